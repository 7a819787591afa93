"""Shannon entropy as a Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a byte; 0 for the empty text."""
    h = F.hex(F.encode(value, "UTF-8"))
    n = F.octet_length(value)
    every = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(h, i * 2 + 1, F.lit(2)))).otherwise(F.array().cast("array<string>"))

    def add(acc: Column, b: Column) -> Column:
        p = F.size(F.filter(every, lambda x: x == b)) / n
        return acc - p * F.log2(p)

    return F.aggregate(F.array_distinct(every), F.lit(0.0), add)
