"""Escaped forms of dictionary values, so that a value is also found where a format has escaped it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Short escapes, the backslash first (fixed values).
SHORT = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
MORE = (("\b", "\\b"), ("\f", "\\f"))


def _swap(value: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, value)


def _controls(value: Column, form: str) -> Column:
    """Other control characters as \\u and four hex digits."""
    left = [(chr(i), "\\u" + form % i) for i in range(32) if chr(i) not in "\n\r\t\b\f"]
    return F.when(value.rlike("[\\x00-\\x1f]"), _swap(value, left)).otherwise(value)


def forms(value: Column) -> Column:
    """The distinct escaped forms that differ from the value: JSON, YAML and TOML strings, XML text and attributes, CSV."""
    plain = _swap(value, SHORT)
    xml = _swap(value, (("&", "&amp;"), ("<", "&lt;")))
    double, single = (('"', "&quot;"),), (("'", "&apos;"),)
    every = F.array(
        _controls(_swap(plain, MORE), "%04x"),
        plain,
        _controls(_swap(plain, MORE), "%04X"),
        xml,
        _swap(xml, double),
        _swap(xml, single),
        _swap(xml, ((">", "&gt;"), *double, *single)),
        _swap(value, (('"', '""'),)),
    )
    return F.array_distinct(F.filter(every, lambda v: v != value))


def with_aliases(dictionary: DataFrame, sanitized: str = "sanitized") -> DataFrame:
    """category, original and sanitized of a dictionary, with a row for each escaped form; forms share their value's replacement.

    A form that is a value of the dictionary itself keeps its own row; of
    equal forms, the one with the least replacement stays.
    """
    own = dictionary.select("category", "original", sanitized)
    more = own.select("category", F.explode(forms(F.col("original"))).alias("original"), sanitized).join(own.select("category", "original"), ["category", "original"], "left_anti")
    return own.unionByName(more.groupBy("category", "original").agg(F.min(sanitized).alias(sanitized)))
