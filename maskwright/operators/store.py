"""The dictionary of replacements as a table: category, original, sanitized and the phase in which a value was first met.

Replacements are pure functions of key, category and value, so the table is
derived from the values, not kept by locks: equal values meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replace import DEMO_KEY, is_mask, replace_any
from ..rules import CATEGORIES

#: Values that a store holds at most, unless told otherwise.
CAPACITY = 10_000_000


class CapacityError(ValueError):
    """More values than the store may hold."""


def build(values: DataFrame, key: bytes = DEMO_KEY, allowed=None, phase: int = 0) -> DataFrame:
    """category, original, sanitized and phase of the distinct values (category, original).

    Null and empty values, masks, and what allowed(value) lets stay have no row.
    """
    v = F.col("original")
    own = values.where(v.isNotNull() & (v != "") & ~is_mask(v))
    if allowed is not None:
        own = own.where(~allowed(v))
    names = sorted(r["category"] for r in own.select("category").distinct().collect())  # at most one for each rule
    if not names:
        return own.select("category", "original", F.lit("").alias("sanitized"), F.lit(phase).alias("phase")).limit(0)
    which = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("category")).cast("int") - 1
    return own.select("category", "original").distinct().select("category", "original", replace_any(v, which, names, key).alias("sanitized"), F.lit(phase).alias("phase"))


def extend(store: DataFrame, values: DataFrame, key: bytes = DEMO_KEY, allowed=None, capacity: int | None = CAPACITY) -> DataFrame:
    """The store with the values that it lacks, in the next phase; beyond capacity CapacityError, unless nothing new comes."""
    phase = store.agg(F.coalesce(F.max("phase"), F.lit(-1))).first()[0] + 1
    new = build(values, key, allowed, phase).join(store.select("category", "original"), ["category", "original"], "left_anti")
    out = store.unionByName(new)
    if capacity is not None and not new.isEmpty() and (n := out.count()) > capacity:
        raise CapacityError(f"{n} values; the store may hold {capacity}")
    return out


def lookup(store: DataFrame, values: DataFrame) -> DataFrame:
    """values (category, original) with sanitized, null where the store has none."""
    return values.join(store.select("category", "original", "sanitized"), ["category", "original"], "left")


def since(store: DataFrame, phase: int) -> DataFrame:
    """What came in after a phase; since(store, -1) is all."""
    return store.where(F.col("phase") > phase)


def sizes(store: DataFrame) -> DataFrame:
    """category and the number of its values."""
    return store.groupBy("category").agg(F.count("*").alias("values"))


def known_category(name: Column) -> Column:
    """A category's name as the store writes it: a built-in one, or custom: and the tag."""
    return F.when(name.isin(*CATEGORIES) | name.startswith("custom:"), name).otherwise(F.concat(F.lit("custom:"), name))
