"""Profiles say how the inputs of a kind are read and which of their fields are replaced; sanitize runs the whole engine."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replace import DEMO_KEY
from ..rules import Rule
from . import entropy, fields, propagate, scan
from .inputs import path_matches


@dataclass(frozen=True)
class Profile:
    """Takes the paths that end in one of extensions, match any of include (if there are some) and none of exclude."""

    format: str
    extensions: tuple[str, ...]
    rules: tuple[fields.FieldRule, ...] = ()
    signals: tuple[fields.Signal, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)

    def takes(self, path: Column) -> Column:
        some = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
        out = some([F.lower(path).endswith(e.lower()) for e in self.extensions])
        if self.include:
            out &= some([path_matches(path, g) for g in self.include])
        return out & ~some([path_matches(path, g) for g in self.exclude])


def choose(df: DataFrame, path: str, profiles: Sequence[Profile]) -> DataFrame:
    """df with profile: the number of the first profile that takes the path, else null."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(profiles))):
        out = F.when(profiles[k].takes(F.col(path)), k).otherwise(out)
    return df.withColumn("profile", out)


def discover(df: DataFrame, path: str, text: str, profiles: Sequence[Profile]) -> DataFrame:
    """category and original of every value that a profile's rules or signals find."""
    chosen = choose(df, path, profiles)
    parts = []
    for k, p in enumerate(profiles):
        read = fields.redact_fields(chosen.where(F.col("profile") == k), text, p.format, p.rules, p.signals, **p.options)
        parts.append(fields.dictionary(read, p.rules, p.signals))
    if not parts:
        return df.sparkSession.createDataFrame([], "category string, original string")
    return reduce(DataFrame.union, parts).distinct()


def sanitize(df: DataFrame, path: str, text: str, rules: Sequence[Rule], profiles: Sequence[Profile] = (), tokens: Sequence[entropy.EntropyRule] = (), key: bytes = DEMO_KEY, allowed: Callable[[Column], Column] | None = None, made: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """path and sanitized of every input (null texts as empty ones; rows of equal paths stay apart).

    First the fields that profiles name are replaced; then every value found
    so, wherever else it stands and in any escaped form; then the rules'
    matches (without the key-value rules where a profile has read the text; a
    text that its profile's reader cannot parse gets them all); last, tokens
    that look random.
    """
    chosen = choose(df.select(F.col(path).alias("path"), F.col(text).alias("text")), "path", profiles)
    parts = [chosen.where("profile is null").select("path", "text", "profile")]
    for k, p in enumerate(profiles):
        read = fields.redact_fields(chosen.where(F.col("profile") == k), "text", p.format, p.rules, p.signals, key, **p.options)
        parts.append(read.select("path", F.col("sanitized").alias("text"), F.when(F.col("parsed"), F.col("profile")).alias("profile")))
    out = reduce(DataFrame.unionByName, parts)
    if profiles:
        known = propagate.redact_known(out, "text", discover(df, path, text, profiles), key, escaped=True)
        out = known.select("path", F.col("sanitized").alias("text"), "profile")
    if rules:
        unread = lambda r: F.col("profile").isNull() if profiles and r.label.endswith("_kv") else None
        out = scan.redact(out, "text", rules, key, allowed, made=made, only=unread).select("path", F.col("sanitized").alias("text"), "profile")
    return entropy.redact_tokens(out, "text", tokens, key).select("path", "sanitized")
