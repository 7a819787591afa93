"""Replacement of tokens that look random: length, characters and Shannon entropy decide."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entropy import entropy
from ..functions.replace import DEMO_KEY, replace
from .textutil import DELIMITERS

#: What a token of each character set may hold (fixed values).
CHARSETS = {"alphanumeric": "^[A-Za-z0-9]+$", "base64": "^[A-Za-z0-9+/=]+$", "hex": "^[0-9A-Fa-f]+$", "any": "^[!-~]+$"}
CLASS = "".join("\\" + c for c in DELIMITERS if c not in " \t\r\n") + " \\t\\r\\n"


@dataclass(frozen=True)
class EntropyRule:
    """Bounds are bytes of the token, threshold is bits a byte."""

    label: str = "high_entropy_token"
    category: str = "auth_token"
    min_length: int = 20
    max_length: int = 200
    threshold: float = 4.5
    charset: str = "alphanumeric"

    def __post_init__(self) -> None:
        if self.charset not in CHARSETS:
            raise ValueError(f"rule {self.label}: unknown charset")

    def fits(self, token: Column) -> Column:
        return F.octet_length(token).between(self.min_length, self.max_length) & token.rlike(CHARSETS[self.charset]) & (entropy(token) >= self.threshold)


def _pieces(text: Column, rules: Sequence[EntropyRule]) -> Column:
    """Tokens and delimiters in order, each with the number of the first rule that it fits."""

    def first(piece: Column) -> Column:
        out = F.lit(None).cast("int")
        for k, r in reversed(list(enumerate(rules))):
            out = F.when(r.fits(piece), k).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(text, F.lit(f"[^{CLASS}]+|[{CLASS}]+"), 0), lambda p: F.struct(p.alias("piece"), first(p).alias("rule")))


def redact_tokens(df: DataFrame, text: str, rules: Sequence[EntropyRule], key: bytes = DEMO_KEY) -> DataFrame:
    """df with sanitized, n_entropy and entropy_counts (label to tokens replaced, without zeros).

    Meant for texts that the patterns have already been replaced in. A null
    text gives the empty one; without rules the text stays.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.create_map().cast("map<string,bigint>")
    if not rules:
        return df.withColumns({"sanitized": t, "n_entropy": F.lit(0).cast("long"), "entropy_counts": none})
    # only a run of non-delimiters this long (in characters, of which each has at most four bytes) can be replaced
    guard = t.rlike("[^%s]{%d,}" % (CLASS, max(1, -(-min(r.min_length for r in rules) // 4))))
    out = df.withColumn("pieces", F.when(guard, _pieces(t, rules)))

    def new(p: Column) -> Column:
        made = p["piece"]
        for k, r in enumerate(rules):
            made = F.when(p["rule"] == k, replace(p["piece"], r.category, key)).otherwise(made)
        return made

    count = lambda ks: F.size(F.filter("pieces", lambda p: p["rule"].isin(ks))).cast("long")
    labels: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        labels.setdefault(r.label, []).append(k)
    counts = F.map_filter(F.create_map(*(c for name, ks in labels.items() for c in (F.lit(name), count(ks)))), lambda _, n: n > 0)
    hit = F.col("pieces").isNotNull() & F.exists("pieces", lambda p: p["rule"].isNotNull())
    columns = {
        "sanitized": F.when(hit, F.array_join(F.transform("pieces", new), "")).otherwise(t),
        "n_entropy": F.when(hit, count(list(range(len(rules))))).otherwise(F.lit(0).cast("long")),
        "entropy_counts": F.when(hit, counts).otherwise(none),
    }
    return out.withColumns(columns).drop("pieces")
