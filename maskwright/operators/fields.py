"""Field rules and field-name signals over structured texts.

The readers of ``sources.formats`` give each text's values as an array of spans;
everything after that is Catalyst: the rule of each span, its replacement, the
way that it is written, the splice and the dictionary of what was found.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import splice
from ..functions.entropy import entropy
from ..functions.replace import DEMO_KEY, replace_any
from ..sources import formats

SPAN = "struct<path:string,start:int,stop:int,value:string,style:int>"


#: Stands between the path of a value and a path inside of it.
INSIDE = "\x1f"
#: What a value may be read as (fixed names), and the reader of each.
SUB_PROCESSORS = {"yaml": "yaml", "json": "json", "toml": "toml", "ini": "ini", "env": "env", "log_line": "log"}


@dataclass(frozen=True)
class FieldRule:
    """pattern is a path glob; shorter values than min_length (bytes) stay, and no signal is asked for them.

    With a sub_processor, the value is read as such a text itself and only what
    sub_rules name in it is replaced; a value that is no such text, or that its
    own format writes with escapes, is replaced as a whole.
    """

    pattern: str
    category: str
    label: str = "profile-field"
    min_length: int = 0
    sub_processor: str | None = None
    sub_rules: tuple[FieldRule, ...] = ()

    def __post_init__(self) -> None:
        if self.sub_processor is not None and self.sub_processor not in SUB_PROCESSORS:
            raise ValueError(f"unknown sub_processor {self.sub_processor!r}; there are {', '.join(SUB_PROCESSORS)}")

    @property
    def regex(self) -> str:
        return path_regex(self.pattern)


@dataclass(frozen=True)
class _Inner:
    """A sub_rule under the path of its rule."""

    regex: str
    category: str
    label: str
    min_length: int


def flat(rules: Sequence[FieldRule]) -> list:
    """The rules, each behind those of the texts inside of its values."""
    out: list = []
    for r in rules:
        out += [_Inner(r.regex.removesuffix(r"\z") + INSIDE + s.regex.removeprefix(r"(?s)\A"), s.category, s.label, s.min_length) for s in r.sub_rules]
        out.append(r)
    return out


@dataclass(frozen=True)
class Signal:
    """key is searched in the last part of a path, case aside; the value needs threshold bits a byte."""

    key: str
    category: str = "custom:credential"
    label: str = "field-name-signal"
    threshold: float = 3.0


#: The built-in signals (fixed values: what a key holds, label, the entropy that its value must have).
SIGNALS = (
    Signal(r"password|passwd|secret|private_key|api_secret|client_secret", label="field-signal:strong", threshold=3.0),
    Signal(r"api_key|access_key|auth_token|token|signing_key|encryption_key|credential|cert", label="field-signal:medium", threshold=3.5),
)


def _quote(s: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", s)


def path_regex(glob: str) -> str:
    """A path glob as a pattern: the whole path; * is anything; *.x ends at a dot or is x itself; x.* begins with x and a dot."""
    any_ = f"[^{INSIDE}]*"
    if "*" not in glob:
        return rf"(?s)\A{_quote(glob)}\z"
    if glob.startswith("*.") and "*" not in glob[2:]:
        return rf"(?s)\A(?:{any_}\.)?{_quote(glob[2:])}\z"
    return r"(?s)\A" + any_.join(_quote(p) for p in glob.split("*")) + r"\z"


def _read(text: str, fmt: str, subs: list[tuple[re.Pattern, str]], options: dict) -> list[tuple] | None:
    """The spans of a text, with those inside of values that a rule has a reader for."""
    found = formats.spans(text, fmt, **options)
    if found is None or not subs:
        return found
    out = []
    for span in found:
        path, start, stop, value = span[:4]
        inner = next((f for p, f in subs if p.search(path)), None)
        own = formats.spans(value, inner) if inner and text[start:stop] == value else None
        out += [span] if own is None else [(f"{path}{INSIDE}{x[0]}", start + x[1], start + x[2], *x[3:]) for x in own]
    return out


def with_spans(df: DataFrame, text: str, fmt: str, rules: Sequence[FieldRule] = (), **options) -> DataFrame:
    """df with spans; null where the text is null or not of the format."""
    subs = [(r.regex.replace(r"\z", r"\Z"), SUB_PROCESSORS[r.sub_processor]) for r in rules if r.sub_processor]

    @F.pandas_udf(f"array<{SPAN}>")
    def read(texts: pd.Series) -> pd.Series:
        names, inner = ("path", "start", "stop", "value", "style"), [(re.compile(p), f) for p, f in subs]
        return pd.Series([None if (s := _read(t, fmt, inner, options)) is None else [dict(zip(names, x)) for x in s] for t in texts])

    return df.withColumn("spans", read(F.col(text)))


def _chosen(span: Column, rules: Sequence[FieldRule], signals: Sequence[Signal]) -> Column:
    """The number of the rule, or of the signal after all rules, that replaces the span's value; null if it stays."""
    stays = F.lit(None).cast("int")
    leaf = F.regexp_extract(span["path"], r"[^./@]*\z", 0)
    out = stays
    for k, s in reversed(list(enumerate(signals, len(rules)))):
        hit = ~F.contains(span["path"], F.lit(INSIDE)) & leaf.rlike(f"(?i){s.key}") & (entropy(span["value"]) >= s.threshold)
        out = F.when(hit, F.lit(k)).otherwise(out)
    for k, r in reversed(list(enumerate(rules))):
        fits = F.when(F.octet_length(span["value"]) >= r.min_length, F.lit(k)).otherwise(stays)
        out = F.when(span["path"].rlike(r.regex), fits).otherwise(out)
    return out


def edits(spans: Column, rules: Sequence[FieldRule], signals: Sequence[Signal] = ()) -> Column:
    """The spans that are replaced, each with the number of its rule or signal."""
    named = F.transform(spans, lambda s: F.struct(s["path"].alias("path"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), s["style"].alias("style"), _chosen(s, rules, signals).alias("rule")))
    return F.filter(named, lambda e: e["rule"].isNotNull())


def _written(new: Column, style: Column) -> Column:
    escaped = F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    marked = F.replace(F.replace(F.replace(F.replace(new, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    out = F.when(style == formats.QUOTED, escaped).when(style == formats.BARE, F.concat(F.lit('"'), escaped, F.lit('"')))
    return out.when(style == formats.XML, marked).when(style == formats.DOUBLED, F.replace(new, F.lit('"'), F.lit('""'))).otherwise(new)


def redact_fields(df: DataFrame, text: str, fmt: str, rules: Sequence[FieldRule], signals: Sequence[Signal] = (), key: bytes = DEMO_KEY, **options) -> DataFrame:
    """df with edits, parsed and sanitized: the first rule that a path fits, else the first signal, replaces a value in its place.

    A null or empty text gives the empty one; a text not of the format stays as
    it is, without edits, and is not parsed.
    """
    every = flat(rules)
    made_by = [*every, *signals]
    t = F.coalesce(F.col(text), F.lit(""))
    out = with_spans(df, text, fmt, rules, **options).withColumn("parsed", F.col("spans").isNotNull())
    out = out.withColumn("edits", F.coalesce(edits(F.col("spans"), every, signals), F.array().cast(f"array<{SPAN.replace('style:int', 'style:int,rule:int')}>"))).drop("spans")
    categories = [r.category for r in made_by]
    new = lambda e: _written(replace_any(e["value"], e["rule"], categories, key), e["style"])
    return out.withColumn("sanitized", splice(t, F.col("edits"), "start", "stop", new) if made_by else t)


def dictionary(redacted: DataFrame, rules: Sequence[FieldRule], signals: Sequence[Signal] = ()) -> DataFrame:
    """category, original: each value that was replaced, once."""
    categories = F.array(*(F.lit(r.category) for r in [*flat(rules), *signals]))
    e = redacted.select(F.explode("edits").alias("e"))
    return e.select(F.element_at(categories, F.col("e.rule") + 1).alias("category"), F.col("e.value").alias("original")).distinct()
