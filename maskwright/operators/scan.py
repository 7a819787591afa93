"""Scans: every rule's matches, the leftmost-longest selection, replacement and locations.

One array of matches for each row drives everything. A rule runs only on rows
that hold what all of its hits hold (its ``hints``). Its matches are built from
``split`` and ``regexp_extract_all``: pieces and hits alternate, so their
running lengths are the offsets. A rule with a group is cut at it into three
parts, which gives the place of the group in the hit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import blocks, cut, emit, let, splice
from ..functions.replace import DEMO_KEY, is_mask, replace_any
from ..rules import Rule

#: before are the hit's characters ahead of the value, the part that is replaced.
MATCH = "struct<start:int,stop:int,rule:int,hit:string,before:string,value:string>"
#: What stands for a hit longer than the scan's bound, and its label (fixed values).
OVERLONG_MARKER, OVERLONG_LABEL = "__SANITIZED_OVERLONG__", "overlong-redacted"
#: Bytes of the longest hit that is replaced by its own kind.
LONGEST = 1 << 20
_OVERLONG = -1


def _hinted(text: Column, low: Column, rule: Rule) -> Column:
    """Whether the text can hold a hit of the rule."""
    if not rule.hints:
        return text.rlike(rule.regex)
    return reduce(lambda a, b: a | b, (text.rlike(h[6:]) if h.startswith("regex:") else F.contains(low, F.lit(h[6:])) if h.startswith("lower:") else F.contains(text, F.lit(h)) for h in rule.hints))


def _gate(text: Column, low: Column, rules: Sequence[Rule]) -> Column:
    """Whether the text can hold a hit of any rule, by what the rules' gates share."""
    if not all(r.gate for r in rules):
        return F.lit(True)
    every = dict.fromkeys(g for r in rules for g in r.gate)
    tests = [F.contains(low, F.lit(g[6:])) if g.startswith("lower:") else F.contains(text, F.lit(g)) for g in every if not g.startswith("regex:")]
    if patterns := [g[6:] for g in every if g.startswith("regex:")]:
        tests.append(text.rlike("|".join(patterns)))
    return reduce(lambda a, b: a | b, tests)


def _spans_by_python(rule: Rule):
    """Hits, befores and values of a rule whose group can't be cut out of its pattern."""

    @F.pandas_udf("array<struct<start:int,stop:int,hit:string,before:string,value:string>>")
    def spans(texts: pd.Series) -> pd.Series:
        import re

        p = re.compile(rule.pattern, re.ASCII)

        def of(t: str) -> list[dict]:
            out = []
            for m in p.finditer(t):
                a, b = m.span(1) if m.start(1) >= 0 else m.span()
                out.append({"start": m.start(), "stop": m.end(), "hit": m[0], "before": t[m.start() : a], "value": t[a:b]})
            return out

        return pd.Series([None if t is None else of(t) for t in texts])

    return spans


#: A rule's hits and what stands between them; befores and values only where the rule has a group.
_FOUND = "struct<rule:int,least:int,most:int,gaps:array<string>,hits:array<string>,befores:array<string>,values:array<string>>"


def _found(text: Column, rule: Rule, number: int) -> Column:
    """The hits of a rule that can be cut at its group."""
    if rule.has_group:
        flags, before, group, behind = rule.parts
        pattern = f"{flags}({before})({group}){behind}"
        hits, befores, values = (F.regexp_extract_all(text, F.lit(pattern), k) for k in range(3))
    else:
        hits = F.regexp_extract_all(text, F.lit(rule.regex), 0)
        befores = values = F.lit(None)
    bounds = F.lit(rule.min_length or 0), F.lit((1 << 31) - 1 if rule.max_length is None else rule.max_length)
    return F.struct(F.lit(number), *bounds, F.split(text, rule.regex, -1), hits, befores, values).cast(_FOUND)


def _placed(found: Column) -> Column:
    """The matches of one rule's hits, in order, within its bounds of length."""
    plain = found["values"].isNull()
    none = F.array().cast("array<string>")
    rows = F.arrays_zip(F.slice(found["gaps"], F.lit(1), F.size(found["hits"])).alias("gap"), found["hits"].alias("hit"), F.coalesce(found["befores"], none).alias("before"), F.coalesce(found["values"], found["hits"]).alias("value"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.char_length(x["gap"])
        stop = start + F.char_length(x["hit"])
        one = F.struct(start.alias("start"), stop.alias("stop"), found["rule"].alias("rule"), x["hit"].alias("hit"), F.when(plain, "").otherwise(x["before"]).alias("before"), x["value"].alias("value"))
        return stop, F.array(one)

    fits = lambda m: F.octet_length(m["hit"]).between(found["least"], found["most"])
    return F.filter(emit(rows, F.lit(0), MATCH, step), fits)


def _nested(text: Column, rule: Rule, number: int) -> Column:
    """The matches of a rule whose group can't be cut out of its pattern."""
    out = F.transform(_spans_by_python(rule)(text), lambda m: F.struct(m["start"], m["stop"], F.lit(number), m["hit"], m["before"], m["value"]).cast(MATCH))
    return F.filter(out, lambda m: F.octet_length(m["hit"]).between(rule.min_length or 0, (1 << 31) - 1 if rule.max_length is None else rule.max_length))


def _bounded(text: Column, found: Column, longest: int) -> Column:
    """Hits over the bound in bytes become overlong ones, which reach to the first space behind the bound."""

    def one(m: Column) -> Column:
        stop = m["start"] + longest
        run = F.char_length(F.regexp_extract(F.substr(text, stop + 1), r"\A[^ \t\r\n\f]*", 0))
        return F.when(F.octet_length(m["hit"]) > longest, F.struct(m["start"].alias("start"), F.least(stop + run, F.char_length(text)).alias("stop"), F.lit(_OVERLONG).alias("rule"), F.lit("").alias("hit"), F.lit("").alias("before"), F.lit("").alias("value"))).otherwise(m)

    return F.when(F.octet_length(text) > longest, F.transform(found, one)).otherwise(found)


def find_matches(text: Column, rules: Sequence[Rule], longest: int = LONGEST, only: Callable[[Rule], Column | None] | None = None) -> Column:
    """The selected matches of a text: by start, then length, then literals, then rule order; the first of overlapping ones.

    only(rule) may give a condition of the row without which the rule is left out.
    """
    none = F.array().cast(f"array<{MATCH}>")
    if not rules:
        return none
    literal = [k for k, r in enumerate(rules) if r.kind == "literal"]

    def order(x: Column, y: Column) -> Column:
        kind = lambda m: F.when(m["rule"].isin(literal), 0).otherwise(1) if literal else F.lit(1)
        keys = [lambda m: m["start"], lambda m: -m["stop"], kind, lambda m: m["rule"]]
        out = F.lit(0)
        for k in reversed(keys):
            out = F.when(k(x) < k(y), -1).when(k(x) > k(y), 1).otherwise(out)
        return out

    nested = [k for k, r in enumerate(rules) if r.has_group and r.parts is None]
    on = lambda r, c: c if only is None or (own := only(r)) is None else own & c

    def every(low: Column) -> Column:
        each = [F.when(on(r, _hinted(text, low, r)), _found(text, r, k)) for k, r in enumerate(rules) if k not in nested]
        out = F.flatten(F.transform(F.array_compact(F.array(*each)), _placed)) if each else none
        return F.concat(out, *(F.when(on(rules[k], F.lit(True)), F.coalesce(_nested(text, rules[k], k), none)).otherwise(none) for k in nested)) if nested else out

    pick = lambda at, m: (F.when(m["start"] >= at, m["stop"]).otherwise(at), F.when(m["start"] >= at, F.array(m)).otherwise(none))
    chosen = lambda xs: F.when(F.size(xs) < 2, xs).otherwise(emit(F.array_sort(xs, order), F.lit(0), MATCH, pick))
    found = let(F.lower(text), every) if any(h.startswith("lower:") for r in rules for h in r.hints) else every(text)
    return F.when(_gate(text, F.lower(text), rules), let(_bounded(text, found, longest), chosen)).otherwise(none)


def with_matches(df: DataFrame, text: str, rules: Sequence[Rule], longest: int = LONGEST, only: Callable[[Rule], Column | None] | None = None) -> DataFrame:
    """df with its selected matches; a null text has none."""
    return df.withColumn("matches", find_matches(F.coalesce(F.col(text), F.lit("")), rules, longest, only))


def labels_of(rules: Sequence[Rule], rule: Column) -> Column:
    """The label of a match by its rule's number."""
    return F.when(rule == _OVERLONG, F.lit(OVERLONG_LABEL)).otherwise(F.element_at(F.array(*(F.lit(r.label) for r in rules)), F.greatest(rule, F.lit(0)) + 1))


def redact(df: DataFrame, text: str, rules: Sequence[Rule], key: bytes = DEMO_KEY, allowed: Callable[[Column], Column] | None = None, longest: int = LONGEST, made: Callable[[Column, Column], Column] | None = None, only: Callable[[Rule], Column | None] | None = None) -> DataFrame:
    """df with sanitized beside matches: each match's value (its first group, if the rule has one) is replaced.

    allowed is a function of a value's Column that tells which values stay
    (they are matches still); made(value, number of the rule) takes the place
    of the replacement by key. A hit of more than longest bytes becomes a fixed
    marker up to the next space.
    """
    categories = [r.category for r in rules]

    def new(m: Column) -> Column:
        out = F.when(m["rule"] == _OVERLONG, F.lit(OVERLONG_MARKER))
        if allowed is not None:
            out = out.when(allowed(m["value"]), m["value"])
        put = made(m["value"], m["rule"]) if made else replace_any(m["value"], m["rule"], categories, key)
        rest = F.substr(m["hit"], F.char_length(m["before"]) + F.char_length(m["value"]) + 1)
        return F.concat(m["before"], out.otherwise(put), rest)

    t = F.coalesce(F.col(text), F.lit(""))
    found = with_matches(df, text, rules, longest, only)
    return found.withColumn("sanitized", splice(t, F.col("matches"), "start", "stop", new) if rules else t)


def locations(df: DataFrame, id_: str, text: str, rules: Sequence[Rule], cap: int | None = None, longest: int = LONGEST) -> DataFrame:
    """id, line (from 1), byte_offset (from 0) and pattern of every match, at most cap for each row of df.

    With a cap there is a column truncated, which tells that the row has more.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = with_matches(df, text, rules, longest)
    more = F.size("matches") > cap if cap is not None else F.lit(False)
    mine = F.slice("matches", 1, cap) if cap is not None else F.col("matches")

    def placed(pieces: Column) -> Column:
        def step(s: Column, m: Column) -> tuple[Column, Column]:
            gap = cut(pieces, s["at"], m["start"])
            line = s["line"] + F.octet_length(gap) - F.octet_length(F.replace(gap, F.lit("\n"), F.lit("")))
            byte = s["byte"] + F.octet_length(gap)
            return F.struct(m["start"].alias("at"), line.alias("line"), byte.alias("byte")), F.array(F.struct(line.cast("long").alias("line"), byte.cast("long").alias("byte"), m["rule"].alias("rule")))

        begin = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.lit(0).alias("byte"))
        return emit(mine, begin, "struct<line:bigint,byte:bigint,rule:int>", step)

    at = F.when(F.size("matches") > 0, let(blocks(t), placed)).otherwise(F.array().cast("array<struct<line:bigint,byte:bigint,rule:int>>"))
    one = found.select(id_, more.alias("truncated"), F.explode(at).alias("m"))
    out = one.select(id_, F.col("m.line").alias("line"), F.col("m.byte").alias("byte_offset"), labels_of(rules, F.col("m.rule")).alias("pattern"), "truncated")
    return out if cap is not None else out.drop("truncated")


def counts(df: DataFrame, id_: str, text: str, rules: Sequence[Rule], longest: int = LONGEST) -> DataFrame:
    """id, pattern, matches: one row for each label that a row of df holds."""
    one = with_matches(df, text, rules, longest).select(id_, F.explode("matches").alias("m"))
    return one.groupBy(id_, labels_of(rules, F.col("m.rule")).alias("pattern")).agg(F.count("*").alias("matches"))


def totals(df: DataFrame, text: str, rules: Sequence[Rule]) -> DataFrame:
    """pattern and matches: how often each rule's pattern stands in all texts, whatever other rules match there."""
    t, low = F.coalesce(F.col(text), F.lit("")), F.lower(F.coalesce(F.col(text), F.lit("")))
    sums = df.where(_gate(t, low, rules)).agg(*(F.coalesce(F.sum(F.when(_hinted(t, low, r), F.regexp_count(t, F.lit(r.regex)))), F.lit(0)).cast("long").alias(str(k)) for k, r in enumerate(rules)))
    pairs = F.arrays_zip(F.array(*(F.lit(r.label) for r in rules)).alias("pattern"), F.array(*(F.col(f"`{k}`") for k in range(len(rules)))).alias("matches"))
    return sums.select(F.inline(pairs))


def dictionary(df: DataFrame, text: str, rules: Sequence[Rule], allowed: Callable[[Column], Column] | None = None, longest: int = LONGEST) -> DataFrame:
    """category and original of every value that is replaced, once: what is allowed, empty or masked already is not."""
    one = with_matches(df, text, rules, longest).select(F.explode("matches").alias("m")).where(F.col("m.rule") >= 0)
    category = F.element_at(F.array(*(F.lit(r.category) for r in rules)), F.col("m.rule") + 1)
    out = one.select(category.alias("category"), F.col("m.value").alias("original")).distinct()
    out = out.where((F.col("original") != "") & ~is_mask(F.col("original")))
    return out if allowed is None else out.where(~allowed(F.col("original")))
