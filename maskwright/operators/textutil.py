"""Allow lists, entropy, value stripping, log context and archive-entry filters."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.entropy import entropy

#: Characters that part entropy tokens (fixed values).
DELIMITERS = " \t\n\r\"'`=:,;()[]{}|<>@#\\/^~!?&%$*"
_CLASS = "".join("\\" + c for c in DELIMITERS if c not in " \t\r\n") + " \\t\\r\\n"
KEYWORDS = ("error", "failure", "warning", "warn", "fatal", "exception", "critical")


def allowed(value: Column, patterns: Sequence[str], case_sensitive: bool = False) -> Column:
    """The first pattern that allows a value, or null: exact ones, then globs with *, then regex: ones."""
    fold = (lambda c: c) if case_sensitive else F.lower
    low = (lambda s: s) if case_sensitive else str.lower
    v, out = fold(value), F.lit(None).cast("string")
    rank = lambda p: 2 if p.startswith("regex:") else 1 if "*" in p else 0
    for p in reversed(sorted(patterns, key=rank)):
        if rank(p) == 2:
            hit = value.rlike(p[6:])
        elif rank(p) == 1:
            hit = v.rlike(rf"(?s)\A{_glob(low(p))}\z")
        else:
            hit = v == low(p)
        out = F.when(hit, F.lit(p)).otherwise(out)
    return out


def is_allowed(value: Column, patterns: Sequence[str], case_sensitive: bool = False) -> Column:
    """Whether any of the patterns allows a value."""
    v, low = (value, lambda s: s) if case_sensitive else (F.lower(value), str.lower)
    exact = [low(p) for p in patterns if "*" not in p and not p.startswith("regex:")]
    globs = [_glob(low(p)) for p in patterns if "*" in p and not p.startswith("regex:")]
    out = v.isin(exact)
    if globs:
        out |= v.rlike(r"(?s)\A(?:" + "|".join(globs) + r")\z")
    for p in patterns:
        if p.startswith("regex:"):
            out |= value.rlike(p[6:])
    return out


def seen_counts(df: DataFrame, value: str, patterns: Sequence[str], case_sensitive: bool = False) -> DataFrame:
    """pattern and how many of df's values it allows, zero included."""
    hits = df.select(allowed(F.col(value), patterns, case_sensitive).alias("pattern")).where("pattern is not null").groupBy("pattern").agg(F.count("*").alias("seen"))
    known = df.sparkSession.createDataFrame([(p,) for p in dict.fromkeys(patterns)], "pattern string")
    return known.join(F.broadcast(hits), "pattern", "left").select("pattern", F.coalesce("seen", F.lit(0)).alias("seen"))  # a row for each pattern


def checked_patterns(patterns: Sequence[str]) -> tuple[list[str], list[str]]:
    """The patterns that can be used, and a warning for each one that cannot or that looks like something else; by number, not by text."""
    good, warnings = [], []
    for k, p in enumerate(patterns):
        if p.startswith("regex:"):
            try:
                re.compile(p[6:])
            except re.error:
                warnings.append(f"allow pattern {k}: not a regular expression, left out")
                continue
        elif re.search(r"[\\^$+()\[\]|]|\{[0-9]", p):
            warnings.append(f"allow pattern {k}: holds signs of regular expressions but does not begin with regex:")
        good.append(p)
    return good, warnings


def _glob(pattern: str) -> str:
    return ".*".join(re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", x) for x in pattern.split("*"))


def strip_values(text: Column, delimiter: str = "=", comment: str = "#") -> Column:
    """Every line up to and including its first delimiter; blank lines, comments and lines without one stay. Ends with a line feed."""
    lines = F.split(F.regexp_replace(text, "\r?\n$", ""), "\r?\n")
    bare = lambda s: (F.trim(s) == "") | F.ltrim(s).startswith(comment) | (F.instr(s, delimiter) == 0)
    return F.concat(F.array_join(F.transform(lines, lambda s: F.when(bare(s), s).otherwise(F.substr(s, F.lit(1), F.instr(s, delimiter) + len(delimiter) - 1))), "\n"), F.lit("\n"))


def entropy_tokens(df: DataFrame, id_: str, text: str, min_length: int = 20, max_length: int = 200) -> DataFrame:
    """id, token and its Shannon entropy in bits a byte, for ASCII alphanumeric tokens within the bounds."""
    t = F.coalesce(F.col(text), F.lit(""))
    run = F.regexp_extract_all(t, F.lit("[^%s]{%d,}" % (_CLASS, min_length)), 0)
    tokens = F.filter(run, lambda x: x.rlike(r"\A[A-Za-z0-9]+\z") & F.octet_length(x).between(min_length, max_length))
    tok = df.select(id_, F.explode(tokens).alias("token")).distinct()
    return tok.select(id_, "token", F.round(entropy(F.col("token")), 6).alias("bits"))


def log_context(df: DataFrame, id_: str, text: str, keywords: Sequence[str] = KEYWORDS, around: int = 2, cap: int | None = 50, case_sensitive: bool = False) -> DataFrame:
    """Lines with a keyword (the first in list order), with the lines before and after; at most cap for each document.

    truncated tells that a document has more such lines than cap.
    """
    fold = (lambda c: c) if case_sensitive else F.lower
    words = [k if case_sensitive else k.lower() for k in keywords]
    word = lambda line: F.coalesce(*(F.when(F.contains(line, F.lit(k)), F.lit(k)) for k in words))
    t = F.coalesce(F.col(text), F.lit(""))

    def context(lines: Column) -> Column:
        found = F.transform(lines, lambda line, i: F.struct(i.alias("i"), word(fold(line)).alias("keyword")))
        hits = F.filter(found, lambda x: x["keyword"].isNotNull())
        join = lambda start, n: F.array_join(F.slice(lines, start, n), "\n")

        def near(x: Column) -> Column:
            first = F.greatest(x["i"] - around, F.lit(0))
            return F.struct((x["i"] + 1).cast("long").alias("line_number"), x["keyword"].alias("keyword"), F.element_at(lines, x["i"] + 1).alias("line"), join(first + 1, x["i"] - first).alias("before"), join(x["i"] + 2, F.lit(around)).alias("after"))

        mine = (lambda h: F.slice(h, 1, cap)) if cap is not None else (lambda h: h)
        more = (lambda h: F.size(h) > cap) if cap is not None else (lambda h: F.lit(False))
        return let(hits, lambda h: F.struct(F.transform(mine(h), near).alias("lines"), more(h).alias("truncated")))

    # only texts with a keyword are cut into lines
    some = reduce(lambda a, b: a | b, (F.contains(fold(t), F.lit(k)) for k in words))
    found = df.where(some).select(id_, let(F.split(t, "\n"), context).alias("c"))
    return found.select(id_, "c.truncated", F.explode("c.lines").alias("l")).select(id_, "l.*", "truncated")


def safe_entry_name(name: Column) -> Column:
    """An archive entry's name without drive letters, leading slashes, . and .. parts; _ if nothing is left."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(name, "\\\\", "/"), "^[A-Za-z]:", ""), "/"), lambda p: ~p.isin("", ".", ".."))
    joined = F.array_join(parts, "/")
    return F.when(joined == "", "_").otherwise(joined)


def test_patterns(df: DataFrame, value: str, rules: Sequence) -> DataFrame:
    """df's value beside label, start, stop (characters from 0), matched and partial of the first hit of every rule that has one.

    matched is the first group where the rule has one; partial tells that the
    hit is not the whole value.
    """
    v = F.coalesce(F.col(value), F.lit(""))
    tests = []
    for r in rules:
        hit = F.regexp_extract_all(v, F.lit(r.regex), 0)
        part = F.regexp_extract_all(v, F.lit(r.regex), 1) if r.has_group else hit
        start = F.char_length(F.element_at(F.split(v, r.regex, 2), 1))
        tests.append(F.when(F.size(hit) > 0, F.struct(F.lit(r.label).alias("label"), start.alias("start"), (start + F.char_length(hit[0])).alias("stop"), part[0].alias("matched"), (hit[0] != v).alias("partial"))))
    return df.select(value, F.explode(F.array_compact(F.array(*tests))).alias("m")).select(value, "m.*")


test_patterns.__test__ = False  # not a test, whatever its name


def notable_events(context: DataFrame, id_: str) -> DataFrame:
    """id_ and events: log_context's lines as text, each line found as ``>>> [keyword] line`` amid its neighbours, two spaces in."""
    indent = lambda c: F.transform(F.filter(F.split(c, "\n"), lambda s: s != ""), lambda s: F.concat(F.lit("  "), s))
    block = F.array_join(F.concat(indent("before"), F.array(F.concat(F.lit(">>> ["), "keyword", F.lit("] "), "line")), indent("after")), "\n")
    return context.groupBy(id_).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_number", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("events"))


#: What a prompt asks for, by name.
TEMPLATES = {
    "summary": "The texts below were sanitized: values that looked secret or personal are replaced by made-up ones of the same form. Sum up what they show.",
    "incident": "The texts below were sanitized: values that looked secret or personal are replaced by made-up ones of the same form. Find what went wrong, in which order, and what to look at next.",
    "review": "The texts below were sanitized: values that looked secret or personal are replaced by made-up ones of the same form. Review the settings for mistakes and risks.",
}


def prompt_head(template: str, per_file: DataFrame) -> str:
    """A template (a name of TEMPLATES, or a text) with the totals of report.files() behind it."""
    total = per_file.agg(F.count("*").alias("n"), F.coalesce(F.sum("matches"), F.lit(0)).alias("m")).first()
    return f"{TEMPLATES.get(template, template)}\n\n{total['n']} files, {total['m']} values replaced."


def prompts(df: DataFrame, path: str, sanitized: str, template: str, events: DataFrame | None = None, by_reference: bool = False) -> DataFrame:
    """path and prompt of each text: the template, the file's name and size and, unless by reference, the sanitized content and its notable events."""
    parts = [F.lit(template), F.lit("\n\nFile: "), F.col(path).cast("string"), F.lit(" ("), F.octet_length(sanitized).cast("string"), F.lit(" bytes)")]
    if not by_reference:
        parts += [F.lit("\n<content>\n"), F.col(sanitized), F.lit("\n</content>")]
    if events is not None:
        df = df.join(events, path, "left")
        parts.append(F.coalesce(F.concat(F.lit("\n<notable_events>\n"), "events", F.lit("\n</notable_events>")), F.lit("")))
    return df.select(path, F.concat(*parts).alias("prompt"))
