"""Which inputs are taken, what they are, and the names of their outputs, as expressions over paths and contents."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Directories of version control that a walk leaves out (fixed values).
SKIPPED = (".git", ".hg", ".svn", ".bzr")
#: Formats by file extension (fixed values).
EXTENSIONS = {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "csv": "csv", "tsv": "tsv", "env": "env", "ini": "ini", "cfg": "ini", "conf": "key_value", "properties": "key_value", "log": "log"}
ARCHIVES = {"tar.gz": "tar.gz", "tgz": "tar.gz", "tar": "tar", "zip": "zip", "gz": "gz"}


def glob_regex(glob: str) -> str:
    """A path glob as a Java pattern: * and ? stop at a slash, ** does not, [..] and [!..] are classes."""
    out, i = "", 0
    while i < len(glob):
        rest = glob[i:]
        if rest.startswith("**/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rest.startswith("**"):
            out, i = out + ".*", i + 2
        elif rest[0] == "*":
            out, i = out + "[^/]*", i + 1
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif (m := re.match(r"\[(!?)([^\]]+)\]", rest)) is not None:
            out, i = out + "[" + ("^/" if m[1] else "") + re.sub(r"([\\\[&^])", r"\\\1", m[2]) + "]", i + m.end()
        else:
            out, i = out + re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", rest[0]), i + 1
    return out


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def path_matches(path: Column, glob: str) -> Column:
    """A glob with a trailing slash takes a subtree; one without any slash, a base name; others, the whole path."""
    if glob.endswith("/"):
        return path.startswith(glob) | F.contains(path, F.lit("/" + glob)) if "/" not in glob[:-1] else path.startswith(glob)
    if "/" not in glob:
        return F.element_at(F.split(path, "/"), -1).rlike(rf"(?s)\A{glob_regex(glob)}\z")
    return path.rlike(rf"(?s)\A{glob_regex(glob)}\z")


def entry_matches(entry: Column, glob: str) -> Column:
    """An archive entry against a glob of its whole path; with a trailing slash, against that directory and what is in it."""
    if glob.endswith("/"):
        bare = glob.rstrip("/")
        return (entry == bare) | entry.startswith(bare + "/")
    return entry.rlike(rf"(?s)\A{glob_regex(glob)}\z")


def selected(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), matches=path_matches) -> Column:
    """Whether a path passes: any of include, if there are some, and none of exclude."""
    inside = _any([matches(path, g) for g in include]) if include else F.lit(True)
    return inside & ~_any([matches(path, g) for g in exclude])


def walkable(path: Column, hidden: bool = False) -> Column:
    """Whether a directory walk takes a path (relative to its root): no version control, hidden names only on request."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin(*SKIPPED))
    return ~bad if hidden else ~bad & ~F.exists(parts, lambda p: p.startswith("."))


def looks_binary(content: Column) -> Column:
    """Whether the first 512 bytes hold a zero, or more than a tenth of them are control bytes other than tab, line feed and return."""
    h = F.hex(F.substring(content, 1, 512))
    n = F.char_length(h) / 2
    pairs = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.substr(h, i * 2 - 1, F.lit(2)))
    odd = F.size(F.filter(pairs, lambda b: (b < "20") & ~b.isin("09", "0A", "0D")))
    return F.when(n > 0, F.exists(pairs, lambda b: b == "00") | (odd / n > 0.1)).otherwise(False)


def format_of(path: Column) -> Column:
    """Archive kind or format by the name's ending; text for others."""
    low, out = F.lower(path), F.lit("text")
    for ends in (EXTENSIONS, ARCHIVES):
        for ext, name in reversed(ends.items()):
            out = F.when(low.endswith("." + ext), name).otherwise(out)
    return out


def output_name(path: Column) -> Column:
    """name-sanitized.ext for plain inputs, name.sanitized.ext for archives, in the input's directory."""
    cut = F.char_length(path) - F.char_length(F.element_at(F.split(path, "/"), -1))
    head, name = F.substr(path, F.lit(1), cut), F.substr(path, cut + 1)
    archive = F.regexp_extract(name, r"(?i)^(.*?)(\.tar\.gz|\.tgz|\.tar|\.zip|\.gz)$", 1)
    kind = F.regexp_replace(F.lower(F.regexp_extract(name, r"(?i)(\.tar\.gz|\.tgz|\.tar|\.zip|\.gz)$", 1)), r"^\.tgz$", ".tar.gz")
    stem, ext = F.regexp_extract(name, r"(?s)^(.*)\.([^.]*)$", 1), F.regexp_extract(name, r"(?s)^(.*)\.([^.]*)$", 2)
    plain = F.when(F.contains(name, F.lit(".")), F.concat(stem, F.lit("-sanitized."), ext)).otherwise(F.concat(name, F.lit("-sanitized")))
    return F.concat(head, F.when(kind != "", F.concat(archive, F.lit(".sanitized"), kind)).otherwise(plain))


def output_names(df: DataFrame, path: str) -> DataFrame:
    """df with output: the name of each path's output; of equal ones the later by path get -1, -2 and so on before the extension."""
    out = df.withColumn("output", output_name(F.col(path)))
    k = F.row_number().over(Window.partitionBy("output").orderBy(path)) - 1
    numbered = F.regexp_replace("output", r"(?s)^(.*?)(\.tar\.gz|\.[^./]*)?$", F.concat(F.lit("$1-"), F.col("k").cast("string"), F.lit("$2")))
    return out.withColumn("k", k).withColumn("output", F.when(F.col("k") > 0, numbered).otherwise(F.col("output"))).drop("k")
