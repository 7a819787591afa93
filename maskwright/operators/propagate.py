"""Propagation: values found in structured texts are replaced wherever else they stand.

The dictionary holds the distinct (category, original) pairs, found without the
driver. To be looked for in other texts a small one goes to the executors as
one automaton. A larger one, of any size, stays distributed: the executors get
a bit table of the hashes of its values (``filters``), which tells the few
places of a text where a value may stand, and what stands there is joined with
the values themselves. So the result does not depend on the table's false hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.replace import DEMO_KEY, replace
from . import filters
from .aliases import forms

#: Shorter values (bytes) are not looked for elsewhere.
LEAST = 4
#: Bytes of all values together that go to the executors as one automaton, which takes some 50 bytes of memory for each.
AUTOMATON_BYTES = 2 << 20
FOUND = "struct<start:int,stop:int,category:string,value:string>"


def literals(dictionary: DataFrame) -> DataFrame:
    """The dictionary's values that are long enough; of one value in several categories, the first by name."""
    return dictionary.where(F.octet_length("original") >= LEAST).groupBy("original").agg(F.min("category").alias("category"))


def _automaton(values: dict[str, tuple[str, str]]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for form, (category, value) in values.items():
        out.add_word(form, (len(form), category, value))
    out.make_automaton()
    return out


def leftmost_longest(hits: Iterator[tuple[int, tuple[int, str, str]]]) -> list[dict]:
    """Of the hits (last character, (length, category, value)): by start, then the longest; the first of overlapping ones."""
    ordered = sorted(((end - n + 1, end + 1, c, v) for end, (n, c, v) in hits), key=lambda h: (h[0], -h[1]))
    out, at = [], 0
    for start, stop, c, v in ordered:
        if start >= at:
            out.append({"start": start, "stop": stop, "category": c, "value": v})
            at = stop
    return out


def _by_automaton(df: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """df with found, by one automaton of all words."""
    known = df.sparkSession.sparkContext.broadcast({r["form"]: (r["category"], r["original"]) for r in words.collect()})

    @F.pandas_udf(f"array<{FOUND}>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = _automaton(known.value) if known.value else None
        for texts in batches:
            yield pd.Series([leftmost_longest(auto.iter(t)) if auto is not None and t else [] for t in texts])

    return df.withColumn("found", search(F.col(text)))


def _by_join(df: DataFrame, text: str, words: DataFrame, n: int) -> DataFrame:
    """df with found, by a join of the places that the filter lets through with the words.

    Places are gathered by the SHA-256 of the text that they are in, so copies
    of a text share them and rows need no id.
    """
    table = df.sparkSession.sparkContext.broadcast(filters.build(words, "form", n))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, forms_, starts in filters.search(batch.column(1).to_pylist(), table.value):
                yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(forms_, pa.string()), pa.array(starts, pa.list_(pa.int32()))], names=["digest", "form", "starts"])

    digest = F.unhex(F.sha2(F.col(text), 256))
    at = df.select(digest.alias("digest"), F.col(text).alias("text")).where("text != ''").mapInArrow(places, "digest binary, form string, starts array<int>")
    hit = at.join(words.select("form", "original", "category"), "form").select("digest", F.explode("starts").alias("start"), "form", "category", "original")
    # by start, then the longest; equal places of copies are one
    size = F.char_length("form").cast("int")
    hits = hit.groupBy("digest").agg(F.sort_array(F.collect_set(F.struct("start", (-size).alias("less"), "category", "original"))).alias("hits"))

    @F.pandas_udf("array<int>")
    def first_free(starts: pd.Series, less: pd.Series) -> pd.Series:
        out = []
        for ss, ls in zip(starts, less, strict=True):
            kept, free = [], 0
            for k, (s, n_) in enumerate(zip(ss, ls, strict=True)):
                if s >= free:
                    kept.append(k)
                    free = s - n_
            out.append(kept)
        return pd.Series(out)

    chosen = hits.withColumn("kept", first_free(F.col("hits.start"), F.col("hits.less")))
    one = lambda h: F.struct(h["start"].alias("start"), (h["start"] - h["less"]).alias("stop"), h["category"].alias("category"), h["original"].alias("value"))
    found = chosen.select(F.col("digest").alias("__digest"), F.transform("kept", lambda k: one(F.get("hits", k))).alias("__found"))
    every = df.withColumn("__digest", digest).join(found, "__digest", "left")
    return every.withColumn("found", F.coalesce("__found", F.array().cast(f"array<{FOUND}>"))).drop("__digest", "__found")


def redact_known(df: DataFrame, text: str, dictionary: DataFrame, key: bytes = DEMO_KEY, escaped: bool = False) -> DataFrame:
    """df with found and sanitized: every dictionary value in the text is replaced as it was where it was discovered.

    With escaped, the forms in which formats write a value are replaced like
    the value. A null text gives the empty one. A dictionary of more than
    AUTOMATON_BYTES stays persisted, as the result reads it.
    """
    words = literals(dictionary).withColumn("form", F.col("original"))
    if escaped:
        every = words.withColumn("form", F.explode(F.concat(F.array("original"), forms(F.col("original")))))
        # a value's own row comes before one in which it is another's form
        words = every.groupBy("form").agg(F.min(F.struct((F.col("form") != F.col("original")).alias("other"), "original", "category")).alias("m")).select("form", "m.original", "m.category")
    words = words.persist()
    n, size, categories = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("form")), F.lit(0)), F.sort_array(F.collect_set("category"))).first()
    if size <= AUTOMATON_BYTES:
        out = _by_automaton(df, text, words)
        words.unpersist()
    else:
        out = _by_join(df, text, words, n)

    def new(m: Column) -> Column:
        by = None
        for c in categories:
            by = (F if by is None else by).when(m["category"] == c, replace(m["value"], c, key))
        return F.lit("") if by is None else by

    t = F.coalesce(F.col(text), F.lit(""))
    splice = F.aggregate(
        "found",
        F.struct(F.lit("").alias("t"), F.lit(0).alias("at")),
        lambda acc, m: F.struct(F.concat(acc["t"], F.substr(t, acc["at"] + 1, m["start"] - acc["at"]), new(m)).alias("t"), m["stop"].alias("at")),
        lambda acc: F.concat(acc["t"], F.substr(t, acc["at"] + 1)),
    )
    return out.withColumn("sanitized", F.when(F.size("found") > 0, splice).otherwise(t))


def new_literals(dictionary: DataFrame, known: DataFrame) -> DataFrame:
    """category and original of discovered values that the rules (column pattern) do not yet hold, for the write-back."""
    return literals(dictionary).join(known.select(F.col("pattern").alias("original")), "original", "left_anti").select("category", "original")
