"""Packing into optimal length buckets and token-budget batches.

The lengths of all documents form one exact histogram, a row for each distinct
length. Dynamic programming over it chooses the bucket bounds, which are
lengths that occur, that leave the least padding over the corpus; as the cost
of a bucket is a line in its bound, each round keeps the lower hull of the
lines and takes time in proportion to the distinct lengths. Lengths are those
of ``length``, such as the ids that ``with_ids`` counts; without it they are
white-space words. In a bucket every batch holds as many documents as fit the
token budget at the bucket's bound, one at least.

Batches are numbered without gathering a bucket in one task: rows are dealt to
blocks evenly, whatever their ids, ranked in their (bucket, block), and the
block counts give each block its first place in the bucket.

Defined cases: a null or empty text, or a null length, has length 0 and goes to
the first bucket, which pads it to that bound. Rows of a block are ordered by
doc_id, then length; repeated rows and null ids each take a place of their own.
A document longer than the budget has a batch of its own. An empty table gives
an empty result. Columns named in ``keep`` are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, text_slices, tidy
from .token_files import encoder

BUCKETS, BUDGET = 12, 16_384
BLOCK_ROWS = 50_000


def n_words(text: str = "text") -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_ids(docs: DataFrame, path: str, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keep and n_ids, the ids of the whole text by a tokenizer file; a null text has none."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for i, j, data, off in text_slices(batch.column(len(keep))):
                n[i:j] = np.diff(enc.encode(data, off)[1])
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(n)], names=[*keep, "n_ids"])

    src = docs.select(*keep, F.col(text_col).alias("__text"))
    return src.mapInArrow(tidy(run), T.StructType([*src.schema.fields[:-1], T.StructField("n_ids", T.LongType())]))


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """At most k bounds out of sorted distinct lengths, the last one included, with the least total of length times count."""
    n = len(lengths)
    if n == 0:
        return []
    size = [int(x) for x in lengths]
    total = [0]
    for c in counts:
        total.append(total[-1] + int(c))
    best = [total[j + 1] * size[j] for j in range(n)]  # of the first j + 1 lengths, in one bucket
    back: list[list[int]] = []
    for _ in range(min(k, n) - 1):
        new, of = list(best), [-1] * n
        hull: list[tuple[int, int, int]] = []  # lines (slope, height, index), of falling slopes
        at = 0
        for j in range(1, n):
            # with the lengths up to j - 1 in the buckets before: best[j - 1] + size[j] * (total[j + 1] - total[j])
            m, h = -total[j], best[j - 1]
            while len(hull) >= 2 and (h - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                hull.pop()
            hull.append((m, h, j - 1))
            at = min(at, len(hull) - 1)
            value = lambda q, x=size[j]: q[0] * x + q[1]
            while at + 1 < len(hull) and value(hull[at + 1]) <= value(hull[at]):
                at += 1
            cost = value(hull[at]) + size[j] * total[j + 1]
            if cost < new[j]:
                new[j], of[j] = cost, hull[at][2]
        back.append(of)
        best = new
    out, j = [], n - 1
    for of in reversed(back):
        if of[j] >= 0:
            out.append(size[j])
            j = of[j]
    return sorted({*out, size[j]})


def bucket_bounds(lengths: DataFrame, k: int) -> list[int]:
    """The bounds for a table with column n_tokens; its histogram, a row for each distinct length, comes to the driver."""
    rows = lengths.groupBy("n_tokens").agg(F.count("*").alias("count")).toArrow().sort_by("n_tokens")
    return optimal_bounds(rows.column("n_tokens").to_numpy(), rows.column("count").to_numpy(), k)


def pack(docs: DataFrame, *, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, bucket (from 0), bucket_len, batch (from 0 in each bucket), slot (from 0) and batch_id for every document."""
    prepare(docs.sparkSession)
    sized = docs.select(*keep, F.coalesce(length if length is not None else n_words(), F.lit(0)).cast("long").alias("n_tokens"))
    # the checkpoint fixes the rows' numbers, by which hot and null ids are dealt evenly, too
    sized = sized.withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    bounds = bucket_bounds(sized, buckets) or [0]
    each = F.array(*(F.lit(b) for b in bounds))
    bucket = sum((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]) if len(bounds) > 1 else F.lit(0)
    n = max(1, -(-sized.count() // BLOCK_ROWS))
    placed = sized.withColumn("bucket", bucket).withColumn("block", F.pmod(F.xxhash64("__row"), F.lit(n)))
    counts = placed.groupBy("bucket", "block").count()  # at most buckets * n rows
    first = counts.select("bucket", "block", (F.sum("count").over(Window.partitionBy("bucket").orderBy("block")) - F.col("count")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("bucket", "block").orderBy("doc_id", "n_tokens", "__row"))
    out = placed.withColumn("rank", rank).join(F.broadcast(first) if n * len(bounds) <= 1_000_000 else first, ["bucket", "block"])
    place = F.col("first") + F.col("rank") - 1
    bound = F.element_at(each, F.col("bucket") + 1)
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), bound)))
    return out.select(*keep, "n_tokens", "bucket", bound.cast("long").alias("bucket_len"), F.floor(place / fits).alias("batch"), F.pmod(place, fits).alias("slot")).withColumn("batch_id", F.concat_ws("-", "bucket", "batch"))
