"""Exact top-k by inner product with vector-approximation files.

Components become integers, floor(scale * x). Each dimension is cut into
2**bits cells of one width between its least and greatest value; a vector's
approximation is the byte string of its cells. For a query, the cells bound the
score from both sides. Blocks of queries meet chunks of approximations in a
grid of tasks; a task goes through both in tiles, holds each query's k best
lower bounds so far and keeps what can still be among its k best. The kth best
lower bound over all tasks then cuts the rest. Only for what is left are the
exact vectors read, in the order of their upper bounds, until the kth score is
certain. A task gives a query little more than k rows, so what is exchanged
grows with queries times chunks, and chunks grow to CHUNK vectors.

Of equal vectors only the k + 1 least ids can be in any result (one of them may
be the query), so the others are left out of the scan; this is exact and keeps
a vector that a third of all rows share from filling every candidate list.

Defined cases: null ids, and vectors that are null or hold null or non-finite
components, take no part. Only vectors of the query's length are candidates.
Vectors without components have score 0. Components beyond +-2**62 after scaling
count as that, and scores beyond 64 bits as the nearest long. Ties go to the
smaller id. Repeated rows of an id: candidates count once for each distinct
vector; queries give one result for each distinct vector, too. Empty tables
give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

K, SCALE, BITS = 5, 256, 6
#: Queries of a block and approximations of a chunk, which a task holds, and of the tiles that it takes at once.
BLOCK, CHUNK = 8192, 65_536
QUERIES, VECTORS = 1024, 4096
_TOP = float(1 << 62)
_FOUND = "qkey long, query_id long, vec_id long, key long, lower double, upper double"


def _ints(scale: float):
    """vec_id, dim and the integer components (long, little-endian) of usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws, dims = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    dims.append(len(x))
                    raws.append(np.clip(np.floor(x * scale), -_TOP, _TOP).astype("<i8").tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["vec_id", "dim", "vec"])

    return run


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    raw = b"".join(x.as_py() for x in col)
    return np.frombuffer(raw, "<i8").reshape(len(col), dim)


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and greatest of each component, by the vectors' length."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for d in np.unique(dims).tolist():
            x = _matrix(batch.column(1).filter(pa.array(dims == d)), d)
            both = np.stack((x.min(axis=0), x.max(axis=0)))
            held[d] = both if d not in held else np.stack((np.minimum(held[d][0], both[0]), np.maximum(held[d][1], both[1])))
    yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x[0].tobytes() for x in held.values()], pa.binary()), pa.array([x[1].tobytes() for x in held.values()], pa.binary())], names=["dim", "low", "high"])


def _cells(extent: dict[int, tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [((np.frombuffer(v.as_py(), "<i8").astype(np.float64) - extent[d][0]) // extent[d][1]).astype(np.uint8).tobytes() for d, v in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), pa.array(codes, pa.binary())], names=["vec_id", "dim", "key", "cells"])

    return run


def _scan(extent: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    def run(key: tuple, queries: pa.Table, chunk: pa.Table) -> pa.Table:
        return _scan_chunk(queries, chunk, extent, k)

    run.__annotations__ = {}
    return run


def _scan_chunk(queries: pa.Table, chunk: pa.Table, extent: dict, k: int) -> pa.Table:
    """What a chunk may add to the results of a block of queries, with bounds on the scores."""
    kinds = [pa.int64()] * 4 + [pa.float64()] * 2
    names = ["qkey", "query_id", "vec_id", "key", "lower", "upper"]
    out: list[list[np.ndarray]] = []
    if queries.num_rows and chunk.num_rows:
        d = queries.column("dim")[0].as_py()
        low, width = extent[d]
        cells = np.frombuffer(b"".join(x.as_py() for x in chunk.column("cells")), np.uint8).reshape(chunk.num_rows, d)
        ids, keys = chunk.column("vec_id").to_numpy(), chunk.column("key").to_numpy()
        qids, qkeys = queries.column("vec_id").to_numpy(), queries.column("key").to_numpy()
        vectors = _matrix(queries.column("vec").combine_chunks(), d).astype(np.float64)
        for a in range(0, len(qids), QUERIES):
            out.append(_scan_tiles(vectors[a : a + QUERIES], qids[a : a + QUERIES], qkeys[a : a + QUERIES], cells, ids, keys, low, width, k))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 6
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def _scan_tiles(q: np.ndarray, qids: np.ndarray, qkeys: np.ndarray, cells: np.ndarray, ids: np.ndarray, keys: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> list[np.ndarray]:
    """Some queries against all approximations of a chunk, tile by tile."""
    # the cells' half widths, and more than the sums' own rounding
    slack = np.abs(q) @ ((width - 1) / 2) + 2.0**-40 * (np.abs(q) @ (np.abs(low) + 256 * width)) + 1
    best = np.full((len(q), k), -np.inf)  # of each query, its k best middles so far
    kept: list[tuple[np.ndarray, ...]] = []
    for c in range(0, len(ids), VECTORS):
        middle = low + cells[c : c + VECTORS] * width + (width - 1) / 2
        score = q @ middle.T
        score[qids[:, None] == ids[None, c : c + VECTORS]] = -np.inf
        n = score.shape[1]
        top = np.partition(score, n - k, axis=1)[:, n - k :] if n > k else score
        both = np.concatenate((best, top), axis=1)
        best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        row, col = np.nonzero((score >= (best[:, 0] - 2 * slack)[:, None]) & np.isfinite(score))
        kept.append((row, c + col, score[row, col]))
    row, col, score = (np.concatenate(x) for x in zip(*kept, strict=True))
    on = score >= best[row, 0] - 2 * slack[row]  # by the last bound, no longer by that of its tile
    row, col, score = row[on], col[on], score[on]
    return [qkeys[row], qids[row], ids[col], keys[col], score - slack[row], score + slack[row]]


def _certain(k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _read_in_order(table, k)

    run.__annotations__ = {}
    return run


def _exact(q: np.ndarray, x: np.ndarray) -> list[int]:
    bound = len(q) * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0))
    if bound < 2.0**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64).tolist()
    top = (1 << 63) - 1
    return [max(-top - 1, min(top, sum(a * b for a, b in zip(q.tolist(), r.tolist(), strict=True)))) for r in x]


def _read_in_order(table: pa.Table, k: int, step: int = 64) -> pa.Table:
    """The k best of one query's candidates: exact vectors by falling upper bound, until no other can be among them."""
    table = table.combine_chunks().sort_by([("upper", "descending"), ("vec_id", "ascending")])
    q = np.frombuffer(table.column("qvec")[0].as_py(), "<i8")
    upper, ids, vecs = table.column("upper").to_numpy(), table.column("vec_id").to_numpy(), table.column("vec").combine_chunks()
    best: list[tuple[int, int]] = []
    for i in range(0, len(ids), step):
        if len(best) == k and upper[i] < -best[-1][0]:
            break
        for s, v in zip(_exact(q, _matrix(vecs[i : i + step], len(q))), ids[i : i + step].tolist(), strict=True):
            best.append((-s, v))
        best = sorted(best)[:k]
    n = len(best)
    return pa.table({"query_id": pa.array([table.column("query_id")[0].as_py()] * n, pa.int64()), "rank": pa.array(range(1, n + 1), pa.int32()), "vec_id": pa.array([v for _, v in best], pa.int64()), "score": pa.array([-s for s, _ in best], pa.int64())})


def exact_topk(vectors: DataFrame, queries: DataFrame, *, k: int = K, scale: float = SCALE, bits: int = BITS, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: for every query (vec_id, embedding) its k best of all vectors but its own id."""
    spark = prepare(vectors.sparkSession)
    kind = "vec_id long, dim int, vec binary"
    whole = vectors.select("vec_id", "embedding").mapInArrow(_ints(scale), kind)
    # of equal vectors, the k + 1 least ids: first within salted parts, then over them
    same = ["dim", "vec"]
    salted = whole.dropDuplicates(["vec_id", "vec"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    part = salted.withColumn("r", F.row_number().over(Window.partitionBy(*same, "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    kept = part.withColumn("r", F.row_number().over(Window.partitionBy(*same).orderBy("vec_id"))).where(F.col("r") <= k + 1).select("vec_id", *same)
    kept = kept.withColumn("key", F.xxhash64("vec_id", "vec")).checkpoint()
    asked = queries.select("vec_id", "embedding").mapInArrow(_ints(scale), kind).dropDuplicates(["vec_id", "vec"]).withColumn("key", F.xxhash64("vec_id", "vec")).checkpoint()

    extent = {}
    for r in kept.select("dim", "vec").mapInArrow(_extent, "dim int, low binary, high binary").collect():  # a row for each task and length
        low, high = np.frombuffer(r["low"], "<i8"), np.frombuffer(r["high"], "<i8")
        if r["dim"] in extent:
            low, high = np.minimum(low, extent[r["dim"]][0]), np.maximum(high, extent[r["dim"]][1])
        extent[r["dim"]] = low, high
    extent = {d: (lo.astype(np.float64), np.ceil((hi.astype(np.float64) - lo + 1) / 2**bits)) for d, (lo, hi) in extent.items()}

    rows, spread = kept.count(), spark.sparkContext.defaultParallelism
    # chunks of full size where there are enough of them to go round
    n_chunks, n_blocks = max(1, -(-rows // chunk), min(-(-rows // VECTORS), spread)), max(1, -(-asked.count() // block))
    cells = kept.select("vec_id", "dim", "vec", "key").mapInArrow(_cells(extent), "vec_id long, dim int, key long, cells binary")
    cells = cells.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(n_chunks))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    grid = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long"))))
    by = ["chunk", "block", "dim"]
    found = grid.groupBy(*by).cogroup(cells.groupBy(*by)).applyInArrow(_scan(extent, k), _FOUND)
    nth = F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("lower")))
    floor = F.max(F.when(F.col("n") == k, F.col("lower"))).over(Window.partitionBy("qkey"))
    left = found.withColumn("n", nth).withColumn("floor", floor).where("floor is null or upper >= floor").select("qkey", "query_id", "vec_id", "key", "upper")
    read = left.join(kept.select("key", "vec"), "key").join(asked.select(F.col("key").alias("qkey"), F.col("vec").alias("qvec")), "qkey")
    return read.select("qkey", "query_id", "vec_id", "upper", "vec", "qvec").groupBy("qkey").applyInArrow(_certain(k), "query_id long, rank int, vec_id long, score long")
