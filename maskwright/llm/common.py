"""Helpers shared by the training-data operators: scratch space, Arrow text access, hashing.

Text is handled as the raw UTF-8 bytes of Arrow columns in numpy, in slices of
whole documents of about ``SLICE`` bytes, so that a Python worker's memory
depends on the longest document and not on the size of a batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker handles at once.
SLICE = 1 << 20
#: Rows and bytes of an Arrow batch sent to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Rows of a side that may be broadcast, where each row is one or two longs.
BROADCAST_ROWS = 1_000_000

U64 = np.uint64
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: An odd multiplier and its inverse modulo 2**64, for prefix hashes.
_K = U64(0x9E3779B97F4A7C15)
_KINV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, and name a checkpoint folder where the session has none."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception as e:  # noqa: BLE001  a Spark without the setting keeps the bound on rows
        if "CONF" not in str(e):
            raise
    # the driver keeps the plan of every query as text, and again at each step of an adaptive plan
    spark.conf.set("spark.sql.ui.explainMode", "simple")
    spark.conf.set("spark.sql.maxPlanStringLength", "20000")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one of our own only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or sc.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Asks for garbage collections, upon which Spark deletes the shuffles and checkpoints that nothing refers to any more.

    Without them they stay on disk until the driver's heap happens to fill up;
    Spark has no call that deletes a query's shuffles by name. What a query has
    just left is let go by the second one.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.java.lang.System.gc()
        time.sleep(0.2)


def file_system(uri: str):
    """The file system of a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, uri: str) -> None:
    """Deletes a scratch folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; else it is shuffled."""
    return F.broadcast(df) if rows <= bound else df


# --- Arrow text -----------------------------------------------------------------


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    n = len(col)
    if n == 0 or col.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about size bytes, of whole rows, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, j
        i = j


def _trim() -> None:
    """Gives memory that was freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """A function for mapInArrow that leaves its worker, which goes on to other tasks, without the memory it has freed."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return tidied


def text_slices(col: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = text_buffers(col)
    for i, j in slices(off, size):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


# --- hashing --------------------------------------------------------------------

_powers = np.ones(1, U64), np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """K**i and K**-i for i < n, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers = tuple(np.concatenate(([U64(1)], np.cumprod(np.full(size - 1, k, U64)))) for k in (_K, _KINV))
    return _powers[0][:n], _powers[1][:n]


#: A fixed random 64-bit value for each byte.
BYTE_HASH = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= _MIX1
    x ^= x >> U64(27)
    x *= _MIX2
    x ^= x >> U64(31)
    return x


class PrefixHash:
    """Hashes of any spans of a byte string in constant time each, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_HASH[data] * up[: len(data)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))

    def windows(self, q: int) -> np.ndarray:
        """Of all spans of q bytes, by start."""
        n = len(self.sums) - q
        return mix((self.sums[q:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)


# --- words ----------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Words:
    """The words of a slice of documents: byte spans, and the first word of each document."""

    def __init__(self, data: np.ndarray, off: np.ndarray, keep: np.ndarray, lower: np.ndarray = LOWER):
        self.data = lower[data]
        self.isw = keep[self.data]
        first = self.isw.copy()
        first[1:] &= ~self.isw[:-1]
        inner = off[(off > 0) & (off < len(data))]
        first[inner] = self.isw[inner]
        last = self.isw.copy()
        last[:-1] &= ~self.isw[1:]
        last[inner - 1] = self.isw[inner - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return PrefixHash(self.data).spans(self.start, self.end)

    def array(self) -> pa.BinaryArray:
        off = np.zeros(len(self) + 1, np.int32)
        np.cumsum(self.end - self.start, out=off[1:])
        return pa.BinaryArray.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(off), pa.py_buffer(self.data[self.isw])])


#: Fixed random odd multipliers of the places in a shingle.
_STEP = list(np.random.default_rng(7919).integers(1, 1 << 63, 64, dtype=U64) * U64(2) + U64(1))


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """For each document, the sorted distinct hashes of its n-word shingles.

    With fewer words, the whole sequence is the one shingle; without words, the
    set is empty.
    """
    w = Words(data, off, SPACED)
    h = w.hashes()
    if len(h) >= n:
        s = np.zeros(len(h) - n + 1, U64)
        for k in range(n):
            s += h[k : len(h) - n + 1 + k] * _STEP[k]
        s = mix(s + U64(n))
    out = []
    for a, b in zip(w.doc[:-1].tolist(), w.doc[1:].tolist(), strict=True):
        if b - a >= n:
            x = np.sort(s[a : b - n + 1])
            keep = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            out.append(mix(np.array([sum((int(h[a + k]) * int(_STEP[k]) for k in range(b - a)), b - a) % (1 << 64)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


# --- connected components -------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as edges(a, b): the least node of each component.

    Alternates large-star and small-star steps, which take a number of rounds
    that grows with the logarithm of the longest path. Each round is cut by a
    reliable checkpoint, so lost executors do not replay the rounds before it.
    An isolated node does not appear.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(e)
    for _ in range(max_rounds):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = small.where("a <> b").distinct().checkpoint()
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def local_session(cpus: int | None = None) -> SparkSession:
    n = cpus or os.cpu_count()
    return SparkSession.builder.master(f"local[{n}]").config("spark.sql.shuffle.partitions", str(n)).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
