"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Every word (a run of letters, digits and non-ASCII bytes, or a run of symbols)
falls into one of ``WORDS`` hash buckets, and every bucket has a fixed sparse
random index vector. A bucket's context vector is the sum of the index vectors
of the words around it in all documents: integers, counted in one pass over the
whole corpus and added up over the tasks, so the table has one fixed size
whatever the corpus. A document is the mean of its words' context vectors, with
pooled word shapes and repetition beside it. A two-layer numpy network is
fitted on the driver to at most ``SAMPLE`` labelled documents, the ones with
the least hash of doc_id; its temperature is set on a fifth of them that the
fit has not seen.

Labels are learnt only from rows whose crc32(doc_id as text) mod 5 is not 0.
labels, lang, source and doc_id are no inputs of a score.

Defined cases: a null text is empty; an empty text has a score like any other.
Labels with a null quality or doc_id are ignored, of repeated ones the least
counts. Without labels of both kinds, every score is the share of label 1, or
0.5 without labels. A null doc_id is not held out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, PrefixHash, prepare, text_slices, tidy

BITS, DIM, WINDOW, NONZERO = 14, 32, 2, 4
WORDS = 1 << BITS
SAMPLE = 20_000
HIDDEN, EPOCHS, RATE, DECAY, SEED = 32, 40, 3e-3, 1e-4, 17
THRESHOLD = 0.3
SHAPES = 96
FEATURES = DIM + SHAPES + 5
PARTS = 16

_CLASS = np.full(256, 2, np.int8)  # 0: space, 1: letters and digits, 2: symbols
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x30:0x3A] = _CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_UPPER = np.zeros(256, np.int32)
_UPPER[0x41:0x5B] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[0x30:0x3A] = 1


def index_vectors() -> np.ndarray:
    """The fixed sparse ternary index vector of every bucket."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((WORDS, DIM), np.int16)
    at = rng.integers(0, DIM, (WORDS, NONZERO))
    np.add.at(out, (np.arange(WORDS)[:, None], at), rng.choice([-1, 1], (WORDS, NONZERO)).astype(np.int16))
    return out


class Pieces:
    """The words of a slice: bucket, shape, and the first word of each document."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        kind = _CLASS[data]
        cut = np.ones(len(data) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
        cut[off] = True
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        if len(start):
            word = kind[start] > 0
            start, end = start[word], end[word]
        self.start, self.end = start, end
        self.hash = PrefixHash(data).spans(start, end)
        self.bucket = (self.hash >> U64(64 - BITS)).astype(np.int64)
        self.doc = np.searchsorted(start, off)
        upper, digit = (np.concatenate(([0], np.cumsum(t[data]))) for t in (_UPPER, _DIGIT))
        size = end - start
        caps = upper[end] - upper[start]
        case = np.where(caps == 0, 0, np.where((caps == 1) & (upper[start + (size > 0)] - upper[start] == 1) & (size > 1), 1, 2))
        sort = np.where(kind[start] == 2, 3, np.where(digit[end] > digit[start], 3, case)) if len(start) else case
        group = np.where(len(start) and kind[start] == 2, 4, sort) if len(start) else case
        self.shape = group * 16 + np.minimum(size, 15)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the context vectors over a task's documents."""
    index, total = index_vectors(), np.zeros((WORDS, DIM), np.int64)
    for batch in batches:
        for _, _, data, off in text_slices(batch.column(0)):
            p = Pieces(data, off)
            n = len(p.bucket)
            if n < 2:
                continue
            own, doc = index[p.bucket], np.repeat(np.arange(len(off) - 1), np.diff(p.doc))
            around = np.zeros((n, DIM), np.int16)
            for d in range(1, WINDOW + 1):
                if n > d:
                    same = (doc[d:] == doc[:-d]).astype(np.int16)[:, None]
                    around[d:] += own[:-d] * same
                    around[:-d] += own[d:] * same
            order = np.argsort(p.bucket.astype(np.uint16), kind="stable")
            b = p.bucket[order]
            first = np.flatnonzero(np.diff(b, prepend=-1))
            total[b[first]] += np.add.reduceat(around[order], first, axis=0, dtype=np.int64)
    if total.any():
        yield pa.record_batch([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in total.reshape(PARTS, -1)], pa.binary())], names=["part", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, part = np.zeros(WORDS * DIM // PARTS, np.int64), None
    for batch in batches:
        part = batch.column(0).slice(0, 1)
        for x in batch.column(1):
            total += np.frombuffer(x.as_buffer(), np.int64)
    yield pa.record_batch([part, pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The unit context vector of every bucket, over all documents: 2 MB."""
    total = np.zeros((PARTS, WORDS * DIM // PARTS), np.int64)
    for r in docs.select(text_col).mapInArrow(tidy(_contexts), "part int, sums binary").groupBy("part").applyInArrow(_add, "part int, sums binary").collect():
        total[r["part"]] = np.frombuffer(r["sums"], np.int64)
    v = total.reshape(WORDS, DIM).astype(np.float64)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1)).astype(np.float32)


def pooled(data: np.ndarray, off: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The features of every document of a slice."""
    p, n = Pieces(data, off), len(off) - 1
    count = np.diff(p.doc)
    out = np.zeros((n, FEATURES), np.float32)
    full = np.flatnonzero(count)
    if len(full):
        out[full, :DIM] = np.add.reduceat(vectors[p.bucket], p.doc[full], axis=0) / count[full, None]
    doc = np.repeat(np.arange(n), count)
    shape = np.bincount(doc * SHAPES + p.shape, minlength=n * SHAPES).reshape(n, SHAPES)
    out[:, DIM : DIM + SHAPES] = np.sqrt(shape / np.maximum(count, 1)[:, None])
    key = np.sort((doc.astype(U64) << U64(44)) | (p.hash >> U64(20)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[new] >> U64(44)).astype(np.int64), minlength=n)
    two = np.sort((doc[1:].astype(U64) << U64(44)) | ((p.hash[1:] * U64(3) + p.hash[:-1]) >> U64(20))) if len(doc) > 1 else key
    new = np.ones(len(two), bool)
    new[1:] = two[1:] != two[:-1]
    pairs = np.bincount((two[new] >> U64(44)).astype(np.int64), minlength=n)
    rest = DIM + SHAPES
    out[:, rest] = np.log1p(count)
    out[:, rest + 1] = distinct / np.maximum(count, 1)
    out[:, rest + 2] = pairs / np.maximum(count, 1)
    out[:, rest + 3] = np.linalg.norm(out[:, :DIM], axis=1)
    out[:, rest + 4] = np.log1p(np.diff(off)) - np.log1p(count)
    return out


class Network:
    """Standardised inputs, one hidden layer, one logit, a temperature."""

    def __init__(self, prior: float = 0.5):
        self.prior, self.layers = prior, None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        self.prior = float(y.mean()) if len(y) else 0.5
        if len(np.unique(y)) < 2:
            return self
        rng = np.random.default_rng(SEED)
        held = np.arange(len(x)) % 5 == 0
        if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
            held[:] = False
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float64)
        tx, ty = z[~held], y[~held].astype(np.float64)
        weight = np.where(ty == 1, 0.5 / ty.mean(), 0.5 / (1 - ty.mean()))
        # the classes weigh alike in the fit; the logit is shifted back to their shares afterwards
        shift = np.log(ty.mean() / (1 - ty.mean()))
        w = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(tx))
            for i in range(0, len(order), 128):
                k = order[i : i + 128]
                h = np.maximum(tx[k] @ w[0] + w[1], 0)
                d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - ty[k]) * weight[k] / len(k)
                back = np.outer(d, w[2]) * (h > 0)
                grads = [tx[k].T @ back + DECAY * w[0], back.sum(axis=0), h.T @ d + DECAY * w[2], np.array([d.sum()])]
                step += 1
                for a, g, b, c in zip(w, grads, m, v, strict=True):
                    b += 0.1 * (g - b)
                    c += 0.001 * (g * g - c)
                    a -= RATE * (b / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
        self.layers, self.shift, self.temperature = [a.astype(np.float32) for a in w], shift, 1.0
        if held.any():
            logit, t = self.logits(x[held]), y[held]
            loss = lambda s: np.logaddexp(0, np.where(t == 1, -1, 1) * logit / s).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 141), key=loss))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float32)
        return (np.maximum(z @ self.layers[0] + self.layers[1], 0) @ self.layers[2] + self.layers[3]).astype(np.float64) + self.shift

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(vectors, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pooled(data, off, vectors.value) for _, _, data, off in text_slices(batch.column("text"))]
            flat = pa.array(np.concatenate(x).ravel() if x else np.zeros(0, np.float32))
            cols = [pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * FEATURES, flat) if f.name == "features" else batch.column(f.name) for f in arrow]
            yield pa.record_batch(cols, names=arrow.names)

    return run


def _scores(vectors, network: Network, arrow: pa.Schema, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [network.score(pooled(data, off, vectors.value)) for _, _, data, off in text_slices(batch.column(text_col))]
            score = pa.array(np.concatenate(s) if s else np.zeros(0))
            yield pa.record_batch([score if f.name == "score" else batch.column(f.name) for f in arrow], names=arrow.names)

    return run


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE):
    """The broadcast word vectors of docs (2 MB) and a network fitted to at most sample labelled documents."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = prepare(docs.sparkSession)
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    usable = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    kind = T.StructType.fromDDL("doc_id long, quality int, features array<float>")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    got = found.mapInArrow(tidy(_features(vectors, to_arrow_schema(kind))), kind).toArrow().combine_chunks().sort_by([("doc_id", "ascending")])
    y = got.column("quality").to_numpy()
    x = got.column("features").combine_chunks().flatten().to_numpy().reshape(len(y), FEATURES) if len(y) else np.zeros((0, FEATURES), np.float32)
    return vectors, Network().fit(x, y)


def score(docs: DataFrame, vectors, network: Network, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """keep, held_out, score and predicted for every document."""
    from pyspark.sql.pandas.types import to_arrow_schema

    src = docs.select(*dict.fromkeys([*keep, text_col]))
    out = T.StructType([*(f for f in src.schema if f.name in keep), T.StructField("score", T.DoubleType())])
    scored = src.mapInArrow(tidy(_scores(vectors, network, to_arrow_schema(out), text_col)), out)
    return scored.select(*keep, held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return score(docs, *fit(docs, labels), keep=keep)
