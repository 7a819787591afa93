"""Benchmark decontamination with an FM-index per training shard.

Each Python worker packs documents into shards of about ``SHARD`` words and
builds an FM-index over the shard's word sequence: a suffix array by prefix
doubling, its Burrows-Wheeler transform in a wavelet matrix, and every
``SAMPLE``-th text position kept. All benchmark windows are found by backward
search at once; occurrences are located by walking to sampled positions; the
covered words of a document merge into removal spans. Documents are read once
and never shuffled. The benchmark is cut into blocks of about ``BLOCK_BYTES``
of text. A single block goes along with the task; more of them are written to
the shared folder one after the other, and a worker reads them one at a time
for each shard, whose index it builds once.

Defined cases: a null text or one without words has no words, hits or items. A
benchmark item without words (or with a null item_id) has no window. An item
with fewer words than a window is one window as a whole. Equal windows of
several items count for each of them; repeated rows of an item count once.
Every document row, repeated ones too, gives one row. An empty benchmark gives
rows without hits. Extra columns of documents are dropped or, with ``keep``, passed on.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, file_system, prepare, scratch_path, text_buffers, text_slices, tidy

WINDOW = 8
#: Words of a shard; a longer document is a shard of its own.
SHARD = 1 << 19
#: Distance of the sampled text positions.
SAMPLE = 16
#: Benchmark text sent to the workers at once.
BLOCK_BYTES = 8 << 20

RESULT = "n_words long, n_hit long, items array<string>, runs array<struct<first:int,last:int>>, spans array<struct<start:int,end:int>>"


def _sort_pairs(high: np.ndarray, low: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """at in the order of (high, low), and where a new pair begins; all values are at most n."""
    if n < (1 << 20) - 1:
        key = (high.astype(np.uint64) << np.uint64(40)) | (low.astype(np.uint64) << np.uint64(20)) | at.astype(np.uint64)
        key.sort()
        out, pair = (key & np.uint64((1 << 20) - 1)).astype(np.int64), key >> np.uint64(20)
    else:
        key = high.astype(np.uint64) * np.uint64(n + 2) + low.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        out, pair = at[order], key[order]
    new = np.ones(len(out), bool)
    np.not_equal(pair[1:], pair[:-1], out=new[1:])
    return out, new


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of symbols >= 0 that are at most len(s), by prefix doubling over the groups still tied."""
    n = len(s)
    follow = np.zeros(n, np.int64)
    follow[:-1] = s[1:] + 1
    sa, new = _sort_pairs(s, follow, np.arange(n), max(n, int(s.max()) + 1))
    rank, h = np.empty(n, np.int64), 2
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        sub = sa[at]
        nxt = sub + h
        low = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        sa[at], fresh = _sort_pairs(rank[sub], low, sub, n)
        new[at] = fresh
        rank[sa[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
        h *= 2


class WaveletMatrix:
    """Access and rank over a sequence of symbols, one bit vector for each bit."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n, self.levels = len(seq), []
        cur = seq.astype(np.uint32)
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            one = ((cur >> np.uint32(bit)) & np.uint32(1)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            zeros = self.n - int(one.sum())
            self.levels.append((bit, words, before, zeros))
            cur = np.concatenate((cur[~one], cur[one]))

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[w] + np.bitwise_count(words[w] & low)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands before position i."""
        start = np.zeros(len(i), np.int64)
        for bit, words, before, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            a, b = self._ones(words, before, start), self._ones(words, before, i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it stands before i."""
        symbol, start = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for bit, words, before, zeros in self.levels:
            one = ((words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            a, b = self._ones(words, before, start), self._ones(words, before, i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
            symbol |= one.astype(np.int64) << bit
        return symbol, i - start


class FMIndex:
    """Count and locate phrases in a sequence of symbols >= 1."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        text = np.append(seq.astype(np.int64), 0)
        sigma = int(text.max()) + 1
        sa = suffix_array(text)
        self.n, self.sample = len(text), sample
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.first[1:])
        self.tree = WaveletMatrix(text[sa - 1], sigma)
        kept = sa % sample == 0
        self.row_of_sample = np.flatnonzero(kept)
        self.samples = sa[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, given as rows of symbols right-aligned with -1 to the left."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for c in phrases.T[::-1]:
            on = np.flatnonzero((c >= 0) & (hi > lo))
            if len(on):
                s = c[on]
                lo[on], hi[on] = self.first[s] + self.tree.rank(s, lo[on]), self.first[s] + self.tree.rank(s, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            k = np.minimum(np.searchsorted(self.row_of_sample, at), len(self.row_of_sample) - 1)
            found = self.row_of_sample[k] == at
            out[todo[found]] = self.samples[k[found]] + steps
            todo, at = todo[~found], at[~found]
            if len(todo):
                symbol, before = self.tree.access_rank(at)
                at, steps = self.first[symbol] + before, steps + 1
        return out


class Phrases:
    """The distinct windows of benchmark items over their own vocabulary, and the items of each window."""

    def __init__(self, item_ids: list, texts: list, window: int):
        data, off = text_buffers(pa.array(texts, pa.string()))
        w = Words(data, off, ALNUM)
        coded = w.array().dictionary_encode()
        self.vocabulary, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        rows, owner = [], []
        for item, a, b in zip(item_ids, w.doc[:-1].tolist(), w.doc[1:].tolist(), strict=True):
            if item is None or a == b:
                continue
            if b - a < window:
                rows.append(np.concatenate((np.full(window - b + a, -1), code[a:b]))[None])
            else:
                rows.append(np.lib.stride_tricks.sliding_window_view(code[a:b], window))
            owner += [str(item)] * len(rows[-1])
        if rows:
            self.windows, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        else:
            self.windows, of = np.zeros((0, window), np.int64), np.zeros(0, np.int64)
        self.lengths = (self.windows >= 0).sum(axis=1)
        self.names, name = np.unique(np.array(owner, dtype=str), return_inverse=True)
        pairs = np.unique(np.stack((of.ravel(), name.ravel())), axis=1) if len(owner) else np.zeros((2, 0), np.int64)
        self.items = pairs[1]
        self.item_at = np.searchsorted(pairs[0], np.arange(len(self.windows) + 1))


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Shard:
    """The FM-index over the words of some documents."""

    def __init__(self, parts: list[Words]):
        words = pa.chunked_array([w.array() for w in parts]).combine_chunks() if parts else pa.array([], pa.binary())
        if isinstance(words, pa.ChunkedArray):
            words = words.chunk(0)
        coded = words.dictionary_encode()
        self.dictionary = coded.dictionary
        self.counts = np.concatenate([np.diff(w.doc) for w in parts])
        self.n = int(self.counts.sum())
        self.first = np.zeros(len(self.counts) + 1, np.int64)
        np.cumsum(self.counts, out=self.first[1:])
        self.hits, self.items = np.zeros(self.n + 1, np.int64), [set() for _ in self.counts]
        self.index, self._codes = None, coded.indices

    def _built(self) -> FMIndex:
        if self.index is None:
            doc = np.repeat(np.arange(len(self.counts)), self.counts)
            seq = np.ones(self.n + len(self.counts), np.int64)  # 1 stands between documents
            seq[np.arange(self.n) + doc] = self._codes.to_numpy(zero_copy_only=False).astype(np.int64) + 2
            self.index = FMIndex(seq)
        return self.index

    def search(self, p: Phrases) -> None:
        """Adds the hit words and items of one block of the benchmark."""
        known = pc.index_in(p.vocabulary, value_set=self.dictionary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        phrase = np.where(p.windows >= 0, known[p.windows] + 2, -1)
        usable = np.flatnonzero(((phrase != 1) | (p.windows < 0)).all(axis=1))
        if not self.n or not len(usable):
            return
        index = self._built()
        lo, hi = index.search(phrase[usable])
        size = np.maximum(hi - lo, 0)
        if not size.any():
            return
        window = np.repeat(usable, size)
        rows = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        at = index.locate(rows)
        in_doc = np.searchsorted(self.first[1:] + np.arange(1, len(self.counts) + 1), at, side="right")
        word = at - in_doc
        np.add.at(self.hits, word, 1)
        np.add.at(self.hits, word + p.lengths[window], -1)
        seen = np.unique(np.stack((in_doc, window), axis=1), axis=0)
        width = p.item_at[seen[:, 1] + 1] - p.item_at[seen[:, 1]]
        item = p.items[np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(p.item_at[seen[:, 1]], width)]
        for k, name in np.unique(np.stack((np.repeat(seen[:, 0], width), item), axis=1), axis=0).tolist():
            self.items[k].add(str(p.names[name]))

    def found(self) -> list[dict]:
        """For each document its words, its items and its hit word runs."""
        hit, out = np.cumsum(self.hits[:-1]) > 0, []
        for k, items in enumerate(self.items):
            a, b = self.first[k], self.first[k + 1]
            runs = list(zip(*(x.tolist() for x in _runs(hit[a:b])), strict=True)) if items else []
            out.append({"n_words": int(b - a), "items": sorted(items), "runs": runs})
        return out


def _scan(blocks_of, schema: pa.Schema, text_col: str):
    """blocks_of() gives the benchmark's blocks, one after the other."""

    def flush(held: list[pa.RecordBatch], parts: list[Words]) -> pa.RecordBatch:
        shard = Shard(parts)
        for p in blocks_of():
            shard.search(p)
        found = shard.found()
        rows = pa.Table.from_batches(held).combine_chunks()
        spans, k = [], 0
        for w in parts:
            char = None
            for d in range(len(w.doc) - 1):
                x = found[k]
                if x["runs"]:
                    if char is None:
                        char = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))
                    at = w.off[d]
                    spans.append([{"start": int(char[w.start[w.doc[d] + a]] - char[at]), "end": int(char[w.end[w.doc[d] + b - 1]] - char[at])} for a, b in x["runs"]])
                else:
                    spans.append([])
                k += 1
        own = {
            "n_words": pa.array([x["n_words"] for x in found], pa.int64()),
            "n_hit": pa.array([sum(b - a for a, b in x["runs"]) for x in found], pa.int64()),
            "items": pa.array([x["items"] for x in found], schema.field("items").type),
            "runs": pa.array([[{"first": a, "last": b} for a, b in x["runs"]] for x in found], schema.field("runs").type),
            "spans": pa.array(spans, schema.field("spans").type),
        }
        return pa.table([own[f.name] if f.name in own else rows.column(f.name) for f in schema], names=schema.names).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, total = [], [], 0
        for batch in batches:
            for i, j, data, off in text_slices(batch.column(text_col)):
                w = Words(data, off, ALNUM)
                w.off = off
                if parts and total + len(w) > SHARD:
                    yield flush(held, parts)
                    held, parts, total = [], [], 0
                held.append(batch.slice(i, j - i))
                parts.append(w)
                total += len(w)
        if parts:
            yield flush(held, parts)

    return run


def _arrow(kind) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Phrases]:
    """The benchmark in parts of about block_bytes of text, one at a time."""
    size = benchmark.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text").toArrow()
        yield Phrases(part.column(0).to_pylist(), part.column(1).to_pylist(), window)


def _shipped(spark: SparkSession, parts: Iterator[Phrases]):
    """A function that gives the blocks in a worker: the only one itself, several from files in the shared folder."""
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return lambda: iter((first,))
    uris, root = [], scratch_path(spark, "benchmark")
    for k, p in enumerate(itertools.chain((first, second), parts)):
        fs, path = file_system(root)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{k}") as out:
            out.write(pickle.dumps(p))
        uris.append(f"{root}/{k}")

    def read() -> Iterator[Phrases]:
        for uri in uris:
            fs, path = file_system(uri)
            with fs.open_input_stream(path) as f:
                yield pickle.loads(f.read())

    return read


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, min_items: int = 2, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: keep, n_words, n_hit, n_items, items, runs, spans, contaminated.

    items are the item_ids whose windows occur, sorted as strings; runs are the
    merged hit word ranges and spans the same as characters of the text, end
    exclusive. A document with min_items items or more is contaminated.
    """
    prepare(docs.sparkSession)
    src = docs.select(*dict.fromkeys([*keep, text_col]))
    schema = T.StructType([*(f for f in src.schema if f.name in keep), *T.StructType.fromDDL(RESULT)])
    shipped = _shipped(docs.sparkSession, blocks(benchmark, window, block_bytes))
    out = src.mapInArrow(tidy(_scan(shipped, _arrow(schema), text_col)), schema)
    n = F.size("items")
    return out.select(*keep, "n_words", "n_hit", n.cast("long").alias("n_items"), "items", "runs", "spans", (n >= min_items).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of decontaminate()."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
