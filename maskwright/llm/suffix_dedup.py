"""Removal of repeated byte strings through a logarithmic family of sparse suffix arrays.

Documents are dealt to batches of about ``BATCH`` bytes by a hash of their row.
A batch's suffix array is sparse: it holds the suffixes at anchors, the
positions whose ``Q``-byte prefix has the least hash within some window of
``length`` bytes, so that equal windows have an anchor at the same place. An
anchor's context is the suffix as far as windows with this anchor reach, and
the bytes before it that they reach. An entry of the array is the prefix, by
whose bytes it is ordered, and then a hash (64 bits) of the context. Equal
entries of a batch are sent once, with the least doc_id, to a bucket by the
prefix, so that all suffixes that could share a window meet.

In a bucket the family of levels takes one batch after the other: its array is
merge-scanned against each level (both are sorted), an entry that stands there
is a long match for whichever of the two has the greater doc_id, and the new
entries become a level; levels of like size merge, so that there are
logarithmically many. At the end the levels are one array. Entries with a
neighbour that has the same prefix, but another context, go on to a second
round with all their bytes: there the suffixes are sorted in full, and so are
the bytes before the anchors, backwards. The common prefixes of neighbours in
both orders tell for every split of a window whether two contexts share it:
windows are equal if they lie in one stretch of both orders that agrees to the
window's ends. At last the matched windows of each document are merged into
spans and cut.

A task holds one batch of documents or one bucket of entries; both are sized by
parameters, not by the corpus. Text that millions of documents share meets in a
bucket once for each batch at most. What can't be split is a prefix: all the
different contexts of one ``Q``-byte string are compared in one bucket.

Defined cases: a null text is empty; texts shorter than ``length`` lose
nothing; rows with equal doc_id do not count as earlier for one another; a null
doc_id comes before all others (with the least long, if that is an id) and
removes nothing from itself. Empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, PrefixHash, mix, prepare, text_slices

LENGTH = 50
#: Bytes of the prefix by which anchors are found; fewer give fewer anchors, which are shared by chance more often.
Q = 20
#: Text of a batch and of the entries of a bucket, in bytes of documents.
BATCH, BUCKET = 12 << 20, 8 << 20
#: Contexts that are cut out of the text at once.
CHUNK = 1 << 16
_NULL = np.iinfo(np.int64).min


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w], by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = op(x[: len(x) - step], x[step:])
        have += step
    return x


class Layout:
    """The bytes of a context: the suffix, the bytes before it backwards, and how many of either belong to it."""

    def __init__(self, length: int, q: int):
        self.length, self.q, self.side = length, q, length - q
        self.width = length + self.side + 4
        self.kind = np.dtype(f"S{self.width}")
        #: of an entry: the prefix and the hash of the context
        self.entry = np.dtype(f"S{q + 8}")
        self.mask_bytes = -(-(self.side + 1) // 8)

    def sizes(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each context, the bytes before the anchor and those from it on."""
        tail = text[:, -4:].astype(np.int64)
        return tail[:, 2] * 256 + tail[:, 3], tail[:, 0] * 256 + tail[:, 1]


def _text(rows: np.ndarray) -> np.ndarray:
    """Sortable byte rows as a matrix."""
    return np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), rows.dtype.itemsize)


class Anchors:
    """The anchors of a slice of documents: position, document, and the window starts [first, last] that each stands for."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lay: Layout):
        n, w, length = len(data), lay.side + 1, lay.length
        self.data, self.off, self.lay = data, off, lay
        if n < length:
            self.at = self.doc = self.first = self.last = np.zeros(0, np.int64)
            self.prefix = self.reach = np.zeros(0, U64)
            return
        hashes = PrefixHash(data)
        key = hashes.windows(lay.q)
        order = (key >> U64(32)).astype(np.uint32)
        least = _slide(order, w, np.minimum)  # of each window start
        whole = np.zeros(len(least) + 1, np.int8)
        full = np.flatnonzero(np.diff(off) >= length)
        whole[off[full]] += 1
        whole[off[full + 1] - length + 1] -= 1
        top = np.where(np.cumsum(whole[:-1], dtype=np.int8) > 0, least, 0)
        padded = np.zeros(len(top) + 2 * (w - 1), np.uint32)
        padded[w - 1 : w - 1 + len(top)] = top
        self.at = np.flatnonzero((_slide(padded, w, np.maximum) == order) & (order > 0))
        self.prefix = mix(key[self.at] + U64(1))  # anchors have low hashes; these are even
        self.doc = np.searchsorted(off, self.at, side="right") - 1
        self.first, self.last = self._reach(padded, order, w)
        self.reach = hashes.spans(self.first, self.last + length) + (self.at - self.first).astype(U64)

    def _reach(self, padded: np.ndarray, order: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """The run of window starts p in [at - w + 1, at] whose least hash is the anchor's."""
        # that run lies in one stretch of equal least hashes, which is sought from the first start on
        mine = order[self.at]
        edge = np.flatnonzero(padded[1:] != padded[:-1]) + 1
        starts, ends = np.concatenate(([0], edge)), np.append(edge, len(padded))
        value = padded[starts]
        run = np.searchsorted(starts, self.at, side="right") - 1
        todo = np.flatnonzero(value[run] != mine)
        while len(todo):
            run[todo] += 1
            todo = todo[value[run[todo]] != mine[todo]]
        return np.maximum(starts[run], self.at) - (w - 1), np.minimum(ends[run] - 1, self.at + w - 1) - (w - 1)

    def entries(self, which: np.ndarray) -> np.ndarray:
        """The prefix and the context's hash of the given anchors."""
        q, out = self.lay.q, np.empty((len(which), self.lay.entry.itemsize), np.uint8)
        if len(which):
            out[:, :q] = np.lib.stride_tricks.sliding_window_view(self.data, q)[self.at[which]]
            out[:, q:] = self.reach[which].astype(">u8").view(np.uint8).reshape(-1, 8)
        return out.reshape(-1).view(self.lay.entry)

    def contexts(self, which: np.ndarray) -> np.ndarray:
        """The contexts of the given anchors."""
        lay, at = self.lay, self.at[which]
        before, after = at - self.first[which], self.last[which] + lay.length - at
        out = np.zeros((len(which), lay.width), np.uint8)
        if len(which):
            body = np.concatenate((np.zeros(lay.side, np.uint8), self.data, np.zeros(lay.length, np.uint8)))
            view = np.lib.stride_tricks.sliding_window_view
            out[:, : lay.length] = view(body, lay.length)[at + lay.side]
            out[:, : lay.length][np.arange(lay.length) >= after[:, None]] = 0
            if lay.side:
                left = view(body, lay.side)[at][:, ::-1]
                out[:, lay.length : -4] = np.where(np.arange(lay.side) < before[:, None], left, 0)
            for k, x in ((-4, after), (-2, before)):
                out[:, k], out[:, k + 1] = x >> 8, x & 255
        return out.reshape(-1).view(lay.kind)


class Batch:
    """The documents of one batch and its sparse suffix array, dealt to buckets.

    ``rows`` are the distinct entries, by bucket and in each by their bytes;
    ``least`` is the least doc_id of each and ``one`` some anchor of it, ``cut``
    has the bounds of the buckets, and ``of`` gives the entry of each anchor.
    """

    def __init__(self, table: pa.Table, lay: Layout, n_buckets: int):
        table = table.combine_chunks()
        self.lay, self.ids_column = lay, table.column("doc_id")
        ids = self.ids_column.combine_chunks() if table.num_rows else pa.array([], pa.int64())
        self.ids = ids.fill_null(int(_NULL)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.parts = [(i, Anchors(data, off, lay)) for i, _, data, off in text_slices(table.column("text"))] if table.num_rows else []
        doc = [self.ids[i + a.doc] for i, a in self.parts]
        self.sizes = np.array([0, *(len(a.at) for _, a in self.parts)], np.int64).cumsum()
        self.doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)
        self._distinct(n_buckets)

    def _gather(self, which: np.ndarray, f, kind: np.dtype) -> np.ndarray:
        """f of anchors given by number, over all slices."""
        out = np.zeros(len(which), kind)
        part = np.searchsorted(self.sizes, which, side="right") - 1
        for k in np.unique(part).tolist():
            at = np.flatnonzero(part == k)
            for c in range(0, len(at), CHUNK):
                mine = at[c : c + CHUNK]
                out[mine] = f(self.parts[k][1], which[mine] - self.sizes[k])
        return out

    def _distinct(self, n_buckets: int) -> None:
        n = len(self.doc)
        reach, prefix = (np.concatenate([getattr(a, x) for _, a in self.parts]) if self.parts else np.zeros(0, U64) for x in ("reach", "prefix"))
        order = np.argsort(reach)
        new = np.ones(n, bool)
        new[1:] = (reach[order[1:]] != reach[order[:-1]]) | (prefix[order[1:]] != prefix[order[:-1]])
        group = np.empty(n, np.int64)
        group[order] = np.cumsum(new) - 1
        one = order[new]
        rows = self._gather(one, Anchors.entries, self.lay.entry)
        bucket = ((prefix[one] >> U64(32)) * U64(n_buckets) >> U64(32)).astype(np.int32)
        order = _byte_order(rows)
        order = order[np.argsort(bucket[order], kind="stable")]
        rows, bucket, one = rows[order], bucket[order], one[order]
        new = np.ones(len(rows), bool)
        if len(rows):
            new[1:] = rows[1:] != rows[:-1]
        place = np.empty(len(rows), np.int64)
        place[order] = np.cumsum(new) - 1
        self.of, self.rows, self.one = place[group] if n else group, rows[new], one[new]
        self.least = np.full(len(self.rows), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.of, self.doc)
        self.cut = np.searchsorted(bucket[new], np.arange(n_buckets + 1))

    def contexts(self, entries: np.ndarray) -> np.ndarray:
        return self._gather(self.one[entries], Anchors.contexts, self.lay.kind)


def _byte_order(rows: np.ndarray) -> np.ndarray:
    """The order of rows by their bytes: by the first eight, then, among equal ones, by all."""
    if not len(rows):
        return np.zeros(0, np.int64)
    text, width = _text(rows), rows.dtype.itemsize
    if width < 8:
        return np.argsort(rows)
    head = np.ascontiguousarray(text[:, :8]).view(">u8").reshape(-1).astype(U64)
    order = np.argsort(head)
    head = head[order]
    same = head[1:] == head[:-1]
    tied = np.zeros(len(rows), bool)
    tied[1:] |= same
    tied[:-1] |= same
    at = np.flatnonzero(tied)
    if len(at):
        number = np.cumsum(np.concatenate(([True], ~same)))[at].astype(">u4")
        wide = np.empty((len(at), width - 4), np.uint8)
        wide[:, :4] = number.view(np.uint8).reshape(-1, 4)
        wide[:, 4:] = text[order[at], 8:]
        order[at] = order[at][np.argsort(wide.reshape(-1).view(f"S{width - 4}"))]
    return order


_CODEC = "zstd"


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec=_CODEC, asbytes=True) if len(x) else b""


def _unpack(raw: bytes, n: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.frombuffer(pa.decompress(raw, n * kind.itemsize, codec=_CODEC, asbytes=True), kind) if n else np.zeros(0, kind)


#: In the first round rows are entries, in the second one contexts.
ENTRIES = "bucket int, batch long, n int, rows binary, least binary"
#: whole: bits of the entries that an earlier document holds; which: the entries that go on.
FLAGS = "batch long, bucket int, n int, whole binary, n_part int, which binary"
MASKS = "batch long, bucket int, n int, masks binary"


def _send(batch: int, rows: np.ndarray, least: np.ndarray, cut: np.ndarray) -> pa.Table:
    full = np.flatnonzero(np.diff(cut)).tolist()
    part = [slice(int(cut[k]), int(cut[k + 1])) for k in full]
    return pa.table({
        "bucket": pa.array(full, pa.int32()), "batch": pa.array([batch] * len(full), pa.int64()), "n": pa.array([s.stop - s.start for s in part], pa.int32()),
        "rows": pa.array([_pack(rows[s]) for s in part], pa.binary()), "least": pa.array([_pack(least[s]) for s in part], pa.binary()),
    })


def _entry_table(batch: int, b: Batch) -> pa.Table:
    return _send(batch, b.rows, b.least, b.cut)


class Family:
    """Sorted levels of distinct entries, each with its least doc_id and where that stands (batch, number); like levels merge."""

    def __init__(self, kind: np.dtype):
        self.kind, self.levels = kind, []

    @staticmethod
    def _merge(x: tuple, y: tuple) -> tuple:
        """Both in one order; no entry is in both."""
        at = np.searchsorted(x[0], y[0]) + np.arange(len(y[0]))
        from_x = np.ones(len(x[0]) + len(y[0]), bool)
        from_x[at] = False
        out = []
        for a, b in zip(x, y, strict=True):
            c = np.empty(len(from_x), a.dtype)
            c[from_x], c[at] = a, b
            out.append(c)
        return tuple(out)

    def add(self, rows: np.ndarray, least: np.ndarray, batch: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Merge-scans a batch's sorted entries against the levels and makes what is new a level.

        Gives which entries a smaller doc_id holds, which ones the same doc_id
        holds in another batch, and the (batches, numbers) of entries that hold
        their place no longer, as the batch has a smaller doc_id for them.
        """
        new, later, same, lost = np.ones(len(rows), bool), np.zeros(len(rows), bool), np.zeros(len(rows), bool), []
        for k, g, of, number in self.levels:
            todo = np.flatnonzero(new)
            if not len(todo):
                break
            at = np.minimum(np.searchsorted(k, rows[todo]), len(k) - 1)
            hit = k[at] == rows[todo]
            todo, at = todo[hit], at[hit]
            new[todo] = False
            later[todo], same[todo] = g[at] < least[todo], g[at] == least[todo]
            won = g[at] > least[todo]
            if won.any():
                todo, at = todo[won], at[won]
                lost.append((of[at], number[at]))
                g[at], of[at], number[at] = least[todo], batch, todo
        fresh = np.flatnonzero(new)
        if len(fresh):
            level = (rows[fresh], least[fresh], np.full(len(fresh), batch, np.int64), fresh.astype(np.int64))
            while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
                level = self._merge(self.levels.pop(), level)
            self.levels.append(level)
        return later, same, lost

    def all(self) -> tuple[np.ndarray, ...]:
        while len(self.levels) > 1:
            y = self.levels.pop()
            self.levels[-1] = self._merge(self.levels[-1], y)
        z = np.zeros(0, np.int64)
        return self.levels[0] if self.levels else (np.zeros(0, self.kind), z, z, z)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common prefix of each two rows."""
    out = np.empty(len(a), np.int64)
    for c in range(0, len(a), CHUNK):
        differ = a[c : c + CHUNK] != b[c : c + CHUNK]
        out[c : c + CHUNK] = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return out


def shared_windows(rows: np.ndarray, least: np.ndarray, lay: Layout) -> np.ndarray:
    """Of sorted contexts, as bits for each: the windows that one with a smaller doc_id has too.

    Bit k stands for the window that begins k bytes before the anchor.
    """
    text, n = _text(rows), len(rows)
    bits = np.zeros((n, lay.mask_bytes * 8), bool)
    if n < 2:
        return bits
    before, after = lay.sizes(text)
    up = np.zeros(n + 1, np.int64)  # common with the one before; 0 at the ends
    up[1:-1] = _common(text[1:, : lay.length], text[:-1, : lay.length])
    left = np.ascontiguousarray(text[:, lay.length : -4])
    back = np.argsort(left.reshape(-1).view(f"S{lay.side}")) if lay.side else np.arange(n)
    down = np.zeros(n + 1, np.int64)
    down[1:-1] = _common(left[back[1:]], left[back[:-1]])
    right_most, left_most = np.maximum(up[1:], up[:-1]), np.empty(n, np.int64)
    left_most[back] = np.maximum(down[1:], down[:-1])
    block = np.empty(n, np.int64)
    for k in range(lay.side + 1):
        r = lay.length - k
        on = (before >= k) & (after >= r) & (right_most >= r)
        if k:
            on &= left_most >= k
        idx = np.flatnonzero(on)
        if len(idx) < 2:
            continue
        block[back] = np.cumsum(down[:-1] < k) if k else 0
        key = np.cumsum(up[:-1] < r)[idx] * (n + 1) + block[idx]
        order = np.argsort(key)
        key, who = key[order], idx[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        first = np.repeat(np.minimum.reduceat(least[who], start), np.diff(np.append(start, len(who))))
        bits[who[least[who] > first], k] = True
    return bits


def _match(table: pa.Table, lay: Layout) -> pa.Table:
    """First round, one bucket: which entries of each batch an earlier document holds, and which ones share only their prefix."""
    rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
    bucket, family = rows[0]["bucket"], Family(lay.entry)
    whole: dict[int, np.ndarray] = {}
    again: list[tuple[np.ndarray, np.ndarray, int, np.ndarray]] = []
    for r in rows:
        own, least = _unpack(r["rows"], r["n"], lay.entry), _unpack(r["least"], r["n"], np.int64)
        r["rows"] = r["least"] = None
        later, same, lost = family.add(own, least, r["batch"])
        whole[r["batch"]] = later
        for of, number in lost:
            for b in np.unique(of).tolist():
                whole[b][number[of == b]] = True
        if same.any():
            at = np.flatnonzero(same)
            again.append((own[at], least[at], r["batch"], at))
    key, least, batch, number = family.all()
    prefix = _text(key)[:, : lay.q]
    alike = _common(prefix[1:], prefix[:-1]) == lay.q
    near = np.zeros(len(key), bool)
    near[1:] |= alike
    near[:-1] |= alike
    of, which = [batch[near]], [number[near]]
    for own, mine, b, at in again:  # other rows of a document whose id holds the entry
        place = np.searchsorted(key, own)
        whole[b][at[least[place] < mine]] = True
        hit = near[place] & (least[place] == mine)
        of, which = [*of, np.full(int(hit.sum()), b)], [*which, at[hit]]
    of, which = np.concatenate(of), np.concatenate(which)
    order = np.lexsort((which, of))
    of, which = of[order], which[order].astype(np.uint32)
    names = sorted(whole)
    cut = np.searchsorted(of, np.array([*names, 1 << 62])).tolist()
    part = [slice(cut[k], cut[k + 1]) for k in range(len(names))]
    return pa.table({
        "batch": pa.array(names, pa.int64()), "bucket": pa.array([bucket] * len(names), pa.int32()), "n": pa.array([len(whole[b]) for b in names], pa.int32()),
        "whole": pa.array([_pack(np.packbits(whole[b])) for b in names], pa.binary()), "n_part": pa.array([s.stop - s.start for s in part], pa.int32()),
        "which": pa.array([_pack(which[s]) for s in part], pa.binary()),
    })


def _going_on(b: Batch, flags: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The entries that the first round passed on, in order, and the bounds of the buckets among them."""
    found = [int(b.cut[r["bucket"]]) + _unpack(r["which"], r["n_part"], np.uint32).astype(np.int64) for r in flags.select(["bucket", "n_part", "which"]).to_pylist() if r["n_part"]]
    entries = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return entries, np.searchsorted(entries, b.cut)


def _context_table(batch: int, b: Batch, flags: pa.Table) -> pa.Table:
    entries, cut = _going_on(b, flags)
    return _send(batch, b.contexts(entries), b.least[entries], cut)


def _match_contexts(table: pa.Table, lay: Layout) -> pa.Table:
    """Second round, one bucket: of each context the windows that an earlier document has, as bits."""
    rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
    text = np.concatenate([_unpack(r["rows"], r["n"], lay.kind) for r in rows])
    least = np.concatenate([_unpack(r["least"], r["n"], np.int64) for r in rows])
    order = _byte_order(text)
    masks = np.empty((len(text), lay.mask_bytes), np.uint8)
    masks[order] = np.packbits(shared_windows(text[order], least[order], lay), axis=1, bitorder="little")
    cut = np.cumsum([0] + [r["n"] for r in rows]).tolist()
    return pa.table({
        "batch": pa.array([r["batch"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "n": pa.array([r["n"] for r in rows], pa.int32()),
        "masks": pa.array([_pack(masks[cut[k] : cut[k + 1]]) for k in range(len(rows))], pa.binary()),
    })


SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def _cut_batch(b: Batch, flags: pa.Table, found: pa.Table) -> pa.Table:
    """Both rounds' findings of one batch put to its documents."""
    lay = b.lay
    state, masks = np.zeros(len(b.rows), bool), np.zeros((len(b.rows), lay.mask_bytes), np.uint8)
    for r in flags.to_pylist():
        lo = int(b.cut[r["bucket"]])
        state[lo : lo + r["n"]] = np.unpackbits(_unpack(r["whole"], -(-r["n"] // 8), np.uint8))[: r["n"]]
    entries, cut = _going_on(b, flags)
    for r in found.to_pylist():
        at = entries[int(cut[r["bucket"]]) : int(cut[r["bucket"] + 1])]
        masks[at] = _unpack(r["masks"], r["n"] * lay.mask_bytes, np.uint8).reshape(-1, lay.mask_bytes)
    some = masks.any(axis=1)
    rows = []
    for k, (row, a) in enumerate(b.parts):
        mine = slice(int(b.sizes[k]), int(b.sizes[k + 1]))
        of = b.of[mine]
        whole = state[of] | (b.doc[mine] > b.least[of])
        step = np.zeros(len(a.data) + 1, np.int32)
        np.add.at(step, a.first[whole], 1)
        np.add.at(step, a.last[whole] + lay.length, -1)
        rest = np.flatnonzero(~whole & some[of])
        if len(rest):
            bits = np.unpackbits(masks[of[rest]], axis=1, bitorder="little")
            who, before = np.nonzero(bits)
            p = a.at[rest[who]] - before
            np.add.at(step, p, 1)
            np.add.at(step, p + lay.length, -1)
        gone = np.cumsum(step[:-1]) > 0
        raw = a.data.tobytes()
        for d in range(len(a.off) - 1):
            s, e = int(a.off[d]), int(a.off[d + 1])
            g = gone[s:e]
            n_gone = int(g.sum())
            if n_gone:
                edge = np.flatnonzero(np.diff(g.view(np.int8), prepend=0, append=0))
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                kept = a.data[s:e][~g].tobytes()
            else:
                spans, kept = [], raw[s:e]
            rows.append((e - s, n_gone, len(spans), hashlib.sha256(kept).hexdigest(), spans))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table({
        "doc_id": b.ids_column, "n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "n_spans": pa.array(cols[2], pa.int64()),
        "kept_sha256": pa.array(cols[3], pa.string()), "spans": pa.array(cols[4], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    })


def _by_batch(f, docs: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """f(batch, documents, findings) over the batches."""

    def run(key, table, other):
        return f(key[0].as_py(), table, other)

    run.__annotations__ = {}
    return docs.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(run, kind)


def _by_bucket(f, lay: Layout, sent: DataFrame, kind: str) -> DataFrame:
    def run(table):
        return f(table, lay)

    run.__annotations__ = {}
    return sent.groupBy("bucket").applyInArrow(run, kind)


class SuffixDedup:
    """See the module; ``result`` gives a row for each document."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, q: int = Q, batch_bytes: int = BATCH, bucket_bytes: int = BUCKET):
        if not 0 < q <= length:
            raise ValueError("q must be within length")
        self.spark = prepare(docs.sparkSession)
        self.lay = Layout(length, q)
        total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.n_batches, self.n_buckets = max(1, -(-total // batch_bytes)), max(1, -(-total // bucket_bytes))
        self.docs = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.n_batches)).alias("batch"))

    def _flags(self) -> DataFrame:
        lay, n = self.lay, self.n_buckets

        def run(key, table):
            return _entry_table(key[0].as_py(), Batch(table, lay, n))

        run.__annotations__ = {}
        return _by_bucket(_match, lay, self.docs.groupBy("batch").applyInArrow(run, ENTRIES), FLAGS)

    def result(self) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed byte ranges) of every document."""
        lay, n = self.lay, self.n_buckets
        # read twice, from one exchange
        flags = self._flags().repartition("batch")
        context = lambda batch, table, found: _context_table(batch, Batch(table, lay, n), found)
        masks = _by_bucket(_match_contexts, lay, _by_batch(context, self.docs, flags, ENTRIES), MASKS)
        both = flags.withColumn("masks", F.lit(None).cast("binary")).unionByName(masks, allowMissingColumns=True)

        def cut(batch, table, found):
            first = pc.is_valid(found.column("whole"))
            return _cut_batch(Batch(table, lay, n), found.filter(first), found.filter(pc.invert(first)))

        # one plan, in which the exchange of the documents by batch stands once and is read three times
        return _by_batch(cut, self.docs, both, SPANS)


def remove_repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans: see SuffixDedup.result."""
    return SuffixDedup(docs, length).result()
