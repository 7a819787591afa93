"""A bit table of a large dictionary's hashes, and the places of texts where it lets a value through.

The table holds two bits for each value: one of the hash of its first q
characters, q being the largest power of two that is not above its length, and
one of the hash of all of them. A place of a text passes where both are set. No
place of a value is lost; others pass by chance, so what stands there is to be
compared. Its size is bounded: beyond it, more places pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each value, and the least and the greatest size of a table (powers of two, in bits).
BITS, LEAST, GREATEST = 32, 16, 28
#: Characters that a worker handles at once.
BLOCK = 1 << 20

U64 = np.uint64
_K = 0x9E3779B97F4A7C15
_powers = np.ones(1, U64), np.ones(1, U64)


@dataclass(frozen=True)
class Table:
    words: np.ndarray  # uint64
    lengths: tuple[int, ...]  # characters of the values, ascending

    def has(self, h: np.ndarray) -> np.ndarray:
        h = _bit(h, len(self.words) * 64)
        return (self.words[h >> U64(6)] >> (h & U64(63))) & U64(1) != 0


def _bit(h: np.ndarray, size: int) -> np.ndarray:
    return h & U64(size - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _up_down(n: int) -> tuple[np.ndarray, np.ndarray]:
    """K**i and K**-i for i < n, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers = tuple(np.concatenate(([U64(1)], np.cumprod(np.full(size - 1, U64(k))))) for k in (_K, pow(_K, -1, 1 << 64)))
    return _powers[0][:n], _powers[1][:n]


class _Hashes:
    """Hashes of any spans of a text in constant time each, from one prefix sum over its characters."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U64)
        up, self.down = _up_down(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, U64)
        np.cumsum(_mix(codes + U64(1)) * up[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        return _mix((self.sums[start + n] - self.sums[start]) * self.down[start] + np.asarray(n).astype(U64))

    def windows(self, n: int) -> np.ndarray:
        """Of all spans of n characters, by start."""
        end = len(self.sums) - n
        return _mix((self.sums[n:] - self.sums[:end]) * self.down[:end] + U64(n)) if end > 0 else np.zeros(0, U64)


def _groups(values: list[str], size: int = BLOCK) -> Iterator[list[str]]:
    group, n = [], 0
    for v in values:
        group.append(v)
        n += len(v)
        if n >= size:
            yield group
            group, n = [], 0
    if group:
        yield group


def _classes(n: np.ndarray) -> np.ndarray:
    """The largest power of two that is not above each length of at least 1."""
    return np.left_shift(1, np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1)


def _bits(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for values in _groups(batch.column(0).to_pylist()):
                n = np.array([len(v) for v in values], np.int64)
                start = np.cumsum(n) - n
                h = _Hashes("".join(values))
                both = np.unique(_bit(np.concatenate((h.spans(start, _classes(n)), h.spans(start, n))), size))
                yield pa.record_batch([pa.array(both.astype(np.int64))], names=["bit"])

    return run


def build(df: DataFrame, column: str, n: int) -> Table:
    """The table of n values (not null, not empty); only its set bits and the distinct lengths come to the driver."""
    size = 1 << min(GREATEST, max(LEAST, (n * BITS - 1).bit_length()))
    lengths = sorted(r[0] for r in df.select(F.char_length(column)).distinct().collect())
    bits = df.select(column).mapInArrow(_bits(size), "bit long")
    each = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    words = np.zeros(size >> 6, U64)
    words[each["word"].to_numpy()] = each["bits"].to_numpy().view(U64)
    return Table(words, tuple(lengths))


def _sections(texts: list[str | None], reach: int) -> Iterator[tuple[int, int, str, int]]:
    """(row, first place, characters, places) of the texts: values begin at the section's places and may end reach characters after."""
    for row, t in enumerate(texts):
        for a in range(0, len(t or ""), BLOCK):
            yield row, a, t[a : a + BLOCK + reach], min(BLOCK, len(t) - a)


def _places(sections: list[tuple[int, int, str, int]], table: Table) -> tuple[list[int], list[str], list[list[int]]]:
    off = np.cumsum([0] + [len(x[2]) for x in sections])
    limit = off[:-1] + np.array([x[3] for x in sections])
    text = "".join(x[2] for x in sections)
    h, lengths = _Hashes(text), np.array(table.lengths)
    classes = _classes(lengths)
    found: dict[tuple[int, str], list[int]] = {}
    for q in np.unique(classes).tolist():
        at = np.flatnonzero(table.has(h.windows(q)))
        of = np.searchsorted(off, at, side="right") - 1
        inside = at < limit[of]
        at, of = at[inside], of[inside]
        for n in lengths[classes == q].tolist():
            fits = at + n <= off[of + 1]
            a, k = at[fits], of[fits]
            on = table.has(h.spans(a, n))
            for i, j in zip(a[on].tolist(), k[on].tolist(), strict=True):
                row, base = sections[j][:2]
                found.setdefault((row, text[i : i + n]), []).append(base + i - int(off[j]))
    return [r for r, _ in found], [f for _, f in found], list(found.values())


def search(texts: list[str | None], table: Table) -> Iterator[tuple[list[int], list[str], list[list[int]]]]:
    """For blocks of the texts: rows, what stands at places that pass, and those places (in characters, from 0)."""
    if not table.lengths:
        return
    group, n = [], 0
    for x in _sections(texts, table.lengths[-1] - 1):
        group.append(x)
        n += len(x[2])
        if n >= BLOCK:
            yield _places(group, table)
            group, n = [], 0
    if group:
        yield _places(group, table)
