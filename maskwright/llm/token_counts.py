"""Token counts by section: whole documents are encoded once, tokens are attributed by their character offsets.

A document is encoded as one text, so its tokens are those that training sees.
The tokens' byte lengths give their spans, counted in characters; the spans are
joined to the document's sections by two binary searches each. The rule for a
token that crosses a boundary: it counts for the section that holds most of its
characters, of equal ones for the earlier; a token that no section touches
counts as outside (section null). ``n_crossing`` are the counted tokens that
also touch another section or stand partly outside.

Documents are handled alone, in the order they come: no shuffle.

Defined cases: a null text is empty. Null sections and those without characters
are given with 0 tokens (null ones not at all). Sections may come in any order;
where they overlap, the later one is cut at the end of the earlier. Every
document gives one row for each of its sections, and a row for outside if there
are such tokens. Repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_slices

#: The pre-tokenizer pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RESULT = "doc_id long, section string, n_tokens long, n_crossing long"
_encodings: dict[str, tuple] = {}


def encoding(path: str, pattern: str = PATTERN):
    """The worker's encoding of a rank file, and the byte length of each id."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            size[k] = len(token)
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _encodings[path]


def spans(ids: np.ndarray, size: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens; a token inside a character has that character's span."""
    end = np.cumsum(size[ids])
    start = end - size[ids]
    if len(raw) and raw.max() >= 0x80:
        char = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        return char[start + 1] - 1, char[end]
    return start, end


def attribute(start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens [start, end), the section of sorted disjoint [lo, hi) that each counts for (-1: none), and whether it crosses."""
    first, last = np.searchsorted(hi, start, side="right"), np.searchsorted(lo, end, side="left")
    best, most, inside = np.full(len(start), -1), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    k, todo = first.copy(), np.flatnonzero(first < last)
    while len(todo):
        s = k[todo]
        n = np.minimum(end[todo], hi[s]) - np.maximum(start[todo], lo[s])
        inside[todo] += n
        better = n > most[todo]
        best[todo[better]], most[todo[better]] = s[better], n[better]
        k[todo] += 1
        todo = todo[k[todo] < last[todo]]
    return best, (best >= 0) & (most < end - start)


def _sections(rows: list | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    rows = sorted((r for r in rows or () if r is not None and r["start"] is not None and r["end"] is not None), key=lambda r: (r["start"], r["end"]))
    lo, hi, at = [], [], 0
    for r in rows:
        lo.append(max(r["start"], at))
        hi.append(at := max(r["end"], lo[-1]))
    return [r["name"] for r in rows], np.array(lo, np.int64), np.array(hi, np.int64)


def _run(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoding(path, pattern)
        for batch in batches:
            ids, names, count, crossing = [], [], [], []
            docs, sections = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j, data, off in text_slices(batch.column(1)):
                for k in range(j - i):
                    raw = data[off[k] : off[k + 1]]
                    name, lo, hi = _sections(sections[i + k])
                    got = np.asarray(enc.encode_to_numpy(raw.tobytes().decode(errors="replace"), disallowed_special=()))
                    best, cross = attribute(*spans(got, size, raw), lo, hi)
                    n, x = np.bincount(best + 1, minlength=len(lo) + 1), np.bincount(best + 1, weights=cross, minlength=len(lo) + 1)
                    for s in range(0 if n[0] else 1, len(lo) + 1):
                        ids.append(docs[i + k])
                        names.append(name[s - 1] if s else None)
                        count.append(int(n[s]))
                        crossing.append(int(x[s]))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(count, pa.int64()), pa.array(crossing, pa.int64())], names=["doc_id", "section", "n_tokens", "n_crossing"])

    return run


def count_tokens(docs: DataFrame, sections: Column, ranks: str, *, pattern: str = PATTERN) -> DataFrame:
    """doc_id, section, n_tokens, n_crossing; sections is array<struct<name, start, end>> in characters, end exclusive."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "text", sections.alias("sections")).mapInArrow(_run(ranks, pattern), RESULT)


def title_body_tail(text: str = "text") -> Column:
    """The first line, the lines between, and the last line, without the line feeds that part them."""
    t = F.coalesce(F.col(text), F.lit(""))
    n, first = F.char_length(t), F.instr(t, "\n")
    last = n - F.instr(F.reverse(t), "\n") + 1  # place of the last line feed, from 1
    part = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    one = F.array(part("title", F.lit(0), n))
    two = F.array(part("title", F.lit(0), first - 1), part("tail", first, n))
    return F.when(first == 0, one).when(first == last, two).otherwise(F.array(part("title", F.lit(0), first - 1), part("body", first, last - 1), part("tail", last, n)))
