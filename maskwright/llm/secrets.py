"""Secret scans with a recursive decoding worklist.

The whole text is scanned for three kinds of secrets. Then encoded segments
(URL escapes, Unicode escapes and character references, two-byte characters,
base64, gzip and zlib streams) are unwrapped; each layer goes on a worklist, is scanned itself and
searched for further encoded segments, until nothing new appears. A layer whose
content was seen before at the same place of the document is not opened again,
so encodings that reproduce themselves end. Every decoded character knows the range of the
original text it came from, so a secret found in any layer has a span there.

Documents are handled alone, in the order they come: no shuffle, and the memory
of a slice of documents.

Decoded layers are scanned as bytes, whatever they hold. Packed streams are read
to the end, through all their members, in pieces cut where no secret or encoded
run is; a run without such a place is held whole.

Defined cases: a null or empty text has no spans. Of a damaged or short stream,
what comes before the damage is scanned, and it is counted in ``n_unopened`` (as
are single lines of a stream that goes on in the next line).
Repeated rows give repeated rows; extra columns pass if named in ``keep``.
"""

from __future__ import annotations

import binascii
import contextlib
import hashlib
import io
import itertools
import re
import tempfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, prepare, text_slices, tidy

KINDS = ("assign", "access", "hex")
#: Fixed patterns; letters of assign's first group stand in either case.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_VALUE = 8

URL = re.compile(r"(?:[A-Za-z0-9._~!*'();:@&=+$,/?#\[\]\"<>{}|^`\\-]|%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
#: The characters of the shortest secret's encoding, without padding.
B64_LEAST = 19
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % B64_LEAST)
#: Runs that go on after line feeds.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t\r]*+\n[\x20\t\r\n]*+[A-Za-z0-9+/_-]++)+={0,2}")
_PARTS = re.compile(r"[+/_-]")
#: ASCII as two-byte characters, of either byte order, as long as the shortest secret.
WIDE = re.compile(r"(?:[\t\n\r\x20-\x7e]\x00){14,}|(?:\x00[\t\n\r\x20-\x7e]){14,}")
_GZIP = re.compile(rb"\x1f\x8b\x08")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
#: Bytes that a stream is unpacked by, that are scanned at once, and that are kept in memory of a stream inside a stream.
BLOCK, PIECE, SPOOL = 1 << 20, 4 << 20, 16 << 20

_TRIGGERS = (b"passw", b"secret", b"token", b"api")
_HEXBYTE = np.zeros(256, bool)
_HEXBYTE[list(b"0123456789abcdef")] = True
_ANYHEX = _HEXBYTE.copy()
_ANYHEX[list(b"ABCDEF")] = True
_B64BYTE = np.zeros(256, bool)
_B64BYTE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True
#: Bytes of no secret and of no encoding; bytes beside which a space may belong to a secret; bytes beside which a line feed may part base64.
_BREAK = np.ones(256, bool)
_BREAK[[9, 10, 13, *range(0x20, 0x7F)]] = False
_NEAR_SPACE, _WRAPPED = np.zeros(256, bool), _B64BYTE.copy()
_NEAR_SPACE[list(b" :=\t\r\n\0")] = _WRAPPED[list(b" \t\r\n\0")] = True


def find(text: str) -> list[tuple[str, int, int]]:
    """The secrets of one layer: (kind, start, end), by start and then kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sort_spans(out)


def sort_spans(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Layer:
    """Decoded text, a character for each byte where it comes from bytes.

    Character i stands for [start[i], end[i]) of the original, for itself where
    these are None, and for all of ``whole`` where that is given.
    """

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None, path: str = "", whole: tuple[int, int] | None = None):
        self.text, self.start, self.end, self.path, self.whole = text, start, end, path, whole

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.whole is not None:
            return self.whole
        return (a, b) if self.start is None else (int(self.start[a:b].min()), int(self.end[a:b].max()))

    def derive(self, text: str, lo: np.ndarray, hi: np.ndarray, path: str) -> Layer:
        """A layer whose character i comes from [lo[i], hi[i]) of this one, both ascending."""
        if self.whole is not None:
            return Layer(text, path=self.path + path, whole=self.whole)
        if self.start is None:
            return Layer(text, lo, hi, self.path + path)
        if not (hi - lo > 1).any():
            return Layer(text, self.start[lo], self.end[lo], self.path + path)
        k = np.arange(int((hi - lo).max()))[:, None]
        at = np.minimum(lo + k, hi - 1)
        return Layer(text, self.start[at].min(axis=0), self.end[at].max(axis=0), self.path + path)

    def readable(self) -> bool:
        """Whether it is UTF-8 without control characters, or text already."""
        try:
            return not _CONTROL.search(self.text.encode("latin-1").decode())
        except UnicodeEncodeError:
            return not _CONTROL.search(self.text)
        except UnicodeDecodeError:
            return False


def _from_url(layer: Layer) -> Iterator[Layer]:
    for m in URL.finditer(layer.text):
        if "%" not in (seg := m[0]):
            continue
        lo = np.arange(len(seg))
        raw = np.frombuffer(seg.encode("ascii"), np.uint8)
        at = np.flatnonzero(raw == 0x25)  # each starts an escape
        keep = np.ones(len(seg), bool)
        keep[at + 1] = keep[at + 2] = False
        lo = lo[keep]
        hi = np.where(raw[lo] == 0x25, lo + 3, lo + 1)
        yield layer.derive(unquote_to_bytes(seg).decode("latin-1"), lo + m.start(), hi + m.start(), "url/")


def _from_escapes(layer: Layer) -> Iterator[Layer]:
    """The whole layer with its escapes replaced."""
    out, lo, hi, at = [], [], [], 0
    for m in ESCAPE.finditer(layer.text):
        digits = next(x for x in m.groups() if x)
        code = int(digits, 10 if m[5] else 16)
        if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF or code == 0:
            continue
        out += [layer.text[at : m.start()], chr(code)]
        lo += [np.arange(at, m.start()), [m.start()]]
        hi += [np.arange(at + 1, m.start() + 1), [m.end()]]
        at = m.end()
    if out:
        n = len(layer.text)
        lo, hi = (np.concatenate([*x, np.arange(at + k, n + k)]).astype(np.int64) for k, x in ((0, lo), (1, hi)))
        yield layer.derive("".join(out) + layer.text[at:], lo, hi, "unicode/")


def _from_wide(layer: Layer) -> Iterator[Layer]:
    """Runs of two-byte characters without their zero bytes."""
    if "\x00" in layer.text:
        for m in WIDE.finditer(layer.text):
            lo = np.arange(m.start(), m.end(), 2)
            yield layer.derive(m[0].replace("\x00", ""), lo, lo + 2, "wide/")


def _bits(raw: bytes) -> int:
    """zlib's window bits for the stream that raw begins with, 0 if it is none."""
    return 31 if raw[:2] == b"\x1f\x8b" else 15 if len(raw) > 2 and raw[0] == 0x78 and (raw[0] * 256 + raw[1]) % 31 == 0 else 0


def _inflate(src, broken: list[int], ended: list[int]) -> Iterator[bytes]:
    """Blocks of what a file's gzip or zlib streams hold, one after the other, and of what follows them.

    broken counts damaged ones; ended gets the place that whole streams reach to.
    """
    data, any_out = src.read(BLOCK), False
    while data:
        if not (bits := _bits(data)):
            ended.append(src.tell() - len(data))
            while any_out and data:
                yield data
                data = src.read(BLOCK)
            return
        d = zlib.decompressobj(bits)
        while not d.eof:
            if not data:
                broken[0] += any_out
                return
            before = d.copy()
            try:
                got, bad = d.decompress(data, BLOCK), False
            except zlib.error:  # what comes before the damage is whole
                got, bad = b"", True
                with contextlib.suppress(zlib.error):
                    for k in range(len(data)):
                        got += before.decompress(data[k : k + 1])
            any_out |= bool(got)
            if got:
                yield got
            if bad:
                broken[0] += any_out
                return
            if not d.eof:
                data = d.unconsumed_tail or src.read(BLOCK)
                if not data and len(got) == BLOCK:  # the last of the output may still be held back
                    if rest := d.flush():
                        yield rest
        data = d.unused_data
        if len(data) < 3:
            data += src.read(BLOCK)
    ended.append(src.tell())


def _cuts(data: bytes) -> int:
    """The last place at which no secret or encoded run can be cut in two; 0 if there is none."""
    x = np.frombuffer(data, np.uint8)
    ok = _BREAK[x]
    prev, after = np.append(np.uint8(0), x[:-1]), np.append(x[1:], np.uint8(0))
    ok |= (x == 0x20) & ~_NEAR_SPACE[prev] & ~_NEAR_SPACE[after]
    ok |= (x == 0x0A) & ~(_WRAPPED[prev] & _WRAPPED[after])
    ok[-1] = False  # what comes next is not known
    at = np.flatnonzero(ok)
    return int(at[-1]) + 1 if len(at) else 0


def _pieces(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The same bytes in pieces of about PIECE bytes, longer only where a run without a break is."""
    held, size, least = [], 0, PIECE
    for block in blocks:
        held.append(block)
        size += len(block)
        if size >= least:
            data = b"".join(held)
            if cut := _cuts(data):
                yield data[:cut]
            held, size = [data[cut:]], len(data) - cut
            least = max(PIECE, 2 * size)
    if size:
        yield b"".join(held)


def _unpacked(raw: bytes, broken: list[int], ended: list[int]) -> Iterator[tuple[str, str]]:
    """The text of a packed stream in pieces, then that of the stream it holds, with the path of each."""
    src, seen, path = io.BytesIO(raw), {hashlib.sha256(raw).digest()}, ""
    while src is not None:
        path += "zip/"
        spool, sha = None, hashlib.sha256()

        def copied(src=src, sha=sha):
            nonlocal spool
            for k, block in enumerate(_inflate(src, broken, ended)):
                if not k and _bits(block):
                    spool = tempfile.SpooledTemporaryFile(SPOOL)  # noqa: SIM115
                if spool is not None:
                    spool.write(block)
                sha.update(block)
                yield block

        for piece in _pieces(copied()):
            yield piece.decode("latin-1"), path
        src.close()
        if spool is not None and sha.digest() not in seen:  # a stream may hold itself
            seen.add(sha.digest())
            spool.seek(0)
            src = spool
        else:
            src = None
            if spool is not None:
                spool.close()


def _runs(layer: Layer) -> Iterator[tuple[str, np.ndarray, int]]:
    """Base64 runs: the characters, the place of each, and the end with padding; lines that follow one another also joined."""
    for m in BASE64.finditer(layer.text):
        seg = m[0].rstrip("=")
        yield seg, np.arange(m.start(), m.start() + len(seg)), m.end()
    if "\n" in layer.text:
        for m in WRAPPED.finditer(layer.text):
            raw = np.frombuffer(m[0].encode("ascii"), np.uint8)
            at = np.flatnonzero(_B64BYTE[raw])
            if len(at) >= B64_LEAST:
                yield raw[at].tobytes().decode("ascii"), at + m.start(), m.end()


def _from_base64(layer: Layer, broken: list[int]) -> Iterator[Layer]:
    """Each run decoded from its first four characters on, one of which is in phase with whatever begins inside of the run."""
    for seg, at, stop in _runs(layer):
        ends = np.append(at[1:], stop) if len(at) == at[-1] - at[0] + 1 else np.append(at[:-1] + 1, stop)
        plain = seg.replace("-", "+").replace("_", "/")
        # a packed stream may begin with the run, a line, or after a character that also parts words
        marks = [0, *(np.flatnonzero(np.diff(at) > 1) + 1).tolist(), *(m.end() for m in _PARTS.finditer(seg))]
        for phase in range(4):
            n = len(seg) - phase
            n -= n % 4 == 1
            if n < B64_LEAST:
                break
            raw = binascii.a2b_base64(plain[phase : phase + n] + "=" * (-n % 4))
            begins = {(k - phase) // 4 * 3 for k in marks if k >= phase and (k - phase) % 4 == 0}
            begins.update(m.start() for m in _GZIP.finditer(raw))
            past = 0  # later members of a stream come with it
            for k in sorted(begins):
                if k >= past and _bits(raw[k : k + 3]):
                    whole, ended = layer.span(int(at[phase + k // 3 * 4]), stop), []
                    for text, path in _unpacked(raw[k:], broken, ended):
                        yield Layer(text, path=layer.path + "base64/" + path, whole=whole)
                    past = k + ended[0] if ended else past
            group = phase + np.arange(len(raw)) // 3 * 4
            yield layer.derive(raw.decode("latin-1"), at[group], ends[np.minimum(group + 3, len(at) - 1)], "base64/")


def scan(text: str) -> tuple[list[tuple], list[tuple], int, int]:
    """Base spans, added (kind, start, end, path), layers opened, and damaged streams.

    A layer counts as opened if it reads as text or holds a secret.
    """
    base = find(text)
    held, added, seen, broken, opened = set(base), {}, {(text, 0, len(text))}, [0], 0
    known: dict[str, list] = {}

    def inside(layer: Layer) -> Iterator[Layer]:
        return itertools.chain(_from_url(layer), _from_base64(layer, broken), _from_escapes(layer), _from_wide(layer))

    work = [inside(Layer(text))]  # one layer of each depth is held at a time
    while work:
        x = next(work[-1], None)
        if x is None:
            work.pop()
            continue
        if not x.text:
            continue
        small = len(x.text) <= 4096
        name = x.text if small else hashlib.sha256(x.text.encode(errors="surrogatepass")).digest()
        place = (name, *x.span(0, len(x.text)))  # equal text elsewhere has spans of its own
        if place in seen:
            continue
        seen.add(place)
        found = known.get(name)
        if found is None:
            found = find(x.text)
            if small:
                known[name] = found
        opened += bool(found) or x.readable()
        for kind, a, b in found:
            span = (kind, *x.span(a, b))
            if span not in held:
                held.add(span)
                added[span] = x.path
        work.append(inside(x))
    return base, [(*s, added[s]) for s in sort_spans(added)], opened, broken[0]


def suspects(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Documents of a slice in which anything can be found; the others need no scan."""
    hit = np.zeros(len(off), bool)

    def mark(at) -> None:
        hit[np.searchsorted(off, at, side="right") - 1] = True

    low, raw = LOWER[data].tobytes(), data.tobytes()
    for what, where in [*((t, low) for t in _TRIGGERS), (b"AKIA", raw), (b"\\", raw), (b"&#", raw)]:
        at = where.find(what)
        while at >= 0:
            k = int(np.searchsorted(off, at, side="right")) - 1
            hit[k] = True
            at = where.find(what, int(off[k + 1]))
    pct = np.flatnonzero(data == 0x25)
    pct = pct[pct + 2 < len(data)]
    if len(pct):
        mark(pct[_ANYHEX[data[pct + 1]] & _ANYHEX[data[pct + 2]]])
    runs = [(_HEXBYTE[data], 32, None), (_B64BYTE[data], B64_LEAST, None)]
    feed = data == 0x0A
    if feed.any():  # base64 runs that go on after line feeds
        blank = _BLANK[data]
        edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        feeds = np.concatenate(([0], np.cumsum(feed)))
        gap = feeds[end] > feeds[start]
        step = np.zeros(len(data) + 1, np.int8)
        step[start[gap]], step[end[gap]] = 1, -1
        at = np.flatnonzero(np.cumsum(step[:-1], dtype=np.int8) == 0)
        runs.append((_B64BYTE[data[at]], B64_LEAST, at))
    for isin, least, at in runs:
        edge = np.flatnonzero(np.diff(isin.view(np.int8), prepend=0, append=0))
        start, end = edge[::2], edge[1::2]
        long_ = end - start >= least
        start, last = start[long_], end[long_] - 1
        if at is not None:
            start, last = at[start], at[last]
        x, y = (np.searchsorted(off, k, side="right") - 1 for k in (start, last))
        hit[x] = True
        # a run across documents is cut there: it counts for each of them
        for k in np.flatnonzero(y > x).tolist():
            hit[x[k] : y[k] + 1] = True
    return hit[:-1]


RESULT = "base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int,path:string>>, n_layers int, n_unopened int"


def _run(schema: pa.Schema, text_col: str, mask: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            base, added, opened, cut = [[] for _ in range(n)], [[] for _ in range(n)], np.zeros(n, np.int32), np.zeros(n, np.int32)
            masked: dict[int, str] = {}
            for i, _, data, off in text_slices(batch.column(text_col)):
                for k in np.flatnonzero(suspects(data, off)).tolist():
                    text = data[off[k] : off[k + 1]].tobytes().decode(errors="replace")
                    base[i + k], added[i + k], opened[i + k], cut[i + k] = scan(text)
                    if mask is not None and (base[i + k] or added[i + k]):
                        masked[i + k] = cover(text, [x[1:3] for x in (*base[i + k], *added[i + k])], mask)
            own = {"base": [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in xs] for xs in base], "added": [[dict(zip(("kind", "start", "end", "path"), x, strict=True)) for x in xs] for xs in added], "n_layers": opened, "n_unopened": cut}
            cols = []
            for f in schema:
                if f.name in own:
                    cols.append(pa.array(own[f.name], f.type))
                elif f.name == text_col and masked:
                    old = batch.column(f.name).to_pylist()
                    cols.append(pa.array([masked.get(k, x) for k, x in enumerate(old)], f.type))
                else:
                    cols.append(batch.column(f.name))
            yield pa.record_batch(cols, schema=schema)

    return run


def cover(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """text with overlapping spans merged and each replaced by mask."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", mask: str | None = None) -> DataFrame:
    """keep, base, added, n_layers, n_unopened for every document; with mask, the kept text has its spans replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(docs.sparkSession)
    cols = list(dict.fromkeys([*keep, text_col]))
    src = docs.select(*cols)
    out = T.StructType([*(f for f in src.schema if f.name in keep), *T.StructType.fromDDL(RESULT)])
    return src.mapInArrow(tidy(_run(to_arrow_schema(out), text_col, mask)), out)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of scan_secrets()."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    order = F.array(*(F.lit(k) for k in KINDS))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    every = F.array_sort(F.concat(plain(F.col("base")), plain(F.col("added"))))
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.col("n_layers").cast("long").alias("n_layers"))
