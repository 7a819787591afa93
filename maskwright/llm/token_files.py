"""Token ids in length-delimited binary records, with an offset index beside them.

Documents are range-partitioned by doc_id; every partition becomes one file, in
order. A record is framed as

    length of the payload   uint64, little-endian
    masked CRC of the length  uint32
    payload
    masked CRC of the payload uint32

with payload = doc_id (int64), flags (uint8: bit 0, doc_id is null; bit 1, ids
are uint16 and not uint32), ids, the end id last. The mask rotates a CRC-32
right by 15 bits and adds a constant, so that checksums of data that holds
checksums stay strong. The index (Parquet: file, doc_id, offset, length,
n_tokens) lets a reader fetch any record alone, in any order.

A file is written under a name of its own attempt and then renamed, so retried
or doubled tasks leave one whole file. Files are reached through the file
system of the target's URI, not through local paths.

Encoding: equal results to encoding whole texts, at a fraction of the cost. The
pre-tokenizer cuts a text at white space and between ASCII letters, digits and
symbols, and encodes the pieces alone; so distinct pieces are encoded once by
the tokenizer and reused from a bounded cache. Pieces whose cuts could depend
on more than that (apostrophes, special-token marks, letters beyond Latin-1)
stay whole between spaces and line feeds. A tokenizer file with other rules than
these is not cut up: it encodes whole texts.

Defined cases: a null text is empty and has the end id alone; null doc_ids come
first; ties in doc_id are ordered by text; repeated rows give repeated records.
An empty table gives no files and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, file_system, prepare, scratch_path, text_buffers, text_slices

END_ID = 1
FILE_BYTES = 24 << 20
#: Pieces kept by a worker between batches, in two halves by age.
CACHE = 200_000
#: New pieces encoded together, which bounds what the tokenizer holds at once.
NEW = 8192
_MASK = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_META = struct.Struct("<qB")

_PLAIN = np.arange(256, dtype=np.uint8)
_BETWEEN = np.ones(256, bool)
_BETWEEN[[0x20, 0x0A]] = False
_KIND = np.full(256, 3, np.int8)  # 0 between, 1 letters, 2 digits, 3 symbols
_KIND[[0x20, 0x0A]] = 0
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1
_KIND[0x30:0x3A] = 2


#: Bytes of pieces that are letters in lower case alone: a-z and, behind 0xC3, the lower-case letters of Latin-1.
_LETTERS = bytes([*range(0x61, 0x7B), 0xC3, 0x9F, *(b for b in range(0xA0, 0xC0) if b != 0xB7)])
#: The characters that stand for bytes in a byte-level model, where they are not those of the same code.
_BYTE_LEVEL = {b: chr(256 + k) for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


#: How a tokenizer file normalises and cuts texts for which pieces may be encoded alone (fixed values).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def cuts_as_known(spec: dict) -> bool:
    """Whether a tokenizer file has the rules that PieceEncoder's cuts rest on."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    plain = spec.get("truncation") is None and spec.get("padding") is None and not spec.get("post_processor")
    byte_level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex", True)
    marks = all(t["content"].startswith("<|") for t in spec.get("added_tokens") or [])
    return plain and marks and spec.get("normalizer") == _NORMALIZER and byte_level and steps[0] == _SPLIT


class PieceEncoder:
    """Encodes slices of documents: by pieces, with a tokenizer whose rules cut as the module says, else as whole texts."""

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.uint32 if self.wide else np.uint16
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            self.by_piece = cuts_as_known(json.load(f))
        self.model = self.tokenizer.model
        self.digits: dict[int, bytes] = {}
        if self.by_piece:
            self.digits = {d: np.array(self.tokenizer.encode(chr(d), add_special_tokens=False).ids, self.kind).tobytes() for d in range(0x30, 0x3A)}

    def _encode_whole(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        ids = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.kind) for t in texts]
        return np.concatenate([np.zeros(0, self.kind), *ids]), np.cumsum([0] + [len(x) for x in ids])

    def _encode_together(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces that are encoded together, apart by spaces, taken back by their offsets."""
        texts = [p.decode() for p in pieces]
        got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(got.ids, dtype=self.kind)
        start = np.array([a for a, _ in got.offsets], dtype=np.int64)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        cut = (np.searchsorted(start, begin) * ids.itemsize).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _encode_new(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces.

        A run of letters is one part for the model, which so encodes it without
        the tokenizer's other steps; every digit is a part of its own. Other
        pieces go through the whole tokenizer.
        """
        out, others, tokenize, code = [b""] * len(pieces), [], self.model.tokenize, "I" if self.wide else "H"
        for k, p in enumerate(pieces):
            if not p.translate(None, _LETTERS):
                text = p.decode("latin-1")
                out[k] = array(code, [t.id for t in tokenize(text if p.isascii() else text.translate(_BYTE_LEVEL))]).tobytes()
            elif p.isdigit():
                out[k] = b"".join([self.digits[d] for d in p])
            else:
                others.append(k)
        for a in range(0, len(others), NEW):
            some = others[a : a + NEW]
            for k, ids in zip(some, self._encode_together([pieces[k] for k in some]), strict=True):
                out[k] = ids
        return out

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces, from the cache where it has them."""
        found: list = list(map(self.cache.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if not missing:
            return found
        if len(self.cache) + len(missing) > CACHE // 2:
            self.older, self.cache = self.cache, {}
        new = []
        for k in missing:
            ids = found[k] = self.older.get(words[k])
            if ids is None:
                new.append(k)
        for k, ids in zip(new, self._encode_new([words[k] for k in new]), strict=True):
            found[k] = ids
        self.cache.update((words[k], found[k]) for k in missing)
        return found

    def _pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
        """The pieces of a slice, and the first piece of each document."""
        if not len(data):
            return pa.array([], pa.binary()), np.zeros(len(off), np.int64)
        kind = _KIND[data]
        low = data.copy()
        low[(data >= 0x41) & (data <= 0x5A)] += 32
        prev = np.concatenate(([0], data[:-1])).astype(np.uint8)
        second = (data >= 0x80) & (data < 0xC0)
        latin = second & (prev == 0xC3)
        low[latin & (data <= 0x9E) & (data != 0x97)] += 32
        follows = np.append(second[1:], False)
        odd = (data >= 0x80) & ~(latin & (data != 0x97) & (data != 0xB7)) & ~((data == 0xC3) & follows)
        odd |= (data == 0x27) | ((data == 0x7C) & (prev == 0x3C))
        if odd.any():
            w = Words(data, off, _BETWEEN, _PLAIN)
            # off the pieces' cuts and lower-casing in runs between spaces that hold an odd byte
            bad = np.searchsorted(w.start, np.flatnonzero(odd), side="right") - 1
            for k in np.unique(bad).tolist():
                kind[w.start[k] : w.end[k]] = 4
                low[w.start[k] : w.end[k]] = data[w.start[k] : w.end[k]]
        cut = np.ones(len(data) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
        cut[off] = True
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        on = kind[start] > 0
        start, end = start[on], end[on]
        spans = np.zeros(len(start) + 1, np.int32)
        np.cumsum(end - start, out=spans[1:])
        body = low[kind > 0]
        return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(spans), pa.py_buffer(body)]), np.searchsorted(start, off)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a slice in a row, and where each document begins."""
        if not self.by_piece:
            return self._encode_whole(data, off)
        pieces, first = self._pieces(data, off)
        coded = pieces.dictionary_encode()
        body, spans = text_buffers(coded.dictionary)
        raw, cut = body.tobytes(), spans.tolist()
        words = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        found = self._ids_of(words)
        table = np.frombuffer(b"".join(found), self.kind)
        size = np.array([len(x) for x in found], np.int64) // np.dtype(self.kind).itemsize
        begin = np.cumsum(size) - size
        of = coded.indices.to_numpy(zero_copy_only=False)
        n = size[of]
        ends = np.cumsum(n)
        ids = table[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin[of] - (ends - n), n)] if len(words) else table
        return ids, np.concatenate(([0], ends))[first]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file, with its cache."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def masked_crc(raw: bytes) -> int:
    c = zlib.crc32(raw)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def read_frames(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of a file's records; a wrong checksum or a cut file raises ValueError."""
    at = 0
    while head := stream.read(_HEAD.size):
        if len(head) < _HEAD.size or masked_crc(head[:8]) != _HEAD.unpack(head)[1]:
            raise ValueError(f"damaged record length at byte {at}")
        size = _HEAD.unpack(head)[0]
        payload, tail = stream.read(size), stream.read(4)
        if len(payload) < size or len(tail) < 4 or masked_crc(payload) != struct.unpack("<I", tail)[0]:
            raise ValueError(f"damaged record at byte {at}")
        yield at, payload
        at += _HEAD.size + size + 4


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = _META.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, np.uint16 if flags & 2 else np.uint32, offset=_META.size)


INDEX = "file int, doc_id long, offset long, length long, n_tokens long"


def _write_part(batches: Iterator[pa.RecordBatch], uri: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    tc = TaskContext.get()
    number, enc = tc.partitionId(), encoder(path)
    fs, root = file_system(uri)
    own, flags = f"{root}/.part-{number:06d}-{tc.taskAttemptId()}", 0 if enc.wide else 2
    end, out, at = np.array([end_id], enc.kind).tobytes(), None, 0
    for batch in batches:
        if batch.num_rows and out is None:
            out = fs.open_output_stream(own)
        rows, doc_ids = [], batch.column(0).to_pylist()
        for i, j, data, off in text_slices(batch.column(1)):
            ids, begin = enc.encode(data, off)
            raw, w = ids.tobytes(), ids.itemsize
            cut = (begin * w).tolist()
            for k in range(j - i):
                doc_id = doc_ids[i + k]
                payload = _META.pack(doc_id or 0, flags | (doc_id is None)) + raw[cut[k] : cut[k + 1]] + end
                out.write(record := frame(payload))
                rows.append((at, len(record), (cut[k + 1] - cut[k]) // w + 1))
                at += len(record)
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.record_batch([pa.array([number] * len(rows), pa.int32()), batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["file", "doc_id", "offset", "length", "n_tokens"])
    if out is not None:
        out.close()
        fs.move(own, f"{root}/part-{number:06d}.rec")


def _write(uri: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _write_part(batches, uri, path, end_id)

    return run


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, *, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> None:
    """Writes part-*.rec and the index under uri, in ascending order of doc_id over all files."""
    prepare(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // file_bytes))
    fs, root = file_system(uri)
    fs.create_dir(root, recursive=True)
    placed = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    placed.mapInArrow(_write(uri, tokenizer, end_id), INDEX).write.mode("overwrite").parquet(f"{uri}/index")


def _read_files(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    fs, root = file_system(uri)
    for batch in batches:
        for number, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, start = [], base
            with fs.open_input_stream(f"{root}/part-{number:06d}.rec", buffer_size=1 << 20) as f:
                for _, payload in read_frames(f):
                    doc_id, ids = unpack(payload)
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 5000:
                        yield _rows(rows)
                        rows = []
            yield _rows(rows)


def _read(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _read_files(batches, uri)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read from the files; every checksum is tested."""
    files = spark.read.parquet(f"{uri}/index").groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # one row a file: the running sum over them is a small sort
    base = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))
    n = max(1, files.count())
    return base.repartition(min(n, 10_000)).mapInArrow(_read(uri), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_record(uri: str, file: int, offset: int, length: int) -> tuple[int | None, np.ndarray]:
    """One record by its index entry."""
    fs, root = file_system(uri)
    with fs.open_input_file(f"{root}/part-{file:06d}.rec") as f:
        f.seek(offset)
        import io

        return unpack(next(read_frames(io.BytesIO(f.read(length))))[1])


def round_trip(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID) -> DataFrame:
    """Writes the token files of docs to the shared folder and reads them back."""
    spark = docs.sparkSession
    uri = scratch_path(spark, "token-files")
    write_token_files(docs, uri, tokenizer, end_id=end_id)
    return read_token_files(spark, uri)
