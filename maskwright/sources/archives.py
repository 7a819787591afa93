"""Archives as rows: their entries, and archives made anew from entries whose contents were changed.

An archive comes as one binary value, so Spark's own bound on a value bounds
the work on one. Entries that are archives themselves are opened too, down to
a depth; their entries' names follow the archive's name after a ``!``.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.textutil import safe_entry_name

DEPTH, MAX_DEPTH = 5, 10
#: Contents longer than this when unpacked are an error, not a cut.
MAX_BYTES = 1 << 30
NEST = "!"
SCHEMA = "entry string, depth int, seq int, kind string, content binary, mtime long, mode int"


class TooDeep(ValueError):
    """Archives nested deeper than allowed."""


def kind_of(name: str) -> str | None:
    low = name.lower()
    if low.endswith((".tar.gz", ".tgz")):
        return "tar.gz"
    return next((k for k in ("tar", "zip", "gz") if low.endswith("." + k)), None)


def _bounded(stream, what: str, limit: int) -> bytes:
    out = stream.read(limit + 1)
    if len(out) > limit:
        raise ValueError(f"{what}: longer than {limit} bytes when unpacked")
    return out


def members(content: bytes, kind: str, name: str, limit: int = MAX_BYTES) -> Iterator[tuple[str, bytes, int, int]]:
    """name, content, time and mode of each file, in the archive's order; other entries are left out."""
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    with z.open(i) as f:
                        yield i.filename, _bounded(f, i.filename, limit), int(pd.Timestamp(*i.date_time).timestamp()), (i.external_attr >> 16) & 0o7777
    elif kind == "gz":
        with gzip.open(io.BytesIO(content)) as f:
            yield name.rsplit("/", 1)[-1][:-3], _bounded(f, name, limit), 0, 0
    else:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz" if kind == "tar.gz" else "r:") as t:
            for m in t:
                if m.isfile():
                    yield m.name, _bounded(t.extractfile(m), m.name, limit), int(m.mtime), m.mode


def walk(content: bytes, kind: str, name: str, depth: int, prefix: str = "", level: int = 1) -> Iterator[tuple]:
    """Rows of every file, nested archives opened; one that is not what its name says is a file."""
    for inner, data, mtime, mode in members(content, kind, name):
        deeper = kind_of(inner)
        if deeper is not None:
            if level >= depth:
                raise TooDeep(f"archives are nested deeper than {depth}")
            try:
                yield from list(walk(data, deeper, inner, depth, prefix + inner + NEST, level + 1))
                continue
            except (tarfile.TarError, zipfile.BadZipFile, gzip.BadGzipFile, EOFError):
                pass
        yield prefix + inner, level, mtime, mode, data


def entries(df: DataFrame, path: str = "path", content: str = "content", depth: int = DEPTH) -> DataFrame:
    """archive, entry, safe_entry, depth, seq (place in the archive), kind, content, mtime and mode of every file.

    Nulls in either column, and paths that do not end like an archive, give
    no rows. An archive that cannot be read gives one row, of kind broken,
    with its whole content. Nesting beyond depth (at most 10) raises.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be from 1 to {MAX_DEPTH}")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["archive", "entry", "depth", "seq", "kind", "content", "mtime", "mode"]
        for batch in batches:
            for archive, raw in zip(batch["archive"], batch["content"], strict=True):
                kind = kind_of(archive or "")
                if kind is None or raw is None:
                    continue
                raw = bytes(raw)
                try:
                    rows = [(archive, e, d, k, kind, data, t, m) for k, (e, d, t, m, data) in enumerate(walk(raw, kind, archive, depth))]
                except (tarfile.TarError, zipfile.BadZipFile, gzip.BadGzipFile, EOFError):
                    rows = [(archive, "", 0, 0, "broken", raw, 0, 0)]
                yield pd.DataFrame(rows, columns=names)

    plain = df.select(F.col(path).alias("archive"), F.col(content).alias("content"))
    out = plain.mapInPandas(unpack, f"archive string, {SCHEMA}")
    return out.select("archive", "entry", F.array_join(F.transform(F.split("entry", NEST), safe_entry_name), NEST).alias("safe_entry"), "depth", "seq", "kind", "content", "mtime", "mode")


def _pack(kind: str, rows: list[tuple[str, bytes, int, int]]) -> bytes:
    """An archive of (name, content, time, mode); entries of one nested archive, which stand together, are packed first."""
    flat: list[tuple[str, bytes, int, int]] = []
    k = 0
    while k < len(rows):
        head, nested, _ = rows[k][0].partition(NEST)
        if not nested:
            flat.append(rows[k])
            k += 1
            continue
        group = []
        while k < len(rows) and rows[k][0].startswith(head + NEST):
            group.append((rows[k][0][len(head) + 1 :], *rows[k][1:]))
            k += 1
        flat.append((head, _pack(kind_of(head) or "zip", group), group[0][2], 0o644))
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data, mtime, mode in flat:
                stamp = pd.Timestamp(max(mtime, 315532800), unit="s")
                info = zipfile.ZipInfo(name, stamp.timetuple()[:6])
                info.external_attr, info.compress_type = mode << 16, zipfile.ZIP_DEFLATED
                z.writestr(info, data)
    elif kind == "gz":
        with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as g:
            g.write(flat[0][1])
    else:
        with tarfile.open(fileobj=out, mode="w:gz" if kind == "tar.gz" else "w") as t:
            for name, data, mtime, mode in flat:
                info = tarfile.TarInfo(name)
                info.size, info.mtime, info.mode = len(data), mtime, mode
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def rebuild(changed: DataFrame) -> DataFrame:
    """archive and content: archives of the same kinds from rows of entries, in their order; broken ones as they were.

    One task holds one archive, which was a single value before, too.
    """

    def make(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("seq")
        kind = g["kind"].iloc[0]
        rows = [(e, bytes(c), int(t), int(m)) for e, c, t, m in zip(g["entry"], g["content"], g["mtime"], g["mode"], strict=True)]
        return pd.DataFrame({"archive": [g["archive"].iloc[0]], "content": [rows[0][1] if kind == "broken" else _pack(kind, rows)]})

    return changed.select("archive", "entry", "seq", "kind", "content", "mtime", "mode").groupBy("archive").applyInPandas(make, "archive string, content binary")
