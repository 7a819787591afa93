"""Files as rows: plain files, directory walks, standard input, their texts, and writing a result in one step."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inputs

SCHEMA = "path string, content binary"


def read(spark: SparkSession, roots: Sequence[str], include: Sequence[str] = (), exclude: Sequence[str] = (), hidden: bool = False) -> DataFrame:
    """path and content of every file under the roots (files or folders) that the walk and the globs let pass.

    Globs and hidden names are judged on the path under its root. No roots, or
    empty ones, give an empty table; a root that does not exist raises.
    """
    parts = []
    for root in roots:
        base = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
        at = fs.getFileStatus(base)
        whole = at.getPath().toUri().getPath().rstrip("/")
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        # schemes are written in several ways, so the root is sought by its path alone
        inner = F.substr("path", F.instr("path", whole + "/") + len(whole) + 1) if at.isDirectory() else F.element_at(F.split("path", "/"), -1)
        keep = inputs.selected(inner, include, exclude)
        if at.isDirectory():
            keep &= inputs.walkable(inner, hidden)
        parts.append(df.where(keep).select("path", "content"))
    out = spark.createDataFrame([], SCHEMA)
    for p in parts:
        out = out.unionByName(p)
    return out


def from_stream(spark: SparkSession, stream=None, name: str = "stdin", fmt: str | None = None) -> DataFrame:
    """One row from standard input or another stream of bytes; fmt gives the name the ending that its format is known by."""
    raw = (stream or sys.stdin.buffer).read()
    ending = next((e for e, f in inputs.EXTENSIONS.items() if f == fmt), None)
    return spark.createDataFrame([(f"{name}.{ending}" if ending else name, bytearray(raw))], SCHEMA)


def texts(df: DataFrame, content: str = "content") -> DataFrame:
    """df with text (bytes that are no UTF-8 become the replacement sign) and binary, which tells what should be passed over."""
    return df.withColumn("binary", inputs.looks_binary(F.col(content))).withColumn("text", F.expr(f"make_valid_utf8(cast({content} as string))"))


def entry_passes(archive: Column, entry: Column, filters: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> Column:
    """Whether the filter that a call has bound to an archive lets an entry pass; archives without one let all pass."""
    out = F.lit(True)
    for path, (only, exclude) in filters.items():
        out = F.when((archive == path) | archive.endswith("/" + path.lstrip("./")), inputs.selected(entry, only, exclude, inputs.entry_matches)).otherwise(out)
    return out


def write_whole(spark: SparkSession, uri: str, data: bytes) -> None:
    """Writes a file under a name of its own and then renames it, so a reader sees the old one or the new one."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    own = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}.{uuid.uuid4().hex}")
    try:
        out = fs.create(own, True)
        out.write(bytearray(data))
        out.close()
        fs.setPermission(own, jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
        if fs.exists(path):
            fs.delete(path, False)
        if not fs.rename(own, path):
            raise OSError("the result could not be renamed")
    finally:
        if fs.exists(own):
            fs.delete(own, False)
