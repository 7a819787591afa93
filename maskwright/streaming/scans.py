"""The scans over streams: every row is replaced on its own, and findings are counted in event-time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.replace import DEMO_KEY
from ..operators import scan
from ..rules import Rule


def read_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """value of every line of the text files that arrive under a path."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def redact_stream(stream: DataFrame, text: str, rules: Sequence[Rule], key: bytes = DEMO_KEY, allowed: Column | None = None) -> DataFrame:
    """The stream with sanitized and n_matches in place of the text; it keeps no state. A null text gives the empty one."""
    out = scan.redact(stream, text, rules, key, allowed)
    return out.withColumn("n_matches", F.size("matches").cast("long")).drop(text, "matches")


def count_stream(stream: DataFrame, text: str, at: str, rules: Sequence[Rule], window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """from, to, pattern and matches for each window of event time; rows later than the watermark are left out."""
    labels = F.array(*(F.lit(r.label) for r in rules))
    found = scan.with_matches(stream.withWatermark(at, late), text, rules).select(at, F.explode("matches").alias("m"))
    by = found.groupBy(F.window(at, window).alias("w"), F.element_at(labels, F.col("m.rule") + 1).alias("pattern")).agg(F.count("*").alias("matches"))
    return by.select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "pattern", "matches")


def write(stream: DataFrame, path: str, checkpoint: str, now: bool = True) -> StreamingQuery:
    """Appends the stream to Parquet files; with now, all that is there and then stops. The checkpoint must be on shared storage."""
    out = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if now else out).start()
