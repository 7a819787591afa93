"""A training-data pipeline over documents: quality, near copies, benchmark leaks, secrets, packing.

Every stage takes (spark, docs, sf_dir) and gives the rows that the next one
works on; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontam, jaccard, packing, quality, secrets
from maskwright.llm.common import drop_path, scratch_path, table
from maskwright.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, fitted to the labelled ones among docs, rejects."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of each group linked by 5-word shingles at 0.8."""
    return jaccard.keep_one(docs.select(*COLUMNS), n=5, num=80, den=100)


def remove_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold windows of two items or more; of the others, the spans of single items are cut."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    text = F.col("text")
    kept = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["text"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).alias("text"), s["end"].alias("at")),
        lambda acc: F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.char_length(text))),
    )
    cut = F.when(F.size("spans") > 0, kept).otherwise(text)
    out = found.where("not contaminated").withColumn("cut", cut)
    n_chars = F.when(F.size("spans") > 0, F.char_length("cut").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("cut").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found in the text or in what it encodes is replaced by [SECRET]."""
    found = secrets.scan_secrets(docs, keep=COLUMNS, mask="[SECRET]")
    hit = (F.size("base") > 0) | (F.size("added") > 0)
    n_chars = F.when(hit, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length bucket, batch and slot, by its ids (n_ids); n_tokens are its white-space words."""
    counted = packing.with_ids(docs.withColumn("n_words", packing.n_words()), tokenizer_path("word_bpe_49k.json"), keep=("doc_id", "n_words"))
    packed = packing.pack(counted, length=F.col("n_ids"), keep=("doc_id", "n_words"))
    return packed.withColumnsRenamed({"n_tokens": "n_ids", "n_words": "n_tokens"})


STAGES = [
    ("quality", reject_low_quality),
    ("near_copies", drop_near_copies),
    ("decontaminate", remove_benchmark_text),
    ("secrets", mask_secrets),
    ("packing", pack_batches),
]

#: No stage but the third can be said in SQL as a whole; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again as the next one's docs."""
    docs, read = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(path := scratch_path(spark, name))
            if read is not None:  # the stage before has been read for the last time
                drop_path(spark, read)
            docs, read = spark.read.parquet(path), path
    return docs
