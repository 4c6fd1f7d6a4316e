"""Passages of documents, kept up as files arrive: a stream over a folder of documents.

    python -m jobs.passages --source DOCUMENTS --target OUT --checkpoint MARK

Each run takes the files that the checkpoint has not seen, cuts their documents into passages, and ends. A micro-batch writes
`passages/batch=N/lang=L` and `rejected/batch=N/reason=R` and replaces what an attempt before it wrote there, so a batch that is
run again gives the same files. A document that comes again in a later batch replaces its passages: `current()` reads the last
version of each, and a version that was rejected leaves none. A folder can't show what is gone.

Of rows with one doc_id in a batch one counts (the greatest by its values). Rejected are rows without doc_id (`no_id`) and those without a word
(`no_words`). A null language is `und`.
"""

from __future__ import annotations

import logging
import os
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import corpus, passages
from lodestone.sources.files import read_or_empty
from lodestone.stage import stash

log = logging.getLogger("jobs.passages")

DOCUMENT = "doc_id long, text string, lang string, source string"
PASSAGE = "record_id string, doc_id long, source string, passage_no int, text string, n_words long, content_hash string, lang string, batch long"
REJECTED = "doc_id long, text string, lang string, source string, reason string, batch long"


def faulty() -> F.Column:
    """Why a document gives no passage, or null."""
    return F.when(F.col("doc_id").isNull(), "no_id").when(~F.coalesce(F.col("text").rlike(T.NO_SPACE), F.lit(False)), "no_words")


def write_batch(batch: DataFrame, number: int, target: str, words: int) -> dict:
    """One micro-batch's folders, whole; gives what was read and written."""
    rows = batch.select("doc_id", "text", F.coalesce("lang", F.lit("und")).alias("lang"), "source").withColumn("reason", faulty())
    good, bad = Observation(f"passages-{number}"), Observation(f"rejected-{number}")
    docs = corpus.unique(rows.where("reason is null").drop("reason"), "doc_id")
    cut = passages.cut(docs, words).select(*(c for c in PASSAGE.replace(",", "").split()[::2] if c != "batch"))
    cut.observe(good, F.count("*").alias("passages"), F.count_if(F.col("passage_no") == 1).alias("documents"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).write.mode("overwrite").partitionBy("lang").parquet(f"{target}/passages/batch={number}")
    rows.where("reason is not null").observe(bad, F.count("*").alias("rejected")).write.mode("overwrite").partitionBy("reason").parquet(f"{target}/rejected/batch={number}")
    return good.get | bad.get


def current(spark: SparkSession, target: str) -> DataFrame:
    """The passages of each document's last version, without a batch number."""
    kept, gone = read_or_empty(spark, f"{target}/passages", PASSAGE), read_or_empty(spark, f"{target}/rejected", REJECTED)
    versions = kept.select("doc_id", "batch").unionByName(gone.where("doc_id is not null").select("doc_id", "batch"))
    last = versions.groupBy("doc_id").agg(F.min("batch").alias("_first"), F.max("batch").alias("_last")).where("_first < _last")
    last = stash(last, "newer-versions")  # often few or none: then the join moves no passage
    newer = (F.col("doc_id") == F.col("_id")) & (F.col("batch") < F.col("_last"))
    return kept.join(last.select(F.col("doc_id").alias("_id"), "_last"), newer, "left_anti").drop("batch")


def run(spark: SparkSession, source: str, target: str, checkpoint: str, words: int = 120, files: int = 1000) -> dict:
    """Takes what is new in `source` (a folder of Parquet files of documents, or a pattern of paths) and ends; gives the counts of this run."""
    total = {"batches": 0, "documents": 0, "passages": 0, "words": 0, "rejected": 0}

    def put(batch: DataFrame, number: int) -> None:
        got = write_batch(batch, number, target, words)
        log.info("batch %d: %s", number, got)
        total["batches"] += 1
        for k, n in got.items():
            total[k] += n

    stream = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("read %s, wrote %s: %s", source, target, total)
    return total


if __name__ == "__main__":
    from jobs.command import main

    sys.exit(main("passages", f"{os.path.dirname(__file__)}/passages.json", run))
