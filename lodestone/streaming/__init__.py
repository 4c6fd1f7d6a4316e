"""Streaming faces: records that keep an index in step, questions that are answered as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.index import VectorIndex
from lodestone.operators.models import Embedder
from lodestone.functions.text import content_hash
from lodestone.operators.corpus import unique


def sync_stream(records: DataFrame, index: VectorIndex, embedder: Embedder, checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch of records, of one id the last by `ordinal` (else the greatest by its values, which no order of arrival changes); a stream of files can't
    show what is gone. A batch that is run again after a failure upserts the same rows."""
    from pyspark.sql import functions as F

    def put(batch: DataFrame, _: int) -> None:
        last = unique(batch, "record_id").withColumn("content_hash", content_hash("text"))
        rows = last.withColumn("start_page", F.array_min("pages")).withColumn("end_page", F.array_max("pages")).withColumn("embedding", embedder.documents(F.col("text")))
        if not index.exists():
            index.put(rows, {"embedding_model": embedder.name, "embedding_dimension": embedder.dimension, "embedding_fingerprint": embedder.fingerprint}, last.count())
        else:
            index.upsert(rows)

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer_stream(questions: DataFrame, engine, target: str, checkpoint: str, asked: str | None = None) -> StreamingQuery:
    """Answers each micro-batch of questions; they know nothing of each other. asked: where answers are kept by prompt, so that a batch which is run
    again after a failure asks only what is unanswered."""

    def run(batch: DataFrame, number: int) -> None:
        engine.answer(batch, asked).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
