"""Answers to a table of questions, each from its nearest documents, with citations.

    python -m jobs.answers --questions Q --vectors V --documents D --target OUT

The funnel of the engine in one batch: nearest vectors, rerank by shared words, first sources, a budgeted prompt, the model. Writes
`prompts` (by language), `asked` (an answer for each model and prompt, ever) and `answers` (by language). `asked` is only
appended to, a round of prompts at a time, and read before a model is called: a run that failed goes on where it was, and a rerun, or one
with more questions, asks only what is new. `prompts` and `answers` are replaced whole, so a rerun gives the same rows.

A question's vector is the one with its number; a document's too. Blank and null questions are left out, a question without a
vector or without a document near it is asked without sources.
"""

from __future__ import annotations

import logging
import os
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions import text as T
from lodestone.operators import answers, models, retrieval

log = logging.getLogger("jobs.answers")


def build_prompts(questions: DataFrame, vectors: DataFrame, documents: DataFrame, budget: int, retrieve: int, rerank: int, sources: int) -> DataFrame:
    """item_id, language, question, prompt, citations, truncated, prompt_chars."""
    asked = questions.where(T.strip("text") != "").select("item_id", T.strip("text").alias("question"))
    v = vectors.select(F.col("vec_id").alias("item_id"), "embedding").join(asked, "item_id", "left_semi")
    near = retrieval.nearest(v, vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), retrieve, "item_id", "doc_id")
    found = near.join(documents.select("doc_id", "text", "source"), "doc_id").join(asked, "item_id")
    best = retrieval.rerank(found, models.lexical_reranker().score(F.col("question"), F.col("text")), rerank, "item_id")
    name = F.col("doc_id").cast("string")
    rows = best.select(
        "item_id", name.alias("record_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("text").alias("content_type"), F.concat(F.coalesce("source", F.lit("document")), F.lit(" "), name).alias("title"),
        F.lit(1).alias("start_page"), F.lit(1).alias("end_page"), F.coalesce("text", F.lit("")).alias("passage"), F.coalesce("text", F.lit("")).alias("section"), F.lit(False).alias("expanded"), "rerank_rank",
    )
    fit = retrieval.budgeted(retrieval.first_distinct(rows, "item_id", retrieval.source_key(), sources), "item_id", budget)
    every = asked.join(fit, "item_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast(f"array<{retrieval.CITED}>")))
    return retrieval.prompts(every).select("item_id", T.language("question").alias("language"), "question", "prompt", "citations", "truncated", "prompt_chars")


def run(spark: SparkSession, questions: str, vectors: str, documents: str, target: str, budget: int = 6000, retrieve: int = 20, rerank: int = 8, sources: int = 4, host: str = "none", model: str = "extractive", llm: models.LanguageModel | None = None) -> dict:
    """Answers all questions; gives the counts of this run. host: of a chat model behind HTTP, or `none` for the offline model."""
    if llm is None:
        llm = models.extractive_model() if host == "none" else models.http_model(Settings({"generation.host": host, "generation.model": model}).generation)
    read, wrote = Observation("prompts"), Observation("answers")
    made = build_prompts(spark.read.parquet(questions), spark.read.parquet(vectors), spark.read.parquet(documents), budget, retrieve, rerank, sources)
    made.observe(read, F.count("*").alias("questions"), F.count_if(F.size("truncated") > 0).alias("cut")).write.mode("overwrite").partitionBy("language").parquet(f"{target}/prompts")
    prompts = spark.read.schema(made.schema).parquet(f"{target}/prompts")
    called = answers.ask(prompts, llm, f"{target}/asked")
    rows = answers.answered(prompts, llm, f"{target}/asked").drop("latency")
    rows.observe(wrote, F.count("*").alias("answers")).write.mode("overwrite").partitionBy("language").parquet(f"{target}/answers")
    total = read.get | {"asked": called} | wrote.get
    log.info("read %s, %s and %s, wrote %s: %s", questions, vectors, documents, target, total)
    return total


def current(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/answers")


if __name__ == "__main__":
    from jobs.command import main

    sys.exit(main("answers", f"{os.path.dirname(__file__)}/answers.json", run))
