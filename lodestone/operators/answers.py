"""Answers that survive a failure: a table of what a model said to which prompt, asked in rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.models import LanguageModel, generate
from lodestone.sources.files import read_or_empty

ASKED = "key string, model string, answer string, latency double"
#: Prompts that are asked between two writes: what a lost job can lose.
ROUND = 4096


def prompt_key(prompt: Column, model: LanguageModel) -> Column:
    """What an answer depends on: the model's name and the prompt's text."""
    return F.sha2(F.concat(F.lit(f"{model.name}\n"), prompt), 256)


def ask(prompts: DataFrame, model: LanguageModel, path: str, round_size: int = ROUND) -> int:
    """Asks each distinct prompt (column prompt) that `path` has no answer to and appends the answers, a round at a time; gives how many.
    A round's answers are there once its write has ended; what fails in it loses that round's at most, and the next call asks only the rest.
    Within a round a task that is run again asks its own prompts again."""
    spark = prompts.sparkSession
    todo = prompts.select(prompt_key(F.col("prompt"), model).alias("key"), "prompt").dropDuplicates(["key"])
    left = todo.join(read_or_empty(spark, path, ASKED), "key", "left_anti")
    n = left.count()
    rounds = -(-n // round_size)
    for k in range(rounds):
        own = todo.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k).join(read_or_empty(spark, path, ASKED), "key", "left_anti")
        generate(own, model).select("key", "model", "answer", "latency").write.mode("append").parquet(path)
    return n


def answered(prompts: DataFrame, model: LanguageModel, path: str) -> DataFrame:
    """Adds answer, model and latency to each prompt; of a prompt that two jobs asked at one time, one answer counts."""
    known = read_or_empty(prompts.sparkSession, path, ASKED)
    one = known.groupBy("key").agg(F.min(F.struct("answer", "model", "latency")).alias("_said"))
    x = prompts.withColumn("key", prompt_key(F.col("prompt"), model)).join(one, "key", "left")
    return x.withColumn("answer", F.col("_said.answer")).withColumn("model", F.col("_said.model")).withColumn("latency", F.col("_said.latency")).drop("key", "_said")
