"""Plain documents as passages of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import NO_SPACE, SPACE, content_hash
from lodestone.operators import tables


def cut(docs: DataFrame, words: int, key: str = "doc_id") -> DataFrame:
    """record_id, passage_no (from 1), text, n_words and content_hash of each document's passages, beside its other columns (not text).

    Lines follow each other while their words fit; a longer line is cut into runs of `words` words first. Blank lines and runs of white space go,
    so a document without a word gives nothing. key: unique, not null."""
    rest = [c for c in docs.columns if c not in (key, "text")]
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line", "_t")).where(F.col("_t").rlike(NO_SPACE)).select(key, "line", F.filter(F.split("_t", f"{SPACE}+"), lambda w: w != "").alias("_w"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / words).cast("int")), lambda i: F.slice("_w", i * words + 1, F.lit(words)))
    items = lines.select(key, "line", F.posexplode(runs).alias("part", "_r")).select(key, "line", "part", F.array_join("_r", " ").alias("text"), F.size("_r").alias("n"))
    packed = tables.pack(items, key, ["line", "part"], "n", words).repartition(key)  # serves the grouping and the join
    own = packed.groupBy(key, F.col("group_no").alias("passage_no")).agg(F.array_sort(F.collect_list(F.struct("row_no", "text"))).alias("_own"), F.sum("n").alias("n_words"))
    text = F.array_join(F.transform("_own", lambda r: r["text"]), "\n")
    x = own.select(F.format_string("%s:text:%06d", F.col(key).cast("string"), "passage_no").alias("record_id"), key, "passage_no", text.alias("text"), "n_words").withColumn("content_hash", content_hash("text"))
    return x.join(docs.select(key, *rest), key) if rest else x
