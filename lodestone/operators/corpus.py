"""Records and parents: lookups, links, counts, unions and identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import content_hash
from lodestone.stage import numbered, stash


def last_of(df: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """Of rows with one key the last by ordinal: what a lookup keeps. Combined before the shuffle."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, ordinal).alias("_row")).select("_row.*")


def lookup(df: DataFrame, key: str) -> DataFrame:
    """One row for each key, for the side of a join that must not multiply rows: the last by `ordinal` where there is one, else the
    greatest by its scalar columns."""
    if "ordinal" in df.columns:
        return last_of(df, key)
    plain = [c for c, kind in df.dtypes if not kind.startswith("map")]
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*plain)).alias("_row")).select("_row.*")


def unique(df: DataFrame, key: str) -> DataFrame:
    """lookup() where few rows share a key: those that do are found by a count of keys alone and gathered, all others stay where they are. Runs a job;
    the shared keys are written, so a join with few of them moves no row."""
    shared = stash(df.groupBy(key).count().where("count > 1").select(F.col(key).alias("_shared")), "shared-keys")
    if not shared.head(1):
        return df
    same = F.col(key).eqNullSafe(F.col("_shared"))
    return df.join(shared, same, "left_anti").unionByName(lookup(df.join(shared, same, "left_semi"), key))


def orphans(children: DataFrame, parents: DataFrame, parent_key: str = "record_id") -> DataFrame:
    """Table children whose parent is missing, a null parent included."""
    ids = parents.select(F.col(parent_key).alias("_parent"))
    kids = children.where(F.col("content_type") == "table_child")
    return kids.join(ids, kids["parent_id"] == ids["_parent"], "left_anti").select("record_id", "parent_id")


def counts(records: DataFrame, by: str = "content_type") -> DataFrame:
    """Rows by type, and in all (type null), in one pass."""
    return records.rollup(by).agg(F.count("*").alias("n"))


def type_counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(F.col("content_type") == "text").alias("text"), F.count_if(F.col("content_type") == "table_child").alias("table_child"), F.count("*").alias("total"))


def accepted(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the chosen ones; a key that is chosen twice multiplies nothing."""
    return df.join(chosen.select(key), key, "left_semi")


def token_stats(chunks: DataFrame, limit: int) -> DataFrame:
    """min_tokens, max_tokens and over_limit, one row. A missing count is over the limit, as everywhere."""
    n = F.col("token_count")
    return chunks.agg(F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.count_if(F.coalesce(n, F.lit(limit + 1)) > limit).alias("over_limit"))


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """How many rows repeat a key: grouped by key, so no task holds a key twice or all keys."""
    return df.groupBy(key).count().agg((F.coalesce(F.sum("count"), F.lit(0)) - F.count("*")).alias("n_duplicates"))


def single_value(df: DataFrame, column: str) -> DataFrame:
    """n_values, n_null, ok: one value and no null is wanted."""
    values = df.groupBy(column).count()
    x = values.agg(F.count_if(F.col(column).isNotNull()).alias("n_values"), F.coalesce(F.sum(F.when(F.col(column).isNull(), F.col("count"))), F.lit(0)).alias("n_null"))
    return x.withColumn("ok", (F.col("n_values") == 1) & (F.col("n_null") == 0))


def ordered_union(*frames: DataFrame) -> DataFrame:
    """UNION ALL that keeps each frame's `ordinal` order, one frame after the other: adds src_rank."""
    out = None
    for k, df in enumerate(frames):
        x = df.withColumn("src_rank", F.lit(k))
        out = x if out is None else out.unionByName(x)
    return out


def with_ids(df: DataFrame, kind: str | Column, *order: str, by: Sequence[str] = ("document_id",), digits: int = 6, start: int = 0) -> DataFrame:
    """record_id `document:kind:000001` and number in an order by values within `by`; numbers are prefix sums, so a document may be any size."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return numbered(df, list(by), list(order), "number", start).withColumn("record_id", F.format_string(f"%s:%s:%0{digits}d", "document_id", kind, "number"))


def spans(df: DataFrame, pages: str = "pages") -> DataFrame:
    return df.withColumn("start_page", F.array_min(pages)).withColumn("end_page", F.array_max(pages))


def flat_metadata(records: DataFrame) -> DataFrame:
    """record_id, document and scalar metadata, as a vector store keeps them."""
    return spans(records).select(
        "record_id", "text", content_hash("text").alias("content_hash"), F.coalesce("parent_id", F.lit("")).alias("parent_id"), "content_type", "document_id", "title",
        "start_page", "end_page", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "token_count",
    )


def chapters(items: DataFrame, by: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Each item's chapter. Unnumbered section headers are pending chapters; a header that starts with
    "1. Introduction" makes the pending one the chapter; before that the first unnumbered header is."""
    from lodestone.functions.text import NUMBERED, strip

    t = strip(F.coalesce("text", F.lit("")))
    header = (F.col("label") == "section_header") & (t != "")
    numbered = t.rlike(NUMBERED)
    upto = Window.partitionBy(*by).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, 0)
    x = items.withColumn("_free", F.when(header & ~numbered, t)).withColumn("_pending", F.last("_free", True).over(upto)).withColumn("_new", F.when(header & numbered & t.startswith("1. Introduction"), F.col("_pending")))
    chapter = F.coalesce(F.last("_new", True).over(upto), F.first("_free", True).over(upto), F.lit(""))
    return x.withColumn("chapter", chapter).drop("_free", "_pending", "_new")


def index_problems(state: DataFrame) -> DataFrame:
    """state: vector_count, corpus_count, model, fingerprint, dimension, expected_model, expected_fingerprint, one row
    a case. Adds `problems`; an empty index is the only problem it has."""
    c = F.col
    differs = lambda a, b, what: F.when(c(a).isNull() | (c(a) == ""), F.lit(f"no {what} stored")).when(c(a) != c(b), F.lit(f"other {what}"))
    found = F.array(
        F.when(c("corpus_count").isNotNull() & (c("vector_count") != c("corpus_count")), F.lit("counts differ")), differs("model", "expected_model", "model"),
        differs("fingerprint", "expected_fingerprint", "fingerprint"), F.when(c("dimension").isNull() | (c("dimension") <= 0), F.lit("bad dimension")),
    )
    return state.withColumn("problems", F.when(c("vector_count") <= 0, F.array(F.lit("no vectors"))).otherwise(F.array_compact(found)))
