"""Sources and sinks: JSON lines, whole JSON documents, binary files, review tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.errors import CorpusError
from lodestone.functions.text import strip


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, blank lines count), value of text files.

    A split's lines stand together in one task, so a line's place in it is how many ids it is past the split's first; the counts of the splits
    before it, by file and offset, are added. The second scan reads no values, and its result is a row a split."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    return raw.join(splits.withColumn("before", before), ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def read_lines(spark: SparkSession, path: str, schema: str, ordinal: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line is an error that shows its file and text. ordinal: adds a column that rises with the place
    of a line among all files' lines (file, line), and the error names the line's number."""
    own = lines(spark, path).select("value", F.struct("file", "line").alias("ordinal")) if ordinal else spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    row = own.where(strip("value") != "").select("*", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    # A line that is no JSON fails the scan where it is read; no second pass looks for it.
    place = F.concat(F.col("ordinal.file"), F.lit(":"), F.col("ordinal.line").cast("string")) if ordinal else F.col("_file")
    checked = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), F.raise_error(F.concat(F.lit("bad JSON line: "), place, F.lit(": "), F.left("value", F.lit(200)))).cast("boolean")).otherwise(F.lit(True))
    return row.where(checked).select("r.*", *(["ordinal"] if ordinal else [])).drop("_bad")


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; null fields are kept, other than ASCII characters too."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files, one JSON value each; `$ref` reads as `ref`. A file that is no JSON is an error."""
    own = spark.read.text(path, wholetext=True).select(F.replace("value", F.lit('"$ref"'), F.lit('"ref"')).alias("value"))
    return own.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of files, for parsers that run in mapInPandas."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def parse_binary(files: DataFrame, parser, schema: str) -> DataFrame:
    """Applies parser(path, bytes) -> rows (dicts) to each file in the workers: the place for a PDF parser."""

    def run(frames):
        import pandas as pd

        names = [f.split()[0] for f in schema.split(",")]
        for pdf in frames:
            rows = [r for p, b in zip(pdf["path"], pdf["content"]) for r in parser(p, bytes(b))]
            if rows:
                yield pd.DataFrame(rows)[names]

    return files.mapInPandas(run, schema)


def digest(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def write_review(df: DataFrame, path: str) -> None:
    """The review table as CSV with a byte-order mark: pages joined by ';', nulls as empty fields. Human-made, so one file."""
    shown = df.select(*(F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes))
    shown.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]).coalesce(1).write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """table_index, reason, note, and document_id where the file has it, from CSV with a header."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*(["document_id"] if "document_id" in raw.columns else []), F.col("table_index").cast("int").alias("table_index"), "reason", "note")


def write_each(df: DataFrame, path: str, name: Column, **values: Column) -> None:
    """For each record a folder named by its id with ':' as '_'; in it the record as JSON and, for each of `values`, a text."""
    own = df.select(F.translate(name, ":", "_").alias("name"), F.struct(F.lit("json").alias("kind"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).alias("json"), *(F.struct(F.lit(k).alias("kind"), v.alias("value")).alias(k) for k, v in values.items()))
    own.select("name", F.explode(F.array("json", *values)).alias("x")).select("name", "x.kind", "x.value").write.partitionBy("name", "kind").text(path)


def report(df: DataFrame) -> dict:
    """A one-row table of figures as a dict."""
    return df.first().asDict(recursive=True)


def write_report(figures: DataFrame | dict, spark: SparkSession, path: str) -> dict:
    """Figures (a dict or a one-row table) as indented JSON, in a folder that any store can hold."""
    got = figures if isinstance(figures, dict) else report(figures)
    spark.createDataFrame([(json.dumps(got, ensure_ascii=False, indent=2, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return got


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table by its schema, partition columns included; a missing folder is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """document_id, table_index, caption from JSON objects of texts by `index` (any document) or `document:index`; a missing file is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "document_id string, table_index int, caption array<string>")
    pairs = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")))
    return pairs.select(F.nullif(F.regexp_extract("key", "^(.*):[^:]*$", 1), F.lit("")).alias("document_id"), F.regexp_extract("key", "([^:]*)$", 1).cast("int").alias("table_index"), F.col("value").alias("caption"))


def _place(raw: DataFrame) -> list[str]:
    return ["ordinal"] if "ordinal" in raw.columns else []


def records(raw: DataFrame) -> DataFrame:
    """Stored records -> retrieval units: empty parent ids become null, pages sorted, titles by type."""
    from lodestone.functions.text import table_title, text_title

    m, s = (lambda f: F.col(f"metadata.{f}")), (lambda f: F.col(f"source.{f}"))
    empty = F.array().cast("array<string>")
    title = F.when(F.col("content_type") == "text", text_title(F.coalesce(m("headings"), empty), m("chapter"))).otherwise(table_title(F.coalesce(m("caption"), empty), m("table_index")))
    return raw.select(
        "record_id", F.nullif(F.col("parent_id"), F.lit("")).alias("parent_id"), "content_type", s("document_id").alias("document_id"), title.alias("title"),
        F.array_sort(s("pages")).alias("pages"), F.col("content.text").alias("text"), F.coalesce(m("token_count"), F.lit(0)).alias("token_count"), *_place(raw),
    )


def parents(raw: DataFrame) -> DataFrame:
    """Stored table parents -> parents: text is the Markdown, unless it is null or empty."""
    from lodestone.functions.text import table_title

    rows = raw.where(F.col("content_type") == "table_parent")
    title = table_title(F.coalesce(F.col("metadata.caption"), F.array().cast("array<string>")), F.col("metadata.table_index"))
    return rows.select(
        "record_id", F.col("source.document_id").alias("document_id"), title.alias("title"), F.array_sort("source.pages").alias("pages"),
        F.coalesce(F.nullif(F.col("content.markdown"), F.lit("")), F.col("content.text")).alias("text"), F.col("metadata.num_rows").alias("num_rows"), F.col("metadata.num_cols").alias("num_cols"), *_place(raw),
    )


def load_corpus(spark: SparkSession, records_path: str, parents_path: str) -> tuple[DataFrame, DataFrame]:
    """Checked records and parents, each once (of one id the last): at least one record, no child without its parent."""
    from lodestone.operators.corpus import last_of, orphans

    r, p = records(read_lines(spark, records_path, schemas.ENVELOPE, True)), parents(read_lines(spark, parents_path, schemas.ENVELOPE, True))
    if not r.head(1):
        raise CorpusError(f"no records in {records_path}")
    if found := orphans(r, p).orderBy("record_id").limit(5).collect():
        raise CorpusError("; ".join(f"{x.record_id} has no parent {x.parent_id}" for x in found))
    return last_of(r, "record_id"), last_of(p, "record_id")
