"""Stored records: what a chunk of text, a table, or a part of a table is kept as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import text as T

NONE = "struct<num_rows:int,num_cols:int,orientation:string>"


def structured_cell(c: Column) -> Column:
    """A cell's text at single blanks, its place, what it heads, and its box if it has one."""
    kept = [n for n in schemas.CELL_FIELDS if n != "text"]
    return F.struct(T.collapse(F.coalesce(c["text"], F.lit(""))).alias("text"), *(c[n].alias(n) for n in kept), c["bbox"].alias("bbox"))


def structured(num_rows: Column, num_cols: Column, orientation: Column, cells: Column) -> Column:
    """A table's structure; a table without cells has an empty list."""
    own = F.transform(cells, structured_cell)
    return F.struct(num_rows.alias("num_rows"), num_cols.alias("num_cols"), orientation.alias("orientation"), F.when(cells.isNull(), F.slice(own, 1, 0)).otherwise(own).alias("cells"))


def _record(df: DataFrame, record_id: Column, parent_id: Column, kind: str, locators: Column, content: Column, metadata: Column) -> DataFrame:
    source = F.struct("document_id", "source_filename", "pages", locators.alias("locators"))
    return df.select(F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), record_id.alias("record_id"), parent_id.alias("parent_id"), F.lit(kind).alias("content_type"), source.alias("source"), content.alias("content"), metadata.alias("metadata"))


def texts(chunks: DataFrame, tokenizer: str, target: int, limit: int) -> DataFrame:
    """Records of text chunks. chunks: document_id, source_filename, number, headings, captions, chapter, refs, pages, text, token_count.
    Refs stay in the order of their first place; pages are sorted."""
    metadata = F.struct(
        textual("headings").alias("headings"), F.col("chapter").alias("chapter"), textual("captions").alias("captions"), F.lit(tokenizer).alias("tokenizer_name"),
        F.lit(target).alias("chunk_target_tokens"), F.lit(limit).alias("chunk_max_tokens"), F.lit(0).alias("chunk_overlap"), F.col("token_count").cast("int").alias("token_count"),
    )
    own = chunks.withColumn("pages", F.array_sort(F.array_distinct("pages")))
    content = F.struct(F.col("text").alias("text"), F.lit(None).cast("string").alias("markdown"), F.lit(None).cast(NONE).alias("structured"))
    return _record(own, F.format_string("%s:text:%06d", "document_id", F.col("number").cast("long")), F.lit(None).cast("string"), "text", F.struct(F.array_distinct("refs").alias("refs")), content, metadata)


def textual(values: str) -> Column:
    """Values that aren't blank, stripped."""
    return F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: T.strip(v) != ""), lambda v: T.strip(v))


def table_parents(tables: DataFrame) -> DataFrame:
    """Records of the tables that were taken. tables: document_id, source_filename, table_index, ref, pages, boxes, captions, num_rows,
    num_cols, orientation, cells, grid (array of rows of texts), decision, review_source."""
    taken = tables.where(F.col("decision") == "include")
    content = F.struct(T.grid_text(F.col("grid")).alias("text"), T.grid_markdown(F.col("grid")).alias("markdown"), structured(F.col("num_rows"), F.col("num_cols"), F.col("orientation"), F.col("cells")).alias("structured"))
    metadata = F.struct(F.col("captions").alias("caption"), "num_rows", "num_cols", F.lit("accepted").alias("review_status"), "review_source", F.col("table_index").alias("table_index"))
    record_id = F.format_string("%s:table:%03d:parent:000", "document_id", F.col("table_index").cast("long"))
    return _record(taken, record_id, F.lit(None).cast("string"), "table_parent", F.struct(F.col("ref").alias("ref"), "table_index", F.col("boxes").alias("bounding_boxes")), content, metadata)


def table_children(parts: DataFrame, tokenizer: str, target: int, limit: int) -> DataFrame:
    """Records of tables' parts. parts: document_id, source_filename, table_index, number, ref, pages, boxes, captions, header, header_rows,
    synthetic, key_value, rows (array<struct<row_index, values>>), text, markdown, token_count, fragment (struct or null)."""
    index = F.transform("rows", lambda r: r["row_index"])
    content = F.struct(
        F.col("text").alias("text"), F.col("markdown").alias("markdown"),
        F.struct(F.col("header_rows").alias("header_row_indices"), F.col("header").alias("header"), index.alias("row_indices"), F.col("rows").alias("rows"), F.col("fragment").alias("row_fragment")).alias("structured"),
    )
    metadata = F.struct(
        F.col("captions").alias("caption"), F.col("table_index").alias("table_index"), F.lit(True).alias("header_repeated"), F.col("synthetic").alias("synthetic_header"), F.lit(tokenizer).alias("tokenizer_name"),
        F.lit(target).alias("chunk_target_tokens"), F.lit(limit).alias("chunk_max_tokens"), F.lit(0).alias("chunk_overlap"), F.col("token_count").cast("int").alias("token_count"),
        F.col("fragment").isNotNull().alias("row_fragmented"), F.when(F.col("key_value"), "key_value_v1").otherwise("attribute_value_v1").alias("embedding_serialization"),
    )
    number = F.col("table_index").cast("long")
    return _record(
        parts, F.format_string("%s:table:%03d:child:%03d", F.col("document_id"), number, F.col("number").cast("long")), F.format_string("%s:table:%03d:parent:000", "document_id", number), "table_child",
        F.struct(F.col("ref").alias("ref"), "table_index", F.col("boxes").alias("bounding_boxes"), index.alias("row_indices")), content, metadata,
    )
