"""From parsed documents to the joint corpus: each step reads what the one before wrote, and can be run alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.errors import CorpusError
from lodestone.functions import text as T
from lodestone.operators import checks, corpus, envelopes, tables, textview
from lodestone.operators.counters import Counter, name_of, words
from lodestone.sources import files
from lodestone.stage import stash


def convert(spark: SparkSession, source: str, target: str, parser) -> None:
    """Documents from files: parser(path, bytes) gives each one's JSON text. There is no PDF parser here; this is where one goes."""
    checks.require_inputs(spark, source)
    rows = files.parse_binary(files.read_binary(spark, source), lambda path, raw: [{"value": parser(path, raw)}], "value string")
    rows.write.mode("overwrite").text(target)


def document(spark: SparkSession, path: str) -> DataFrame:
    """Documents with an id: the slug of their name. A document without a file name is an error."""
    checks.require_inputs(spark, path)
    docs = files.read_document(spark, path, schemas.DOCUMENT)
    if docs.where(T.strip(F.coalesce("origin.filename", F.lit(""))) == "").head(1):
        raise CorpusError(f"a document of {path} doesn't name its file")
    return docs.select(T.slug("name").alias("document_id"), F.col("origin.filename").alias("source_filename"), "texts", "tables", "pictures")


def _pages(prov):
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(prov, F.array().cast("array<struct<page_no:int>>")), lambda p: p["page_no"])))


#: What tells a document's items and tables from another's: refs and table numbers begin anew in each.
BY = ["document_id"]


def items(docs: DataFrame) -> DataFrame:
    """ITEM rows of all documents' texts, with document_id and source_filename."""
    x = docs.select("document_id", "source_filename", F.posexplode("texts").alias("at", "t"))
    return x.select("document_id", "source_filename", F.col("at").cast("long").alias("ordinal"), "t.self_ref", "t.label", "t.text", F.col("t.parent.ref").alias("parent_ref"), _pages(F.transform("t.prov", lambda p: F.struct(p["page_no"].alias("page_no")))).alias("pages"), F.coalesce("t.headings", F.array().cast("array<string>")).alias("headings"))


def inventory(docs: DataFrame, reviews: DataFrame, overrides: DataFrame) -> DataFrame:
    """All documents' tables, decided on. reviews: table_index, reason, note; overrides: table_index, caption; both may have document_id,
    and what has none is meant for each document."""
    x = docs.select("document_id", "source_filename", F.posexplode("tables").alias("table_index", "t"))
    x = x.select(
        "document_id", "source_filename", "table_index", F.format_string("%s:%03d", "document_id", "table_index").alias("table_key"), F.col("t.self_ref").alias("ref"), F.transform("t.captions", lambda c: F.struct(c["ref"].alias("ref"), c["text"].alias("text"))).alias("caption_refs"),
        _pages(F.transform("t.prov", lambda p: F.struct(p["page_no"].alias("page_no")))).alias("pages"), F.transform("t.prov", lambda p: p["bbox"]).alias("boxes"), "t.data.num_rows", "t.data.num_cols", "t.data.orientation",
        F.col("t.data.table_cells").alias("cells"), F.transform("t.data.grid", lambda row: F.transform(row, lambda c: T.collapse(F.coalesce(c["text"], F.lit(""))))).alias("grid"),
    )
    named = tables.captions_of(x, items(docs).select("document_id", "self_ref", "text"), BY).withColumnRenamed("captions", "caption")
    cell_text = F.array_join(F.transform(F.coalesce("cells", F.array().cast(x.schema["cells"].dataType)), lambda c: F.coalesce(c["text"], F.lit(""))), " ")
    reason = tables.toc_reason(cell_text, F.col("num_rows"), F.array_min("pages"), tables.tail_rows(F.col("grid")))
    return tables.decide(named.withColumn("toc_reason", reason), reviews, overrides).withColumnRenamed("caption", "captions")


def review(decided: DataFrame) -> DataFrame:
    """What a human reviews, in the review table's seven columns."""
    return decided.select("ref", "table_index", "pages", "decision", "classification", "review_source", "note").orderBy("document_id", "table_index")


def view(docs: DataFrame, start: int, index_page: int | None = None) -> tuple[DataFrame, dict]:
    """The items of each document's body, and counts by label before and after. index_page: for all documents; else each has its own."""
    all_items = items(docs)
    pages = textview.index_start(all_items, BY).where("page is not null") if index_page is None else None
    refs = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<ref:string,text:string>>")), lambda x: x["ref"])
    owners = [docs.select("document_id", F.explode(c).alias("t")).select("document_id", refs(F.col("t.captions")).alias("captions"), refs(F.col("t.footnotes")).alias("footnotes")) for c in ("tables", "pictures")]
    none = F.array().cast("array<string>")
    roots = docs.select("document_id", F.explode(F.concat(F.coalesce(F.transform("tables", lambda t: t["self_ref"]), none), F.coalesce(F.transform("pictures", lambda t: t["self_ref"]), none))).alias("ref"))
    kept = textview.keep_text(all_items, textview.linked_refs(owners[0].unionByName(owners[1]), BY), start, pages if index_page is None else index_page, textview.subtree(all_items, roots, BY), BY)
    count = lambda df: {r.label: r.n for r in df.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()}  # noqa: E731  one row a label
    first, n = (index_page, None) if index_page is not None else pages.agg(F.min("page"), F.count("*")).first()
    before, after = count(all_items), count(kept)
    return kept, {"start_page": start, "index_page": first, "documents_with_index": n, "items_before": sum(before.values()), "items_after": sum(after.values()), "labels_before": before, "labels_after": after}


def text_records(kept: DataFrame, target: int, limit: int, count: Counter = words) -> DataFrame:
    """Records of the chunks of a text view; items carry the headings above them, which count."""
    checks.require_parameters(target, limit)
    chunks = textview.chunk(kept, "document_id", target, count)
    named = corpus.chapters(kept, BY).select("document_id", "self_ref", "chapter")
    chunks = chunks.withColumn("key", F.format_string("%s:%d", "document_id", "number"))
    chunks = chunks.join(textview.first_chapter(chunks, named, "key", BY), "key", "left").join(kept.select("document_id", "source_filename").distinct(), "document_id")
    chunks = chunks.withColumn("captions", F.array().cast("array<string>")).withColumn("text", textview.contextual(F.col("context"), F.col("text")))
    return envelopes.texts(chunks, name_of(count), target, limit)


def table_rows(decided: DataFrame) -> DataFrame:
    """document_id, table_index, table_key, row_no, values of the rows that are packed of each table that was taken."""
    return _rows(decided.where(F.col("decision") == "include"))[0]


def _rows(taken: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Data rows, all rows, and which rows are headers (table_key, row_no). Rows and headers are used several times, so they are written once."""
    key = "table_key"
    cell = taken.select(key, F.posexplode("cells").alias("ordinal", "c"))
    cells = cell.select(key, "ordinal", F.col("c.start_row_offset_idx").alias("row"), F.col("c.start_col_offset_idx").alias("col"), F.col("c.text").alias("text"))
    rows = stash(tables.matrix(cells, taken.select(key, "num_rows", "num_cols"), key), "table-rows")
    heading = stash(cell.where("c.column_header").select(key, F.col("c.start_row_offset_idx").alias("row_no")).distinct(), "table-heads")
    return tables.data_rows(rows, heading, key), rows, heading


def table_records(decided: DataFrame, target: int, limit: int, count: Counter = words) -> DataFrame:
    """Records of the parts of tables that were taken: whole rows as far as they fit, larger rows in fragments. With another counter than
    words(), which adds up over rows, every group's whole text is counted as it will stand."""
    checks.require_parameters(target, limit)
    key = "table_key"
    taken = decided.where(F.col("decision") == "include")
    data, rows, heading = _rows(taken)
    names = tables.headers(rows, heading, key).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "header"))), lambda h: h["header"]).alias("header"), F.min("fallback").alias("synthetic"))
    per = data.groupBy(key).agg(F.collect_list("values").alias("all"))
    heads = heading.groupBy(key).agg(F.array_sort(F.collect_set("row_no")).alias("header_rows"))
    about = taken.select("document_id", "source_filename", "table_index", key, "ref", "pages", "boxes", "captions", "num_cols").join(names, key).join(heads, key, "left").join(per, key)
    about = about.withColumn("key_value", tables.is_key_value(F.col("all"), F.col("header_rows").isNotNull(), F.col("num_cols"))).drop("all", "num_cols")
    about = about.withColumn("header_rows", F.coalesce("header_rows", F.array().cast("array<int>"))).withColumn("top", T.embedding_text(F.col("captions"), F.col("header"), F.array().cast("array<string>")))
    about = about.withColumn("lead", T.embedding_text(F.col("captions"), F.col("header"), F.array(F.lit(""))))
    x = data.join(about, key).withColumn("text", T.row_text(F.col("row_no"), F.col("values"), F.col("header"), F.col("key_value")))
    tokens = T.counted_by(count)
    x = x.withColumn("size", tokens(F.col("text"))).withColumn("fits", tokens(F.concat("lead", "text")) <= limit)
    whole = x.where("fits").withColumnRenamed("row_no", "row_index")
    packed = tables.pack(whole, key, ["row_index"], "size", target) if count is words else tables.pack_texts(whole, key, ["row_index"], "text", "lead", target, count)
    packed = packed.groupBy(key, "group_no").agg(F.array_sort(F.collect_list(F.struct("row_index", "values", "text"))).alias("own"))
    rows_of = lambda c: F.transform(c, lambda r: F.struct(r["row_index"].alias("row_index"), r["values"].alias("values")))
    packed = packed.select(key, rows_of(F.col("own")).alias("rows"), F.transform("own", lambda r: r["text"]).alias("body"), F.element_at("own", 1)["row_index"].alias("first"), F.lit(0).alias("fragment_no"), F.lit(None).cast("struct<row_index:int,fragment:int,fragments:int>").alias("fragment"))
    large = x.where("not fits").withColumn("prefix", F.concat("top", F.lit("\n\nRow "), F.col("row_no").cast("string"), F.lit(" fragment: ")))
    pieces = tables.fragments(large, key, limit, count).join(large.select(key, "row_no", "values"), [key, "row_no"])
    pieces = pieces.select(key, F.array(F.struct(F.col("row_no").alias("row_index"), "values")).alias("rows"), F.array(F.concat(F.lit("Row "), F.col("row_no").cast("string"), F.lit(" fragment: "), "text")).alias("body"), F.col("row_no").alias("first"), "fragment_no", F.struct(F.col("row_no").alias("row_index"), F.col("fragment_no").alias("fragment"), F.col("n_fragments").alias("fragments")).alias("fragment"))
    parts = packed.unionByName(pieces).join(about, key)
    parts = parts.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("first", "fragment_no")) - 1)
    text = F.when(F.col("fragment").isNull(), T.embedding_text(F.col("captions"), F.col("header"), F.col("body"))).otherwise(F.concat("top", F.lit("\n\n"), F.get("body", F.lit(0))))
    parts = parts.withColumn("text", text).withColumn("token_count", tokens(F.col("text"))).withColumn("markdown", T.table_markdown(F.col("captions"), F.col("header"), F.transform("rows", lambda r: r["values"])))
    return envelopes.table_children(parts, name_of(count), target, limit)


def child_coverage(children: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """packed, expected (key, row_no) and numbers (key, fragment_no) of children's records: what validate_children() compares."""
    key = F.regexp_extract("record_id", "^(.*):child:", 1)
    structure = F.col("content.structured")
    whole = children.where(structure["row_fragment"].isNull()).select(key.alias("key"), F.explode(structure["row_indices"]).alias("row_no"))
    cut = children.where(structure["row_fragment"].isNotNull()).select(key.alias("key"), structure["row_fragment"]["row_index"].alias("row_no"), structure["row_fragment"]["fragment"].alias("fragment_no"))
    expected = table_rows(decided).select(F.regexp_replace("table_key", "^(.*):([0-9]+)$", "$1:table:$2").alias("key"), "row_no")
    return whole.unionByName(cut.select("key", "row_no").distinct()), expected, cut.select(F.concat_ws("#", "key", F.col("row_no").cast("string")).alias("key"), "fragment_no")


def write_texts(records: DataFrame, target: str, limit: int, quarantine: str | None = None) -> dict:
    """Writes text records as JSON lines; each keeps its schema and text_rules(), or the step fails or parts it (quarantine)."""
    return checks.write_checked(records, target, checks.text_rules(limit) | checks.prefixed("schema_", checks.envelope_rules()), "record_id", quarantine, fields=checks.FIELDS)


def write_children(records: DataFrame, decided: DataFrame, target: str, limit: int, quarantine: str | None = None) -> dict:
    """Writes tables' parts as JSON lines; each keeps its schema and holds its rows' pairs, or the step fails or parts it (quarantine); each row is there
    once and fragments follow each other, or the step fails with nothing at the target."""
    own = stash(records, "children")
    checks.validate_coverage(*child_coverage(own, decided))
    fields = {k: checks.FIELDS[k] for k in ("text", "token_count", "pages")}
    return checks.write_checked(own, target, checks.record_rules(limit) | checks.stored_child_rules() | checks.prefixed("schema_", checks.envelope_rules()), "record_id", quarantine, fields=fields)


def write_view(kept: DataFrame, target: str, start: int, index_page: int | None, quarantine: str | None = None) -> dict:
    """Writes the text view's items by document and in order; each keeps view_rules(), or the step fails or parts it (quarantine). Where each
    document has an index page of its own, the filter has used it and no rule repeats it."""
    return checks.write_checked(kept, target, checks.view_rules(start, index_page), "self_ref", quarantine, ["document_id", "ordinal"])


def combine(spark: SparkSession, text_path: str, children_path: str, parents_path: str, target: str, limit: int) -> dict:
    """The joint corpus: texts, then tables' parts, as they were written: file by file, line by line. Nothing is written unless all of it holds."""
    checks.require_inputs(spark, text_path, children_path, parents_path)
    both = [files.lines(spark, p).where(T.strip("value") != "") for p in (text_path, children_path)]
    read = [files.read_lines(spark, p, schemas.ENVELOPE, True) for p in (text_path, children_path)]
    got = checks.validate_combined(read[0].unionByName(read[1]), files.read_lines(spark, parents_path, schemas.ENVELOPE, True), limit)
    corpus.ordered_union(*both).orderBy("src_rank", "file", "line").select("value").write.mode("overwrite").text(target)
    return got
