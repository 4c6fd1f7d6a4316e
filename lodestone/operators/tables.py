"""Tables: classification, headers, matrices, row packing, serialisation."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import collapse, strip
from lodestone.operators.counters import Counter, longest, words

FAR = 1_000_000_000


def toc_reason(text: Column, num_rows: Column, page: Column, tails: Column) -> Column:
    """Why a table is navigation, or null. page: its first (null: far away); tails: rows that end in a number."""
    plain, near = F.lower(collapse(text)), (F.coalesce(page, F.lit(FAR)) <= 20) & (num_rows >= 20)
    leaders = F.regexp_count(text, F.lit("[_.]"))
    return F.when(plain.contains("contents") & (num_rows >= 10), "contents").when(near & (leaders >= 40) & (tails >= 5), "navigational_list").when(near & plain.startswith("figure") & (tails >= 5), "list_of_figures")


def tail_rows(grid: Column) -> Column:
    """Rows of two cells at least whose last is all digits."""
    return F.size(F.filter(grid, lambda r: (F.size(r) >= 2) & collapse(F.element_at(r, -1)).rlike(r"^\p{Nd}+$")))


def chosen(tables: DataFrame, made: DataFrame, value: str, name: str) -> DataFrame:
    """Adds what humans say of each table, or null. made: table_index, value and maybe document_id; a row without a document is meant for any,
    one with a document comes first. Human-made and small; Spark broadcasts it by its size."""
    if "document_id" not in made.columns:
        return tables.join(made.select("table_index", F.col(value).alias(name)), "table_index", "left")
    own, any_ = (made.where(F.col("document_id").isNotNull()).select("document_id", "table_index", F.col(value).alias("_own")), made.where(F.col("document_id").isNull()).select("table_index", F.col(value).alias("_any")))
    return tables.join(own, ["document_id", "table_index"], "left").join(any_, "table_index", "left").withColumn(name, F.coalesce("_own", "_any")).drop("_own", "_any")


def decide(tables: DataFrame, reviews: DataFrame, captions: DataFrame) -> DataFrame:
    """Adds decision, classification, source, note and caption. Navigation comes first, then a human review, else the
    table is taken. reviews: table_index, reason, note; captions: table_index, caption (replaces); each maybe with document_id."""
    said = reviews.withColumn("_said", F.struct("reason", "note"))
    x = chosen(chosen(tables, said, "_said", "_review"), captions, "caption", "_caption")
    toc, review = F.col("toc_reason").isNotNull(), F.col("_review.reason").isNotNull()
    return (
        x.withColumn("decision", F.when(toc | review, "exclude").otherwise("include"))
        .withColumn("classification", F.coalesce("toc_reason", "_review.reason"))
        .withColumn("review_source", F.when(toc, "automatic").when(review, "review").otherwise("accepted"))
        .withColumn("caption", F.coalesce("_caption", "caption"))
        .withColumn("note", F.col("_review.note"))
        .drop("_review", "_caption")
    )


def matrix(cells: DataFrame, shape: DataFrame, key: str) -> DataFrame:
    """Dense rows from cells. shape: key, num_rows, num_cols; cells: key, ordinal, row, col, text. Cells outside or
    empty are left out; of several at one place the last stays. Gives key, row_no, values."""
    inside = cells.join(shape, key).where((F.col("row") >= 0) & (F.col("row") < F.col("num_rows")) & (F.col("col") >= 0) & (F.col("col") < F.col("num_cols"))).withColumn("text", collapse("text")).where("text != ''")
    per_cell = inside.groupBy(key, "row", "col").agg(F.max_by("text", "ordinal").alias("text"))
    per_row = per_cell.groupBy(key, F.col("row").alias("row_no")).agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"))
    every = shape.where("num_rows > 0").select(key, "num_cols", F.explode(F.sequence(F.lit(0), F.col("num_rows") - 1)).alias("row_no"))
    values = F.when(F.col("num_cols") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("num_cols") - 1, F.lit(0))), lambda c: F.coalesce(F.element_at("m", c), F.lit("")))).otherwise(F.array().cast("array<string>"))
    return every.join(per_row, [key, "row_no"], "left").select(key, "row_no", values.alias("values"))


def headers(rows: DataFrame, header_rows: DataFrame, key: str) -> DataFrame:
    """key, col, header, fallback: header rows' cells joined by ' / ', else `Column n`. rows as matrix() gives them."""
    own = rows.join(header_rows.select(key, "row_no").distinct(), [key, "row_no"]).select(key, "row_no", F.posexplode("values").alias("col", "text")).where("text != ''")
    joined = own.groupBy(key, "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda s: s["text"]), " / ").alias("joined"))
    cols = rows.groupBy(key).agg(F.max(F.size("values")).alias("w")).where("w > 0").select(key, F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("col"))
    x = cols.join(joined, [key, "col"], "left")
    return x.select(key, "col", F.coalesce("joined", F.concat(F.lit("Column "), (F.col("col") + 1).cast("string"))).alias("header"), F.col("joined").isNull().alias("fallback"))


def data_rows(rows: DataFrame, header_rows: DataFrame, key: str) -> DataFrame:
    """Rows that head no column: what is packed."""
    return rows.join(header_rows.select(key, "row_no"), [key, "row_no"], "left_anti")


def is_key_value(rows: Column, has_header: Column, num_cols: Column) -> Column:
    """No header, two columns, all rows complete, and at least 60 % of the second values digits by half."""
    digits = lambda v: F.regexp_count(v, F.lit(r"\p{Nd}"))
    full = F.forall(rows, lambda r: (F.get(r, F.lit(0)) != "") & (F.get(r, F.lit(1)) != ""))
    numeric = F.size(F.filter(rows, lambda r: digits(F.get(r, F.lit(1))) >= F.greatest(F.lit(1), F.floor(F.length(F.get(r, F.lit(1))) / 2))))
    return ~has_header & (num_cols == 2) & (F.size(rows) > 0) & full & (numeric.cast("double") / F.size(rows) >= 0.6)


def pack(rows: DataFrame, key: str, order: list[str], size: str, target: int, base: int = 0) -> DataFrame:
    """Adds row_no (from 1) and group_no: rows fill a group up to `target`; one that is larger alone is a group of
    its own. size: an additive token count; base: what each group costs besides.

    Rows stand by key and number in each partition, and a batch goes on where the one before ended, so a table of any
    size takes one pass and a batch's memory."""
    import pyarrow as pa

    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    x = rows.withColumn("row_no", n).sortWithinPartitions(key, "row_no")  # the window has brought a key's rows together

    def run(batches):
        now, group, held = None, 0, 0
        for b in batches:
            out = []
            for k, s in zip(b.column(key).to_pylist(), b.column(size).cast(pa.int64()).to_pylist()):
                if k != now or held + (s or 0) > target:
                    group, held = (1 if k != now else group + 1), base
                now, held = k, held + (s or 0)
                out.append(group)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], [*b.schema.names, "group_no"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema)
    return x.mapInArrow(run, f"{fields}, group_no int")


def pack_texts(rows: DataFrame, key: str, order: list[str], text: str, lead: str, target: int, count: Counter) -> DataFrame:
    """pack() for counts that don't add up: a group's size is the count of its lead and its rows' texts as they will stand, blank lines between.
    Adds row_no and group_no. A group's own text is what a task holds."""
    import pandas as pd

    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    x = rows.withColumn("row_no", n).sortWithinPartitions(key, "row_no")

    def run(frames):
        now, group, held = None, 0, ""
        for pdf in frames:
            out = []
            for k, own, top in zip(pdf[key], pdf[text], pdf[lead]):
                own, top = own or "", top or ""
                if k != now or count(f"{top}{held}\n\n{own}") > target:
                    group, held = (1 if k != now else group + 1), own
                else:
                    held = f"{held}\n\n{own}"
                now = k
                out.append(group)
            yield pdf.assign(group_no=pd.Series(out, index=pdf.index, dtype="int32"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema)
    return x.mapInPandas(run, f"{fields}, group_no int")


def split_row(text: str, prefix: str, limit: int, count=None) -> list[str]:
    """Fragments of a row too large for a chunk: whole words while they fit after the prefix. A word that is too long
    even alone is cut into the largest pieces that fit; each piece, the last too, is a fragment of its own. count: tokens of a text; the prefix is counted with the longest fragment label."""
    count = count or words
    if count(prefix) >= limit:
        raise ValueError("the context alone reaches the limit")
    fits = lambda s: count(prefix + s) <= limit
    units, out, at = re.findall(r"\S+\s*", text), [], 0
    while at < len(units):
        n = longest(lambda k: fits("".join(units[at : at + k])), len(units) - at)  # noqa: B023
        if n:
            out.append("".join(units[at : at + n]).rstrip())
            at += n
            continue
        rest = units[at]
        while rest:
            n = longest(lambda k: fits(rest[:k]), len(rest))  # noqa: B023
            if not n:
                raise ValueError("not one character fits")
            out.append(rest[:n].rstrip())
            rest = rest[n:]
        at += 1
    return out


def fragments(rows: DataFrame, key: str, limit: int, count=None) -> DataFrame:
    """key, row_no, fragment_no, n_fragments, text of rows with columns text and prefix; in the workers, row by row."""
    import pandas as pd

    def run(frames):
        for pdf in frames:
            out = [(k, r, i, len(parts), p) for k, r, t, f in zip(pdf[key], pdf["row_no"], pdf["text"], pdf["prefix"]) for parts in [split_row(t, f, limit, count)] for i, p in enumerate(parts, 1)]
            yield pd.DataFrame(out, columns=[key, "row_no", "fragment_no", "n_fragments", "text"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, "row_no", "text", "prefix").mapInPandas(run, f"{key} {kind}, row_no int, fragment_no int, n_fragments int, text string")


def coverage(packed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, ok: each expected row_no is there once, and no other."""
    both = packed.select(key, "row_no", F.lit(1).alias("got"), F.lit(0).alias("want")).unionByName(expected.select(key, "row_no", F.lit(0).alias("got"), F.lit(1).alias("want")))
    per_row = both.groupBy(key, "row_no").agg(F.sum("got").alias("got"), F.max("want").alias("want"))
    return per_row.groupBy(key).agg(F.min((F.col("got") == 1) & (F.col("want") == 1)).alias("ok"))


def consecutive(df: DataFrame, key: str, number: str) -> DataFrame:
    """key, ok: the numbers are 1..n."""
    n = F.col(number)
    per = df.groupBy(key, n.alias("number")).count().groupBy(key).agg(F.sum("count").alias("rows"), F.count("*").alias("distinct"), F.min("number").alias("low"), F.max("number").alias("high"))
    return per.select(key, ((F.col("rows") == F.col("high")) & (F.col("low") == 1) & (F.col("distinct") == F.col("rows"))).alias("ok"))


def captions_of(tables: DataFrame, items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds `captions`: each table's caption refs looked up among the items (by, self_ref, text) of its document, else their own text; empty ones
    are left out, order stays. tables: by, table_index, caption_refs array<struct<ref,text>>."""
    keys = [*by, "table_index"]
    refs = tables.select(*keys, F.posexplode("caption_refs").alias("at", "c")).withColumn("_ref", F.col("c.ref"))
    found = refs.join(items.select(*by, F.col("self_ref").alias("_ref"), F.col("text").alias("_text")), [*by, "_ref"], "left")
    texts = found.withColumn("t", collapse(F.coalesce("_text", "c.text", F.lit("")))).where("t != ''")
    per = texts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda s: s["t"]).alias("captions"))
    return tables.join(per, keys, "left").withColumn("captions", F.coalesce("captions", F.array().cast("array<string>")))


def attribute(key: Column) -> Column:
    return strip(F.regexp_replace(key, ":+$", ""))
