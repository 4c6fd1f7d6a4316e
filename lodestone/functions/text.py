"""Text functions as Spark columns. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space that Python's str.strip() and \s know.
SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NO_SPACE = SPACE.replace("[", "[^", 1)
#: Fixed value: code points that make a question Chinese: kana, CJK with extension A, compatibility forms.
CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
#: Fixed value: a numbered heading.
NUMBERED = r"^[0-9]+(?:\.[0-9]+)*\.?" + SPACE + "+"
NOTE = "\n[... cut to fit ...]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.regexp_replace(col(c), rf"\A{SPACE}+|{SPACE}+\z", "")


def rstrip(c: str | Column) -> Column:
    return F.regexp_replace(col(c), rf"{SPACE}+\z", "")


def collapse(c: str | Column) -> Column:
    """Runs of white space become a blank; none stays at the ends."""
    return F.trim(F.regexp_replace(col(c), f"{SPACE}+", " "))


def preview(c: str | Column, n: int = 160) -> Column:
    return F.left(collapse(c), F.lit(n))


def slug(c: str | Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9._-]+", "-"), F.lit("-"))


def escape_pipes(c: str | Column) -> Column:
    return F.replace(col(c), F.lit("|"), F.lit("\\|"))


def content_hash(c: str | Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the UTF-8 text."""
    return F.left(F.sha2(col(c).cast("binary"), 256), F.lit(16))


def token_count(c: str | Column) -> Column:
    """Words; the offline stand-in for a tokenizer, and additive over rows."""
    return F.coalesce(F.regexp_count(col(c), F.lit(SPACE.replace("[", "[^", 1) + "+")), F.lit(0))


def counted_by(count) -> Callable[[Column], Column]:
    """A column of a counter's counts: token_count() for words(), else the counter in Arrow batches."""
    if getattr(count, "__name__", "") == "words":
        return token_count

    @F.pandas_udf("int")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count(t or "")).astype("int32")

    return lambda c: tokens(c)


def language(c: str | Column, setting: str | Column = "auto") -> Column:
    """`en` or `zh-hant`: as set, if the setting is one of them, else by the characters."""
    s = F.lit(setting) if isinstance(setting, str) else setting
    return F.when(s.isin("en", "zh-hant"), s).when(col(c).rlike(CJK), "zh-hant").otherwise("en")


def terms(c: str | Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(col(c)), f"{SPACE}+"), lambda x: x != ""))


def overlap(query: str | Column, passage: str | Column) -> Column:
    """Shared terms by the query's terms: the offline reranker."""
    q = terms(query)
    return F.size(F.array_intersect(q, terms(passage))) / F.greatest(F.size(q), F.lit(1))


def fit(c: str | Column, budget: str | Column) -> Column:
    """struct(text, cut): whole if it fits, else cut with a note, else as much of the note as fits."""
    t, b, n = col(c), col(budget), len(NOTE)
    kept = F.concat(rstrip(F.left(t, b - n)), F.lit(NOTE))
    return F.struct(F.when(F.length(t) <= b, t).when(b <= n, F.left(F.lit(NOTE), F.greatest(b, F.lit(0)))).otherwise(kept).alias("text"), (F.length(t) > b).alias("cut"))


def markdown_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def markdown(header: Column, rows: Column) -> Column:
    """A Markdown table of a header (array of strings) and rows (arrays); short rows are padded, pipes escaped."""
    escaped = lambda r: F.transform(r, lambda v: escape_pipes(F.coalesce(v, F.lit(""))))
    width = F.greatest(F.size(header), F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)))
    pad = lambda r: F.concat(escaped(r), F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0))))
    rule = markdown_line(F.array_repeat(F.lit("---"), width))
    return F.array_join(F.concat(F.array(markdown_line(pad(header)), rule), F.transform(rows, lambda r: markdown_line(pad(r)))), "\n")


def grid_markdown(grid: Column) -> Column:
    """A grid's first row is its header; no rows: ''."""
    return F.when(F.size(grid) > 0, markdown(F.get(grid, F.lit(0)), F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))))).otherwise("")


def grid_text(grid: Column) -> Column:
    """Tab-separated lines of the rows that hold any value."""
    return F.array_join(F.transform(F.filter(grid, lambda r: F.exists(r, lambda v: v != "")), lambda r: F.array_join(r, "\t")), "\n")


def row_text(index: Column, values: Column, header: Column, key_value: Column) -> Column:
    """A table row with its column names."""
    head = F.concat(F.lit("Row "), index.cast("string"), F.lit(":"))
    pairs = F.filter(F.zip_with(header, values, lambda h, v: F.when(v != "", F.concat(h, F.lit(": "), v))), lambda x: x.isNotNull())
    single = F.concat(head, F.lit("\n"), strip(F.regexp_replace(F.get(values, F.lit(0)), ":+$", "")), F.lit(": "), F.get(values, F.lit(1)))
    return F.when(key_value, single).when(F.size(pairs) == 0, F.concat(head, F.lit(" (empty)"))).otherwise(F.concat(head, F.lit("\n"), F.array_join(pairs, "\n")))


def embedding_text(captions: Column, header: Column, rows: Column) -> Column:
    """Captions, then the rows' texts, or the column names if there are none."""
    top = F.when(F.size(captions) > 0, F.array_join(F.transform(captions, lambda c: F.concat(F.lit("Table: "), c)), "\n"))
    body = F.when(F.size(rows) > 0, rows).otherwise(F.array(F.concat(F.lit("Columns: "), F.array_join(header, "; "))))
    return F.array_join(F.concat(F.filter(F.array(top), lambda x: x.isNotNull()), body), "\n\n")


def table_markdown(captions: Column, header: Column, rows: Column) -> Column:
    lines = F.transform(captions, lambda c: F.concat(F.lit("Caption: "), c))
    return F.array_join(F.concat(lines, F.array(markdown(header, rows))), "\n")


def page_label(start: str | Column, end: str | Column) -> Column:
    """As in a citation."""
    s, e = col(start), col(end)
    return F.when(s == e, F.concat(F.lit("p. "), s.cast("string"))).otherwise(F.concat(F.lit("pp. "), s.cast("string"), F.lit("-"), e.cast("string")))


def prompt_pages(start: str | Column, end: str | Column) -> Column:
    """As in a prompt."""
    s, e = col(start), col(end)
    return F.when(s == e, s.cast("string")).otherwise(F.concat(s.cast("string"), F.lit(" - "), e.cast("string")))


def text_title(headings: Column, chapter: Column) -> Column:
    section = F.when(F.size(headings) > 0, F.array_join(headings, " > ")).otherwise(F.lit("Untitled section"))
    c = strip(F.coalesce(chapter, F.lit("")))
    return F.when((c != "") & (c != section), F.concat(c, F.lit(" > "), section)).otherwise(section)


def table_title(captions: Column, index: Column) -> Column:
    return F.when(F.size(captions) > 0, F.array_join(captions, " ")).when(index.isNotNull(), F.concat(F.lit("Table (index "), index.cast("string"), F.lit(")"))).otherwise("Table")


def normalized(v: Column) -> Column:
    """A vector at length 1; a zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
