"""The text view of a parsed document: which items stay, and how they become chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import SPACE, strip
from lodestone.operators.counters import Counter, words
from lodestone.operators.tables import split_row
from lodestone.stage import stash

LABELS = ("caption", "page_footer", "page_header")


def index_start(items: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """page: the first page of section headers that read 'index', or null. One row in all, or one for each `by` that has such a header."""
    own = items.where((F.col("label") == "section_header") & (F.lower(strip("text")) == "index"))
    return own.groupBy(*by).agg(F.min(F.array_min("pages")).alias("page"))


def linked_refs(owners: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, ref: captions and footnotes of tables and pictures, each once."""
    none = F.array().cast("array<string>")
    return owners.select(*by, F.explode(F.concat(F.coalesce("captions", none), F.coalesce("footnotes", none))).alias("ref")).distinct()


def subtree(items: DataFrame, roots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, ref: the roots and all that hangs below them by parent_ref.

    Pointers jump: each round an item learns whether the item that it points to is taken, and points to where that one does. A chain of n
    items ends after log2(n) rounds, and so does a circle: a round's table is written, and no more rounds than the number of rows allows are
    made. Of items with one ref in one document the least parent counts. Items of which all is known are written once and only looked up later."""
    keys = [*by, "ref"]
    marked = roots.select(*keys).distinct()
    nodes = items.where(F.col("self_ref").isNotNull()).select(*by, F.col("self_ref").alias("ref"), F.col("parent_ref").alias("up"), F.lit(False).alias("taken"))
    both = nodes.unionByName(marked.select(*keys, F.lit(None).cast("string").alias("up"), F.lit(True).alias("taken")))  # a root need not be an item
    state = stash(both.groupBy(*keys).agg(F.min("up").alias("up"), F.max("taken").alias("taken")).withColumn("up", F.when(~F.col("taken"), F.col("up"))).select(*keys, "up", "taken"), "subtree")
    done, live = state.where("up is null"), state.where("up is not null")
    for _ in range(max(1, state.count()).bit_length() + 1):
        if not live.head(1):
            break
        next_ = done.unionByName(live).select(*by, F.col("ref").alias("up"), F.col("up").alias("_up"), F.col("taken").alias("_taken"))
        step = live.join(next_, [*by, "up"], "left").select(*keys, F.when(~F.coalesce("_taken", F.lit(False)), F.col("_up")).alias("up"), F.coalesce("_taken", F.lit(False)).alias("taken"))
        step = stash(step, "subtree")
        done, live = done.unionByName(step.where("up is null")), step.where("up is not null")
    return done.where("taken").select(*keys)


def keep_text(items: DataFrame, linked: DataFrame, start: int, index_page: int | DataFrame | None, removed: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Items that are text of the body. Items without pages stay where pages decide. index_page: one for all, or a table of by, page."""
    last = F.array_max("pages")
    out = F.col("label").isin(*LABELS) | F.coalesce(last < start, F.lit(False))
    if isinstance(index_page, DataFrame):
        kept = items.join(index_page.select(*by, F.col("page").alias("_page")), [*by], "left").where(~(out | F.coalesce(last >= F.col("_page"), F.lit(False)))).drop("_page")
    else:
        kept = items.where(~out if index_page is None else ~(out | F.coalesce(last >= index_page, F.lit(False))))
    for gone in (linked, removed):
        if gone is not None:
            kept = kept.join(gone.select(*by, F.col("ref").alias("self_ref")), [*by, "self_ref"], "left_anti")
    return kept.select(*items.columns)


def first_chapter(chunks: DataFrame, chapters: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """key, chapter: of a chunk's refs, in order, the first chapter that isn't empty."""
    refs = chunks.select(key, *by, F.posexplode("refs").alias("at", "ref")).join(chapters.select(*by, F.col("self_ref").alias("ref"), "chapter"), [*by, "ref"], "left")
    return refs.where(strip(F.coalesce("chapter", F.lit(""))) != "").groupBy(key).agg(F.min_by(strip("chapter"), "at").alias("chapter"))


def non_empty(values):
    """Headings or captions that aren't blank."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: strip(v) != "")


def contextual(headings, text):
    """What is embedded: the heading path's lines, then the text."""
    return F.concat_ws("\n", non_empty(headings), text)


def chunk(items: DataFrame, by: str, target: int, count: Counter = words) -> DataFrame:
    """Chunks of a document's items under one heading path: by, number, headings, context, refs, pages, text, token_count.

    Items follow each other while they fit `target` with their headings; an item that is too large alone is cut as split_row() does; neighbours
    under one heading path share a chunk as far as they fit; none overlap, blank items go. context: the headings that are counted and stand
    before the text: all, or the last of them that leave room. token_count is that of context and text together.

    Items stand by document and ordinal in each partition and pass as a stream: a document of any length takes a batch's memory."""

    def run(frames):
        state = None
        for pdf in frames:
            out: list[tuple] = []
            for r in pdf.itertuples(index=False):
                if state is None or state.document != r.document:
                    if state is not None:
                        state.close(out)
                    state = _Chunks(r.document, target, count)
                state.add(r, out)
            yield _frame(out, by)
        if state is not None:
            state.close(out := [])
            yield _frame(out, by)

    kind = dict(items.dtypes)[by]
    placed = items.select(F.col(by).alias("document"), "ordinal", "self_ref", "headings", "pages", "text").repartition(by_parts(items), "document").sortWithinPartitions("document", "ordinal")
    return placed.mapInPandas(run, f"{by} {kind}, number int, headings array<string>, context array<string>, refs array<string>, pages array<int>, text string, token_count int")


def by_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _frame(rows: list[tuple], by: str):
    import pandas as pd

    return pd.DataFrame(rows, columns=[by, "number", "headings", "context", "refs", "pages", "text", "token_count"])


class _Chunks:
    """The chunk that is being filled, of one document."""

    def __init__(self, document, target: int, count: Counter) -> None:
        self.document, self.target, self.count = document, target, count
        self.number, self.path, self.context = 0, None, []
        self.refs, self.pages, self.held = [], set(), ""

    def lead(self) -> str:
        return "".join(f"{h}\n" for h in self.context)

    def close(self, out: list) -> None:
        if self.held:
            self.number += 1
            out.append((self.document, self.number, list(self.path), list(self.context), self.refs, sorted(self.pages), self.held, self.count(self.lead() + self.held)))
        self.refs, self.pages, self.held = [], set(), ""

    def add(self, r, out: list) -> None:
        text = (r.text or "").strip()
        if not text:
            return
        heads = [h for h in (r.headings if r.headings is not None else []) if h and h.strip()]
        if heads != self.path:
            self.close(out)
            self.path = self.context = heads
            while self.context and self.count(self.lead()) >= self.target:
                self.context = self.context[1:]
        lead = self.lead()
        for p in [text] if self.count(lead + text) <= self.target else split_row(text, lead, self.target, self.count):
            if self.held and self.count(f"{lead}{self.held}\n{p}") > self.target:
                self.close(out)
            self.held = f"{self.held}\n{p}" if self.held else p
            if r.self_ref not in self.refs:
                self.refs = [*self.refs, r.self_ref]
            self.pages |= {int(x) for x in (r.pages if r.pages is not None else [])}


__all__ = ["LABELS", "SPACE", "chunk", "contextual", "first_chapter", "index_start", "keep_text", "linked_refs", "non_empty", "subtree"]
