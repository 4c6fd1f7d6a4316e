"""Retrieval: exact nearest neighbours, reranking, context and its budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.corpus import lookup

#: Numbers of the questions' vectors that a task holds at a time: 32 MB, 65,536 questions of 64 dimensions.
NUMBERS = 1 << 22


def nearest(questions: DataFrame, index: DataFrame, k: int, qid: str = "qid", rid: str = "record_id", vector: str = "embedding") -> DataFrame:
    """qid, rid, distance (squared Euclidean, in doubles), rank (from 1) of each question's k nearest; ties to the
    smaller rid. Rows without a vector take no part.

    A grid of question blocks x index blocks, a cell a task: a cell has its questions first, then its rows of the index as a stream, and
    keeps each question's best k. So k rows a question and cell are shuffled, a task holds NUMBERS numbers of questions and one batch,
    and nothing passes the driver. The index is sent once for each block of questions."""
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, cols = F.col("_rows"), F.greatest(F.lit(1), F.floor(F.lit(tasks) / F.col("_rows"))).cast("int")
    asked, kept = (df.select(name, vector).where(F.col(vector).isNotNull()) for df, name in ((questions, qid), (index, rid)))
    blocks = asked.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.coalesce(F.max(F.size(vector)), F.lit(1)) / NUMBERS)).cast("int").alias("n")).scalar()
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    kinds = dict(questions.dtypes)[qid], dict(index.dtypes)[rid]
    doubles = F.transform(vector, lambda v: v.cast("double")).alias("v")
    q = asked.withColumn("_rows", blocks).withColumn("_row", F.pmod(F.xxhash64(qid), rows)).withColumn("_col", every(cols)).select((F.col("_row") * cols + F.col("_col")).cast("int").alias("cell"), F.lit(False).alias("own"), F.col(qid).alias("q"), F.lit(None).cast(kinds[1]).alias("r"), doubles)
    x = kept.withColumn("_rows", blocks).withColumn("_col", F.pmod(F.xxhash64(rid), cols)).withColumn("_row", every(rows)).select((F.col("_row") * cols + F.col("_col")).cast("int").alias("cell"), F.lit(True).alias("own"), F.lit(None).cast(kinds[0]).alias("q"), F.col(rid).alias("r"), doubles)
    placed = q.unionByName(x).repartitionById(tasks, F.col("cell") % tasks).sortWithinPartitions("cell", "own")

    def measure(frames):
        now, best = None, None
        for pdf in frames:
            for cell, part in pdf.groupby("cell", sort=True):
                if cell != now:
                    if best is not None:
                        yield from best.frames(qid, rid)
                    now, best = cell, Best(k)
                own = part["own"].to_numpy(dtype=bool)
                best.ask(part[~own])
                best.see(part[own])
        if best is not None:
            yield from best.frames(qid, rid)

    found = placed.mapInPandas(measure, f"{qid} {kinds[0]}, {rid} {kinds[1]}, distance double")
    return top(found, qid, k, F.col("distance").asc(), F.col(rid).asc())


class Best:
    """The k nearest so far of some questions, of rows that come in batches."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.held = k, [], []
        self.ids, self.q = None, None
        self.count = 0

    def ask(self, part: pd.DataFrame) -> None:
        if len(part):
            self.parts.append((part["q"].to_numpy(), np.stack(part["v"].to_numpy())))

    def see(self, part: pd.DataFrame) -> None:
        if not len(part) or not self.parts:
            return
        if self.q is None:  # a cell's questions stand before its rows
            self.ids, self.q = (np.concatenate(c) for c in zip(*self.parts))
        names = part["r"].to_numpy()
        i, j, d = near_pairs(self.q, np.stack(part["v"].to_numpy()), names, self.k)
        self.held.append((i, names[j], d))
        self.count += len(i)
        if self.count > 4 * len(self.q) * self.k:
            self.cut()

    def cut(self) -> None:
        i, names, d = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((names, d, i))
        i, names, d = i[order], names[order], d[order]
        good = np.arange(len(i)) - np.searchsorted(i, i) < self.k
        self.held, self.count = [(i[good], names[good], d[good])], int(good.sum())

    def frames(self, qid: str, rid: str):
        if self.held:
            self.cut()
            i, names, d = self.held[0]
            yield pd.DataFrame({qid: self.ids[i], rid: names, "distance": d})


def near_pairs(q: np.ndarray, x: np.ndarray, names: np.ndarray, k: int, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, row, squared distance) of each question's k nearest rows, ties to the smaller name. One matrix product gives all
    distances nearly; rows within its error of the k-th are measured exactly. Of equal vectors only the k smallest names are measured."""
    _, which = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    by_class = np.lexsort((names, which))
    at = which[by_class]
    row = np.sort(by_class[np.arange(len(at)) - np.searchsorted(at, at) < k])
    x, names = x[row], names[row]
    out, xx = [], (x * x).sum(axis=1)
    for a in range(0, len(q), block):
        own = q[a : a + block]
        about = xx[None, :] - 2 * own @ x.T
        scale = xx.max() + (own * own).sum(axis=1)
        edge = np.partition(about, k - 1, axis=1)[:, k - 1] if len(x) > k else about.max(axis=1)
        i, j = np.nonzero(about <= (edge + 1e-9 * scale)[:, None])
        d = ((x[j] - own[i]) ** 2).sum(axis=1)
        order = np.lexsort((names[j], d, i))
        i, j, d = i[order], j[order], d[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((i[nth < k] + a, row[j[nth < k]], d[nth < k]))
    return tuple(np.concatenate(c) for c in zip(*out))


def top(rows: DataFrame, by: str, k: int, *order: Column, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= k)


def rerank(candidates: DataFrame, score: Column, k: int, qid: str = "qid", rank: str = "rank") -> DataFrame:
    """The k best by score, none last, equals in their order so far; adds score and rerank_rank."""
    return top(candidates.withColumn("score", score), qid, k, F.col("score").desc_nulls_last(), F.col(rank).asc(), name="rerank_rank")


def first_distinct(ranked: DataFrame, qid: str, key: Column, n: int, rank: str = "rerank_rank") -> DataFrame:
    """Of rows in rank order the first of each key, and of those the first n; adds source_no."""
    x = ranked.withColumn("_key", key)
    first = x.withColumn("_n", F.row_number().over(Window.partitionBy(qid, "_key").orderBy(rank))).where("_n = 1")
    return top(first, qid, n, F.col(rank).asc(), name="source_no").drop("_n", "_key")


def source_key() -> Column:
    """Children of one table share their parent's place."""
    return F.when((F.col("content_type") == "table_child") & (F.coalesce("parent_id", F.lit("")) != ""), F.col("parent_id")).otherwise(F.col("record_id"))


def context(candidates: DataFrame, records: DataFrame, parents: DataFrame) -> DataFrame:
    """Candidates with title, pages, passage, section, expanded. Texts take their title as the records have it now;
    table children become their whole table, or stay alone where the parent is missing. Of records or parents with one id the last counts."""
    records, parents = lookup(records, "record_id"), lookup(parents, "record_id")
    live = records.select(F.col("record_id").alias("_rid"), F.col("title").alias("_title"))
    whole = parents.select(F.col("record_id").alias("_pid"), F.col("title").alias("_ptitle"), F.array_min("pages").alias("_p0"), F.array_max("pages").alias("_p1"), F.col("text").alias("_ptext"))
    child = (F.col("content_type") == "table_child") & (F.coalesce("parent_id", F.lit("")) != "")
    x = candidates.withColumn("_child", child)
    x = x.join(live, (x["record_id"] == live["_rid"]) & ~x["_child"], "left").join(whole, (F.col("parent_id") == F.col("_pid")) & F.col("_child"), "left")
    x = x.withColumn("title", F.coalesce("_ptitle", "_title", "title")).withColumn("start_page", F.coalesce("_p0", "start_page")).withColumn("end_page", F.coalesce("_p1", "end_page"))
    x = x.withColumn("passage", F.col("text")).withColumn("section", F.coalesce("_ptext", "text")).withColumn("parent_id", F.when(F.col("_child"), F.col("parent_id")))
    return x.withColumn("expanded", F.col("section") != F.col("passage")).drop("_child", "_rid", "_title", "_pid", "_ptitle", "_p0", "_p1", "_ptext")


def _block(no: Column, s: Column, section: Column) -> Column:
    head = F.concat(F.lit("[Source "), no.cast("string"), F.lit("] "), s["title"], F.lit(" (pages "), T.prompt_pages(s["start_page"], s["end_page"]), F.lit(")\n"))
    return F.when(s["expanded"], F.concat(head, F.lit("Matched rows:\n"), s["passage"], F.lit("\nWhole table:\n"), section)).otherwise(F.concat(head, section))


BLOCK = "struct<source_no:int,title:string,start_page:int,end_page:int,content_type:string,record_id:string,parent_id:string,passage:string,section:string,expanded:boolean>"
CITED = "struct<source_no:int,title:string,start_page:int,end_page:int,content_type:string,record_id:string,parent_id:string,text:string,cut:boolean>"


def budgeted(blocks: DataFrame, qid: str | list[str], budget: int | Column) -> DataFrame:
    """qid, sources: what fits the budget of characters, in order of source_no, each rendered; a section is cut to
    what is left; a block whose head alone doesn't fit ends the list. What stands between blocks isn't charged."""
    keys = [qid] if isinstance(qid, str) else qid
    names = [f.split(":")[0] for f in BLOCK[7:-1].split(",")]
    limit = (F.lit(budget) if isinstance(budget, int) else budget).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct(*names))).cast(f"array<{BLOCK}>")
    start = F.struct(limit.alias("left"), F.array().cast(f"array<{CITED}>").alias("out"))

    def step(a, s):
        no = F.size(a["out"]) + 1
        overhead = F.length(_block(no, s, F.lit("")))
        got = T.fit(s["section"], a["left"] - overhead)
        text = _block(no, s, got["text"])
        cited = F.struct(no.alias("source_no"), *(s[n].alias(n) for n in names[1:7]), text.alias("text"), got["cut"].alias("cut"))
        goes = (a["left"] > 0) & (overhead < a["left"])
        return F.when(goes, F.struct((a["left"] - F.length(text)).alias("left"), F.concat(a["out"], F.array(cited)).alias("out"))).otherwise(F.struct(F.lit(0).alias("left"), a["out"].alias("out")))

    per = blocks.groupBy(*keys).agg(ordered.alias("blocks"))
    return per.select(*keys, F.aggregate("blocks", start, step, lambda a: a["out"]).alias("sources"))


def dictionary(*columns: str) -> Column:
    """A row as a JSON object of these columns; what is null has no key."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


RULES = {"en": "Answer in English.", "zh-hant": "Answer in Traditional Chinese."}


def prompts(sources: DataFrame, question: str = "question", language: str = "auto") -> DataFrame:
    """Adds prompt, citations and truncated (ids whose section was cut)."""
    lang = T.language(question, language)
    rule = F.when(lang == "zh-hant", RULES["zh-hant"]).otherwise(RULES["en"])
    body = F.array_join(F.transform("sources", lambda s: s["text"]), "\n\n")
    x = sources.withColumn("prompt", F.concat(F.lit("Use only the sources below and name them as [Source N]. "), rule, F.lit("\n\nSources:\n\n"), body, F.lit("\n\nQuestion: "), F.col(question), F.lit("\nAnswer:")))
    cite = F.transform("sources", lambda s: F.struct(F.concat(F.lit("Source "), s["source_no"].cast("string")).alias("source_id"), s["title"].alias("title"), T.page_label(s["start_page"], s["end_page"]).alias("pages"), s["record_id"].alias("record_id"), s["parent_id"].alias("parent_id")))
    return x.withColumn("citations", cite).withColumn("truncated", F.transform(F.filter("sources", lambda s: s["cut"]), lambda s: s["record_id"])).withColumn("prompt_chars", F.length("prompt"))
