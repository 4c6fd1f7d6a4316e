"""Phrase collocation mining: which runs of 2 to 5 words are frequent and cohere.

Texts are lower-cased (A-Z), split at PIECE_ENDS into pieces and these into words; everything is counted by language. The
frequent phrases come length by length, each in one pass over all texts (PCY, with DHP's pruning of longer runs):

1. The pass of length k counts the k-grams that can be frequent, exactly, and adds every (k+1)-gram that can be to one of
   BUCKETS counters by its hash. A task's counters stop at the least count, so a byte each is enough; only those that
   are not zero are shuffled, by blocks, and a block's sum is a stream over its tasks' rows.
2. A bucket whose sum is under the least count holds no frequent (k+1)-gram. The bitmap of the others is broadcast: BUCKETS
   bits, whatever the corpus.
3. Apriori: a (k+1)-gram counts, here and in the bucket counters of the length after it, only if its bucket is in the bitmap
   and both its k-grams are in the filter of frequent k-grams (FILTER_BITS bits). Filters let through more than is frequent,
   never less; the exact count decides.

The bitmap prunes nothing once every bucket is over the least count (about BUCKETS * 100 words, 6.7 billion); from there on Apriori
alone prunes. Results are the same.

Phrases are equal if their texts are; within one task those with equal 64-bit hashes are one. Null and empty texts have no
word; a null language is `und`; rows repeat as they are given, doc_ids are not read; an empty table gives no row; other columns are
left out. A very long text is taken some words at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KeyFilter, folded, frugal, give_back, mix64, stash, text_of, tune, word_hashes

#: The contract's lengths, least count, scale, phrases a language and piece ends.
LONGEST, LEAST, SCALE, TOP = 5, 100, 1000, 2000
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Counters of next-length runs, in BLOCKS blocks; words that are taken at a time.
BUCKETS, BLOCKS, WORDS = 1 << 26, 64, 1 << 19
#: Shares of a language's phrases that are ranked apart before the rest is ranked together.
SHARES = 64

_END = np.zeros(256, dtype=bool)
_END[list(PIECE_ENDS)] = True
_GAP = _END.copy()
_GAP[[0x20, 0x09]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "kind int, lang string, phrase string, hash long, n long, block int, cells binary"


def _lang_hash(lang: str) -> np.uint64:
    x = np.frombuffer(lang.encode("utf-8", "surrogatepass") + b"\x00", dtype=np.uint8)
    return word_hashes(x, np.zeros(256, dtype=bool))[2][0]


class Words:
    """The words of some texts of several languages: byte places, hashes, pieces."""

    def __init__(self, texts: list, langs: list[str]) -> None:
        raw = [folded(t if isinstance(t, str) else None) for t in texts]
        self.data = np.concatenate([x for r in raw for x in (r, np.frombuffer(b"\n", dtype=np.uint8))]) if raw else np.zeros(0, dtype=np.uint8)
        self.start, self.end, h = word_hashes(self.data, _GAP)
        ends = np.cumsum(_END[self.data], dtype=np.int64)
        self.piece = ends[self.start] if len(self.start) else np.zeros(0, dtype=np.int64)  # words of one piece have as many ends before them
        self.langs = sorted(set(langs))
        number = {x: k for k, x in enumerate(self.langs)}
        size = np.array([len(r) + 1 for r in raw], dtype=np.int64)
        row = np.searchsorted(np.cumsum(size), self.start, side="right")
        self.lang = np.array([number[x] for x in langs], dtype=np.int64)[row] if len(row) else np.zeros(0, dtype=np.int64)
        salt = np.array([_lang_hash(x) for x in self.langs], dtype=np.uint64)
        self.own = mix64(h ^ salt[self.lang]) if len(h) else h

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of k words of one piece begin, and a hash for every place (of any k words)."""
        m = max(0, len(self.own) - k + 1)
        h = np.zeros(m, dtype=np.uint64)
        for i in range(k):
            h = h * _STEP + self.own[i : i + m]
        return self.piece[:m] == self.piece[k - 1 :][:m], mix64(h + np.uint64(k))

    def phrase(self, at: int, k: int) -> str:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[at : at + k].tolist(), self.end[at : at + k].tolist())).decode("utf-8", "replace")


def pieces_of(texts: list, langs: list[str]):
    """Words of some texts at a time. A text with very many words is one group alone."""
    k = 0
    while k < len(texts):
        m, size = k, 0
        while m < len(texts) and (m == k or size + len(texts[m]) <= 4 * WORDS):
            size += len(texts[m])
            m += 1
        yield Words(texts[k:m], langs[k:m])
        k = m


def _passing(w: Words, k: int, bitmap, kept) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of k words that can be frequent. bitmap: of k-grams' buckets; kept: filter of frequent (k-1)-grams."""
    inside, h = w.runs(k)
    if bitmap is None:
        return np.flatnonzero(inside), h
    bucket = h & np.uint64(BUCKETS - 1)
    at = np.flatnonzero(inside)
    at = at[(bitmap[(bucket[at] >> np.uint64(3)).astype(np.int64)] >> (bucket[at] & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
    if kept is not None and len(at):
        shorter = w.runs(k - 1)[1].view(np.int64)
        at = at[kept.has(shorter[at])]
        at = at[kept.has(shorter[at + 1])]
    return at, h


def counted(docs: DataFrame, k: int, bitmap, kept, least: int, last: bool) -> DataFrame:
    """COUNTS rows of one pass: kind 0 a k-gram's count in some texts, kind 1 a block of a task's counters of (k+1)-grams, as bucket
    numbers (4 bytes each) and then counts (one each)."""

    def run(frames):
        cells = None if last else np.zeros(BUCKETS, dtype=np.uint8)
        bits = None if bitmap is None else np.frombuffer(bitmap.value, dtype=np.uint8)
        for pdf in frames:
            langs = ["und" if not isinstance(x, str) else x for x in pdf["lang"].tolist()]
            for w in pieces_of([text_of(t) for t in pdf["text"].tolist()], langs):
                at, h = _passing(w, k, bits, kept)
                if len(at):
                    distinct, first, n = np.unique(h[at], return_index=True, return_counts=True)
                    place = at[first].tolist()
                    yield pd.DataFrame({"kind": 0, "lang": [w.langs[x] for x in w.lang[place].tolist()], "phrase": [w.phrase(p, k) for p in place], "hash": distinct.view(np.int64), "n": n, "block": None, "cells": None}).astype({"block": "Int32"})
                if cells is not None:
                    inside, longer = w.runs(k + 1)
                    good = inside
                    if k > 1:  # both its k-grams can be frequent
                        can = np.zeros(len(h), dtype=bool)
                        can[at] = True
                        good = inside & can[: len(inside)] & can[1 : len(inside) + 1]
                    bucket, n = np.unique(longer[good] & np.uint64(BUCKETS - 1), return_counts=True)
                    bucket = bucket.astype(np.int64)
                    cells[bucket] = np.minimum(cells[bucket] + n, least).astype(np.uint8)
                del w
            give_back()
        if cells is not None:
            width = BUCKETS // BLOCKS
            for b in range(BLOCKS):
                at = np.flatnonzero(cells[b * width : (b + 1) * width])
                if len(at):
                    blob = at.astype("<u4").tobytes() + cells[b * width + at].tobytes()
                    yield pd.DataFrame({"kind": [1], "lang": [None], "phrase": [None], "hash": [None], "n": [None], "block": [b], "cells": [blob]}).astype({"block": "Int32", "hash": "Int64", "n": "Int64"})

    return docs.mapInPandas(frugal(run), COUNTS)


def bitmap_of(rows: DataFrame, least: int) -> bytes:
    """The buckets that reach the least count, BUCKETS bits: the only rows that come to the driver, and their number is fixed."""
    width = BUCKETS // BLOCKS

    def run(frames):
        own: dict[int, np.ndarray] = {}
        for pdf in frames:
            for block, blob in zip(pdf["block"].tolist(), pdf["cells"].tolist()):
                n = len(blob) // 5
                cells = own.setdefault(block, np.zeros(width, dtype=np.uint8))
                at = np.frombuffer(blob, dtype="<u4", count=n)
                cells[at] = np.minimum(cells[at].astype(np.uint16) + np.frombuffer(blob, dtype=np.uint8, offset=4 * n), least).astype(np.uint8)
        for block, cells in own.items():
            yield pd.DataFrame({"block": [block], "bits": [np.packbits(cells >= least, bitorder="little").tobytes()]})

    placed = rows.where("kind = 1").select("block", "cells").repartitionById(BLOCKS, F.col("block"))
    found = {r.block: bytes(r.bits) for r in placed.mapInPandas(frugal(run), "block int, bits binary").collect()}
    return b"".join(found.get(b, bytes(width // 8)) for b in range(BLOCKS))


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, n: all words) and (lang, phrase, k, n) of all phrases of up to `longest` words that are there `least` times."""
    if not 0 < least < 256:
        raise ValueError("the least count must be from 1 to 255: a counter is a byte")
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("lang", "text")
    bitmap = kept = totals = out = None
    for k in range(1, longest + 1):
        rows = stash(counted(docs, k, bitmap, kept, least, k == longest), "phrase-counts")
        per = rows.where("kind = 0").groupBy("lang", "phrase").agg(F.max("hash").alias("hash"), F.sum("n").alias("n"))
        if k == 1:
            totals = stash(rows.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-words")
        found = stash(per.where(F.col("n") >= least).withColumn("k", F.lit(k)), f"phrases-{k}")
        out = found if out is None else out.unionByName(found)
        if k < longest:
            bitmap, kept = spark.sparkContext.broadcast(bitmap_of(rows, least)), KeyFilter(found, "hash")
    return totals, out.select("lang", "phrase", "k", "n")


def scored(totals: DataFrame, phrases: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of the phrases of two words and more, at their weakest cut. Products are decimals of 38 digits: exact."""
    long = phrases.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    cut = long.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumn("_left", F.expr("substring_index(phrase, ' ', cut)")).withColumn("_right", F.expr("substring_index(phrase, ' ', cut - k)"))
    part = lambda side, name: phrases.select(F.col("lang").alias(f"_{name}"), F.col("phrase").alias(side), F.col("n").alias(name))
    for side, name in (("_left", "l"), ("_right", "r")):
        p = part(side, name)
        cut = cut.join(p, (cut["lang"] == p[f"_{name}"]) & (cut[side] == p[side]), "inner").drop(p[side]).drop(f"_{name}", side)
    cut = cut.join(totals, "lang")
    whole = F.expr(f"({SCALE}BD * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cut.withColumn("score", whole).groupBy("lang", "phrase", "k").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("x"))
    return best.select("lang", "phrase", "k", "x.a", "x.l", "x.r", "x.n", "x.score")


def not_inside(phrases: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of found (lang, phrase, a) that no longer phrase holds that is there as often."""
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(F.col("_w"), i, m), " "))))
    subs = phrases.where("k > 2").withColumn("_w", words).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "n")
    most = subs.groupBy("lang", "phrase").agg(F.max("n").alias("_most"))
    return found.join(most, ["lang", "phrase"], "left").where(F.col("_most").isNull() | (F.col("_most") * 100 < F.col("a") * 100)).drop("_most")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases by score, then count, then text."""
    totals, phrases = frequent(docs, least, longest)
    rows = not_inside(phrases, scored(totals, phrases)).withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))).where(F.col("rank") <= top)
    ranked = best(best(rows, "lang", "_share").drop("rank"), "lang")  # so a language's last task takes SHARES * top rows at most
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
