"""Approximate nearest neighbours by shifted space-filling curves.

Each curve turns the vectors by its own random rotation, keeps DIMS coordinates, shifts them by a random offset
and orders the vectors along a Hilbert curve (BITS bits a coordinate, of the vectors at length 1); vectors of one
cell of it follow a curve of FINE bits through the same coordinates as they are, so near vectors that fill a cell
stand by nearness, on each curve in another order. Spark range-partitions each order; a query
takes the rows of a window around its place on every curve, measures the true distance in double precision and
keeps its k best there; the curves' lists merge and the k best of all are the answer.

`window` is a share of the rows on each side of a query. Vectors with 64 nearly independent coordinates have no
few near places on a curve, so windows must be wide for recall; their share does not depend on the table's size.
The set of queries is stated (by default every hundredth row), so work is queries x windows of all curves, in blocks.

Rows whose vector is null, zero or has null or non-finite components, or another length than the most common one,
take no part. Equal distances go to the smaller vec_id. A query is never its own candidate; a repeated vec_id counts once,
with its least vector. Rows with a null vec_id take no part. Other columns of the table are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stash, tune

CURVES, DIMS, BITS, WINDOW, SEED = 32, 8, 4, 0.012, 7
#: Bits of a coordinate on the curve inside a cell; it reaches to 16 times the vectors' usual length on each side.
FINE = 32
#: Rows in a cell of a curve, and places of queries in a block: they bound what a task holds.
CELL, BLOCK = 4096, 8192


def _turned(cells: np.ndarray, bits: int) -> np.ndarray:
    """Rows of digits, shape (dims, rows): their bits, the highest first and dims in turn, are the places on the curve."""
    x = cells.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    return x


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates, shape (rows, dims); bits * dims <= 62."""
    x = _turned(cells, bits)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            out = out << 1 | (row >> b & 1)
    return out


def hilbert_bytes(cells: np.ndarray, bits: int) -> list[bytes]:
    """The same places as bytes that sort like them, of any number of bits."""
    x = _turned(cells, bits)
    digits = np.stack([(x >> b & 1).astype(np.uint8) for b in range(bits - 1, -1, -1)])  # bits, dims, rows
    flat = np.packbits(digits.reshape(-1, x.shape[1]), axis=0).T
    return [r.tobytes() for r in flat]


def projections(width: int, curves: int, dims: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, shift) of each curve: rows of a random rotation, and an offset in cells."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < curves:
        turned = np.linalg.qr(rng.standard_normal((width, width)))[0]
        out += [(turned[:, i : i + dims], rng.random(min(dims, width - i))) for i in range(0, width, dims) if width - i >= min(dims, width)]
    return out[:curves]


def nearest_inside(q: np.ndarray, x: np.ndarray, ids: np.ndarray, inside: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest among its rows, ties to the smaller id. A matrix product gives all distances
    nearly; rows within its error of the k-th are measured in full."""
    xx = (x * x).sum(axis=1)
    about = np.where(inside, xx[None, :] - 2 * q @ x.T, np.inf)
    edge = np.partition(about, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
    i, j = np.nonzero(inside & (about <= (edge + 1e-9 * (xx.max() + (q * q).sum(axis=1)))[:, None]))
    d = np.sqrt(((x[j] - q[i]) ** 2).sum(axis=1))
    order = np.lexsort((ids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], d[first]


def valid(embeddings: DataFrame, vector: str) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part; of repeated vec_ids the least vector stays."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(good & F.col("vec_id").isNotNull())
    common = x.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).select("width")
    return x.join(F.broadcast(common), F.size("v") == F.col("width")).drop("width").groupBy("vec_id").agg(F.min("v").alias("v"))  # one row


def search(embeddings: DataFrame, k: int = 10, every: int = 100, vector: str = "embedding", curves: int = CURVES, dims: int = DIMS, bits: int = BITS, window: float = WINDOW, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest found of each query (vec_id divisible by `every`).

    Equal vectors are one class with its k + 1 smallest ids: no query can need more of them."""
    spark = embeddings.sparkSession
    tune(spark)
    rows = stash(valid(embeddings, vector), "ann-vectors")
    first = rows.select("v").head()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    least = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = stash(least.groupBy("v").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-classes")
    queries = stash(rows.where(F.col("vec_id") % every == 0).join(classes.select("v", "cid"), "v").select(F.col("vec_id").alias("query_id"), "cid"), "ann-queries")
    near = _nearest_classes(classes.select("cid", "v"), queries.select("cid").distinct(), len(first.v), k, curves, dims, bits, window, seed)
    # a class's list: the k + 1 first ids of its nearest classes, of which its own is one
    own = queries.select("cid").distinct().select("cid", F.col("cid").alias("near"), F.lit(0.0).alias("score"))
    listed = near.unionByName(own).join(classes.select(F.col("cid").alias("near"), "ids"), "near").select("cid", "score", F.explode("ids").alias("vec_id"))
    best = listed.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    found = queries.join(best, "cid").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest_classes(points: DataFrame, wanted: DataFrame, width: int, k: int, curves: int, dims: int, bits: int, window: float, seed: int) -> DataFrame:
    """cid, near, score: of each wanted class the k nearest others that its windows hold."""
    planes = projections(width, curves, dims, seed)
    usual = points.agg(F.percentile_approx(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 0.5).alias("n")).head().n or 1.0

    def place(frames):
        for pdf in frames:
            if len(pdf):
                x = np.array(pdf["v"].tolist())
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                for c, (m, shift) in enumerate(planes):
                    cells = np.clip(np.floor((unit @ m) * np.sqrt(width) * 2 ** (bits - 3) + 2 ** (bits - 1) + shift - 0.5), 0, 2**bits - 1)
                    inside = np.clip(np.floor(((x / usual) @ m / 16 + 1) * 2.0 ** (FINE - 1)), 0, 2**FINE - 1)
                    key = [a + b for a, b in zip(hilbert_bytes(cells, bits), hilbert_bytes(inside, FINE))]
                    yield pd.DataFrame({"curve": np.full(len(x), c, dtype="int32"), "key": key, "cid": pdf["cid"]})

    order = ("curve", "key", "cid")
    placed = points.mapInPandas(place, "curve int, key binary, cid long").repartitionByRange(max(parts(points.sparkSession), curves), *order).sortWithinPartitions(*order)
    placed = stash(placed.withColumn("part", F.spark_partition_id()), "ann-curves")
    # A row's place: the rows of earlier partitions, and those before it in its own, which is a bounded range.
    by = Window.partitionBy("curve")
    before = placed.groupBy("curve", "part").agg(F.count("*").alias("n")).select("curve", "part", (F.sum("n").over(by.orderBy("part")) - F.col("n")).alias("base"), F.sum("n").over(by).alias("all"))
    ranked = placed.join(before, ["curve", "part"]).withColumn("at", F.col("base") + F.row_number().over(Window.partitionBy("curve", "part").orderBy("key", "cid")) - 1)
    ranked = ranked.select("curve", F.floor(F.col("at") / CELL).alias("cell"), "at", "all", "cid").join(points, "cid")
    ranked = stash(ranked.repartition(parts(points.sparkSession), "curve", "cell"), "ann-ranked")

    def pack(pdf):
        return pd.DataFrame({"curve": pdf["curve"].iloc[:1], "cell": pdf["cell"].iloc[:1], "ids": [pdf["cid"].to_numpy()], "ats": [pdf["at"].to_numpy()], "vs": [np.array(pdf["v"].tolist(), dtype="<f8").tobytes()]})

    blocks = ranked.select("curve", "cell", "at", "cid", "v").groupBy("curve", "cell").applyInPandas(pack, "curve int, cell long, ids array<long>, ats array<long>, vs binary")  # CELL rows at most
    reach = F.greatest(F.lit(4 * k).cast("long"), F.ceil(F.col("all") * window).cast("long"))
    asked = ranked.join(wanted, "cid", "left_semi").withColumn("lo", F.greatest(F.col("at") - reach, F.lit(0))).withColumn("hi", F.least(F.col("at") + reach, F.col("all") - 1))
    asked = asked.select("curve", F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor(F.col("hi") / CELL))).alias("cell"), "cid", "lo", "hi", "v")
    asked = asked.withColumn("block", F.floor(F.col("lo") / BLOCK)).groupBy("curve", "cell", "block").agg(F.collect_list(F.struct("cid", "lo", "hi", "v")).alias("asked"))  # BLOCK rows at most, but for the edge

    def measure(frames):
        for pdf in frames:
            for ids, at, vs, qs in zip(pdf["ids"], pdf["ats"], pdf["vs"], pdf["asked"]):
                x, at, ids = np.frombuffer(vs, dtype="<f8").reshape(len(ids), -1), np.asarray(at), np.asarray(ids)
                for a in range(0, len(qs), 256):
                    own = qs[a : a + 256]
                    cid, lo, hi = (np.array([r[f] for r in own], dtype=np.int64)[:, None] for f in ("cid", "lo", "hi"))
                    q = np.array([r["v"] for r in own])
                    inside = (at >= lo) & (at <= hi) & (ids != cid)
                    i, j, d = nearest_inside(q, x, ids, inside, k)
                    yield pd.DataFrame({"cid": cid[i, 0], "near": ids[j], "score": d})

    found = blocks.join(asked, ["curve", "cell"]).select("ids", "ats", "vs", "asked").mapInPandas(measure, "cid long, near long, score double")
    found = found.groupBy("cid", "near").agg(F.min("score").alias("score"))  # every curve measures the same
    return found.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("score", "near"))).where(F.col("r") <= k).drop("r")
