"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text are byte-class shares, word and line shape and repetition; labels, language, source
and ids are no input. Trees are fitted in numpy on a bounded sample of labelled rows (SAMPLE_ROWS), whatever
the corpus' size, flattened into arrays and applied to batches: at each level all rows of a batch move to
their child at once. A document's statistics are made from its whole text, which is in memory once; null and empty texts
have statistics of zero and a score like others.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, frugal, text_of, tune

#: Labelled rows that are used for fitting, at most: the bound of the sample.
SAMPLE_ROWS = 12_000
NAMES = (
    "log_bytes log_words word_len upper digit space other_ascii non_ascii bang star hash dollar percent amp bar at dot comma entropy "
    "distinct top_word top3 line_len lines_dup repeat_next max_run long_words short_words symbol_end caps_words dup_grams spread"
).split()
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 4
_CLASS[128:] = 5


def features(text: str | None) -> np.ndarray:
    """Statistics of one whole text; null and empty texts get zeros."""
    out = np.zeros(len(NAMES))
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    hist = np.bincount(raw, minlength=256)
    n = len(raw)
    kinds = np.bincount(_CLASS, weights=hist, minlength=6) / n
    words = text.split()
    m = max(1, len(words))
    count = Counter(words)
    top = [c for _, c in count.most_common(3)] + [0, 0, 0]
    share = hist[hist > 0] / n
    lines = [x for x in text.split("\n") if x]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    same = sum(map(str.__eq__, words, words[1:]))
    grams = list(zip(words, words[1:], words[2:]))
    out[:] = [
        np.log1p(n), np.log1p(len(words)), n / m, *kinds[1:], *(hist[[33, 42, 35, 36, 37, 38, 124, 64, 46, 44]] / n),
        -(share * np.log(share)).sum(), len(count) / m, top[0] / m, sum(top[:3]) / m, n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        same / m, np.log1p(lengths.max()), (lengths > 14).mean(), (lengths < 3).mean(),
        sum(w[-1] in "!*#$%&|" for w in words) / m, sum(map(str.isupper, words)) / m, 1 - len(set(grams)) / max(1, len(grams)), lengths.std(),
    ]
    return out


def feature_matrix(texts) -> np.ndarray:
    return np.array([features(text_of(t)) for t in texts]).reshape(-1, len(NAMES))


@dataclass
class Trees:
    """All trees in flat arrays; node 0 of each tree is its root. A leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            right = x[rows, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(f < 0, at, self.left[at] + right)
        return self.bias + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, l2: float = 2.0, least: int = 10) -> Trees:
    """Boosts log loss on histograms of quantile bins. Without rows, or with one class only, the bias alone is left."""
    good = float(y.sum()) + 1
    bias = float(np.log(good / (len(y) - y.sum() + 1)))
    flat: dict[str, list] = {"feature": [], "threshold": [], "left": [], "value": []}
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
        margin = np.full(len(y), bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            root = len(flat["feature"])
            roots.append(root)
            for k in flat:
                flat[k].append(-1 if k == "feature" else 0.0 if k != "left" else 0)
            node, open_nodes = np.full(len(y), root), [root]
            for level in range(depth + 1):
                following = []
                for at in open_nodes:
                    rows = np.flatnonzero(node == at)
                    sg, sh = g[rows].sum(), h[rows].sum()
                    best, gain0 = (1e-3, -1, 0), sg * sg / (sh + l2)
                    if level < depth and len(rows) >= 2 * least:
                        for j, c in enumerate(cuts):
                            if len(c):
                                b = binned[j, rows]
                                lg, lh, ln = (np.cumsum(np.bincount(b, w, minlength=len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                                gain = lg * lg / (lh + l2) + (sg - lg) ** 2 / (sh - lh + l2) - gain0
                                gain[(ln < least) | (len(rows) - ln < least)] = 0
                                k = int(gain.argmax())
                                if gain[k] > best[0]:
                                    best = (gain[k], j, k)
                    if best[1] < 0:
                        flat["value"][at] = rate * sg / (sh + l2)
                        margin[rows] += flat["value"][at]
                        continue
                    _, j, k = best
                    child = len(flat["feature"])
                    for name in flat:
                        flat[name] += [-1, -1] if name == "feature" else [0, 0] if name == "left" else [0.0, 0.0]
                    flat["feature"][at], flat["threshold"][at], flat["left"][at] = j, float(cuts[j][k]), child
                    node[rows] = child + (binned[j, rows] > k)
                    following += [child, child + 1]
                open_nodes = following
    if not roots:
        flat, roots = {"feature": [-1], "threshold": [0.0], "left": [0], "value": [0.0]}, [0]
    return Trees(np.array(flat["feature"], dtype=np.int64), np.array(flat["threshold"]), np.array(flat["left"], dtype=np.int64), np.array(flat["value"], dtype=float), np.array(roots), depth, bias)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Fits on the labelled rows that are not held out (crc32 of doc_id modulo 4 is not 2). Null labels and
    labels without a document count for nothing; a document with both labels counts as 1 from half up."""
    tune(docs.sparkSession)
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc32_of("doc_id") % 4 != 2)).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # its size is bounded, so it may be broadcast
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = own.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # a repeated doc_id gives one row, so the bound holds

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": list(feature_matrix(pdf["text"]))})

    got = rows.mapInPandas(frugal(run), "doc_id long, y double, x array<double>").toPandas()
    if not len(got):
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort((*x.T[::-1], got["doc_id"].to_numpy()))
    return fit(x[order], (got["y"].to_numpy()[order] >= 0.5).astype(float))


def score(docs: DataFrame, model: Trees, threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Repeated rows stay; a null doc_id is not held out."""
    tune(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc32_of("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "text")

    def run(frames):
        for pdf in frames:
            s = model.score(feature_matrix(pdf["text"])) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "score": s, "predicted": (s >= threshold).astype("int32")})

    return src.mapInPandas(frugal(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Trees, threshold: float = 0.7) -> DataFrame:
    """The rows whose score reaches the threshold, with all columns of docs; any column may be null or clash in name."""
    tune(docs.sparkSession)

    def run(frames):
        for pdf in frames:
            if len(pdf):
                yield pdf[model.score(feature_matrix(pdf["text"])) >= threshold]

    return docs.mapInPandas(frugal(run), docs.schema)
