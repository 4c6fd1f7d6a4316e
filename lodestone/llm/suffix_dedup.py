"""Suffix-array dedup: removes every byte that a SPAN-byte string covers which also starts earlier.

Earlier means in a smaller doc_id, or earlier in the same document; matches never cross documents; all strings
are judged on the input. The result is exact, and no text is gathered beyond its own task:

1. Anchors: of all GRAM-byte strings in any SPAN-byte window, those with the least hash are anchors, so equal
   windows have equal anchors at equal places. An anchor's context is what windows that hold it can reach.
   Anchors meet by hash. Where an anchor's whole context occurs earlier, it is covered. Copies within one batch
   are settled there and not sent, so a group of copies costs the batches it is in, not its size.
2. Only where one anchor has different contexts are their bytes needed. The suffixes that begin at such anchors
   are sorted: prefix polynomial hashes and a binary search give two suffixes' common extension, so a comparison
   takes logarithmic time; the merge sort compares many pairs at once. With the common extensions of neighbours
   in that order, and hashes of what is left of the anchors, windows fall into classes of equal strings. Classes
   are verified byte by byte; if hashes ever collide, bytes decide. All but a class's earliest window are covered.
3. Covered runs of each document merge; what is kept is hashed, or returned.

Null texts are empty. Texts shorter than SPAN lose nothing. Rows with a null doc_id come after all others. Rows
with equal doc_id and text are one document and share its result; rows with equal doc_id and other texts follow
each other in the order of their hashes. Other columns are not touched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, KeyFilter, buckets, bytes_of, frugal, mix64, numbered, packed, powers, prefix_hash, slice_hash, stash, to_buckets, tune

SPAN, GRAM = 100, 32
REACH = SPAN - GRAM  # bytes on either side of an anchor that its windows reach
PIECE = 1 << 17
FLUSH = 8 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
ANCHOR = np.dtype([("g", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("pos", "<u4")])
INTERVAL = np.dtype([("doc", "<i8"), ("a", "<u4"), ("b", "<u4")])
REQUEST = np.dtype([("doc", "<i8"), ("g", "<u8"), ("pos", "<u4")])
CONTEXT = np.dtype([("g", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("left", "u1"), ("right", "u1"), ("x", "u1", (REACH + SPAN,))])
INFO = np.dtype([("doc", "<i8"), ("n", "<u8"), ("sha", "S32")])
ROWS = "bucket int, kind int, blob binary"
COVERED, WANTED, INFOS, ANCHORS, TEXTS = range(5)


def sliding(least, x: np.ndarray, width: int) -> np.ndarray:
    """The minimum (or maximum) of each window of x, by doubling."""
    n, k = len(x) - width + 1, 1
    while 2 * k <= width:
        x = least(x[:-k], x[k:])
        k *= 2
    return least(x[:n], x[width - k : width - k + n])


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, gram hashes and context hashes of the anchors in texts that stand one after the other; bounds: their
    starts and the end."""
    found = []
    for lo in range(0, len(data), PIECE):
        a, b = max(0, lo - REACH), min(len(data), lo + PIECE + SPAN + REACH)
        x = data[a:b]
        if len(x) < SPAN:
            continue
        h = prefix_hash(x)
        at = np.arange(len(x) - GRAM + 1)
        g = np.minimum(slice_hash(h, at, at + GRAM), NONE - np.uint64(1)) | np.uint64(1)
        m = sliding(np.minimum, g, REACH + 1)
        inside = bounds[(bounds > a) & (bounds < b)] - a
        for s in inside.tolist():  # no window crosses the start of a text
            m[max(0, s - SPAN + 1) : s] = 0
        top = sliding(np.maximum, np.concatenate([np.zeros(REACH, dtype=np.uint64), m, np.zeros(REACH, dtype=np.uint64)]), REACH + 1)
        p = np.flatnonzero(top == g)
        p = p[(p + a >= lo) & (p + a < lo + PIECE)]
        if len(p):
            k = np.searchsorted(bounds, p + a, side="right")
            left, right = np.minimum(p + a - bounds[k - 1], REACH), np.minimum(bounds[k] - p - a, SPAN)
            c = slice_hash(h, p - left, p + right) ^ mix64(left.astype(np.uint64) + np.uint64(1))
            found.append((p + a, g[p], c))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def merged(rows: np.ndarray) -> np.ndarray:
    """Intervals of each document, without overlaps; touching ones become one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows["a"], rows["doc"]))]
    which = np.cumsum(np.append(True, rows["doc"][1:] != rows["doc"][:-1])) - 1
    b = rows["b"].astype(np.int64) + (which << 33)  # documents apart, so that one running maximum will do
    a = rows["a"].astype(np.int64) + (which << 33)
    reach = np.maximum.accumulate(b)
    first = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
    out = np.zeros(len(first), dtype=INTERVAL)
    out["doc"], out["a"] = rows["doc"][first], rows["a"][first]
    out["b"] = (reach[np.append(first[1:] - 1, len(rows) - 1)] & ((1 << 33) - 1)).astype(np.uint32)
    return out


def by_doc(rows: np.ndarray, kind: int, nb: int) -> pd.DataFrame:
    return packed((mix64(rows["doc"].view("<i8").astype(np.int64).view(np.uint64)) % np.uint64(nb)).astype(np.int64), rows).assign(kind=kind)[["bucket", "kind", "blob"]]


def later_copies(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor rows sorted by (g, c, doc, pos), and which have their gram and context in an earlier row."""
    rows = rows[np.lexsort((rows["pos"], rows["doc"], rows["c"], rows["g"]))]
    return rows, np.append(False, (rows["g"][1:] == rows["g"][:-1]) & (rows["c"][1:] == rows["c"][:-1]))


def squeeze(rows: np.ndarray) -> bytes:
    """Anchor rows column by column, documents as differences, compressed."""
    import zstandard

    rows = rows[np.lexsort((rows["pos"], rows["doc"]))]
    step = np.diff(rows["doc"], prepend=np.int64(0)).astype("<i8")
    body = b"".join([rows["g"].tobytes(), rows["c"].tobytes(), step.view("u1").reshape(-1, 8).T.tobytes(), np.ascontiguousarray(rows["pos"]).view("u1").reshape(-1, 4).T.tobytes()])
    return zstandard.ZstdCompressor(level=1).compress(body)


def expand(blob: bytes) -> np.ndarray:
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(blob)
    n = len(body) // 28
    out = np.zeros(n, dtype=ANCHOR)
    raw = np.frombuffer(body, dtype="u1")
    out["g"], out["c"] = raw[: 8 * n].view("<u8"), raw[8 * n : 16 * n].view("<u8")
    out["doc"] = np.cumsum(np.ascontiguousarray(raw[16 * n : 24 * n].reshape(8, n).T).view("<i8")[:, 0])
    out["pos"] = np.ascontiguousarray(raw[24 * n :].reshape(4, n).T).view("<u4")[:, 0]
    return out


def lengths_of(rows: np.ndarray, sizes: dict) -> np.ndarray:
    return np.fromiter((sizes[d] for d in rows["doc"].tolist()), dtype=np.int64, count=len(rows))


class Collector:
    """Takes texts, gives packed rows: anchors by gram, what is covered already, and each text's length and hash."""

    def __init__(self, nb: int) -> None:
        self.nb, self.docs, self.raw, self.size = nb, [], [], 0

    def add(self, doc: int, raw: bytes):
        self.docs.append(doc)
        self.raw.append(raw)
        self.size += len(raw)

    def flush(self):
        if not self.docs:
            return
        info = np.zeros(len(self.docs), dtype=INFO)
        docs = np.array(self.docs, dtype=np.int64)
        sizes = np.array([len(x) for x in self.raw], dtype=np.int64)
        info["doc"], info["n"], info["sha"] = docs, sizes, [hashlib.sha256(x).digest() for x in self.raw]
        yield by_doc(info, INFOS, self.nb)
        bounds = np.append(0, np.cumsum(sizes))
        p, g, c = anchors(np.frombuffer(b"".join(self.raw), dtype=np.uint8), bounds)
        if len(p):
            k = np.searchsorted(bounds, p, side="right") - 1
            rows = np.zeros(len(p), dtype=ANCHOR)
            rows["g"], rows["c"], rows["doc"], rows["pos"] = g, c, docs[k], p - bounds[k]
            rows, again = later_copies(rows)
            yield from self.covered(rows[again], dict(zip(self.docs, sizes.tolist())))
            rows = rows[~again]
            bucket = (mix64(rows["g"]) % np.uint64(self.nb)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
            groups = np.split(order, cut[1:])
            yield pd.DataFrame({"bucket": bucket[order][cut].astype("int32"), "kind": ANCHORS, "blob": [squeeze(rows[o]) for o in groups]})
        self.docs, self.raw, self.size = [], [], 0

    def covered(self, rows: np.ndarray, sizes: dict):
        if len(rows):
            out = np.zeros(len(rows), dtype=INTERVAL)
            pos = rows["pos"].astype(np.int64)
            out["doc"], out["a"], out["b"] = rows["doc"], np.maximum(pos - REACH, 0), np.minimum(pos + SPAN, lengths_of(rows, sizes))
            yield by_doc(merged(out), COVERED, self.nb)


def suffix_order(h: np.ndarray, x: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts suffixes x[i, :size[i]] within groups (equal numbers stand together), by merging. h: prefix hashes of
    the rows. Gives the order, and each suffix' common extension with the one before it (0 at a group's first)."""

    def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(i), dtype=np.int64), np.minimum(size[i], size[j])
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = h[i, mid] == h[j, mid]  # all suffixes begin at the same power, so prefixes compare as they are
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def before(i: np.ndarray, j: np.ndarray, equal: bool) -> np.ndarray:
        """Whether suffix i comes before j; `equal`: what holds for equal suffixes."""
        c = common(i, j)
        ended = (c == size[i]) | (c == size[j])
        at = np.minimum(c, x.shape[1] - 1)
        return np.where(ended, np.where(size[i] == size[j], equal, size[i] < size[j]), x[i, at] < x[j, at])

    n = len(group)
    order = np.arange(n)
    start = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), np.arange(n), 0))
    stop = np.append(np.flatnonzero(np.append(False, group[1:] != group[:-1])), n)[np.cumsum(np.append(False, group[1:] != group[:-1]))]
    width = 1
    while True:
        local = np.arange(n) - start
        block = local // (2 * width) * (2 * width) + start  # where the pair of runs begins
        middle, end = np.minimum(block + width, stop), np.minimum(block + 2 * width, stop)
        todo = np.flatnonzero(middle < end)
        if not len(todo) and not ((stop - start) > width).any():
            break
        mine = local % (2 * width) < width
        place = np.arange(n)
        left = mine[todo]
        low, high = np.where(left, middle[todo], block[todo]), np.where(left, end[todo], middle[todo])
        base = low.copy()
        me = order[todo]
        while (open_ := low < high).any():  # how many of the other run come before me
            k = np.flatnonzero(open_)
            mid = (low[k] + high[k]) // 2
            first = before(order[mid], me[k], False)
            ties = ~first & ~left[k]
            if ties.any():  # elements of the right run come after equal ones of the left run
                t = np.flatnonzero(ties)
                first[t] = before(order[mid[t]], me[k][t], True)
            low[k], high[k] = np.where(first, mid + 1, low[k]), np.where(first, high[k], mid)
        place[todo] = np.where(left, todo + (low - base), block[todo] + (low - base) + (todo - middle[todo]))
        new = np.empty(n, dtype=np.int64)
        new[place] = order
        order = new
        width *= 2
    lcp = np.zeros(n, dtype=np.int64)
    k = np.flatnonzero(np.append(False, group[1:] == group[:-1]))
    lcp[k] = common(order[k - 1], order[k])
    return order, lcp


def covered_windows(rows: np.ndarray) -> np.ndarray:
    """What windows around anchors with several contexts cover. rows: CONTEXT rows, all of each gram in it."""
    rows = rows[np.lexsort((rows["pos"], rows["doc"], rows["g"]))]
    change = np.append(True, rows["g"][1:] != rows["g"][:-1])
    group = np.cumsum(change)
    x = np.ascontiguousarray(rows["x"])
    right = np.ascontiguousarray(x[:, REACH:])
    size = rows["right"].astype(np.int64)
    h = np.stack([np.zeros(len(rows), dtype=np.uint64), *np.cumsum(_powered(right), axis=1, dtype=np.uint64).T], axis=1)
    order, lcp = suffix_order(h, right, size, group)
    rows, x, group = rows[order], x[order], group[order]
    left, size = rows["left"].astype(np.int64), size[order]
    rank = np.empty(len(rows), dtype=np.int64)
    rank[np.lexsort((rows["pos"], rows["doc"]))] = np.arange(len(rows))
    least, most = np.full(len(rows), SPAN), np.full(len(rows), -1)
    tail = np.zeros(len(rows), dtype=np.uint64)  # hash of the t bytes left of the anchor
    for t in range(REACH + 1):
        if t:
            tail = mix64(tail ^ (x[:, REACH - t].astype(np.uint64) + np.uint64(256 * t + 1)))
        fits = (left >= t) & (size >= SPAN - t)
        if not fits.any():
            continue
        run = np.cumsum(np.append(True, (lcp[1:] < SPAN - t) | (group[1:] != group[:-1])))
        k = np.flatnonzero(fits)
        key = mix64(run[k].astype(np.uint64)) ^ tail[k]
        by = np.lexsort((rank[k], key))
        new = np.append(True, key[by][1:] != key[by][:-1])
        head = k[by[np.flatnonzero(new)]][np.cumsum(new) - 1]
        own = k[by]
        again = own != head
        own, head = own[again], head[again]
        same = (x[own, REACH - t : REACH - t + SPAN] == x[head, REACH - t : REACH - t + SPAN]).all(axis=1)
        if not same.all():  # hashes collided: bytes decide
            _, which = np.unique(x[k, REACH - t : REACH - t + SPAN], axis=0, return_inverse=True)
            first = np.full(which.max() + 1, len(rows))
            np.minimum.at(first, which.ravel(), rank[k])
            own = k[rank[k] != first[which.ravel()]]
        least[own], most[own] = np.minimum(least[own], t), np.maximum(most[own], t)
    k = np.flatnonzero(most >= 0)
    out = np.zeros(len(k), dtype=INTERVAL)
    out["doc"], out["a"], out["b"] = rows["doc"][k], rows["pos"][k] - most[k], rows["pos"][k] - least[k] + SPAN  # windows over one anchor overlap
    return out


def _powered(x: np.ndarray) -> np.ndarray:
    return _BYTE[x] * powers(x.shape[1])[0][None, :]


def context_rows(doc: int, raw: bytes, wanted: np.ndarray) -> np.ndarray:
    data = np.frombuffer(raw, dtype=np.uint8)
    pos = wanted["pos"].astype(np.int64)
    out = np.zeros(len(wanted), dtype=CONTEXT)
    out["g"], out["doc"], out["pos"] = wanted["g"], doc, wanted["pos"]
    out["left"], out["right"] = np.minimum(pos, REACH), np.minimum(len(data) - pos, SPAN)
    at = pos[:, None] + np.arange(-REACH, SPAN)[None, :]
    good = (at >= 0) & (at < len(data))
    out["x"] = np.where(good, data[np.clip(at, 0, max(0, len(data) - 1))], 0)
    return out


def kept(raw: bytes, spans: np.ndarray) -> bytes:
    edge = [0, *np.stack([spans["a"], spans["b"]], axis=1).ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2]))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a unique `doc` in the order of doc_id. If doc_ids are null or repeat, rows are numbered."""
    as_long = F.col("doc_id").cast("long")
    ids = docs.groupBy(as_long.alias("i")).count()
    if not ids.where("count > 1 or i is null").head(1):
        return docs.withColumn("doc", as_long)
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    keys = docs.select(as_long.alias("_i"), h.alias("_h")).distinct().withColumn("_none", F.col("_i").isNull())
    keys = stash(numbered(keys, ["_none", "_i", "_h"], "_doc").select("_i", "_h", "_doc"), "suffix-keys")
    return docs.drop("doc").join(keys, as_long.eqNullSafe(F.col("_i")) & (h == F.col("_h"))).withColumn("doc", F.col("_doc")).drop("_i", "_h", "_doc")


def _exchange(df: DataFrame, work) -> DataFrame:
    """work: generator over the frames of a partition that holds all rows of its buckets."""
    return to_buckets(df).mapInPandas(frugal(work), ROWS)


def spans(keyed: DataFrame) -> DataFrame:
    """Rows of kind COVERED (removed intervals by document) and INFOS, packed by document."""
    spark = keyed.sparkSession
    nb = buckets(spark)

    def scan(frames):
        c = Collector(nb)
        for pdf in frames:
            seen: set[int] = set()
            for doc, text in zip(pdf["doc"].tolist(), pdf["text"]):
                if doc in seen:
                    continue
                seen.add(doc)
                c.add(doc, bytes_of(text))
                if c.size >= FLUSH:
                    yield from c.flush()
        yield from c.flush()

    def meet(frames):
        got = []
        for pdf in frames:
            passing = pdf["kind"] != ANCHORS
            if passing.any():
                yield pdf[passing]
            got += [expand(b) for b in pdf["blob"][~passing]]
        if not got:
            return
        rows, again = later_copies(np.unique(np.concatenate(got)))
        if again.any():  # lengths are known where intervals are used
            out = np.zeros(again.sum(), dtype=INTERVAL)
            pos = rows["pos"][again].astype(np.int64)
            out["doc"], out["a"], out["b"] = rows["doc"][again], np.maximum(pos - REACH, 0), pos + SPAN
            yield by_doc(merged(out), COVERED, nb)
        rows = rows[~again]
        same = rows["g"][1:] == rows["g"][:-1]
        several = np.append(False, same) | np.append(same, False)
        if several.any():
            ask = np.zeros(several.sum(), dtype=REQUEST)
            for f in ("doc", "g", "pos"):
                ask[f] = rows[f][several]
            yield by_doc(ask, WANTED, nb)

    first = stash(_exchange(keyed.select("doc", "text").mapInPandas(frugal(scan), ROWS), meet), "suffix-anchors")

    def fetch(frames):
        texts, ask = {}, []
        for pdf in frames:
            for kind, blob in zip(pdf["kind"], pdf["blob"]):
                if kind == TEXTS:
                    texts[int.from_bytes(blob[:8], "little", signed=True)] = blob[8:]
                else:
                    ask.append(np.frombuffer(blob, dtype=REQUEST))
        if not ask:
            return
        ask = np.concatenate(ask)
        ask = ask[np.argsort(ask["doc"], kind="stable")]
        cut = np.flatnonzero(np.append(True, ask["doc"][1:] != ask["doc"][:-1])) if len(ask) else []
        held, n = [], 0
        for part in np.split(ask, cut[1:]):
            held.append(context_rows(int(part["doc"][0]), texts[int(part["doc"][0])], part))
            n += len(part)
            if n >= 100_000:
                yield _by_gram(np.concatenate(held), nb)
                held, n = [], 0
        if held:
            yield _by_gram(np.concatenate(held), nb)

    def resolve(frames):
        blobs = [b for pdf in frames for b in pdf["blob"]]
        if not blobs:
            return
        rows = np.unique(np.frombuffer(b"".join(blobs), dtype=CONTEXT).view(f"V{CONTEXT.itemsize}")).view(CONTEXT)  # equal documents ask twice
        rows = rows[np.argsort(rows["g"], kind="stable")]
        change = np.flatnonzero(np.append(True, rows["g"][1:] != rows["g"][:-1]))
        a = 0
        while a < len(rows):  # whole grams, some thousand rows at a time
            b = change[np.searchsorted(change, a + 20_000)] if a + 20_000 <= change[-1] else len(rows)
            out = merged(covered_windows(rows[a:b]))
            if len(out):
                yield by_doc(out, COVERED, nb)
            a = b

    wanted = first.where(F.col("kind") == WANTED)
    contexts = _exchange(wanted.unionByName(texts_of(keyed, wanted, REQUEST, nb)), fetch)
    second = stash(_exchange(contexts, resolve), "suffix-windows")
    return first.where(F.col("kind").isin(COVERED, INFOS)).unionByName(second)


def _by_gram(rows: np.ndarray, nb: int) -> pd.DataFrame:
    return packed((mix64(rows["g"]) % np.uint64(nb)).astype(np.int64), rows).assign(kind=WANTED)[["bucket", "kind", "blob"]]


def texts_of(keyed: DataFrame, rows: DataFrame, dtype: np.dtype, nb: int) -> DataFrame:
    """The texts of documents that packed rows name, and a few others, as rows of kind TEXTS."""

    def docs_in(frames):
        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame({"doc": np.unique(np.concatenate([np.frombuffer(b, dtype=dtype)["doc"] for b in pdf["blob"]]))})

    needed = KeyFilter(rows.mapInPandas(frugal(docs_in), "doc long"), "doc")

    def send(frames):
        for pdf in frames:
            pdf = pdf[needed.has(pdf["doc"].to_numpy())] if len(pdf) else pdf
            if len(pdf):
                doc = pdf["doc"].to_numpy().astype("<i8")
                bucket = (mix64(doc.astype(np.int64).view(np.uint64)) % np.uint64(nb)).astype("int32")
                yield pd.DataFrame({"bucket": bucket, "kind": TEXTS, "blob": [d.tobytes() + bytes_of(t) for d, t in zip(doc, pdf["text"])]})

    return keyed.select("doc", "text").mapInPandas(frugal(send), ROWS)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""
    keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return keyed.select("doc_id", "doc").join(_finished(keyed, False), "doc").drop("doc")


def rewrite(docs: DataFrame) -> DataFrame:
    """docs with the kept text of each row in place of its text; a character that a cut goes through is dropped whole.
    Rows that lose all of their text go; a column n_chars is set anew where a text has changed. Other columns stay."""
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    keyed = _keyed(rows)
    done = _finished(keyed, True).select("doc", "n_bytes", "n_removed", "kept")
    x = keyed.drop("doc_id").join(done, "doc").where("n_removed < n_bytes or n_bytes = 0")
    changed = F.col("n_removed") > 0
    put = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("kept")).otherwise(F.col(f"c{docs.columns.index('n_chars')}"))} if "n_chars" in docs.columns else {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    return x.select(*(put.get(c, F.col(f"c{k}")).cast(docs.schema[k].dataType).alias(c) for k, c in enumerate(docs.columns)))


def _finished(keyed: DataFrame, with_text: bool) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (null where nothing is removed)."""
    tune(keyed.sparkSession)
    nb = buckets(keyed.sparkSession)
    keyed = keyed.select("doc", "text")
    found = spans(keyed)
    covered = found.where(F.col("kind") == COVERED)
    texts = texts_of(keyed, covered, INTERVAL, nb)
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text

    def finish(frames):
        texts, info, cover = {}, [], []
        for pdf in frames:
            for kind, blob in zip(pdf["kind"], pdf["blob"]):
                if kind == TEXTS:
                    texts[int.from_bytes(blob[:8], "little", signed=True)] = blob[8:]
                else:
                    (info if kind == INFOS else cover).append(np.frombuffer(blob, dtype=INFO if kind == INFOS else INTERVAL))
        if not info:
            return
        cover = merged(np.concatenate(cover)) if cover else np.zeros(0, dtype=INTERVAL)
        rows = []
        info = np.concatenate(info)
        first = np.searchsorted(cover["doc"], info["doc"], side="left")
        last = np.searchsorted(cover["doc"], info["doc"], side="right")
        done = set()
        for d, n, sha, a, b in zip(info["doc"].tolist(), info["n"].tolist(), info["sha"], first.tolist(), last.tolist()):
            if d in done:
                continue
            done.add(d)
            own = cover[a:b].copy()
            own["b"] = np.minimum(own["b"], n)
            if a == b:
                rows.append((d, n, 0, 0, sha.ljust(32, b"\0").hex(), None))
            else:
                rest = kept(texts[d], own)
                rows.append((d, n, n - len(rest), b - a, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None))
            if len(rows) >= 2000:
                yield frame(rows)
                rows = []
        if rows:
            yield frame(rows)

    def frame(rows):
        out = pd.DataFrame(rows, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        return out if with_text else out.drop(columns="kept")

    return to_buckets(found.unionByName(texts)).mapInPandas(frugal(finish), schema)
