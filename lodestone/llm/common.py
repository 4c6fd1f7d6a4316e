"""Helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts can be long, so batches are smaller than Spark's default.
BATCH_ROWS = 2000
#: Bytes in an Arrow batch.
BATCH_BYTES = 16 << 20

#: White space and words of the word contracts.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_TABLE = str.maketrans(UPPER, LOWER)


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches; a value that the caller has set lower stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set a local session gets a temporary one; a cluster's
    executors couldn't see that, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends here and a lost executor
    costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of(col: str | Column) -> Column:
    """CRC-32 of an integer's decimal text."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file: in LODESTONE_TOKENIZERS if set, else in the installed package."""
    if (folder := os.environ.get("LODESTONE_TOKENIZERS")) and os.path.exists(f"{folder}/{name}"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_POWERS: dict[str, np.ndarray] = {}
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        m = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.full(m, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with len(data)+1 entries; the hash of data[i:j] is (H[j] - H[i]) * BASE**-i modulo 2**64."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of many slices of one text; equal bytes get equal hashes wherever they stand."""
    return mix64((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BLANK_ONLY = np.zeros(256, dtype=bool)
BLANK_ONLY[0x20] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def word_spans(data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are not ASCII white space, or not in another table)."""
    edge = np.diff(np.concatenate(([True], space[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


#: Bytes whose words are hashed at a time; longer only if one word is.
PIECE = 1 << 19


def word_hashes(data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a text, or of texts with a blank between them. Memory beyond the result is bounded."""
    start, end = word_spans(data, space)
    out, k = np.empty(len(start), dtype=np.uint64), 0
    while k < len(start):
        a = start[k]
        m = max(k + 1, int(np.searchsorted(end, a + PIECE, side="right")))
        out[k:m] = slice_hash(prefix_hash(data[a : end[m - 1]]), start[k:m] - a, end[k:m] - a)
        k = m
    return start, end, out


class WordIds:
    """Ids of texts word by word, where words are ended by the bytes of `space`: a table from a word's 64-bit hash to
    its ids. New words are given to encode(list of words) -> packed ids of each (or their sizes, starts, and all ids); spans: to
    encode(data, starts, ends) instead. Bounded: a full table starts again, which
    costs time but changes no result."""

    def __init__(self, encode, dtype: str, space: np.ndarray = _SPACE, limit: int = 1_200_000, spans: bool = False) -> None:
        self.encode, self.dtype, self.space, self.limit, self.spans = encode, np.dtype(dtype), space, limit, spans
        self.clear()

    def clear(self) -> None:
        self.known, self.at, self.size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.flat, self.used = np.zeros(1 << 20, dtype=self.dtype), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rows of sorted hashes in the table, -1 for new ones."""
        if not len(self.known):
            return np.full(len(h), -1, dtype=np.int64)
        k = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[k] == h, k, -1)

    def learn(self, h: np.ndarray, got: list[bytes] | tuple) -> None:
        if isinstance(got, tuple):
            size, at, new = got
        else:
            size = np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // self.dtype.itemsize
            at, new = np.cumsum(size) - size, np.frombuffer(b"".join(got), dtype=self.dtype)
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(new), self.used // 2), dtype=self.dtype)])
        at = at + self.used
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)
        place = np.searchsorted(self.known, h)
        self.known, self.at, self.size = np.insert(self.known, place, h), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def rows(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Rows in the table of distinct, sorted hashes; new words are learned from where they stand first."""
        row = self.find(h)
        if (new := row < 0).any():
            if len(self.known) + new.sum() > self.limit:
                self.clear()
                new[:] = True
            start, end = start[new], end[new]
            self.learn(h[new], self.encode(data, start, end) if self.spans else self.encode([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())]))
            row = self.find(h)
        return row

    def spread(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[row].astype(np.int64)
        begin = self.at[row] - (np.cumsum(size) - size)
        return size, self.flat[np.repeat(begin, size) + np.arange(size.sum())]

    def ids(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and hashes of the words in data, number of ids of each, and all ids in order."""
        start, end, h = word_hashes(data, self.space)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        return start, h, *self.spread(self.rows(distinct, start[first], end[first], data)[which])

    def tally(self, data: np.ndarray, ids: int, words: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words' hashes, how often each occurs, and how often each of so many ids does. words: word_hashes() of data, if known."""
        start, end, h = words or word_hashes(data, self.space)
        distinct, first, n = np.unique(h, return_index=True, return_counts=True)
        size, own = self.spread(self.rows(distinct, start[first], end[first], data))
        return distinct, n, np.bincount(own, np.repeat(n, size), minlength=ids).astype(np.int64)

    def texts(self, texts: list[bytes], group: int = 1 << 20) -> list[np.ndarray]:
        """The ids of each text; short texts go in groups."""
        out, k = [], 0
        while k < len(texts):
            m, total = k, 0
            while m < len(texts) and (m == k or total + len(texts[m]) < group):
                total += len(texts[m]) + 1
                m += 1
            own = texts[k:m]
            start, _, size, ids = self.ids(np.frombuffer(b" ".join(own), dtype=np.uint8))
            begins = np.cumsum([0, *(len(x) + 1 for x in own)])
            cut = np.append(0, np.cumsum(size))[np.searchsorted(start, begins)]
            out += [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            k = m
        give_back()
        return out


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers live long and share an executor's limit."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def frugal(work):
    """A mapInPandas function that gives freed memory back when its partition is done."""

    def run(frames):
        yield from work(frames)
        give_back()

    return run


def folded(text: str | None) -> np.ndarray:
    """A text's UTF-8 bytes with A-Z in lower case. A lone surrogate counts as its three bytes."""
    return _FOLD[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)]


def text_of(value) -> str:
    return value if isinstance(value, str) else ""


def bytes_of(value) -> bytes:
    return value.encode("utf-8", "surrogatepass") if isinstance(value, str) else b""


class PieceCache:
    """word -> packed ids, where new words are encoded in groups by encode(list of words). Bounded: it is emptied
    when it is full, which costs time but changes no result."""

    def __init__(self, encode, limit: int = 60_000) -> None:
        self.encode, self.limit, self.known = encode, limit, {}

    def pack(self, texts: list[list[str]]) -> list[bytes]:
        """The packed ids of each text's words, one after the other. New words of all texts are encoded in one go."""
        found = [list(map(self.known.get, words)) for words in texts]
        new = list({w for words, got in zip(texts, found) if None in got for w, x in zip(words, got) if x is None})
        if new:
            if len(self.known) + len(new) > self.limit:
                self.known = {}
            now = dict(zip(new, self.encode(new)))
            self.known.update(now)
            found = [[now[w] if x is None else x for w, x in zip(words, got)] if None in got else got for words, got in zip(texts, found)]
        return [b"".join(got) for got in found]


SPACES = re.compile(r"[\x20\x09-\x0D]+")


def packed(bucket: np.ndarray, rows: np.ndarray):
    """Groups structured rows by bucket: a pandas frame with one blob of rows for each bucket that has any."""
    import pandas as pd

    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, dtype=np.int64)
    ends = np.append(first[1:], len(rows))
    return pd.DataFrame({"bucket": bucket[first].astype("int32"), "blob": [rows[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist())]})


PACKED = "bucket int, blob binary"


def buckets(spark: SparkSession) -> int:
    """Buckets of packed rows: one for each shuffle partition, so a task writes a blob at most to each."""
    return parts(spark)


def to_buckets(df: DataFrame) -> DataFrame:
    """Each bucket's rows in a partition of their own: placed by number, so none meet by hash and none stay empty."""
    return df.repartitionById(buckets(df.sparkSession), F.col("bucket"))


def exchange(df: DataFrame, work, dtype: np.dtype, schema: str) -> DataFrame:
    """Brings all rows of a bucket into one partition and applies work(rows of a partition) -> frames."""

    def run(frames):
        blobs = [b for pdf in frames for b in pdf["blob"]]
        if blobs:
            yield from work(np.frombuffer(b"".join(blobs), dtype=dtype))

    return to_buckets(df).mapInPandas(frugal(run), schema)


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b): root is the smallest node reachable. Labels spread to neighbours
    and jump along pointers until nothing changes; each round's labels are written, so lineage stays short."""
    both = stash(links.where("a != b").select("a", "b").unionByName(links.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.join(label.select(F.col("node").alias("root"), F.col("root").alias("far")), "root").select("node", "old", F.least("root", "far").alias("root"))
        new = stash(jump, "labels")
        if not new.where("root != old").head(1):
            return new.select("node", "root")
        label = new.select("node", "root")


#: Bits of the filter that finds again, in a scan, the rows of needed keys, whatever their number (4 MB).
FILTER_BITS = 1 << 25


class KeyFilter:
    """A fixed-size bit filter of 64-bit keys: it lets all needed keys through and few others. More keys make it
    let more others through, which an exact join removes later."""

    def __init__(self, keys: DataFrame, column: str) -> None:
        import pandas as pd

        def bits(frames):
            out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
            for pdf in frames:
                h = mix64(pdf[column].to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)
                np.bitwise_or.at(out, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
            if out.any():
                yield pd.DataFrame({"block": np.arange(16), "bits": [x.tobytes() for x in np.split(out, 16)]})

        def merge(pdf):
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in pdf["bits"]]).tobytes()]})

        rows = keys.select(column).where(F.col(column).isNotNull()).mapInPandas(bits, "block int, bits binary").groupBy("block").applyInPandas(merge, "block int, bits binary").collect()  # 4 MB
        found = {r.block: bytes(r.bits) for r in rows}
        self.mask = keys.sparkSession.sparkContext.broadcast(b"".join(found.get(k, bytes(FILTER_BITS // 128)) for k in range(16)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        mask = np.frombuffer(self.mask.value, dtype=np.uint8)
        h = mix64(keys.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)
        return (mask[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds each row's number (from 0) in a global order, found by range partitions: no task holds more than one."""
    from pyspark.sql import Window

    placed = df.repartitionByRange(parts(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = stash(placed, "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # as many rows as partitions
    return placed.join(base, "_part").withColumn(name, F.col("_base") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).drop("_part", "_base")
