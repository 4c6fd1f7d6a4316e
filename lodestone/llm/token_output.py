"""Token-ID / binary output: ids in compressed shards with one shared zstandard dictionary.

A shard is one binary value: a header (magic, version, bytes of an id, SHA-256 of the dictionary, number of
documents), an index (document id and a presence flag, offset and length of its frame, number of ids) and the
frames, one independent zstandard frame for each document, so that a short document is read without its
neighbours. The dictionary is trained on the serialized id arrays of a bounded sample (DICTIONARY_DOCS); it
shapes sizes only, never content. Shards and the dictionary are written by Spark's own writers, so any store
that Spark writes will do. Shards come in ascending doc_id order (`part`, `seq`); rows with a null doc_id come first.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordIds, bytes_of, parts, text_of, tune

MAGIC, VERSION = b"LDTK", 1
DICTIONARY_DOCS, DICTIONARY_BYTES, SHARD_BYTES = 500, 65_536, 1 << 20
HEAD, ENTRY = ">4sHH32sQ", ">qBQII"


class Encoder:
    """Packed ids of whole texts with a tokenizers file, special tokens not added.

    Where `by_word` holds (the tokenizer drops white space before it merges, so no merge, normalisation or
    pre-token crosses it), each distinct run of non-space is given to the library once, many runs in a call with
    a control character between them, and is then taken from a bounded table; the ids are those of encoding the
    whole text.
    """

    MARK = "\x01"
    #: Words of one pre-token (and a closing stop or comma, which is one of its own) that normalisation leaves alone.
    PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,]?)").fullmatch

    def __init__(self, path: str, dtype: str = "<u4", by_word: bool | None = None) -> None:
        from tokenizers import Tokenizer

        self.library, self.dtype = Tokenizer.from_file(path), dtype
        self.by_word = self.drops_space() if by_word is None else by_word
        self.cache, self.plain = WordIds(self.words, dtype), self.plain_tokenizer() if self.by_word else None

    def drops_space(self) -> bool:
        mark = self.ids(self.MARK)
        if len(mark) != 1:
            return False
        return all(self.ids(f"ab{c}cd{c}{self.MARK}{c}.{c}é") == sum((self.ids(x) for x in ("ab", "cd", self.MARK, ".", "é")), []) for c in "\x20\x09\x0a\x0b\x0c\x0d")

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.array(self.ids(text), dtype=self.dtype).tobytes()

    def plain_tokenizer(self):
        """The same model without normaliser and pattern, for PLAIN words; None where it can't be used."""
        from tokenizers import Tokenizer, pre_tokenizers

        said = json.loads(self.library.to_str())
        suffix = said["model"].get("end_of_word_suffix")
        if not suffix:
            return None
        plain = Tokenizer.from_str(json.dumps(said | {"normalizer": None, "added_tokens": []}))
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.library.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for p, i in vocab.items() if p.endswith(suffix)]] = True
        self.stops = {x: self.whole(x) for x in (".", ",", "")}
        tried = ["a", "the", "zq", "\u00e9t\u00e9", "na\u00efve", "stra\u00dfe", "xylophones", "s", "ve"]
        good = all(plain.encode(w.lower(), add_special_tokens=False).ids == self.ids(w) and self.ids(w + ".") == self.ids(w) + self.ids(".") and self.closes[self.ids(w)].tolist()[:-1] == [False] * (len(self.ids(w)) - 1) for v in tried for w in (v, v.upper()) if len(w.lower()) == len(v))
        return plain if good else None

    def split(self, tokenizer, texts: list[str], cut_at) -> list[list[bytes]]:
        """Packed ids of each text's parts; cut_at(ids) gives the first id after each part, and how many ids lie between parts."""
        out = []
        for got in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(got.ids, dtype=self.dtype)
            cut, gap = cut_at(ids)
            size, raw = ids.itemsize, ids.tobytes()
            ends = (cut * size).tolist()
            out.append([raw[a:b] for a, b in zip([0, *((cut + gap) * size).tolist()], [*ends, len(raw)] if gap else ends)])
        return out

    def words(self, words: list[str], group: int = 256) -> list[bytes]:
        out = {}
        if self.plain:
            match = {w: m.groups() for w in words if (m := self.PLAIN(w.lower() if w.isascii() else w))}
            cores = list({c for c, _ in match.values()})
            groups = [cores[i : i + group] for i in range(0, len(cores), group)]
            got = self.split(self.plain, [" ".join(g) for g in groups], lambda ids: (np.flatnonzero(self.closes[ids]) + 1, 0))
            known = {c: x for g, own in zip(groups, got) for c, x in zip(g, own, strict=True)}
            out = {w: known[c] + self.stops[stop] for w, (c, stop) in match.items()}
        mark = self.ids(self.MARK)[0]
        rest = [w for w in words if w not in out and self.MARK not in w]
        groups = [rest[i : i + group] for i in range(0, len(rest), group)]
        for g, own in zip(groups, self.split(self.library, [f" {self.MARK} ".join(g) for g in groups], lambda ids: (np.flatnonzero(ids == mark), 1))):
            out.update(zip(g, own, strict=True))
        return [out[w] if w in out else self.whole(w) for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self.whole(t) for t in texts]
        return [x.tobytes() for x in self.cache.texts([bytes_of(t) for t in texts])]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str) -> Encoder:
    """One for each Python worker."""
    if (path, dtype) not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path, dtype] = Encoder(path, dtype)
    return _ENCODERS[path, dtype]


def width_of(ids_limit: int) -> str:
    return "<u2" if ids_limit <= 1 << 16 else "<u4"


def build_shard(dictionary_sha: bytes, width: int, docs: list[tuple[int | None, bytes, int]]) -> bytes:
    """docs: (doc_id, frame, number of ids)."""
    at, index = 0, []
    for d, frame, n in docs:
        index.append(struct.pack(ENTRY, d or 0, d is not None, at, len(frame), n))
        at += len(frame)
    return b"".join([struct.pack(HEAD, MAGIC, VERSION, width, dictionary_sha, len(docs)), *index, *(f for _, f, _ in docs)])


class Shard:
    """Reads single documents of a shard: the index first, then only the frame that is asked for."""

    def __init__(self, blob: bytes, dictionary: bytes) -> None:
        magic, version, width, sha, self.n = struct.unpack_from(HEAD, blob)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this format")
        if sha != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        import zstandard

        self.blob, self.dtype = memoryview(blob), f"<u{width}"
        self.index = list(struct.iter_unpack(ENTRY, self.blob[struct.calcsize(HEAD) :][: self.n * struct.calcsize(ENTRY)]))
        self.frames = struct.calcsize(HEAD) + self.n * struct.calcsize(ENTRY)
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def doc_id(self, k: int) -> int | None:
        return self.index[k][0] if self.index[k][1] else None

    def ids(self, k: int) -> np.ndarray:
        _, _, at, length, n = self.index[k]
        out = np.frombuffer(self.reader.decompress(self.blob[self.frames + at : self.frames + at + length]), dtype=self.dtype)
        if len(out) != n:
            raise ValueError("a frame doesn't hold as many ids as its index says")
        return out


def serialized(texts, path: str, end_id: int, dtype: str) -> list[bytes]:
    e, end = encoder(path, dtype), np.array([end_id], dtype=dtype).tobytes()
    return [x + end for x in e.encode([text_of(t) for t in texts])]


def train_dictionary(docs: DataFrame, path: str, end_id: int, dtype: str) -> bytes:
    """Trained on at most DICTIONARY_DOCS documents, each of which gives at most DICTIONARY_BYTES bytes of ids. Too few: no dictionary."""
    import zstandard

    chosen = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICTIONARY_DOCS).distinct()  # ids alone meet in one task; one that is there often leaves fewer
    some = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).select("text")

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"x": [x[:DICTIONARY_BYTES] for x in serialized(pdf["text"], path, end_id, dtype)]})

    samples = sorted(bytes(r.x) for r in some.mapInPandas(run, "x binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, target: str, path: str, end_id: int, vocabulary: int = 1 << 16, shards: int | None = None) -> None:
    """Writes the ids of every whole text (null: empty), each with end_id after it, to `target`.

    Rows with the same doc_id stay, in the order of their ids. `shards`: how many ranges of doc_id, by default one
    for each shuffle partition.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dtype = width_of(vocabulary)
    dictionary = train_dictionary(docs, path, end_id, dtype)
    spark.createDataFrame([Row(dictionary=bytearray(dictionary), sha256=hashlib.sha256(dictionary).hexdigest())], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{target}/dictionary")
    n = shards or parts(spark)
    bounds = docs.where("doc_id is not null").approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n)) if n > 1 else []
    cuts, sha = np.unique(np.array(bounds)), hashlib.sha256(dictionary).digest()

    def encode(frames):
        import zstandard

        z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        for pdf in frames:
            ids = serialized(pdf["text"], path, end_id, dtype)
            d = pdf["doc_id"].astype("Int64")
            part = np.where(d.isna(), 0, np.searchsorted(cuts, d.fillna(0).to_numpy(dtype="float64"), side="right"))
            yield pd.DataFrame({"part": part.astype("int32"), "doc_id": d, "n": [len(x) // np.dtype(dtype).itemsize for x in ids], "frame": [z.compress(x) for x in ids]})

    def pack(frames):
        part, seq, docs_, size = None, 0, [], 0

        def out():
            return pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(docs_)], "n_tokens": [sum(x[2] for x in docs_)], "shard": [build_shard(sha, np.dtype(dtype).itemsize, docs_)]})

        for pdf in frames:
            for p, d, k, f in zip(pdf["part"], pdf["doc_id"].astype("Int64"), pdf["n"], pdf["frame"]):
                if docs_ and (p != part or size >= SHARD_BYTES):
                    yield out()
                    seq, docs_, size = seq + 1 if p == part else 0, [], 0
                part = p
                docs_.append((None if d is pd.NA else int(d), f, int(k)))
                size += len(f)
        if docs_:
            yield out()

    rows = docs.mapInPandas(encode, "part int, doc_id long, n int, frame binary").repartitionById(n, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "frame")
    rows.mapInPandas(pack, "part int, seq int, n_docs int, n_tokens long, shard binary").write.parquet(f"{target}/shards")


def read(spark: SparkSession, target: str) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens, ids (unsigned 32-bit, little endian)."""
    tune(spark)
    dictionary = bytes(spark.read.parquet(f"{target}/dictionary").first().dictionary)
    shards = spark.read.parquet(f"{target}/shards")
    sizes = shards.select("part", "seq", "n_tokens")
    whole = sizes.groupBy("part").agg(F.sum("n_tokens").alias("of_part"))
    base = whole.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("base"))  # as many rows as ranges
    starts = sizes.withColumn("before", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).join(base, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("shard_start"))

    def run(frames):
        for pdf in frames:
            for at, blob in zip(pdf["shard_start"], pdf["shard"]):
                s, rows = Shard(blob, dictionary), []
                for k in range(s.n):
                    ids = s.ids(k)
                    rows.append((s.doc_id(k), int(at), len(ids), ids.astype("<u4").tobytes()))
                    at += len(ids)
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return shards.select("part", "seq", "shard").join(starts, ["part", "seq"]).mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")
