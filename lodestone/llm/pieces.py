"""SentencePiece encoding and decoding of texts of any length by a max-plus parallel scan.

The model file's vocabulary is of the merge (BPE) kind. A segmentation is the one that merging gives exactly when
every two neighbouring pieces are compatible: merging their joined text gives these two pieces again (the first
merge across a border would also happen in the pair alone). So encoding is a best path: states are pieces, a
transition weighs the new piece's score where the pair is compatible and minus infinity elsewhere.

Texts over CHUNK characters are cut into chunks wherever they fall. A chunk gives a transfer matrix from each
state at its left border (the piece that covers the character before it) to each state at its right border;
matrices combine by the associative max-plus product, a scan over them fixes the state at each border, and every
chunk is traced back by itself. Runs between blanks cannot be crossed by any piece: there a matrix has one state,
and the library's merges give that run's pieces from a bounded cache. Shorter texts are one chunk.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK_ONLY, PieceCache, WordIds, bytes_of, text_of, tune

CHUNK = 16_384
BLANK = "▁"
_RUN = re.compile(f"{BLANK}+[^{BLANK}]*")
_PINCH = re.compile(f"(?<=[^{BLANK}]){BLANK}")
State = tuple[int, int]
Inner = tuple[tuple[int, int] | None, np.ndarray]


class Pieces:
    """A model's vocabulary. `normal`: pieces that merges can give, with their scores."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = {i for i in range(len(names)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(names) if i not in special}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(names[i][3:5], 16): i for i in special if sp.is_byte(i)}
        self.longest = max(map(len, self.ids))
        raw = {i: b"" for i in special} | {i: bytes([b]) for b, i in self.byte_ids.items()} | {i: p.replace(BLANK, " ").encode() for p, i in self.ids.items()}
        self.raw = [raw[i] for i in range(len(names))]
        self.value = np.array([self.scores.get(n, 0.0) for n in names])
        self.lone = np.array([self.ids[BLANK]], dtype="<u4").tobytes()
        self.cache, self.table = PieceCache(self.words), WordIds(self.words, "<u4", BLANK_ONLY)
        self.merged = lru_cache(200_000)(self._merged)
        self.compatible = lru_cache(400_000)(lambda a, b: self.merged(a + b) == (a, b))

    def words(self, words: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(words), 4096):  # lists of numbers are large; few live at a time
            own = words[k : k + 4096]
            out += [np.array(x, dtype="<u4").tobytes() if w else self.lone for w, x in zip(own, self.library.encode(own, num_threads=1))]
        return out

    def _merged(self, text: str) -> tuple[str, ...]:
        """Merges one short text: the best score first, the leftmost of equals."""
        at = list(text)
        while len(at) > 1:
            score, k = max(((self.scores.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(at, at[1:]))))
            if score == -np.inf:
                break
            at[-k : -k + 2] = [at[-k] + at[-k + 1]]
        return tuple(at)

    def packed(self, pieces: list[str]) -> bytes:
        """Ids; a character outside the vocabulary becomes its UTF-8 bytes."""
        out = []
        for p in pieces:
            out += [self.ids[p]] if p in self.ids else [self.byte_ids[b] for b in p.encode("utf-8", "replace")]
        return np.array(out, dtype="<u4").tobytes()

    def piece_at(self, text: str, i: int, j: int) -> bool:
        p = text[i:j]
        return self.merged(p) == (p,) if p in self.ids else j - i == 1

    def runs(self, text: str) -> list[str]:
        """The runs of a text, without the blank that each begins with, as the library takes them."""
        if not text:
            return []
        text = text.replace(BLANK, " ")
        if text[0] != " " and "  " not in text:
            return text.split(" ")
        return [r[1:].replace(BLANK, " ") for r in _RUN.findall(BLANK + text.replace(" ", BLANK))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts that are one chunk each. Where single blanks part the words, all are looked up at once."""
        plain = [bool(t) and t[0] != " " and t[-1] != " " and "  " not in t and BLANK not in t for t in texts]
        quick = iter(self.table.texts([bytes_of(t) for t, p in zip(texts, plain) if p]))
        other = iter(self.cache.pack([self.runs(t) for t, p in zip(texts, plain) if not p]))
        return [next(quick).tobytes() if p else next(other) for p in plain]

    def read(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def decode(self, ids) -> bytes:
        """The UTF-8 text of packed ids, without the blank that encoding puts before it."""
        return self.read(ids)[1:]

    def borders(self, text: str, at: int) -> list[State]:
        """All pieces that cover the character before `at`."""
        return [(i, j) for i in range(max(0, at - self.longest), at) for j in range(at, min(len(text), i + self.longest) + 1) if self.piece_at(text, i, j)]

    def walk(self, text: str, origins: list[State], start: int, end: int) -> tuple[dict, dict]:
        """Best paths from each origin to each state at `end`: {(origin, state): score}, and what precedes each state."""
        best: dict[State, dict[State, float]] = {o: {o: 0.0} for o in origins}
        back: dict[tuple[State, State], State] = {}
        ending: dict[int, list[State]] = {}
        for o in origins:
            ending.setdefault(o[1], []).append(o)
        for at in range(start, end):
            for last in ending.get(at, ()):
                if last[1] >= end:
                    continue
                for stop in range(at + 1, min(len(text), at + self.longest) + 1):
                    if self.piece_at(text, at, stop) and (last[0] == last[1] or self.compatible(text[last[0] : at], text[at:stop])):
                        new, gain = (at, stop), self.scores.get(text[at:stop], 0.0)
                        if new not in best:
                            best[new] = {}
                            ending.setdefault(stop, []).append(new)
                        for o, s in best[last].items():
                            if s + gain > best[new].get(o, -np.inf):
                                best[new][o], back[o, new] = s + gain, last
        return {(o, s): x for s, of in best.items() if s[1] >= end and s[0] < end for o, x in of.items()}, back

    def pinches(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        """The first and the last place in start..end where no piece can cross."""
        first = _PINCH.search(text, start, end + 1)
        if not first:
            return None
        last = text.rfind(BLANK, start, end + 1)
        while last and text[last - 1] == BLANK:
            last = text.rfind(BLANK, start, last)
        return first.start(), last

    def transfer(self, text: str, start: int, end: int, last: bool, inner: Inner | None = None) -> dict[tuple[State, State], float]:
        """The matrix of text[start:end]; text holds some characters more on either side. Rows: states at start
        ((0, 0) at the text's start); columns: states at end. inner: of inners(), if known."""
        origins = self.borders(text, start) if start else [(0, 0)]
        found, ids = inner or self.inners([(text, start, end)])[0]
        if found:
            first, final = found
            left = self.ends(text, origins, start, first)
            if final == end:  # the state at the border is the piece that ends there
                return left if first == final else {(o, self.closing(ids, final)): a + self.value[ids].sum() for o, a in self.totals(left).items()}
            right = {s: x for (_, s), x in self.walk(text, [(final, final)], final, end)[0].items()}
            return {(o, s): a + self.value[ids].sum() + x for o, a in self.totals(left).items() for s, x in right.items() if not last or s[1] == end}
        out = self.walk(text, origins, start, end)[0] | {(o, o): 0.0 for o in origins if o[1] >= end and o[0] < o[1]}
        return {k: x for k, x in out.items() if not last or k[1][1] == end}

    def ends(self, text: str, origins: list[State], start: int, at: int) -> dict[tuple[State, State], float]:
        inside = [o for o in origins if o[1] <= at]
        out = {(o, o): 0.0 for o in inside if o[1] == at}
        return out | {k: x for k, x in self.walk(text, inside, start, at)[0].items() if k[1][1] == at}

    @staticmethod
    def totals(matrix: dict) -> dict[State, float]:
        out: dict[State, float] = {}
        for (o, _), x in matrix.items():
            out[o] = max(x, out.get(o, -np.inf))
        return out

    def inners(self, parts: list[tuple[str, int, int]]) -> list[Inner]:
        """Of each (text, start, end): its pinches, and the ids between them. Where single blanks part the words, all texts' are
        looked up at once."""
        found = [self.pinches(*p) for p in parts]
        inside = [t[f[0] + 1 : f[1]] if f else "" for (t, _, _), f in zip(parts, found)]
        plain = [bool(x) and x[0] != BLANK and 2 * BLANK not in x for x in inside]
        quick = iter(self.table.texts([bytes_of(x.replace(BLANK, " ")) for x, p in zip(inside, plain) if p]))
        other = iter(self.cache.pack([[r[1:].replace(BLANK, " ") for r in _RUN.findall(BLANK + x)] if x else [] for x, p in zip(inside, plain) if not p]))
        return [(f, next(quick) if p else np.frombuffer(next(other), dtype="<u4")) for f, p in zip(found, plain)]

    def closing(self, ids: np.ndarray, final: int) -> State:
        """The one state that ends at the pinch `final`."""
        last = int(ids[-1])
        return final - (1 if self.library.is_byte(last) else len(self.library.id_to_piece(last))), final

    def trace(self, text: str, start: int, end: int, origin: State, state: State, inner: Inner | None = None) -> bytes:
        """Ids of the pieces that begin in text[start:end], given the states at both borders."""
        if origin == state:
            return b""
        found, ids = inner or self.inners([(text, start, end)])[0]
        if not found:
            return self.packed(self.path(text, origin, state, start, end))
        first, final = found
        ending = [s for (_, s) in self.ends(text, [origin], start, first) if s != origin]
        left = self.path(text, origin, ending[0], start, first) if ending else []
        right = self.path(text, (final, final), state, final, end) if final < end else []
        return self.packed(left) + ids.tobytes() + self.packed(right)

    def path(self, text: str, origin: State, state: State, start: int, end: int) -> list[str]:
        _, back = self.walk(text, [origin], start, end)
        out = []
        while state != origin:
            out.append(text[slice(*state)])
            state = back[origin, state]
        return out[::-1]


def product(a: dict, b: dict) -> dict:
    """Max-plus product of two transfer matrices with their states at absolute places."""
    rows: dict[State, list] = {}
    for (m, s), x in b.items():
        rows.setdefault(m, []).append((s, x))
    out: dict[tuple[State, State], float] = {}
    for (o, m), x in a.items():
        for s, y in rows.get(m, ()):
            if x + y > out.get((o, s), -np.inf):
                out[o, s] = x + y
    return out


def scan(matrices: list[dict]) -> list[State]:
    """The states at all borders of the best path, start and end included. Prefix products are made by doubling."""
    prefix, step = list(matrices), 1
    while step < len(prefix):
        prefix = [product(prefix[k - step], prefix[k]) if k >= step else prefix[k] for k in range(len(prefix))]
        step *= 2
    (_, state), _ = max(prefix[-1].items(), key=lambda x: x[1])
    out = [state]
    for k in range(len(matrices) - 1, 0, -1):
        before = {s: x for (_, s), x in prefix[k - 1].items()}
        state = max(((before[o] + x, o) for (o, s), x in matrices[k].items() if s == state and o in before))[1]
        out.append(state)
    return [(0, 0), *out[::-1]]


_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """One for each Python worker."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def chunks(text: str, size: int, around: int) -> list[tuple[int, int, int, str]]:
    """(offset of the piece of text, start and end in it, piece of text) of a text with its first blank."""
    whole = BLANK + text.replace(" ", BLANK)
    out = []
    for a in range(0, len(whole), size):
        b = min(len(whole), a + size)
        left = max(0, a - around)
        out.append((left, a - left, b - left, whole[left : b + around]))
    return out


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, decoded: bool = False) -> DataFrame:
    """doc_id, text, ids (unsigned 32-bit, little endian) of every row; decoded: also what they read as, made in the
    same pass. Null texts count as empty and get no ids; repeated rows stay; other columns of docs are left out. The ids of one
    text are one value, so they are joined in one task."""
    docs, giant = _parted(docs, chunk)

    def short(frames):
        for pdf in frames:
            out = pdf.assign(doc_id=pdf["doc_id"].astype("Int64"), ids=model(path).encode([text_of(t) for t in pdf["text"]]))
            yield _decoded(out, path) if decoded else out

    def joined(pdf):
        pdf = pdf.sort_values("k")
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "ids": [b"".join(pdf["ids"])]})

    whole = traced(giant, path, chunk).groupBy("key").applyInPandas(joined, "key string, ids binary")
    giants = giant.join(whole, "key").select("doc_id", "text", "ids")
    small = docs.mapInPandas(short, "doc_id long, text string, ids binary" + ", decoded string" * decoded)
    return small.unionByName(decode(giants, path) if decoded else giants)


def _parted(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """doc_id and text of texts that are one chunk, and of longer ones, these with a key: equal texts are encoded once."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > chunk
    return docs.where(~long), docs.where(long).withColumn("key", F.sha2("text", 256))


def traced(giant: DataFrame, path: str, chunk: int) -> DataFrame:
    """key, k, ids of the chunks of long texts, and whether those read as the text that they stand for."""
    around = 48  # over twice the longest piece

    def cut(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                got = pd.DataFrame(chunks(r.text, chunk, around), columns=["off", "a", "b", "t"])
                yield got.assign(key=r.key, k=np.arange(len(got)), last=np.arange(len(got)) == len(got) - 1)[["key", "k", "last", "off", "a", "b", "t"]]

    def transfer(frames):
        for pdf in frames:
            rows = []
            for r, inner in zip(pdf.itertuples(index=False), model(path).inners(list(zip(pdf["t"], pdf["a"], pdf["b"])))):
                m = model(path).transfer(r.t, r.a, r.b, r.last, inner)
                rows.append(np.array([(*np.add(o, r.off), *np.add(s, r.off), x) for (o, s), x in m.items()], dtype="<f8").tobytes())
            yield pd.DataFrame({"key": pdf["key"], "k": pdf["k"], "m": rows})

    def states(pdf):
        pdf = pdf.sort_values("k")
        found = scan([{((int(a), int(b)), (int(c), int(d))): x for a, b, c, d, x in np.frombuffer(m, dtype="<f8").reshape(-1, 5)} for m in pdf["m"]])
        return pd.DataFrame({"key": pdf["key"], "k": pdf["k"], "o0": [s[0] for s in found[:-1]], "o1": [s[1] for s in found[:-1]], "s0": [s[0] for s in found[1:]], "s1": [s[1] for s in found[1:]]})

    def trace(frames):
        for pdf in frames:
            inner = model(path).inners(list(zip(pdf["t"], pdf["a"], pdf["b"])))
            ids = [model(path).trace(r.t, r.a, r.b, (r.o0 - r.off, r.o1 - r.off), (r.s0 - r.off, r.s1 - r.off), x) for r, x in zip(pdf.itertuples(index=False), inner)]
            good = [model(path).read(x) == r.t[r.o1 - r.off : r.s1 - r.off].replace(BLANK, " ").encode("utf-8", "replace") for x, r in zip(ids, pdf.itertuples(index=False))]
            yield pd.DataFrame({"key": pdf["key"], "k": pdf["k"], "ids": ids, "good": good})

    pieces = giant.select("key", "text").dropDuplicates(["key"]).mapInPandas(cut, "key string, k long, last boolean, off long, a long, b long, t string").repartition("key", "k")
    borders = pieces.mapInPandas(transfer, "key string, k long, m binary").groupBy("key").applyInPandas(states, "key string, k long, o0 long, o1 long, s0 long, s1 long")
    return pieces.join(borders, ["key", "k"]).mapInPandas(trace, "key string, k long, ids binary, good boolean")


def _decoded(pdf: pd.DataFrame, path: str) -> pd.DataFrame:
    return pdf.assign(doc_id=pdf["doc_id"].astype("Int64"), decoded=[model(path).decode(x).decode("utf-8", "replace") for x in pdf["ids"]])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded` to the columns doc_id, text and ids of encode()."""

    def run(frames):
        for pdf in frames:
            yield _decoded(pdf, path)

    return encoded.select("doc_id", "text", "ids").mapInPandas(run, "doc_id long, text string, ids binary, decoded string")


def digest(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_crc32, round_trip: what encoding every text and decoding it again gives.
    round_trip holds if the decoded text is the text (a literal U+2581 reads as a blank); chunks are decoded alone."""
    docs, giant = _parted(docs, chunk)

    def short(frames):
        for pdf in frames:
            texts = [text_of(t) for t in pdf["text"]]
            ids = model(path).encode(texts)
            good = [model(path).decode(x).decode("utf-8", "replace") == t.replace(BLANK, " ") for x, t in zip(ids, texts)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_chars": [len(t) for t in texts], "n_pieces": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids], "round_trip": good})

    def summed(pdf):
        crc, pdf = 0, pdf.sort_values("k")
        for x in pdf["ids"]:
            crc = zlib.crc32(x, crc)
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "n_pieces": [sum(map(len, pdf["ids"])) // 4], "ids_crc32": [crc], "round_trip": [bool(pdf["good"].all())]})

    whole = traced(giant, path, chunk).groupBy("key").applyInPandas(summed, "key string, n_pieces long, ids_crc32 long, round_trip boolean")
    giants = giant.select("doc_id", F.length("text").cast("long").alias("n_chars"), "key").join(whole, "key").drop("key")
    return docs.mapInPandas(short, "doc_id long, n_chars long, n_pieces long, ids_crc32 long, round_trip boolean").unionByName(giants)
