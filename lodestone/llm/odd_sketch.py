"""MinHash near-dedup by odd sketches: which documents share 85 % of their word five-grams.

1. A document's set are the 64-bit hashes of its distinct five-word shingles (of its whole sequence, if it has fewer words);
   equal sets are one class. A class gets SAMPLES MinHash values (the least of x * multiplier over its shingles), BANDS band
   keys of ROWS values each, and an odd sketch: every sample toggles one of BITS bits.
2. Stars: of the classes with one band key the most usual (that which meets most others over all its keys) is its pivot. A class is
   compared with two of its keys' pivots: the most usual, and that of its rarest key. So a family is mostly one component after a
   comparison or two a member, whatever its size.
3. The rest: band keys whose classes are still in several components are gone through in blocks of BLOCK classes: those
   outside the commonest component meet every block. Pairs of one component are left out, the others go by their sketches.
   Of keys that more than SPLIT classes have (a license text in half of all documents makes such) two together are a key: a pair that
   shares no smaller key is compared if it shares two of them, so a common passage does not bring together all that holds it.
4. Two sketches' XOR has as many odd bits as samples differ, but for samples that meet in one bit. A pair goes on if it
   has no more than odd_limit() of them, and if its sizes, and as many parities of its whole sets, leave enough overlap. Pairs that
   go on are confirmed on their full sets.

A linked pair is lost if no band key is shared, or a single one and that very common, or if its XOR is over the limit: at the threshold
(1 - 0.85**ROWS)**BANDS, 6e-11, the chance of one band alone, 2e-9, and LOSS, 1e-9; less above it. Nothing else is sampled or capped. Equality of shingles and classes is that of 64-bit hashes.
Null and empty texts, and texts without words, have an empty set and no link. Rows with a null doc_id take part; a component's
id is its smallest doc_id that is not null (null if all are). Repeated rows stay, of which each gets a row; an empty table gives
an empty one; other columns of docs are left out; a very long text is one set, hashed piece by piece.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, connected, frugal, give_back, mix64, parts, stash, tune
from .ngram_join import classes_of, shingle_sets

PERCENT = 85
SAMPLES, ROWS, BITS = 128, 4, 1024
BANDS = SAMPLES // ROWS
LOSS = 1e-9
#: Classes from which on a band key counts only beside another; classes of one band key in a block; pairs of sketches that are compared at a time; shingles that are hashed at a time.
SPLIT, BLOCK, PAIRS, CHUNK = 4096, 1024, 1 << 20, 1 << 16
WORDS64 = BITS // 64
PAIR = "a long, b long"

_MULTIPLIER = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
_SALT = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES values of each set (none is empty): rows of sets. Sets are taken some at a time, so memory is bounded by the longest."""
    out, k = np.empty((len(sets), SAMPLES), dtype=np.uint64), 0
    while k < len(sets):
        m, size = k + 1, len(sets[k])
        while m < len(sets) and size + len(sets[m]) <= CHUNK:
            size += len(sets[m])
            m += 1
        x = np.concatenate(sets[k:m])
        first = np.cumsum([0, *(len(s) for s in sets[k : m - 1])])
        for i, by in enumerate(_MULTIPLIER):
            out[k:m, i] = np.minimum.reduceat(x * by, first)
        k = m
    return mix64(out + _SALT)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """BANDS keys of each row of samples; the band's number is part of its key."""
    x = samples.reshape(len(samples), BANDS, ROWS)
    h = np.zeros(x.shape[:2], dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, i])
    return h.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """BITS parities of each row of samples, as 64-bit words."""
    bit = (samples >> np.uint64(64 - int(math.log2(BITS)))).astype(np.int64)
    out = np.zeros((len(samples), WORDS64), dtype=np.uint64)
    rows = np.arange(len(samples))
    for i in range(SAMPLES):
        out[rows, bit[:, i] >> 6] ^= np.uint64(1) << (bit[:, i] & 63).astype(np.uint64)
    return out.view(np.int64)


def whole_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """BITS parities of each set's shingles: where two sets differ in k shingles, k of them differ at most."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    out = np.zeros((len(sets), BITS // 8), dtype=np.uint8)
    for part in np.array_split(np.arange(len(sets)), 1 + len(sets) // 4096):
        bit = (mix64(np.concatenate([sets[k] for k in part.tolist()]) ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - int(math.log2(BITS)))).astype(np.int64)
        row = np.repeat(np.arange(len(part)), size[part])
        odd = np.bincount(row * BITS + bit, minlength=len(part) * BITS) & 1
        out[part] = np.packbits(odd.astype(np.uint8).reshape(len(part), BITS), axis=1)
    return out.view(np.int64)


def needed(na, nb, percent: int):
    """The least overlap of two linked sets with these sizes."""
    return (percent * (na + nb) + 99 + percent) // (100 + percent)


def estimate(odd: float, samples: int = SAMPLES, bits: int = BITS) -> float:
    """The similarity that so many odd bits of two sketches' XOR speak for."""
    return 1 + bits * math.log(max(1 - 2 * odd / bits, 1e-9)) / (4 * samples)


@lru_cache
def odd_limit(percent: int = PERCENT, loss: float = LOSS) -> int:
    """The least limit that the odd bits of a pair with this similarity pass with a chance of `loss` at most."""
    p = 1 - percent / 100
    differ = [math.comb(SAMPLES, m) * p**m * (1 - p) ** (SAMPLES - m) for m in range(SAMPLES + 1)]
    odd, z = np.zeros(BITS + 1), np.arange(BITS + 1)
    odd[0], total = 1.0, np.zeros(BITS + 1)
    for chance in differ:  # each sample that differs toggles two bits
        total += chance * odd
        for _ in range(2):
            up, down = odd * (BITS - z) / BITS, odd * z / BITS
            odd = np.append(0, up[:-1]) + np.append(down[1:], 0)
    return int(np.flatnonzero(np.cumsum(total[::-1])[::-1] > loss).max())


def odd_bits(a: str, b: str, first: int = 0) -> Column:
    """How many bits of two sketches (arrays of 64-bit words, from one of them on) differ."""
    return reduce(Column.__add__, (F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(first, first + WORDS64)))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls of each row (cls null: no shingle); the first row of a class in a task also has its keys and sketch."""

    def run(frames):
        seen: set[int] = set()
        for pdf in frames:
            sets = shingle_sets(pdf["text"].tolist())
            cls = classes_of(sets)
            keys, sketch = [None] * len(sets), [None] * len(sets)
            if len(seen) > 1 << 20:  # copies of what was forgotten meet their class later
                seen.clear()
            new = [k for k, c in enumerate(cls.tolist()) if len(sets[k]) and not (c in seen or seen.add(c))]
            if new:
                samples = min_hashes([sets[k] for k in new])
                for k, x, y in zip(new, band_keys(samples), np.concatenate([odd_sketches(samples), whole_sketches([sets[k] for k in new])], axis=1)):
                    keys[k], sketch[k] = x, y
            empty = np.array([not len(s) for s in sets], dtype=bool)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": [len(s) for s in sets], "cls": pd.Series(cls, index=pdf.index).astype("Int64").mask(pd.Series(empty, index=pdf.index)), "keys": keys, "sketch": sketch})
            del sets
            give_back()

    return docs.mapInPandas(frugal(run), "doc_id long, n long, cls long, keys array<long>, sketch array<long>")


def full_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, tokens (array<long>) of the classes that are asked for (cls), each once. A filter of fixed size lets them through where texts are
    hashed; others that pass it find no partner later."""
    wanted = KeyFilter(classes, "cls")

    def run(frames):
        seen: set[int] = set()
        for pdf in frames:
            sets = shingle_sets(pdf["text"].tolist())
            cls = classes_of(sets)
            hit = wanted.has(cls) if len(cls) else np.zeros(0, dtype=bool)
            if len(seen) > 1 << 20:
                seen.clear()
            own = [k for k in np.flatnonzero(hit).tolist() if len(sets[k]) and not (cls[k] in seen or seen.add(cls[k]))]
            for at in range(0, len(own), 256):
                yield pd.DataFrame({"cls": cls[own[at : at + 256]], "tokens": [sets[k].view(np.int64) for k in own[at : at + 256]]})
            del sets
            give_back()

    return docs.select("text").mapInPandas(frugal(run), "cls long, tokens array<long>").dropDuplicates(["cls"])


def shared_keys(classes: DataFrame) -> DataFrame:
    """key, cls, many: the band keys that several classes have, and how many."""
    rows = classes.select("cls", F.explode("keys").alias("key"))
    many = rows.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    return rows.join(many, "key")


def stars(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class b with the most usual of its keys' pivots, and with that of its rarest key."""
    usual = rows.groupBy("cls").agg(F.sum("many").alias("usual"))
    pivots = rows.select("key", "cls").join(usual, "cls").groupBy("key").agg(F.max(F.struct("usual", "cls")).alias("pivot"))
    own = rows.join(pivots, "key").where("cls != pivot.cls").groupBy(F.col("cls").alias("b")).agg(F.max("pivot").alias("hub"), F.min(F.struct("many", "pivot")).alias("rare"))
    return own.select(F.explode(F.array_distinct(F.array("hub.cls", "rare.pivot.cls"))).alias("a"), "b")


def similar(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches let them be linked."""
    s = lambda side: classes.select(F.col("cls").alias(side), F.col("sketch").alias(f"_s{side}"), F.col("n").alias(f"_n{side}"))
    x = pairs.join(s("b"), "b").join(s("a"), "a").withColumn("_need", F.expr(f"({percent} * (_na + _nb) + {99 + percent}) div {100 + percent}"))
    sizes = (F.col("_need") <= F.least("_na", "_nb")) & (odd_bits("_sa", "_sb", WORDS64) <= F.col("_na") + F.col("_nb") - 2 * F.col("_need"))
    return x.where(sizes & (odd_bits("_sa", "_sb") <= odd_limit(percent))).select("a", "b")


def groups(rows: DataFrame) -> DataFrame:
    """key, top (the commonest label and how many have it), every: of the keys whose classes have several labels."""
    per = rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("every"), F.count("*").alias("labels"))
    return per.where("labels > 1").drop("labels")


def narrowed(rows: DataFrame) -> DataFrame:
    """Rows of the keys that have several labels; those of very common keys under each two of them that a class has."""
    mixed = stash(groups(rows).select("key", (F.col("every") > SPLIT).alias("hot")), "odd-mixed")
    own = rows.join(mixed, "key")
    hot = own.where("hot").select("key", "cls", "label")
    other = hot.select("cls", F.col("key").alias("_other"))
    both = hot.join(other, "cls").where("key < _other").select(F.xxhash64("key", "_other").alias("key"), "cls", "label")
    return own.where("not hot").select("key", "cls", "label").unionByName(both)


def across(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes with a key in common and different labels whose sketches let them be linked. rows: key, cls, label."""
    rows = stash(narrowed(rows), "odd-groups")
    mixed = groups(rows).select("key", F.col("top.label").alias("common"), F.ceil(F.col("every") / BLOCK).alias("blocks"), F.ceil((F.col("every") - F.col("top.c")) / BLOCK).alias("turns"))
    own = rows.join(mixed, "key").join(classes.select("cls", "n", "sketch"), "cls")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # a grid of blocks of all classes x blocks of those outside the commonest label; mostly it is one cell
    all_sides = own.withColumn("block", F.pmod(F.xxhash64("cls"), "blocks")).withColumn("turn", every("turns")).withColumn("few", F.lit(False))
    few = own.where("label != common").withColumn("block", every("blocks")).withColumn("turn", F.pmod(F.xxhash64("cls", F.lit(1)), "turns")).withColumn("few", F.lit(True))
    cells = all_sides.unionByName(few).select("key", "block", "turn", "few", "cls", "label", "n", "sketch")
    limit = odd_limit(percent)

    def run(frames):
        held = None
        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            cell = pdf[["key", "block", "turn"]].to_numpy()
            last = np.flatnonzero((cell != cell[-1]).any(axis=1))  # the last cell may go on in the next frame
            cut = int(last[-1]) + 1 if len(last) else 0
            held = pdf.iloc[cut:]
            yield from _compared(pdf.iloc[:cut], limit, percent)
        if held is not None:
            yield from _compared(held, limit, percent)

    placed = cells.repartition(parts(rows.sparkSession), "key", "block", "turn").sortWithinPartitions("key", "block", "turn")
    return placed.mapInPandas(frugal(run), PAIR).distinct()


def _compared(pdf: pd.DataFrame, limit: int, percent: int):
    """Frames of the pairs (a < b) of one cell's classes that differ in label and whose sketches are near."""
    if not len(pdf):
        return
    cell = pdf[["key", "block", "turn"]].to_numpy()
    number = np.cumsum(np.append(False, (cell[1:] != cell[:-1]).any(axis=1)))
    few, cls, label = pdf["few"].to_numpy(dtype=bool), pdf["cls"].to_numpy(), pdf["label"].to_numpy()
    sketch, size_of = np.stack(pdf["sketch"].to_numpy()).view(np.uint64), pdf["n"].to_numpy()
    left, right = np.flatnonzero(few), np.flatnonzero(~few)
    start, stop = np.searchsorted(number[right], number[left], side="left"), np.searchsorted(number[right], number[left], side="right")
    size = stop - start
    done = np.cumsum(size)
    for part in np.split(np.arange(len(left)), np.searchsorted(done, np.arange(PAIRS, done[-1] if len(done) else 0, PAIRS))):
        n = size[part]
        i = np.repeat(left[part], n)
        j = right[np.repeat(start[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        need = needed(size_of[i], size_of[j], percent)
        keep = (label[i] != label[j]) & (need <= np.minimum(size_of[i], size_of[j]))
        i, j, room = i[keep], j[keep], (size_of[i] + size_of[j] - 2 * need)[keep]
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            odd = np.bitwise_count(sketch[x] ^ sketch[y])
            near = (odd[:, :WORDS64].sum(axis=1, dtype=np.int64) <= limit) & (odd[:, WORDS64:].sum(axis=1, dtype=np.int64) <= room[at : at + (1 << 16)])
            if near.any():
                a, b = cls[x[near]], cls[y[near]]
                yield pd.DataFrame(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0), columns=["a", "b"])


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked, by their full sets."""
    both = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = stash(full_sets(docs, both), "odd-sets")
    x = pairs.join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("_tb")), "b").join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("_ta")), "a")
    x = x.select("a", "b", (F.size("_ta") + F.size("_tb")).cast("long").alias("both"), F.size(F.array_intersect("_ta", "_tb")).cast("long").alias("common"))
    return x.where(F.col("common") * 100 >= (F.col("both") - F.col("common")) * percent).select("a", "b")


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs. kept: the row's doc_id is its component's id."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stash(described(docs), "odd-docs")
    classes = stash(rows.where("keys is not null").select("cls", "n", "keys", "sketch").dropDuplicates(["cls"]), "odd-classes")
    keys = stash(shared_keys(classes), "odd-keys")
    links = stash(confirmed(stash(similar(stars(keys), classes, percent), "odd-pairs"), docs, percent), "odd-links")
    labels = connected(links).select(F.col("node").alias("cls"), F.col("root").alias("label"))
    labelled = stash(keys.select("key", "cls").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "odd-labels")
    rest = stash(confirmed(stash(across(labelled, classes, percent), "odd-pairs"), docs, percent), "odd-links")
    roots = connected(links.unionByName(rest))
    per_class = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    per_class = stash(per_class.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "odd-roots")
    found = per_class.join(per_class.groupBy("root").agg(F.min("least").alias("component")), "root").select("cls", "component")
    out = rows.select("doc_id", "n", "cls").join(found, "cls", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
