"""N-gram Jaccard join: which documents share 80 % of their word five-grams.

A document's set are the 64-bit hashes of its distinct five-word shingles (of its whole sequence, if it has fewer
words). Equal sets are one class, found by hash before anything else.

1. Every shingle of every class meets its like, which gives the number of classes that hold it. A shingle of one class
   only can be in no overlap, so a class keeps its shared shingles, and a class with under 80 % of them shared can be
   linked with nothing. Very common shingles meet nowhere: a first pass counts shingles in COUNTERS counters by hash, and those of a
   heavy counter (HEAVY rows at least, and 8 times the mean) count as shared, at the counter's level. So no task holds the classes of one
   license line.
2. Prefix-tree join. Under each of KEYS global orders, classes with the same first shingle meet (linked sets do with
   their similarity as the chance); a task's classes go into one trie, and many probes walk
   it together, a stretch of shingles at a time. The overlap with a shared path is counted once, and a subtree is left
   when its overlap and what can remain, of its longest set and of the probe, are less than its smallest set needs, or
   when all its sets are in the probe's component already. The most usual sets of a group probe first (what copies were
   made from), so a family becomes one component after few walks. Groups over GROUP classes are split; each part gets
   the group's most usual class. A class gives one row: what its component is called. These links' components are labels.
3. What tries cannot have seen: in one order, rare shingles first, linked sets have one in common among the first
   n - ceil(0.8 n) + 1 of both (unshared ones counted). These prefixes meet by shingle; classes with different labels
   become pairs if their sizes, and the parities of their whole sets, leave enough overlap; tries decide the pairs.
   Shingles of 2**HOT classes or more are dealt with in a grid of blocks: of classes outside the commonest label, and of all.
4. Labels and links make components.

Nothing is capped or sampled. Equality of shingles and classes is that of 64-bit hashes. Null and empty texts, and
texts without words, have an empty set and no link. Rows with a null doc_id take part; a component's id is its smallest
doc_id that is not null (null if all are). Repeated rows stay; other columns of docs are left out; a very long text is one set, hashed piece by
piece.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, buckets, connected, exchange, folded, frugal, give_back, mix64, packed, stash, to_buckets, tune, word_hashes

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles that a task packs at a time, pairs that it looks at, shingles of sets in one trie.
FLUSH, PAIRS, TREE = 1 << 20, 1 << 17, 1 << 21
#: Global orders; classes in a trie's group, binary logarithm of the classes in a prefix group, partners in a tree of the last step.
KEYS, GROUP, HOT, FAN = 2, 256, 12, 128
#: Counters of shingles, binary logarithm, in as many parts; rows of a heavy one.
COUNTERS, PARTS, HEAVY = 18, 16, 1 << 14
#: Shingles that a walk takes from a node at a time.
STRETCH = 64
ENTRY = np.dtype([("token", "<u8"), ("cls", "<i8"), ("label", "<i8"), ("n", "<u4"), ("s", "<u4"), ("sign", "<u8", (4,))])
PAIR = "a long, b long"
LIVE = "cls long, n int, firsts array<long>, usual double, tokens binary, cold int"


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _shingles(w: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of so many word hashes."""
    h = np.zeros(max(0, len(w) - words + 1), dtype=np.uint64)
    for i in range(words):
        h = h * _STEP + w[i : i + len(h)]
    return mix64(h)


def shingle_sets(texts: list, words: int = WORDS, group: int = 1 << 19) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each whole text; short texts are hashed in groups."""
    raw, out, k = [folded(t if isinstance(t, str) else None) for t in texts], [], 0
    blank = np.frombuffer(b" ", dtype=np.uint8)
    while k < len(raw):
        m, size = k, 0
        while m < len(raw) and (m == k or size + len(raw[m]) < group):
            size += len(raw[m]) + 1
            m += 1
        start, _, w = word_hashes(np.concatenate([x for r in raw[k:m] for x in (r, blank)]))
        cut = np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in raw[k:m])])).tolist()
        h = _shingles(w, words)
        for a, b in zip(cut[:-1], cut[1:]):
            out.append(np.unique(h[a : b - words + 1] if b - a >= words else _shingles(w[a:b], b - a)) if b > a else np.zeros(0, dtype=np.uint64))
        k = m
    return out


def classes_of(sets: list[np.ndarray]) -> np.ndarray:
    """Each set's identity: a hash of all its members; 0 for an empty set."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.zeros(len(sets), dtype=np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        x = mix64(np.concatenate([sets[k] for k in full.tolist()]) + np.uint64(0x632BE59BD9B4E019))
        first = np.cumsum(size[full]) - size[full]
        out[full] = mix64(np.add.reduceat(x * (np.uint64(2) * mix64(x) + np.uint64(1)), first) + size[full].astype(np.uint64)) | np.uint64(1)
    return out.view(np.int64)


def prefix_length(n, percent: int = PERCENT):
    return n - -(-percent * n // 100) + 1


def needed(na, nb, percent: int = PERCENT):
    """The least overlap of two linked sets with these sizes."""
    return -(-percent * (na + nb) // (100 + percent))


def are_linked(overlap, na, nb, percent: int = PERCENT):
    return 100 * overlap >= percent * (na + nb - overlap)


def signature(token: np.ndarray, size: np.ndarray) -> np.ndarray:
    """256 parities of each set's shingles; sets stand one after the other. Where two sets differ in k shingles, k parities differ at most."""
    bit = mix64(token ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(56)
    one, first = np.uint64(1) << (bit & np.uint64(63)), np.cumsum(size) - size
    return np.stack([np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == word, one, np.uint64(0)), first) for word in range(4)], axis=1)


def possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of entries can be linked: an overlap has shared shingles only, and leaves out those that differ."""
    differ = np.bitwise_count(a["sign"] ^ b["sign"]).sum(axis=1, dtype=np.int64)
    sa, sb = a["s"].astype(np.int64), b["s"].astype(np.int64)
    return needed(a["n"].astype(np.int64), b["n"].astype(np.int64)) <= np.minimum(np.minimum(sa, sb), (sa + sb - differ) // 2)


# Lists of shingles by class, as bytes: the number of classes, then a head for each, all shingles, and a level for each.
HEAD = np.dtype([("cls", "<i8"), ("n", "<u4"), ("size", "<u4")])


def pack_lists(bucket: np.ndarray, cls: np.ndarray, n: np.ndarray, token: np.ndarray, level: np.ndarray | None = None) -> pd.DataFrame:
    """One blob for each bucket; rows of one class in one bucket stand together."""
    order = np.argsort(bucket, kind="stable")
    bucket, cls, n, token = bucket[order], cls[order], n[order], token[order]
    level = np.zeros(0, dtype="u1") if level is None else level[order]
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (cls[1:] != cls[:-1]))
    at = np.flatnonzero(new)
    heads = np.zeros(len(at), dtype=HEAD)
    heads["cls"], heads["n"], heads["size"] = cls[at], n[at], np.diff(np.append(at, len(cls)))
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends, of = np.append(first[1:], len(bucket)), np.searchsorted(at, np.append(first, len(bucket)))
    blobs = [b"".join([np.uint32(of[k + 1] - of[k]).tobytes(), heads[of[k] : of[k + 1]].tobytes(), token[a:b].tobytes(), level[a:b].tobytes()]) for k, (a, b) in enumerate(zip(first.tolist(), ends.tolist()))]
    return pd.DataFrame({"bucket": bucket[first].astype("int32"), "blob": blobs})


def unpack_lists(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cls, n, token and level (none: empty) of all rows."""
    out = []
    for x in blobs:
        heads = np.frombuffer(x, dtype=HEAD, count=int(np.frombuffer(x, dtype="<u4", count=1)[0]), offset=4)
        at, k = 4 + heads.nbytes, int(heads["size"].sum())
        out.append((np.repeat(heads["cls"], heads["size"]), np.repeat(heads["n"], heads["size"]), np.frombuffer(x, dtype="<u8", count=k, offset=at), np.frombuffer(x, dtype="u1", offset=at + 8 * k)))
    return tuple(np.concatenate(c) for c in zip(*out))


def shared_of(cls: np.ndarray, n: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows whose shingle several classes hold, sorted by class, with the level of each: the power of two of its classes."""
    order = np.argsort(token)
    new = np.append(True, token[order][1:] != token[order][:-1])
    run = np.diff(np.append(np.flatnonzero(new), len(token)))
    keep = order[np.repeat(run > 1, run)]
    cls, n, token = cls[keep], n[keep], token[keep]
    order = np.lexsort((cls, token))
    cls, n, token = cls[order], n[order], token[order]
    once = np.append(True, (cls[1:] != cls[:-1]) | (token[1:] != token[:-1]))[: len(cls)]  # copies in several tasks
    cls, n, token = cls[once], n[once], token[once]
    at = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(cls)])
    run = np.diff(np.append(at, len(token)))
    level = np.repeat(np.log2(np.maximum(run, 1)).astype("u1"), run)
    keep = np.flatnonzero(np.repeat(run > 1, run))
    keep = keep[np.argsort(cls[keep], kind="stable")]
    return cls[keep], n[keep], token[keep], level[keep]


class Trie:
    """Sets of ascending numbers as a radix tree in arrays: nodes are runs of numbers, parents come before children.
    n: the sizes that links are judged by; they may count members that no other set has."""

    def __init__(self, sets: list[np.ndarray], n: np.ndarray) -> None:
        keys = [x.astype(">u4").tobytes() for x in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        parent, a, b = [-1], [0], [0]
        runs, at, stack = [], 0, [(0, 0)]  # (node, its depth) on the path to the last set
        last, self.leaf = np.zeros(0, dtype=np.int64), np.zeros(len(sets), dtype=np.int64)
        for k in order:
            x, m = sets[k], min(len(last), len(sets[k]))
            same = int(np.append(last[:m] != x[:m], True).argmax())
            while len(stack) > 1 and stack[-1][1] > same:
                node, depth = stack.pop()
                above = stack[-1][1]
                if above < same:  # the run is split where the paths part
                    cut = a[node] + same - above
                    parent.append(parent[node])
                    a.append(a[node])
                    b.append(cut)
                    parent[node], a[node] = len(parent) - 1, cut
                    stack.append((len(parent) - 1, same))
            if len(x) > same:
                runs.append(x[same:])
                parent.append(stack[-1][0])
                a.append(at)
                b.append(at + len(x) - same)
                at += len(x) - same
                stack.append((len(parent) - 1, len(x)))
            self.leaf[k] = stack[-1][0]
            last = x
        self.run = np.concatenate(runs) if runs else np.zeros(0, dtype=np.int64)
        self.parent, self.a, self.b = (np.array(x, dtype=np.int64) for x in (parent, a, b))
        self.sizes, self.n = np.array([len(x) for x in sets], dtype=np.int64), np.asarray(n, dtype=np.int64)
        depth, up = np.zeros(len(parent), dtype=np.int64), self.parent.copy()
        while (up >= 0).any():
            depth += up >= 0
            up = np.where(up >= 0, self.parent[up], -1)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        self.until = np.zeros(len(parent), dtype=np.int64)  # members on the path to a node's end
        for level in self.levels[1:]:
            self.until[level] = self.until[self.parent[level]] + self.b[level] - self.a[level]
        self.large, self.small = self.up(np.maximum, self.sizes, 0), self.up(np.minimum, self.n, 1 << 62)
        self.child, self.child_at = self.index(self.parent[1:], 1)
        self.ends, self.ends_at = self.index(self.leaf, 0)
        # for membership: (set, member) as one ascending array
        self.width = int(max((x[-1] for x in sets if len(x)), default=0)) + 1
        self.start = np.append(0, np.cumsum(self.sizes))
        self.flat = np.repeat(np.arange(len(sets)) * self.width, self.sizes) + (np.concatenate(sets) if sets else 0)

    def index(self, of: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Things by node: all of them in order, and where each node's begin."""
        return np.argsort(of, kind="stable") + base, np.append(0, np.cumsum(np.bincount(of, minlength=len(self.parent))))

    def up(self, least, of_set: np.ndarray, none: int) -> np.ndarray:
        """The minimum or maximum over the sets of each subtree."""
        out = np.full(len(self.parent), none, dtype=np.int64)
        least.at(out, self.leaf, of_set)
        for level in self.levels[:0:-1]:
            least.at(out, self.parent[level], out[level])
        return out

    def top(self, k: np.ndarray) -> np.ndarray:
        """The child of the root that holds each set."""
        node = self.leaf[k]
        while (deep := self.parent[node] > 0).any():
            node = np.where(deep, self.parent[node], node)
        return node

    def walk(self, probe: np.ndarray, node: np.ndarray, skip) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (probe, set) that are linked, of probes that go into these nodes. skip(probe, node): subtrees to leave."""
        pos, got, found = self.a[node], np.zeros(len(probe), dtype=np.int64), []
        while len(probe):
            live = ~skip(probe, node)
            probe, node, pos, got = probe[live], node[live], pos[live], got[live]
            if not len(probe):
                break
            size = np.minimum(self.b[node] - pos, STRETCH)
            first = np.cumsum(size) - size
            key = np.repeat(probe * self.width, size) + self.run[np.repeat(pos - first, size) + np.arange(size.sum())]
            at = np.searchsorted(self.flat, key)
            hit = self.flat[np.minimum(at, len(self.flat) - 1)] == key
            got, pos = got + np.add.reduceat(hit, first), pos + size
            end = first + size - 1
            remain = np.minimum(self.large[node] - self.until[node] + self.b[node] - pos, self.start[probe + 1] - at[end] - hit[end])
            live = got + remain >= needed(self.n[probe], self.small[node])
            probe, node, pos, got = probe[live], node[live], pos[live], got[live]
            done = pos == self.b[node]
            p, v, g = probe[done], node[done], got[done]
            k, j = self.expand(v, self.ends, self.ends_at)
            good = are_linked(g[k], self.n[p[k]], self.n[j]) & (j != p[k])
            found.append((p[k][good], j[good]))
            k, c = self.expand(v, self.child, self.child_at)
            probe, node, pos, got = (np.concatenate(x) for x in ((probe[~done], p[k]), (node[~done], c), (pos[~done], self.a[c]), (got[~done], g[k])))
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none)

    @staticmethod
    def expand(node: np.ndarray, things: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = begin[node + 1] - begin[node]
        k = np.repeat(np.arange(len(node)), size)
        return k, things[np.repeat(begin[node] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i and j; a component's label is its least member."""
    while (label[i] != label[j]).any():
        a, b = label[i], label[j]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def join_groups(sets: list[np.ndarray], n: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Labels (indices) of the components of sets with the same first member."""
    trie, label = Trie(sets, n), np.arange(len(sets))
    top = trie.top(label)
    order = np.lexsort((label, -trie.sizes, -usual, top))
    place = np.arange(len(sets)) - np.searchsorted(top[order], top[order])  # 0: the most usual of its group
    fresh = np.ones(len(sets), dtype=bool)  # sets that have not probed
    for low, high in ((0, 1), (1, 9), (9, len(sets))):
        turn = order[(place >= low) & (place < high)]
        for k in np.array_split(turn, 1 + len(turn) // 2048):
            if not len(k):
                continue
            least, most = trie.up(np.minimum, np.where(fresh, label, 1 << 62), 1 << 62), trie.up(np.maximum, np.where(fresh, label, -1), -1)
            i, j = trie.walk(k, top[k], lambda p, v: (most[v] < 0) | ((least[v] == label[p]) & (most[v] == label[p])))  # noqa: B023
            fresh[k] = False
            unite(label, i, j)
    return label


def linked_to(probe: np.ndarray, n: int, sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Which of the sets are linked to the probe. All are in one global order; sizes count members that are left out."""
    if not sets:
        return np.zeros(0, dtype=bool)
    rows = ranked([*sets, probe])
    trie = Trie(rows, np.append(sizes, n))
    k = np.full(trie.child_at[1], len(sets))
    _, hit = trie.walk(k, trie.child[: len(k)], lambda p, v: np.zeros(len(p), dtype=bool))
    out = np.zeros(len(sets) + 1, dtype=bool)
    out[hit] = True
    return out[:-1]


def spread(token: np.ndarray, key: int) -> np.ndarray:
    """Where shingles stand in a global order."""
    return mix64(token + np.uint64(key * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF))


def ranked(tokens: list[np.ndarray], key: int = 0) -> list[np.ndarray]:
    """Sets of shingles as the ascending places of their members in a global order."""
    _, which = np.unique(spread(np.concatenate(tokens), key), return_inverse=True)
    return [np.sort(x) for x in np.split(which, np.cumsum([len(t) for t in tokens])[:-1])]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls of each row (cls null: no shingle)."""

    def run(frames):
        for pdf in frames:
            sets = shingle_sets(pdf["text"].tolist())
            out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": [len(s) for s in sets], "cls": pd.Series(classes_of(sets), index=pdf.index).astype("Int64")})
            out.loc[out["n"] == 0, "cls"] = pd.NA
            yield out
            del sets
            give_back()

    return docs.mapInPandas(frugal(run), "doc_id long, n long, cls long")


def heavy_levels(docs: DataFrame) -> np.ndarray:
    """The level of each counter's shingles if it is heavy, else 0. A task's counters pass as a stream through one task for each part; the driver takes
    2**COUNTERS sums, whatever the corpus."""
    width = (1 << COUNTERS) // PARTS

    def count(frames):
        total, seen = np.zeros(1 << COUNTERS, dtype=np.int64), set()
        for pdf in frames:
            sets = shingle_sets(pdf["text"].tolist())
            own = [s for c, s in zip(classes_of(sets).tolist(), sets) if len(s) and not (c in seen or (len(seen) < 1 << 20 and seen.add(c)))]
            if own:
                total += np.bincount(counter_of(np.concatenate(own)), minlength=1 << COUNTERS)
            give_back()
        if total.any():
            yield pd.DataFrame({"bucket": np.arange(PARTS, dtype="int32"), "blob": [x.tobytes() for x in np.split(total, PARTS)]})

    def add(frames):
        own: dict[int, np.ndarray] = {}
        for pdf in frames:
            for b, blob in zip(pdf["bucket"].tolist(), pdf["blob"]):
                own[b] = own.get(b, 0) + np.frombuffer(blob, dtype=np.int64)
        for b, x in own.items():
            yield pd.DataFrame({"bucket": [b], "blob": [x.tobytes()]})

    found = {r.bucket: np.frombuffer(bytes(r.blob), dtype=np.int64) for r in docs.select("text").mapInPandas(frugal(count), PACKED).repartitionById(PARTS, F.col("bucket")).mapInPandas(add, PACKED).collect()}
    total = np.concatenate([found.get(b, np.zeros(width, dtype=np.int64)) for b in range(PARTS)])
    heavy = total >= max(HEAVY, 8 * total.mean())
    return np.where(heavy, np.log2(np.maximum(total, 1)), 0).astype("u1")


def counter_of(token: np.ndarray) -> np.ndarray:
    return (mix64(token ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - COUNTERS)).astype(np.int64)


def shared_sets(docs: DataFrame, nb: int) -> DataFrame:
    """LIVE rows: the classes of which enough shingles are shared, with these in global order."""
    levels = docs.sparkSession.sparkContext.broadcast(heavy_levels(docs))  # 2**COUNTERS bytes
    by_class = lambda cls: (mix64(cls.view(np.uint64)) % np.uint64(nb)).astype(np.int64)

    def entries(frames):
        held, count, seen = [], 0, set()

        def out():
            size = [len(x) for _, x in held]
            cls, token = np.repeat([c for c, _ in held], size), np.concatenate([x for _, x in held])
            n, level = np.repeat(size, size), levels.value[counter_of(token)]
            for heavy in (False, True):
                k = np.flatnonzero((level > 0) == heavy)
                if len(k):
                    bucket = by_class(cls[k]) if heavy else (mix64(token[k]) % np.uint64(nb)).astype(np.int64)
                    yield pack_lists(bucket, cls[k], n[k], token[k], level[k] if heavy else None).assign(heavy=heavy)

        for pdf in frames:
            sets = shingle_sets(pdf["text"].tolist())
            for c, s in zip(classes_of(sets).tolist(), sets):
                if not len(s) or c in seen:
                    continue
                if len(seen) < 1 << 20:  # copies in one task are left out here; others meet their class later
                    seen.add(c)
                held.append((c, s))
                count += len(s)
                if count >= FLUSH:
                    yield from out()
                    held, count = [], 0
            give_back()
        if held:
            yield from out()

    def meet(frames):
        blobs = []
        for pdf in frames:
            for blob, heavy, bucket in zip(pdf["blob"], pdf["heavy"], pdf["bucket"]):
                if heavy:  # it stands by its class already
                    yield pd.DataFrame({"bucket": np.array([bucket], dtype="int32"), "blob": [blob]})
                else:
                    blobs.append(blob)
        if blobs:
            cls, n, token, level = shared_of(*unpack_lists(blobs)[:3])
            if len(cls):
                yield pack_lists(by_class(cls), cls, n, token, level)

    def gather(frames):
        blobs = [b for pdf in frames for b in pdf["blob"]]
        if not blobs:
            return
        cls, n, token, level = unpack_lists(blobs)
        order = np.lexsort((token, level, cls))
        order = order[np.append(True, (cls[order][1:] != cls[order][:-1]) | (token[order][1:] != token[order][:-1]))]  # heavy ones come from each task that has the class
        cls, n, token, level = cls[order], n[order], token[order], level[order]
        at = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
        size = np.diff(np.append(at, len(cls)))
        for part in np.array_split(np.flatnonzero(100 * size >= PERCENT * n[at].astype(np.int64)), 1 + len(cls) // FLUSH):
            own = [slice(a, a + k) for a, k in zip(at[part].tolist(), size[part].tolist())]
            firsts = [[int(token[x][spread(token[x], key).argmin()].view(np.int64)) for key in range(KEYS)] for x in own]
            yield pd.DataFrame({"cls": cls[at[part]], "n": n[at[part]].astype("int32"), "firsts": firsts, "usual": [float(level[x].mean()) for x in own], "tokens": [token[x].tobytes() for x in own], "cold": [int((level[x] < HOT).sum()) for x in own]})

    met = to_buckets(docs.select("text").mapInPandas(frugal(entries), f"{PACKED}, heavy boolean")).mapInPandas(frugal(meet), PACKED)
    return to_buckets(met).mapInPandas(frugal(gather), LIVE)


def dealt(live: DataFrame, nb: int) -> DataFrame:
    """live by order and group: its first shingle and, in groups over GROUP classes, a part; there the most usual class is in each."""
    live = live.select("cls", "n", "usual", "tokens", F.posexplode("firsts").alias("key", "first"))
    sizes = live.groupBy("key", "first").agg(F.count("*").alias("many"), F.max(F.struct("usual", F.length("tokens").alias("length"), "cls")).alias("pivot"))
    hot = sizes.where(F.col("many") > GROUP).select("key", "first", F.ceil(F.col("many") / GROUP).alias("parts"), F.col("pivot.cls").alias("pivot"))
    rows = live.join(hot, ["key", "first"], "left")
    own = rows.where("pivot is null or cls != pivot").select(*live.columns, F.coalesce(F.pmod(F.xxhash64("cls"), "parts"), F.lit(-1)).alias("part"), F.lit(0).alias("copy"))
    pivot = rows.where("cls = pivot").select(*live.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("copy"))
    both = own.unionByName(pivot).withColumn("bucket", F.pmod(F.xxhash64("key", "first", "part"), F.lit(nb)).cast("int"))
    return to_buckets(both).sortWithinPartitions("part", "key", "first", "cls")


def joined(live: DataFrame, nb: int) -> DataFrame:
    """The trie join: a class, and what its component in its group is called, if that is another class (PAIR)."""

    def run(frames):
        held, count, now = [], 0, None

        def out():
            cls, copy = np.array([r.cls for r in held], dtype=np.int64), np.array([r.copy for r in held], dtype=bool)
            sets = ranked([np.frombuffer(r.tokens, dtype="<u8") for r in held], held[0].key)
            label = join_groups(sets, np.array([r.n for r in held]), np.array([r.usual + 1000 * r.copy for r in held]))
            name = cls.copy()
            name[label[copy]] = cls[copy]  # parts of one group agree on the class that is in all of them
            name = name[label]
            return pd.DataFrame({"a": cls, "b": name})[cls != name]

        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if held and (r.part, r.key, r.first) != now and (count >= TREE or r.part >= 0 or r.key != now[1]):  # parts of split groups have tries of their own
                    yield out()
                    held, count = [], 0
                now = (r.part, r.key, r.first)
                held.append(r)
                count += len(r.tokens) // 8
        if held:
            yield out()

    return dealt(live, nb).mapInPandas(frugal(run), PAIR)


def prefixes(live: DataFrame, labels: DataFrame, nb: int) -> DataFrame:
    """ENTRY rows of each class' prefix; hot: of shingles that 2**HOT classes or more hold, without a bucket."""

    def run(frames):
        for pdf in frames:
            for part in np.array_split(np.arange(len(pdf)), 1 + int(pdf["tokens"].map(len).sum()) // (8 * FLUSH)) if len(pdf) else ():
                own = pdf.iloc[part]
                tokens, n, cold = [np.frombuffer(x, dtype="<u8") for x in own["tokens"]], own["n"].to_numpy(dtype=np.int64), own["cold"].to_numpy()
                s = np.array([len(x) for x in tokens], dtype=np.int64)
                size = s - -(-PERCENT * n // 100) + 1
                e = np.zeros(size.sum(), dtype=ENTRY)
                if not len(e):
                    continue
                e["token"] = np.concatenate([x[:k] for x, k in zip(tokens, size.tolist())])
                for f, x in (("cls", own["cls"]), ("label", own["label"]), ("n", n), ("s", s), ("sign", signature(np.concatenate(tokens), s))):
                    e[f] = np.repeat(np.asarray(x), size, axis=0)
                hot = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size) >= np.repeat(cold, size)
                yield by_token(e[~hot], nb).assign(hot=False)
                if hot.any():
                    yield pd.DataFrame({"bucket": [-1], "blob": [e[hot].tobytes()], "hot": [True]})

    rows = live.select("cls", "n", "tokens", "cold").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    return rows.mapInPandas(frugal(run), "bucket int, blob binary, hot boolean")


def by_token(rows: np.ndarray, nb: int) -> pd.DataFrame:
    return packed((mix64(rows["token"]) % np.uint64(nb)).astype(np.int64), rows)


def distinct_pairs(found: list[tuple[np.ndarray, np.ndarray]]):
    if found:
        x, y = (np.concatenate(c) for c in zip(*found))
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        yield pd.DataFrame(both, columns=["a", "b"])


def compared(a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries' classes with different labels that can be linked."""
    good = (a["label"] != b["label"]) & possible(a, b)
    return [(a["cls"][good], b["cls"][good])] if good.any() else []


def across_labels(rows: np.ndarray):
    """Pairs of classes in the same shingle's group; rows: ENTRY, all of each shingle."""
    rows = rows[np.lexsort((rows["label"], rows["token"]))]
    if not len(rows):
        return
    by_shingle = np.append(rows["token"][1:] != rows["token"][:-1], True)
    by_label = by_shingle | np.append(rows["label"][1:] != rows["label"][:-1], True)
    k = np.arange(len(rows))
    stop, start = (np.flatnonzero(x)[np.cumsum(x) - x] + 1 for x in (by_shingle, by_label))  # a row's partners: after its label, in its group
    size = stop - start
    found, done = [], np.cumsum(size)
    for part in np.split(k, np.searchsorted(done, np.arange(4 * PAIRS, done[-1], 4 * PAIRS))):
        n = size[part]
        left = np.repeat(part, n)
        right = np.repeat(start[part] - (np.cumsum(n) - n), n) + np.arange(len(left))
        found += compared(rows[left], rows[right])
        if len(found) > 64:
            found = [tuple(x.to_numpy().T) for x in distinct_pairs(found)]
    yield from distinct_pairs(found)


def hot_pairs(hot: DataFrame) -> DataFrame:
    """The same for shingles of many classes, in a grid of blocks of all classes and of those outside the commonest label; both sides of a cell are
    bounded by about 2**(HOT - 1) classes."""
    counts = hot.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("every"), F.count("*").alias("labels"))
    mixed = counts.where("labels > 1").select("token", F.col("top.label").alias("common"), F.ceil(F.col("every") / (1 << (HOT - 1))).alias("blocks"), F.ceil((F.col("every") - F.col("top.c")) / (1 << (HOT - 1))).alias("turns"))
    rows = hot.join(mixed, "token")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = rows.withColumn("block", F.pmod(F.xxhash64("cls"), "blocks")).withColumn("turn", every("turns"))
    few = rows.where("label != common").withColumn("block", every("blocks")).withColumn("turn", F.pmod(F.xxhash64("cls", F.lit(1)), "turns"))

    def run(key, few, own):
        if not len(few) or not len(own):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        a, b = (np.zeros(len(x), dtype=ENTRY) for x in (few, own))
        for f in ("cls", "label", "n", "s"):
            a[f], b[f] = few[f"f_{f}"], own[f]
        a["sign"], b["sign"] = (np.frombuffer(b"".join(x), dtype="<u8").reshape(-1, 4) for x in (few["f_sign"], own["sign"]))
        found = []
        for k in np.array_split(np.arange(len(a)), 1 + len(a) * len(b) // (4 * PAIRS)):
            found += compared(np.repeat(a[k], len(b)), np.tile(b, len(k)))
        return next(iter(distinct_pairs(found)), pd.DataFrame({"a": [], "b": []})).astype("int64")

    columns = ["token", "block", "turn", "cls", "label", "n", "s", "sign"]
    few = few.select(*(F.col(c).alias(f"f_{c}") for c in columns))  # names of its own: both sides come from hot
    return few.groupBy("f_token", "f_block", "f_turn").cogroup(own.select(columns).groupBy("token", "block", "turn")).applyInPandas(run, PAIR)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nb = buckets(spark)
    described = stash(describe(docs), "ngram-docs")
    live = stash(shared_sets(docs, nb), "ngram-live")
    links = stash(joined(live, nb), "ngram-links")
    labels = connected(links).select(F.col("node").alias("cls"), F.col("root").alias("label"))
    entries = stash(prefixes(live, labels, nb), "ngram-prefixes")

    def rows_of(frames):
        for pdf in frames:
            for blob in pdf["blob"]:
                e = np.frombuffer(blob, dtype=ENTRY)
                yield pd.DataFrame({f: e[f].astype("<u8").view("<i8") for f in ("token", "cls", "label", "n", "s")} | {"sign": [x.tobytes() for x in e["sign"]]})

    rest = exchange(entries.where("not hot").select("bucket", "blob"), across_labels, ENTRY, PAIR)
    rest = rest.unionByName(hot_pairs(entries.where("hot").select("blob").mapInPandas(rows_of, "token long, cls long, label long, n long, s long, sign binary")))
    rest = stash(rest.distinct(), "ngram-pairs")
    roots = connected(links.unionByName(verify(rest, live)))
    # cls -> component -> its smallest document
    per_class = described.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    per_class = stash(per_class.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "ngram-classes")
    least = per_class.groupBy("root").agg(F.min("least").alias("component"))
    found = per_class.join(least, "root").select("cls", "component")
    rows = described.join(found, "cls", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def verify(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked: the partners of a class go into tries of FAN sets, and it walks them."""
    fans = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salted = pairs.join(fans, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.expr(f"1 + n div {FAN}")).alias("salt"))
    sets = live.select("cls", "n", "tokens")
    right = salted.join(sets.withColumnRenamed("cls", "b"), "b").select("a", "salt", "b", "n", "tokens")
    left = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("cls", "a"), "a").select(F.col("a").alias("la"), F.col("salt").alias("ls"), F.col("n").alias("ln"), F.col("tokens").alias("lt"))  # names of its own: both sides come from pairs

    def check(key, probe, partners):
        if not len(probe) or not len(partners):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        hit = linked_to(np.frombuffer(probe["lt"].iloc[0], dtype="<u8"), int(probe["ln"].iloc[0]), [np.frombuffer(x, dtype="<u8") for x in partners["tokens"]], partners["n"].to_numpy())
        return pd.DataFrame({"a": key[0], "b": partners["b"].to_numpy()[hit]}).astype("int64")

    return left.groupBy("la", "ls").cogroup(right.groupBy("a", "salt")).applyInPandas(check, PAIR)
