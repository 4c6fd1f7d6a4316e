"""Language-model scoring: a causal self-attention model on subword ids, trained in numpy.

Texts become words, words become byte-level subword ids (without loss, a blank before each word). One attention
layer with relative-place biases and one hidden layer give the next id's probability over the whole vocabulary, by an
exact two-level softmax: a class, then an id in it, both from the hidden state. A class holds ids that begin a word
(the end of a text is one), or only others, so the chance that a word ends is a sum over classes. Ids that no training text has share one slot of their
kind evenly. Scoring runs over blocks of BLOCK ids that see the block before them, so each
id is scored once with BLOCK to 2 * BLOCK - 1 places of context, many blocks in one masked batch; masks keep texts
apart.

A word's probability under the network is that of its ids, given that a word begins, and that the word ends there. It is mixed,
with weight MIX, with the word's frequency (c + 1) / (N + V + 1); what that leaves for unknown words, 1 / (N + V + 1), falls to
them as the network has it. Both are distributions over words and the end of a text, so `score` is the logarithm of a probability.

Word counts come from every training text: counted in tasks, summed by hash, never gathered. The most frequent
words (KEEP at most, whatever the corpus) are sent to all tasks; occurrences of others meet their counts by
shuffle. The network is fitted on all ids of the training texts, in windows that follow each other (score() takes a share instead: windows at
seeded places). Windows fall into groups of a bounded size; each group takes its steps in a task, and the groups' weights are averaged ROUNDS
times. A group of more windows than STEPS * BATCH is dealt over the rounds, so that each window is used in one of them and a task holds one round's.

Training texts are those whose crc32(doc_id as text) modulo 7 is not 2. Null texts are empty and score their end
alone. Rows with equal doc_id and text are one text that counts once; null doc_ids are training texts. Without any
training text all counts are 0 and the network keeps its first weights. Other columns of docs are left out; a very long
text is scored in blocks, and its words are packed in memory once.
"""

from __future__ import annotations

import copy
import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, buckets, crc32_of, exchange, folded, give_back, mix64, packed, parts, stash, to_buckets, tune, word_hashes
from .suffix_dedup import _keyed

STEPS, RATE, BATCH, ROUNDS = 700, 0.01, 48, 7
#: A large group's windows, and windows of one step at most.
GROUP, WIDE = 1 << 17, 384
#: For a quick fit (share None): windows' share of all ids of training texts, and the characters a corpus has at least before that share holds.
SHARE, SMALL = 1 / 32, 1 << 22
WIDTH, HIDDEN, BLOCK = 16, 32, 32
SPAN = 2 * BLOCK
#: Windows of a batch that pass attention together.
NEAR = 16
#: Numbers of a vector that are summed together: vectors as long as the network or the vocabulary are summed slice by slice.
SLICE = 1 << 16
MIX = 0.65
KEEP = 1 << 20
FLUSH = 16 << 20
COUNT = np.dtype([("h", "<u8"), ("n", "<i8")])
OCCURS = np.dtype([("h", "<u8"), ("doc", "<i8"), ("lp", "<f4")])
PART = np.dtype([("doc", "<i8"), ("held", "u1"), ("n", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])


#: Words of letters with a stop or comma at most: each part is one pre-token of a byte-level tokenizer.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+[.,]?").fullmatch
#: Bytes of letters that a PLAIN word has at most to be cut into ids beside many others.
LONG = 40


class Merges:
    """A byte-pair vocabulary's merges, taken for many words at once: a word's first pair of the least rank merges until none is left, as in the library."""

    SLOTS, NONE = 19, np.int32(2**31 - 1)

    @classmethod
    def of(cls, file: dict) -> Merges | None:
        """None where the library does more than that."""
        model, before = file["model"], file["pre_tokenizer"] or {}
        more = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) or file["normalizer"] or before.get("type") != "ByteLevel"
        letters = [b for b in range(256) if 97 <= b <= 122 or 0x80 <= b]
        if model.get("type") != "BPE" or more or len(model["vocab"]) >= 0xFFFF or len(model["merges"]) >= 1 << 24 or not all(x in model["vocab"] for x in ("Ġ", ".", ",", *map(_byte, letters))):
            return None
        return cls(model["vocab"], model["merges"], letters)

    def __init__(self, vocab: dict[str, int], merges: list, letters: list[int]) -> None:
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        rank = {vocab[a] << 16 | vocab[b]: (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.into = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys, ranks = np.fromiter(rank, dtype=np.uint32, count=len(rank)), np.array([k for k, _ in rank.values()], dtype=np.int32)
        order = np.argsort(keys)
        keys, ranks = keys[order], ranks[order]
        slot = self.slot(keys)
        own, first, n = np.unique(slot, return_index=True, return_counts=True)
        self.key, self.rank, self.shared = np.full(1 << self.SLOTS, 0xFFFFFFFF, dtype=np.uint32), np.full(1 << self.SLOTS, -1, dtype=np.int32), np.zeros(1 << self.SLOTS, dtype=bool)
        self.key[own], self.rank[own], self.shared[own[n > 1]] = keys[first], ranks[first], True
        self.rest, self.rest_rank = keys[self.shared[slot]], ranks[self.shared[slot]]
        self.letter = np.zeros(256, dtype=np.int32)
        self.letter[letters] = [vocab[_byte(b)] for b in letters]
        self.blank, self.stops = vocab["Ġ"], np.array([vocab["."], vocab[","]], dtype=np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.SLOTS)

    def ranks(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids (-1: none) with the places where they stand, in one number; NONE if they don't merge."""
        keys = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32) & np.uint32(0xFFFF)
        slot = self.slot(keys)
        out = np.where((self.key.take(slot) == keys) & (a >= 0) & (b >= 0), self.rank.take(slot), -1)
        some = np.flatnonzero(self.shared.take(slot) & (a >= 0) & (b >= 0))
        if len(some):
            at = np.minimum(np.searchsorted(self.rest, keys[some]), len(self.rest) - 1)
            out[some] = np.where(self.rest[at] == keys[some], self.rest_rank[at], -1)
        return np.where(out >= 0, out << 6 | place, self.NONE).astype(np.int32)

    def words(self, data: np.ndarray, begin: np.ndarray, stem: np.ndarray, stop: np.ndarray, group: int = 1 << 13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many ids words have, where they begin, and all ids. A word: `stem` bytes of letters, LONG at most, from `begin` on, then a stop (-1: none)."""
        size, at, parts_, used = np.empty(len(begin), dtype=np.int64), np.empty(len(begin), dtype=np.int64), [], 0
        order = np.argsort(stem, kind="stable")  # words of about a length together
        for k in range(0, len(order), group):
            own = order[k : k + group]
            ids = self.merged(data, begin[own], stem[own])
            ids[-1] = np.where(stop[own] >= 0, self.stops[stop[own]], -1)
            ids = ids.T
            n = (ids >= 0).sum(axis=1)
            size[own], at[own] = n, used + np.cumsum(n) - n
            parts_.append(ids[ids >= 0])
            used += len(parts_[-1])
        return size, at, np.concatenate(parts_)

    def merged(self, data: np.ndarray, begin: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """The ids of words, one below the other with -1 between them; a first row and two last ones are free."""
        n, rows = len(begin), int(stem.max()) + 4
        ids = np.full((rows, n), -1, dtype=np.int32)
        ids[1] = self.blank
        for j in range(rows - 4):
            own = np.flatnonzero(stem > j)
            ids[j + 2, own] = self.letter[data[begin[own] + j]]
        after, before = (np.repeat(np.arange(rows, dtype=np.int32)[:, None] + d, n, axis=1).ravel() for d in (1, -1))
        rank = np.full((rows, n), self.NONE, dtype=np.int32)
        rank[1:-2] = self.ranks(ids[1:-2].ravel(), ids[2:-1].ravel(), np.repeat(np.arange(1, rows - 2, dtype=np.int32), n)).reshape(-1, n)
        flat, ranks = ids.ravel(), rank.ravel()
        while len(own := np.flatnonzero((best := rank.min(axis=0)) < self.NONE)):
            best = best[own]
            k = best & 63
            here = k * n + own
            there = after.take(here) * n + own
            then = after.take(there)
            behind, ahead = then * n + own, before.take(here)
            front = ahead * n + own
            new = self.into.take(best >> 6)
            flat[here], flat[there], ranks[there], after[here], before[behind] = new, -1, self.NONE, then, k
            ranks[here] = self.ranks(new, flat.take(behind), k)
            ranks[front] = self.ranks(flat.take(front), new, ahead)
        return ids


def _byte(b: int) -> str:
    """A byte that is no blank, as byte-level vocabularies write it."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(b) if b in shown else chr(256 + sorted(set(range(256)) - set(shown)).index(b))


class Subwords:
    """Ids of words with a byte-level tokenizers file; the end of a text is one more id."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.end = max(vocab.values()) + 1
        self.begins = np.zeros(self.end + 1, dtype=bool)
        self.begins[[i for p, i in vocab.items() if p.startswith("Ġ")]] = True  # the blank of a byte-level vocabulary
        self.library.encode_special_tokens = True  # a special token's text is a text like others
        self.table = WordIds(self.spans, "<u2" if self.end < 1 << 16 else "<u4", spans=True)
        self.merges = Merges.of(json.loads(self.library.to_str()))
        self.plain = self.library
        if not self.merges:  # PLAIN words are one pre-token and their stop another, so they need no pattern
            self.plain = Tokenizer.from_str(self.library.to_str())
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.Split(".", "isolated"), pre_tokenizers.Split(",", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        give_back()

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """words() of words that stand in data."""
        size, at, flat = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64), np.zeros(0, dtype=self.table.dtype)
        own = np.zeros(len(start), dtype=bool)
        if self.merges:
            more = (data >= 0x9F) & (data <= 0xBF) & (data != 0xB7)  # PLAIN, byte by byte: what may follow 0xC3
            more[1:] &= data[:-1] == 0xC3
            more[:1] = False
            letter = (data >= 0x61) & (data <= 0x7A) | more
            letter[:-1] |= more[1:]
            others = np.append(0, np.cumsum(~letter))
            last = data[end - 1]
            stop = np.where(last == 0x2E, 0, np.where(last == 0x2C, 1, -1))
            stem = end - start - (stop >= 0)
            own = (others[start] == others[start + stem]) & (stem > 0) & (stem <= LONG)
            if own.any():
                size[own], at[own], flat = self.merges.words(data, start[own], stem[own], stop[own])
                flat = flat.astype(self.table.dtype)
        if not own.all():
            rest = ~own
            size[rest], begin, ids = self.words([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[rest].tolist(), end[rest].tolist())])
            at[rest], flat = begin + len(flat), np.concatenate([flat, ids])
        return size, at, flat

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many ids each word has, where they begin, and all ids."""
        plain = np.fromiter((PLAIN(w) is not None for w in words), dtype=bool, count=len(words))
        size, at, flat = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), np.zeros(0, dtype=self.table.dtype)
        for tokenizer, own in ((self.plain, np.flatnonzero(plain)), (self.library, np.flatnonzero(~plain))):
            for k in range(0, len(own), 1 << 16):  # lists of numbers are large; few live at a time
                part = own[k : k + (1 << 16)]
                ids = self.encoded(tokenizer, [words[i] for i in part.tolist()])
                first = np.flatnonzero(self.begins[ids])
                if len(first) != len(part):
                    raise ValueError("words and their first ids don't match")
                size[part], at[part] = np.diff(np.append(first, len(ids))), first + len(flat)
                flat = np.concatenate([flat, ids])
        return size, at, flat

    def encoded(self, tokenizer, words: list[str], group: int = 256) -> np.ndarray:
        texts = [" " + " ".join(words[i : i + group]) for i in range(0, len(words), group)]
        return np.concatenate([np.array(x.ids, dtype=self.table.dtype) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])


_SUBWORDS: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    """One for each Python worker."""
    if path not in _SUBWORDS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _SUBWORDS[path] = Subwords(path)
    return _SUBWORDS[path]


class Network:
    """Weights, and where ids stand: a class and a slot in it, and an embedding row. counts: of each id, the end (the last)
    included, over all training texts; begins: which ids begin a word, or end a text."""

    def __init__(self, counts: np.ndarray, begins: np.ndarray, seed: int = 5) -> None:
        seen = counts > 0
        seen[-1] = True
        usual = max(2, int(np.ceil(np.sqrt(seen.sum()))))
        self.slots = 2 * usual
        self.cls, self.slot, self.row = (np.zeros(len(counts), dtype=np.int32) for _ in range(3))
        self.row[seen], self.row[~seen] = np.arange(seen.sum()), seen.sum()
        self.share = np.zeros(len(counts), dtype=np.float32)
        self.begins, self.widths, mass = [], [], []
        for kind in (True, False):
            own, rest = np.flatnonzero(seen & (begins == kind)), np.flatnonzero(~seen & (begins == kind))
            own = own[np.lexsort((own, -counts[own]))]
            many = len(own) + (len(rest) > 0)
            widths = ([max(1, usual // 4)] * 4 + [max(1, usual // 2)] * 4 + [usual] * 4 + [self.slots] * many) if many else []  # frequent ids in small classes
            cut = np.append(0, np.minimum(np.cumsum(widths, dtype=np.int64), many))
            cut = cut[: 1 + np.searchsorted(cut, many)]
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                ids = own[x:y]
                self.cls[ids], self.slot[ids] = len(mass), np.arange(len(ids))
                held = np.zeros(self.slots)
                held[: len(ids)] = counts[ids] + 1.0
                if len(rest) and y == many:
                    self.cls[rest], self.slot[rest], self.share[rest] = len(mass), y - x - 1, -np.log10(len(rest))
                    held[y - x - 1] = 1.0
                mass.append(held)
                self.widths.append(y - x)
                self.begins.append(kind)
        self.begins, mass = np.array(self.begins), np.array(mass)
        r = np.random.default_rng(seed)
        normal = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        total = mass.sum(axis=1)
        with np.errstate(divide="ignore"):
            inner = np.maximum(np.log(mass / total[:, None]), -1e4).astype(np.float32)  # slots without an id have no chance
        self.w = {
            "e": (r.standard_normal((seen.sum() + 1, WIDTH)) * 0.3).astype(np.float32), "qkv": normal(WIDTH, 3 * WIDTH), "o": normal(WIDTH, WIDTH) * 0.3, "place": np.zeros(2 * BLOCK, dtype=np.float32),
            "h": normal(WIDTH, HIDDEN), "hb": np.zeros(HIDDEN, dtype=np.float32), "g": normal(HIDDEN, WIDTH) * 0.3, "out": normal(WIDTH, len(mass)) * 0.3, "ob": np.log(total / total.sum()).astype(np.float32),
            "in": normal(len(mass), WIDTH, self.slots) * 0.3, "ib": inner,
        }

    def fit(self, stream: np.ndarray, steps: int = STEPS, rate: float = RATE, batch: int = BATCH, seed: int = 6) -> None:
        """Adam on windows of a stream of texts, each with its end."""
        if len(stream) > SPAN:
            at = np.random.default_rng(seed).integers(0, len(stream) - SPAN, steps * batch)
            self.fit_windows(stream[at[:, None] + np.arange(SPAN + 1)[None, :]], self.moments(), range(1, steps + 1), steps, rate, batch)

    def copy(self) -> Network:
        out = copy.copy(self)
        out.w = {k: x.copy() for k, x in self.w.items()}
        return out

    def moments(self) -> tuple[dict, dict]:
        return {k: np.zeros_like(x) for k, x in self.w.items()}, {k: np.zeros_like(x) for k, x in self.w.items()}

    def fit_windows(self, windows: np.ndarray, moments: tuple[dict, dict], numbers: range, steps: int, rate: float = RATE, batch: int = BATCH) -> None:
        """Adam's steps of these numbers (from 1) out of `steps`, on windows of SPAN + 1 ids in turn. A batch passes attention a few windows at a
        time, which stay in cache, and both softmax levels in the order of its targets' classes."""
        w, (m, v), kind, n = self.w, moments, self.w["e"].dtype, batch * SPAN
        off = np.arange(SPAN)[:, None] - np.arange(SPAN)[None, :]
        by_off, ones, half = np.maximum(off, 0), np.ones(max(SPAN, self.slots, len(self.begins)), dtype=kind), kind.type(1 / np.sqrt(WIDTH))
        cells = np.arange(w["e"].size).reshape(w["e"].shape)
        q, k, val, x = slice(WIDTH), slice(WIDTH, 2 * WIDTH), slice(2 * WIDTH, 3 * WIDTH + 1), slice(3 * WIDTH + 1, None)
        for step in numbers:
            ids = windows.take(((step - 1) * batch + np.arange(batch)) % len(windows), axis=0)
            # a window begins anywhere; what stands before a text's end is masked for what follows it
            text = np.cumsum(ids[:, :-1] == len(self.cls) - 1, axis=1)
            u, t = self.row.take(ids[:, :-1]), self.cls.take(ids[:, 1:]).ravel()
            by = np.argsort(t.astype(np.uint16), kind="stable")
            slot, cut = self.slot.take(ids[:, 1:]).ravel().take(by), np.append(0, np.cumsum(np.bincount(t, minlength=len(w["ob"])))).tolist()
            # all that attention takes from an id: query, key, value, a one that sums the weights, its embedding; a last column carries biases
            qkv = w["qkv"].copy()
            qkv[:, q] *= half
            table = np.zeros((len(w["e"]), 4 * WIDTH + 2), dtype=kind)
            table[:, : 3 * WIDTH], table[:, 3 * WIDTH], table[:, x][:, :WIDTH] = w["e"] @ qkv, 1, w["e"]
            o, g = np.eye(WIDTH + 1, dtype=kind), np.zeros((HIDDEN, WIDTH + 1), dtype=kind)
            o[:WIDTH, :WIDTH], g[:, :WIDTH] = w["o"], w["g"]
            hb, outer = np.concatenate([w["h"], w["hb"][None, :]]), np.concatenate([w["out"], w["ob"][None, :]])
            place = np.where(off >= 0, w["place"][by_off], -1e9).astype(kind)
            length = lambda s: np.sqrt((table[:, s] ** 2).sum(axis=1).max())  # noqa: B023, E731
            steep = length(q) * length(k) + w["place"].max() > 60
            hidden, kept = np.empty((n, WIDTH + 1), dtype=kind), []
            for a in range(0, batch, NEAR):
                p = table.take(u[a : a + NEAR], axis=0)
                z = p[:, :, q] @ p[:, :, k].transpose(0, 2, 1)
                z += place
                if steep:
                    z -= z.max(axis=2, keepdims=True)
                np.exp(z, out=z)
                if len(parted := np.flatnonzero(text[a : a + NEAR, -1])):
                    z[parted] *= text[a + parted][:, :, None] == text[a + parted][:, None, :]
                y = z @ p[:, :, val]
                r = 1 / y[:, :, WIDTH:]
                y *= r
                y = y.reshape(-1, WIDTH + 1)
                h = y @ o
                h += p[:, :, x].reshape(h.shape)
                rr = h @ hb
                np.maximum(rr, 0, out=rr)
                np.add(h, rr @ g, out=hidden[a * SPAN : a * SPAN + len(h)])
                kept.append((p, z, r, y, h, rr))
            hidden = hidden.take(by, axis=0)
            d = _shares(hidden, outer, ones, n)
            for c in np.flatnonzero(np.diff(cut)).tolist():
                d[cut[c] : cut[c + 1], c] -= 1 / n
            both = hidden.T @ d
            grad = {"out": both[:-1], "ob": both[-1], "in": np.zeros_like(w["in"]), "ib": np.zeros_like(w["ib"])}
            dg = d @ w["out"].T
            for c in np.flatnonzero(np.diff(cut)).tolist():
                own, wide = slice(cut[c], cut[c + 1]), self.widths[c]
                miss = _shares(hidden[own], np.concatenate([w["in"][c, :, :wide], w["ib"][c, None, :wide]]), ones, n)
                miss.ravel()[np.arange(0, miss.size, wide) + slot[own]] -= 1 / n
                both = hidden[own].T @ miss
                grad["in"][c, :, :wide], grad["ib"][c, :wide] = both[:-1], both[-1]
                dg[own] += miss @ w["in"][c, :, :wide].T
            back = np.empty_like(by)
            back[by] = np.arange(n)
            dg, dx, far = dg.take(back, axis=0), np.empty((n, WIDTH), dtype=kind), np.zeros((SPAN, SPAN), dtype=kind)
            gg, gh, go, gq = np.zeros_like(w["g"]), np.zeros_like(hb), np.zeros_like(o), np.zeros_like(qkv)
            for a, (p, z, r, y, h, rr) in zip(range(0, batch, NEAR), kept):
                own = slice(a * SPAN, a * SPAN + len(h))
                dr = dg[own] @ w["g"].T
                dr *= rr > 0
                gg += rr.T @ dg[own]
                gh += h.T @ dr
                dh = dr @ w["h"].T
                dh += dg[own]
                go[:, :WIDTH] += y.T @ dh
                dy = np.empty_like(y)
                np.matmul(dh, w["o"].T, out=dy[:, :WIDTH])
                # softmax takes from each gradient their mean; under the weights that is what the whole sum has
                np.negative(np.einsum("ij,ij->i", dy[:, :WIDTH], y[:, :WIDTH]), out=dy[:, WIDTH])
                dy = dy.reshape(len(z), SPAN, -1)
                dy *= r
                dqkv = np.empty((len(z), SPAN, 3 * WIDTH), dtype=kind)
                np.matmul(z.transpose(0, 2, 1), dy[:, :, :WIDTH], out=dqkv[:, :, 2 * WIDTH :])
                da = dy @ p[:, :, val].transpose(0, 2, 1)
                da *= z
                far += (ones[: len(z)] @ da.reshape(len(z), -1)).reshape(far.shape)
                np.matmul(da, p[:, :, k], out=dqkv[:, :, q])
                np.matmul(da.transpose(0, 2, 1), p[:, :, q], out=dqkv[:, :, k])
                dqkv = dqkv.reshape(-1, 3 * WIDTH)
                gq += p[:, :, x].reshape(h.shape)[:, :WIDTH].T @ dqkv
                np.matmul(dqkv, qkv.T, out=dx[own])
                dx[own] += dh
            gq[:, q] *= half
            grad |= {"g": gg, "h": gh[:-1], "hb": gh[-1], "o": go[:-1, :-1], "qkv": gq, "e": np.zeros_like(w["e"])}
            grad["place"] = np.bincount(by_off.ravel(), (far * (off >= 0)).ravel(), minlength=SPAN).astype(kind)
            np.add.at(grad["e"].ravel(), cells.take(u.ravel(), axis=0).ravel(), dx.ravel())
            now = rate * min(1, step / 30) * (1 - 0.9 * step / steps)
            for name, gr in grad.items():
                m[name] *= 0.9
                m[name] += 0.1 * gr
                v[name] *= 0.99
                v[name] += 0.01 * (gr * gr)
                change = v[name] / (1 - 0.99**step)
                np.sqrt(change, out=change)
                change += 1e-6
                np.divide(m[name], change, out=change)
                change *= now / (1 - 0.9**step)
                w[name] -= change

    def score(self, ids: np.ndarray, text: np.ndarray, blocks: int = 64, group: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """Of texts that stand one after the other, each with its end: log10 probabilities of each id, and of that the id at its
        place begins a word or ends the text. text: the number of each id's text. A text's first block begins with it, so its
        values don't depend on other texts."""
        end, w, n = len(self.cls) - 1, self.w, len(ids)
        begins = np.flatnonzero(np.append(True, text[1:] != text[:-1]))[: n]
        blocks_of = -(-np.diff(np.append(begins, n)) // BLOCK)
        opening = np.cumsum(blocks_of) - blocks_of  # the texts' first blocks
        at = np.arange(n) + np.repeat(opening * BLOCK - begins, np.diff(np.append(begins, n)))
        size = int(blocks_of.sum()) * BLOCK
        before = np.append(end, ids[:-1])
        before[begins] = end
        rows = np.zeros(BLOCK + size, dtype=np.int32)  # a block before the first
        rows[BLOCK + at] = self.row[before]
        off = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
        place = np.where(off >= 0, w["place"][np.clip(off, 0, 2 * BLOCK - 1)], -1e9).astype(np.float32)
        # all that attention takes from an id: query, key, value, a one that sums the weights, and its embedding
        q, k, v = np.split(w["e"] @ w["qkv"], 3, axis=1)
        q = q * np.float32(1 / np.sqrt(WIDTH))
        table = np.concatenate([q, k, v, np.ones((len(q), 1), dtype=np.float32), w["e"]], axis=1)
        steep = np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max() + w["place"].max() > 60
        outer = np.concatenate([w["out"], w["ob"][None, :]])
        inner = [np.concatenate([w["in"][k, :, :n], w["ib"][k, None, :n]]) for k, n in enumerate(self.widths)]
        sums = np.stack([np.ones(len(self.begins)), self.begins], axis=1).astype(np.float32)
        ones, steps = np.ones((self.slots, 1), dtype=np.float32), blocks * BLOCK
        space, zs = np.empty(max(steps, 2048) * max(self.slots, len(self.begins)), dtype=np.float32), np.empty((blocks, BLOCK, 2 * BLOCK), dtype=np.float32)
        lp, begin, hidden = np.empty(size, dtype=np.float32), np.empty(size, dtype=np.float32), np.ones((min(size, group), WIDTH + 1), dtype=np.float32)
        c, slot = np.zeros(size, dtype=np.uint16), np.zeros(size, dtype=np.int32)  # short numbers sort fast
        c[at], slot[at] = self.cls[ids], self.slot[ids]
        for lo in range(0, size, group):
            hi = min(size, lo + group)
            for a in range(lo, hi, blocks * BLOCK):
                b = min(hi, a + blocks * BLOCK)
                x = table.take(rows[a : b + BLOCK], axis=0)  # from the block before
                one, step = x.itemsize, x.strides[0]
                near = lambda y: np.lib.stride_tricks.as_strided(y, ((b - a) // BLOCK, 2 * BLOCK, y.shape[1]), (BLOCK * step, step, one))  # noqa: B023, E731
                z = np.matmul(x[BLOCK:, :WIDTH].reshape(-1, BLOCK, WIDTH), near(x[:, WIDTH : 2 * WIDTH]).transpose(0, 2, 1), out=zs[: (b - a) // BLOCK])
                z += place
                if steep:
                    np.minimum(z, 60, out=z)
                np.exp(z, out=z)
                first = slice(*np.searchsorted(opening, (a // BLOCK, b // BLOCK)))
                z[opening[first] - a // BLOCK, :, :BLOCK] = 0  # what stands before a text is none of it
                y = (z @ near(x[:, 2 * WIDTH : 3 * WIDTH + 1])).reshape(-1, WIDTH + 1)
                h = (y[:, :WIDTH] / y[:, WIDTH:]) @ w["o"]
                h += x[BLOCK:, 3 * WIDTH + 1 :]
                r = h @ w["h"]
                r += w["hb"]
                np.maximum(r, 0, out=r)
                h += r @ w["g"]
                hidden[a - lo : b - lo, :WIDTH] = h
                lp[a:b], begin[a:b] = _softmax(hidden[a - lo : b - lo], outer, c[a:b], sums, space)
            by = np.argsort(c[lo:hi], kind="stable")
            h, places, which = hidden.take(by, axis=0), slot[lo:hi].take(by), c[lo:hi].take(by)
            cut, found = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(by)], np.empty(len(by), dtype=np.float32)
            for x, y in zip(cut[:-1], cut[1:]):
                for a in range(x, y, 2048):
                    b = min(y, a + 2048)
                    found[a:b] = _softmax(h[a:b], inner[which[x]], places[a:b], ones[: self.widths[which[x]]], space)[0]
            lp[lo + by] += found
        ten = np.float32(1 / np.log(10))
        return lp[at] * ten + self.share[ids], begin[at] * ten


def _shares(h: np.ndarray, weights: np.ndarray, ones: np.ndarray, rows: int) -> np.ndarray:
    """What softmax gives for each row, divided by the number of rows that a mean is over."""
    p = h @ weights
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(p, out=p)
        total = p @ ones[: p.shape[1]]
    if not (np.isfinite(total).all() and total.min() > 1e-30):  # beyond a float's range
        p = h @ weights
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        total = p.sum(axis=1)
    total *= rows
    p *= (1 / total)[:, None]
    return p


def _softmax(h: np.ndarray, weights: np.ndarray, target: np.ndarray, sums: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithms of the targets' shares, and of those that the last column of sums adds up; its first is all ones."""
    logit = np.matmul(h, weights, out=space[: len(h) * weights.shape[1]].reshape(len(h), -1))
    right = logit[np.arange(len(h)), target]
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(logit, out=logit)
        total = logit @ sums
    if not (np.isfinite(total).all() and total.min() > 1e-30):  # beyond a float's range
        logit = (h @ weights).astype(float)
        top = logit.max(axis=1)
        right, total = right - top, np.maximum(np.exp(logit - top[:, None]) @ sums, 1e-300)
    log = np.log(total)
    return right - log[:, 0], log[:, -1] - log[:, 0]


def _held(doc_id: str = "doc_id"):
    return F.coalesce(crc32_of(doc_id) % 7 == 2, F.lit(False))


def plan(keyed: DataFrame, share: float | None = None) -> tuple[float, int, int]:
    """The share of ids that windows take, the number of their groups, and the parts of each, from the training texts' characters. share None: that of a quick fit."""
    chars = keyed.where(~_held()).agg(F.sum(F.length("text").cast("long")).alias("n")).head().n or 0
    quick = share is None
    share = min(1.0, max(SHARE, SMALL / max(chars, 1))) if quick else share
    windows = chars * share / 4 / SPAN  # an id has about four characters
    if quick:
        return share, max(1, round(windows / (STEPS * BATCH))), 1
    return share, max(1, round(windows / GROUP)), ROUNDS if windows > STEPS * BATCH else 1


def followed(table: WordIds, data: np.ndarray, words: tuple, sizes: list[int], end: int) -> np.ndarray:
    """Windows of SPAN + 1 ids that hold all ids of texts, each with its end; a window begins with the last id of the one before, the last ends with the
    first ids again. Parameters as in drawn()."""
    start, stop, h = words
    distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
    size, ids = table.spread(table.rows(distinct, start[first], stop[first], data)[which])
    text = np.searchsorted(np.cumsum([0, *(x + 1 for x in sizes)]), start, side="right") - 1
    flat = np.insert(ids.astype("<u4"), np.cumsum(np.bincount(text, size, minlength=len(sizes)).astype(np.int64)), end)
    return flat[(np.arange(0, len(flat), SPAN)[:, None] + np.arange(SPAN + 1)[None, :]) % len(flat)]


def drawn(table: WordIds, data: np.ndarray, words: tuple, sizes: list[int], end: int, n: int, seed: int) -> np.ndarray:
    """n windows of SPAN + 1 ids at seeded places of texts that stand in data one after the other with a blank between
    them, as long as `sizes` say; each text has its end, and after the last the first follows again. words: word_hashes()
    of data."""
    start, stop, h = words
    if not len(start) or not n:
        return np.zeros((0, SPAN + 1), dtype="<u4")
    at = np.random.default_rng(seed).integers(0, len(start), n)[:, None] + np.arange(SPAN + 1)[None, :]
    text = np.searchsorted(np.cumsum([0, *(x + 1 for x in sizes)]), start, side="right") - 1
    # a word has an id at least, so as many words are enough; ends of texts stand before the words that follow them
    place = at // len(start) * len(sizes) + text[at % len(start)]
    ends = np.diff(place, axis=1, prepend=place[:, :1]).ravel()
    at = (at % len(start)).ravel()
    distinct, first, which = np.unique(h[at], return_index=True, return_inverse=True)
    size, ids = table.spread(table.rows(distinct, start[at][first], stop[at][first], data)[which])
    full = size + ends
    flat = np.full(full.sum(), end, dtype="<u4")
    before = np.cumsum(full) - full
    flat[np.repeat(before + ends - (np.cumsum(size) - size), size) + np.arange(len(ids))] = ids
    return flat[before.reshape(n, -1)[:, :1] + np.arange(SPAN + 1)[None, :]]


def slices(vector: np.ndarray, bucket: int) -> pd.DataFrame:
    """A vector in rows of SLICE numbers."""
    at = range(0, len(vector), SLICE)
    return pd.DataFrame({"bucket": bucket, "slice": np.arange(len(at), dtype="int32"), "blob": [vector[i : i + SLICE].tobytes() for i in at]})


def summed(rows: DataFrame, dtype: str) -> tuple[np.ndarray, int]:
    """The sum of vectors that slices() has cut (as many of each slice), and their number. A slice's rows pass one task as a stream, in the order of
    their buckets, so sums are the same in each run; a task holds one sum of SLICE numbers, the driver takes one vector."""
    wide = "<f8" if np.dtype(dtype).kind == "f" else dtype

    def add(frames):
        now, n, total = None, 0, None
        for pdf in frames:
            for k, blob in zip(pdf["slice"].tolist(), pdf["blob"]):
                x = np.frombuffer(blob, dtype=dtype)
                if k != now:
                    if total is not None:
                        yield pd.DataFrame({"slice": [now], "n": [n], "blob": [total.tobytes()]})
                    now, n, total = k, 0, np.zeros(len(x), dtype=wide)
                total += x
                n += 1
        if total is not None:
            yield pd.DataFrame({"slice": [now], "n": [n], "blob": [total.tobytes()]})

    tasks = parts(rows.sparkSession)
    placed = rows.select("bucket", "slice", "blob").repartitionById(tasks, F.col("slice") % tasks).sortWithinPartitions("slice", "bucket", F.xxhash64("blob"))
    got = sorted(placed.mapInPandas(add, "slice int, n long, blob binary").collect(), key=lambda r: r.slice)  # one vector
    return np.concatenate([np.zeros(0, dtype=wide), *(np.frombuffer(bytes(r.blob), dtype=wide) for r in got)]), got[0].n if got else 0


def count(keyed: DataFrame, path: str, share: float = 0.0, groups: int = 1, parts_: int = 1) -> tuple[DataFrame, np.ndarray, int, DataFrame]:
    """From all training texts: packed COUNT rows of their words, counts of their ids, the number of texts, and windows
    that hold `share` of the ids, from 1 on each id once (bucket: -2 - group - part * groups)."""
    spark = keyed.sparkSession
    nb = buckets(spark)

    def scan(frames):
        words, ids, texts, seen = [], np.zeros(subwords(path).end + 1, dtype=np.int64), 0, 0

        def out():
            h, which = np.unique(np.concatenate([x for x, _ in words]), return_inverse=True)
            rows = np.zeros(len(h), dtype=COUNT)
            rows["h"], rows["n"] = h, np.bincount(which, np.concatenate([n for _, n in words]))
            return packed((mix64(h) % np.uint64(nb)).astype(np.int64), rows)

        for pdf in frames:
            raw = [folded(t if isinstance(t, str) else None).tobytes() for t in pdf["text"]]
            for own_raw in _joined(raw):
                data = np.frombuffer(b" ".join(own_raw), dtype=np.uint8)
                found = word_hashes(data, subwords(path).table.space)
                h, n, own = subwords(path).table.tally(data, len(ids), found)
                seed = zlib.crc32(data)
                given = subwords(path).table, data, found, [len(x) for x in own_raw], subwords(path).end
                wanted = share * (own.sum() + len(own_raw)) / SPAN + np.random.default_rng([seed, 1]).random()
                got = followed(*given) if share >= 1 else drawn(*given, int(wanted), seed)
                which = np.random.default_rng([seed, 2]).integers(0, groups * parts_, len(got))
                if len(got):
                    yield pd.DataFrame([(-2 - g, got[which == g].tobytes()) for g in np.unique(which).tolist()], columns=["bucket", "blob"])
                words.append((h, n))
                ids += own
                seen += len(h)
                if seen * 16 >= FLUSH:
                    yield out()
                    words, seen = [], 0
            texts += len(raw)
            give_back()
        if words:
            yield out()
        if texts:
            ids[-1] = texts
            yield slices(ids, -1)  # as long as the vocabulary

    def whole(frames):  # rows of words and windows are no slices
        for pdf in scan(frames):
            yield pdf if "slice" in pdf else pdf.assign(slice=np.int32(0))

    counted = stash(keyed.where(~_held()).select("text").mapInPandas(whole, "bucket int, slice int, blob binary"), "lm-counted")
    ids, _ = summed(counted.where("bucket = -1"), "<i8")
    ids = ids if len(ids) else np.zeros(subwords(path).end + 1, dtype=np.int64)

    def together(rows):
        h, which = np.unique(rows["h"], return_inverse=True)
        out = np.zeros(len(h), dtype=COUNT)
        out["h"] = h
        np.add.at(out["n"], which, rows["n"])
        yield packed((mix64(h) % np.uint64(nb)).astype(np.int64), out)

    words = stash(exchange(counted.where("bucket >= 0"), together, COUNT, "bucket int, blob binary"), "lm-words")
    return words, ids, int(ids[-1]), counted.where("bucket <= -2")


def _joined(raw: list[bytes], group: int = 1 << 20):
    """Short texts in groups."""
    held, n = [], 0
    for x in raw:
        if held and n + len(x) > group:
            yield held
            held, n = [], 0
        held.append(x)
        n += len(x) + 1
    if held:
        yield held


def frequent(words: DataFrame, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Sorted hashes and counts of at most `keep` words, by a threshold that is a power of two; all words' number and sum."""

    def levels(frames):
        out = np.zeros((64, 2), dtype=np.int64)
        for pdf in frames:
            for b in pdf["blob"]:
                n = np.frombuffer(b, dtype=COUNT)["n"]
                k = np.log2(n).astype(np.int64)
                out[:, 0] += np.bincount(k, minlength=64)
                out[:, 1] += np.bincount(k, n, minlength=64).astype(np.int64)
        yield pd.DataFrame({"level": np.arange(64), "words": out[:, 0], "n": out[:, 1]})

    rows = words.mapInPandas(levels, "level int, words long, n long").groupBy("level").agg(F.sum("words").alias("words"), F.sum("n").alias("n")).collect()  # 64 rows
    size = {r.level: r.words for r in rows}
    level, so_far = 64, 0
    while level > 0 and so_far + size.get(level - 1, 0) <= keep:
        level -= 1
        so_far += size.get(level, 0)

    def take(frames):
        for pdf in frames:
            got = [np.frombuffer(b, dtype=COUNT) for b in pdf["blob"]]
            if got:
                got = np.concatenate(got)
                yield pd.DataFrame({"x": [got[got["n"] >= 1 << level].tobytes()]})

    got = np.concatenate([np.zeros(0, dtype=COUNT), *(np.frombuffer(bytes(r.x), dtype=COUNT) for r in words.mapInPandas(take, "x binary").collect())])  # `keep` rows at most
    got = got[np.argsort(got["h"])]
    return got["h"].copy(), got["n"].copy(), sum(r.words for r in rows), sum(r.n for r in rows)


def train(net: Network, windows: DataFrame, groups: int) -> None:
    """Fits the network on all windows. A group's steps run in one task; after each round weights are averaged. If windows come in parts, a round takes one part."""
    spark = windows.sparkSession

    number = (-2 - F.col("bucket")).cast("int")
    sized = F.length("blob") / (4 * (SPAN + 1))
    by_group = windows.groupBy((number % groups).alias("group")).agg(F.sum(sized.cast("long")).alias("n"), F.max(F.floor(number / groups)).alias("part"))
    most, part = by_group.agg(F.max("n"), F.max("part")).head()
    if not most:
        return
    dealt = part > 0
    steps = max(STEPS, -(-most // (WIDE if dealt else BATCH)))
    moments = net.moments()
    names, row, whole = sorted(net.w), np.dtype(("<u4", SPAN + 1)), np.dtype((np.void, 4 * (SPAN + 1)))
    sizes = np.cumsum([net.w[k].size for k in names])[:-1]
    rounds = ROUNDS if groups > 1 or dealt else 1

    def put(x: np.ndarray) -> None:
        for d, row in zip((net.w, *moments), x.astype(np.float32)):
            d.update({k: p.reshape(net.w[k].shape).copy() for k, p in zip(names, np.split(row, sizes))})

    for k in range(rounds):
        numbers = range(1 + steps * k // rounds, 1 + steps * (k + 1) // rounds)
        sent = spark.sparkContext.broadcast((net, moments))

        def run(frames, sent=sent, numbers=numbers):
            held = {}
            for pdf in frames:
                for bucket, blob in zip(pdf["bucket"].tolist(), pdf["blob"]):
                    held.setdefault(bucket, []).append(np.frombuffer(blob, dtype=row))
            for bucket, found in held.items():
                found = np.sort(np.concatenate(found).view(whole).ravel())  # in whatever order rows came
                found = found[np.random.default_rng(3).permutation(len(found))].view("<u4").reshape(-1, SPAN + 1).astype(np.int32)
                own, (m, v) = sent.value
                own = own.copy()
                m, v = ({k: x.copy() for k, x in d.items()} for d in (m, v))
                batch = max(BATCH, -(-len(found) // len(numbers))) if dealt else BATCH
                own.fit_windows(found, (m, v), numbers, steps, batch=batch)
                yield slices(np.concatenate([d[k].ravel() for d in (own.w, m, v) for k in names]).astype("<f4"), bucket)
                give_back()

        now = windows.where(F.floor(number / groups) == k) if dealt else windows
        placed = now.select("bucket", "blob").repartitionById(groups, number % groups)  # a group, or its part, has a bounded size
        total, n = summed(placed.mapInPandas(run, "bucket int, slice int, blob binary"), "<f4")
        if n:
            put(total.reshape(3, -1) / n)
        sent.unpersist()


def score(docs: DataFrame, path: str, share: float | None = 1.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs. share: of the training texts' ids, for the network; None: a quick fit."""
    spark = docs.sparkSession
    tune(spark)
    nb = buckets(spark)
    keyed = _keyed(docs := docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    keyed = keyed.dropDuplicates(["doc"]) if (repeats := _repeats(keyed)) else keyed
    share, groups, parts_ = plan(keyed, share)
    words, id_counts, texts, windows = count(keyed, path, share, groups, parts_)
    top, top_n, distinct, total = frequent(words)
    n_all, v_all = total + texts, distinct + (texts > 0)
    net = Network(id_counts, subwords(path).begins | (np.arange(len(id_counts)) == len(id_counts) - 1))
    train(net, windows, groups)
    shared = spark.sparkContext.broadcast((top, top_n, net))  # bounded by KEEP and the vocabulary
    floor = np.log10(n_all + v_all + 1)

    def mixture(lp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base, lp = np.log10(n + 1.0) - floor, lp.astype(float)
        other = np.where(n > 0, base, lp - floor)  # unknown words share what is left as the network has them
        top = np.maximum(lp, other)
        return base, top + np.log10(MIX * 10 ** (lp - top) + (1 - MIX) * 10 ** (other - top))

    def scan(frames):
        top, top_n, net = shared.value
        s = subwords(path)
        held_rows, held_n = [], 0
        for pdf in frames:
            parts_, seen, sharing = [], {}, {}
            for doc, held, text in zip(pdf["doc"].tolist(), pdf["held"].tolist(), pdf["text"]):
                if doc not in seen:
                    seen[doc] = held
                    sharing.setdefault(text if isinstance(text, str) else "", []).append(doc)
            owners = iter(sharing.values())
            for raw in _joined([folded(t).tobytes() for t in sharing], 1 << 20):
                docs_ = [next(owners) for _ in raw]
                data = np.frombuffer(b" ".join(raw), dtype=np.uint8)
                start, stop, h = word_hashes(data, s.table.space)
                distinct, first, word = np.unique(h, return_index=True, return_inverse=True)
                per_word, ids = s.table.spread(s.table.rows(distinct, start[first], stop[first], data)[word])
                which = np.searchsorted(np.cumsum([0, *(len(x) + 1 for x in raw)]), start, side="right") - 1
                # the end of each text stands after its words
                n_words = np.bincount(which, minlength=len(raw))
                unit_text = np.concatenate([which, np.arange(len(raw))])
                order = np.argsort(unit_text, kind="stable")
                unit_text, unit_size = unit_text[order], np.concatenate([per_word, np.ones(len(raw), dtype=np.int64)])[order]
                is_end = order >= len(which)
                flat = np.empty(unit_size.sum(), dtype=np.int64)
                of_end = np.repeat(is_end, unit_size)
                flat[of_end], flat[~of_end] = s.end, ids
                each, begin = net.score(flat, np.repeat(unit_text, unit_size))
                first = np.cumsum(unit_size) - unit_size
                # of a word, given that one begins: its ids, and that another word or the end follows
                lp = np.add.reduceat(each, first) - begin[first] + np.where(is_end, 0, np.append(begin[first[1:]], 0))
                at = np.minimum(np.searchsorted(top, distinct), max(0, len(top) - 1))
                found = (top[at] == distinct if len(top) else np.zeros(len(distinct), dtype=bool))[word]
                base, mixed = mixture(lp[~is_end][found], top_n[at][word[found]] if len(top) else np.zeros(0))
                end_base, end_mixed = mixture(lp[is_end], np.full(len(raw), texts))
                copies = np.array([len(d) for d in docs_])
                flat_docs = np.array([x for d in docs_ for x in d], dtype=np.int64)
                out = np.zeros(len(flat_docs), dtype=PART)
                out["doc"], out["held"] = flat_docs, [seen[d] for d in flat_docs.tolist()]
                out["n"], out["known"] = np.repeat(n_words + 1, copies), np.repeat(np.bincount(which[found], minlength=len(raw)) + (texts > 0), copies)
                out["base"] = np.repeat(np.bincount(which[found], base, minlength=len(raw)) + end_base, copies)
                out["score"] = np.repeat(np.bincount(which[found], mixed, minlength=len(raw)) + end_mixed, copies)
                parts_.append(out)
                own, lp = which[~found], lp[~is_end][~found]
                times = copies[own]
                rest = np.zeros(times.sum(), dtype=OCCURS)
                rest["h"], rest["lp"] = np.repeat(h[~found], times), np.repeat(lp, times)
                nth = np.arange(len(rest)) - np.repeat(np.cumsum(times) - times, times)
                rest["doc"] = flat_docs[np.repeat((np.cumsum(copies) - copies)[own], times) + nth]
                held_rows.append(rest)
                held_n += len(rest)
            if parts_:
                yield _by_doc(np.concatenate(parts_), nb)
            if held_n >= 1 << 20:
                yield _tail(np.concatenate(held_rows), nb)
                held_rows, held_n = [], 0
            give_back()
        if held_n:
            yield _tail(np.concatenate(held_rows), nb)

    def meet(frames):
        counts, occurs = [], []
        for pdf in frames:
            for kind, blob in zip(pdf["kind"], pdf["blob"]):
                (counts if kind == 2 else occurs).append(np.frombuffer(blob, dtype=COUNT if kind == 2 else OCCURS))
        if not occurs:
            return
        rows = np.concatenate(occurs)
        counts = np.concatenate(counts) if counts else np.zeros(0, dtype=COUNT)
        counts = counts[np.argsort(counts["h"])]
        at = np.minimum(np.searchsorted(counts["h"], rows["h"]), max(0, len(counts) - 1))
        n = np.where(counts["h"][at] == rows["h"], counts["n"][at], 0) if len(counts) else np.zeros(len(rows), dtype=np.int64)
        base, mixed = mixture(rows["lp"], n)
        doc, which = np.unique(rows["doc"], return_inverse=True)
        out = np.zeros(len(doc), dtype=PART)
        out["doc"], out["known"] = doc, np.bincount(which, n > 0)
        out["base"], out["score"] = np.bincount(which, base), np.bincount(which, mixed)
        yield _by_doc(out, nb)

    def finish(frames):
        got = [np.frombuffer(b, dtype=PART) for pdf in frames for b in pdf["blob"]]
        if got:
            rows = np.concatenate(got)
            doc, which = np.unique(rows["doc"], return_inverse=True)
            out = {"doc": doc, "held_out": np.bincount(which, rows["held"]) > 0}
            out |= {k: np.bincount(which, rows[f]).astype(np.int64) for k, f in (("n_tokens", "n"), ("n_known", "known"))}
            yield pd.DataFrame(out | {"base_score": np.bincount(which, rows["base"]), "score": np.bincount(which, rows["score"])})

    scanned = stash(keyed.select("doc", _held().alias("held"), "text").mapInPandas(scan, "bucket int, kind int, blob binary"), "lm-scanned")
    tail = scanned.where("kind = 1").unionByName(words.withColumn("kind", F.lit(2)))
    met = to_buckets(tail).mapInPandas(meet, "bucket int, kind int, blob binary")
    done = to_buckets(scanned.where("kind = 0").unionByName(met)).mapInPandas(finish, "doc long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = (_keyed(docs) if repeats else keyed).select("doc_id", "doc").join(done, "doc")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def _repeats(keyed: DataFrame) -> bool:
    return bool(keyed.groupBy("doc").count().where("count > 1").head(1))


def _by_doc(rows: np.ndarray, nb: int) -> pd.DataFrame:
    return packed((mix64(rows["doc"].astype(np.int64).view(np.uint64)) % np.uint64(nb)).astype(np.int64), rows).assign(kind=0)[["bucket", "kind", "blob"]]


def _tail(rows: np.ndarray, nb: int) -> pd.DataFrame:
    return packed((mix64(rows["h"]) % np.uint64(nb)).astype(np.int64), rows).assign(kind=1)[["bucket", "kind", "blob"]]
