"""Each operator against brute force, and on nulls, empty and odd rows, repeats and clashing columns."""

import hashlib
import itertools
import json
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_model, media, mixing, neighbours, ngram_join, pieces, quality, suffix_dedup, token_output, urls
from lodestone.llm.common import connected, tokenizer_path

DOC = "doc_id long, text string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))


def odd(spark, extra="n_chars long, bucket int"):
    """Null and empty texts, repeats, long words, clashing columns, other scripts."""
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta,", "Épsilon"]) for _ in range(4000))
    rows = [(1, None), (2, ""), (3, "one"), (4, "one"), (4, "one"), (5, long), (6, long), (None, "null id text"), (7, "x" * 3000), (8, " \n\t "), (9, "資料 治理 😀 \u00a0 z"), (10, long[50:]), (11, "a\x00b \x1c c")]
    return spark.createDataFrame([(*r, 5, 3) for r in rows], f"{DOC}, {extra}")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts with exact and near copies, shared passages and repeats."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices(["th", "er", "on", "an", "é", "in"], k=rng.randint(1, 4))) for _ in range(300)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = make(70)
    texts = []
    for i in range(160):
        kind = rng.random()
        if kind < 0.2 and texts:
            t = rng.choice(texts)
        elif kind < 0.55 and texts:
            t = list(rng.choice(texts))
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
        elif kind < 0.7:
            t = make(rng.randint(5, 60)) + passage[: rng.randint(20, 70)] + make(rng.randint(5, 60))
        elif kind < 0.75:
            t = make(20) * 4
        else:
            t = make(rng.randint(1, 150))
        texts.append(t)
    rows = [(i, " ".join(t) if i % 9 else "\n".join(t).upper()) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DOC).repartition(5), sorted(rows)


# 1 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(tokenizer_path("piece_bpe_32k.model"))


@pytest.mark.parametrize("size", [1, 3, 7, 20, 5000])
def test_pieces_scan_is_the_library(model, size):
    rng = random.Random(size)
    for _ in range(150):
        t = "".join(rng.choices("abtheinr  ▁\n1.,é梦😀", k=rng.randint(1, 30)))
        cs = pieces.chunks(t, size, 48)
        ms = []
        for k, (off, a, b, x) in enumerate(cs):
            ms.append({((o[0] + off, o[1] + off), (s[0] + off, s[1] + off)): v for (o, s), v in model.transfer(x, a, b, k == len(cs) - 1).items()})
        st, out = pieces.scan(ms), b""
        for k, (off, a, b, x) in enumerate(cs):
            out += model.trace(x, a, b, (st[k][0] - off, st[k][1] - off), (st[k + 1][0] - off, st[k + 1][1] - off))
        assert np.frombuffer(out, "<u4").tolist() == model.library.encode(t)


def test_max_plus_product_is_associative():
    rng = random.Random(2)
    m = [{((i, i), (j, j)): rng.random() for i in range(4) for j in range(4) if rng.random() < 0.7} for _ in range(3)]
    a, b = pieces.product(pieces.product(m[0], m[1]), m[2]), pieces.product(m[0], pieces.product(m[1], m[2]))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k]) for k in a)


def test_pieces_rows(spark, model, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    df = odd(spark)
    got = sorted(((r.doc_id, r.text, bytes(r.ids)) for r in pieces.encode(df, path, chunk=1000).collect()), key=str)
    want = sorted(((r.doc_id, r.text or "", np.array(model.library.encode(r.text or ""), "<u4").tobytes()) for r in df.collect()), key=str)
    assert got == want
    d = pieces.digest(df, path, chunk=1000).collect()
    assert len(d) == len(want) and all(r.round_trip for r in d)
    assert pieces.digest(empty, path).count() == 0


# 2 -----------------------------------------------------------------------------------------------------------------


def pour(children, budget):
    """children: {name: (cap, weight)}; fills by weight, saturated children out first, leftovers by running shares."""
    order = sorted(children, key=lambda c: (children[c][0] / children[c][1], c))
    full, rest, heavy = set(), budget, sum(w for _, w in children.values())
    for c in order:
        cap, w = children[c]
        if cap * heavy <= w * rest:
            full.add(c)
            rest, heavy = rest - cap, heavy - w
        else:
            break
    out, so_far = {c: children[c][0] for c in full}, 0
    for c in (c for c in order if c not in full):
        w = children[c][1]
        out[c] = rest * (so_far + w) // heavy - rest * so_far // heavy
        so_far += w
    return out


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b"]), rng.choice(["x", "y", "z", None]), " ".join(["w"] * rng.randint(0, 30)) if i % 17 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, d string, s string, text string").repartition(4)
    weights = {"d": {"a": 7, "b": 1}, "s": {"x": 5}}
    for share, epochs in (((1, 2), 1), ((9, 10), 2), ((3, 1), 2), ((0, 1), 1)):
        got = Counter((r.doc_id, r.epoch) for r in mixing.mix(df, {"d": F.col("d"), "s": F.col("s")}, weights, share, epochs, 3).collect())
        n = {i: len(words(t)) for i, _, _, t in rows}
        leaf = {i: (d, s or "") for i, d, s, _ in rows}
        avail = Counter()
        for i in n:
            avail[leaf[i]] += n[i]
        total = sum(avail.values())
        top = {d: (sum(a for (x, _), a in avail.items() if x == d) * epochs, weights["d"][d]) for d in ("a", "b")}
        grant = {}
        for d, b in pour(top, min(total * share[0] // share[1], total * epochs)).items():
            grant |= {(d, s): g for s, g in pour({s: (a * epochs, weights["s"].get(s, 1)) for (x, s), a in avail.items() if x == d}, b).items()}
        want = Counter()
        for k, b in grant.items():
            full, rest = (b // avail[k], b - b // avail[k] * avail[k]) if avail[k] else (0, 0)
            own = [i for i in n if leaf[i] == k]
            want.update((i, e) for i in own for e in range(full))
            if rest or not full:
                run = 0
                for i in sorted(own, key=lambda i: hashlib.md5(f"3:{full}:{i}".encode()).hexdigest()):
                    run += n[i]
                    if run <= rest:
                        want[i, full] += 1
        assert got == want


def test_mix_odd(spark, empty):
    out = mixing.mix(odd(spark, "epoch long, domain int"), {"domain": F.col("domain"), "t": F.lit("t")}, {}, (1, 1), 1, 1)
    assert out.columns == ["doc_id", "text", "epoch", "domain", "n_tokens", "leaf_budget", "t"] and out.count() == 13
    assert mixing.mix(empty, {"a": F.lit("a")}, {}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(empty, {"a": F.lit("a")}, {"a": {"a": 0}})


# 3 -----------------------------------------------------------------------------------------------------------------


def test_hilbert_visits_neighbours():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    h = neighbours.hilbert(g, 3)
    assert sorted(h.tolist()) == list(range(512)) and (np.abs(np.diff(g[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((1500, 24))
    v[300:420] = v[300]  # one very common vector
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2100, [0.0] * 24), (2200, [float("nan")] * 24), (2300, [1.0, 2.0]), (2400, [1.0] * 23 + [None])]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id long, embedding array<double>, cid int, score int")
    hit = total = 0
    got = {}
    for r in neighbours.search(df, 10, 50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 50))
    for q, found in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(math.isclose(f[2], d[f[1]], abs_tol=1e-12) for f in found)
        assert [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        hit, total = hit + len({f[1] for f in found} & set(best.tolist())), total + 10
        if 300 <= q < 420:
            assert [f[1] for f in found] == best.tolist()
    assert hit / total >= 0.9


def test_hilbert_bytes_sort_like_places():
    g = np.random.default_rng(1).integers(0, 128, (500, 8))
    assert [int.from_bytes(b, "big") for b in neighbours.hilbert_bytes(g, 7)] == neighbours.hilbert(g, 7).tolist()


@pytest.mark.parametrize("noise", [0.0005, 0.002])
def test_neighbours_in_a_tight_cluster(spark, noise):
    """A third of the rows are near one another but not equal: their nearest are found by nearness, not by vec_id."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((6000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hot = rng.permutation(6000)[:2000]
    v[hot] = v[hot[0]] + rng.standard_normal((2000, 64)) * noise
    got = {}
    for r in neighbours.search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), 10, 60).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = {}
    for q, found in got.items():
        d = ((v - v[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        recall.setdefault(q in set(hot.tolist()), []).append(len(found & set(np.argsort(d)[:10].tolist())) / 10)
    print({k: (len(x), np.mean(x)) for k, x in recall.items()})
    assert np.mean(recall[True]) >= 0.9 and np.mean(recall[False]) >= 0.9


def test_nearest_inside_is_brute_force():
    rng = np.random.default_rng(2)
    x, q = rng.integers(0, 3, (300, 5)).astype(float), rng.integers(0, 3, (20, 5)).astype(float)
    ids, inside = rng.permutation(300), rng.random((20, 300)) < rng.choice([0.01, 0.5, 1], (20, 1))
    i, j, d = neighbours.nearest_inside(q, x, ids, inside, 7)
    for k in range(20):
        own = np.flatnonzero(inside[k])
        e = np.sqrt(((x[own] - q[k]) ** 2).sum(axis=1))
        best = np.lexsort((ids[own], e))[:7]
        assert j[i == k].tolist() == own[best].tolist() and d[i == k].tolist() == e[best].tolist()


def test_shared_folder_of_a_cluster(spark, monkeypatch):
    from lodestone.llm import common

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in neighbours.search(df, 10, 100).collect()]
    assert sorted(got) == [(0, 1, 2, 1.0), (0, 2, 1, 1.414214)]
    assert neighbours.search(df.limit(0)).count() == 0


# 4 -----------------------------------------------------------------------------------------------------------------


def network(seed, ids=40, unseen=7):
    """Ids 0 to 14 and the end (the last) begin words."""
    rng = np.random.default_rng(seed)
    counts = rng.integers(1, 50, ids)
    counts[rng.choice(ids - 1, unseen, replace=False)] = 0
    net = language_model.Network(counts, (np.arange(ids) < 15) | (np.arange(ids) == ids - 1))
    net.w = {k: x + rng.standard_normal(x.shape).astype("float32") * 0.2 for k, x in net.w.items()}
    return net


def plain_softmax(net, y):
    """All ids' probabilities from a hidden state, one by one."""
    outer, out = y @ net.w["out"] + net.w["ob"], []
    outer = np.exp(outer - outer.max()) / np.exp(outer - outer.max()).sum()
    for i in range(len(net.cls)):
        inner = y @ net.w["in"][net.cls[i]] + net.w["ib"][net.cls[i]]
        inner = np.exp(inner - inner.max())
        out.append(outer[net.cls[i]] * inner[net.slot[i]] / inner.sum() * 10 ** net.share[i])
    return np.array(out)


def plain_network(net, ids, text):
    """Each place's probabilities of all ids. Blocks are counted from a text's start."""
    w, b, out, end = net.w, language_model.BLOCK, [], len(net.cls) - 1
    for i in range(len(ids)):
        start = text.tolist().index(text[i])
        own = [j for j in range(start + (i - start) // b * b - b, i + 1) if j >= start]
        x = np.stack([w["e"][net.row[end if j == 0 or text[j - 1] != text[j] else ids[j - 1]]] for j in own])
        q, k, v = np.split(x @ w["qkv"], 3, axis=1)
        z = k @ q[-1] / math.sqrt(language_model.WIDTH) + w["place"][[i - j for j in own]]
        a = np.exp(z) / np.exp(z).sum()
        h = x[-1] + a @ v @ w["o"]
        out.append(plain_softmax(net, h + np.maximum(h @ w["h"] + w["hb"], 0) @ w["g"]))
    return np.array(out)


@pytest.mark.parametrize("group", [64, 1 << 15])
def test_attention_blocks_are_a_plain_loop(group):
    rng, net = np.random.default_rng(1), network(1)
    text = np.repeat(np.arange(7), [1, 40, 3, 75, 16, 33, 64])
    ids = rng.integers(0, 39, len(text))
    lp, begin = net.score(ids, text, blocks=2, group=group)
    p = plain_network(net, ids, text)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    assert np.allclose(lp, np.log10(p[np.arange(len(ids)), ids]), atol=1e-4)
    assert np.allclose(begin, np.log10(p[:, (np.arange(40) < 15) | (np.arange(40) == 39)].sum(axis=1)), atol=1e-4)


def test_extreme_weights_are_finite():
    rng, net = np.random.default_rng(1), network(1)
    net.w["out"] *= 300
    net.w["in"] *= 300
    lp, begin = net.score(rng.integers(0, 39, 300), np.zeros(300, dtype=int))
    assert np.isfinite(lp).all() and np.isfinite(begin).all() and (lp <= 1e-5).all()


def test_context_is_32_ids_at_least():
    """Every id's score depends on the id 32 places before it, as far as its text goes."""
    rng, net = np.random.default_rng(1), network(1, unseen=0)
    ids = rng.integers(0, 39, 100)
    one = net.score(ids, np.zeros(100, dtype=int))[0]
    for at in (0, 15, 40, 60):
        other = ids.copy()
        other[at] = (other[at] + 1) % 39
        assert net.score(other, np.zeros(100, dtype=int))[0][at + 32] != one[at + 32]


def test_words_under_the_network_are_a_distribution():
    """Over all words of up to four ids, and the end of the text: longer ones have the little that is left."""
    begins = (np.arange(8) < 3) | (np.arange(8) == 7)
    net = language_model.Network(np.array([5, 3, 0, 7, 2, 0, 4, 6]), begins)
    net.w = {k: x + np.random.default_rng(5).standard_normal(x.shape).astype("float32") * 0.2 for k, x in net.w.items()}
    net.w["ob"] = net.w["ob"] + np.where(net.begins, 4, 0).astype("float32")  # words are short
    before, total = [1, 4, 0], 0.0
    for w in [*([a, *rest] for a in range(3) for n in range(4) for rest in itertools.product([3, 4, 5, 6], repeat=n)), [7]]:
        ids = np.array([*before, *w, 7])
        lp, begin = net.score(ids, np.zeros(len(ids), dtype=int))
        k = len(before)
        total += 10.0 ** (lp[k : k + len(w)].sum() - begin[k] + (begin[k + len(w)] if w != [7] else 0))
    assert 0.99 < total <= 1 + 1e-4


def test_fit_gains():
    stream = np.tile([1, 2, 3, 4, 5, 39], 2000)
    net = language_model.Network(np.bincount(stream, minlength=40), np.arange(40) > 38)
    before = net.score(stream[:600], np.repeat(np.arange(100), 6))[0].mean()
    net.fit(stream, steps=60, batch=16)
    assert net.score(stream[:600], np.repeat(np.arange(100), 6))[0].mean() > before + 0.3


def test_gradients_are_differences():
    """The first moment after one step is a tenth of the gradient; along a direction it is the difference of the loss."""
    net, rng = network(4, unseen=3), np.random.default_rng(4)
    net.w = {k: x.astype(float) for k, x in net.w.items()}
    windows = rng.integers(0, 39, (5, language_model.SPAN + 1))
    first = net.copy()
    moments = first.moments()
    first.fit_windows(windows, moments, range(1, 2), 10, 1e-3, 5)
    step = {k: rng.standard_normal(x.shape) * 1e-4 for k, x in net.w.items() if k not in ("ib", "e")}

    def loss(sign):
        n, total = net.copy(), []
        n.w = {k: x + sign * step.get(k, 0.0) for k, x in n.w.items()}
        for w in windows:
            b = len(w) - 1
            p = whole_window(n, w)
            total.append(-np.log(p[np.arange(b), w[1:]]).mean())
        return np.mean(total)

    want = (loss(1) - loss(-1)) / 2
    assert math.isclose(want, sum((moments[0][k] * 10 * step[k]).sum() for k in step), rel_tol=0.02)


def whole_window(net, ids):
    """Probabilities of all ids at each place of a training window, whose places all see those before them."""
    w, end = net.w, len(net.cls) - 1
    x = w["e"][net.row[ids[:-1]]]
    q, k, v = np.split(x @ w["qkv"], 3, axis=1)
    off, text = np.arange(len(x))[:, None] - np.arange(len(x))[None, :], np.cumsum(ids[:-1] == end)
    z = np.where((off >= 0) & (text[:, None] == text[None, :]), q @ k.T / math.sqrt(language_model.WIDTH) + w["place"][np.maximum(off, 0)], -1e9)
    a = np.exp(z - z.max(axis=1, keepdims=True))
    h = x + (a / a.sum(axis=1, keepdims=True)) @ v @ w["o"]
    return np.array([plain_softmax(net, y) for y in h + np.maximum(h @ w["h"] + w["hb"], 0) @ w["g"]])


def test_lm_windows_are_of_whole_texts(spark):
    """Training windows stand anywhere in all training texts, and twice the texts give twice as many."""
    path, n, ends = tokenizer_path("byte_bpe_50k.json"), {}, 0
    s = language_model.subwords(path)
    for size in (100, 200):
        texts = [(i, " ".join(["cat"] * 5000 + [f"dog{i}"] * 5000)) for i in range(size)]
        df = spark.createDataFrame([(i, t, i) for i, t in texts], "doc_id long, text string, doc long")
        assert language_model.plan(df)[0] == pytest.approx(language_model.SMALL / sum(len(t) for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2))
        rows = language_model.count(df, path, 1 / 32, 3)[3].collect()
        got = np.concatenate([np.frombuffer(bytes(r.blob), dtype="<u4") for r in rows]).reshape(-1, language_model.SPAN + 1)
        held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts]
        ids = [np.append(x, s.end) for x, h in zip(s.table.texts([t.encode() for _, t in texts]), held) if not h]
        stream = b"".join(x.astype("<u4").tobytes() for x in ids)
        assert all(x.tobytes() in stream * 2 for x in got if s.end not in x)  # as they stand in a text
        n[size] = len(got)
        cat = s.table.texts([b"cat"])[0]
        assert 0.4 < np.mean([not np.isin(x, cat).all() for x in got]) and n[size] == pytest.approx(len(stream) / 4 / 32 / language_model.SPAN, rel=0.1)
        assert {r.bucket for r in rows} == {-2, -3, -4}
        ends += (got == s.end).sum()
    assert ends > 0 and n[200] == pytest.approx(2 * n[100], rel=0.1)


def test_groups_train_one_network(spark):
    rng = np.random.default_rng(2)
    stream = np.tile([1, 2, 3, 4, 5, 39], 2000)
    windows = np.stack([stream[a : a + language_model.SPAN + 1] for a in rng.integers(0, 6, 300)]).astype("<u4")
    rows = spark.createDataFrame([(-2 - k % 3, bytearray(windows[k::6].tobytes())) for k in range(6)], "bucket int, blob binary")
    score = lambda net: net.score(stream[:600], np.repeat(np.arange(100), 6))[0].mean()
    nets = [language_model.Network(np.bincount(stream, minlength=40), np.arange(40) > 38) for _ in range(3)]
    for net in nets[1:]:
        language_model.train(net, rows, 3)
    assert score(nets[1]) == score(nets[2]) > score(nets[0]) + 0.3


def test_lm(spark, corpus, empty):
    df, rows = corpus
    path = tokenizer_path("byte_bpe_50k.json")
    got = {r.doc_id: r for r in language_model.score(df, path).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = {i: [*words(t), "\0end"] for i, t in rows}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), abs_tol=1e-6) and r.score < 0
    assert language_model.score(empty, path).count() == 0


def test_lm_score_is_the_models(spark, monkeypatch):
    """score of each text, odd rows too, against the network applied word by word and counts."""
    path, df = tokenizer_path("byte_bpe_50k.json"), odd(spark)
    kept = {}
    monkeypatch.setattr(language_model, "train", lambda net, windows, groups: kept.update(net=net))
    monkeypatch.setattr(language_model, "KEEP", 4)  # most words meet their counts by shuffle
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 2)) for r in language_model.score(df, path).collect())
    rows = [(r.doc_id, r.text) for r in df.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in set(rows) if not held(i) for w in [*words(t), "\0end"])
    n, v, s, want = sum(c.values()), len(c), language_model.subwords(path), Counter()
    for i, t in rows:
        units = [s.table.texts([w.encode()])[0].tolist() for w in words(t)] + [[s.end]]
        ids = np.array([x for u in units for x in u])
        lp, begin = kept["net"].score(ids, np.zeros(len(ids), dtype=int))
        at, base, score = 0, 0.0, 0.0
        for w, u in zip([*words(t), "\0end"], units):
            p = lp[at : at + len(u)].astype(float).sum() - begin[at] + (begin[at + len(u)] if u != [s.end] else 0)
            own = math.log10((c[w] + 1) / (n + v + 1))
            base, at = base + own, at + len(u)
            other = own if c[w] else p + own
            score += max(p, other) + math.log10(language_model.MIX * 10 ** (p - max(p, other)) + (1 - language_model.MIX) * 10 ** (other - max(p, other)))
        want[i, held(i), len(units), sum(c[w] > 0 for w in [*words(t), "\0end"]), n, round(base, 4), round(score, 2)] += 1
    near = lambda x: sorted(((str(k[0]), *k[1:5], k[5], k[6]) for k in x.elements()))
    for a, b in zip(near(got), near(want), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], abs_tol=1e-2) and math.isclose(a[6], b[6], rel_tol=1e-3, abs_tol=0.05)


# 5 -----------------------------------------------------------------------------------------------------------------


def repeats(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), len(b) - len(kept), sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_dedup(corpus):
    df, rows = corpus
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df).collect()}
    assert got == repeats(rows)


def test_dedup_runs_and_scripts(spark):
    rng = random.Random(9)
    rows = [(0, "a" * 500), (1, "a" * 99), (2, "a" * 100), (3, "xy" * 400), (5, "資料治理" * 60), (6, "b" + "資料治理" * 50), (7, "".join(rng.choices("ab", k=2000))), (8, None), (9, "")]
    rows.append((10, "q" + rows[6][1][300:900] + "z" + rows[6][1][1000:1100]))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(spark.createDataFrame(rows, DOC).repartition(3)).collect()}
    assert got == repeats(rows)


def test_dedup_odd(spark, empty):
    df = odd(spark)
    got = suffix_dedup.dedup(df).collect()
    assert len(got) == 13 and suffix_dedup.dedup(empty).count() == 0
    out = suffix_dedup.rewrite(df)
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert out.columns == df.columns and (2, "") in kept and (4, "one") in kept and not any(r[0] in (6, 10) for r in kept)


def test_suffix_order():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (300, suffix_dedup.SPAN), dtype=np.uint8)
    size, group = rng.integers(32, 101, 300), np.sort(rng.integers(0, 9, 300))
    h = np.stack([np.zeros(300, dtype=np.uint64), *np.cumsum(suffix_dedup._powered(x), axis=1, dtype=np.uint64).T], axis=1)
    order, lcp = suffix_dedup.suffix_order(h, x, size, group)
    want = sorted(range(300), key=lambda i: (group[i], x[i, : size[i]].tobytes(), i))
    assert order.tolist() == want
    for k in range(1, 300):
        a, b = x[order[k - 1], : size[order[k - 1]]], x[order[k], : size[order[k]]]
        m = min(len(a), len(b))
        assert lcp[k] == (0 if group[order[k]] != group[order[k - 1]] else next((j for j in range(m) if a[j] != b[j]), m))


# 6 -----------------------------------------------------------------------------------------------------------------


def shingled(t):
    w = words(t)
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def groups_of(rows):
    s = {i: shingled(t) for i, t in rows}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in ids}


def test_ngram_join(corpus):
    df, rows = corpus
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(df).collect()} == groups_of(rows)


def test_ngram_chain_of_copies(spark):
    """Copies of copies: most pairs are no link, all are one component; and words that all texts share."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(3):
            t[rng.randrange(120)] = f"e{i}{rng.random()}"
        rows.append((i, " ".join(t)))
        if i % 5 == 0:
            base[rng.randrange(120)] = f"n{i}"
    rows += [(200 + i, " ".join(["common"] * 10 + [f"u{i}-{k}" for k in range(30)])) for i in range(100)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(spark.createDataFrame(rows, DOC).repartition(6)).collect()}
    assert got == groups_of(rows)


def linked(a, b):
    return 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))


def test_trie_is_brute_force():
    rng = np.random.default_rng(6)
    universe = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    for _ in range(60):
        sets = [np.unique(rng.choice(universe, rng.integers(1, 50))) for _ in range(rng.integers(1, 12))]
        sets += sets[:1]
        probe = np.unique(rng.choice(universe, rng.integers(1, 50)))
        got = ngram_join.linked_to(probe, len(probe), sets, np.array([len(s) for s in sets]))
        assert got.tolist() == [linked(s, probe) for s in sets]


@pytest.mark.parametrize("stretch", [1, 7, 64])
def test_trie_joins_groups(monkeypatch, stretch):
    """Sets with one first member: components by the trie are those of all pairs."""
    monkeypatch.setattr(ngram_join, "STRETCH", stretch)
    rng = np.random.default_rng(stretch)
    for _ in range(30):
        sets = []
        for first in range(4):
            base = np.arange(10, 200)
            for _ in range(rng.integers(1, 30)):
                sets.append(np.unique(np.append(np.where(rng.random(190) < rng.choice([0.01, 0.05, 0.12]), rng.integers(200, 999, 190), base), first)))
        want = np.arange(len(sets))
        for _ in sets:
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    if a[0] == b[0] and want[i] != want[j] and linked(a, b):
                        want[[i, j]] = min(want[i], want[j])
            if all(want[i] == want[j] for i, a in enumerate(sets) for j, b in enumerate(sets) if a[0] == b[0] and linked(a, b)):
                break
        order = rng.permutation(len(sets))
        got = np.empty(len(sets), dtype=int)
        got[order] = order[ngram_join.join_groups([sets[k] for k in order], np.array([len(sets[k]) for k in order]), rng.random(len(sets)))]
        assert {tuple(np.flatnonzero(got == k)) for k in set(got.tolist())} == {tuple(np.flatnonzero(want == k)) for k in set(want.tolist())}


def test_lists_of_shingles():
    rng = np.random.default_rng(2)
    cls, n = rng.integers(-5, 5, 400).astype("<i8"), np.full(400, 9)
    token, bucket = rng.integers(0, 60, 400).astype("<u8"), rng.integers(0, 3, 400)
    frame = ngram_join.pack_lists(bucket, cls, n, token, token.astype("u1"))
    got = ngram_join.unpack_lists(frame["blob"].tolist())
    assert sorted(zip(got[0], got[2])) == sorted(zip(cls, token)) and (got[3] == got[2]).all()
    c, _, t, level = ngram_join.shared_of(cls, n, token)
    held = {x: {a for a, b in zip(cls.tolist(), token.tolist()) if b == x} for x in token.tolist()}
    assert sorted(zip(c.tolist(), t.tolist(), level.tolist())) == sorted((a, x, int(math.log2(len(g)))) for x, g in held.items() if len(g) > 1 for a in g)


@pytest.mark.parametrize("heavy", [1 << 14, 3])
def test_ngram_split_groups(spark, monkeypatch, heavy):
    """Groups and shingles over the sizes that one task takes: a family, unlinked texts with a common part, and chains."""
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    monkeypatch.setattr(ngram_join, "GROUP", 8)
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join, "PAIRS", 64)
    rng = random.Random(5)
    base, common = [f"w{i}" for i in range(100)], [f"c{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        t = list(base)
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(100)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join([*common, *(f"u{rng.randrange(30)}" for _ in range(rng.randint(4, 14)))])) for i in range(90)]
    assert (ngram_join.heavy_levels(spark.createDataFrame(rows, DOC)) > 0).sum() > 50 or heavy > 3
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(spark.createDataFrame(rows, DOC).repartition(6)).collect()}
    assert got == groups_of(rows)


def test_ngram_odd(spark, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(odd(spark)).collect()}
    assert {(1, 0, 1), (2, 0, 2), (8, 0, 8), (3, 1, 3), (4, 1, 3)} <= got and any(r[0] is None for r in got)
    assert ngram_join.components(empty).count() == 0


def test_connected(spark):
    rng = random.Random(8)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = {i: i for p in links for i in p}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root[i] for p in links if p[0] != p[1] for i in p}


# 7 -----------------------------------------------------------------------------------------------------------------

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8")]


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.Example.COM/en/7x?y#z": ("a.example.com", "/en/7x", "example.com/en/7", "allow"), "https://com/en/1": ("com", "/en/1", "com/en/", "block"), "http://xcom/en/1": ("xcom", "/en/1", None, None),
        "x://h?q=/a": ("h", "", None, None), "http://b.net#f": ("b.net", "", None, None), "no scheme": ("", "", None, None), None: ("", "", None, None), "http://a.net/de/": ("a.net", "/de/", "net/de/", "block"),
        "http://example.net/de/81": ("example.net", "/de/81", "example.net/de/8", "block"), "a://b://c/d": ("b:", "//c/d", None, None), "http://É.net/de/x\ny": ("É.net", "/de/x\ny", "net/de/", "block"),
    }
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, df.select("url", F.lit(None).cast("int").alias("bad")), RULES).collect()}
    for u, (h, p, rule, verdict) in cases.items():
        assert got[u][:3] == (h, p, rule) and got[u][3] == (verdict or got[u][3])


def test_url_templates(spark):
    rows = [(f"http://s.org/spam/{i}", 1) for i in range(60)] + [(f"http://s.org/good/{i}.html", 0) for i in range(60)] + [(f"http://s.org/user/{chr(97 + i % 26)}{chr(97 + i // 26)}/posts", i % 10 == 0) for i in range(100)]
    labelled = spark.createDataFrame([(u, int(b)) for u, b in rows], "url string, bad int")
    pages = spark.createDataFrame([(1, "http://s.org/spam/999"), (2, "http://s.org/good/999.html"), (3, "http://s.org/user/zz/posts"), (4, "http://new.org/spam/1"), (5, "http://s.org/a/b/c/d/e/f/g/h")], "page_id long, url string")
    got = {r.page_id: (r.template, r.verdict) for r in urls.judge(pages, labelled, []).collect()}
    assert got == {1: ("/spam/{n}", "block"), 2: ("/good/{n}.html", "allow"), 3: ("/user/*/posts", "allow"), 4: ("/spam/{n}", "allow"), 5: ("/a/b/c/d/e/f/**", "allow")}
    assert urls.judge(pages.limit(0), labelled.limit(0), []).count() == 0


def test_url_branches_stay_apart(spark):
    """Among more than FAN sections a frequent or a bad one keeps its name, and paths are told apart past DEPTH."""
    deep = "http://d.org/a/b/c/d/e/f"
    rows = [(f"http://w.org/s{i}x/{k}", 0) for i in map(chr, range(97, 123)) for k in range(4)] + [(f"http://w.org/t{i}/{k}", 0) for i in map(chr, range(97, 123)) for k in range(4)]
    rows += [(f"http://w.org/casino/{k}", 1) for k in range(3000)] + [(f"http://w.org/pills/{k}", 1) for k in range(10)] + [(f"http://w.org/news/{k}", 0) for k in range(2000)]
    rows += [(f"{deep}/spam/x/{k}", 1) for k in range(200)] + [(f"{deep}/good/x/{k}", 0) for k in range(200)]
    labelled = spark.createDataFrame(rows, "url string, bad int")
    ask = ["http://w.org/casino/9", "http://w.org/pills/9", "http://w.org/news/9", "http://w.org/ta/9", f"{deep}/spam/x/9", f"{deep}/good/x/9", f"{deep}/rare/x/9"]
    got = {r.page_id: (r.template, r.verdict) for r in urls.judge(spark.createDataFrame(list(enumerate(ask)), "page_id long, url string"), labelled, []).collect()}
    f = "/a/b/c/d/e/f"
    assert {k: got[k] for k in range(6)} == {0: ("/casino/{n}", "block"), 1: ("/pills/{n}", "block"), 2: ("/news/{n}", "allow"), 3: ("/*/{n}", "allow"), 4: (f"{f}/spam/x/{{n}}", "block"), 5: (f"{f}/good/x/{{n}}", "allow")}
    assert got[6][0] == f"{f}/**"


# 8 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 100_000])
def test_media_round_trip(n):
    raw = random.Random(n).randbytes(n)
    m = media.mux(media.padded(raw))
    (t,), wrong = media.probe(m)
    assert wrong is None and media.payload(m, t) == media.padded(raw) and len(media.padded(raw)) % 576 == 0
    assert (t["codec"], t["width"], t["height"], t["samples"], t["duration_ms"]) == ("raw ", 24, 24, len(media.padded(raw)) // 576, len(media.padded(raw)) // 576 * 40)
    assert t["key_start"] == [m.index(b"mdat") + 4] and t["key_bytes"] == [len(media.padded(raw))]


def test_media_of_other_makers():
    """Two chunks, own sizes, some keyframes, 64-bit offsets and a long box."""
    data = b"AAABBCCCCD"
    stbl = media.box(
        b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(70))), media.full(b"stts", struct.pack(">IIIII", 2, 3, 10, 1, 20)), media.full(b"stsc", struct.pack(">7I", 2, 1, 3, 1, 2, 1, 1)),
        media.full(b"stsz", struct.pack(">6I", 0, 4, 3, 2, 4, 1)), media.full(b"co64", struct.pack(">IQQ", 2, 16, 27)), media.full(b"stss", struct.pack(">III", 2, 1, 4)),
    )
    moov = media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", struct.pack(">QQIQI", 0, 0, 100, 50, 0), version=1), media.full(b"hdlr", bytes(4), b"vide", bytes(13)), media.box(b"minf", stbl))))
    file = struct.pack(">I4sQ", 1, b"mdat", 16 + 12) + data[:9] + b"--" + data[9:] + moov
    (t,), wrong = media.probe(file)
    assert wrong is None and (t["codec"], t["duration_ms"], t["keyframes"], t["key_start"], t["key_bytes"]) == ("avc1", 500, 2, [16, 27], [3, 1]) and media.payload(file, t) == data
    for cut in range(0, len(file), 7):
        tracks, wrong = media.probe(file[:cut])
        assert tracks == [] or wrong is None
    rng = random.Random(1)
    for _ in range(300):
        broken = bytearray(file)
        broken[rng.randrange(28, len(file))] = rng.randrange(256)
        media.probe(bytes(broken))


def test_media_rows(spark, empty):
    df = odd(spark)
    got = {(r.doc_id, r.n_bytes): r for r in media.digest(media.pack_texts(df)).collect()}
    for r in df.collect():
        raw = (r.text or "").encode()
        p = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        g = got[r.doc_id, len(raw)]
        assert (g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    t = media.probe_media(media.pack_texts(df).unionByName(spark.createDataFrame([(99, 0, bytearray(b"junk"))], "doc_id long, n_bytes long, media binary"))).collect()
    assert len(t) == 14 and sum(r.media_error is not None for r in t) == 1 and media.digest(media.pack_texts(empty)).count() == 0


# 9 -----------------------------------------------------------------------------------------------------------------


def test_trees_split_like_brute_force():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 4))
    y = ((x[:, 1] > 0.3) ^ (x[:, 2] < -0.5)).astype(float)
    m = quality.fit(x, y, trees=30)
    s = m.score(x)
    assert ((s > 0.5) == (y > 0)).mean() > 0.97
    walked = []
    for row in x[:50]:
        total = m.bias
        for at in m.roots:
            while m.feature[at] >= 0:
                at = m.left[at] + (row[m.feature[at]] > m.threshold[at])
            total += m.value[at]
        walked.append(1 / (1 + math.exp(-total)))
    assert np.allclose(s[:50], walked)


def test_quality(spark, sf, empty):
    docs, labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    got = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got["score"] >= 0.5) == (got["quality"] == 1)).mean() > 0.95 and got["score"].between(0, 1).all()
    none = quality.train(empty, labels.limit(0))
    df = odd(spark)
    assert quality.score(df, none).count() == 13 and quality.keep_good(df, none, 0.0).columns == df.columns and quality.score(empty, none).count() == 0


# 10 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name):
    e = token_output.Encoder(tokenizer_path(name))
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab 's'T\t\n\x1c\u00a0\u3000é\u0301Σς0１٣!?İßﬁ\u200b\u0085.,", k=rng.randint(0, 40))) for _ in range(2000)] + ["<|endoftext|> x", "A\x01b \x01 c"]
    assert [x for x, g in zip(texts, e.encode(texts)) if np.frombuffer(g, "<u4").tolist() != e.ids(x)] == []


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path, target = tokenizer_path("word_bpe_49k.json"), str(tmp_path / "t")
    df = odd(spark).unionByName(spark.range(300, 700).select(F.col("id").alias("doc_id"), F.concat(F.lit("the number "), F.col("id").cast("string")).alias("text"), F.lit(1).cast("long").alias("n_chars"), F.lit(1).alias("bucket")))
    token_output.write(df, target, path, 2, shards=5)
    lib = Tokenizer.from_file(path)
    want = sorted(((r.doc_id if r.doc_id is not None else -1), np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in df.collect())
    got = sorted(token_output.read(spark, target).collect(), key=lambda r: (r.start))
    assert sorted(((r.doc_id if r.doc_id is not None else -1), bytes(r.ids)) for r in got) == want
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    d = bytes(spark.read.parquet(f"{target}/dictionary").first().dictionary)
    shard = token_output.Shard(bytes(spark.read.parquet(f"{target}/shards").first().shard), d)
    assert len(shard.ids(shard.n - 1)) == shard.index[shard.n - 1][4]
    with pytest.raises(ValueError, match="dictionary"):
        token_output.Shard(bytes(spark.read.parquet(f"{target}/shards").first().shard), d + b"x")
    token_output.write(df.limit(0), str(tmp_path / "e"), path, 2)
    assert token_output.read(spark, str(tmp_path / "e")).count() == 0


def test_queries_are_whole(spark, sf):
    from lodestone.llm import queries

    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for n in queries.QUERIES] and len(queries.QUERIES) == 12
    assert json.dumps(list(queries.ORACLE_SQL))
