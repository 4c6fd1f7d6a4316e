"""Odd sketches and phrase mining against brute force, and on nulls, odd rows, repeats, ties and clashing columns."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOC, FOLD, odd, words

from lodestone.llm import odd_sketch, phrases

rng = random.Random(11)
VOCABULARY = [f"w{k}" for k in range(400)]


def near_groups(rows, percent=85):
    """doc_id -> (size, component, kept) by all pairs; rows with a null doc_id link others."""
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(x), least.get(find(k)), i == least.get(find(k))) for k, (i, x) in enumerate(sets)), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def families():
    """Families of near copies: of one original, chains that drift, and texts that share a long common passage."""
    texts = []
    for _ in range(6):
        own = [rng.choice(VOCABULARY) for _ in range(90)]
        for _ in range(12):
            t = list(own)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = "edit"
            texts.append(t)
    chain = [rng.choice(VOCABULARY) for _ in range(120)]
    for _ in range(15):
        chain = chain[4:] + [rng.choice(VOCABULARY) for _ in range(4)]
        texts.append(chain)
    shared = [rng.choice(VOCABULARY) for _ in range(150)]
    texts += [shared + [rng.choice(VOCABULARY) for _ in range(rng.choice([10, 20, 40, 60]))] for _ in range(60)]
    texts += [[w] for w in "aab"] + [[]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def test_sketch_near_dedup(spark):
    rows = families()
    assert found(odd_sketch.components(spark.createDataFrame(rows, DOC).repartition(5))) == near_groups(rows)
    assert found(odd_sketch.components(spark.createDataFrame(rows, DOC), 70)) == near_groups(rows, 70)


@pytest.mark.parametrize("split", [4, 4096])
def test_sketch_blocks(spark, monkeypatch, split):
    """Groups that are larger than a block, keys that count only in twos, and batches that cut a cell in two."""
    monkeypatch.setattr(odd_sketch, "SPLIT", split)
    monkeypatch.setattr(odd_sketch, "BLOCK", 7)
    monkeypatch.setattr(odd_sketch, "PAIRS", 50)
    rows = families()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        assert found(odd_sketch.components(spark.createDataFrame(rows, DOC))) == near_groups(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)


def test_common_passages_bring_few_together(spark, monkeypatch):
    """A text that hundreds of documents hold beside their own: keys of it alone bring no pair together, in twos few."""
    g = random.Random(9)
    common = [f"c{k}" for k in range(40)]
    rows = [(k, " ".join([*(f"o{k}x{g.randrange(1000)}" for _ in range(80)), *common])) for k in range(300)]
    rows += [(300 + k, rows[k][1] + " end") for k in range(40)]
    df = spark.createDataFrame(rows, DOC)
    classes = odd_sketch.stash(odd_sketch.described(df).where("keys is not null").select("cls", "n", "keys", "sketch"), "t")
    keys = odd_sketch.shared_keys(classes).select("key", "cls").withColumn("label", F.col("cls"))
    size = lambda r: r.groupBy("key").count().selectExpr("sum(count * count)").first()[0]
    whole = size(odd_sketch.narrowed(keys))
    monkeypatch.setattr(odd_sketch, "SPLIT", 5)
    assert size(odd_sketch.narrowed(keys)) < whole
    assert found(odd_sketch.components(df)) == near_groups(rows)


def test_across_gives_pairs_of_other_components_only(spark):
    near = np.zeros(2 * odd_sketch.WORDS64, dtype=np.int64)
    classes = spark.createDataFrame([(k, 100, near.tolist()) for k in range(40)] + [(40, 50, near.tolist())], "cls long, n long, sketch array<long>")
    rows = spark.createDataFrame([(1, k, 0 if k < 30 else k) for k in range(41)] + [(2, k, 0) for k in range(30)], "key long, cls long, label long")
    got = {(r.a, r.b) for r in odd_sketch.across(rows, classes, 85).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(range(40), 2) if b >= 30}


def test_sketch_odd_rows(spark):
    df = odd(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert found(odd_sketch.components(df)) == near_groups(rows)
    assert odd_sketch.components(spark.createDataFrame([], DOC)).count() == 0
    lone = odd_sketch.components(spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], DOC)).collect()
    assert len(lone) == 3 and all(r.component_id is None and r.kept for r in lone)


def test_sketches_estimate_similarity():
    g = np.random.default_rng(5)
    for share in (0.6, 0.8, 0.9, 0.97, 1.0):
        x = np.unique(g.integers(0, 1 << 63, 1400).astype(np.uint64))[:1200]
        n = int(1000 * share)
        s = odd_sketch.odd_sketches(odd_sketch.min_hashes([x[:1000], np.sort(np.concatenate([x[:n], x[1000 : 2000 - n] if n < 800 else x[1000 : 1000 + 1000 - n]]))])).view(np.uint64)
        odd_bits = int(np.bitwise_count(s[0] ^ s[1]).sum())
        real = n / (1000 + 1000 - n) if n >= 800 else n / (1000 + len(x[1000 : 2000 - n]))
        assert abs(odd_sketch.estimate(odd_bits) - real) < 0.15
        if real >= 0.85:
            assert odd_bits <= odd_sketch.odd_limit()
    # the limit: simulated pairs at the threshold all stay under it
    differ = g.binomial(odd_sketch.SAMPLES, 0.15, 20_000)
    z = [int(np.count_nonzero(np.bincount(g.integers(0, odd_sketch.BITS, 2 * d), minlength=1) & 1)) for d in differ]
    assert max(z) <= odd_sketch.odd_limit() < 2 * odd_sketch.SAMPLES
    assert odd_sketch.odd_limit(loss=1e-3) >= np.quantile(z, 0.999) - 1


# phrases ---------------------------------------------------------------------------------------------------------------


def mined(rows, least, top=phrases.TOP):
    """Counts of everything, then cuts, then what longer phrases hold; plain Python."""
    f, n = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    frequent = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    for (lang, p), a in frequent.items():
        if any(lang == m and len(q) > len(p) and 100 * c >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (m, q), c in frequent.items()):
            continue
        score, k = min((phrases.SCALE * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, r, *x[1:]) for r, x in enumerate(own, 1)]
    return sorted(ranked)


def rows_of_phrases(df):
    return sorted(tuple(r) for r in df.collect())


def phrase_rows(n=250):
    g = random.Random(4)
    heads = ["new york city", "in spite of the", "a b a b a b", "Été à Paris", "z", "x y q"]
    make = lambda: " ".join(g.choice(heads) if g.random() < 0.4 else f"v{g.randint(0, 30)}" for _ in range(g.randint(0, 40))) + g.choice([".", "! ", "\n", "\t", ",x;"])
    return [(g.choice(["en", "fr", None, "und"]), "".join(make() for _ in range(g.randint(0, 3))).replace(" v1 ", g.choice([" V1  ", ". ", "\t", "\r"]))) for _ in range(n)]


@pytest.mark.parametrize("least", [1, 5, 100])
def test_phrases(spark, least):
    rows = phrase_rows(40 if least == 1 else 250)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert rows_of_phrases(phrases.collocations(df, least)) == mined(rows, least)
    assert rows_of_phrases(phrases.collocations(df, least, top=7)) == mined(rows, least, 7)


def test_phrase_counters_prune(spark):
    """The bitmap and the filter leave out what cannot be frequent, and nothing that is."""
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string")
    one = phrases.stash(phrases.counted(df, 1, None, None, 50, False), "t")
    bits = np.frombuffer(phrases.bitmap_of(one, 50), dtype=np.uint8)
    w = phrases.Words([t for _, t in rows], ["und" if x is None else x for x, _ in rows])
    inside, h = w.runs(2)
    bucket, n = np.unique(h[inside] & np.uint64(phrases.BUCKETS - 1), return_counts=True)
    assert set(np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()) == set(bucket[n >= 50].tolist())
    assert 0 < int(np.unpackbits(bits).sum()) < len(bucket)


def test_phrase_products_pass_64_bits(spark):
    """Scores are floors of exact quotients, also where doubles and 64-bit integers fail."""
    totals = spark.createDataFrame([("en", 9_007_199_254_740_993)], "lang string, n long")
    f = [("a", 1, 999_999_999_999), ("b", 1, 3), ("a b", 2, 3), ("b a", 2, 1), ("a a", 2, 999_999_999_989)]
    got = {r.phrase: r.score for r in phrases.scored(totals, spark.createDataFrame([("en", *x) for x in f], "lang string, phrase string, k int, n long")).collect()}
    n = {p: c for p, _, c in f}
    assert got == {p: 1000 * c * 9_007_199_254_740_993 // (n[p[0]] * n[p[2]]) for p, k, c in f if k == 2}


def test_phrase_odd_rows(spark, monkeypatch):
    rows = [(None, "a b c"), ("und", "A  B\tc"), ("en", None), (None, None), ("en", ""), ("en", " ,.; "), ("x", "é é é é"), ("x", "é é é é"), ("long", "k l m " * 3000)]
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "lang string, text string, n long, phrase string, hash long")
    for size in (phrases.WORDS, 5):
        monkeypatch.setattr(phrases, "WORDS", size)
        assert rows_of_phrases(phrases.collocations(df, 2)) == mined(rows, 2)
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df).where("lang != 'long'").count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(df, 0)


# sums of long vectors, of op4 ------------------------------------------------------------------------------------------


def test_sums_by_slices(spark, monkeypatch):
    from lodestone.llm import language_model as lm

    monkeypatch.setattr(lm, "SLICE", 1000)
    g = np.random.default_rng(1)
    x = g.normal(size=(23, 4321)).astype("<f4")
    rows = spark.createDataFrame([(k, s, b) for k in range(23) for s, b in ((int(r.slice), bytearray(r.blob)) for r in lm.slices(x[k], k).itertuples())], "bucket int, slice int, blob binary").repartition(6)
    total, n = lm.summed(rows, "<f4")
    assert n == 23 and np.array_equal(total, sum(v.astype("<f8") for v in x))
    assert lm.summed(rows.limit(0), "<f4")[1] == 0


def test_the_full_vocabulary_stays_small():
    """With all 50,257 ids and the end seen: what a group sends, what one row of it holds, what the driver takes."""
    from lodestone.llm import language_model as lm

    n = 50_258
    net = lm.Network(np.ones(n, dtype=np.int64), np.arange(n) % 2 == 0)
    vector = np.concatenate([d[k].ravel() for d in (net.w, *net.moments()) for k in sorted(net.w)]).astype("<f4")
    rows = lm.slices(vector, 0)
    assert max(map(len, rows["blob"])) <= 4 * lm.SLICE
    assert vector.nbytes < 30 << 20 and 2 * vector.nbytes < 100 << 20  # sums are doubles; the driver takes one vector of them
