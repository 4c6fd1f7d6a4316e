"""The network learns from every id of every training text."""

import zlib

import numpy as np

from lodestone.llm import language_model as lm
from lodestone.llm.common import tokenizer_path


def test_windows_hold_every_id(spark, monkeypatch):
    monkeypatch.setattr(lm, "SMALL", 100)
    monkeypatch.setattr(lm, "STEPS", 1)
    monkeypatch.setattr(lm, "GROUP", 300)
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(f"w{n}" for n in rng.integers(0, 500, 300))) for i in range(400)] + [(-1, ""), (-2, None), (-3, "  ")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    path = tokenizer_path("byte_bpe_50k.json")
    share, groups, parts = lm.plan(df, 1.0)
    assert share == 1 and groups > 1 and parts == lm.ROUNDS
    _, counts, n, windows = lm.count(df, path, share, groups, parts)
    rows = windows.collect()
    got = np.concatenate([np.frombuffer(bytes(r.blob), dtype="<u4") for r in rows]).reshape(-1, lm.SPAN + 1)
    held = np.bincount(got[:, :-1].ravel(), minlength=len(counts))
    assert n == sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in texts)
    assert (held >= counts).all() and held.sum() <= counts.sum() + 3 * lm.SPAN * 4  # the ends of last windows come twice
    assert {-2 - r.bucket for r in rows} == set(range(groups * parts))


def test_each_round_takes_its_part(spark, monkeypatch):
    used = []
    monkeypatch.setattr(lm, "STEPS", 14)
    windows = np.arange(14 * 60)[:, None] % 39 + np.zeros((1, lm.SPAN + 1), dtype=np.int64)
    rows = spark.createDataFrame([(-2 - k, bytearray(windows[k::14].astype("<u4").tobytes())) for k in range(14)], "bucket int, blob binary")
    net = lm.Network(np.bincount(windows.ravel(), minlength=40), np.arange(40) > 38)
    before = net.w["ob"].copy()
    real = lm.summed
    monkeypatch.setattr(lm, "summed", lambda df, kind: used.append(real(df, kind)) or used[-1])
    lm.train(net, rows, 2)
    assert [n for _, n in used] == [2] * lm.ROUNDS and not np.allclose(before, net.w["ob"]) and all(np.isfinite(x).all() for x in net.w.values())
