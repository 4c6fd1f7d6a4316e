"""Words of letters become ids side by side, and a training step takes a batch in parts: both as one by one."""

import random

import numpy as np

from lodestone.llm import language_model as lm
from lodestone.llm.common import tokenizer_path


def test_words_merge_side_by_side():
    """Ids are the library's, and it is asked only for words that aren't plain letters."""
    s, rng = lm.Subwords(tokenizer_path("byte_bpe_50k.json")), random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzßàéïöøüÿ"
    plain = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 20))) + rng.choice(["", ".", ","]) for _ in range(500)] + ["the" * k for k in range(1, 13)] + ["a", "é.", "ß,"]
    odd = ["a÷b", "...", ",", "a.b", "x" * 41, "é" * 21, "ſ", "3a", "a..", "\u0080", "Ã\u009f", "\U0001f600a", "don't"]
    raw = [w.encode() for w in plain + odd]
    data, length = np.frombuffer(b" ".join(raw), dtype=np.uint8), np.array([len(x) for x in raw])
    start = np.cumsum(length + 1) - length - 1
    asked, real = [], s.words
    s.words = lambda words: asked.extend(words) or real(words)
    size, at, flat = s.spans(data, start, start + length)
    assert asked == odd
    want_size, want_at, want = real(plain + odd)
    assert size.tolist() == want_size.tolist()
    assert all((flat[a : a + n] == want[b : b + n]).all() for a, b, n in zip(at, want_at, size))


def test_parts_of_a_batch_and_steep_weights(monkeypatch):
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 40, (21, lm.SPAN + 1))
    got = []
    for near, steep in ((4, False), (21, False), (4, True)):
        monkeypatch.setattr(lm, "NEAR", near)
        net = lm.Network(np.bincount(windows.ravel(), minlength=40), np.arange(40) > 38)
        if steep:
            net.w["place"] += 200  # beyond a float's range without the largest taken off; softmax is the same
        moments = net.moments()
        net.fit_windows(windows, moments, range(1, 3), 10, batch=21)
        assert all(np.isfinite(x).all() for x in net.w.values())
        got.append(moments[0])
    for other in got[1:]:
        assert all(np.allclose(got[0][k], other[k], atol=1e-4) for k in got[0])
