"""What makes scoring cheap: exponentials taken once a symbol, words split and numbered by the batch."""

import random

import numpy as np
import pyarrow as pa

from harrier.llm import log_bilinear


def test_exponentials_are_taken_once_a_symbol(monkeypatch):
    draw = np.random.default_rng(4)
    m = log_bilinear.LogBilinear(draw.integers(1, 900, 300).astype(float))
    a, b, s = draw.integers(0, 9, 4000), draw.integers(0, 9, 4000), draw.integers(0, 300, 4000)
    got = m.log_probabilities(a, b, s)
    plain = [np.log(np.exp(log).sum()) for log in (m.log_probabilities(np.full(300, x), np.full(300, y), np.arange(300)) for x, y in ((0, 1), (8, 3)))]
    assert np.allclose(plain, 0, atol=1e-12)  # all symbols have 1 together
    called = []
    monkeypatch.setattr(log_bilinear, "MODERATE", 0.0)  # no product of exponentials is taken
    monkeypatch.setattr(log_bilinear, "_log_sum", lambda *x, inner=log_bilinear._log_sum: called.append(len(x[0])) or inner(*x))
    m.set_parameters(m.parameters())
    assert np.allclose(m.log_probabilities(a, b, s), got, rtol=0, atol=1e-12) and sum(called) > 500
    monkeypatch.undo()
    called.clear()
    monkeypatch.setattr(log_bilinear, "_log_sum", lambda *x, inner=log_bilinear._log_sum: called.append(len(x[0])) or inner(*x))
    m.set_parameters(m.parameters())
    assert (m.log_probabilities(a, b, s) == got).all() and sum(called) < 100


def test_words_of_a_batch_are_the_plain_tokens():
    draw = random.Random(1)
    signs = " \t\n\r\x0b\x0cAZaz\x1c\x1d\x1f\x85\xa0 　\x00ÄÉßİ@[`{\U0001f600ȺK"
    texts = pa.array(["".join(draw.choice(signs) for _ in range(draw.randrange(14))) for _ in range(9000)] + [None, "", " "], pa.string())
    for some in (texts, texts.slice(5, 700), texts.slice(0, 0), texts.slice(9000)):
        lens, distinct, place = log_bilinear.split(some)
        want = [log_bilinear.tokens(t) for t in some.to_pylist()]
        assert lens.tolist() == [len(w) for w in want] and [distinct[i] for i in place] == [w for t in want for w in t]
        assert len(set(distinct)) == len(distinct)
