"""What makes counting, numbering and training cheap: no Python call a word, no argsort, no search among all words a draw."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from harrier.llm import log_bilinear


def test_symbols_are_those_of_single_words(monkeypatch):
    draw = random.Random(2)
    words = list({"".join(draw.choice("abÄé\U0001f600\x00ß") for _ in range(draw.randrange(1, 4))).encode() for _ in range(900)})
    modelled = words[::3] + [b"absent"]
    want = [modelled.index(w) if w in modelled else len(modelled) + log_bilinear.tail(w) for w in words]
    log_bilinear.symbols_of(pa.array([b"x"]), pa.array(modelled, pa.binary()))  # endings are known from here
    monkeypatch.setattr(log_bilinear, "tail", None)
    for lo, hi in ((0, len(words)), (7, 50), (3, 3)):  # slices too
        some = pa.array(words, pa.binary()).slice(lo, hi - lo)
        assert log_bilinear.symbols_of(some, pa.array(modelled, pa.binary())).tolist() == want[lo:hi]
        assert log_bilinear.word_hashes(some).tolist() == [xxhash.xxh64_intdigest(w) - (1 << 63) for w in words[lo:hi]]
    assert log_bilinear.symbols_of(pa.array([b"a"]), pa.array([], pa.binary())).tolist() == log_bilinear._tails()[[65536 + 97]].tolist()


@pytest.mark.parametrize("most", [5, 1 << 40, 1 << 62])
def test_numbers_are_ordered_and_summed(most):
    draw = np.random.default_rng(3)
    for n in (0, 1, 3000):
        keys = draw.integers(0, most, n)
        for x, y in zip(log_bilinear._ordered(keys), np.unique(keys, return_inverse=True), strict=True):
            assert (x == y).all()
    parts, times = [draw.integers(0, most, n) for n in (40, 0, 7, 300, 9)], [1, 3, 70_000, 1, 2]
    for some in (slice(0, 5), slice(2, 3), slice(3, 4), slice(0, 0)):
        want = Counter()
        for k, t in zip(parts[some], times[some], strict=True):
            for x in k.tolist():
                want[x] += t
        keys, n = log_bilinear.summed(parts[some], times[some])
        assert list(zip(keys.tolist(), n.tolist(), strict=True)) == sorted(want.items())


@pytest.mark.parametrize("n", [161, 20_161])
def test_noise_is_that_of_a_search_among_all_words(n):
    """The guide gives what a binary search gives, also at the words' very beginnings, and for a draw that rounds up to the end."""
    draw = np.random.default_rng(5)
    m = log_bilinear.LogBilinear(draw.pareto(1.0, n) * (draw.random(n) < 0.9))
    drawn = np.concatenate([draw.random(50_000) * m.below[-1], m.below, np.nextafter(m.below, 0), np.arange(len(m.p_group) + 1)])
    want = np.searchsorted(m.below, drawn, "right") - 1
    assert (m._word_finder()(drawn) == np.minimum(want, n - 1)).all()


def test_counts_are_the_words(spark):
    draw = random.Random(6)
    texts = [" ".join(f"W{draw.randrange(3000)}" for _ in range(draw.randrange(40))) for _ in range(700)] + [None, "", "Ab\nab\tAB \x85"]
    want = Counter(w for t in texts for w in [*log_bilinear.tokens(t), b"\n"])
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for entries in (10, 400_000):
        got = log_bilinear.count_words(df, entries).collect()
        assert {bytes(r.word): r.n for r in got} == dict(want) and len(got) == len(want)
