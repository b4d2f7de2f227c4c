"""Sums over pairs without pairs, against all pairs."""

import numpy as np
import pandas as pd
import pytest

from harrier.operators import folds, metrics, sums


@pytest.mark.parametrize("spread", [0.0, 0.3, 2.0, 60.0])
@pytest.mark.parametrize("n", [1, 2, 127, 700, 3001])
def test_sums_over_pairs(n, spread):
    draw = np.random.default_rng(n)
    x = draw.normal(7.0, 1.0, n) * spread
    x[draw.integers(0, n, n // 3)] = x[0]
    d = x[:, None] - x[None, :]
    before = np.triu(np.ones((n, n), bool), 1)
    assert np.allclose(sums.expected_wins(x, 64), sums.logistic(d).sum(axis=1), rtol=0, atol=1e-9)
    assert sums.higher_before(x) == (int((d[before] > 0).sum()), int((d[before] == 0).sum()))
    assert np.isclose(sums.losses_before(x), sums.pair_loss(d[before]).sum(), rtol=1e-12)
    k = n // 2
    assert sums.higher_across(x[:k], x[k:]) == (int((d[:k, k:] > 0).sum()), int((d[:k, k:] == 0).sum()))
    assert np.isclose(sums.losses_across(x[:k], x[k:]), sums.pair_loss(d[:k, k:]).sum(), rtol=1e-12)


def test_backtest_of_tied_ranks(spark, monkeypatch):
    """Ties in rank within and across blocks, against a loop over pairs."""
    monkeypatch.setattr(metrics, "PAIR_BLOCK", 7)
    draw = np.random.default_rng(3)
    rows = [(f"r{r}", f"a{i:02}", float(draw.integers(1, 9)), float(draw.choice([1400.0, 1500.0, 1600.0 + i])), 1) for r in range(3) for i in range(12 + 9 * r)]
    right, loss, n = 0, 0.0, 0
    for r in range(3):
        field = sorted((x[2], x[1], x[3]) for x in rows if x[0] == f"r{r}")
        for i, (ri, _, x) in enumerate(field):
            for rj, _, y in field[i + 1 :]:
                p = 1 / (1 + 10 ** ((y - x) / 400))
                right, loss, n = right + ((p > 0.5) == (ri < rj)), loss - np.log(p if ri < rj else 1 - p), n + 1
    got = metrics.backtest(spark.createDataFrame(rows, "race_id string, fis_code string, rank double, rating double, n_races int")).first()
    assert got.pairs == n and np.isclose(got.pair_accuracy, right / n) and np.isclose(got.log_loss, loss / n, rtol=1e-9)


def test_large_field_is_the_sum_over_opponents():
    """A field of thousands, against every pair's surprise."""
    draw = np.random.default_rng(2)
    codes, ranks = [str(i) for i in range(3000)], draw.integers(1, 900, 3000).astype(float)
    state = {c: [float(x), 20, None, None] for c, x in zip(codes, draw.normal(1500, 300, 3000), strict=True)}
    r = np.array([x[0] for x in state.values()])
    won = (ranks[:, None] < ranks) + 0.5 * (ranks[:, None] == ranks)
    want = r + 200 * (won - 1 / (1 + 10 ** ((r - r[:, None]) / 400))).sum(axis=1) / 2999
    folds.update_race(state, codes, ranks, None)
    assert np.allclose([x[0] for x in state.values()], want, rtol=0, atol=1e-9)


def test_races_that_span_batches():
    """A race over any number of batches is one."""
    table = pd.DataFrame({"pool": ["p"] * 9 + ["q"] * 4, "race_id": list("aaaaaaabb") + list("bbcc"), "n": range(13)})
    for size in (1, 2, 3, 5, 13):
        got = [(p, race, rows.n.tolist()) for p, race, rows in folds._by_race((table.iloc[k : k + size].reset_index(drop=True) for k in range(0, 13, size)), "pool")]
        assert got == [("p", "a", list(range(7))), ("p", "b", [7, 8]), ("q", "b", [9, 10]), ("q", "c", [11, 12])]


def test_pairs_are_sorted_once(spark):
    """Rows are dealt by group without a window or a sort for the races' sizes; places may have gaps, and rows without a race take no part."""
    df = spark.createDataFrame([("m", r, p, float(p * 7 % 5)) for r in ("a", "b", None) for p in (9, 2, 200_000, 70_000, 5)], "method string, race_id string, pos int, score double").repartition(3)
    pairs = metrics.race_pairs(df)
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "FlatMapGroupsInPandas" in plan
    score = [p * 7 % 5 for p in (2, 5, 9, 70_000, 200_000)]
    right = sum(1.0 if x > y else 0.5 if x == y else 0.0 for i, x in enumerate(score) for y in score[i + 1 :])
    assert sorted((r.race_id, r.pairs, r.correct) for r in pairs.collect()) == [("a", 10, right), ("b", 10, right)]
