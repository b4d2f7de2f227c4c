"""Queries over all races, against plain loops."""

import hashlib
import math
import os
import random
from collections import defaultdict
from itertools import combinations, groupby
from statistics import median

import numpy as np
import pytest

from harrier.operators import folds, metrics, ranker, results, simulate
from harrier.plans import queries
from harrier.testing import league

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """The orders of two months."""
    folder = str(tmp_path_factory.mktemp("few"))
    spark.read.parquet(f"{SF}/orders.parquet").where("date_format(o_orderdate, 'yyyyMM') in ('199701', '199702')").write.parquet(f"{folder}/orders.parquet")
    return folder


def test_start_lists(spark):
    names = {r.fis_code: (r["name"], r.nation) for r in league.athletes(spark, SF).collect()}
    entries = league.results(spark, SF).select("race_id", "fis_code").collect()
    got = sorted(tuple(r) for r in queries.queries()["start_lists"](spark, SF).collect())
    assert got == sorted((r.race_id, r.fis_code, *names[r.fis_code]) for r in entries) and len({r[0] for r in got}) > 100


def test_drawn_pairs(spark):
    """All pairs of small races; 600 different ones, from everywhere, of a large race."""
    rows = [("small", 3 * p) for p in range(1, 21)] + [("large", p) for p in range(1, 101)] + [("one", 1)]
    df = spark.createDataFrame([(r, p, *([float(p)] * len(ranker.FEATURES))) for r, p in rows], "race_id string, pos int, " + ", ".join(f"{n} double" for n in ranker.FEATURES))
    got = defaultdict(list)
    for r in ranker.sampled_pairs(df).collect():
        assert r.ahead == [float(r.i)] * len(ranker.FEATURES) and r.behind == [float(r.j)] * len(ranker.FEATURES)
        got[r.race_id].append((r.i, r.j))
    assert sorted(got["small"]) == list(combinations(range(3, 61, 3), 2)) and "one" not in got
    large = got["large"]
    assert len(set(large)) == len(large) == 600 and all(1 <= i < j <= 100 for i, j in large) and {x for p in large for x in p} == set(range(1, 101))


def test_strength_in_the_order_of_races(spark):
    """All races one after another, by a plain loop."""
    rows = results.performances(league.races(spark, SF), league.results(spark, SF)).select("race_date", "race_id", "world_cup", "fis_code", "pct").collect()
    wide = [(d, r, w, str(int(c) % 12), p) for d, r, w, c, p in rows]  # few athletes, so that there are anchors
    best = {}
    for d, r, w, c, p in wide:
        best[r, c] = min(best.get((r, c), (d, r, w, c, 2.0)), (d, r, w, c, p), key=lambda x: x[4])
    rows = sorted(best.values())
    past, starts, want = defaultdict(list), defaultdict(int), {}
    for (_, race, wc), field in groupby(rows, key=lambda x: x[:3]):
        field = list(field)
        standing = [1 - sum(past[c][-12:]) / len(past[c][-12:]) for *_, c, _ in field if starts[c] >= 5]
        usable = wc or len(standing) >= 5
        mean = sum(standing) / len(standing) if standing else 0.0
        strength = 1.0 if wc else min(1.0, min(1.0, math.log(1 + len(standing)) / math.log(21)) * mean) if usable else 0.0
        want[race] = (len(standing), len(field), mean, strength, usable)
        for *_, c, p in field if usable else ():
            past[c].append(1 - strength * (1 - p))
            starts[c] += wc
    df = spark.createDataFrame(rows, "race_date date, race_id string, world_cup boolean, fis_code string, pct double")
    got = folds.field_strength(df).collect()
    assert len(got) == len(want) and sum(w[4] and w[3] < 1 for w in want.values()) > 10
    for r in got:
        w = want[r.race_id]
        assert (r.n_anchors, r.n_starters, r.usable) == (w[0], w[1], w[4]) and math.isclose(r.strength, w[3], abs_tol=1e-9) and math.isclose(r.anchor_quality, w[2], abs_tol=1e-9)


def mixed(x):
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1)):
        x ^= x >> shift
        x = x * factor & 0xFFFFFFFF
    return x


def plain_ranks(fields, sims, spread=1.0):
    ranks = defaultdict(list)
    for race, field in fields.items():
        keys = {c: hashlib.md5(f"0|{c}".encode()).hexdigest() for c in field}
        for run in range(1, sims + 1):
            u = {c: (mixed(mixed(run ^ int(k[8:16], 16)) ^ int(k[:8], 16)) + 0.5) / 2**32 for c, k in keys.items()}
            order = sorted(field, key=lambda c: (-(field[c] * math.log(10) / 400 - spread * math.log(-math.log(u[c]))), c))  # noqa: B023
            for k, c in enumerate(order, 1):
                ranks[race, c].append(k)
    return ranks


@pytest.mark.parametrize("draws", [1 << 24, 3000])
def test_simulations(spark, few, monkeypatch, draws):
    monkeypatch.setattr(simulate, "GROUP_DRAWS", draws)
    monkeypatch.setattr(simulate, "BLOCK_DRAWS", 1000 if draws > 3000 else 20)
    fields = defaultdict(dict)
    for r in league.results(spark, few).collect():
        fields[r.race_id][r.fis_code] = 1500.0 + int(r.fis_code) % 7 * 40
    ranks = plain_ranks(fields, 20_000 if draws > 3000 else 900)
    got = queries.queries()["simulations"](spark, few) if draws > 3000 else simulate.simulate(queries._field(spark, few), 900)
    got = {(r.race_id, r.fis_code): r for r in got.collect()}
    assert set(got) == set(ranks) and len(fields) > 5
    for key, k in ranks.items():
        assert math.isclose(got[key].mean_rank, sum(k) / len(k), abs_tol=1e-6) and got[key].median_rank == median(k)
        assert all(math.isclose(got[key][c], sum(x <= m for x in k) / len(k), abs_tol=1e-6) for c, m in (("p_win", 1), ("p_podium", 3), ("p_top10", 10)))


def test_chances_to_win_are_a_softmax(spark):
    field = [("r", str(i), 1500.0 + 37 * i) for i in range(9)]
    got = {r.fis_code: r for r in simulate.simulate(spark.createDataFrame(field, "race_id string, fis_code string, rating double"), 40_000, seed=5).collect()}
    theta = {c: math.exp(x * math.log(10) / 400) for _, c, x in field}
    for c, t in theta.items():
        assert abs(got[c].p_win - t / sum(theta.values())) < 0.01
        assert abs(got[c].mean_rank - 1 - sum(o / (o + t) for x, o in theta.items() if x != c)) < 0.05
    with pytest.raises(ValueError):
        simulate.simulate(spark.createDataFrame([], "race_id string, fis_code string, rating double"))


def test_pairs_without_pairs(spark, monkeypatch):
    """Accuracy by counts and losses by blocks, against all pairs; with ties, races of one and of odd sizes."""
    monkeypatch.setattr(metrics, "PAIR_BLOCK", 7)
    draw = random.Random(8)
    rows = [(m, f"r{n}", 3 * p + 1, float(draw.randrange(6) if m == "tied" else draw.random())) for m in ("tied", "free") for n in (1, 2, 3, 17, 32, 61) for p in range(n)]
    df = spark.createDataFrame(rows, "method string, race_id string, pos int, score double")
    want = defaultdict(lambda: [0, 0.0, 0.0])
    for a in rows:
        for b in rows:
            if a[:2] == b[:2] and a[2] < b[2]:
                w = want[a[:2]]
                w[0] += 1
                w[1] += 1.0 if a[3] > b[3] else 0.5 if a[3] == b[3] else 0.0
                w[2] += math.log(1 + math.exp(b[3] - a[3]))
    assert {(r.method, r.race_id): [r.pairs, r.correct] for r in metrics.race_pairs(df).collect()} == {k: w[:2] for k, w in want.items()}
    got = metrics.ranker_metrics(df.where("method = 'tied'")).first()
    n, right, loss = (sum(w[i] for k, w in want.items() if k[0] == "tied") for i in range(3))
    assert got.pairs == n and math.isclose(got.accuracy, right / n) and math.isclose(got.log_loss, loss / n, rel_tol=1e-9)


def test_training_in_one_stage(spark):
    """The barrier stage's weights against plain gradient descent, for tables laid out in two ways."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(60, 9, 11)) + 3
    score = x[:, :, 0] - 0.5 * x[:, :, 3] + draw.normal(0, 0.3, (60, 9))
    rows = [(f"r{r:02}", p + 1, *map(float, x[r, i])) for r in range(60) for p, i in enumerate(np.argsort(-score[r]))]
    df = spark.createDataFrame(rows, "race_id string, pos int, " + ", ".join(f"{n} double" for n in ranker.FEATURES))
    one, two = (ranker.fit(df.repartition(k)) for k in (1, 5))
    assert np.allclose(one.weights, two.weights, atol=1e-10) and (one.pairs, one.races) == (two.pairs, two.races) == (60 * 36, 60)
    flat = np.array([r[2:] for r in rows])
    z = ((flat - flat.mean(axis=0)) / flat.std(axis=0)).reshape(60, 9, 11)
    d = np.concatenate([z[:, i] - z[:, j] for i, j in combinations(range(9), 2)])
    w = np.zeros(11)
    for _ in range(300):
        w -= 0.5 * ((((1 / (1 + np.exp(-d @ w))) - 1)[:, None] * d).mean(axis=0) + 1e-4 * w)
    assert np.allclose(one.weights, w, atol=1e-8)
    with pytest.raises(ValueError):
        ranker.fit(df.where("pos = 1"))
