import math
from datetime import date

import numpy as np
import pytest

from harrier.functions import kernels as K
from harrier.operators import folds, metrics, ranker, simulate
from harrier.schemas import FEATURES
from harrier.streaming.ratings import RACE, rate_stream


def test_ratings_are_conserved_and_small_fields_ignored():
    state = {}
    folds.update_race(state, ["a", "b"], np.array([1.0, 2.0]), date(2024, 1, 1))
    assert state == {}
    folds.update_race(state, ["a", "b", "c"], np.array([1.0, 2.0, 2.0]), date(2024, 1, 1), "r")
    assert math.isclose(sum(x[0] for x in state.values()), 4500) and state["a"][0] > 1500 and state["b"][0] == state["c"][0]


def test_fold_against_a_plain_loop(spark):
    races = spark.createDataFrame([(f"r{i}", date(2024, 1, 1 + i), "M", "sprint", False) for i in range(6)], "race_id string, race_date date, gender string, kind string, is_team boolean")
    rows = [(f"r{i}", f"a{j}", (j * (i + 3)) % 7 + 1, None if j else "") for i in range(6) for j in range(6)]
    res = spark.createDataFrame(rows, "race_id string, fis_code string, rank int, status string")
    state = {}
    for i in range(6):
        got = sorted([(r[2], r[1]) for r in rows if r[0] == f"r{i}"])
        folds.update_race(state, [c for _, c in got], np.array([float(k) for k, _ in got]), date(2024, 1, 1 + i), f"r{i}")
    got = {r.fis_code: r.rating for r in folds.elo_ratings(races, res).collect()}
    assert all(math.isclose(got[c], x[0]) for c, x in state.items())
    before = folds.ratings_before(races, res)
    assert before.where("race_id = 'r0'").select("rating").distinct().collect()[0].rating == K.ELO_START
    assert metrics.backtest(before, 3).first().races == 5


def test_ratings_against_a_loop_over_pairs(spark):
    """Written apart from the fold: every pair of a race, one after another."""
    races = [(f"r{i}", date(2024, 1, 1 + 40 * i % 27), "W", "distance", False) for i in range(8)]
    rows = [(f"r{i}", f"a{j}", (j * (i + 2)) % 6 + 1) for i in range(8) for j in range(9) if (i + j) % 4]
    rating, seen, last = {}, {}, {}
    for race, day, *_ in sorted(races, key=lambda x: (x[1], x[0])):
        field = {c: k for r, c, k in rows if r == race}
        now = {c: 1500 + 0.5 ** ((day - last[c]).days / 1825) * (rating[c] - 1500) if c in last and day > last[c] else rating.get(c, 1500.0) for c in field}
        for c in field:
            gain = 0.0
            for d in field:
                if d != c:
                    gain += (1.0 if field[c] < field[d] else 0.5 if field[c] == field[d] else 0.0) - 1 / (1 + 10 ** ((now[d] - now[c]) / 400))
            rating[c] = now[c] + (60 if seen.get(c, 0) < 10 else 200) * gain / (len(field) - 1)
        for c in field:
            seen[c], last[c] = seen.get(c, 0) + 1, day
    got = folds.elo_ratings(spark.createDataFrame(races, "race_id string, race_date date, gender string, kind string, is_team boolean"), spark.createDataFrame([(*r, "OK") for r in rows], "race_id string, fis_code string, rank int, status string")).collect()
    assert {r.fis_code: (round(r.rating, 8), r.n_races) for r in got} == {c: (round(x, 8), seen[c]) for c, x in rating.items()}


def test_blocks_of_opponents(monkeypatch):
    draw, whole, blocks = np.random.default_rng(1), {}, {}
    ranks = draw.integers(1, 30, 50).astype(float)
    folds.update_race(whole, [str(i) for i in range(50)], ranks, None)
    monkeypatch.setattr(folds, "OPPONENTS", 7)
    folds.update_race(blocks, [str(i) for i in range(50)], ranks, None)
    assert all(math.isclose(whole[c][0], blocks[c][0]) for c in whole)


def test_favourite_wins_as_often_as_its_odds(spark):
    field = spark.createDataFrame([("r", "a", 1900.0), ("r", "b", 1500.0)], "race_id string, fis_code string, rating double")
    got = {r.fis_code: r for r in simulate.simulate(field, 4000).collect()}
    assert abs(got["a"].p_win - 10 / 11) < 0.02 and math.isclose(got["a"].p_win + got["b"].p_win, 1) and got["b"].p_podium == 1


def test_ranker_learns_and_round_trips(spark):
    draw = np.random.default_rng(0)
    rows = []
    for race in range(20):
        x = draw.normal(0, 0.05, (8, len(FEATURES)))
        x[:, 0] = np.linspace(1, 0, 8)
        rows += [(f"r{race}", i + 1, *map(float, x[i])) for i in range(8)]
    df = spark.createDataFrame(rows, "race_id string, pos int, " + ", ".join(f"{n} double" for n in FEATURES))
    model = ranker.fit(df)
    again = ranker.Ranker.from_json(model.to_json())
    assert metrics.ranker_metrics(df.withColumn("score", again.score())).first().accuracy > 0.95 and model.explain()[0][0] == "similar_form"


def test_ties_are_half(spark):
    df = spark.createDataFrame([("m", "r", 1, 0.5), ("m", "r", 2, 0.5), ("m", "r", 3, 0.1)], "method string, race_id string, pos int, score double")
    r = metrics.pair_accuracy(df).first()
    assert (r.pairs, r.correct) == (3, 2.5)


def test_stream_agrees_with_update(spark, tmp_path):
    spark.createDataFrame([("p", "r1", date(2024, 1, 1), ["a", "b", "c"], [1.0, 2.0, 3.0])], RACE).write.parquet(str(tmp_path / "in"))
    q = rate_stream(spark.readStream.schema(RACE).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("rated").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    state = {}
    folds.update_race(state, ["a", "b", "c"], np.array([1.0, 2.0, 3.0]), date(2024, 1, 1))
    assert {r.fis_code: r.rating for r in spark.table("rated").collect()} == {c: x[0] for c, x in state.items()}


def test_stream_out_of_order_and_restarted_is_the_batch_fold(spark, tmp_path):
    draw, races = np.random.default_rng(5), []
    for i in range(24):
        codes = [f"a{x}" for x in draw.choice(12, int(draw.integers(2, 9)), replace=False)]
        day = None if i < 2 else date.fromordinal(date(2024, 1, 1).toordinal() + i // 3 * 2)  # three races a day
        races.append((f"p{i % 2}", f"r{i:02}", day, codes, [float(x) for x in draw.integers(1, 6, len(codes))]))
    far = [(p, "end", date(2026, 1, 1), ["x", "y"], [1.0, 2.0]) for p in ("p0", "p1")]
    mixed = [races[:8][::-1], races[8:16][::-1], races[16:][::-1] + [races[9]], [("p0", "late", date(2024, 1, 2), ["a1", "a2", "a3"], [1.0, 2.0, 3.0])], far, far]
    mixed[0], mixed[1] = mixed[0] + mixed[1][:3], mixed[1][3:] + mixed[0][2:3]  # some a batch too early, one twice

    def run(batches):
        for b in batches:
            spark.createDataFrame(b, RACE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q = rate_stream(spark.readStream.schema(RACE).parquet(str(tmp_path / "in")), "60 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
            q.processAllAvailable()
            q.stop()

    run(mixed[:3])
    waited = spark.read.parquet(str(tmp_path / "out")).count() if (tmp_path / "out").exists() else 0
    run(mixed[4:] + mixed[3:4])  # the late race comes when its time is over
    want = {}
    for p in ("p0", "p1"):
        state = {}
        for _, race_id, day, codes, ranks in sorted((r for r in races if r[0] == p), key=lambda r: (r[2] or date.min, r[1])):
            folds.update_race(state, codes, np.array(ranks), day, race_id)
            want |= {(p, race_id, c): tuple(state[c][:2]) for c in codes if c in state}
    got = [((r.pool, r.race_id, r.fis_code), (r.rating, r.n_races)) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert waited < len(got) == len(want) and all(want[k][1] == n and math.isclose(want[k][0], x, rel_tol=1e-12) for k, (x, n) in got)


def test_performances_are_made_once_for_grades_and_samples(spark, monkeypatch):
    from harrier.plans import queries

    seen = []

    def stop(perf):
        seen.append(perf._jdf.queryExecution().sparkPlan().toString())
        raise StopIteration

    monkeypatch.setattr(queries.folds, "field_strength", stop)
    for query in (queries.graded_samples, queries.field_strength):
        with pytest.raises(StopIteration):
            query(spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and all("harrier-performances" in p and "Window" not in p for p in seen)
