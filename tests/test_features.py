import math
import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from harrier.functions import kernels as K
from harrier.operators import features as feat
from harrier.operators import results
from harrier.schemas import FEATURES

PAST = "race_id string, fis_code string, race_date date, kind string, technique string, length_km double, pct double, fis_points double, margin double"
DAY = date(2024, 1, 1)


def past(spark, *rows):
    base = {"race_id": "r", "fis_code": "a", "race_date": DAY, "kind": "distance", "technique": "F", "length_km": 10.0, "pct": 0.2, "fis_points": None, "margin": None}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], PAST)


def target(spark, day=DAY + timedelta(days=150)):
    return spark.createDataFrame([("t", "a", day, "distance", "F", 10.0)], "race_id string, fis_code string, race_date date, kind string, technique string, length_km double")


def test_one_race_long_ago(spark):
    r = feat.features(target(spark), past(spark, {})).first()
    assert math.isclose(r.similar_form, 0.8) and math.isclose(r.experience, math.log1p(0.5))
    assert (r.fis_points, r.has_fis_points, r.similar_margin, r.has_margin, r.recent_starts) == (0.5, 0.0, 0.5, 0.0, 0.0)


def test_no_race_of_the_day_or_later_counts(spark):
    rows = [{}, {"race_id": "same", "race_date": DAY + timedelta(days=150), "pct": 0.9}, {"race_id": "later", "race_date": DAY + timedelta(days=200), "pct": 0.9}]
    assert feat.features(target(spark), past(spark, *rows)).collect() == feat.features(target(spark), past(spark, {})).collect()


def test_debutants_have_no_features(spark):
    assert feat.features(target(spark), past(spark, {"fis_code": "b"})).isEmpty()


def test_a_win_has_no_points_to_carry(spark):
    rows = [{"fis_points": 30.0}, {"race_id": "s", "race_date": DAY + timedelta(days=1), "fis_points": 0.0}]
    assert math.isclose(feat.features(target(spark), past(spark, *rows)).first().fis_points, 0.9)


def test_margins_are_clipped(spark):
    r = feat.features(target(spark), past(spark, {"margin": 50.0})).first()
    assert (r.similar_margin, r.has_margin) == (0.0, 1.0)


def test_percentiles_and_margins(spark):
    races = spark.createDataFrame([("r", DAY, 2024, "World Cup", "distance", "F", 10.0, "M", "P", None), ("u", DAY, 2024, "U16 Cup", "distance", "F", 10.0, "M", "P", False)], "race_id string, race_date date, season int, series string, kind string, technique string, length_km double, gender string, place string, is_team boolean")
    rows = [("r", f"a{i}", i, 100.0 + i, None, "OK") for i in range(1, 7)] + [("r", "z", None, None, None, "DNF"), ("u", "a1", 1, 1.0, None, "OK")]
    res = spark.createDataFrame(rows, "race_id string, fis_code string, rank int, time_s double, fis_points double, status string")
    got = {r.fis_code: r for r in results.performances(races, res).collect()}
    assert len(got) == 7 and got["a1"].pct == 0.0 and got["z"].pct == 1.0 and got["z"].pos == 7 and math.isclose(got["a4"].pct, 0.5)
    assert math.isclose(got["a4"].margin, 1.0) and got["z"].margin is None  # the upper median is the fourth


def test_empty_tables(spark):
    assert feat.features(target(spark).limit(0), past(spark, {})).isEmpty()
    assert feat.features(target(spark), past(spark, {}).limit(0)).isEmpty()


def test_adjustment_keeps_the_order(spark):
    df = spark.range(0, 11).select((F.col("id") / 10).alias("p"))
    got = [r.x for r in df.orderBy("p").select(K.adjusted_percentile(F.col("p"), F.lit(0.4)).alias("x")).collect()]
    assert got == sorted(got) and math.isclose(got[0], 0.6) and got[-1] == 1.0


def test_clock(spark):
    got = spark.createDataFrame([("1:02.5",), ("+12.3",), ("1:00:00",), ("x",)], "t string").select(K.clock_seconds(F.col("t"))).collect()
    assert [r[0] for r in got] == [62.5, 12.3, 3600.0, None]


def test_prefix_sums_are_the_joined_history(spark):
    """Both ways, over long histories with every kind of gap, tie and same day."""
    draw = random.Random(11)
    rows = []
    for code, n in (("a", 150), ("b", 40), ("c", 3), ("d", 1)):
        for k in range(n):
            rows.append((f"r{k:03}", code, DAY + timedelta(days=draw.randrange(900)), draw.choice(["sprint", "distance", "?", None]), draw.choice(["C", "F", "CF", "?"]), draw.choice([None, 0.0, 1.5, 10.0, 50.0]), round(draw.random() * 1.3, 1), draw.choice([None, 0.0, 12.5, 400.0]), draw.choice([None, draw.random() * 5])))
    df = spark.createDataFrame(rows, PAST)
    asked = df.select("race_id", "fis_code", "race_date", "kind", "technique", "length_km")
    one, two = ({(r.race_id, r.fis_code): r for r in feat.features(asked, df, joined=most).collect()} for most in (1000, 20))
    assert set(one) == set(two) and len(one) > 180
    for key, r in one.items():
        for n in FEATURES:  # a spread of nothing is the root of what cancels
            assert math.isclose(r[n], two[key][n], abs_tol=1e-6 if n == "consistency" else 1e-9), (key, n, r[n], two[key][n])


def test_samples_are_made_once(spark):
    """However often samples are read, neither the performances nor the history behind them are made again."""
    rows = [(f"r{d:02}", f"a{k}", DAY + timedelta(days=7 * d), 2024, True, "distance", "F", 10.0, k + 1, None, k + 1, k / 7, None) for d in range(4) for k in range(8)]
    perf = spark.createDataFrame(rows, "race_id string, fis_code string, race_date date, season int, world_cup boolean, kind string, technique string, length_km double, rank int, fis_points double, pos int, pct double, margin double")
    got = feat.samples(perf)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "ExistingRDD" not in plan and "p_race_date" not in plan and "harrier-rated" in plan
    assert sorted((r.race_id, r.fis_code) for r in got.collect()) == [(f"r{d:02}", f"a{k}") for d in range(1, 4) for k in range(8)]


def test_the_weighted_quantile_makes_no_list_of_the_history(spark):
    draw = random.Random(8)
    rows = [{"race_id": f"r{i}", "race_date": DAY + timedelta(days=draw.randrange(300)), "technique": draw.choice("CF"), "kind": draw.choice(["sprint", "distance"]), "pct": draw.choice([0.0, 0.25, 0.5, 0.9, 1.0])} for i in range(40)]
    p = past(spark, *rows)
    targets = spark.createDataFrame([(f"t{i}", "a", DAY + timedelta(days=9 * i), "distance", "F", 10.0) for i in range(36)], target(spark).schema)
    got = feat._sums_joined(targets, p)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    got = {r.race_id: r for r in got.collect()}
    known = {}
    for r in feat.history(targets, p).collect():
        known.setdefault(r.race_id, []).append((r.p_pct, r.w))
    assert set(got) == set(known) and len(got) > 25
    for race, found in known.items():
        c, sw, best = 0.0, sum(w for _, w in found), None
        for x, w in sorted(f for f in found if f[1] > 0):
            c += w
            if c >= 0.2 * sw - 1e-12:
                best = x
                break
        assert got[race].best == best and math.isclose(got[race].sw, sw)
