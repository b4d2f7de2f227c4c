"""Axes that curves share, and features of a chosen history."""

import math
from datetime import date

from harrier.operators import charts, features


def test_axes_are_shared(spark):
    points = spark.createDataFrame(
        [("a", "1", date(2020, 12, 30), 3), ("a", "2", date(2020, 12, 30), 12), ("a", "1", date(2021, 1, 2), 1), ("a", "2", date(2021, 3, 9), 4), ("a", "2", None, 90), ("a", "1", date(2021, 5, 1), None), ("b", "3", date(2019, 1, 1), 120)],
        "chart string, fis_code string, race_date date, rank int",
    )
    assert sorted(charts.axes(points).collect()) == [("a", date(2020, 12, 30), 0.0, 20, 2020), ("a", date(2021, 1, 2), 0.5, 20, 2021), ("a", date(2021, 3, 9), 1.0, 20, None), ("b", date(2019, 1, 1), 0.5, 120, 2019)]
    at = {(r.chart, r.fis_code, r["rank"]): (r.x, r.y) for r in charts.curves(points).collect()}
    assert at == {("a", "1", 3): (0.0, 2 / 19), ("a", "2", 12): (0.0, 11 / 19), ("a", "1", 1): (0.5, 0.0), ("a", "2", 4): (1.0, 3 / 19), ("b", "3", 120): (0.5, 1.0)}
    marked = {c: sorted((r.tick, r.y) for r in charts.ticks(points).collect() if r.chart == c) for c in "ab"}
    assert [t for t, _ in marked["a"]] == [1, 5, 10, 20] and [t for t, _ in marked["b"]] == [1, 5, 10, 20, 30, 50, 100, 120]
    assert marked["b"][-1] == (120, 1.0)
    none = points.limit(0)
    assert charts.axes(none).isEmpty() and charts.curves(none).isEmpty() and charts.ticks(none).isEmpty()


def test_reader_chooses_the_history(spark):
    perf = spark.createDataFrame(
        [
            ("r1", "1", date(2020, 1, 1), "sprint", "C", 1.5, 1, 10.0, 0.0, 0.0, True),
            ("r2", "1", date(2020, 1, 11), "sprint", "F", 1.5, 9, 20.0, 0.8, None, True),
            ("r3", "1", date(2020, 1, 21), "sprint", "C", 1.5, None, 30.0, 1.0, None, True),
            ("r4", "1", date(2020, 1, 31), "sprint", "C", 1.5, 2, 30.0, 0.1, None, False),
            ("r5", "1", date(2020, 2, 10), "sprint", "C", 1.5, 5, 30.0, 0.5, None, True),
        ],
        "race_id string, fis_code string, race_date date, kind string, technique string, length_km double, rank int, fis_points double, pct double, margin double, world_cup boolean",
    )
    target = perf.where("race_id = 'r5'")
    (got,) = features.reader_features(target, perf, world_cup=True).collect()
    w = [0.5 ** (40 / 150), 0.15 * 0.5 ** (30 / 150)]  # r1 and r2; r3 has no rank, r4 is no World Cup race
    assert math.isclose(got.similar_form, 1 - w[1] * 0.8 / sum(w)) and math.isclose(got.experience, math.log1p(sum(w)))
    assert (got.fis_points, got.has_fis_points, got.has_margin, got.similar_margin) == (0.5, 0.0, 1.0, 1.0)
    (classic,) = features.reader_features(target, perf, world_cup=True, technique="C").collect()
    assert classic.similar_form == 1.0 and math.isclose(classic.recent_starts, math.log1p(1))
    assert features.reader_features(target, perf, kind="distance").isEmpty()
