"""Payloads of races are joined from sorted rows: no aggregate holds many races at once."""

import json

from harrier.operators import profiles
from harrier.schemas import FEATURES


def test_payloads_hold_one_race_at_a_time(spark):
    rows = [(f"r{k % 3}" if k else None, f"a{k}", k, k / 7 if k % 5 else None, *[k / 3] * len(FEATURES)) for k in range(40)]
    scored = spark.createDataFrame(rows, "race_id string, fis_code string, pos int, score double, " + ", ".join(f"{n} double" for n in FEATURES)).repartition(5)
    made = profiles.race_payloads(scored)
    assert "collect_list" not in made._jdf.queryExecution().toString()
    got = {r.race_id: json.loads(r.payload) for r in made.collect()}
    summary = {r.race_id: r for r in profiles.race_summary(scored.where("race_id IS NOT NULL")).collect()}
    assert set(got) == set(summary) == {"r0", "r1", "r2"}
    for race, x in got.items():
        mine = [r for r in rows if r[0] == race]
        assert {k: v for k, v in x.items() if k != "athletes"} == {k: v for k, v in summary[race].asDict().items() if v is not None}
        assert [a["predicted"] for a in x["athletes"]] == list(range(1, len(mine) + 1))
        order = sorted(mine, key=lambda r: (r[3] is None, -(r[3] or 0), r[2]))
        assert [a["fis_code"] for a in x["athletes"]] == [r[1] for r in order]
        assert all(set(a["features"]) == set(FEATURES) and ("score" in a) == (r[3] is not None) for a, r in zip(x["athletes"], order, strict=True))


def test_summaries_rank_once(spark):
    """The ranks of a race are made once and read by all figures, by no window of their own."""
    scored = spark.createDataFrame([(r, f"a{k}", k, float(k * 5 % 7)) for r in ("p", "q") for k in range(1, 8)], "race_id string, fis_code string, pos int, score double")
    made = profiles.race_summary(scored)
    assert "Window" not in made._jdf.queryExecution().sparkPlan().toString()
    order = sorted(range(1, 8), key=lambda k: (-(k * 5 % 7), k))
    right = sum(order.index(i) < order.index(j) for i in range(1, 8) for j in range(i + 1, 8))
    assert [(r.race_id, r.n_athletes, r.pair_accuracy, r.winner_predicted_rank) for r in made.orderBy("race_id").collect()] == [(r, 7, round(right / 21, 4), order.index(1) + 1) for r in "pq"]
