"""What is exported of scored races and of athletes."""

import json
import math
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from harrier.functions import fantasy
from harrier.operators import folds, metrics, profiles, results
from harrier.sources import pages
from harrier.sources.scratch import settled
from harrier.testing import league

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_files_and_comparison(spark):
    races, res, athletes = league.races(spark, SF), league.results(spark, SF), league.athletes(spark, SF)
    perf = settled(results.performances(races, res).where("race_id < '199512'"), "test")
    scored = perf.where("rank IS NOT NULL").withColumn("score", F.hash("race_id", "fis_code") / F.lit(1e9))
    for name in profiles.FEATURES:
        scored = scored.withColumn(name, F.coalesce("pct", F.lit(0.0)))
    scored = settled(scored, "test")
    n = {r.race_id: r["count"] for r in scored.groupBy("race_id").count().collect()}
    files = {r.race_id: r.text for r in profiles.race_csv(scored, races, athletes).collect()}
    assert {k: v.count("\r\n") - 1 for k, v in files.items()} == n
    first = next(iter(files.values())).split("\r\n")
    assert first[0].startswith('﻿"race_id","date"') and first[1].split(",")[7] == '"1"'
    payloads = [json.loads(r.payload) for r in profiles.race_payloads(scored).collect()]
    assert {p["race_id"]: p["n_athletes"] for p in payloads} == n and all([a["predicted"] for a in p["athletes"]] == list(range(1, n[p["race_id"]] + 1)) for p in payloads)
    weekends = profiles.weekend_csv(scored, races, athletes).collect()
    dated = scored.join(races.where("place IS NOT NULL").select("race_id"), "race_id", "left_semi").count()
    assert sum(r.text.count("\r\n") - 1 for r in weekends) == dated
    careers = {r.fis_code: r.text.count("\r\n") - 1 for r in profiles.athlete_csv(perf, races, athletes, 2).collect()}
    assert careers == {r.fis_code: r.n_results for r in profiles.athlete_summary(perf).where("n_results >= 2").collect()}
    scores = metrics.elo_scores(scored, folds.ratings_before(races, res)).unionByName(scored.select(F.lit("drawn").alias("method"), "race_id", "fis_code", "pos", "score"))
    rows = {r.method: r for r in metrics.pair_accuracy(scores, scored).collect()}
    assert rows["drawn"].skipped == 0 and rows["elo"].skipped > 0
    assert metrics.format_comparison(metrics.pair_accuracy(scores, scored)).count("\n") == 2


def test_forcing_costs_are_two_solutions_each(spark):
    draw = random.Random(3)
    rows = [(g, f"{g}-{i}", draw.choice("MW"), float(draw.randrange(1, 90)), draw.randrange(3, 60 if i % 9 else 260)) for g in (1, 2) for i in range(14)]
    m = spark.createDataFrame(rows, "game int, fis_code string, gender string, points double, price int")
    got = {r.fis_code: r.cost for r in fantasy.forcing_costs(m, 120, 2, 3).collect()}
    assert len(got) == 28 and None in got.values()
    for g in (1, 2):
        own = pd.DataFrame([r[1:] for r in rows if r[0] == g], columns=["fis_code", "gender", "points", "price"])
        for code in own.fis_code:
            want = fantasy.cost_of_forcing(own, code, 120, 2, 3)
            assert got[code] == want or math.isclose(got[code], want)


def test_sketches_merge_and_count(spark):
    perf = spark.range(40_000).selectExpr("cast(id % 3 + 2020 AS int) AS season", "cast(id % 9000 AS string) AS fis_code")
    athletes = spark.range(9000).selectExpr("cast(id AS string) AS fis_code", "concat('N', id % 4) AS nation")
    whole = profiles.starter_sketches(perf, athletes)
    parts = profiles.merged_sketches(profiles.starter_sketches(perf.where("fis_code < '5'"), athletes), profiles.starter_sketches(perf.where("fis_code >= '5'"), athletes))
    for by in ((), ("season",), ("nation",), ("season", "nation")):
        exact = {tuple(r)[:-1]: r[-1] for r in perf.join(athletes, "fis_code").groupBy(*by).agg(F.countDistinct("fis_code").alias("n")).select(*by, "n").collect()}
        for df in (whole, parts):
            got = {tuple(r)[:-1]: r[-1] for r in profiles.distinct_starters(df, *by).collect()}
            assert set(got) == set(exact) and all(abs(got[k] / n - 1) < 0.05 for k, n in exact.items())


def test_pages_in_sql(spark):
    html = "".join(f'<a class="table-row" href="x?competitorid={k}"><div>{k}</div><div>342000{k}</div><div>BERG {k}</div></a>' for k in (1, 2))
    df = spark.createDataFrame([("r", html), ("n", None)], "race_id string, html string")
    pages.register(spark)
    got = spark.sql("SELECT p.race_id, r.rank, r.fis_code, r.name FROM {p} p, LATERAL race_page(p.html) r", p=df)
    assert sorted(got.collect()) == sorted(pages.parse_race_pages(df).select("race_id", "rank", "fis_code", "name").collect())
