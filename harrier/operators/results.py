"""Races and their results: filters, percentiles, margins, positions, weekends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.titles import is_excluded, is_standings, is_world_cup

MIN_TIMED = 6


def datable_races(races: DataFrame) -> DataFrame:
    """Dated individual races; a null is_team counts as individual."""
    return races.where(F.col("race_date").isNotNull() & ~F.coalesce("is_team", F.lit(False)))


def finished_races(races: DataFrame, results: DataFrame, include_team: bool = False) -> DataFrame:
    """Races with a ranked result. Unlike above, undated ones stay and a null is_team is dropped."""
    found = races.join(results.where(F.col("rank").isNotNull()).select("race_id"), "race_id", "left_semi")
    return found if include_team else found.where(~F.col("is_team"))


def single_races(races: DataFrame) -> DataFrame:
    """Without pages of standings."""
    return races.where(~is_standings(F.col("title")))


def counted_as_ok(status: Column) -> Column:
    return F.coalesce(F.nullif(status, F.lit("")), F.lit("OK")) == "OK"


def performances(races: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each result of a dated individual race that isn't excluded.

    pct: 1 if unranked, 0 in a field of one, else (rank - 1) / (field - 1), where the field has all
    rows. margin: share of the spread between the winner and the upper median, of timed rows, if
    there are six or more and the spread is positive. pos: place by (rank, fis_code), unranked last.

    What is known of a race is joined to its rows after they are sorted, so that no sort carries it.
    """
    r = datable_races(races).where(~is_excluded(F.col("series")))
    rows = results.where("race_id IS NOT NULL").select("race_id", "fis_code", "rank", "time_s", "fis_points", "status")
    in_race = Window.partitionBy("race_id")
    timed = F.when(F.col("rank").isNotNull() & (F.col("time_s") != 0), F.col("time_s"))
    rows = rows.withColumns({"timed": timed, "field": F.count("*").over(in_race), "n_timed": F.count(timed).over(in_race)})
    rows = rows.withColumns({"pos": F.row_number().over(in_race.orderBy(F.col("rank").asc_nulls_last(), "fis_code")), "by_time": F.row_number().over(in_race.orderBy(F.col("timed").asc_nulls_last(), "fis_code"))})
    # two numbers a race: the winner's time and the upper median
    median = F.max(F.when(F.col("by_time") == F.floor(F.col("n_timed") / 2) + 1, F.col("timed"))).over(in_race)
    rows = rows.withColumns({"winner": F.min("timed").over(in_race), "median": median})
    n, spread = F.col("n_timed"), F.col("median") - F.col("winner")
    pct = F.when(F.col("rank").isNull(), 1.0).when(F.col("field") <= 1, 0.0).otherwise((F.col("rank") - 1) / (F.col("field") - 1))
    margin = F.when((n >= MIN_TIMED) & (spread > 0), (F.col("timed") - F.col("winner")) / spread)
    rows = rows.select("race_id", "fis_code", "rank", "status", "fis_points", "field", "pos", pct.alias("pct"), margin.alias("margin"))
    rows = rows.join(r.select("race_id", "race_date", "season", "series", "kind", "technique", "length_km", "gender", "place"), "race_id")
    return rows.select(
        "race_id", "fis_code", "race_date", "season", "place", "series", is_world_cup(F.col("series")).alias("world_cup"), "gender", "kind", "technique", "length_km",
        "rank", "status", "fis_points", "field", "pos", "pct", "margin",
    )


def weekends(races: DataFrame, gap: int = 4) -> DataFrame:
    """Runs of races in one place in which the next race is at most ``gap`` days later."""
    dated = races.where(F.col("race_date").isNotNull() & F.col("place").isNotNull() & (F.col("place") != ""))
    by = Window.partitionBy("place").orderBy("race_date", "race_id")
    new = F.coalesce((F.datediff("race_date", F.lag("race_date").over(by)) > gap).cast("int"), F.lit(1))
    runs = dated.withColumn("new", new).withColumn("run", F.sum("new").over(by))
    out = runs.groupBy("place", "run").agg(F.min("race_date").alias("start_date"), F.max("race_date").alias("end_date"), F.array_sort(F.collect_list("race_id")).alias("ids"), F.count("*").alias("n_races"))
    return out.select(F.concat_ws("|", "place", F.col("start_date").cast("string")).alias("key"), "place", "start_date", "end_date", F.array_join("ids", ",").alias("race_ids"), "n_races")


def split_by_season(samples: DataFrame, held_out: list[int]) -> tuple[DataFrame, DataFrame]:
    """Rows to train on and rows to test on; a null season is trained on."""
    test = F.coalesce(F.col("season").isin(held_out), F.lit(False))
    return samples.where(~test), samples.where(test)


def chosen(perf: DataFrame, *, world_cup: bool = False, kind: str | None = None, technique: str | None = None, season: int | None = None, race_ids: list[str] | None = None) -> DataFrame:
    """Ranked performances that a reader wants counted: as the history of features, or as points of a curve."""
    out = perf.where(F.col("rank").isNotNull())
    for on, test in ((world_cup, F.col("world_cup")), (kind, F.col("kind") == kind), (technique, F.col("technique") == technique), (season, F.col("season") == season), (race_ids, F.col("race_id").isin(race_ids or []))):
        if on:
            out = out.where(test)
    return out


def trajectory(perf: DataFrame, **choice) -> DataFrame:
    """Dated points of an athlete's curve: the place, and 1 + 99 x percentile."""
    return chosen(perf, **choice).select("fis_code", "race_id", "race_date", "rank", (1 + 99 * F.col("pct")).alias("adjusted"))


def median_places(points: DataFrame) -> DataFrame:
    """fis_code, n, median: the upper median of an athlete's places."""
    by = Window.partitionBy("fis_code")
    rows = points.withColumns({"i": F.row_number().over(by.orderBy("rank")), "n": F.count("*").over(by)})
    return rows.where(F.col("i") == F.floor(F.col("n") / 2) + 1).select("fis_code", "n", F.col("rank").alias("median"))
