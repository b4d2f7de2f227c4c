"""Athletes' profiles, races' payloads, leaderboards, and their exports."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..schemas import FEATURES
from ..sources.scratch import settled
from ..sources.store import csv_files
from .features import history
from .metrics import predicted_ranks, race_pairs, rank_correlation
from .results import weekends

# fixed values: the events that a profile rates
EVENTS = (("sprint_c", "sprint", "C", 1.4), ("sprint_f", "sprint", "F", 1.5), ("d10_c", "distance", "C", 10.0), ("d10_f", "distance", "F", 10.0), ("d20_c", "distance", "C", 20.0), ("d20_f", "distance", "F", 20.0), ("d50", "distance", "F", 50.0))


def athlete_summary(perf: DataFrame) -> DataFrame:
    """Athletes with a ranked World Cup result: counts of results, starts (also unfinished), wins, podiums; their gender if it is one."""
    wc, rank = F.col("world_cup"), F.col("rank")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    genders = F.collect_set(F.when(F.col("gender").isin("M", "W"), F.col("gender")))
    g = perf.groupBy("fis_code").agg(F.count("*").alias("n_results"), count(wc).alias("wc_starts"), count(rank == 1).alias("wins"), count(rank <= 3).alias("podiums"), genders.alias("g"), count(wc & rank.isNotNull()).alias("ranked"))
    return g.where("ranked > 0").select("fis_code", "n_results", "wc_starts", "wins", "podiums", F.when(F.size("g") == 1, F.element_at("g", 1)).alias("gender"))


def athlete_payloads(perf: DataFrame, min_results: int = 3) -> DataFrame:
    """fis_code, payload: a JSON text of each athlete's results in order of (date, race)."""
    one = F.struct(F.col("race_date"), "race_id", "series", "world_cup", "kind", "technique", "length_km", "rank", "field", F.round("pct", 4).alias("percentile"), F.round("margin", 3).alias("margin"))
    rows = perf.join(athlete_summary(perf).where(F.col("n_results") >= min_results).select("fis_code"), "fis_code", "left_semi")
    return rows.groupBy("fis_code").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("payload"))


def best_events(perf: DataFrame) -> DataFrame:
    """fis_code, event, form, n_similar: the first feature the day after an athlete's last race, for each event."""
    events = F.array(*[F.struct(F.lit(e).alias("event"), F.lit(k).alias("kind"), F.lit(t).alias("technique"), F.lit(x).alias("length_km")) for e, k, t, x in EVENTS])
    last = perf.groupBy("fis_code").agg(F.date_add(F.max("race_date"), 1).alias("race_date")).select("fis_code", "race_date", F.explode(events).alias("e"))
    targets = last.select("fis_code", "race_date", F.col("e.event").alias("race_id"), "e.kind", "e.technique", "e.length_km")
    g = history(targets, perf).groupBy("fis_code", F.col("race_id").alias("event")).agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("p_pct")).alias("swx"))
    return g.where("sw > 0").select("fis_code", "event", F.round(1 - F.col("swx") / F.col("sw"), 4).alias("form"), F.round("sw", 2).alias("n_similar"))


def athlete_index(perf: DataFrame, athletes: DataFrame, min_results: int = 3) -> DataFrame:
    """Counts of each athlete with a payload, and the event of the best form; to be shown by wc_starts, most first, then name."""
    best = best_events(perf).groupBy("fis_code").agg(F.min_by("event", F.struct(-F.col("form"), "event")).alias("best_event"), F.max("form").alias("best_form"))
    named = athletes.select("fis_code", "name", "nation")
    out = athlete_summary(perf).where(F.col("n_results") >= min_results).join(best, "fis_code", "left").join(named, "fis_code", "left")
    return out.select("fis_code", "name", "nation", "gender", "n_results", "wc_starts", "wins", "podiums", "best_event", "best_form")


def race_summary(scored: DataFrame) -> DataFrame:
    """race_id, n_athletes, pair_accuracy, spearman and winner_predicted_rank of each scored race."""
    ranked = settled(predicted_ranks(scored).select("race_id", "predicted", "actual"), "ranked")
    pairs = race_pairs(ranked.select(F.lit("score").alias("method"), "race_id", F.col("actual").alias("pos"), (-F.col("predicted")).alias("score")))
    counts = ranked.groupBy("race_id").agg(F.count("*").alias("n_athletes"), F.max(F.when(F.col("actual") == 1, F.col("predicted"))).alias("winner_predicted_rank"))
    out = counts.join(rank_correlation(ranked), "race_id").join(pairs, "race_id", "left")
    return out.select("race_id", "n_athletes", F.round(F.col("correct") / F.col("pairs"), 4).alias("pair_accuracy"), F.round("spearman", 4).alias("spearman"), "winner_predicted_rank")


def race_payloads(scored: DataFrame) -> DataFrame:
    """race_id, payload: JSON of the race's summary and of each athlete's score, predicted and actual rank and features."""
    w = Window.partitionBy("race_id")
    rows = scored.where("race_id IS NOT NULL").withColumns({"predicted": F.row_number().over(w.orderBy(F.desc("score"), "pos")), "actual": F.row_number().over(w.orderBy("pos"))})
    values = F.map_from_arrays(F.array(*map(F.lit, FEATURES)), F.array(*[F.round(n, 4) for n in FEATURES]))
    one = F.to_json(F.struct("predicted", "fis_code", F.round("score", 4).alias("score"), "actual", values.alias("features")))
    summary = race_summary(scored)
    heads = summary.select("race_id", F.lit(0).alias("predicted"), F.to_json(F.struct(*summary.columns)).alias("text"))
    parts = heads.unionByName(rows.select("race_id", "predicted", one.alias("text"))).repartition("race_id").sortWithinPartitions("race_id", "predicted")

    def joined(batches):
        """Rows come by race, its summary first: only one race's texts are held at a time."""
        race, texts = None, []

        def out():
            payload = f'{texts[0][:-1]},"athletes":[{",".join(texts[1:])}]}}'
            return pa.RecordBatch.from_pydict({"race_id": pa.array([race], pa.string()), "payload": pa.array([payload], pa.string())})

        for b in batches:
            for r, t in zip(b.column("race_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if r != race and texts:
                    yield out()
                    texts = []
                race = r
                texts.append(t)
        if texts:
            yield out()

    return parts.select("race_id", "text").mapInArrow(joined, "race_id string, payload string")


# fixed values: columns of the CSV files
ATHLETE_CSV = ["athlete", "nation", "gender", "date", "season", "series", "world_cup", "place", "title", "kind", "technique", "length_km", "rank", "field_size", "pct_of_field_beaten", "margin_to_winner"]
RACE_CSV = ["race_id", "date", "place", "title", "kind", "technique", "length_km", "predicted_rank", "actual_rank", "athlete", "nation", "model_score", "similar_form", "similar_races"]
WEEKEND_CSV = ["date", "place", "title", "kind", "technique", "length_km", "predicted_rank", "actual_rank", "athlete", "nation", "model_score"]


def athlete_csv(perf: DataFrame, races: DataFrame, athletes: DataFrame, min_results: int = 3) -> DataFrame:
    """fis_code, text: each athlete's career as a CSV file."""
    who = athlete_summary(perf).where(F.col("n_results") >= min_results).select("fis_code", F.col("gender").alias("g")).join(athletes.select("fis_code", F.col("name").alias("athlete"), "nation"), "fis_code", "left")
    rows = perf.join(who, "fis_code").join(races.select("race_id", "title"), "race_id", "left").drop("gender").withColumnRenamed("g", "gender")
    beaten = F.when(F.col("rank").isNotNull(), F.format_string("%.4f", 1 - F.col("pct")))
    rows = rows.withColumns({"date": F.col("race_date"), "world_cup": F.when(F.col("world_cup"), "yes").otherwise("no"), "field_size": F.col("field"), "pct_of_field_beaten": beaten, "margin_to_winner": F.round("margin", 3)})
    return csv_files(rows, "fis_code", ["date", "race_id"], ATHLETE_CSV)


def _scored_rows(scored: DataFrame, races: DataFrame, athletes: DataFrame) -> DataFrame:
    w = Window.partitionBy("race_id")
    rows = scored.select("race_id", "fis_code", F.row_number().over(w.orderBy(F.desc("score"), "pos")).alias("predicted_rank"), F.row_number().over(w.orderBy("pos")).alias("actual_rank"), F.round("score", 4).alias("model_score"), F.round("similar_form", 4).alias("similar_form"), F.format_string("%.2f", F.exp("experience") - 1).alias("similar_races"))
    rows = rows.join(athletes.select("fis_code", F.col("name").alias("athlete"), "nation"), "fis_code", "left")
    return rows.join(races.select("race_id", F.col("race_date").alias("date"), "place", "title", "kind", "technique", "length_km"), "race_id")


def race_csv(scored: DataFrame, races: DataFrame, athletes: DataFrame) -> DataFrame:
    """race_id, text: each scored race as a CSV file, by predicted rank."""
    rows = _scored_rows(scored, races, athletes).withColumn("file", F.col("race_id"))
    return csv_files(rows, "file", ["predicted_rank"], RACE_CSV).withColumnRenamed("file", "race_id")


def weekend_csv(scored: DataFrame, races: DataFrame, athletes: DataFrame) -> DataFrame:
    """key, text: the scored races of each weekend as one CSV file, by date, race and predicted rank."""
    member = weekends(races).select("key", F.explode(F.split("race_ids", ",")).alias("race_id"))
    return csv_files(_scored_rows(scored, races, athletes).join(member, "race_id"), "key", ["date", "race_id", "predicted_rank"], WEEKEND_CSV)


def medal_table(perf: DataFrame) -> DataFrame:
    """season, gender, kind, level, golds, silvers, bronzes, medallists of World Cup races, at four levels from one pass.

    level is the grouping id: 0 for all three columns, 1 over all kinds, 3 over genders too, 7 for everything; what is
    summed over is null.
    """
    won = lambda k: F.count_if(F.col("rank") == k)
    rows = perf.where("world_cup AND rank <= 3").rollup("season", "gender", "kind")
    return rows.agg(F.grouping_id("season", "gender", "kind").alias("level"), won(1).alias("golds"), won(2).alias("silvers"), won(3).alias("bronzes"), F.countDistinct("fis_code").alias("medallists")).select("season", "gender", "kind", "level", "golds", "silvers", "bronzes", "medallists")


def starter_sketches(perf: DataFrame, athletes: DataFrame) -> DataFrame:
    """season, nation, sketch: a HyperLogLog sketch of the starters, of a few kilobytes at any number of them.

    Sketches are stored and merged: those of a new ingest need no old rows.
    """
    rows = perf.select("season", "fis_code").join(athletes.select("fis_code", "nation"), "fis_code", "left")
    return rows.groupBy("season", "nation").agg(F.hll_sketch_agg("fis_code", F.lit(12)).alias("sketch"))


def merged_sketches(*sketches: DataFrame) -> DataFrame:
    """Sketches of several ingests in one table, one of each season and nation."""
    return reduce(DataFrame.unionByName, sketches).groupBy("season", "nation").agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_starters(sketches: DataFrame, *by: str) -> DataFrame:
    """``by`` (season, nation, both or nothing) and starters, the estimated number of different ones: a starter of two seasons is one
    in their union. The standard error is about 1.3 %."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("starters"))


def race_index(races: DataFrame, results: DataFrame, held_out: list[int]) -> DataFrame:
    """race_id, race_date, season, n, held_out; to be shown newest first, undated last."""
    n = results.groupBy("race_id").agg(F.count("*").alias("n"))
    return races.join(n, "race_id").select("race_id", "race_date", "season", "n", F.coalesce(F.col("season").isin(held_out), F.lit(False)).alias("held_out"))


def leaderboard(ratings: DataFrame, min_races: int = 5, top: int = 20) -> DataFrame:
    """The best of each pool among those with enough races."""
    place = F.row_number().over(Window.partitionBy("pool").orderBy(F.desc("rating"), "fis_code"))
    return ratings.where(F.col("n_races") >= min_races).withColumn("place", place).where(F.col("place") <= top).select("pool", "place", "fis_code", "rating", "n_races")


def rating_as_of(ratings: DataFrame, day: str) -> DataFrame:
    return ratings.select("fis_code", "pool", K.decayed(F.col("rating"), F.coalesce(F.datediff(F.lit(day).cast("date"), F.col("last_date")), F.lit(0))).alias("rating"))
