"""Operators in which races hang on earlier ones: Elo ratings and the strength of fields.

Elo reads a stream of rows that is sorted within its partition and keeps only what later races need,
so a pool may be far larger than memory; pools are folded in parallel. Strengths are linear in
earlier ones and are found by rounds over all races at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.scratch import settled
from .results import counted_as_ok, finished_races
from .sums import expected_wins

MIN_FIELD = 3
#: Opponents that ratings are compared with at once, if the field isn't larger; and ratings handed on at once.
OPPONENTS, ROWS = 1024, 50_000


@dataclass(frozen=True)
class Elo:
    """k: the factor of those who raced often enough. half_life: days in which an idle rating loses half its distance to the start."""

    k: float = K.ELO_K
    half_life: float = K.ELO_HALF_LIFE


def update_race(state: dict, codes: list[str], ranks: np.ndarray, when: date | None, race_id: str | None = None, elo: Elo = Elo()) -> None:
    """One race of one pool: every pair's surprise on the ratings before it; ties are half a win.

    Wins are counted by sorting, and in a large field expected wins are sums over smooth pieces (``sums``), so that its time grows
    with the field, not with its pairs.
    state: fis_code to [rating, races, last race, last date]. Fewer than three ranked: no change.
    """
    if len(codes) < MIN_FIELD:
        return
    rows = [state.setdefault(c, [K.ELO_START, 0, None, None]) for c in codes]
    r = np.array([x[0] for x in rows])
    days = np.array([(when - x[3]).days if when and x[3] else 0 for x in rows])
    r = np.where(days > 0, K.ELO_START + 0.5 ** (np.maximum(days, 0) / elo.half_life) * (r - K.ELO_START), r)
    placed = np.sort(ranks)
    behind = len(ranks) - (np.searchsorted(placed, ranks, "left") + np.searchsorted(placed, ranks, "right")) / 2  # one's own half win is expected
    surprise = behind - expected_wins(r * (math.log(10) / K.ELO_SCALE), OPPONENTS)
    k = np.array([K.ELO_K_NEW if x[1] < K.ELO_NEW_RACES else elo.k for x in rows])
    for x, new in zip(rows, r + k * surprise / (len(codes) - 1), strict=True):
        x[:] = [float(new), x[1] + 1, race_id, when]


def _by_race(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple]:
    """(key, race_id, rows) of sorted batches; a race may span batches."""
    held: list[pd.DataFrame] = []  # of the race that the last batch ended in
    last = None

    def whole() -> tuple:
        race = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
        held.clear()
        return race[key].iloc[0], race.race_id.iloc[0], race

    for b in batches:
        if not len(b):
            continue
        groups, races = b[key].fillna("").to_numpy(), b.race_id.to_numpy()
        new = np.ones(len(b), bool)
        new[0] = (groups[0], races[0]) != last
        new[1:] = (groups[1:] != groups[:-1]) | (races[1:] != races[:-1])
        last = groups[-1], races[-1]
        ends = [*np.flatnonzero(new), len(b)]
        if ends[0]:
            held.append(b.iloc[: ends[0]])
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            if held:
                yield whole()
            held.append(b.iloc[lo:hi])
    if held:
        yield whole()


def _rated_rows(races: DataFrame, results: DataFrame) -> DataFrame:
    r = finished_races(races, results).select("race_id", "race_date", K.pool(F.col("gender"), F.col("kind")).alias("pool"))
    rows = results.where(counted_as_ok(F.col("status"))).select("race_id", "fis_code", "rank").join(r, "race_id")
    return rows.select("pool", "race_id", "race_date", "fis_code", F.col("rank").cast("double").alias("rank")).repartition("pool").sortWithinPartitions("pool", F.col("race_date").asc_nulls_first(), "race_id", "rank", "fis_code")


def _day(x) -> date | None:
    return None if pd.isna(x) else x


def elo_ratings(races: DataFrame, results: DataFrame, elo: Elo = Elo()) -> DataFrame:
    """fis_code, pool, rating, n_races, last_race_id, last_date after all races, oldest first."""

    def fold(batches):
        pool, state = None, {}

        def out():
            every = iter(state.items())
            while some := list(islice(every, ROWS)):
                yield pd.DataFrame([(c, pool, *x) for c, x in some], columns=["fis_code", "pool", "rating", "n_races", "last_race_id", "last_date"])

        for p, race, rows in _by_race(batches, "pool"):
            if p != pool:
                yield from out()
                pool, state = p, {}
            ranked = rows[rows["rank"].notna()]
            update_race(state, ranked.fis_code.tolist(), ranked["rank"].to_numpy(), _day(rows.race_date.iloc[0]), race, elo)
        yield from out()

    return _rated_rows(races, results).mapInPandas(fold, "fis_code string, pool string, rating double, n_races int, last_race_id string, last_date date")


def ratings_before(races: DataFrame, results: DataFrame, elo: Elo = Elo()) -> DataFrame:
    """race_id, pool, fis_code, rank, rating and n_races that each had just before the race, decayed to its date."""

    def fold(batches):
        pool, state = None, {}
        for p, race, rows in _by_race(batches, "pool"):
            if p != pool:
                pool, state = p, {}
            when = _day(rows.race_date.iloc[0])
            before = []
            for c in rows.fis_code:
                r, n, _, last = state.get(c, (K.ELO_START, 0, None, None))
                days = (when - last).days if when and last else 0
                before.append((K.ELO_START + 0.5 ** (days / elo.half_life) * (r - K.ELO_START) if days > 0 else r, n))
            yield pd.DataFrame({"race_id": rows.race_id, "pool": rows["pool"], "fis_code": rows.fis_code, "rank": rows["rank"], "rating": [b[0] for b in before], "n_races": [b[1] for b in before]})
            ranked = rows[rows["rank"].notna()]
            update_race(state, ranked.fis_code.tolist(), ranked["rank"].to_numpy(), when, race, elo)

    return _rated_rows(races, results).mapInPandas(fold, "race_id string, pool string, fis_code string, rank double, rating double, n_races int")


def rating_history(races: DataFrame, results: DataFrame, elo: Elo = Elo()) -> DataFrame:
    """pool, race_id, race_date, fis_code, rating, n_races of each ranked starter just after each race that counts."""

    def fold(batches):
        pool, state = None, {}
        for p, race, rows in _by_race(batches, "pool"):
            if p != pool:
                pool, state = p, {}
            ranked, when = rows[rows["rank"].notna()], _day(rows.race_date.iloc[0])
            if len(ranked) >= MIN_FIELD:
                codes = ranked.fis_code.tolist()
                update_race(state, codes, ranked["rank"].to_numpy(), when, race, elo)
                yield pd.DataFrame({"pool": p, "race_id": race, "race_date": when, "fis_code": codes, "rating": [state[c][0] for c in codes], "n_races": [state[c][1] for c in codes]})

    return _rated_rows(races, results).mapInPandas(fold, "pool string, race_id string, race_date date, fis_code string, rating double, n_races int")


def ratings_as_of(history: DataFrame, asked: DataFrame, elo: Elo = Elo()) -> DataFrame:
    """``asked`` (pool, fis_code, day and any other columns) with the rating and n_races that each had before that day.

    The last of the athlete's rows in the pool's history whose race was earlier; races of the day itself don't count.
    It is decayed to the day; who has none begins at the start, with no races. One shuffle by athlete and pool: no row
    of the history meets another. A null day asks for nothing and gets the start; undated races count as the earliest.
    """
    known = F.struct("rating", "n_races", F.col("race_date").alias("last_date"))
    rows = history.select("pool", "fis_code", F.col("race_date").alias("day"), F.col("race_id").alias("_race"), known.alias("_known"), F.lit(1).alias("_turn"))
    asks = asked.select("pool", "fis_code", "day", F.struct(*asked.columns).alias("_asked"), F.when(F.col("day").isNull(), -1).otherwise(0).alias("_turn"))
    order = Window.partitionBy("pool", "fis_code").orderBy(F.col("day").asc_nulls_first(), "_turn", "_race").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.unionByName(asks, allowMissingColumns=True).withColumn("_last", F.last("_known", ignorenulls=True).over(order)).where("_asked IS NOT NULL")
    days = F.coalesce(F.datediff("day", "_last.last_date"), F.lit(0))
    rating = F.coalesce(K.decayed(F.col("_last.rating"), days, elo.half_life), F.lit(K.ELO_START))
    return both.select("_asked.*", rating.alias("rating"), F.coalesce("_last.n_races", F.lit(0)).alias("n_races"))


def standings(perf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the strength of fields is made of.

    races: race_id, world_cup, n_starters, n_anchors, usable. parts: race_id, past_race, share: an anchor's standing is the
    mean, over its last twelve usable performances before the race, of the past race's strength times
    (1 - percentile); ``share`` adds these up for the race's anchors and each past race, over the number of anchors.
    """
    order = Window.partitionBy("fis_code").orderBy("race_date", "race_id")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = perf.select("race_id", "race_date", "world_cup", "fis_code", "pct")
    rows = rows.withColumn("anchor", F.coalesce(F.sum(F.col("world_cup").cast("int")).over(earlier), F.lit(0)) >= K.ANCHOR_STARTS)
    races = rows.groupBy("race_id", "world_cup").agg(F.count("*").cast("int").alias("n_starters"), F.count_if("anchor").cast("int").alias("n_anchors"))
    races = races.withColumn("usable", F.col("world_cup") | (F.col("n_anchors") >= K.MIN_ANCHORS))
    rows = rows.join(races.select("race_id", "n_anchors", "usable"), "race_id").withColumn("used", F.col("usable").cast("int"))
    rows = rows.withColumns({"before": F.coalesce(F.sum("used").over(earlier), F.lit(0)), "number": F.sum("used").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    asked = rows.where("anchor AND before > 0").withColumn("k", F.least("before", F.lit(K.STANDING_RACES)))
    asked = asked.select("race_id", "fis_code", "n_anchors", "k", F.explode(F.sequence(F.col("before") - F.col("k") + 1, F.col("before"))).alias("number"))
    past = rows.where("usable").select("fis_code", "number", F.col("race_id").alias("past_race"), (1 - F.col("pct")).alias("ahead"))
    parts = asked.join(past, ["fis_code", "number"]).groupBy("race_id", "past_race").agg(F.sum(F.col("ahead") / F.col("k") / F.col("n_anchors")).alias("share"))
    return races, parts


def field_strength(perf: DataFrame, *, exact: float = 1e-12, together: int = 5) -> DataFrame:
    """race_id, n_anchors, n_starters, anchor_quality, strength, usable of every race.

    World Cup races have strength 1. In others, anchors are starters with five World Cup starts in
    earlier races (by date and race_id); a standing is 1 less the mean of an athlete's last
    twelve adjusted percentiles. A race that is unusable leaves no trace.

    Strengths hang on those of earlier races, linearly up to 1. They are computed for all races at once
    from those of the round before, until none moves by more than ``exact``: what a round gets wrong counts less than half in
    the next, so the rounds are few, whatever the number of races. ``together`` rounds are one job.
    """
    races, parts = (settled(x, "strength") for x in standings(perf))
    depth = F.when(F.col("n_anchors") > 0, F.least(F.lit(1.0), F.log1p(F.col("n_anchors").cast("double")) / math.log1p(K.FULL_ANCHORS))).otherwise(0.0)
    fixed = races.where("world_cup").select(F.col("race_id").alias("past_race"))
    graded = races.where("usable AND NOT world_cup").withColumn("depth", depth).select("race_id", "depth")
    base = parts.join(fixed, "past_race").groupBy("race_id").agg(F.sum("share").alias("base"))
    graded = settled(graded.join(base, "race_id", "left").fillna(0.0, ["base"]), "strength")
    links = settled(parts.join(graded.select("race_id"), "race_id").join(graded.select(F.col("race_id").alias("past_race")), "past_race"), "strength")
    strength = graded.select("race_id", F.lit(1.0).alias("strength"))
    while True:
        now = strength
        for _ in range(together):
            sums = links.join(now.withColumnRenamed("race_id", "past_race"), "past_race").groupBy("race_id").agg(F.sum(F.col("share") * F.col("strength")).alias("more"))
            last, now = now, graded.join(sums, "race_id", "left").select("race_id", F.least(F.lit(1.0), F.col("depth") * (F.col("base") + F.coalesce("more", F.lit(0.0)))).alias("strength"))
        moved = now.join(last.withColumnRenamed("strength", "last"), "race_id")
        strength = settled(moved, "strength")
        most = strength.agg(F.max(F.abs(F.col("strength") - F.col("last")))).first()[0]
        strength = strength.drop("last")
        if most is None or most <= exact:
            break
    known = fixed.select("past_race", F.lit(1.0).alias("past")).unionByName(strength.select(F.col("race_id").alias("past_race"), F.col("strength").alias("past")))
    quality = parts.join(known, "past_race").groupBy("race_id").agg(F.sum(F.col("share") * F.col("past")).alias("anchor_quality"))
    out = races.join(quality, "race_id", "left").join(strength, "race_id", "left")
    value = F.when(F.col("world_cup"), 1.0).when(F.col("usable"), F.col("strength")).otherwise(0.0)
    return out.select("race_id", "n_anchors", "n_starters", F.coalesce("anchor_quality", F.lit(0.0)).alias("anchor_quality"), value.alias("strength"), "usable")
