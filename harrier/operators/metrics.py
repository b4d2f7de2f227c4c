"""How well scores order a race: pairs, correlations, comparisons of methods."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import ELO_SCALE, hash_uniform
from . import sums


def baseline_scores(samples: DataFrame, seed: int = 0) -> DataFrame:
    """method, race_id, fis_code, pos, score of the baselines, from one pass over the samples."""
    methods = F.array(*[F.struct(F.lit(m).alias("method"), c.cast("double").alias("score")) for m, c in (
        ("random", hash_uniform(F.lit(str(seed)), F.col("race_id"), F.col("fis_code"))),
        ("fis_points", F.col("fis_points")),
        ("recent_form", F.col("overall_form")),
        ("similar_form", F.col("similar_form")),
    )])
    return samples.select("race_id", "fis_code", "pos", F.explode(methods).alias("x")).select("x.method", "race_id", "fis_code", "pos", "x.score")


#: Scores a race's starters: of samples to race_id, fis_code, pos and score. A race without rows is declined.
Scorer = Callable[[DataFrame], DataFrame]


def compare(samples: DataFrame, scorers: dict[str, Scorer], seed: int = 0) -> DataFrame:
    """The baselines and anybody's scorers on the same samples: method, races, pairs, correct, accuracy, skipped.

    A scorer that gives a score for only some starters of a race is compared on these; null scores are none.
    """
    scores = baseline_scores(samples, seed)
    for name, scorer in scorers.items():
        scores = scores.unionByName(scorer(samples).select(F.lit(name).alias("method"), "race_id", "fis_code", "pos", F.col("score").cast("double").alias("score")))
    return pair_accuracy(scores.where("score IS NOT NULL"), samples)


def elo_scores(samples: DataFrame, ratings: DataFrame) -> DataFrame:
    """Ratings as scores: an unknown athlete has the mean of the known; races with fewer than two known are declined."""
    race = Window.partitionBy("race_id")
    s = samples.select("race_id", "fis_code", "pos").join(ratings.select("race_id", "fis_code", F.when(F.col("n_races") > 0, F.col("rating")).alias("rating")), ["race_id", "fis_code"], "left")
    s = s.withColumns({"known": F.count("rating").over(race), "mean": F.avg("rating").over(race)}).where("known >= 2")
    return s.select(F.lit("elo").alias("method"), "race_id", "fis_code", "pos", F.coalesce("rating", "mean").alias("score"))


#: Starters of a race that are one task's rows, and are paired with as many others there.
PAIR_BLOCK = 1 << 16


def pair_sums(rows: DataFrame, *by: str, losses: bool, ranks: bool = False) -> DataFrame:
    """``by``, pairs, correct, loss: of all pairs in a race, the one ahead by ``at`` (from 0) first; whether its score is higher, with ties half,
    and with ``losses`` the log loss of the difference.

    With ``ranks``, a pair counts as ahead if the first one's rank is less; those of equal rank are right unless the
    first one's score is higher, and their loss is that of the second one's margin. Then equal scores of others are wrong.

    No pair is made (``sums``). A race's starters lie in blocks of ``at``, every two blocks are a group, and a row goes to as many
    groups as there are blocks: one, if ``at`` stays below ``PAIR_BLOCK``. Only races with more blocks are told to the tasks, so rows
    are dealt and sorted once, by group. ``at`` needs no row number: any whole numbers that differ within a race and aren't far apart will do.
    """
    more = ["rank"] if ranks else []
    rows = rows.dropna(subset=[*by]).select(*by, "at", "score", *more, F.expr(f"at div {PAIR_BLOCK}").alias("own"))
    several = rows.where("own <> 0").select(*by, F.explode(F.array(F.lit(0).cast("bigint"), "own")).alias("other")).distinct()
    dealt = rows.join(F.broadcast(several), [*by], "left").withColumn("other", F.coalesce("other", "own"))
    dealt = dealt.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other")

    def inside(x: np.ndarray) -> np.ndarray:
        return np.array([*sums.higher_before(x), sums.losses_before(x) if losses else 0.0])

    def across(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.array([*sums.higher_across(x, y), sums.losses_across(x, y) if losses else 0.0])

    def of_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        left, right = group[group.own == group.a], group[group.own == group.b]
        one = group.a.iloc[0] == group.b.iloc[0]
        x, y = left.score.to_numpy(), right.score.to_numpy()
        pairs = len(x) * (len(x) - 1) // 2 if one else len(x) * len(y)
        higher, equal, loss = inside(x) if one else across(x, y)
        if ranks:
            correct = higher
            for i, j in _of_equal_rank(left["rank"].to_numpy(), right["rank"].to_numpy(), one):
                n = (i.stop - i.start) * (i.stop - i.start - 1) // 2 if one else (i.stop - i.start) * (j.stop - j.start)
                ahead = inside(x[i]) if one else across(x[i], y[j])
                behind = inside(x[i][::-1]) if one else across(y[j], x[i])
                correct += n - 2 * ahead[0]
                loss += behind[2] - ahead[2]
        else:
            correct = higher + equal / 2
        return pd.DataFrame({**{c: [group[c].iloc[0]] for c in by}, "pairs": [pairs], "correct": [float(correct)], "loss": [float(loss)]})

    found = dealt.groupBy(*by, "a", "b").applyInPandas(of_group, "".join(f"{c} string, " for c in by) + "pairs long, correct double, loss double")
    return found.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("pairs", "correct", "loss")]).where("pairs > 0")


def _of_equal_rank(left: np.ndarray, right: np.ndarray, one: bool) -> list[tuple[slice, slice]]:
    """Stretches of equal ranks in a block, or in a block and a later one; ranks don't fall."""
    if not one:
        if left[-1] != right[0]:
            return []
        return [(slice(int(np.searchsorted(left, right[0])), len(left)), slice(0, int(np.searchsorted(right, right[0], "right"))))]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(left)) + 1, [len(left)]])
    return [(slice(lo, hi), slice(lo, hi)) for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if hi - lo > 1]


def race_pairs(scores: DataFrame) -> DataFrame:
    """method, race_id, pairs, correct: of all pairs in a race, who is ahead has the higher score; ties are half."""
    rows = scores.select("method", "race_id", F.col("score").cast("double").alias("score"), F.col("pos").alias("at"))
    return pair_sums(rows, "method", "race_id", losses=False).drop("loss")


def pair_accuracy(scores: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """method, races, pairs, correct, accuracy; and with ``samples`` skipped, the number of its races that a method declined."""
    out = race_pairs(scores).groupBy("method").agg(F.count("*").alias("races"), F.sum("pairs").alias("pairs"), F.sum("correct").alias("correct"), F.round(F.sum("correct") / F.sum("pairs"), 4).alias("accuracy"))
    if samples is None:
        return out
    asked = samples.select("race_id").distinct().count()
    answered = scores.groupBy("method").agg(F.countDistinct("race_id").alias("answered"))
    return out.join(answered, "method").withColumn("skipped", F.lit(asked) - F.col("answered")).drop("answered")


def format_comparison(table: DataFrame, methods: tuple[str, ...] = ()) -> str:
    """The few methods of a comparison as text, the worst first; those of ``methods`` that compared nothing have no data."""
    rows = table.orderBy("accuracy", "method").collect()
    head = f"{'method':<14}{'accuracy':>9}{'pairs':>10}{'races':>7}{'skipped':>9}"
    none = [f"{m:<14}{'no data':>9}" for m in methods if m not in {r.method for r in rows}]
    return "\n".join([head, *none, *(f"{r.method:<14}{r.accuracy:>9.4f}{r.pairs:>10,}{r.races:>7}{r.skipped:>9}" for r in rows)])


def ranker_metrics(scores: DataFrame) -> DataFrame:
    """Pair accuracy and log loss of a ranker's margins."""
    rows = scores.select("race_id", F.col("score").cast("double").alias("score"), F.col("pos").alias("at"))
    total = pair_sums(rows, "race_id", losses=True)
    return total.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), (F.sum("correct") / F.sum("pairs")).alias("accuracy"), (F.sum("loss") / F.sum("pairs")).alias("log_loss"))


def rank_correlation(ranked: DataFrame) -> DataFrame:
    """race_id, spearman: 1 - 6 sum d^2 / (n (n^2 - 1)) of predicted and actual ranks; null for one athlete."""
    n = F.col("n").cast("double")
    g = ranked.groupBy("race_id").agg(F.count("*").alias("n"), F.sum(F.pow(F.col("predicted") - F.col("actual"), 2)).alias("d2"))
    return g.select("race_id", F.when(F.col("n") > 1, 1 - 6 * F.col("d2") / (n * (n * n - 1))).alias("spearman"))


def predicted_ranks(scores: DataFrame) -> DataFrame:
    """race_id, fis_code, score, predicted (ties by place), actual."""
    w = Window.partitionBy("race_id")
    return scores.select("race_id", "fis_code", "score", F.row_number().over(w.orderBy(F.desc("score"), "pos")).alias("predicted"), F.row_number().over(w.orderBy("pos")).alias("actual"))


def backtest(before: DataFrame, min_rated: int = 10) -> DataFrame:
    """One row: the Elo ratings before each race against its order.

    A race counts if it has three ranked and ``min_rated`` that raced before; only those are
    compared. Races with too few of these are skipped. mean_spearman is the correlation of minus the rating with the rank.
    """
    race = Window.partitionBy("race_id")
    ranked = before.where("rank IS NOT NULL").withColumn("ranked", F.count("*").over(race)).where("ranked >= 3")
    ranked_races = ranked.select("race_id").distinct()
    rated = ranked.where("n_races > 0").withColumn("rated", F.count("*").over(race)).where(F.col("rated") >= min_rated)
    rated = rated.withColumn("place", F.row_number().over(race.orderBy("rank", "fis_code")))
    margin = (F.col("rating") * (math.log(10) / ELO_SCALE)).alias("score")
    pairs = pair_sums(rated.select("race_id", margin, "rank", (F.col("place") - 1).alias("at")), "race_id", losses=True, ranks=True)
    n, x, y = F.count("*"), -F.col("rating"), F.col("rank")
    cov = F.sum(x * y) - F.sum(x) * F.sum(y) / n
    var = lambda z: F.greatest(F.lit(0.0), F.sum(z * z) - F.sum(z) * F.sum(z) / n)
    rho = rated.groupBy("race_id").agg(F.try_divide(cov, F.sqrt(var(x) * var(y))).alias("rho"), F.max_by(F.col("place"), F.struct(F.col("rating"), -F.col("place"))).alias("x"))
    winner = rated.withColumn("by_rating", F.row_number().over(race.orderBy(F.desc("rating"), "place"))).where("place = 1").select("race_id", (F.col("by_rating") <= 3).cast("double").alias("top3"))
    every = ranked_races.join(pairs, "race_id", "left").join(rho, "race_id", "left").join(winner, "race_id", "left")
    return every.agg(
        F.count("pairs").alias("races"), F.count_if(F.col("pairs").isNull()).alias("skipped"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), (F.sum("correct") / F.sum("pairs")).alias("pair_accuracy"), (F.sum("loss") / F.sum("pairs")).alias("log_loss"), F.avg("rho").alias("mean_spearman"), F.avg("top3").alias("winner_top3")
    )
