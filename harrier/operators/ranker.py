"""A pairwise logistic ranker on standardised features."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FEATURES
from ..sources.scratch import settled
from .together import Together

PAIRS_PER_RACE = 600


@dataclass
class Ranker:
    weights: list[float]
    mean: list[float]
    std: list[float]
    bias: float = 0.0
    names: list[str] = field(default_factory=lambda: list(FEATURES))
    races: int = 0
    pairs: int = 0

    def score(self) -> Column:
        """As one expression over the feature columns."""
        terms = [(F.col(n) - m) / s * w for n, m, s, w in zip(self.names, self.mean, self.std, self.weights, strict=True)]
        return reduce(lambda a, b: a + b, terms, F.lit(self.bias))

    def explain(self) -> list[tuple[str, float]]:
        return sorted(zip(self.names, self.weights, strict=True), key=lambda x: -abs(x[1]))

    def to_json(self) -> str:
        rounded = {k: [round(x, 6) for x in v] if k in ("weights", "mean", "std") else v for k, v in asdict(self).items()}
        return json.dumps({"kind": "pairwise-logistic", "version": 1, **rounded}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Ranker:
        """Keys that are absent have their defaults."""
        got = json.loads(text)
        n = len(got["weights"])
        return cls(got["weights"], got.get("mean", [0.0] * n), got.get("std", [1.0] * n), got.get("bias", 0.0), got.get("names", list(FEATURES)[:n]), got.get("races", 0), got.get("pairs", 0))


def sampled_pairs(samples: DataFrame, seed: int = 0, most: int = PAIRS_PER_RACE) -> DataFrame:
    """race_id, i, j, ahead, behind: of each race all pairs, or ``most`` of them.

    A race's pairs are numbered and the numbers dealt to ``most`` stretches of equal length, of each of which
    one is drawn by a hash. No other pair is made.
    """
    race = Window.partitionBy("race_id")
    x = F.array(*[F.col(n) for n in FEATURES])
    rows = samples.select("race_id", "pos", x.alias("x")).withColumn("at", F.row_number().over(race.orderBy("pos")) - 1)
    races = rows.groupBy("race_id").agg(F.count("*").alias("n")).where("n > 1").select("race_id", F.expr("n * (n - 1) div 2").alias("pairs"))
    draws = races.withColumn("most", F.least("pairs", F.lit(most))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("most") - 1)))
    draws = draws.selectExpr("race_id", "k", "k * pairs div most AS lo", "(k + 1) * pairs div most AS hi")
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "race_id", F.col("k").cast("string"))), 1, 8), 16, 10).cast("bigint")
    number = F.col("lo") + drawn % (F.col("hi") - F.col("lo"))
    second = F.floor((1 + F.sqrt(1 + 8 * number)) / 2)  # of those before it there are second (second - 1) / 2
    draws = draws.withColumn("number", number).withColumn("b", second.cast("int")).withColumn("a", (F.col("number") - F.expr("bigint(b) * (b - 1) div 2")).cast("int"))
    first = rows.select("race_id", F.col("at").alias("a"), F.col("pos").alias("i"), F.col("x").alias("ahead"))
    other = rows.select("race_id", F.col("at").alias("b"), F.col("pos").alias("j"), F.col("x").alias("behind"))
    return draws.select("race_id", "a", "b").join(first, ["race_id", "a"]).join(other, ["race_id", "b"]).select("race_id", "i", "j", "ahead", "behind")


def fit(samples: DataFrame, *, epochs: int = 300, rate: float = 0.5, l2: float = 1e-4, seed: int = 0) -> Ranker:
    """Full-batch gradient descent from zeros, all of it in one barrier stage.

    Races are dealt to as many tasks as run at once; each packs the pairs of its races into one matrix (53 KB a race
    at most) and keeps it for all epochs. In an epoch the tasks add up their eleven sums (``Together``) and all take the
    same step, so that no epoch needs a job or a shuffle. If a task is lost the stage begins anew. Barrier stages
    need a fixed number of executors: with dynamic allocation Spark refuses them.

    Raises ValueError if no race has a pair.
    """
    samples = settled(samples.select("race_id", "pos", *FEATURES), "ranker-samples")
    stats = samples.agg(F.countDistinct("race_id").alias("races"), *[f(n).alias(f"{f.__name__}_{n}") for n in FEATURES for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([stats[f"avg_{n}"] or 0.0 for n in FEATURES])
    std = np.array([stats[f"stddev_pop_{n}"] or 0.0 for n in FEATURES])
    std = np.where(std < 1e-8, 1.0, std)

    def learn(batches):
        all_tasks = Together()
        races, parts = set(), [np.empty((0, len(std)))]
        for b in batches:
            races.update(b.column("race_id").unique().to_pylist())
            d = b.column("d")
            parts.append(d.values.to_numpy(zero_copy_only=False)[d.offsets[0].as_py() : d.offsets[-1].as_py()].reshape(-1, len(std)) / std)
        d = np.concatenate(parts)

        n, n_races = all_tasks.total(np.array([len(d), len(races)], float))
        w = np.zeros(len(std))
        for _ in range(epochs if n else 0):
            pull = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30))) - 1
            w = w - rate * (all_tasks.total(pull @ d) / n + l2 * w)
        all_tasks.close()
        if all_tasks.rank == 0:
            yield pa.RecordBatch.from_pydict({"w": [w.tolist()], "pairs": [int(n)], "races": [int(n_races)]}, schema=pa.schema([("w", pa.list_(pa.float64())), ("pairs", pa.int64()), ("races", pa.int64())]))

    spark = samples.sparkSession
    tasks = max(1, min(spark.sparkContext.defaultParallelism, stats.races))
    pairs = sampled_pairs(samples, seed).select("race_id", F.zip_with("ahead", "behind", lambda a, b: a - b).alias("d"))
    (got,) = settled(pairs, "ranker-pairs").repartition(tasks, "race_id").mapInArrow(learn, "w array<double>, pairs long, races long", barrier=True).collect()  # the first task's row
    if not got.pairs:
        raise ValueError("no race with a pair to learn from")
    return Ranker(list(got.w), mean.tolist(), std.tolist(), races=got.races, pairs=got.pairs)
