"""Features of each athlete in each race, from strictly earlier dates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.scratch import settled
from .results import chosen

MIN_RATEABLE, RECENT_DAYS, MOST_POINTS, MOST_MARGIN = 6, 90, 300.0, 3.0
UNKNOWN = 0.5
#: Past performances of an athlete that are joined to each target at most.
JOINED = 512
#: The day from which powers of time are counted, 2000-01-01; from 1500 to 2400 they are numbers.
DAY_0 = 10957


def history(targets: DataFrame, past: DataFrame) -> DataFrame:
    """Each target (race_id, fis_code, race_date, kind, technique, length_km) with every earlier
    performance of its athlete: an equi-join on the athlete, the date decides beside it. The
    weight is the product of the kernels; rows without weight go."""
    p = past.select("fis_code", *[F.col(c).alias(f"p_{c}") for c in ("race_id", "race_date", "kind", "technique", "length_km", "pct", "fis_points", "margin")])
    rows = targets.select("race_id", "fis_code", "race_date", "kind", "technique", "length_km").join(p, "fis_code").where("p_race_date < race_date")
    recency = K.recency(F.col("race_date"), F.col("p_race_date"))
    length = K.length_similarity(K.target_length(F.col("kind"), F.col("length_km")), K.history_length(F.col("p_kind"), F.col("p_length_km")))
    w = K.technique_similarity(F.col("technique"), F.col("p_technique")) * K.kind_similarity(F.col("kind"), F.col("p_kind")) * length * recency
    return rows.withColumns({"recency": recency, "w": w})


SUMS = ("sw", "swx", "swxx", "sr", "srx", "recent", "points", "sm", "smx", "best")


def _sums_joined(targets: DataFrame, past: DataFrame) -> DataFrame:
    """race_id, fis_code and SUMS of each target, from its joined history.

    The joined rows are sorted once, by target and percentile. The weighted quantile comes from a running sum in that
    order, and the sums are taken as the sorted rows pass by: no list of a target's history is made.
    """
    w, x, m = F.col("w"), F.col("p_pct"), F.col("m")
    with_points = F.when(F.col("p_fis_points") > 0, F.struct("p_race_date", "p_race_id", F.col("p_fis_points").alias("points")))
    recent = F.when(F.datediff("race_date", "p_race_date") <= RECENT_DAYS, 1).otherwise(0)
    rows = history(targets, past).select("fis_code", "race_id", "w", "recency", "p_pct", recent.alias("recent"), with_points.alias("last"), F.least("p_margin", F.lit(MOST_MARGIN)).alias("m"), F.col("p_margin").isNotNull().alias("with_margin"))
    target = Window.partitionBy("fis_code", "race_id")
    rows = rows.withColumn("reached", F.sum("w").over(target.orderBy("p_pct", "w").rowsBetween(Window.unboundedPreceding, 0)) >= 0.2 * F.sum("w").over(target) - 1e-12)
    g = rows.groupBy("fis_code", "race_id").agg(
        F.sum("w").alias("sw"),
        F.sum(w * x).alias("swx"),
        F.sum(w * x * x).alias("swxx"),
        F.sum("recency").alias("sr"),
        F.sum(F.col("recency") * x).alias("srx"),
        F.sum("recent").alias("recent"),
        F.max("last").alias("last"),
        F.sum(F.when(F.col("with_margin"), w)).alias("sm"),
        F.sum(F.when(F.col("with_margin"), w * m)).alias("smx"),
        F.coalesce(F.min(F.when((w > 0) & F.col("reached"), x)), F.max(F.when(w > 0, x))).alias("best"),
    )
    return g.select("race_id", "fis_code", *[F.col("last.points").alias("points") if c == "points" else F.col(c) for c in SUMS])


def _sums_by_prefixes(targets: DataFrame, past: DataFrame) -> DataFrame:
    """The same without a row for each target and past performance.

    Recency is a power of time, so with each performance worth 2^(day / half-life) a sum over a target's past is a running sum times
    a power of its own. A similarity hangs on technique, kind and length only, so there is one running sum for
    each of the athlete's classes of these, and a target takes each times its similarity. The weighted quantile is
    found bit by bit: the athlete's percentiles are numbered in order, and of the numbers that a target may still have, the running
    sum of those without the next bit tells whether its quantile is among them. That is n rows for each class and bit.
    """
    power = lambda day, sign: F.pow(F.lit(2.0), sign * (day - DAY_0) / K.HALF_LIFE)
    kinds = ["technique", "kind", "length"]
    p = past.where(F.col("race_date").isNotNull()).select(
        "fis_code", "race_id", "race_date", "pct", "fis_points", F.when(F.col("margin").isNotNull(), F.least("margin", F.lit(MOST_MARGIN))).alias("m"), F.unix_date("race_date").alias("day"),
        "technique", "kind", K.history_length(F.col("kind"), F.col("length_km")).alias("length"),
    )
    number = F.dense_rank().over(Window.partitionBy("fis_code").orderBy("pct")) - 1
    p = settled(p.withColumns({"class": F.xxhash64(*kinds), "e": power(F.col("day"), 1), "number": number}), "history")
    classes = p.select("fis_code", "class", *[F.col(c).alias(f"p_{c}") for c in kinds]).distinct()
    asks = targets.where(F.col("race_date").isNotNull()).select("race_id", "fis_code", F.unix_date("race_date").alias("day"), "technique", "kind", K.target_length(F.col("kind"), F.col("length_km")).alias("length")).join(classes, "fis_code")
    alike = K.technique_similarity(F.col("technique"), F.col("p_technique")) * K.kind_similarity(F.col("kind"), F.col("p_kind")) * K.length_similarity(F.col("length"), F.col("p_length"))
    asks = settled(asks.select("race_id", "fis_code", "class", "day", power(F.col("day"), -1).alias("since"), alike.alias("alike")), "history")

    def before(rows: DataFrame, asked: DataFrame, by: list[str], sums: dict[str, Column], days: int | None = None) -> DataFrame:
        """``asked`` with each of ``sums`` over the rows of the same athlete, class and ``by`` that are days earlier."""
        known = rows.select("fis_code", "class", *by, "day", *[c.alias(n) for n, c in sums.items()])
        both = known.unionByName(asked.withColumn("asked", F.lit(True)), allowMissingColumns=True)
        frame = Window.partitionBy("fis_code", "class", *by).orderBy("day").rangeBetween(Window.unboundedPreceding if days is None else -days, -1)
        return both.withColumns({n: (F.max(n) if n == "last" else F.sum(n)).over(frame) for n in sums}).where("asked").drop("asked")

    e, x, m = F.col("e"), F.col("pct"), F.col("m")
    with_points = F.when(F.col("fis_points") > 0, F.struct("race_date", "race_id", F.col("fis_points").alias("points")))
    sums = {"se": e, "sex": e * x, "sexx": e * x * x, "sem": F.when(m.isNotNull(), e), "semx": e * m, "last": with_points}
    got = before(p, asks, [], sums)
    recent = before(p, asks, [], {"recent": F.lit(1)}, RECENT_DAYS).select("race_id", "fis_code", "class", "recent")
    w = F.col("alike") * F.col("since")
    total = lambda c, by=w: F.sum(by * F.coalesce(F.col(c), F.lit(0.0)))
    since = F.col("since")
    got = got.groupBy("fis_code", "race_id").agg(
        total("se").alias("sw"), total("sex").alias("swx"), total("sexx").alias("swxx"), total("se", since).alias("sr"), total("sex", since).alias("srx"), F.max("last").alias("last"), total("sem").alias("sm"), total("semx").alias("smx")
    )
    got = got.join(recent.groupBy("fis_code", "race_id").agg(F.coalesce(F.sum("recent"), F.lit(0)).alias("recent")), ["fis_code", "race_id"]).where("sw > 0")
    got = settled(got, "history")

    bits = int(p.agg(F.max("number")).first()[0] or 0).bit_length()
    state = got.select("fis_code", "race_id", (0.2 * F.col("sw") - 1e-12).alias("wanted"), F.lit(0).alias("node"), F.lit(0.0).alias("have"))
    for bit in reversed(range(bits)):
        rows = p.where(F.shiftright("number", bit).bitwiseAND(1) == 0).withColumn("node", F.shiftright("number", bit + 1))
        left = before(rows, asks.join(state.select("fis_code", "race_id", "node"), ["fis_code", "race_id"]), ["node"], {"se": e})
        left = left.groupBy("fis_code", "race_id").agg(total("se").alias("left"))
        reached = F.col("have") + F.col("left") >= F.col("wanted")
        state = settled(state.join(left, ["fis_code", "race_id"]).select("fis_code", "race_id", "wanted", (2 * F.col("node") + F.when(reached, 0).otherwise(1)).alias("node"), (F.col("have") + F.when(reached, 0.0).otherwise(F.col("left"))).alias("have")), "history")
    values = p.select("fis_code", F.col("number").alias("node"), F.col("pct").alias("best")).distinct()
    return got.join(state.select("fis_code", "race_id", "node").join(values, ["fis_code", "node"]), ["fis_code", "race_id"]).select("race_id", "fis_code", *[F.col("last.points").alias("points") if c == "points" else F.col(c) for c in SUMS])


def features(targets: DataFrame, past: DataFrame, *, joined: int = JOINED) -> DataFrame:
    """The eleven features; a target without weighted history has no row.

    Athletes with at most ``joined`` past performances have these joined to their targets: one shuffle by athlete for
    the join and one by (race, athlete) for all aggregates. Those with more, for whom that would be the square of a
    long list, are summed up by prefixes. Both give the same.
    """
    many = past.groupBy("fis_code").agg(F.count("*").alias("n")).where(F.col("n") > joined).select("fis_code")
    if many.isEmpty():
        g = _sums_joined(targets, past)
    else:
        many = settled(many, "history")
        of = lambda df, how: df.join(many, "fis_code", how)
        g = _sums_joined(of(targets, "left_anti"), of(past, "left_anti")).unionByName(_sums_by_prefixes(of(targets, "left_semi"), of(past, "left_semi")))
    g = g.where("sw > 0")
    mean, overall, best = F.col("swx") / F.col("sw"), F.col("srx") / F.col("sr"), F.col("best")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("swxx") / F.col("sw") - mean * mean))
    has_points, has_margin = F.col("points").isNotNull(), F.coalesce(F.col("sm"), F.lit(0.0)) > 0
    return g.select(
        "race_id",
        "fis_code",
        (1 - mean).alias("similar_form"),
        (1 - best).alias("similar_best"),
        (1 - overall).alias("overall_form"),
        (overall - mean).alias("specificity"),
        F.log1p("sw").alias("experience"),
        F.log1p(F.col("recent").cast("double")).alias("recent_starts"),
        F.when(has_points, 1 - F.least(F.col("points"), F.lit(MOST_POINTS)) / MOST_POINTS).otherwise(UNKNOWN).alias("fis_points"),
        has_points.cast("double").alias("has_fis_points"),
        (1 - F.least(F.lit(1.0), sd)).alias("consistency"),
        F.when(has_margin, 1 - F.least(F.lit(1.0), F.col("smx") / F.when(has_margin, F.col("sm")) / MOST_MARGIN)).otherwise(UNKNOWN).alias("similar_margin"),
        has_margin.cast("double").alias("has_margin"),
    )


def samples(perf: DataFrame, strength: DataFrame | None = None, *, other_series: bool = True, world_cup_only: bool = True, min_rateable: int = MIN_RATEABLE) -> DataFrame:
    """Features of the finishers of each race that has ``min_rateable`` athletes with a history.

    ``strength`` (race_id, strength, usable) grades races that aren't World Cup races; unusable ones are
    neither samples nor history. Percentiles and margins of the others are adjusted by it.

    What the steps share is settled, the graded performances and the rated rows: they are made once, however often they and the
    samples are read, and no task sorts for several steps at a time.
    """
    one = F.lit(1.0)
    if strength is None or not other_series:
        graded = perf.where("world_cup").withColumn("strength", one)
    else:
        graded = perf.join(strength.where("usable").select("race_id", F.col("strength").alias("graded")), "race_id", "left")
        graded = graded.where("world_cup OR graded IS NOT NULL").withColumn("strength", F.when(F.col("world_cup"), one).otherwise(F.col("graded"))).drop("graded")
    graded = settled(graded.select("race_id", "fis_code", "race_date", "season", "kind", "technique", "length_km", "rank", "fis_points", "pos", "pct", "margin", "world_cup", "strength"), "graded")
    past = graded.withColumns({"pct": K.adjusted_percentile(F.col("pct"), F.col("strength")), "margin": K.discounted_margin(F.col("margin"), F.col("strength"))})
    targets = graded.where("rank IS NOT NULL")
    if world_cup_only:
        targets = targets.where("world_cup")
    rated = features(targets, past).join(targets.select("race_id", "fis_code", "race_date", "season", "pos", F.col("fis_points").alias("in_race_points")), ["race_id", "fis_code"])
    rated = settled(rated, "rated")
    enough = rated.groupBy("race_id").agg(F.count("*").alias("rateable")).where(F.col("rateable") >= min_rateable).select("race_id")
    return rated.join(enough, "race_id")


def reader_features(targets: DataFrame, perf: DataFrame, **choice) -> DataFrame:
    """Features of ``targets`` from the part of the history that a reader has chosen (``chosen``'s parameters).

    Unranked performances are no history here, neither percentiles nor margins are graded, and points are always unknown:
    exported careers don't carry them. A target none of whose history is chosen has no row.
    """
    return features(targets, chosen(perf, **choice).withColumn("fis_points", F.lit(None).cast("double")))
