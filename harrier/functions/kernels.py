"""Scalar kernels as column expressions: similarity of races, recency, ratings, scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
TECHNIQUE_OTHER, TECHNIQUE_BOTH, KIND_OTHER, LENGTH_SIGMA, HALF_LIFE = 0.15, 0.75, 0.30, 0.75, 150.0
SPRINT_KM, DISTANCE_KM, UNKNOWN_KM = 1.5, 12.0, 8.0
ELO_START, ELO_SCALE, ELO_K, ELO_K_NEW, ELO_NEW_RACES, ELO_HALF_LIFE = 1500.0, 400.0, 200.0, 60.0, 10, 1825.0
MIN_ANCHORS, ANCHOR_STARTS, FULL_ANCHORS, STANDING_RACES, MIN_STRENGTH = 5, 5, 20, 12, 0.15


def technique_similarity(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).when((a == "CF") | (b == "CF"), TECHNIQUE_BOTH).when((a == "?") | (b == "?"), 1.0).otherwise(TECHNIQUE_OTHER)


def kind_similarity(a: Column, b: Column) -> Column:
    return F.when((a == b) | (a == "?") | (b == "?"), 1.0).otherwise(KIND_OTHER)


def length_similarity(target: Column, other: Column) -> Column:
    """Gaussian in the logarithm of the ratio; 1 where a length isn't positive."""
    return F.when((target > 0) & (other > 0), F.exp(-F.pow(F.ln(other / target), 2) / (2 * LENGTH_SIGMA**2))).otherwise(1.0)


def recency(target: Column, other: Column) -> Column:
    days = F.datediff(target, other)
    return F.when(days.isNull(), 1.0).when(days < 0, 0.0).otherwise(F.pow(F.lit(0.5), days / HALF_LIFE))


def target_length(kind: Column, length: Column) -> Column:
    return F.when(length > 0, length).when(kind == "sprint", SPRINT_KM).when(kind == "distance", DISTANCE_KM).otherwise(UNKNOWN_KM)


def history_length(kind: Column, length: Column) -> Column:
    """Unlike a target's, the length of a past race of unknown kind is taken as a distance race's."""
    return F.when(length != 0, length).when(kind == "sprint", SPRINT_KM).otherwise(DISTANCE_KM)


def adjusted_percentile(p: Column, strength: Column) -> Column:
    return 1 - F.least(F.greatest(strength, F.lit(0.0)), F.lit(1.0)) * (1 - p)


def discounted_margin(margin: Column, strength: Column) -> Column:
    return F.when(strength > 0, margin / F.greatest(strength, F.lit(MIN_STRENGTH))).otherwise(margin)


def expected_score(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / ELO_SCALE))


def decayed(rating: Column, days: Column, half_life: float = ELO_HALF_LIFE) -> Column:
    return F.when(days > 0, ELO_START + F.pow(F.lit(0.5), days / half_life) * (rating - ELO_START)).otherwise(rating)


def k_factor(n_races: Column) -> Column:
    """The lower factor is the newcomers'."""
    return F.when(n_races < ELO_NEW_RACES, ELO_K_NEW).otherwise(ELO_K)


def pool(gender: Column, kind: Column) -> Column:
    return F.concat_ws("-", F.coalesce(F.nullif(gender, F.lit("")), F.lit("?")), F.coalesce(F.nullif(kind, F.lit("")), F.lit("distance")))


def lenient_date(text: Column) -> Column:
    return F.try_to_date(F.substring(text.cast("string"), 1, 10), "yyyy-MM-dd")


def logistic(margin: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(margin, F.lit(-30.0)), F.lit(30.0))))


def hash_uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 32 bits of an md5; the same in any engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def gumbel(u: Column, spread: float = 1.0) -> Column:
    return -F.ln(-F.ln(u)) * spread


def theta(rating: Column) -> Column:
    return rating * (math.log(10) / ELO_SCALE)


def clock_seconds(text: Column) -> Column:
    """``1:02:03.4`` in seconds, by base 60; null if a part is no number."""
    parts = F.split(F.regexp_replace(text, r"^\+", ""), ":")
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double"))
