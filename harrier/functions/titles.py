"""What a race's title, series and signals say, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
STANDINGS = ("standings", "overall standing", "cup standing", "final standing", "total standing")
EXCLUDED = "children|youth|u16|u14"
START_TYPES = (("skiathlon", "skiathlon"), ("relay", "relay"), ("team sprint", "team_sprint"), ("pursuit", "pursuit"), ("mass start", "mass"), ("interval", "interval"), ("sprint", "sprint"))
LENGTH = r"(?:\d+\s*x\s*)?(\d+(?:\.\d+)?)\s*km"


def is_world_cup(series: Column) -> Column:
    return F.lower(F.coalesce(series, F.lit(""))).contains("world cup")


def is_excluded(series: Column) -> Column:
    return F.lower(F.coalesce(series, F.lit(""))).rlike(EXCLUDED)


def is_standings(title: Column) -> Column:
    return F.lower(F.coalesce(title, F.lit(""))).rlike("|".join(STANDINGS))


def classify_title(df: DataFrame, title: str = "title") -> DataFrame:
    """Adds gender, kind, technique, start_type, length_km and is_team of a title."""
    t = F.lower(F.coalesce(F.col(title), F.lit("")))
    classic, free = t.contains("classic"), t.contains("free") | t.contains("skating")
    start = F.lit(None).cast("string")
    for token, name in reversed(START_TYPES):
        start = F.when(t.contains(token), name).otherwise(start)
    return df.withColumns({
        "gender": F.when(t.contains("women") | t.contains("ladies"), "W").when(t.contains("mixed"), "X").when(t.contains("men"), "M"),
        "kind": F.when(t.contains("sprint"), "sprint").otherwise("distance"),
        "technique": F.when(t.contains("skiathlon") | (classic & free), "CF").when(classic, "C").when(free, "F").otherwise("?"),
        "start_type": start,
        "length_km": F.nullif(F.regexp_extract(t, LENGTH, 1), F.lit("")).try_cast("double"),
        "is_team": t.contains("relay") | t.contains("team sprint"),
    })
