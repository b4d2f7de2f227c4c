"""Whole pages into the store: races, athletes, results and start lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.results import single_races
from . import pages as P
from . import store
from .scratch import settled


def latest_pages(pages: DataFrame) -> DataFrame:
    """One page a race: of several the one with the greatest ``seq``, if there is such a column; ties by the text."""
    order = F.struct(F.col("seq"), F.col("html")) if "seq" in pages.columns else F.col("html")
    return pages.groupBy("race_id").agg(F.max_by("html", order).alias("html"))


def ingest(spark: SparkSession, root: str, pages: DataFrame, listed: DataFrame | None = None, page: type = P._Page) -> int:
    """Save what race pages (race_id, html) hold, and return how many can't be parsed. ``listed``: race_id, season, event_id.

    Pages of standings are left out, whatever their rows. A page with ranks gives results; any page with rows replaces its
    race's start list. An athlete's last race in time gives the name. Null race ids are left out. A page that
    can't be parsed is a row of the table ``bad_pages`` with the reason, until a later page of its race is right; it changes
    nothing else, and the other pages are saved. All tables change at once.
    """
    parsed = settled(P.parse_pages(latest_pages(pages.where("race_id IS NOT NULL")), page), "ingest")
    whole = single_races(parsed.where("error IS NULL"))
    rows = settled(P.entries_of(whole), "ingest")
    day = F.greatest(F.lit(0), F.coalesce(F.unix_date(F.col("race_date").try_cast("date")), F.lit(0))).alias("seq")
    done = P.results_of(rows.withColumn("seq", F.lit(1))).select("race_id", "fis_code", "rank", "bib", "time_s", "diff_s", "fis_points", "status", "seq")
    entered = rows.groupBy("race_id", "fis_code").agg(F.max("bib").alias("bib")).withColumn("start_time", F.lit(None).cast("string"))
    upserted = lambda name: lambda old, new: store.upsert(old, new, name)
    store.merge(spark, root, {
        "races": (P.races_of(whole, listed).withColumn("seq", F.lit(1)), upserted("races")),
        "athletes": (rows.select("fis_code", "name", "nation", "birth_year", "competitor_id", day), store.upsert_athletes),
        "results": (done, upserted("results")),
        "start_list": (entered, store.replace_start_list),
        "bad_pages": (parsed.select("race_id", "error", F.lit(1).alias("seq")), lambda old, new: store.upsert(old, new, "bad_pages").where("error IS NOT NULL")),
    })
    return P.bad_pages(parsed).count()
