"""Federations and the treatment of signals about entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
FEDERATIONS = {"NOR": "Norges Skiforbund", "SWE": "Svenska Skidförbundet", "FIN": "Suomen Hiihtoliitto", "ITA": "FISI", "FRA": "Fédération Française de Ski", "GER": "Deutscher Skiverband", "USA": "U.S. Ski & Snowboard", "SUI": "Swiss-Ski", "CAN": "Nordiq Canada"}
CONFIDENCE = {"fis_startlist": 1.0, "federation": 1.0, "news_confirmed": 0.6, "news_rumour": 0.3}


def covers(nation: Column, known=tuple(FEDERATIONS)) -> Column:
    return F.coalesce(nation.isin(*known), F.lit(False))


def uncovered(entries: DataFrame, known=tuple(FEDERATIONS)) -> DataFrame:
    """Distinct nations of the entries that no federation in the list covers."""
    return entries.where(F.col("nation").isNotNull() & (F.col("nation") != "") & ~covers(F.col("nation"), known)).select("nation").distinct()


def treat(signal: Column) -> Column:
    """Only official signals change an entry; all others flag it for review."""
    return F.when(signal.isin("fis_startlist", "federation"), "authoritative").otherwise("flag_for_review")


def confidence(signal: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), signal)
