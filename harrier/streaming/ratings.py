"""Ratings over a stream of races. An extension: the batch fold is the reference result."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import Elo, update_race

RACE = "pool string, race_id string, race_date date, codes array<string>, ranks array<double>"
RATED = "pool string, race_id string, fis_code string, rating double, n_races int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RatePool(StatefulProcessor):
    """A pool's ratings as map state, of which a race reads and writes its starters' only.

    ``waits``: races are held by time and id until the watermark has passed them."""

    def __init__(self, elo: Elo, waits: bool):
        self.elo, self.waits = elo, waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ratings = handle.getMapState("ratings", "fis_code string", "rating double, n_races int, last_race string, last_day int")
        if self.waits:
            self.waiting = handle.getMapState("waiting", "at long, race_id string", "day int, codes array<string>, ranks array<double>")

    def _rated(self, pool: str, race_id: str, day: int | None, codes: list[str], ranks: list[float]) -> pd.DataFrame:
        state = {}
        for c in set(codes):
            if x := self.ratings.getValue((c,)):
                state[c] = [x[0], x[1], x[2], None if x[3] is None else date.fromordinal(x[3])]
        update_race(state, codes, np.asarray(ranks, float), None if day is None else date.fromordinal(day), race_id, self.elo)
        for c, (rating, n, last, when) in state.items():
            self.ratings.updateValue((c,), (float(rating), int(n), last, when and when.toordinal()))
        return pd.DataFrame([(pool, race_id, c, state[c][0], state[c][1]) for c in codes if c in state], columns=["pool", "race_id", "fis_code", "rating", "n_races"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.waits:
            for r in pd.concat(list(rows)).sort_values(["race_date", "race_id"], na_position="first").itertuples():
                yield self._rated(key[0], r.race_id, None if pd.isna(r.race_date) else r.race_date.toordinal(), list(r.codes), list(r.ranks))
            return
        for some in rows:
            for r in some.itertuples():
                day = None if pd.isna(r.race_date) else r.race_date.toordinal()
                self.waiting.updateValue((int(r.at), r.race_id), (day, list(r.codes), [float(x) for x in r.ranks]))
                self.handle.registerTimer(int(r.at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for at, race_id in sorted(tuple(k) for k in self.waiting.keys() if k[0] <= passed):
            day, codes, ranks = self.waiting.getValue((at, race_id))
            self.waiting.removeKey((at, race_id))
            yield self._rated(key[0], race_id, day, list(codes), list(ranks))


def rate_stream(races: DataFrame, late: str | None = None, elo: Elo = Elo()) -> DataFrame:
    """Ratings of a race's starters after it (``RATED``), for a stream of races (``RACE``).

    With ``late``, such as "30 days", races may come in any order within that time: each is rated once the watermark has
    passed its date, by date and id, so that the result is the batch fold's. A race that comes later than that is left
    out and counted as dropped by watermark in the query's progress; one sent twice before its time counts as last sent.
    Undated races stand at 1970-01-02: in time only before the watermark moves; earlier dates are always late.
    Without ``late`` a race is rated in the batch that brings it, those of one batch by date and id, undated first.

    The state lies in RocksDB, which this sets for the session; a restart goes on from the checkpoint.
    """
    races.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    if late:
        time = F.coalesce("race_date", F.lit("1970-01-02").cast("date")).cast("timestamp")
        races = races.withColumn("race_time", time).withWatermark("race_time", late).withColumn("at", F.unix_millis("race_time"))
    return races.groupBy("pool").transformWithStateInPandas(RatePool(elo, bool(late)), RATED, "append", "EventTime" if late else "None")


def session_weekends(races: DataFrame, gap: str = "4 days", late: str = "30 days") -> DataFrame:
    """Weekends of a stream (place, race_time, race_id): sessions of one place, closed when the watermark passes."""
    return races.withWatermark("race_time", late).groupBy("place", F.session_window("race_time", gap)).agg(F.count("*").alias("n_races")).select("place", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_races")
