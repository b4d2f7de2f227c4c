"""Running totals within keys, where a key may be as long as the table."""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, saved

_TYPES = {"bigint": "long", "int": "int", "double": "double", "string": "string", "binary": "binary", "boolean": "boolean"}


def _totals(keys: np.ndarray, values: np.ndarray, before, xor: bool) -> np.ndarray:
    """Totals of ``values`` from the beginning of each run of equal keys; the first run goes on from ``before``."""
    total = np.bitwise_xor.accumulate(values) if xor else np.cumsum(values)
    starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    lengths = np.diff(np.concatenate([[0], starts, [len(keys)]]))
    earlier = np.repeat(np.concatenate([[before if xor else -before], total[starts - 1]]).astype(np.int64), lengths)
    return total ^ earlier if xor else total - earlier


def running(rows: DataFrame, key: str, order: list[str], *, sums: tuple[str, ...] = (), xors: tuple[str, ...] = (), name: str = "running") -> DataFrame:
    """``rows`` with ``run_<c>`` for each column c of ``sums`` (added) and ``xors``: the total of c over the rows of the
    same key that come no later in ``order``. All these columns are long and not null.

    Rows are dealt by ranges of (key, order), so that a key of any size is dealt to many tasks, each of which
    streams its rows. What a key had before a range begins is found from one row a range.
    The result is a written table.
    """
    columns = [*sums, *xors]
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    kept = [(c, _TYPES[t]) for c, t in rows.dtypes]

    def work(batches):
        last, before, at = None, dict.fromkeys(columns, 0), 0
        part = TaskContext.get().partitionId()
        for b in batches:
            keys = b[key].to_numpy()
            out = {c: b[c] for c, _ in kept}
            for c in columns:
                run = _totals(keys, b[c].to_numpy(), before[c] if keys[0] == last else 0, c in xors)
                out[f"run_{c}"], before[c] = run, int(run[-1])
            out["_part"], out["_at"] = np.full(len(keys), part, np.int64), np.arange(at, at + len(keys), dtype=np.int64)
            last, at = keys[-1], at + len(keys)
            yield out

    schema = ", ".join([*(f"{c} {t}" for c, t in kept), *(f"run_{c} long" for c in columns), "_part long", "_at long"])
    parts = saved(map_batches(ranged, schema, work), name)
    ends = parts.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"), *[F.max_by(f"run_{c}", "_at").alias(c) for c in columns])
    carried, carry, last = [], dict.fromkeys(columns, 0), None
    for r in sorted(ends.collect(), key=lambda r: r._part):  # one row a range
        if r.first == last:
            carried.append((r._part, r.first, *carry.values()))
        # a range of one key alone goes on with what came before it
        goes_on = r.first == last and r.first == r.last
        carry = {c: ((carry[c] ^ r[c]) if c in xors else carry[c] + r[c]) if goes_on else r[c] for c in columns}
        last = r.last
    if carried:
        more = rows.sparkSession.createDataFrame(carried, ", ".join(["_part long", f"{key} long", *(f"_{c} long" for c in columns)]))
        parts = parts.join(F.broadcast(more), ["_part", key], "left")  # a row a range at most
        none = lambda c: F.coalesce(F.col(f"_{c}"), F.lit(0))
        parts = parts.withColumns({f"run_{c}": F.col(f"run_{c}").bitwiseXOR(none(c)) if c in xors else F.col(f"run_{c}") + none(c) for c in columns})
    return parts.select(*[c for c, _ in kept], *[f"run_{c}" for c in columns])
