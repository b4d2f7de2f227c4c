"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id), so that equal texts are neighbours.
A size-weighted sample of the keys gives splitters at its quantiles; the splitters cut the
records into ranges, whose exact sizes are then counted, and ranges that are overfull are
subdivided by splitters of their own. With the exact sizes of all ranges known, each
range can number its records and bytes by itself, and the shards are cut at equal bytes.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, map_batches, saved


def _splitters(keyed: DataFrame, wanted: int, per_splitter: int, weight_sum: float, salt: int) -> list[tuple[int, int]]:
    """Quantiles of a sample in which a record stands with a chance in proportion to its weight.

    The sample has about ``wanted * per_splitter`` keys, whatever the number of records.
    """
    rate = wanted * per_splitter / max(weight_sum, 1e-9)
    chance = F.shiftrightunsigned(F.xxhash64("h", "id", F.lit(salt)), 11) / float(2**53)
    drawn = sorted((r.h, r.id) for r in keyed.where(chance < F.col("weight") * rate).select("h", "id").collect())
    return sorted({drawn[len(drawn) * i // wanted] for i in range(1, wanted)}) if drawn else []


def _with_range(keyed: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    hs, ids = (np.array([s[i] for s in splitters], dtype=np.int64) for i in (0, 1))

    def work(batches):
        for b in batches:
            h, i = b["h"].to_numpy(), b["id"].to_numpy()
            lo, hi = np.searchsorted(hs, h, "left"), np.searchsorted(hs, h, "right")
            for at in np.flatnonzero(lo < hi):  # the splitter has the record's own hash: ids decide
                lo[at] += np.searchsorted(ids[lo[at] : hi[at]], i[at], "right")
            yield {**b, "part": lo}

    return map_batches(keyed.select("doc_id", "id", "h", "size", "text_crc32", "weight"), "doc_id long, id long, h long, size long, text_crc32 long, weight double, part long", work)


def shard_by_bytes(docs: DataFrame, shards: int = 24, *, ranges: int = 480, per_splitter: int = 32, overfull: float = 2.0, rounds: int = 3, keep_together: float = 0.01) -> DataFrame:
    """Deal all rows to ``shards`` shards of near equal bytes.

    A record's size is the UTF-8 length of its text (null: 0) plus 8. Cuts fall between
    records. A cut that would part a group of equal texts moves to the group's nearer end if
    the group has at most ``keep_together`` of a shard's bytes; larger groups are parted.
    Repeated rows (same id, same text) are dealt one by one; null ids come first in their
    group; an empty table gives no rows; columns other than doc_id and text are not read.

    Returns doc_id, size, text_crc32, shard (from 0), slot (gapless from 0 in each shard).
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    keyed = saved(keyed, "shard-keys")
    n, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    # half the weight is the record itself: a range is then bounded in bytes and in rows
    keyed = keyed.withColumn("weight", F.col("size") / float(max(total, 1)) + 1.0 / max(n, 1))
    splitters = _splitters(keyed, ranges, per_splitter, 2.0, 0)
    for k in range(rounds):
        ranged = _with_range(keyed, splitters)
        counted = {r.part: r for r in ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.sum("weight").alias("weight")).collect()}
        full = [p for p, r in counted.items() if r.weight > overfull * 2 / ranges and r.rows > 1]
        if not full or k == rounds - 1:
            break
        weight = sum(counted[p].weight for p in full)
        more = _splitters(ranged.where(F.col("part").isin(full)), max(2, round(weight * ranges)), per_splitter, weight, k + 1)
        if set(more) <= set(splitters):
            break
        splitters = sorted({*splitters, *more})

    ends_b = np.cumsum([0] + [counted[p].bytes if p in counted else 0 for p in range(len(splitters) + 1)])
    ends_n = np.cumsum([0] + [counted[p].rows if p in counted else 0 for p in range(len(splitters) + 1)])
    offsets = docs.sparkSession.createDataFrame([(p, int(ends_b[p]), int(ends_n[p])) for p in counted] or [(0, 0, 0)], "part long, bytes_before long, rows_before long")
    within = Window.partitionBy("part").orderBy("h", "id", "text_crc32", "size")
    placed = (
        ranged.withColumn("at", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
        .withColumn("row", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), "part")  # as many rows as ranges
        .select("doc_id", "h", "size", "text_crc32", (F.col("at") + F.col("bytes_before")).alias("at"), (F.col("row") + F.col("rows_before")).alias("row"))
    )
    placed = saved(placed, "shard-places")
    cuts = _cuts(placed, [int(total) * i // shards for i in range(1, shards)], keep_together * int(total) / shards)
    shard = sum((F.when(F.col("at") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    placed = placed.withColumn("shard", shard.cast("int"))
    first = {r.shard: r.first for r in placed.groupBy("shard").agg(F.min("row").alias("first")).collect()}
    start = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("shard")) if first else F.lit(0)
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("row") - start).cast("long").alias("slot"))


def _cuts(placed: DataFrame, aims: list[int], small: float) -> list[int]:
    """The byte at which each shard but the first begins: a record's or a small group's end nearest to the aim."""
    if not aims:
        return []
    over = None
    for a in aims:
        hit = (F.col("at") <= a) & (F.col("at") + F.col("size") > a)
        over = hit if over is None else over | hit
    crossing = placed.where(over).select("h", "at", "size").collect()  # one row an aim at most
    groups = {r.h: (r.lo, r.hi) for r in placed.where(F.col("h").isin([r.h for r in crossing])).groupBy("h").agg(F.min("at").alias("lo"), F.max(F.col("at") + F.col("size")).alias("hi")).collect()} if crossing else {}
    crossing.sort(key=lambda r: r.at)
    starts = [r.at for r in crossing]
    cuts = []
    for a in aims:
        k = bisect_right(starts, a) - 1
        if k < 0:
            cuts.append(a)
            continue
        r = crossing[k]
        lo, hi = groups[r.h] if groups[r.h][1] - groups[r.h][0] <= small else (r.at, r.at + r.size)
        cuts.append(lo if a - lo <= hi - a else hi)
    return cuts


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns."""
    none = F.lit(None).cast("int")
    return shard_by_bytes(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none.alias("grown_shard"))
