"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Words are lower-cased runs of letters and digits. A seed is a fixed mask laid on the words: those
at its ones are hashed, those at its zeros are ignored, so that a substituted word there does not
hide a copy. The hashes of all documents are joined to those of the benchmark. Each hit gives an
alignment of a document with an item, which is then verified word by word: it counts if at
least ``share`` of the item's words agree, or if any stretch of it has ``long`` agreeing words
or more and at least ``share`` of that stretch agrees, whatever lies before and after it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Fixed masks; six words count in each.
MASKS = ("1110111", "11011011", "1101001101")

#: A text's items that are verified in one row.
LOT = 64


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(w: Column) -> Column:
    """All masks' hashes at all positions: entry ``m * size(w) + i`` is mask m laid at word i, null where it overhangs."""

    def laid(m: int) -> Column:
        at = [k for k, bit in enumerate(MASKS[m]) if bit == "1"]
        here = lambda i: F.when(i + len(MASKS[m]) <= F.size(w), F.xxhash64(F.lit(m), *[F.get(w, i + k) for k in at]))
        return F.transform(F.sequence(F.lit(0), F.size(w) - 1), here)

    return F.when(F.size(w) >= min(map(len, MASKS)), F.concat(*[laid(m) for m in range(len(MASKS))]))


def _seed_rows(df: DataFrame, *key: str) -> DataFrame:
    hashed = df.select(*key, "w", F.size("w").alias("n"))
    rows = hashed.select(*key, "n", F.posexplode(seeds(F.col("w"))).alias("p", "seed")).where(F.col("seed").isNotNull())
    return rows.select(*key, "seed", F.pmod("p", "n").alias("at"))


def has_stretch(at: Column, share: float, long: int) -> Column:
    """Whether a stretch has ``long`` of the sorted positions ``at`` or more, and they are at least ``share`` of it.

    Of a longer stretch cut in two parts of ``long`` positions or more, one is as dense as the whole, so
    it is enough to look at stretches of ``long`` to ``2 * long - 1`` positions.
    """
    widest = {k: max(x for x in range(k, int(k / share) + 2) if k >= share * x) for k in range(long, 2 * long)}
    dense = lambda i, k: F.coalesce(F.get(at, i + k - 1) - F.get(at, i) < widest[k], F.lit(False))
    starts = F.sequence(F.lit(0), F.size(at) - long)
    return (F.size(at) >= long) & F.exists(starts, lambda i: reduce(or_, [dense(i, k) for k in widest]))


def find(docs: DataFrame, benchmark: DataFrame, *, share: float = 0.8, long: int = 13, broadcast_seeds: int = 500_000) -> DataFrame:
    """One row for each document and distinct item text that it copies.

    Items of fewer words than the shortest mask, empty and null ones are no evidence and match
    nothing; items of equal words are one, under their smallest id. Null and empty documents match
    nothing; repeated rows of a document give one row. Items' seeds are broadcast where they
    are at most ``broadcast_seeds`` rows by count, else joined by a shuffle.

    Returns doc_id, item_id, matched (agreeing words of the item), item_words, doc_from (the
    document's word where the item's first word would lie, negative before its start).
    """
    found = _found(docs, benchmark, share, long, broadcast_seeds)
    best = F.max(F.struct("matched", (-F.col("lag")).alias("back"), "item_words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.matched").alias("matched"), F.col("best.item_words").alias("item_words"), (-F.col("best.back")).alias("doc_from"))


def _found(docs: DataFrame, benchmark: DataFrame, share: float, long: int, broadcast_seeds: int) -> DataFrame:
    """doc_id, of (the text's hash), item_id and the best alignment of each copied item: matched, item_words, lag."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("w")).where(F.size("w") >= min(map(len, MASKS)))
    items = items.groupBy(F.col("w")).agg(F.min("item_id").alias("item_id")).select("item_id", "w")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("of"))
    probe = _seed_rows(items, "item_id").select("item_id", "seed", F.col("at").alias("item_at")).distinct()
    if probe.count() <= broadcast_seeds:
        probe = F.broadcast(probe)
    rows = _seed_rows(texts.select("doc_id", "of", word_hashes(F.col("text")).alias("w")), "doc_id", "of")
    hits = rows.join(probe, "seed").select("doc_id", "of", "item_id", (F.col("at") - F.col("item_at")).alias("lag")).distinct()
    # one row for each text and item, with all its lags; a text's words are fetched once for all its items
    hits = hits.groupBy("doc_id", "of", "item_id").agg(F.sort_array(F.collect_list("lag")).alias("lags"))
    hits = saved(hits.join(items.withColumnRenamed("w", "item"), "item_id"), "leaks")
    # a text's items go in lots of about ``LOT`` by the items' hash, however many items share a phrase with it
    lots = max(1, -(-items.count() // LOT))
    asked = hits.groupBy("doc_id", "of", F.pmod(F.xxhash64("item_id"), F.lit(lots)).alias("lot")).agg(F.collect_list(F.struct("item_id", "item", "lags")).alias("asked"))
    same = (F.col("h.doc_id").eqNullSafe(F.col("t.doc_id"))) & (F.col("h.of") == F.col("t.of"))
    once = texts.alias("t").join(asked.alias("h"), same).select("h.doc_id", "h.of", "h.lot", "h.asked", F.col("t.text")).dropDuplicates(["doc_id", "of", "lot"])
    # as the one element of an array, words and positions are found once and not again wherever they are named
    once = once.select("doc_id", "of", "asked", F.explode(F.array(word_hashes(F.col("text")))).alias("w"))
    pairs = once.select("doc_id", "of", "w", F.explode("asked").alias("a"))
    n = F.size("a.item")

    def agreeing(lag: Column) -> Column:
        agrees = lambda i: (i >= 0) & F.coalesce(F.get("w", i) == F.get("a.item", i - lag), F.lit(False))
        return F.filter(F.sequence(lag, lag + n - 1), agrees)

    def judged(lag: Column) -> Column:
        """The alignment's agreeing words and lag, null if it is no copy; a text's words make no row a lag."""
        verdict = lambda at: F.when((F.size(at) >= share * n) | has_stretch(at, share, long), F.struct(F.size(at).alias("matched"), (-lag).alias("back")))
        return F.element_at(F.transform(F.array(agreeing(lag)), verdict), 1)

    best = F.array_max(F.transform("a.lags", judged)).alias("best")
    pairs = pairs.select("doc_id", "of", F.col("a.item_id").alias("item_id"), n.alias("item_words"), best).where(F.col("best").isNotNull())
    return pairs.select("doc_id", "of", "item_id", F.col("best.matched").alias("matched"), "item_words", (-F.col("best.back")).alias("lag"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that copy no benchmark item, with all their columns. Rows are known by id and text
    together, so that a clean row stays that shares its id, or the lack of one, with another."""
    dirty = _found(docs, benchmark, 0.8, 13, 500_000).select(F.col("doc_id").alias("_leak_id"), F.col("of").alias("_leak_of")).distinct()
    rows = docs.withColumn("_doc_of", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = rows["doc_id"].eqNullSafe(dirty["_leak_id"]) & (rows["_doc_of"] == dirty["_leak_of"])
    return rows.join(dirty, same, "left_anti").select(*docs.columns)


def oracle_sql() -> str:
    """The same matches in DuckDB."""
    at = [[k for k, bit in enumerate(m) if bit == "1"] for m in MASKS]
    laid = " UNION ALL ".join("SELECT {key}, i, %d AS m, [%s] AS seed FROM {src}, unnest(range(len(w))) AS t(i) WHERE i + %d <= len(w)" % (m, ", ".join(f"w[i + {k + 1}]" for k in ks), len(MASKS[m])) for m, ks in enumerate(at))
    words = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT min(item_id) AS item_id, w FROM (SELECT item_id, {words} AS w FROM benchmark) x WHERE len(w) >= {min(map(len, MASKS))} GROUP BY w),
ds AS ({laid.format(key="doc_id", src="d")}),
bs AS ({laid.format(key="item_id", src="b")}),
h AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS lag FROM ds JOIN bs USING (m, seed)),
p AS (SELECT h.doc_id, h.item_id, lag, len(b.w) AS item_words, list_filter(range(lag, lag + len(b.w)), lambda i: i >= 0 AND i < len(d.w) AND d.w[i + 1] = b.w[i - lag + 1]) AS hit FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
q AS (SELECT *, len(hit) AS matched, len(list_filter(range(1, len(hit) - 11), lambda i: len(list_filter(range(13, 26), lambda k: i + k - 1 <= len(hit) AND hit[i + k - 1] - hit[i] < 5 * k // 4)) > 0)) > 0 AS stretch FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, lag) AS k FROM q WHERE matched >= 0.8 * item_words OR stretch)
SELECT doc_id, item_id, matched::INT AS matched, item_words::INT AS item_words, lag::INT AS doc_from FROM r WHERE k = 1"""
