"""Source divergence audit: how far the sources of a language differ in their words.

Tasks count the terms of their documents by language and source and hand on one row a term. These rows
are hashed by language and term into shards of bounded size. In each shard DuckDB adds up the counts and
keeps the terms that enough documents of the language hold; Spark adds the shards' totals. With the totals
known, a second pass over the kept terms, sharded in the same way, gives each shard's part of the sums of
all pairs of sources, and its best terms of each source; Spark merges both and ranks them.

Sums of pairs take no row for a term that neither source has. With z the probability of a count of 0,
``|p - q|`` summed over all V terms is ``V |z - z'|`` plus, for each term of either source,
what ``|p - z'|`` adds to ``|z - z'|``, plus a correction for the terms that both have. The second part needs no
term, only how many terms of a source have each p; the third is a join on the term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, saved

#: ASCII letters in lower case and all bytes of other characters stay, what else there is parts terms.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
#: Rows of a shard, at most, but for chance; DuckDB holds them in memory.
SHARD_ROWS = 500_000
#: Counts that a task holds before it hands them on.
HELD = 300_000
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 22


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a stretch after another."""
    data, at = data.translate(_FOLD), 0
    while at < len(data):
        end = len(data) if at + PIECE >= len(data) else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); a task may give a term several rows.

    Every group has a row with an empty term, so that groups without terms are known too.
    """

    def flushed(groups):
        rows = [(lang, source, term.decode("utf-8", "replace"), n, df[term]) for (lang, source), (tf, df) in groups.items() for term, n in tf.items()]
        rows += [(lang, source, "", 0, 0) for lang, source in groups]
        return dict(zip(("lang", "source", "term", "n", "docs"), map(list, zip(*rows, strict=True)), strict=True))

    def work(batches):
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in batches:
            for lang, source, data in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["data"], strict=True):
                tf, df = groups.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for words in _pieces(data.as_py()):
                    tf.update(words)
                    seen.update(words)
                df.update(seen)
            if sum(len(tf) for tf, _ in groups.values()) > HELD:
                yield flushed(groups)
                groups = {}
        if groups:
            yield flushed(groups)

    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").cast("binary").alias("data"))
    return map_batches(rows, "lang string, source string, term string, n long, docs long", work)


def _in_shards(rows: DataFrame, schema: str, merge: str, out: str) -> DataFrame:
    """``out``, DuckDB's SQL over the table t of each shard of ``rows``. Rows of one lang and term share a shard.

    ``merge`` (SQL over t) is applied whenever SHARD_ROWS rows have come in, so that what is held is the shard's
    distinct terms and no more.
    """

    def work(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        held = 0
        for b in batches:
            got = pa.table(b)  # noqa: F841  (DuckDB reads it by its name)
            con.execute("INSERT INTO t SELECT * FROM got" if held else "CREATE TABLE t AS SELECT * FROM got")
            held += got.num_rows
            if merge and held > SHARD_ROWS:
                con.execute(f"CREATE TABLE merged AS {merge}; DROP TABLE t; ALTER TABLE merged RENAME TO t")
                held = 1
        if not held:
            return
        if merge:
            con.execute(f"CREATE TABLE merged AS {merge}; DROP TABLE t; ALTER TABLE merged RENAME TO t")
        found = con.sql(out).to_arrow_reader(50_000)
        for b in found:
            yield {n: b.column(i) for i, n in enumerate(b.schema.names)}

    shards = max(1, -(-rows.count() // SHARD_ROWS))
    return map_batches(rows.repartition(shards, "lang", "term"), schema, work)


#: The kept terms of a shard, and the rows of groups; ``first`` is 1 once for each kept term of a language.
KEPT = """SELECT lang, source, term, n, CASE WHEN term <> '' AND row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 THEN 1 ELSE 0 END AS first
FROM (SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS found FROM t) WHERE term = '' OR found >= {least}"""
MERGE = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM t GROUP BY ALL"
#: A shard's best terms, its share in pairs' sums and how many terms have each p.
SHARES = """WITH p AS (SELECT lang, source, term, z, (1 + 1000000000::HUGEINT * (n + 5) // (total + 5 * terms))::BIGINT AS p,
  (1 + 1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5) // (lang_total + 5 * terms))::BIGINT AS q FROM t)
SELECT 'term' AS part, lang, source, term AS item, p - q AS value, 0::BIGINT AS n FROM p WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {most}
UNION ALL SELECT 'pair', a.lang, a.source, b.source, sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(a.z - b.p) + abs(a.z - b.z))::BIGINT, 0 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
UNION ALL SELECT 'held', lang, source, NULL, p, count(*) FROM p GROUP BY lang, source, p"""


def audit(docs: DataFrame, *, least: int = 30, most: int = 50) -> DataFrame:
    """Divergence of sources within each language: lang, source, part, item, value, rank.

    Part ``pair``: the distance of the source to each other source of the language, over the terms that at least
    ``least`` of the language's documents hold. Part ``term``: the ``most`` terms that the source uses more often than
    its language. Null lang, source and text count as empty; repeated rows are documents of their own; groups
    without terms take part, with 0 where a language keeps no term; a language of one source has no pairs. An
    empty table gives no rows. Values are exact. Other columns are not read.
    """
    counts = saved(_counted(docs), "term-counts")
    kept = saved(_in_shards(counts, "lang string, source string, term string, n long, first long", MERGE, KEPT.format(least=int(least))), "kept-terms")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("first"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("first").alias("terms"))
    groups = groups.drop("first").join(langs, "lang").withColumn("z", F.when(F.col("terms") > 0, F.expr("1 + 5000000000 div (total + 5 * terms)")).otherwise(0))
    groups = saved(groups, "term-totals")
    rows = kept.where("term <> '' AND n > 0").drop("first").join(groups, ["lang", "source"])
    rows = rows.select("lang", "source", "term", "n", "total", "lang_total", "terms", "z")
    shares = saved(_in_shards(rows, "part string, lang string, source string, item string, value long, n long", "", SHARES.format(most=int(most))), "term-shares")

    g = groups.select("lang", "source", "z", "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    held = shares.where("part = 'held'").groupBy("lang", "source", F.col("value").alias("p")).agg(F.sum("n").alias("n")).join(groups.select("lang", "source", "z"), ["lang", "source"])
    ones = held.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.expr("n * (abs(p - y) - abs(z - y))")).alias("v"))
    both = shares.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("v"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "v")
    more = ones.unionAll(turned(ones)).unionAll(both).unionAll(turned(both)).groupBy("lang", "source", "item").agg(F.sum("v").alias("v"))
    pairs = g.join(other, "lang").where("source <> item").join(more, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("terms") * F.abs(F.col("z") - F.col("y")) + F.coalesce("v", F.lit(0))).alias("value"))
    terms = shares.where("part = 'term'").select("lang", "source", "part", "item", "value")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pairs).unionAll(ranked(terms).where(F.col("rank") <= most))


def oracle_sql() -> str:
    """The same in DuckDB, over a table of all kept terms of all groups."""
    upper = "".join(map(chr, range(65, 91)))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  unnest(list_append(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, '{upper}', '{upper.lower()}')), '')) AS term FROM documents),
k AS (SELECT lang, term FROM d WHERE term <> '' GROUP BY ALL HAVING count(DISTINCT row) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT d.lang, source, coalesce(v, 0) AS v FROM d LEFT JOIN v USING (lang)),
c AS (SELECT lang, source, term, count(*) AS n FROM d JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, v, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p, 1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM f),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50"""
