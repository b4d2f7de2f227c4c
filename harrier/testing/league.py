"""A league of races over the orders table, for tests and registered queries.

A race is a month of orders of one priority, its athletes are the customers with their best order
of the month. The same SQL text runs in Spark and in DuckDB.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RACES = """
SELECT DISTINCT concat(CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING), '-', substring(o_orderpriority, 1, 1)) AS race_id,
  CAST(year(o_orderdate) AS INT) AS season,
  CAST(make_date(CAST(year(o_orderdate) AS INT), CAST(month(o_orderdate) AS INT), CAST(1 + 7 * floor(CAST(substring(o_orderpriority, 1, 1) AS INT) / 2.0) AS INT)) AS DATE) AS race_date,
  concat('P', CAST(month(o_orderdate) % 3 AS STRING)) AS place,
  CASE WHEN substring(o_orderpriority, 1, 1) IN ('4', '5') THEN 'Continental Cup' ELSE 'Cross-Country World Cup' END AS series,
  CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '2', '4') THEN 'M' ELSE 'W' END AS gender,
  CASE WHEN CAST(substring(o_orderpriority, 1, 1) AS INT) % 2 = 0 THEN 'sprint' ELSE 'distance' END AS kind,
  CASE month(o_orderdate) % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'F' ELSE 'CF' END AS technique,
  CASE WHEN CAST(substring(o_orderpriority, 1, 1) AS INT) % 2 = 0 THEN 1.4E0 WHEN month(o_orderdate) % 4 = 0 THEN NULL ELSE 5.0E0 * (month(o_orderdate) % 4) END AS length_km,
  concat(CASE WHEN substring(o_orderpriority, 1, 1) IN ('1', '2', '4') THEN 'Men''s ' ELSE 'Women''s ' END,
    CASE WHEN CAST(substring(o_orderpriority, 1, 1) AS INT) % 2 = 0 THEN 'Sprint ' ELSE '10km Mass Start ' END,
    CASE month(o_orderdate) % 3 WHEN 0 THEN 'Classic' WHEN 1 THEN 'Free' ELSE 'Overall Standings' END) AS title,
  CASE WHEN month(o_orderdate) = 12 THEN NULL ELSE FALSE END AS is_team
FROM orders"""

RESULTS = """
SELECT race_id, fis_code,
  CASE WHEN out = 0 THEN CAST(row_number() OVER (PARTITION BY race_id, out ORDER BY price DESC, fis_code) AS INT) END AS rank,
  CASE WHEN out = 0 AND timed = 1 THEN floor((4000 - price / 200) * 10 + 0.5E0) / 10.0E0 END AS time_s,
  CASE WHEN out = 0 AND timed = 1 THEN floor((max(CASE WHEN out = 0 THEN price END) OVER (PARTITION BY race_id) - price) / 10 + 0.5E0) / 100.0E0 END AS fis_points,
  CASE WHEN out = 0 THEN 'OK' ELSE 'DNF' END AS status
FROM (SELECT race_id, fis_code, price, timed, CASE WHEN orderkey % 10 = 0 THEN 1 ELSE 0 END AS out FROM (
  SELECT concat(CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING), '-', substring(o_orderpriority, 1, 1)) AS race_id, CAST(o_custkey AS STRING) AS fis_code,
    o_totalprice AS price, o_orderkey AS orderkey, CASE WHEN month(o_orderdate) % 5 = 0 THEN 0 ELSE 1 END AS timed,
    row_number() OVER (PARTITION BY year(o_orderdate), month(o_orderdate), o_orderpriority, o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k
  FROM orders) a WHERE k = 1) b"""

ATHLETES = "SELECT CAST(c_custkey AS STRING) AS fis_code, c_name AS name, upper(substring(n_name, 1, 3)) AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"


def _sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    return spark.sql(text if not tables else _bound(text, tables), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _bound(text: str, tables: tuple[str, ...]) -> str:
    for t in tables:
        for word in ("FROM ", "JOIN "):
            text = text.replace(f"{word}{t}", f"{word}{{{t}}}")
    return text


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, RACES, "orders")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, RESULTS, "orders")


def athletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, ATHLETES, "customer", "nation")


def pages(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """race_id, html of the races that have a head (race_id, text): that, and below it the race's rows (race_id, text) in their order as texts.

    Texts are sorted by race and joined one race at a time, so that a task holds no more than one page.
    """
    parts = heads.select("race_id", F.lit(0).alias("part"), "text").unionByName(rows.select("race_id", F.lit(1).alias("part"), "text")).where("race_id IS NOT NULL AND text IS NOT NULL")
    # races are few and long, and their pages are work for whoever reads them: more tasks than Spark would make of so few bytes
    context = heads.sparkSession.sparkContext
    parts = parts.repartition(max(4 * context.defaultParallelism, int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "race_id").sortWithinPartitions("race_id", "part", "text")

    def joined(batches):
        race, head, texts = None, None, []

        def out():
            return pa.RecordBatch.from_pydict({"race_id": pa.array([race], pa.string()), "html": pa.array([head + "\n".join(texts)], pa.string())})

        for b in batches:
            for r, part, text in zip(*(b.column(c).to_pylist() for c in ("race_id", "part", "text")), strict=True):
                if r != race:
                    if head is not None:
                        yield out()
                    race, head, texts = r, None, []
                if part == 0:
                    head = text
                else:
                    texts.append(text)
        if head is not None:
            yield out()

    return parts.mapInArrow(joined, "race_id string, html string")
