"""The store: Parquet tables with explicit schemas, and the merges that keep their keys."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import KEYS, SCHEMAS
from .scratch import settled


#: Buckets of a table that is merged into, by its first key column; told by the manifest once the store has one.
BUCKETS = 64


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path in its terms."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def _exists(spark: SparkSession, path: str) -> bool:
    files, of = _files(spark, path)
    return files.exists(of)


def manifest(spark: SparkSession, root: str) -> dict:
    """Which version of each bucket of each table is the table's: {"buckets": n, "tables": {name: {bucket: version}}}."""
    path = f"{root}/tables.json"
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if _exists(spark, path) else {"buckets": BUCKETS, "tables": {}}


def _swap(spark: SparkSession, root: str, content: dict) -> None:
    """Put a new manifest in the place of the old one, in one step."""
    files, new = _files(spark, f"{root}/tables-{uuid.uuid4().hex}.json")
    out = files.create(new, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    _, place = _files(spark, f"{root}/tables.json")
    qualified = files.makeQualified(place)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(files.makeQualified(new), qualified, options)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table; empty where nothing was written yet."""
    return _read(spark, root, name, manifest(spark, root))


def _read(spark: SparkSession, root: str, name: str, content: dict, only: list[int] | None = None) -> DataFrame:
    if name in content["tables"]:
        paths = [f"{root}/{name}/{v}/bucket={b}" for b, v in content["tables"][name].items() if only is None or int(b) in only]
    else:
        paths = [f"{root}/{name}"] if _exists(spark, f"{root}/{name}") else []
    return spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[name])


def write(df: DataFrame, root: str, name: str) -> None:
    """Overwrite a whole table that isn't merged into."""
    df.write.mode("overwrite").parquet(f"{root}/{name}")


def merge(spark: SparkSession, root: str, changes: dict[str, tuple[DataFrame, Callable[[DataFrame, DataFrame], DataFrame]]]) -> None:
    """Merge new rows into tables: name to (new rows, what makes a table's rows of its old and the new ones).

    Of each table only the buckets that the new rows' keys fall into are read and written, each to a folder of its own; all
    other buckets stay the files that they are. The manifest, which says what the tables are made of, is replaced last and for
    all tables at once: whoever reads sees all changes or none, and a merge that dies between two tables leaves the old
    state. One merge at a time; readers need no lock. ``vacuum`` removes what no manifest names any more.
    """
    content = manifest(spark, root)
    version = uuid.uuid4().hex
    for name, (new, made) in changes.items():
        bucket = F.pmod(F.xxhash64(KEYS[name][0]), F.lit(content["buckets"])).cast("int").alias("bucket")
        new = settled(new, name)
        touched = sorted(r.bucket for r in new.select(bucket).distinct().collect())  # as many as there are buckets at most
        if not touched:
            continue
        if name not in content["tables"] and _exists(spark, f"{root}/{name}"):  # not in buckets yet
            touched = list(range(content["buckets"]))
        old = _read(spark, root, name, content, touched)
        rows = made(old, new)
        rows.select("*", bucket).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{root}/{name}/{version}")
        now = content["tables"].setdefault(name, {})
        for b in touched:
            now.pop(str(b), None)
            if _exists(spark, f"{root}/{name}/{version}/bucket={b}"):
                now[str(b)] = version
    _swap(spark, root, content)


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove the folders of merged tables that the manifest doesn't name; how many there were."""
    gone = 0
    for name, now in manifest(spark, root)["tables"].items():
        files, of = _files(spark, f"{root}/{name}")
        for found in files.listStatus(of):
            if found.getPath().getName() not in now.values():
                files.delete(found.getPath(), True)
                gone += 1
    return gone


def upsert_athletes(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """The last name always wins; of the other columns the last value that isn't null. Ties go to the greater value."""
    rows = old.withColumn(seq, F.lit(-1).cast("long")).unionByName(new.withColumn(seq, F.col(seq).cast("long")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(seq, c))).alias(c)
    return rows.groupBy("fis_code").agg(F.max_by("name", F.struct(seq, "name")).alias("name"), last("nation"), last("birth_year"), last("competitor_id"))


def upsert(old: DataFrame, new: DataFrame, name: str, seq: str = "seq") -> DataFrame:
    """The last whole row of each key; ties go to the greater row."""
    rows = old.withColumn(seq, F.lit(-1).cast("long")).unionByName(new.withColumn(seq, F.col(seq).cast("long")))
    place = F.row_number().over(Window.partitionBy(*KEYS[name]).orderBy(F.desc(seq), *[F.desc(c) for c in old.columns if c != seq]))
    return rows.withColumn("place", place).where("place = 1").drop("place", seq)


def replace_start_list(old: DataFrame, new: DataFrame) -> DataFrame:
    """Races of the new rows lose their old rows; the new ones are stamped."""
    return old.join(new.select("race_id").distinct(), "race_id", "left_anti").unionByName(new.withColumn("fetched_at", F.current_timestamp()))


def start_list(entries: DataFrame, athletes: DataFrame) -> DataFrame:
    return entries.join(athletes.select("fis_code", "name", "nation"), "fis_code", "left")


def _cell(value: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), '"', '""'), F.lit('"'))


def quoted_csv(df: DataFrame) -> DataFrame:
    """One text column: every field in quotes, quotes doubled, nulls empty."""
    return df.select(F.concat_ws(",", *[_cell(F.col(c)) for c in df.columns]).alias("line"))


def csv_files(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """key, text: a CSV file a key, with byte-order mark, header and CRLF, its lines in the given order, nulls first.

    Numbers that are whole are written without a point. A file holds one athlete, race or weekend, so it is small.
    """
    plain = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "") if dict(df.dtypes)[c] == "double" else F.col(c)
    line = F.concat_ws(",", *[_cell(plain(c)) for c in columns])
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    head = "\ufeff" + ",".join(f'"{c}"' for c in columns) + "\r\n"
    return df.groupBy(key).agg(lines.alias("lines")).select(key, F.concat(F.lit(head), F.array_join(F.transform("lines", lambda x: F.concat(x.line, F.lit("\r\n"))), "")).alias("text"))


def safe_name(text: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores; other runs are a dash, but for one at either end."""
    named = F.coalesce(F.nullif(text, F.lit("")), F.lit("export"))
    return F.regexp_replace(F.regexp_replace(named, r"[^A-Za-z0-9._-]+", "-"), "^-|-$", "")
