"""What the operators share: reading a table, the shared scratch folder, Arrow batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch that goes to Python. Texts can be long, so batches are short.
BATCH_ROWS = 512

#: Stands for a null doc_id where an id is a key.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches at ``BATCH_ROWS`` rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


_own_scratch: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent, in local mode, a temporary folder of this
    process is used instead and removed when it ends.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "dir" not in _own_scratch:
            import shutil

            _own_scratch["dir"] = tempfile.mkdtemp(prefix="harrier-")
            atexit.register(shutil.rmtree, _own_scratch["dir"], ignore_errors=True)
        base = _own_scratch["dir"]
    return f"{base.rstrip('/')}/harrier-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the lineage, and
    what was computed survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, schema: str, work: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` over dictionaries of columns.

    ``work`` gets an iterator of ``{column: pyarrow array}`` and yields
    ``{column: values}`` in the names of ``schema``.
    """
    arrow = _arrow_schema(schema)

    def run(batches):
        def columns():
            for batch in batches:
                if batch.num_rows:
                    yield {n: batch.column(i) for i, n in enumerate(batch.schema.names)}

        for out in work(columns()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def extended(docs: DataFrame, schema: str, work: Callable[[dict], dict]) -> DataFrame:
    """``docs`` with the columns of ``schema``, which ``work`` makes from each batch of ``{column: pyarrow array}``.

    All other columns of the rows, of any type, go along as they are; those of the same names are replaced.
    """
    new = StructType.fromDDL(schema)
    arrow = _arrow_schema(schema)
    others = [f for f in docs.schema.fields if f.name not in new.names]
    names = [f.name for f in others]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                made = work(columns)
                yield pa.RecordBatch.from_arrays([*(columns[n] for n in names), *(pa.array(made[f.name], type=f.type) for f in arrow)], names=[*names, *arrow.names])

    return docs.mapInArrow(run, StructType([*others, *new.fields]))


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "float": pa.float32(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}


def _arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([pa.field(n, _TYPES[t]) for n, t in (part.strip().split(" ", 1) for part in schema.split(","))])


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves ``remainder``. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder


def text_key(text: str = "text") -> Column:
    """128-bit key of a whole text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def one_thread() -> None:
    """For libraries in executors' Python workers, which share cores with other tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
