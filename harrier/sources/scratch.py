"""Intermediate tables that survive the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame


@cache
def _own() -> str:
    """A folder of this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="harrier-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir``, which driver and executors share, and read again. That cuts its lineage.

    Where the setting is absent, in local mode only, a temporary folder is taken.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own()
    path = f"{base.rstrip('/')}/harrier-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
