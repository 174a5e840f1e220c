"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a temporary one serves one machine; a cluster must name it."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (shared or _own_dir()).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and rereads it: cuts lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


#: Stored tables of up to so many narrow rows may be broadcast.
BROADCAST_ROWS = 1 << 20


def counted(df: DataFrame) -> DataFrame:
    """A ``stored`` table, marked for broadcast where its counted size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def released(spark: SparkSession) -> None:
    """Lets Spark remove the broadcasts and shuffle files of frames that are gone: its cleaner waits for the driver's garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Removes the files of ``stored`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
