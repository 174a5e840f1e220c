"""Replacing, merging and logging (S6-S9)."""

from __future__ import annotations

import contextlib
import datetime
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import dropped, stored


def replace_slice(existing: DataFrame, new: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` without the rows whose ``keys`` are in ``scope``, plus ``new``. An empty scope deletes nothing."""
    return existing.join(scope.select(*keys).distinct(), list(keys), "left_anti").select(existing.columns).unionByName(new)


def write_slice(new: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Overwrites exactly the partitions that ``new`` has; others stay."""
    new.repartition(*partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def first_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key with the lowest ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, "_row.*").select(df.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str], order: str | None = None) -> DataFrame:
    """Existing rows with ``update`` columns from ``new`` where a key matches (a null overwrites too), and the other new rows.

    Columns outside ``update`` keep their stored values: curated ones survive. ``new`` needs one row a key,
    or ``order`` to pick the first.
    """
    if order:
        new = first_rows(new, keys, order).drop(order)
    old, fresh = existing.withColumn("_old", F.lit(True)), new.withColumn("_new", F.lit(True))
    joined = old.alias("o").join(fresh.alias("n"), list(keys), "full")
    columns = []
    for c in existing.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c not in new.columns:
            columns.append(F.col(f"o.{c}"))
        elif c in update:
            columns.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            columns.append(F.when(F.col("o._old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return joined.select(columns)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Existing rows, and of each new key the first row."""
    fresh = first_rows(new, keys, order).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh.select(existing.columns))


def merge_partitions(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], partitions: Sequence[str], update: Sequence[str] | None = None, order: str | None = None) -> int:
    """Merges ``new`` into the table at ``path`` and returns how many partitions were rewritten; all others keep their files.

    Its ``partitions`` are among ``keys``, so a key's rows, old or new, are in one partition. The partitions that
    ``new`` has, of which the driver lists as many as a directory listing would, are a filter on the stored table: only
    those are read, merged (``upsert`` with ``update`` columns, else ``insert_ignore`` by ``order``), kept in the
    scratch folder, and written over what they were read from. A run that breaks off before that write leaves the table as
    it was; one that breaks off in it is made good by running again.
    """
    if not set(partitions) <= set(keys):
        raise ValueError("a key must say which partition it is in")
    if update is None and order is None:
        raise ValueError("update columns, or an order of new rows, are needed")
    new = stored(new, "new")
    touched = [tuple(r) for r in new.select(*partitions).distinct().collect()]
    if not touched:
        return 0
    table = spark.read.parquet(path)
    own = lambda values: reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(partitions, values, strict=True)])
    old = table.where(reduce(Column.__or__, map(own, touched)))
    merged = upsert(old, new, keys, update, order) if update is not None else insert_ignore(old, new, keys, order)
    merged = stored(merged, "merged")
    write_slice(merged, path, partitions)
    dropped(new, merged)
    return len(touched)


RUNS_SCHEMA = "source string, started_at timestamp, finished_at timestamp, status string, rows_written long, notes string"


@dataclass
class RunStats:
    rows: int = 0
    notes: list[str] = field(default_factory=list)

    def add(self, n: int) -> None:
        self.rows += n

    def note(self, text: str) -> None:
        self.notes.append(text)


@contextlib.contextmanager
def run_log(spark: SparkSession, source: str, path: str) -> Iterator[RunStats]:
    """Appends one row to the log at ``path`` when the block ends: status, rows written, notes or the error."""
    stats, started, status = RunStats(), datetime.datetime.now(datetime.UTC), "failed"
    try:
        yield stats
        status = "success"
    except BaseException as e:
        stats.note(f"{type(e).__name__}: {e}")
        raise
    finally:
        row = (source, started, datetime.datetime.now(datetime.UTC), status, stats.rows, " | ".join(stats.notes) or None)
        spark.createDataFrame([row], RUNS_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def latest_rows(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each group that is last in ``order``, by aggregation."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*by, "_row.*").select(df.columns)


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence, n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")
