"""Snapshots, reference files and nested feeds (S1-S5)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require_columns(df: DataFrame, required: Iterable[str], name: str = "table") -> DataFrame:
    """``df``, or a ValueError that names missing and present columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}; it has {df.columns}")
    return df


def read_snapshot(spark: SparkSession, path: str, required: Iterable[str] = ()) -> DataFrame:
    """A CSV with a header; all columns are text, with ``ingest_order`` of the rows added."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False)
    return require_columns(df, required, path).withColumn("ingest_order", F.monotonically_increasing_id())


def read_reference_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small CSV whose '#' lines and byte-order mark are ignored; empty text is null."""
    df = spark.read.csv(path, header=True, schema=schema, comment="#", encoding="UTF-8")
    return df.select([F.nullif(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


MOVES_SCHEMA = (
    "response array<struct<player: struct<id: bigint, name: string>, transfers: array<struct<date: string, type: string, "
    "teams: struct<out: struct<id: bigint, name: string>, in: struct<id: bigint, name: string>>>>>>"
)
SQUADS_SCHEMA = "response array<struct<team: struct<id: bigint, name: string>, players: array<struct<id: bigint, name: string, age: int, number: int, position: string, photo: string>>>>"


def flatten_moves(feed: DataFrame) -> DataFrame:
    """A row for each ``response[].transfers[]`` of a transfer feed."""
    entries = feed.select(F.explode("response").alias("e"))
    rows = entries.select(F.col("e.player.id").alias("api_id"), F.trim("e.player.name").alias("name"), F.explode("e.transfers").alias("t"))
    end = lambda side: [F.col(f"t.teams.{side}.id").alias(f"{side}_team"), F.col(f"t.teams.{side}.name").alias(f"{side}_name")]
    return rows.select("api_id", "name", F.col("t.date").alias("date"), F.trim("t.type").alias("type"), *end("out"), *end("in"))


def flatten_squads(feed: DataFrame) -> DataFrame:
    """A row for each player of a squad feed's first response."""
    first = feed.select(F.get("response", F.lit(0)).alias("r"))
    return first.select(F.col("r.team.id").alias("team_id"), F.explode("r.players").alias("p")).select("team_id", F.col("p.id").alias("api_id"), "p.name", "p.position", "p.photo")


def flatten_headers(columns: Iterable[str | tuple[str, str]]) -> list[str]:
    """('Standard', 'Sh') is 'Standard Sh'; parts called 'Unnamed...' and empty ones go."""
    flat = []
    for c in columns:
        parts = [str(p).strip() for p in (c if isinstance(c, tuple) else (c,))]
        flat.append(" ".join(p for p in parts if p and not re.match("unnamed", p, re.IGNORECASE)))
    return flat


def require_labelled(df: DataFrame, label: str, sample: str) -> DataFrame:
    """``df``, or a ValueError with some values of ``sample`` where ``label`` is null."""
    bad = [r[0] for r in df.where(F.col(label).isNull()).select(sample).distinct().orderBy(sample).limit(5).collect()]
    if bad:
        raise ValueError(f"rows without {label}, such as {bad}")
    return df


