"""The domain's tables as projections of the driver's tables, in SQL that Spark and DuckDB both run.

A projection names its inputs in braces: {lineitem}.
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime.date(2000, 6, 30)

#: Metric columns of the wide season rows, which the metric map is made of.
MAP_METRICS = (
    "shots", "shots_on_target", "shots_on_target_pct", "goals_per_shot", "key_passes", "fouls", "yellow_cards", "interceptions", "tackles_won", "crosses", "fouled", "non_penalty_goals",
    "saves", "shots_on_target_against", "save_pct", "goals_against", "clean_sheets", "clean_sheet_pct",
)

_KEEPER = "CASE WHEN l_partkey % 12 = 0 THEN CAST({} AS DOUBLE) END"
_TAX, _DISCOUNT = "SUM(CAST(ROUND(l_tax * 100) AS BIGINT))", "SUM(CAST(ROUND(l_discount * 100) AS BIGINT))"
_METRICS = {
    "shots": "SUM(l_linenumber) * 6",
    "shots_on_target": "SUM(l_linenumber) * 2",
    "shots_on_target_pct": f"(20 + {_TAX}) * 2",
    "goals_per_shot": f"CAST(1 + {_DISCOUNT} AS DOUBLE) / 40",
    "key_passes": "SUM(l_orderkey % 11)",
    "fouls": _DISCOUNT,
    "yellow_cards": _TAX,
    "interceptions": "SUM(CAST(l_quantity AS BIGINT))",
    "tackles_won": "SUM(CAST(l_quantity AS BIGINT) % 7)",
    "crosses": "SUM(l_linenumber % 3)",
    "fouled": "SUM(l_orderkey % 5)",
    "non_penalty_goals": "SUM(l_linenumber % 4)",
    "saves": "SUM(l_orderkey % 50)",
    "shots_on_target_against": "SUM(l_orderkey % 50) + SUM(l_linenumber) * 5",
    "save_pct": f"50 + {_TAX}",
    "goals_against": "SUM(l_linenumber)",
    "clean_sheets": "COUNT(*)",
    "clean_sheet_pct": f"20 + {_DISCOUNT}",
}
_metric = lambda name: (_KEEPER if name in MAP_METRICS[-6:] else "CAST({} AS DOUBLE)").format(_METRICS[name]) + f" AS {name}"

TABLES = {
    "countries": "SELECT CONCAT('R', CAST(r_regionkey AS STRING)) AS code, r_name AS name, CONCAT(LOWER(r_name), ' tr') AS name_tr, CASE WHEN r_regionkey <> 4 THEN CAST(r_regionkey * 10 AS DOUBLE) END AS lat, CAST(r_regionkey AS DOUBLE) AS lng FROM {region}",
    "aliases": "SELECT CONCAT('alias ', r_name) AS alias, CONCAT('R', CAST(r_regionkey AS STRING)) AS code FROM {region}",
    "leagues": "SELECT n_nationkey AS id, n_name AS name, CONCAT('R', CAST(n_regionkey AS STRING)) AS country_code, 1 + n_nationkey % 2 AS tier, CASE WHEN n_nationkey % 6 <> 5 THEN CAST(n_nationkey AS DOUBLE) / 24 END AS strength_coef, CASE WHEN n_nationkey % 8 <> 7 THEN CONCAT('L', CAST(n_nationkey AS STRING)) END AS transfermarkt_id FROM {nation}",
    "clubs": "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS league_id, s_suppkey + 700000 AS transfermarkt_id, CASE WHEN s_suppkey % 3 = 0 THEN 5000 + s_suppkey END AS api_football_id FROM {supplier}",
    "players": (
        "SELECT p_partkey AS id, CONCAT(p_name, CASE WHEN p_partkey % 3 = 0 THEN CONCAT(' ', LOWER(p_type)) ELSE '' END) AS full_name, "
        "CASE p_type WHEN 'STANDARD' THEN 'Defender' WHEN 'PROMO' THEN 'Midfield' WHEN 'LARGE' THEN 'Attack' WHEN 'SMALL' THEN 'Goalkeeper' WHEN 'MEDIUM' THEN 'MF,FW' END AS position, LOWER(p_brand) AS sub_position, "
        "1976 + p_size % 28 AS birth_year, CASE WHEN p_partkey % 2 = 0 THEN CAST(make_date(1976 + p_size % 28, CAST(1 + p_partkey % 12 AS INT), CAST(1 + p_partkey % 28 AS INT)) AS DATE) END AS birth_date, "
        "CASE WHEN p_partkey % 4 <> 0 THEN CONCAT('R', CAST(p_partkey % 5 AS STRING)) END AS nationality_code, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 10 END AS current_club_id, "
        "CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice * (1 + p_size) END AS market_value_eur, CASE p_partkey % 3 WHEN 0 THEN '2000' WHEN 1 THEN '1999' END AS last_season, "
        "CASE WHEN p_partkey % 3 <> 1 THEN p_partkey + 800000 END AS transfermarkt_id, CASE WHEN p_partkey % 5 = 1 THEN 9000000 + p_partkey END AS api_football_id, CASE WHEN p_partkey % 2 = 1 THEN CONCAT('img', p_brand) END AS image_url FROM {part}"
    ),
    "season_stats": (
        "SELECT l_partkey AS player_id, CAST(year(l_shipdate) AS STRING) AS season, s_nationkey AS league_id, l_suppkey AS club_id, CASE l_returnflag WHEN 'A' THEN 'fbref' WHEN 'N' THEN 'understat' ELSE 'other' END AS source, "
        "CAST(SUM(l_quantity) * 36 AS INT) AS minutes, CAST(COUNT(*) * 2 AS INT) AS matches, CAST(SUM(l_linenumber) AS INT) AS goals, CAST(COUNT(*) AS INT) AS assists, "
        f"CASE WHEN l_returnflag = 'N' THEN CAST({_DISCOUNT} AS DOUBLE) / 5 END AS xg, CASE WHEN l_returnflag = 'N' THEN CAST({_TAX} AS DOUBLE) / 5 END AS xa, "
        "CASE l_partkey % 6 WHEN 0 THEN 'GK' WHEN 1 THEN 'DF' WHEN 2 THEN 'MF,FW' WHEN 3 THEN 'DF,MF' WHEN 4 THEN 'FW' END AS position, CASE WHEN l_partkey % 8 <> 0 THEN CONCAT('f', CAST(l_partkey % 7 AS STRING), CASE WHEN l_partkey % 36 = 4 THEN l_returnflag ELSE '' END) END AS nation, "
        + ", ".join(map(_metric, MAP_METRICS))
        + " FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY l_partkey, year(l_shipdate), s_nationkey, l_suppkey, l_returnflag"
    ),
    "matches": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 <> 49 THEN o_orderkey % 25 END AS league_id, CAST(year(o_orderdate) AS STRING) AS season, CAST(o_orderdate AS DATE) AS date, o_orderkey % 10 AS home_club_id, (o_orderkey * 7 + 1) % 10 AS away_club_id FROM {orders}",
    "appearances": "SELECT l_partkey AS player_id, l_orderkey AS match_id, MIN(CASE WHEN l_suppkey % 13 <> 0 THEN l_suppkey % 10 END) AS club_id, CAST(MAX(l_shipdate) AS DATE) AS played_on, CAST(SUM(l_quantity) * 2 AS INT) AS minutes, CAST(SUM(l_linenumber) AS INT) AS goals, CAST(COUNT(*) AS INT) AS assists FROM {lineitem} GROUP BY l_partkey, l_orderkey",
    "transfers": (
        "SELECT o_orderkey AS id, o_custkey AS player_id, CAST(o_orderdate AS DATE) AS transfer_date, CAST(o_totalprice AS DECIMAL(14,2)) AS fee_eur, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 10 END AS from_club_id, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey * 3 + 1) % 10 END AS to_club_id, "
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'Raise' WHEN '2-HIGH' THEN 'Loan' WHEN '5-LOW' THEN NULL ELSE 'Transfer' END AS transfer_type, CASE WHEN o_orderkey % 2 = 0 THEN CONCAT(SUBSTRING(CAST(year(o_orderdate) AS STRING), 3, 2), '/', 'x') ELSE CAST(year(o_orderdate) AS STRING) END AS season, o_orderkey % 4 <> 0 AS date_is_exact FROM {orders}"
    ),
    "people": "SELECT c_custkey AS id, c_name AS full_name, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 10 END AS current_club_id, c_acctbal AS market_value_eur, CASE c_custkey % 3 WHEN 0 THEN '2001' WHEN 1 THEN '1999' END AS last_season FROM {customer}",
    "market_values": "SELECT o_custkey AS player_id, CAST(o_orderdate AS DATE) AS date, MIN(CAST(o_totalprice AS DECIMAL(14,2))) AS value_eur FROM {orders} GROUP BY o_custkey, CAST(o_orderdate AS DATE)",
    "shots": "SELECT event_id AS id, user_id AS player_id, user_id % 10 AS club_id, event_id % 6 AS league_id, CAST(ts AS DATE) AS played_on, value / 500 AS xg, CASE WHEN event_id % 37 <> 0 THEN CAST(event_id % 101 AS DOUBLE) / 100 END AS location_x, CAST((event_id * 7) % 103 AS DOUBLE) / 102 AS location_y, CASE WHEN event_type = 'purchase' THEN 'Goal' ELSE event_type END AS result, event_type = 'purchase' OR event_id % 500 = 3 AS is_goal FROM {events}",
    "runs": "SELECT event_type AS source, ts AS started_at, CASE WHEN value < 20 THEN 'failed' ELSE 'success' END AS status, event_id AS rows_written FROM {events}",
    "worklist": "SELECT c_mktsegment AS source, CASE WHEN c_nationkey % 2 = 0 THEN 'club' ELSE 'player' END AS entity, CAST(c_custkey % 300 AS STRING) AS source_key, c_name AS source_name, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS STRING) WHEN c_custkey % 4 = 1 THEN ' ' ELSE '' END AS target_id, c_custkey AS ingest_order FROM {customer}",
}


def inputs(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str, dealt: dict[str, str] | None = None) -> DataFrame:
    """A table of the domain, over the driver's tables in ``sf_dir``. ``dealt``: inputs shuffled first, by the column named."""
    sql = TABLES[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in inputs(sql)}
    return spark.sql(sql, **frames | {t: frames[t].repartition(c) for t, c in (dealt or {}).items()})


def season_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season rows with their metric map. Their lines are dealt by player, once: what groups by player shuffles no wide rows."""
    wide = table(spark, sf_dir, "season_stats", {"lineitem": "l_partkey"})
    pairs = F.array(*[F.struct(F.lit(m).alias("key"), F.col(m).alias("value")) for m in MAP_METRICS])
    return wide.withColumn("key_metrics", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())))


def with_tables(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB SQL: ``body`` after the named tables (and ``extra`` ones) as common table expressions."""
    parts = [f"{n} AS ({re.sub(r'[{}]', '', TABLES[n])})" for n in names.split()]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


__all__ = ["AS_OF", "MAP_METRICS", "TABLES", "inputs", "season_rows", "table", "with_tables"]
