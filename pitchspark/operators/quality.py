"""Data quality (Q1-Q8)."""

from __future__ import annotations

import datetime
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..constants import INTEGRITY_RULES, MIN_MINUTES, NULL_RULES
from ..sources.tables import latest_rows


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, n."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])


def match_coverage(matches: DataFrame, leagues: DataFrame, top: int = 10) -> DataFrame:
    """Matches and first and last season of each league: the ``top`` by matches."""
    by = matches.groupBy("league_id").agg(F.count_distinct("id").alias("matches"), F.min("season").alias("first_season"), F.max("season").alias("last_season"))
    return by.join(leagues.select(F.col("id").alias("league_id"), "name"), "league_id").select("name", "matches", "first_season", "last_season").orderBy(F.desc("matches"), "name").limit(top)


def source_distribution(stats: DataFrame, min_minutes: int = MIN_MINUTES) -> DataFrame:
    """Rows, rows with xg, rows with enough minutes and clubs of each source and season."""
    return stats.groupBy("source", "season").agg(F.count("*").alias("n"), F.count("xg").alias("with_xg"), F.count_if(F.col("minutes") >= min_minutes).alias("enough_minutes"), F.count_distinct("club_id").alias("clubs"))


def cross_source(stats: DataFrame, sources: Sequence[str] = ("fbref", "understat")) -> DataFrame:
    """Rows of each source and players of each season."""
    return stats.groupBy("season").agg(*[F.count_if(F.col("source") == s).alias(f"{s}_rows") for s in sources], F.count_distinct("player_id").alias("players"))


def null_ratios(tables: Mapping[str, DataFrame], rules: Sequence[tuple] = NULL_RULES) -> DataFrame:
    """table_name, rule, ratio, threshold, violated: one pass a table."""
    out = []
    for name, df in tables.items():
        own = [r for r in rules if r[0] == name]
        if own:
            wide = df.agg(F.count("*").alias("n"), *[F.count_if(F.expr(test)).alias(f"v{i}") for i, (_, _, test, _) in enumerate(own)])
            cells = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"v{i}").alias("v"), F.lit(float(limit)).alias("threshold")) for i, (_, rule, _, limit) in enumerate(own)])
            out.append(wide.select("n", F.explode(cells).alias("c")).select(F.lit(name).alias("table_name"), "c.rule", F.try_divide(F.col("c.v").cast("double"), "n").alias("ratio"), "c.threshold"))
    rows = reduce(DataFrame.unionByName, out)
    return rows.withColumn("violated", F.coalesce(F.col("ratio") > F.col("threshold"), F.lit(False)))


def integrity(tables: Mapping[str, DataFrame], as_of: datetime.date, rules: Sequence[tuple] = INTEGRITY_RULES) -> DataFrame:
    """table_name, rule, violations, tolerance, violated: one pass a table, one join for denormalised dates.

    ``player_season_stats`` counts goals against ``shots``, a column or an entry of key_metrics.
    """
    out = []
    for name, df in tables.items():
        own = [r for r in rules if r[0] == name]
        if name == "player_season_stats" and "shots" not in df.columns:
            df = df.withColumn("shots", F.col("key_metrics")["shots"])
        if own:
            wide = df.withColumn("as_of", F.lit(as_of)).agg(*[F.count_if(F.expr(test)).alias(f"v{i}") for i, (_, _, test, _) in enumerate(own)])
            cells = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"v{i}").alias("violations"), F.lit(limit).alias("tolerance")) for i, (_, rule, _, limit) in enumerate(own)])
            out.append(wide.select(F.explode(cells).alias("c")).select(F.lit(name).alias("table_name"), "c.*"))
    if "player_match_stats" in tables and "matches" in tables:
        pair = tables["player_match_stats"].select("match_id", "played_on").join(tables["matches"].select(F.col("id").alias("match_id"), "date"), "match_id")
        n = pair.agg(F.count_if(~F.col("played_on").eqNullSafe(F.col("date"))).alias("violations"))
        out.append(n.select(F.lit("player_match_stats").alias("table_name"), F.lit("date differs from the match").alias("rule"), "violations", F.lit(0).alias("tolerance")))
    if "ingest_runs" in tables:
        last = latest_rows(tables["ingest_runs"].select("source", "started_at", "status"), ["source"], ["started_at", "status"])
        out.append(last.agg(F.count_if(F.col("status") == "failed").alias("violations")).select(F.lit("ingest_runs").alias("table_name"), F.lit("last run failed").alias("rule"), "violations", F.lit(0).alias("tolerance")))
    return reduce(DataFrame.unionByName, out).withColumn("violated", F.col("violations") > F.col("tolerance"))


class LoadChecks:
    """Counts rows, nulls and rule violations while a load job writes its tables: the reports need no scan of their own.

    ``watch`` each table just before it is written, so that every task that writes counts its rows once; parts of one table
    add up. Reports wait for the writes. Rules that need two tables or a table's last rows stay with ``integrity``.
    """

    def __init__(self, as_of: datetime.date, null_rules: Sequence[tuple] = NULL_RULES, rules: Sequence[tuple] = INTEGRITY_RULES):
        self.as_of, self.null_rules, self.rules = as_of, null_rules, rules
        self.seen: list[tuple[str, str, Observation]] = []

    def watch(self, name: str, df: DataFrame, called: str | None = None) -> DataFrame:
        """``df`` unchanged. ``name`` is the table's in the rules, ``called`` in the row counts."""
        shots = name == "player_season_stats" and "shots" not in df.columns
        wide = df.withColumn("shots", F.col("key_metrics")["shots"]) if shots else df
        test = lambda t: F.count_if(F.expr(re.sub(r"\bas_of\b", f"date'{self.as_of}'", t)))
        counts = [test(r[2]).alias(f"{kind}{i}") for kind, rules in (("v", self.null_rules), ("w", self.rules)) for i, r in enumerate(rules) if r[0] == name]
        seen = Observation()
        self.seen.append((name, called or name, seen))
        out = wide.observe(seen, F.count("*").alias("n"), *counts)
        return out.drop("shots") if shots else out

    def _sums(self, by: int) -> dict[str, dict[str, int]]:
        sums: dict[str, dict[str, int]] = {}
        for row in self.seen:
            own = sums.setdefault(row[by], {})
            for k, v in row[2].get.items():
                own[k] = own.get(k, 0) + v
        return sums

    def row_counts(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, x["n"]) for t, x in self._sums(1).items()], "table_name string, n long")

    def null_ratios(self, spark: SparkSession) -> DataFrame:
        rows = [(r[0], r[1], x[f"v{i}"] / x["n"] if x["n"] else None, float(r[3])) for t, x in self._sums(0).items() for i, r in enumerate(self.null_rules) if r[0] == t]
        out = spark.createDataFrame(rows, "table_name string, rule string, ratio double, threshold double")
        return out.withColumn("violated", F.coalesce(F.col("ratio") > F.col("threshold"), F.lit(False)))

    def integrity(self, spark: SparkSession) -> DataFrame:
        rows = [(r[0], r[1], x[f"w{i}"], r[3]) for t, x in self._sums(0).items() for i, r in enumerate(self.rules) if r[0] == t]
        return spark.createDataFrame(rows, "table_name string, rule string, violations long, tolerance int").withColumn("violated", F.col("violations") > F.col("tolerance"))


def worklist_status(df: DataFrame) -> DataFrame:
    """pending and resolved of each source and entity."""
    done = F.coalesce(F.trim("target_id") != "", F.lit(False))
    return df.groupBy("source", "entity").agg(F.count_if(~done).alias("pending"), F.count_if(done).alias("resolved"))


class QualityError(RuntimeError):
    """A strict run found violations."""


def enforce(checks: DataFrame) -> None:
    """Raises with the violated rules; ``checks`` has a row a rule."""
    bad = checks.where("violated").select("table_name", "rule").orderBy("table_name", "rule").collect()
    if bad:
        raise QualityError("; ".join(f"{r.table_name}: {r.rule}" for r in bad))
