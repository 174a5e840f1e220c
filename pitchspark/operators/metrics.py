"""Peer metrics (M1-M7): merged sources, per-90 rates, ranks among peers, role vectors, league strength."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    COEFFICIENT_FLOOR,
    COLUMN_METRICS,
    COUNTING_METRICS,
    KEEPER_RATIOS,
    MIN_MINUTES,
    MIN_SHOTS_FACED_FOR_RATIO,
    MIN_SHOTS_FOR_RATIO,
    MIN_VALUED_PLAYERS,
    MIN_VECTOR_NORM,
    NEGATIVE_METRICS,
    ROLE_AXES,
    SHOT_RATIOS,
)
from ..functions import resolve_position_group, rounded
from ..sources.scratch import BROADCAST_ROWS, counted, stored

SEASON_ROW = ("league_id", "club_id", "goals", "assists", "xg", "xa", "key_metrics", "position")


def merge_sources(stats: DataFrame, volume: str = "fbref", expected: str = "understat", min_minutes: int = MIN_MINUTES) -> DataFrame:
    """One row a player and season from the rows of all sources with enough minutes.

    Minutes are the largest; goals, assists and ids come from the volume source, or else from the fullest row;
    expected goals from the expected source alone. Its metrics overlay the volume source's. Of a source's
    rows the one with most minutes counts, then the lowest club.
    """
    order = F.struct(-F.coalesce("minutes", F.lit(0)), F.col("source"), F.col("club_id"))
    row = F.struct(*SEASON_ROW)
    first = F.struct(F.coalesce(F.col("source") != volume, F.lit(True)), order)
    rows = stats.where(F.col("minutes") >= min_minutes).groupBy("player_id", "season")
    rows = rows.agg(F.max("minutes").alias("minutes"), F.min_by(row, first).alias("v"), F.min_by(row, F.when(F.col("source") == expected, order)).alias("e"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    held = lambda m: F.map_filter(F.coalesce(m, empty), lambda k, x: x.isNotNull())
    return rows.select(
        "player_id",
        "season",
        "minutes",
        F.coalesce("v.league_id", "e.league_id").alias("league_id"),
        F.coalesce("v.club_id", "e.club_id").alias("club_id"),
        "v.goals",
        "v.assists",
        "e.xg",
        "e.xa",
        F.map_zip_with(held(F.col("v.key_metrics")), held(F.col("e.key_metrics")), lambda k, a, b: F.coalesce(b, a)).alias("key_metrics"),
        F.coalesce("e.position", "v.position").alias("position_hint"),
    )


def _rates() -> dict[str, Column]:
    """Of each metric what a season row has, per 90 minutes or as a ratio; null where it has none."""
    m = lambda name: F.col("key_metrics")[name]
    rates = {}
    for name in COUNTING_METRICS:
        total = F.col("goals") + F.col("assists") if name == "goal_contributions" else F.col(name) if name in COLUMN_METRICS else m(name)
        rates[name] = rounded(total.cast("double") * 90 / F.col("minutes"), 4)
    rates |= {n: F.when(m("shots") >= MIN_SHOTS_FOR_RATIO, rounded(m(n), 4)) for n in SHOT_RATIOS}
    return rates | {n: F.when(m("shots_on_target_against") >= MIN_SHOTS_FACED_FOR_RATIO, rounded(m(n), 4)) for n in KEEPER_RATIOS}


#: Metrics of a season row, and the columns that hold their values in wide form.
RATED = {n: f"v_{n}" for n in sorted((*COUNTING_METRICS, *SHOT_RATIOS, *KEEPER_RATIOS))}
PEERS = ("season", "position_group")


def keeper_gate(rate: Column, saves: Column, group: Column) -> Column:
    """A keeper without saves keeps his row and loses every metric."""
    return F.when((group != "GK") | saves.isNotNull(), rate)


def wide_rates(merged: DataFrame, min_minutes: int = MIN_MINUTES) -> DataFrame:
    """player_id, season, position_group, league_id, club_id, minutes and a column a metric (``RATED``) of placed rows with enough minutes."""
    rates = _rates()
    rows = merged.where((F.col("minutes") >= min_minutes) & F.col("position_group").isNotNull())
    rows = rows.select("player_id", *PEERS, "league_id", "club_id", "minutes", *[rates[n].alias(c) for n, c in RATED.items()])
    return rows.withColumns({c: keeper_gate(F.col(c), F.col(RATED["saves"]), F.col("position_group")) for n, c in RATED.items()})


def long_rates(wide: DataFrame) -> DataFrame:
    """player_id, season, position_group, metric, value of ``wide_rates``."""
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in RATED.items()])
    return wide.select("player_id", *PEERS, F.explode(entries).alias("r")).select("player_id", *PEERS, "r.metric", "r.value").where("value is not null")


def per90_values(merged: DataFrame, min_minutes: int = MIN_MINUTES) -> DataFrame:
    """Long form: player_id, season, position_group, metric, value of placed players with enough minutes."""
    return long_rates(wide_rates(merged, min_minutes))


def value_ranks(long: DataFrame, by: Sequence[str] = PEERS, negative: Sequence[str] = NEGATIVE_METRICS, most: int = BROADCAST_ROWS) -> DataFrame | None:
    """by, metric, value and its zscore, percentile and sample_size (null in groups of one); None where more than ``most`` values differ.

    Equal values of a group have equal ranks, so a table of them all, counted and small enough, says each row's.
    """
    keys = [*by, "metric"]
    counts = stored(long.groupBy(*keys, "value").agg(F.count("*").alias("n")), "values")
    if counts.count() > most:
        return None
    group = Window.partitionBy(*keys)
    n, v = F.col("n"), F.col("value")
    facts = counts.withColumns({"total": F.sum("n").over(group), "upto": F.sum("n").over(group.orderBy("value")), "low": F.min("value").over(group), "high": F.max("value").over(group)})
    facts = facts.withColumn("mean", F.sum(n * v).over(group) / F.col("total"))
    facts = facts.withColumn("stdev", F.sqrt(F.sum(n * F.pow(v - F.col("mean"), F.lit(2))).over(group) / F.col("total")))
    flat, z, total = F.col("low") == F.col("high"), (v - F.col("mean")) / F.col("stdev"), F.when(F.col("total") >= 2, F.col("total"))
    return stored(facts.select(*keys, "value", *_ranked(z, flat, F.col("upto") - n + n / 2, total, negative)), "ranks")


def _ranked(z: Column, flat: Column, lower: Column, total: Column, negative: Sequence[str]) -> list[Column]:
    """zscore (0 where a group is ``flat``), percentile and sample_size; ``lower``: rows below, and half of the equal ones."""
    less, share = F.col("metric").isin(*negative), lower / total
    z = F.when(flat, 0.0).otherwise(rounded(F.when(less, -1.0).otherwise(1.0) * z, 3))
    return [F.when(total.isNotNull(), z).alias("zscore"), rounded(F.when(less, 1 - share).otherwise(share), 3).alias("percentile"), total.cast("int").alias("sample_size")]


def _local_ranks(keys: Sequence[str]):
    """Adds to the rows of one sorted range how many of their group's rows in it are lower, and how many are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        new_group = np.zeros(table.num_rows, bool)
        new_group[0] = True
        for c in keys:
            codes = table.column(c).chunk(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new_group[1:] |= codes[1:] != codes[:-1]
        value = table.column("value").to_numpy()
        new_value = new_group.copy()
        new_value[1:] |= value[1:] != value[:-1]
        groups, values = np.flatnonzero(new_group), np.flatnonzero(new_value)
        at = np.cumsum(new_value) - 1
        below = values[at] - groups[np.cumsum(new_group) - 1]
        equal = np.diff(np.append(values, table.num_rows))[at]
        yield from table.append_column("below", pa.array(below)).append_column("equal", pa.array(equal)).to_batches(1 << 16)

    return run


def _range_facts(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part, and what the rows of a range need to know of all others, from a row a group and range.

    ``earlier``: rows of the group in ranges before. A value at an end of a range may go on in others: ``low_*`` and
    ``high_*`` say how many rows of the group are lower and equal.
    """
    group = Window.partitionBy(*keys)
    earlier = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(group)
    facts = pieces.withColumns({"earlier": earlier, "total": total, "g_low": F.min("low").over(group), "g_high": F.max("high").over(group), "g_mean": F.sum(F.col("n") * F.col("mean")).over(group) / total})
    spread = F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("g_mean"), F.lit(2))).over(group)
    facts = facts.withColumn("g_stdev", F.sqrt(spread / F.col("total"))).where("total >= 2")
    end = lambda v, below, n: F.struct(F.col(v).alias("v"), below.alias("below"), n.alias("n"))
    low, high = end("low", F.col("earlier"), F.col("n_low")), end("high", F.col("earlier") + F.col("under"), F.col("n") - F.col("under"))
    ends = facts.select(*keys, F.explode(F.when(F.col("low") == F.col("high"), F.array(low)).otherwise(F.array(low, high))).alias("e"))
    whole = ends.groupBy(*keys, "e.v").agg(F.min("e.below").alias("below"), F.sum("e.n").alias("equal"))
    for side in ("low", "high"):
        facts = facts.join(whole.select(*keys, F.col("v").alias(side), F.col("below").alias(f"{side}_below"), F.col("equal").alias(f"{side}_equal")), [*keys, side])
    return facts.drop("n", "mean", "m2", "n_low", "under")


def peer_rank(long: DataFrame, by: tuple[str, ...] = PEERS, negative: tuple[str, ...] = NEGATIVE_METRICS, parts: int | None = None) -> DataFrame:
    """``long`` with zscore, percentile and sample_size among the holders of the metric in its group.

    Percentiles are midpoint ranks. Metrics that one player holds have none. Where few enough values differ, rows look their
    ranks up in ``value_ranks`` and are not shuffled; else, and where ``parts`` is given, they are ranked by ``range_rank``.
    """
    ranks = None if parts else value_ranks(long, by, negative)
    return range_rank(long, by, negative, parts) if ranks is None else long.join(F.broadcast(ranks), [*by, "metric", "value"], "left").select(*long.columns, *RANKS)


RANKS = ("zscore", "percentile", "sample_size")


def range_rank(long: DataFrame, by: Sequence[str] = PEERS, negative: Sequence[str] = NEGATIVE_METRICS, parts: int | None = None) -> DataFrame:
    """``peer_rank`` of any values: the rows are shuffled and sorted once, in ranges of (group, metric, value, player).

    A value that very many have is several ranges. Ranks within a range are counted beside the rows and stored with them;
    what other ranges add comes from a table of one row a group and range. ``parts``: ranges, by default the shuffle
    partitions; a task holds one range.
    """
    keys = [*by, "metric"]
    order = [*keys, "value", *[c for c in long.columns if c not in (*keys, "value")]]
    ordered = long.repartitionByRange(parts or int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    schema = T.StructType([*long.schema.fields, *[T.StructField(c, kind) for c, kind in (("part", T.IntegerType()), ("below", T.LongType()), ("equal", T.LongType()))]])
    rows = stored(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_local_ranks(keys), schema), "ranked")
    n, mean, m2 = F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("m2")
    pieces = rows.groupBy(*keys, "part").agg(n, mean, m2, F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("below") == 0).alias("n_low"), F.max("below").alias("under"))
    facts = counted(stored(_range_facts(stored(pieces, "pieces"), keys), "ranges"))
    found = rows.join(facts, [*keys, "part"], "left")
    pick = lambda c, inside: F.when(F.col("value") == F.col("low"), F.col(f"low_{c}")).when(F.col("value") == F.col("high"), F.col(f"high_{c}")).otherwise(inside)
    lower = pick("below", F.col("earlier") + F.col("below")) + pick("equal", F.col("equal")) / 2
    z = (F.col("value") - F.col("g_mean")) / F.col("g_stdev")
    return found.select(*long.columns, *_ranked(z, F.col("g_low") == F.col("g_high"), lower, F.col("total"), negative))


def role_vector(percentile: Column, group: Column, axes: tuple[str, ...] = ROLE_AXES, min_norm: float = MIN_VECTOR_NORM, held: Column | None = None) -> Column:
    """Percentiles on fixed axes, recentred to [-1, 1]; an absent axis is 0. None for keepers and near the origin.

    ``percentile``: a map, or a struct of the axes with ``held``, whether there is any percentile.
    """
    vector = F.array(*[rounded((F.coalesce(percentile[a], F.lit(0.5)) - 0.5) * 2, 4) for a in axes])
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((group != "GK") & (F.size(percentile) > 0 if held is None else held) & (norm >= min_norm), vector)


def placed(merged: DataFrame, players: DataFrame) -> DataFrame:
    """``merged`` with position_group, from its own label and the player's. ``players``: id, position."""
    career = players.select(F.col("id").alias("player_id"), F.col("position").alias("career_position"))
    return merged.join(career, "player_id").withColumn("position_group", resolve_position_group("position_hint", "career_position"))


def metrics_long(stats: DataFrame, players: DataFrame, season: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed season rows, their ranked metrics in long form)."""
    rows = placed(merge_sources(stats.where(F.col("season") == season) if season else stats), players)
    return rows, ranked_rates(rows)


def ranked_rates(rows: DataFrame) -> DataFrame:
    """The ranked metrics of placed season rows in long form; their rates are worked out and stored once."""
    return peer_rank(long_rates(stored(wide_rates(rows), "rates")))


def compute_metrics(stats: DataFrame, players: DataFrame, season: str | None = None) -> DataFrame:
    """player_id, season, position_group, league_id, club_id, minutes, maps per90, zscore, percentile, sample_size, and embedding."""
    return metrics_of(placed(merge_sources(stats.where(F.col("season") == season) if season else stats), players))


def metrics_of(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``compute_metrics`` of placed season rows.

    Their rates are stored once, a row a season row. Where few enough values differ, each of its metrics looks its ranks up
    in a broadcast table of them, so that no row is shuffled or taken apart; else ranks come in long form and are folded.
    """
    wide = stored(wide_rates(rows, 0), "rates")
    ranks = value_ranks(long_rates(wide), most=most)
    rank = F.array(*[F.col(c).cast("double") for c in RANKS])  # one column, whatever it holds: joins of many fields are not compiled
    if ranks is None:
        keys = ["player_id", *PEERS]
        folded = range_rank(long_rates(wide)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("metric", rank))).alias("_ranks"))
        found = wide.join(folded, keys, "left").select(*wide.columns, *[F.col("_ranks")[n].alias(f"r_{n}") for n in RATED])
    else:
        found = wide
        for n, c in RATED.items():
            own = ranks.where(F.col("metric") == n).select(*PEERS, F.col("value").alias(c), rank.alias(f"r_{n}"))
            found = found.join(F.broadcast(own), [*PEERS, c], "left")
    found = found.withColumns({"metric": F.array(*map(F.lit, RATED)), "value": F.array(*RATED.values()), "rank": F.array(*[f"r_{n}" for n in RATED])})
    held = F.filter(F.arrays_zip("metric", "value", "rank"), lambda e: e["value"].isNotNull())
    percentile = F.struct(*[F.get(f"r_{a}", F.lit(RANKS.index("percentile"))).alias(a) for a in ROLE_AXES])
    some = F.coalesce(*[F.get(f"r_{n}", F.lit(RANKS.index("percentile"))) for n in RATED]).isNotNull()
    found = found.select("player_id", *PEERS, "league_id", "club_id", "minutes", held.alias("held"), role_vector(percentile, F.col("position_group"), held=some).alias("embedding"))
    of = lambda e, i: F.get(e["rank"], F.lit(i))
    pairs = lambda c, value: F.map_from_entries(F.transform(c, lambda e: F.struct(e["metric"], value(e))))
    ranked = F.filter("held", lambda e: of(e, 1).isNotNull())
    maps = [pairs(ranked, lambda e, i=i, c=c: of(e, i).cast("int") if c == "sample_size" else of(e, i)).alias(c) for i, c in enumerate(RANKS)]
    return found.select("player_id", *PEERS, "league_id", "club_id", "minutes", pairs(F.col("held"), lambda e: e["value"]).alias("per90"), *maps, "embedding")


def metrics_report(metrics: DataFrame, merged: DataFrame) -> DataFrame:
    """season, position_group, n (players), n_vectors; and group null: rows without a position."""
    counts = metrics.groupBy(*PEERS).agg(F.count("*").alias("n"), F.count("embedding").alias("n_vectors"))
    skipped = merged.where("position_group is null").groupBy("season").agg(F.count("*").alias("n")).select("season", F.lit(None).cast("string").alias("position_group"), "n", F.lit(0).cast("long").alias("n_vectors"))
    return counts.unionByName(skipped)


def vectors_of(metrics: DataFrame) -> DataFrame:
    return metrics.where("embedding is not null").select("player_id", *PEERS, "embedding")


def medians(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, median of the non-null values of each group, the mean of the two middle ones, exactly.

    Values are first counted in classes (an eighth of a power of two), whose running sums say which class each middle value
    is in; only the values of those classes are counted one by one, and sorted within their class.
    """
    v = F.col(value).cast("double")
    size = F.floor(F.log2(F.abs(v)) * 8)
    bucket = F.when(v > 0, size + 10_000).when(v < 0, -(size + 10_000)).otherwise(0).cast("long")
    counts = df.where(F.col(value).isNotNull()).select(by, v.alias("v"), bucket.alias("bucket")).groupBy(by, "bucket", "v").agg(F.count("*").alias("n"))
    classes = counts.groupBy(by, "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(by)
    upto = F.sum("n").over(group.orderBy("bucket"))
    classes = classes.withColumns({"total": F.sum("n").over(group), "before": upto - F.col("n")})
    middle = F.explode(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)))
    wanted = classes.withColumn("at", middle).where("at >= before and at < before + n").groupBy(by, "bucket", "before", "total").agg(F.collect_list("at").alias("ats"))
    inside = counts.join(wanted, [by, "bucket"])  # one or two classes a group
    last = F.col("before") + F.sum("n").over(Window.partitionBy(by, "bucket").orderBy("v"))
    found = inside.withColumn("last", last).withColumn("hits", F.size(F.filter("ats", lambda a: (a < F.col("last")) & (a >= F.col("last") - F.col("n")))))
    return found.where("hits > 0").groupBy(by).agg(F.max("total").alias("n"), (F.sum(F.col("v") * F.col("hits")) / 2).alias("median"))


def league_strength(leagues: DataFrame, clubs: DataFrame, players: DataFrame, min_players: int = MIN_VALUED_PLAYERS, floor: float = COEFFICIENT_FLOOR, source: str = "market-value") -> DataFrame:
    """``leagues`` with strength_coef of those with enough valued players: the median's logarithm, scaled to [floor, 1]. Others keep theirs."""
    of_club = clubs.where("league_id is not null").select(F.col("id").alias("current_club_id"), "league_id")
    middle = medians(players.where("market_value_eur > 0").join(of_club, "current_club_id"), "league_id", "market_value_eur").withColumnRenamed("n", "n_valued")
    logs = middle.where(F.col("n_valued") >= min_players).select("league_id", "n_valued", F.log10("median").alias("log"))
    span = logs.agg(F.min("log").alias("low"), F.max("log").alias("high"))
    share = F.when(F.col("high") <= F.col("low"), 1.0).otherwise((F.col("log") - F.col("low")) / (F.col("high") - F.col("low")))
    scaled = logs.crossJoin(F.broadcast(span)).select(F.col("league_id").alias("id"), "n_valued", rounded(floor + (1 - floor) * share, 3).alias("new_coef"))
    out = leagues.join(scaled, "id", "left")
    old = F.col("coef_source") if "coef_source" in leagues.columns else F.lit(None).cast("string")
    return out.withColumns({"coef_source": F.when(F.col("new_coef").isNotNull(), source).otherwise(old), "strength_coef": F.coalesce("new_coef", "strength_coef")}).drop("new_coef")
