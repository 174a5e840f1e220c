"""Discovery over metrics (D1-D17). Tables come from ``metrics.compute_metrics``."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (
    CONTEXT_METRICS,
    KEEPER_METRICS,
    LABELLED_METRICS,
    LEAGUE_FLOOR,
    MAX_AGE,
    MAX_COMPARE,
    MIN_MINUTES,
    MIN_RADAR_AXES,
    MIN_SAMPLE,
    MOMENTUM_DAYS,
    NOTABLE_GAP,
    PERFORMANCE_WEIGHT,
    POPULATION_DRIFT,
    RADAR_AXES,
    STRENGTH_FLOOR,
    WEAKNESS_CEILING,
    YOUNGEST,
    YOUTH_WEIGHT,
)
from ..functions import age_at, birth_bounds, rounded
from ..sources.scratch import stored
from ..sources.tables import top_rows

KEYS = ["player_id", "season", "position_group"]


def to_long(metrics: DataFrame) -> DataFrame:
    """player_id, season, position_group, metric, percentile, per90, sample_size of every ranked metric."""
    rows = metrics.select(*KEYS, "per90", "sample_size", F.explode("percentile").alias("metric", "percentile"))
    return rows.select(*KEYS, "metric", "percentile", F.col("per90")[F.col("metric")].alias("per90"), F.col("sample_size")[F.col("metric")].alias("sample_size"))


def _labelled(c: Column) -> Column:
    return c.isin(*LABELLED_METRICS)


def notes(long: DataFrame, above: bool = True, limit: int | None = None, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """The metrics furthest from the median on one side, ranked: strengths from the floor up (no context metrics), weaknesses from the ceiling down."""
    keeper = F.col("metric").isin(*KEEPER_METRICS)
    rows = long.where((F.col("sample_size") >= min_sample) & _labelled(F.col("metric")) & (keeper == (F.col("position_group") == "GK")))
    if above:
        rows = rows.where(~F.col("metric").isin(*CONTEXT_METRICS) & (F.col("percentile") >= STRENGTH_FLOOR))
    else:
        rows = rows.where(F.col("percentile") <= WEAKNESS_CEILING)
    order = F.desc("percentile") if above else F.asc("percentile")
    return top_rows(rows, KEYS, [order, "metric"], limit or (3 if above else 2), "rank")


def differences(pairs: DataFrame, long: DataFrame, limit: int = 3, min_sample: int = MIN_SAMPLE) -> DataFrame:
    """The widest percentile gaps of (candidate_id, reference_id) pairs in a (season, position_group)."""
    side = lambda who, p: long.where((F.col("sample_size") >= min_sample) & _labelled(F.col("metric"))).select(F.col("player_id").alias(who), "season", "position_group", "metric", F.col("percentile").alias(p))
    rows = pairs.join(side("candidate_id", "candidate_percentile"), ["candidate_id", "season", "position_group"]).join(side("reference_id", "reference_percentile"), ["reference_id", "season", "position_group", "metric"])
    rows = rows.withColumn("gap", rounded(F.col("candidate_percentile") - F.col("reference_percentile"), 3)).where(F.abs("gap") >= NOTABLE_GAP)
    return top_rows(rows, ["candidate_id", "reference_id", "season", "position_group"], [F.desc(F.abs("gap")), "metric"], limit, "rank")


def default_season(metrics: DataFrame) -> DataFrame:
    """The season with most rows; the later label of equals."""
    return metrics.groupBy("season").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("season")).limit(1)


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Each player's row of the last season by label."""
    rest = [c for c in metrics.columns if c != "player_id"]
    return metrics.groupBy("player_id").agg(F.max_by(F.struct(*rest), F.struct("season", "position_group")).alias("r")).select("player_id", "r.*")


def seasons_of(metrics: DataFrame) -> DataFrame:
    """player_id, seasons, newest first."""
    return metrics.groupBy("player_id").agg(F.sort_array(F.collect_set("season"), False).alias("seasons"))


def axes_table(df: DataFrame, axes: Mapping[str, Sequence[str]] = RADAR_AXES) -> DataFrame:
    """position_group, metric, axis (order): a fixed small table, in the session of ``df``."""
    return df.sparkSession.createDataFrame([(g, m, i) for g, ms in axes.items() for i, m in enumerate(ms)], "position_group string, metric string, axis int")


def on_axes(long: DataFrame, axes: Mapping[str, Sequence[str]] = RADAR_AXES) -> DataFrame:
    """``long`` restricted to its group's axes, with their order."""
    place = F.lit(None).cast("int")
    for group, names in axes.items():
        for i, name in enumerate(names):
            place = F.when((F.col("position_group") == group) & (F.col("metric") == name), i).otherwise(place)
    return long.withColumn("axis", place).where("axis is not null")


def radar(long: DataFrame, axes: Mapping[str, Sequence[str]] = RADAR_AXES, min_sample: int = MIN_SAMPLE, least: int = MIN_RADAR_AXES) -> DataFrame:
    """KEYS and an array of the group's measured axes in order; players with fewer than ``least`` have none."""
    rows = on_axes(long, axes).where(F.col("sample_size") >= min_sample)
    spokes = F.sort_array(F.collect_list(F.struct("axis", "metric", "percentile", "per90", "sample_size")))
    return rows.groupBy(*KEYS).agg(spokes.alias("axes")).where(F.size("axes") >= least)


def profile_strength(long: DataFrame, axes: Mapping[str, Sequence[str]] = RADAR_AXES, min_sample: int = MIN_SAMPLE, least: int = MIN_RADAR_AXES) -> DataFrame:
    """KEYS, profile (mean percentile of the measured axes, null under ``least``) and axes_measured (ranked axes, whatever their sample)."""
    big = F.col("sample_size") >= min_sample
    mean = F.sum(F.when(big, F.floor(F.col("percentile") * 1000 + 0.5))) / 1000 / F.count_if(big)
    return on_axes(long, axes).groupBy(*KEYS).agg(F.when(F.count_if(big) >= least, mean).alias("profile"), F.count("*").alias("axes_measured"))


def candidates(
    metrics: DataFrame, players: DataFrame, clubs: DataFrame, leagues: DataFrame, as_of: datetime.date, season: str | None = None, group: str | None = None,
    max_value: float | None = None, max_age: int | None = None, league_ids: Sequence[int] | None = None,
) -> DataFrame:
    """Metric rows with player, current club and the league of the season row. Filters: value (unpriced are out), age, league of the current club."""
    rows = metrics if season is None else metrics.where(F.col("season") == season)
    rows = rows if group is None else rows.where(F.col("position_group") == group)
    people = players
    if max_value is not None:
        people = people.where(F.col("market_value_eur") <= max_value)
    if max_age is not None:
        _, after = birth_bounds(None, max_age, as_of)
        people = people.where((F.col("birth_date") > after) | (F.col("birth_date").isNull() & (F.col("birth_year") >= F.year(after))))
    people = people.select(F.col("id").alias("player_id"), "full_name", "birth_date", "birth_year", "market_value_eur", "current_club_id")
    club = clubs.select(F.col("id").alias("current_club_id"), F.col("name").alias("club_name"), F.col("league_id").alias("club_league_id"))
    league = leagues.select(F.col("id").alias("league_id"), F.col("name").alias("league_name"), "strength_coef")
    rows = rows.join(people, "player_id").join(club, "current_club_id", "left").join(league, "league_id", "left")
    return rows.where(F.col("club_league_id").isin(*league_ids)) if league_ids else rows


#: Rows of a tile, about: what a task of the similarity search compares with as many others.
TILE = 2048
#: What distances may differ by from rounding.
SLACK = 1e-8


def _unit(embedding: pd.Series) -> np.ndarray:
    x = np.array(embedding.tolist(), dtype=np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _typed(columns: dict) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(v) if len(v) else pd.Series([], dtype=object) for c, v in columns.items()})


def _beside(rows: DataFrame, small_side: DataFrame, block: list[str], tile: int, schema: str, work) -> DataFrame:
    """``work(rows, small side)`` for about ``tile`` rows of a block at a time, each with the whole small side of that block."""
    sizes = rows.groupBy(*block).agg(F.ceil(F.count("*") / tile).cast("int").alias("_parts"))
    left = rows.join(sizes, block).withColumn("_part", F.pmod(F.xxhash64("player_id"), F.col("_parts")).cast("int")).drop("_parts")
    right = small_side.join(sizes, block).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    right = right.select(*[F.col(c).alias(f"s_{c}") for c in right.columns])  # names of its own: both sides may come of one table
    return left.groupBy(*block, "_part").cogroup(right.groupBy(*[f"s_{c}" for c in block], "s__part")).applyInPandas(work, schema)


def tiled(rows: DataFrame, block: list[str], tile: int) -> DataFrame:
    """``rows`` with p, s: the number of the nearest pivot of the block, and a part of that pivot's rows where they are many.

    Pivots are about one row in ``tile``, chosen by hash, and the first row of each block. Rows without a direction have
    pivot -1.
    """
    h = F.xxhash64("player_id", F.lit("pivot"))
    first = rows.groupBy(*block).agg(F.min_by(F.struct("player_id", "embedding"), F.struct(h, "player_id")).alias("x")).select(*block, "x.*")
    pivots = rows.where(F.pmod(h, F.lit(tile)) == 0).select(*block, "player_id", "embedding").unionByName(first).distinct()

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return left.drop(columns="_part").assign(p=pd.Series([], dtype="int64"))
        x, y = _unit(left["embedding"]), _unit(right.sort_values("s_player_id")["s_embedding"])
        near = np.argmax(x @ y.T, axis=1)
        near[~np.any(x, axis=1)] = -1
        return left.drop(columns="_part").assign(p=near)

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", p long"
    out = stored(_beside(rows, pivots, block, tile, schema, assign), "tiles")
    sizes = out.groupBy(*block, "p").agg(F.ceil(F.count("*") / tile).cast("int").alias("_parts"))
    return out.join(sizes, [*block, "p"]).withColumn("s", F.pmod(F.xxhash64("player_id", F.lit("part")), F.col("_parts")).cast("int")).drop("_parts")


def tile_visits(vectors: DataFrame, pool: DataFrame | None = None, k: int = 10, block: Sequence[str] = ("season", "position_group"), tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(player_id, block, embedding, p, s: the tiles that may hold one of a row's ``k`` nearest; the candidates with their tiles).

    A first pass gives every row the distance of its k-th nearest in its own tile. No row of another tile is nearer than the
    angle to that tile's centre less the tile's radius, so a tile where that is further than the k-th nearest so far is
    passed over: exactly, whatever the data. Rows without a direction are as far from all, and visit every tile.
    """
    block = list(block)
    rows = vectors.select("player_id", *block, "embedding")
    chosen = rows if pool is None else rows.join(pool.select("player_id", *block).distinct(), ["player_id", *block], "left_semi")
    marked = rows.withColumn("found", F.lit(True)) if pool is None else rows.join(chosen.select("player_id", *block).distinct().withColumn("found", F.lit(True)), ["player_id", *block], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    tiles = stored(tiled(marked, block, tile), "tiled")
    types = dict(tiles.dtypes)
    kinds = ", ".join(f"{c} {types[c]}" for c in block)

    def own(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        x, found = _unit(df["embedding"]), df["found"].to_numpy()
        ids, others = df["player_id"].to_numpy(), df["player_id"].to_numpy()[found]
        far = 1 - x @ x[found].T
        far[ids[:, None] == others[None, :]] = np.inf
        n = far.shape[1]
        return df[["player_id", *block, "embedding"]].assign(kth=np.partition(far, k - 1, axis=1)[:, k - 1] if n >= k else np.inf)

    def shape(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        x = _unit(df["embedding"])
        centre = x.mean(0)
        size = np.linalg.norm(centre)
        centre = centre / size if size > 0 else np.zeros_like(centre)
        radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max()) if key[len(block)] >= 0 else np.inf
        return pd.DataFrame([[*key, centre.tolist(), radius]], columns=[*block, "p", "s", "centre", "radius"])

    so_far = tiles.groupBy(*block, "p", "s").applyInPandas(own, f"player_id long, {kinds}, embedding array<double>, kth double")
    shapes = tiles.where("found").groupBy(*block, "p", "s").applyInPandas(shape, f"{kinds}, p long, s int, centre array<double>, radius double")

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["player_id", *block, "embedding"]
        if left.empty or right.empty:
            return _typed({c: [] for c in [*names, "p", "s"]})
        x = _unit(left["embedding"])
        angle = np.arccos(np.clip(x @ np.array(right["s_centre"].tolist()).T, -1, 1)) - right["s_radius"].to_numpy()
        least = 1 - np.cos(np.maximum(angle, 0))
        row, col = np.nonzero((least <= left["kth"].to_numpy()[:, None] + SLACK) | ~np.any(x, axis=1)[:, None])
        return left[names].iloc[row].assign(p=right["s_p"].to_numpy()[col], s=right["s_s"].to_numpy()[col])

    visits = _beside(stored(so_far, "so-far"), stored(shapes, "shapes"), block, tile, f"player_id long, {kinds}, embedding array<double>, p long, s int", visit)
    return stored(visits, "visits"), tiles.where("found").drop("found")


def nearest_rows(vectors: DataFrame, pool: DataFrame | None = None, k: int = 10, block: Sequence[str] = ("season", "position_group"), tile: int = TILE) -> DataFrame:
    """block, player_id, rank, candidate_id, distance (nine digits): of every row its ``k`` nearest in the block, not itself.

    Exact: a block is cut into tiles of like rows, each row visits the tiles that ``tile_visits`` can't rule out, and the best
    of those count. A task compares about ``tile`` rows with about as many; no block meets in one task.
    """
    block = list(block)
    visits, cands = tile_visits(vectors, pool, k, block, tile)
    types = dict(vectors.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in block) + ", player_id long, candidate_id long, distance double"
    where = [*block, "p", "s"]
    sizes = visits.groupBy(*where).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    refs = visits.join(sizes, where).withColumn("part", F.pmod(F.xxhash64("player_id", F.lit("visit")), F.col("parts")).cast("int")).select("player_id", *where, "part", "embedding")
    every = cands.join(sizes, where).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # renamed, since both sides of a cogroup over one table need columns of their own
    every = every.select(*[F.col(c).alias(f"c_{c}") for c in ("player_id", *where, "part", "embedding")])

    none = pd.DataFrame({c: pd.Series([], dtype=object) for c in block} | {"player_id": pd.Series([], dtype="int64"), "candidate_id": pd.Series([], dtype="int64"), "distance": pd.Series([], dtype="float64")})

    def nearest(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return none
        right = right.rename(columns=lambda c: c.removeprefix("c_"))
        ids, own = right["player_id"].to_numpy(), left["player_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        far = np.round(1 - _unit(left["embedding"]) @ _unit(right["embedding"])[order].T, 9)
        far[own[:, None] == ids[order][None, :]] = np.inf
        n = min(k, far.shape[1])
        # all that are as near as the n-th stay, so the stable sort below sees every tie
        bound = np.partition(far, n - 1, axis=1)[:, n - 1 : n]
        rows, columns = np.nonzero((far <= bound) & np.isfinite(far))
        best = pd.DataFrame({"r": rows, "player_id": own[rows], "candidate_id": ids[order][columns], "distance": far[rows, columns]})
        if best.empty:
            return none
        best = best.sort_values(["r", "distance", "candidate_id"]).groupby("r").head(k)
        for c, v in zip(block, key, strict=False):
            best[c] = v
        return best[[*block, "player_id", "candidate_id", "distance"]]

    by = [*where, "part"]
    partial = refs.groupBy(*by).cogroup(every.groupBy(*[f"c_{c}" for c in by])).applyInPandas(nearest, schema)
    return top_rows(partial, ["player_id", *block], ["distance", "candidate_id"], k, "rank")


def similar_players(vectors: DataFrame, pool: DataFrame | None = None, k: int = 10, block: Sequence[str] = ("season", "position_group"), tile: int = TILE) -> DataFrame:
    """For every row of ``vectors`` (player_id, block, embedding) its ``k`` nearest by cosine distance within the block, not itself.

    ``pool``: player_id and block of the rows that may be found (all by default). Exact. Equal vectors of a block are one
    class, named by its lowest id that may be found, else its lowest; only classes are compared (``nearest_rows``). A class offers its k + 1 lowest ids, and a row
    takes the best of what its own and the k nearest classes offer, less itself. Distances are compared at nine digits, lower
    ids first among equals, and given with four.
    """
    block = list(block)
    rows = vectors.select("player_id", *block, "embedding")
    marked = rows.withColumn("found", F.lit(True)) if pool is None else rows.join(pool.select("player_id", *block).distinct().withColumn("found", F.lit(True)), ["player_id", *block], "left")
    named = marked.groupBy(*block, "embedding").agg(F.coalesce(F.min(F.when(F.col("found"), F.col("player_id"))), F.min("player_id")).alias("class"))
    member = stored(marked.join(named, [*block, "embedding"]), "members")
    offers = stored(top_rows(member.where("found").select(*block, "class", "player_id"), [*block, "class"], ["player_id"], k + 1), "offers")
    classes = stored(member.where("player_id = class").select("player_id", *block, "embedding"), "classes")
    offering = offers.select(F.col("class").alias("player_id"), *block).distinct()
    near = nearest_rows(classes, None if pool is None else offering, k, block, tile).select(*block, F.col("player_id").alias("class"), F.col("candidate_id").alias("other"), "distance")
    self = F.when(F.exists("embedding", lambda x: x != 0), 0.0).otherwise(1.0)  # what has no direction is as far from its like as from all
    own = classes.select(*block, F.col("player_id").alias("class"), F.col("player_id").alias("other"), self.alias("distance"))
    offered = near.unionByName(own).join(offers.select(*block, F.col("class").alias("other"), F.col("player_id").alias("candidate_id")), [*block, "other"])
    best = top_rows(offered, [*block, "class"], ["distance", "candidate_id"], k + 1)
    lists = best.groupBy(*block, "class").agg(F.sort_array(F.collect_list(F.struct("distance", "candidate_id"))).alias("best"))
    mine = member.join(lists, [*block, "class"]).select("player_id", *block, F.slice(F.filter("best", lambda x: x["candidate_id"] != F.col("player_id")), 1, k).alias("best"))
    out = mine.select("player_id", *block, F.posexplode("best").alias("at", "x"))
    return out.select("player_id", *block, (F.col("at") + 1).alias("rank"), "x.candidate_id", rounded(F.col("x.distance"), 4).alias("distance"))


def progression(metrics: DataFrame, long: DataFrame) -> DataFrame:
    """Every season of a player, oldest first (``place``): minutes, league, club, profile, n_axes, population, and on each row the player's leading_group and profile_delta."""
    big = F.col("sample_size") >= MIN_SAMPLE
    fields = on_axes(long).groupBy(*KEYS).agg(F.count_if(big).alias("n_axes"), F.max(F.when(big, F.col("sample_size"))).alias("population"))
    rows = metrics.select(*KEYS, "minutes", "league_id", "club_id").join(profile_strength(long), KEYS, "left").join(fields, KEYS, "left")
    blank = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    order = Window.partitionBy("player_id").orderBy("season", "position_group")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"n_axes": blank("n_axes"), "population": blank("population"), "place": F.row_number().over(order)})
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("player_id", "position_group")))
    rows = rows.withColumn("leading_group", F.first("position_group").over(Window.partitionBy("player_id").orderBy(F.desc("_n"), "position_group")))
    delta = F.last("profile", True).over(whole) - F.first("profile", True).over(whole)
    rows = rows.withColumn("profile_delta", rounded(delta, 3))
    return rows.select(*KEYS, "place", "minutes", "league_id", "club_id", rounded(F.col("profile"), 3).alias("profile"), "n_axes", "population", "leading_group", "profile_delta")


def progression_flags(prog: DataFrame, drift: float = POPULATION_DRIFT) -> DataFrame:
    """player_id, single_season, population_drifted, several_groups."""
    seen = F.when(F.col("population") > 0, F.col("population"))
    by = prog.groupBy("player_id").agg(F.count("*").alias("n"), F.max(seen).alias("hi"), F.min(seen).alias("lo"), F.count_distinct("position_group").alias("groups"))
    return by.select("player_id", (F.col("n") == 1).alias("single_season"), F.coalesce(F.col("hi") / F.col("lo") >= drift, F.lit(False)).alias("population_drifted"), (F.col("groups") > 1).alias("several_groups"))


def compare(sets: DataFrame, metrics: DataFrame, long: DataFrame, most: int = MAX_COMPARE) -> DataFrame:
    """set_id, n_players, axes, chart_axes, dropped, position_groups.

    ``sets``: set_id, place, player_id, and season (null: the player's latest). Only the first ``most`` distinct ids count, and of
    those the ones with a metric row. Axes are what all of them have: radar order first where all share a group, then by name.
    """
    wanted = sets.groupBy("set_id", "player_id", "season").agg(F.min("place").alias("place"))
    wanted = top_rows(wanted, ["set_id"], ["place"], most)
    latest = metrics.groupBy("player_id").agg(F.max("season").alias("latest"))
    rows = wanted.join(latest, "player_id").withColumn("season", F.coalesce("season", "latest"))
    keyed = metrics.select(*KEYS)
    rows = rows.join(keyed, ["player_id", "season"])
    measured = long.where((F.col("sample_size") >= MIN_SAMPLE) & _labelled(F.col("metric")) & ~F.col("metric").isin(*CONTEXT_METRICS))
    heads = rows.groupBy("set_id").agg(F.count_distinct("player_id").alias("n_players"), F.sort_array(F.collect_set("position_group")).alias("position_groups"))
    held = rows.select("set_id", *KEYS).join(measured, KEYS).groupBy("set_id", "metric").agg(F.count_distinct("player_id").alias("n")).join(heads, "set_id")
    group = F.when(F.size("position_groups") == 1, F.get("position_groups", F.lit(0)))
    place = F.lit(None).cast("int")
    for g, names in RADAR_AXES.items():
        for i, name in enumerate(names):
            place = F.when((group == g) & (F.col("metric") == name), i).otherwise(place)
    held = held.withColumns({"shared": F.col("n") == F.col("n_players"), "axis": place})
    names = lambda arr: F.transform(arr, lambda s: s["metric"])
    ordered = F.sort_array(F.collect_list(F.when(F.col("shared"), F.struct(F.coalesce("axis", F.lit(99)).alias("o"), F.col("metric"), F.col("axis").isNotNull().alias("r")))))
    by = held.groupBy("set_id").agg(ordered.alias("a"), F.sort_array(F.collect_list(F.when(~F.col("shared"), F.col("metric")))).alias("dropped"))
    empty = F.array().cast("array<string>")
    on_radar = names(F.filter("a", lambda s: s["r"]))
    axes = names(F.col("a"))
    chart = F.when(F.size(on_radar) >= MIN_RADAR_AXES, on_radar).when(F.size(axes) >= MIN_RADAR_AXES, F.slice(axes, 1, 6)).otherwise(empty)
    out = heads.join(by.select("set_id", axes.alias("axes"), chart.alias("chart_axes"), "dropped"), "set_id", "left")
    return out.select("set_id", "n_players", *[F.coalesce(c, empty).alias(c) for c in ("axes", "chart_axes", "dropped")], "position_groups")


def rising_score(profile: Column, age: Column, coef: Column) -> dict[str, Column]:
    """score, league_weight and youth; all null without a profile or under the youngest age."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    ok = profile.isNotNull() & (age >= YOUNGEST)
    weight = LEAGUE_FLOOR + (1 - LEAGUE_FLOOR) * clamp(F.coalesce(coef, F.lit(0.0)))
    youth = clamp((MAX_AGE + 1 - age) / F.lit(float(max(1, MAX_AGE + 1 - YOUNGEST))))
    score = PERFORMANCE_WEIGHT * profile * weight + YOUTH_WEIGHT * youth
    return {"score": F.when(ok, rounded(score, 4)), "league_weight": F.when(ok, rounded(weight, 3)), "youth": F.when(ok, rounded(youth, 3))}


def value_momentum(values: DataFrame, as_of: datetime.date, days: int = MOMENTUM_DAYS) -> DataFrame:
    """player_id, from_eur, to_eur, change_ratio, points over the last ``days``; needs two values, the first above 0."""
    recent = values.where((F.col("date") >= F.lit(as_of - datetime.timedelta(days=days))) & F.col("value_eur").isNotNull())
    by = recent.groupBy("player_id").agg(F.min_by("value_eur", "date").alias("from_eur"), F.max_by("value_eur", "date").alias("to_eur"), F.count("*").alias("points"))
    return by.where("points >= 2 and from_eur > 0").select("player_id", "from_eur", "to_eur", rounded(F.col("to_eur") / F.col("from_eur"), 3).alias("change_ratio"), "points")


def rising(cands: DataFrame, long: DataFrame, values: DataFrame, as_of: datetime.date, max_age: int = MAX_AGE, limit: int = 25, by: Sequence[str] = ()) -> DataFrame:
    """The best scored young candidates, of all or of each group of ``by``, with their value momentum beside the score."""
    rows = cands.withColumn("age", age_at("birth_date", "birth_year", as_of)).where(F.col("age") <= max_age).join(profile_strength(long), KEYS)
    rows = rows.withColumns(rising_score(F.col("profile"), F.col("age"), F.col("strength_coef"))).where("score is not null")
    rows = rows.select(*KEYS, "age", "score", rounded(F.col("profile"), 3).alias("profile"), "league_weight", "youth", "axes_measured")
    order = [F.desc("score"), F.asc("player_id"), F.asc("season")]
    best = top_rows(rows, by, order, limit) if by else rows.orderBy(*order).limit(limit)
    return best.join(value_momentum(values, as_of).select("player_id", "change_ratio"), "player_id", "left")


def discover(cands: DataFrame, long: DataFrame, metric: str | None = None, min_percentile: float = STRENGTH_FLOOR, min_minutes: int = MIN_MINUTES, min_sample: int = MIN_SAMPLE, limit: int = 25, by: Sequence[str] = ()) -> DataFrame:
    """Candidates above a percentile of one metric, best first; without a metric, by their own best strength."""
    rows = cands.where(F.col("minutes") >= min_minutes).select(*KEYS, "minutes")
    if metric:
        bar = long.where((F.col("metric") == metric) & (F.col("percentile") >= min_percentile) & (F.col("sample_size") >= min_sample)).select(*KEYS, "metric", "percentile")
    else:
        bar = notes(long, True, 1).select(*KEYS, "metric", "percentile")
    rows = rows.join(bar, KEYS)
    order = [F.desc("percentile"), F.asc("player_id"), F.asc("season")]
    return top_rows(rows, by, order, limit) if by else rows.orderBy(*order).limit(limit)


def metric_coverage(metrics: DataFrame) -> DataFrame:
    """metric, n: rows that hold each metric."""
    return metrics.select(F.explode(F.map_keys("percentile")).alias("metric")).groupBy("metric").agg(F.count("*").alias("n"))


def season_options(metrics: DataFrame) -> DataFrame:
    return metrics.select("season").distinct().orderBy(F.desc("season"))
