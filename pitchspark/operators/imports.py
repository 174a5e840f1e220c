"""Import pipelines (J1-J14, C15): projections, lookups, first-row dedupe, counted rejects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLUB_LOGO, LEAGUE_LOGO, VOLUME_COLUMNS
from ..functions import as_date, as_int, as_number, as_text, date_is_exact, season_from_start_year
from ..sources.tables import first_rows


def _present(c: str) -> Column:
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def country_lookup(countries: DataFrame, aliases: DataFrame) -> DataFrame:
    """country_key, country_code: aliases win over English names, those over local names; aliases need a known code."""
    known = countries.select("code")
    rows = aliases.join(known, "code", "left_semi").select(F.col("alias").alias("name"), "code", F.lit(0).alias("rank"))
    rows = rows.unionByName(countries.select("name", "code", F.lit(1).alias("rank"))).unionByName(countries.select(F.col("name_tr").alias("name"), "code", F.lit(2).alias("rank")))
    rows = rows.where("name is not null").select(F.lower("name").alias("country_key"), "code", "rank")
    return rows.groupBy("country_key").agg(F.min_by("code", F.struct("rank", "code")).alias("country_code"))


def resolve_country(df: DataFrame, c: str, countries: DataFrame, aliases: DataFrame, out: str = "country_code") -> DataFrame:
    """``df`` with ``out``: the code of the country that column ``c`` names, or null."""
    lookup = country_lookup(countries, aliases).withColumnRenamed("country_code", out)
    return df.withColumn("country_key", F.lower(F.trim(c))).join(lookup, "country_key", "left").drop("country_key")


def unresolved(df: DataFrame, c: str, out: str = "country_code") -> DataFrame:
    """Distinct values of ``c`` that ``resolve_country`` left without a code."""
    return df.where(F.col(out).isNull() & F.col(c).isNotNull()).select(F.col(c).alias("unresolved")).distinct()


def import_leagues(competitions: DataFrame, countries: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, country_code, tier, transfermarkt_id, logo_url of domestic leagues in known countries."""
    rows = resolve_country(competitions.where("type = 'domestic_league'"), "country_name", countries, aliases)
    return rows.where("country_code is not null").select(
        F.initcap(F.replace("name", F.lit("-"), F.lit(" "))).alias("name"),
        "country_code",
        F.when(F.col("sub_type") == "first_tier", 1).otherwise(2).alias("tier"),
        F.col("competition_id").alias("transfermarkt_id"),
        F.format_string(LEAGUE_LOGO, F.lower("competition_id")).alias("logo_url"),
    )


def import_clubs(clubs: DataFrame, leagues: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """name, league_id, transfermarkt_id, logo_url of clubs whose competition is given, or known."""
    known = leagues.where("transfermarkt_id is not null").select(F.col("transfermarkt_id").alias("competition"), F.col("id").alias("league_id"))
    rows = clubs.withColumnRenamed("domestic_competition_id", "competition")
    rows = rows.where(F.col("competition").isin(*only)).join(known, "competition", "left") if only else rows.join(known, "competition")
    club = as_int("club_id")
    return rows.select("name", "league_id", club.alias("transfermarkt_id"), F.format_string(CLUB_LOGO, club.cast("string")).alias("logo_url"))


def id_map(table: DataFrame, key: str, out: str) -> DataFrame:
    """The source id of each row of a stored table, as ``key``, and its id, as ``out``."""
    return table.where("transfermarkt_id is not null").select(F.col("transfermarkt_id").cast("bigint").alias(key), F.col("id").alias(out))


def import_players(players: DataFrame, club_map: DataFrame, countries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Cleaned rows of the players of imported clubs. ``club_map``: source_club, club_id."""
    rows = players.withColumn("source_club", as_int("current_club_id")).join(club_map, "source_club")
    rows = resolve_country(rows, "country_of_citizenship", countries, aliases, "nationality_code")
    extra = lambda c: F.col(c) if c in players.columns else F.lit(None)
    return rows.select(
        F.col("name").alias("full_name"),
        as_date("date_of_birth").alias("birth_date"),
        "nationality_code",
        _present("position").alias("position"),
        _present("sub_position").alias("sub_position"),
        _present("foot").alias("foot"),
        as_int("height_in_cm").cast("int").alias("height_cm"),
        F.col("club_id").alias("current_club_id"),
        as_number("market_value_in_eur").alias("market_value_eur"),
        as_date("contract_expiration_date").alias("contract_until"),
        as_int("player_id").alias("transfermarkt_id"),
        season_from_start_year(extra("last_season")).alias("last_season"),
        F.nullif(F.trim(extra("image_url").cast("string")), F.lit("")).alias("image_url"),
    )


def import_transfers(transfers: DataFrame, player_map: DataFrame, club_map: DataFrame, source: str = "transfermarkt") -> DataFrame:
    """Moves of known players; clubs are null where unknown. Maps: source_player, player_id and source_club, club_id."""
    rows = transfers.withColumn("source_player", as_int("player_id")).drop("player_id").join(player_map, "source_player")
    for side in ("from", "to"):
        side_map = club_map.select(F.col("source_club").alias(f"{side}_source"), F.col("club_id").alias(f"{side}_club"))
        rows = rows.withColumn(f"{side}_source", as_int(f"{side}_club_id")).join(side_map, f"{side}_source", "left")
    day = as_date("transfer_date")
    season = F.nullif(F.trim("transfer_season"), F.lit("")) if "transfer_season" in transfers.columns else F.lit(None).cast("string")
    return rows.select(
        "player_id",
        F.col("from_club").alias("from_club_id"),
        F.col("to_club").alias("to_club_id"),
        day.alias("transfer_date"),
        as_number("transfer_fee").alias("fee_eur"),
        season.alias("season"),
        F.array(F.lit(source)).alias("sources"),
        date_is_exact(day).alias("date_is_exact"),
    )


def replace_transfers(stored: DataFrame, new: DataFrame, source: str = "transfermarkt") -> DataFrame:
    """Stored moves without those of the batch's players that this source alone wrote, plus the batch."""
    own = F.col("sources").isNull() | ((F.size("sources") == 1) & F.array_contains("sources", source))
    batch = new.select("player_id").distinct().withColumn("_own", F.lit(True))
    kept = stored.withColumn("_own", F.coalesce(own, F.lit(True))).join(batch, ["player_id", "_own"], "left_anti").select(stored.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def import_valuations(valuations: DataFrame, player_map: DataFrame, order: str = "ingest_order") -> DataFrame:
    """player_id, date, value_eur: the first of a player's values on a day; rows without either go."""
    rows = valuations.withColumn("source_player", as_int("player_id")).drop("player_id").join(player_map, "source_player")
    rows = rows.select("player_id", as_date("date").alias("date"), as_number("market_value_in_eur").alias("value_eur"), order)
    return first_rows(rows.where("date is not null and value_eur is not null"), ["player_id", "date"], order).drop(order)


def import_matches(games: DataFrame, leagues: DataFrame, club_map: DataFrame, only: Sequence[str] | None = None, since: int | None = None, order: str = "ingest_order") -> tuple[DataFrame, DataFrame]:
    """(matches, reasons with counts of the rows left out). The first row of a match counts."""
    known = leagues.where("transfermarkt_id is not null").select(F.col("transfermarkt_id").alias("competition_id"), F.col("id").alias("league_id"))
    rows = games.where(F.col("competition_id").isin(*only)) if only else games
    rows = rows.join(known, "competition_id", "left")
    for side in ("home", "away"):
        side_map = club_map.select(F.col("source_club").alias(f"{side}_source"), F.col("club_id").alias(f"{side}_club"))
        rows = rows.withColumn(f"{side}_source", as_int(f"{side}_club_id")).join(side_map, f"{side}_source", "left")
    start = as_int("season")
    early = F.coalesce(start < since, F.lit(True)) if since is not None else F.lit(False)
    reason = F.when(F.col("league_id").isNull(), "league").when(early, "season").when(F.col("home_club").isNull() | F.col("away_club").isNull(), "club").when(as_int("game_id").isNull(), "id")
    rows = rows.withColumn("reason", reason)
    kept = rows.where("reason is null").select(
        as_int("game_id").alias("id"),
        "league_id",
        season_from_start_year("season").alias("season"),
        as_text("round", 64).alias("round"),
        as_date("date").alias("date"),
        F.col("home_club").alias("home_club_id"),
        F.col("away_club").alias("away_club_id"),
        *[as_int(c).cast("int").alias(n) for c, n in (("home_club_goals", "home_goals"), ("away_club_goals", "away_goals"))],
        *[as_text(c, 32).alias(n) for c, n in (("home_club_formation", "home_formation"), ("away_club_formation", "away_formation"))],
        as_text("stadium", 160).alias("stadium"),
        as_int("attendance").cast("int").alias("attendance"),
        as_text("referee", 120).alias("referee"),
        order,
    )
    return first_rows(kept, ["id"], order).drop(order), rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def import_appearances(appearances: DataFrame, matches: DataFrame, player_map: DataFrame, club_map: DataFrame, order: str = "ingest_order") -> tuple[DataFrame, DataFrame]:
    """(appearances, reasons with counts): rows of kept matches and known players, the first of a player and match."""
    rows = appearances.withColumns({"match_id": as_int("game_id"), "source_player": as_int("player_id"), "source_club": as_int("player_club_id")}).drop("player_id")
    rows = rows.join(matches.select(F.col("id").alias("match_id"), F.lit(True).alias("known")), "match_id", "left").join(player_map, "source_player", "left").join(club_map, "source_club", "left")
    rows = rows.withColumn("reason", F.when(F.col("known").isNull(), "match").when(F.col("player_id").isNull(), "player"))
    whole = lambda c, n: as_int(c).cast("int").alias(n)
    good = rows.where("reason is null").select(
        "player_id", "match_id", "club_id", as_date("date").alias("played_on"), whole("minutes_played", "minutes"), whole("goals", "goals"), whole("assists", "assists"), whole("yellow_cards", "yellow_cards"), whole("red_cards", "red_cards"), order
    )
    kept = first_rows(good, ["player_id", "match_id"], order).drop(order)
    again = good.groupBy("player_id", "match_id").agg((F.count("*") - 1).alias("n")).where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("duplicate").alias("reason"), "n")
    return kept, rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).unionByName(again.where("n > 0"))


STAT_KEYS = ("league", "season", "team", "player")


def widen_stats(standard: DataFrame, *extras: DataFrame | None, keys: Sequence[str] = STAT_KEYS) -> DataFrame:
    """``standard`` with the columns that only the other stat tables have, by league, season, team and player.

    A row of ``standard`` stays one row: of several rows of an extra table with its key the first by values counts.
    A missing extra table adds nothing.
    """
    out = standard
    for extra in extras:
        if extra is None:
            continue
        fresh = [c for c in extra.columns if c not in out.columns]
        one = extra.groupBy(*keys).agg(F.min(F.struct(*fresh)).alias("_x")).select(*keys, "_x.*") if fresh else None
        out = out.join(one, list(keys), "left") if one is not None else out
    return out


def concat_leagues(frames: Sequence[DataFrame]) -> DataFrame:
    """All leagues' tables below each other; columns that one lacks are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def metric_map(df: DataFrame, mapping: Mapping[str, str] = VOLUME_COLUMNS) -> Column:
    """map of metric name and value with an entry for each mapped column of ``df`` that is not null."""
    present = {c: n for c, n in mapping.items() if c in df.columns}
    entries = F.array(*[F.struct(F.lit(n).alias("key"), as_number(F.col(f"`{c}`")).alias("value")) for c, n in present.items()]) if present else F.array().cast("array<struct<key:string,value:double>>")
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def build_season_rows(stats: DataFrame, clubs: DataFrame, players: DataFrame, leagues: DataFrame, mapping: Mapping[str, str] = VOLUME_COLUMNS, source: str = "fbref", columns: Mapping[str, str] | None = None) -> DataFrame:
    """Season rows of resolved clubs and players.

    ``clubs``: league, team, club_id. ``players``: player, born, club_id, player_id (null-safe on born).
    ``leagues``: league, league_id. ``columns``: names of minutes, matches, goals, assists, xg and xa in ``stats``.
    """
    names = {"minutes": "Playing Time Min", "matches": "Playing Time MP", "goals": "Performance Gls", "assists": "Performance Ast"} if columns is None else dict(columns)
    rows = stats.withColumn("key_metrics", metric_map(stats, mapping)).join(leagues, "league", "left").join(clubs.where("club_id is not null"), ["league", "team"])
    born = as_int("born").cast("int") if "born" in stats.columns else F.lit(None).cast("int")
    rows = rows.withColumn("_born", born).alias("r").join(players.where("player_id is not null").alias("p"), F.expr("r.player = p.player and r._born <=> p.born and r.club_id = p.club_id"))
    whole = lambda n: (as_int(F.col(f"r.`{names[n]}`")).cast("int") if n in names and names[n] in stats.columns else F.lit(None).cast("int")).alias(n)
    real = lambda n: (as_number(F.col(f"r.`{names[n]}`")) if n in names and names[n] in stats.columns else F.lit(None).cast("double")).alias(n)
    text = lambda c, n: (F.col(f"r.{c}") if c in stats.columns else F.lit(None).cast("string")).alias(n)
    order = [F.col("r.ingest_order")] if "ingest_order" in stats.columns else []
    return rows.select(
        "p.player_id", "r.season", "r.league_id", "r.club_id", F.lit(source).alias("source"), whole("minutes"), whole("matches"), whole("goals"), whole("assists"), real("xg"), real("xa"), "r.key_metrics",
        text("pos" if "pos" in stats.columns else "position", "position"), text("nation", "nation"), *order,
    )


SEASON_KEYS = ("player_id", "season", "club_id", "source")


def dedupe_fullest(rows: DataFrame, keys: Sequence[str] = SEASON_KEYS, order: str = "ingest_order") -> DataFrame:
    """One row a key: the most minutes, the first of those. ``n_dropped`` says how many others there were."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(-F.coalesce("minutes", F.lit(0)), F.col(order)))
    return rows.groupBy(*keys).agg(best.alias("_row"), (F.count("*") - 1).alias("n_dropped")).select(*keys, "_row.*", "n_dropped").drop(order)


def leagues_in(df: DataFrame, leagues: DataFrame) -> DataFrame:
    """league_id of the leagues whose rows were read, whether or not their players matched."""
    return df.select("league").distinct().join(leagues.select("league", "league_id"), "league").select("league_id").distinct()


def all_null_groups(df: DataFrame, by: str, c: str) -> DataFrame:
    """Groups in which a column is null on every row."""
    return df.groupBy(by).agg(F.count(c).alias("n")).where("n = 0").select(by)


def import_shots(shots: DataFrame, clubs: DataFrame, players: DataFrame, matches: DataFrame, order: str = "ingest_order") -> tuple[DataFrame, DataFrame]:
    """(shots, reasons with counts). ``clubs``: league, team, club_id, league_id; ``players``: source_player, club_id, player_id.

    A shot's match is the one of its day in which its club played, at home or away; the highest id if there are several.
    """
    rows = shots.withColumns({"played_on": as_date("date"), "shot": as_int("shot_id"), "source_player": F.col("player_id").cast("string")}).drop("player_id")
    rows = rows.join(clubs, ["league", "team"], "left").join(players, ["source_player", "club_id"], "left")
    rows = rows.withColumn("reason", F.when(F.col("club_id").isNull(), "club").when(F.col("player_id").isNull(), "player").when(F.col("shot").isNull(), "id"))
    sides = matches.select("id", "date", "season", F.explode(F.array("home_club_id", "away_club_id")).alias("club_id")).where("club_id is not null and date is not null")
    by_day = sides.groupBy(F.col("date").alias("played_on"), "season", "club_id").agg(F.max("id").alias("match_id"))
    kept = rows.where("reason is null").join(by_day, ["played_on", "season", "club_id"], "left")
    kept = kept.select(
        F.col("shot").alias("id"), "player_id", "club_id", "league_id", "match_id", "season", "played_on", as_int("minute").cast("int").alias("minute"), as_number("xg").alias("xg"), as_number("location_x").alias("location_x"), as_number("location_y").alias("location_y"),
        as_text("body_part", 32).alias("body_part"), as_text("situation", 32).alias("situation"), as_text("result", 32).alias("result"), F.coalesce(F.lower(as_text("result", 32)) == "goal", F.lit(False)).alias("is_goal"), order,
    )
    return first_rows(kept, ["id"], order).drop(order), rows.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


WORKLIST_KEYS = ("source", "entity", "source_key")


def worklist_append(existing: DataFrame, rejects: DataFrame, order: str = "ingest_order") -> DataFrame:
    """The worklist with each new entity once, as first seen."""
    fresh = first_rows(rejects, WORKLIST_KEYS, order).join(existing.select(*WORKLIST_KEYS), list(WORKLIST_KEYS), "left_anti")
    return existing.unionByName(fresh.select(existing.columns))


def worklist_resolved(df: DataFrame, source: str, entity: str) -> DataFrame:
    """source_key, target_id of the rows that somebody resolved."""
    return df.where((F.col("source") == source) & (F.col("entity") == entity) & (F.trim("target_id") != "")).select("source_key", F.trim("target_id").cast("bigint").alias("target_id"))
