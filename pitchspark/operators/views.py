"""Form, shots, squads, leagues, transfers and search (F1-F17)."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FORM_MATCHES, FORM_WINDOW, MAX_ARCS, MIN_QUERY, NON_MOVES, PER_KIND
from ..functions import birth_bounds, fold, normalise_season, per_90, rounded, zone_of
from ..sources.scratch import counted, stored
from ..sources.tables import latest_rows, top_rows


def _named(clubs: DataFrame, key: str, out: str) -> DataFrame:
    return clubs.select(F.col("id").alias(key), F.col("name").alias(out))


def match_rows(appearances: DataFrame, matches: DataFrame, clubs: DataFrame, leagues: DataFrame, n: int = FORM_MATCHES) -> DataFrame:
    """Each player's last ``n`` appearances with club, league, opponent and home flag; ``place`` runs from the oldest.

    Ranks come from the appearances' own columns, so all but the last ``n`` of a player go before anything is looked up; a
    semi-join leaves out appearances without a match.
    """
    known = appearances.join(matches.select(F.col("id").alias("match_id")), "match_id", "left_semi")
    last = top_rows(known.select("player_id", "match_id", "played_on", "club_id", "minutes", "goals", "assists"), ["player_id"], [F.desc_nulls_last("played_on"), F.desc("match_id"), "club_id"], n, "_rank")
    rows = last.join(matches.select(F.col("id").alias("match_id"), "league_id", "home_club_id", "away_club_id"), "match_id")
    home = F.coalesce(F.col("home_club_id") == F.col("club_id"), F.lit(False))
    rows = rows.withColumns({"is_home": home, "opponent_id": F.when(home, F.col("away_club_id")).otherwise(F.col("home_club_id"))})
    rows = rows.join(_named(clubs, "club_id", "club_name"), "club_id", "left").join(_named(clubs, "opponent_id", "opponent_name"), "opponent_id", "left").join(_named(leagues, "league_id", "league_name"), "league_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("player_id").orderBy(F.desc("_rank"))))
    return rows.select("player_id", "match_id", "played_on", count("minutes"), count("goals"), count("assists"), "club_name", "league_name", "opponent_name", "is_home", "place")


def form_series(rows: DataFrame, metric: str = "minutes", window: int = FORM_WINDOW) -> DataFrame:
    """A value for each match row and its mean over the last ``window`` rows. Metrics: minutes, goals, assists, goal_contributions."""
    value = (F.col("goals") + F.col("assists") if metric == "goal_contributions" else F.col(metric)).cast("double")
    trailing = Window.partitionBy("player_id").orderBy("place").rowsBetween(1 - window, 0)
    return rows.withColumn("value", value).select("player_id", "match_id", "played_on", "place", "value", rounded(F.avg("value").over(trailing), 3).alias("rolling"))


def season_trend(appearances: DataFrame, matches: DataFrame) -> DataFrame:
    """Totals and gated rates of each player and season."""
    rows = appearances.join(matches.where("season is not null").select(F.col("id").alias("match_id"), "season"), "match_id")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    by = rows.groupBy("player_id", "season").agg(F.count("match_id").alias("matches"), total("minutes"), total("goals"), total("assists"))
    return by.select("player_id", "season", "matches", "minutes", rounded(F.col("minutes") / F.col("matches"), 1).alias("minutes_per_match"), "goals", "assists", per_90("goals", "minutes").alias("goals_per_90"), per_90("assists", "minutes").alias("assists_per_90"))


def trend_direction(series: DataFrame) -> DataFrame:
    """player_id, rising: whether the last third of the rolling series is at least as high as the first; needs two points."""
    whole = Window.partitionBy("player_id")
    rows = series.where("rolling is not null").withColumns({"i": F.row_number().over(whole.orderBy("place")), "n": F.count("*").over(whole)})
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    mean = lambda when: F.avg(F.when(when, F.col("rolling")))
    by = rows.where("n >= 2").groupBy("player_id").agg(mean(F.col("i") <= third).alias("early"), mean(F.col("i") > F.col("n") - third).alias("late"))
    return by.select("player_id", (rounded(F.col("late"), 6) >= rounded(F.col("early"), 6)).alias("rising"))


def shot_totals(shots: DataFrame, by: Sequence[str] = ("player_id",)) -> DataFrame:
    """shots, goals, xg and goals less xg."""
    t = shots.groupBy(*by).agg(F.count("*").alias("shots"), F.count_if("is_goal").alias("goals"), F.coalesce(F.sum(F.col("xg").cast("decimal(18,6)")), F.lit(0)).cast("double").alias("xg"))
    return t.select(*by, "shots", "goals", rounded(F.col("xg"), 2).alias("xg"), rounded(F.col("goals") - F.col("xg"), 2).alias("goals_minus_xg"))


def shot_zones(shots: DataFrame, by: Sequence[str] = ("player_id",), n: int | None = None) -> DataFrame:
    """Shots, goals, xg and xg a shot of each zone, over all or the last ``n`` shots of a group; ``rank`` puts most shots first."""
    rows = top_rows(shots, by, [F.desc_nulls_last("played_on"), F.desc("id")], n) if n else shots
    t = rows.withColumn("zone", zone_of("location_x", "location_y")).groupBy(*by, "zone").agg(F.count("*").alias("shots"), F.count_if("is_goal").alias("goals"), F.coalesce(F.sum(F.col("xg").cast("decimal(18,6)")), F.lit(0)).cast("double").alias("xg"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("shots"), "zone"))
    return t.select(*by, "zone", "shots", "goals", rounded(F.col("xg"), 2).alias("xg"), rounded(F.col("xg") / F.col("shots"), 3).alias("xg_per_shot"), rank.alias("rank"))


def squads(clubs: DataFrame, players: DataFrame, stats: DataFrame) -> DataFrame:
    """club_id, player_id, source, place: live players; else those of the club's latest season; else registered ones."""
    live = players.where("current_club_id is not null and api_football_id is not null").select(F.col("current_club_id").alias("club_id"), F.col("id").alias("player_id"), F.lit(0).alias("rank"))
    latest = stats.where("club_id is not null").groupBy("club_id").agg(F.max("season").alias("season"))
    season = stats.join(latest, ["club_id", "season"]).select("club_id", "player_id", F.lit(1).alias("rank")).distinct()
    filed = players.where("current_club_id is not null").select(F.col("current_club_id").alias("club_id"), F.col("id").alias("player_id"), F.lit(2).alias("rank"))
    # a club with any season rows never falls back to registered players
    every = live.union(season).union(filed).join(clubs.select(F.col("id").alias("club_id")), "club_id", "left_semi")
    best = every.groupBy("club_id").agg(F.min("rank").alias("rank"))
    rows = every.join(best, ["club_id", "rank"]).join(players.select(F.col("id").alias("player_id"), "full_name", "market_value_eur"), "player_id")
    place = F.row_number().over(Window.partitionBy("club_id").orderBy(F.desc_nulls_last("market_value_eur"), "full_name", "player_id"))
    source = F.when(F.col("rank") == 0, "live").when(F.col("rank") == 1, "season").otherwise("registered")
    return rows.select("club_id", "player_id", source.alias("source"), place.alias("place"))


def _of_league(clubs: DataFrame) -> DataFrame:
    return clubs.where("league_id is not null").select(F.col("id").alias("club_id"), F.col("league_id").alias("club_league_id"))


def league_clubs(leagues: DataFrame, clubs: DataFrame, players: DataFrame, stats: DataFrame) -> DataFrame:
    """league_id, club_id, squad_size, squad_source, place of each league's members.

    Members appeared in the league's latest season, or else (no season) are registered clubs with players, or else have a
    live squad; a league with none of these keeps all its clubs at size 0. The live size counts, then that of the members' source.
    """
    of = _of_league(clubs)
    live = players.where("api_football_id is not null").groupBy(F.col("current_club_id").alias("club_id")).agg(F.count("*").alias("live")).where("club_id is not null").join(of, "club_id")
    rows = stats.select("player_id", "season", "club_id").join(of, "club_id")
    latest = rows.groupBy("club_league_id").agg(F.max("season").alias("season"))
    seasonal = rows.join(latest, ["club_league_id", "season"]).groupBy("club_league_id", "club_id").agg(F.count_distinct("player_id").alias("size"))
    filed = players.where("current_club_id is not null").groupBy(F.col("current_club_id").alias("club_id")).agg(F.count("*").alias("size")).join(of, "club_id").join(latest.select("club_league_id"), "club_league_id", "left_anti")
    sized = seasonal.select("club_league_id", "club_id", "size").unionByName(filed.select("club_league_id", "club_id", "size"))
    has_sized, has_live = sized.select("club_league_id").distinct(), live.select("club_league_id").distinct()
    members = sized.join(live.select("club_id", "live"), "club_id", "left").select("club_league_id", "club_id", "size", "live")
    members = members.unionByName(live.join(has_sized, "club_league_id", "left_anti").select("club_league_id", "club_id", F.lit(0).cast("long").alias("size"), "live"))
    bare = of.join(has_sized, "club_league_id", "left_anti").join(has_live, "club_league_id", "left_anti").select("club_league_id", "club_id", F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("live"))
    members = members.unionByName(bare).withColumn("squad_size", F.when(F.col("live") > 0, F.col("live")).otherwise(F.col("size")))
    source = has_live.withColumn("l", F.lit(True)).join(latest.select("club_league_id", F.lit(True).alias("s")), "club_league_id", "full")
    members = members.join(source, "club_league_id", "left").join(_named(clubs, "club_id", "name"), "club_id").join(leagues.select(F.col("id").alias("club_league_id")), "club_league_id", "left_semi")
    label = F.when(F.col("l"), "live").when(F.col("s"), "season").otherwise("registered")
    place = F.row_number().over(Window.partitionBy("club_league_id").orderBy(F.desc("squad_size"), "name", "club_id"))
    return members.select(F.col("club_league_id").alias("league_id"), "club_id", "squad_size", label.alias("squad_source"), place.alias("place"))


def league_counts(leagues: DataFrame, clubs: DataFrame, players: DataFrame, stats: DataFrame) -> DataFrame:
    """league_id, season, clubs, players of the latest season; registered ones, with a null season, where there is none."""
    of = _of_league(clubs)
    rows = stats.select("player_id", "season", "club_id").join(of, "club_id")
    latest = rows.groupBy("club_league_id").agg(F.max("season").alias("season"))
    seasonal = rows.join(latest, ["club_league_id", "season"]).groupBy("club_league_id", "season").agg(F.count_distinct("club_id").alias("clubs"), F.count_distinct("player_id").alias("players"))
    filed = of.join(players.select(F.col("current_club_id").alias("club_id"), "id"), "club_id", "left").groupBy("club_league_id").agg(F.count_distinct("club_id").alias("r_clubs"), F.count_distinct("id").alias("r_players"))
    both = filed.join(seasonal, "club_league_id", "left").join(leagues.select(F.col("id").alias("club_league_id")), "club_league_id", "left_semi")
    return both.select(F.col("club_league_id").alias("league_id"), "season", F.coalesce("clubs", "r_clubs").alias("clubs"), F.coalesce("players", "r_players").alias("players"))


def league_nodes(leagues: DataFrame, countries: DataFrame, clubs: DataFrame, players: DataFrame, stats: DataFrame) -> DataFrame:
    """Leagues in a country with a centroid, strongest first (``place``), with counts."""
    spot = countries.where("lat is not null and lng is not null").select(F.col("code").alias("country_code"), "lat", "lng")
    rows = leagues.select(F.col("id").alias("league_id"), "name", "country_code", "tier", "strength_coef").join(spot, "country_code").join(league_counts(leagues, clubs, players, stats), "league_id", "left")
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("strength_coef"), "league_id"))  # a row a league: one task is enough
    return rows.select("league_id", "name", "country_code", "tier", "strength_coef", "lat", "lng", "season", F.coalesce("clubs", F.lit(0)).alias("clubs"), F.coalesce("players", F.lit(0)).alias("players"), place.alias("place"))


def countries_with_leagues(leagues: DataFrame, countries: DataFrame) -> DataFrame:
    return countries.where("lat is not null").join(leagues.select(F.col("country_code").alias("code")), "code", "left_semi")


def transfer_arcs(transfers: DataFrame, clubs: DataFrame, leagues: DataFrame, countries: DataFrame, season: str | None = None, top: int = MAX_ARCS) -> DataFrame:
    """Moves and fees between different countries with centroids: the ``top`` by moves, then codes."""
    place = clubs.join(leagues.select(F.col("id").alias("league_id"), "country_code"), "league_id").join(countries.where("lat is not null").select(F.col("code").alias("country_code")), "country_code").select("id", "country_code")
    side = lambda s: place.select(F.col("id").alias(f"{s}_club_id"), F.col("country_code").alias(f"{s}_country"))
    rows = transfers.where(F.col("season") == season) if season else transfers
    # moves are counted by clubs first: the lookups see pairs of clubs, not moves
    rows = rows.groupBy("from_club_id", "to_club_id").agg(F.count("*").alias("n"), F.sum("fee_eur").alias("fee"))
    rows = rows.join(side("from"), "from_club_id").join(side("to"), "to_club_id").where("from_country != to_country")
    return rows.groupBy("from_country", "to_country").agg(F.sum("n").alias("transfers"), F.sum("fee").alias("total_fee_eur")).orderBy(F.desc("transfers"), "from_country", "to_country").limit(top)


def _real_moves(transfers: DataFrame) -> DataFrame:
    return transfers.where(F.col("transfer_date").isNotNull() & ~F.lower(F.coalesce("transfer_type", F.lit(""))).isin(*NON_MOVES))


def transfer_board(
    transfers: DataFrame, players: DataFrame, clubs: DataFrame, as_of: datetime.date, since: datetime.date | None = None, until: datetime.date | None = None,
    league_id: int | None = None, club_id: int | None = None, direction: str = "all", min_fee: float | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """One page of real moves, newest first: exact dates, high fees and high ids first on a day."""
    rows = _real_moves(transfers).where(F.col("transfer_date") <= F.lit(until or as_of))
    if since is not None:
        rows = rows.where(F.col("transfer_date") >= F.lit(since))
    if min_fee is not None:
        rows = rows.where(F.col("fee_eur") >= min_fee)
    names = lambda s: clubs.select(F.col("id").alias(f"{s}_club_id"), F.col("name").alias(f"{s}_name"), F.col("league_id").alias(f"{s}_league"))
    rows = rows.join(names("from"), "from_club_id", "left").join(names("to"), "to_club_id", "left")
    if club_id is not None or league_id is not None:
        ends = {s: F.col(f"{s}_club_id") == club_id if club_id is not None else F.col(f"{s}_league") == league_id for s in ("from", "to")}
        rows = rows.where({"in": ends["to"], "out": ends["from"]}.get(direction, ends["from"] | ends["to"]))
    rows = rows.join(players.select(F.col("id").alias("player_id"), "full_name"), "player_id")
    page = rows.orderBy(F.desc("transfer_date"), F.desc("date_is_exact"), F.desc_nulls_last("fee_eur"), F.desc("id")).offset(offset).limit(limit)
    return page.select("id", "player_id", "full_name", "transfer_date", "date_is_exact", "fee_eur", "from_club_id", "to_club_id", "from_name", "to_name")


def board_seasons(transfers: DataFrame, clubs: DataFrame | None = None, league_id: int | None = None) -> DataFrame:
    """Season spellings of the board, made alike, newest first."""
    rows = _real_moves(transfers).where("season is not null")
    if league_id is not None:
        of = clubs.where(F.col("league_id") == league_id).select("id")
        rows = rows.join(of.select(F.col("id").alias("from_club_id")), "from_club_id", "left_semi").select("season").union(rows.join(of.select(F.col("id").alias("to_club_id")), "to_club_id", "left_semi").select("season"))
    return rows.select(normalise_season("season").alias("season")).distinct().orderBy(F.desc("season"))


def _grams(c: Column, n: int = 3) -> Column:
    """Distinct runs of ``n`` characters, or the whole text where it is shorter."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.array_distinct(many)


def search(queries: DataFrame, players: DataFrame, clubs: DataFrame, leagues: DataFrame, n: int = PER_KIND) -> DataFrame:
    """query, kind, rank, id, label, detail: for each query the best ``n`` names of each kind that hold it, accents and case apart.

    Names that start with it come first; then players with a club and a high value, clubs by name, leagues by tier and
    name. Each distinct query text is looked up by the rarest of its runs of three letters, the whole text where it has
    two; a text with a run that no name has finds nothing. A run that very many names have is several parts, dealt by
    name, so that no run is one task.
    """
    q = queries.select("query", fold(F.trim("query")).alias("needle")).where(F.length("needle") >= MIN_QUERY).distinct()
    club = clubs.select(F.col("id").alias("current_club_id"), F.col("name").alias("club_name"))
    league = leagues.select(F.col("id").alias("league_id"), F.col("name").alias("league_name"))
    order = lambda a, b, c: F.struct(a.cast("int").alias("a"), b.alias("b"), c.alias("c")).alias("order")
    value = F.coalesce(-F.col("market_value_eur"), F.lit(float("inf")))
    at_club, detail = F.nullif(F.concat_ws(" · ", "club_name", "position"), F.lit("")), F.concat("country_code", F.lit(" · "), F.col("tier").cast("string"), F.lit(". lig"))
    p = players.join(club, "current_club_id", "left").select(F.lit("player").alias("kind"), "id", F.col("full_name").alias("label"), at_club.alias("detail"), order(F.when(F.col("current_club_id").isNull(), 1).otherwise(0), value, F.lit("")))
    c = clubs.join(league, "league_id", "left").select(F.lit("club").alias("kind"), "id", F.col("name").alias("label"), F.col("league_name").alias("detail"), order(F.lit(0), F.lit(0.0), F.col("name")))
    l = leagues.select(F.lit("league").alias("kind"), "id", F.col("name").alias("label"), F.when(F.col("tier") == 1, F.col("country_code")).otherwise(detail).alias("detail"), order(F.col("tier"), F.lit(0.0), F.col("name")))
    names = p.unionByName(c).unionByName(l).withColumn("folded", fold("label"))
    pairs = gram_pairs(q.select("needle").distinct(), names.select("kind", "id", "folded"), ["kind", "id"])
    hits = pairs.join(names.select("kind", "id", "folded", "order"), ["kind", "id"]).where(F.contains("folded", F.col("needle")))
    first = F.when(F.startswith("folded", F.col("needle")), 0).otherwise(1)
    best = top_rows(hits, ["needle", "kind"], [first, "order", "id"], n, "rank").select("needle", "kind", "rank", "id")
    rows = best.join(names.select("kind", "id", "label", "detail"), ["kind", "id"]).join(q, "needle")
    return rows.select("query", "kind", "rank", "id", "label", "detail")


#: Names with one gram that a part takes, about.
GRAM_PART = 1 << 14


def gram_pairs(needles: DataFrame, names: DataFrame, keys: Sequence[str], size: int = 3, part: int = GRAM_PART) -> DataFrame:
    """needle, keys: each needle with the names that have the rarest of its runs of ``size`` letters. ``names``: keys, folded.

    Only runs that some needle has are kept of the names, without any other column, and counted. Needles shorter than a
    run are runs of their own length.
    """
    wanted = needles.select("needle", F.explode(_grams(F.col("needle"), size)).alias("gram"))
    runs = F.concat(*[_grams(F.col("folded"), k) for k in range(2, size + 1)])
    posts = names.select(*keys, F.explode(F.array_distinct(runs)).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    posts = stored(posts, "posts")
    counts = posts.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("needle").agg(F.min_by(F.struct("gram", "n"), F.struct("n", "gram")).alias("g"), F.count_if(F.col("n").isNull()).alias("missing"))
    chosen = rarest.where("missing = 0").select("needle", "g.gram", F.ceil(F.col("g.n") / part).cast("int").alias("parts"))
    chosen = stored(chosen, "chosen")
    parts = counted(stored(chosen.select("gram", "parts").distinct(), "parts"))
    dealt = posts.join(parts, "gram").select(*keys, "gram", F.pmod(F.xxhash64(*keys), F.col("parts")).cast("int").alias("part"))
    asked = chosen.select("needle", "gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt.join(asked, ["gram", "part"]).select("needle", *keys)


def search_players(
    players: DataFrame, clubs: DataFrame, stats: DataFrame, as_of: datetime.date, q: str | None = None, position: str | None = None, league_id: int | None = None, country: str | None = None,
    age_min: int | None = None, age_max: int | None = None, value_max: float | None = None, minutes_min: int | None = None, limit: int = 25, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(one page of players by value and name, a row with the total)."""
    rows = players.join(clubs.select(F.col("id").alias("current_club_id"), F.col("name").alias("club_name"), "league_id"), "current_club_id", "left")
    like = lambda c, text: F.contains(F.lower(c), F.lit(text.lower()))
    tests = [
        like("full_name", q) if q else None,
        like("position", position) | F.coalesce(like("sub_position", position), F.lit(False)) if position else None,
        F.col("league_id") == league_id if league_id is not None else None,
        F.col("nationality_code") == country.upper() if country else None,
        F.col("market_value_eur") <= value_max if value_max is not None else None,
    ]
    before, after = birth_bounds(age_min, age_max, as_of)
    tests += [F.col("birth_date") <= before if before is not None else None, F.col("birth_date") > after if after is not None else None]
    for t in tests:
        rows = rows.where(t) if t is not None else rows
    if minutes_min is not None:
        rows = rows.join(stats.where(F.col("minutes") >= minutes_min).select(F.col("player_id").alias("id")), "id", "left_semi")
    page = rows.orderBy(F.desc_nulls_last("market_value_eur"), "full_name", "id").offset(offset).limit(limit)
    return page.select("id", "full_name", "position", "club_name", "league_id", "market_value_eur"), rows.agg(F.count("*").alias("total"))


def player_profiles(players: DataFrame, stats: DataFrame, values: DataFrame, clubs: DataFrame, leagues: DataFrame) -> DataFrame:
    """A row a player: club, league, seasons (newest first, with gated rates) and values (oldest first)."""
    season = F.struct("season", "source", "club_id", "minutes", "goals", "assists", per_90("goals", "minutes").alias("goals_per_90"), per_90("assists", "minutes").alias("assists_per_90"))
    seasons = stats.groupBy("player_id").agg(F.sort_array(F.collect_list(season), False).alias("seasons"))
    history = values.groupBy("player_id").agg(F.sort_array(F.collect_list(F.struct("date", "value_eur"))).alias("values"))
    club = clubs.select(F.col("id").alias("current_club_id"), F.col("name").alias("club_name"), "league_id")
    rows = players.select(F.col("id").alias("player_id"), "full_name", "current_club_id").join(club, "current_club_id", "left").join(_named(leagues, "league_id", "league_name"), "league_id", "left")
    return rows.join(seasons, "player_id", "left").join(history, "player_id", "left").select("player_id", "full_name", "club_name", "league_name", "seasons", "values")


def freshness(transfers: DataFrame, matches: DataFrame, values: DataFrame, stats: DataFrame, as_of: datetime.date) -> DataFrame:
    """One row: last transfer up to ``as_of``, last match, last valuation, latest season."""
    one = lambda df, c, name: df.agg(F.max(c).alias(name))
    rows = one(transfers.where(F.col("transfer_date") <= F.lit(as_of)), "transfer_date", "last_transfer_on")
    return rows.crossJoin(one(matches, "date", "last_match_on")).crossJoin(one(values, "date", "last_valuation_on")).crossJoin(one(stats, "season", "latest_season"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each source's most recent run."""
    return latest_rows(runs.select("source", "started_at", "status", "rows_written"), ["source"], ["started_at", "rows_written"])
