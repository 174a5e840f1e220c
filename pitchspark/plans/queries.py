"""The registered queries of the domain's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BUCKET_DAYS, CLUB_NOISE, CONTEXT_METRICS, COUNTING_METRICS, KEEPER_METRICS, KEEPER_RATIOS, LEGAL_FORMS, NEGATIVE_METRICS, RADAR_AXES, ROLE_AXES, SHOT_RATIOS, YOUTH_MARKS
from ..functions import (
    age_at,
    as_date,
    as_int,
    as_number,
    as_text,
    birth_bounds,
    club_key,
    club_tokens,
    date_is_exact,
    fold,
    groups_in,
    is_youth_team,
    normalise_season,
    normalize_name,
    per_90,
    position_group,
    resolve_position_group,
    rounded,
    same_club,
    same_person,
    search_terms,
    season_from_start_year,
    season_label,
    season_of_date,
    surname_key,
    zone_of,
)
from ..functions.football import BOX_HALF, BOX_X, SIX_HALF, SIX_X
from ..functions.text import FOLD_FROM, FOLD_TO, LIGATURES
from ..operators import discovery, imports, metrics, quality, resolve, views
from ..sources import files, tables
from ..sources.scratch import stored as written
from .adapters import AS_OF, MAP_METRICS, season_rows, table, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TODAY = f"DATE '{AS_OF}'"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def r(expression: str, digits: int) -> str:
    """SQL of ``rounded``."""
    scale = 10**digits
    return f"(floor(({expression}) * {scale}.0::DOUBLE + 0.5::DOUBLE) / {scale}.0::DOUBLE)"


def base(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fold_sql(c: str) -> str:
    c = f"translate({c}, '{FOLD_FROM}', '{FOLD_TO}')"
    for a, b in LIGATURES:
        c = f"replace({c}, '{a}', '{b}')"
    return f"lower({c})"


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace({fold_sql(c)}, '[^a-z0-9]+', ' ', 'g'))"


def key_sql(norm: str) -> str:
    return f"coalesce(nullif(array_to_string(list_filter(string_split({norm}, ' '), lambda x: x NOT IN ({quoted(LEGAL_FORMS)})), ' '), ''), {norm})"


# --- column functions -------------------------------------------------------------------------------------------

NAMES = "SELECT doc_id AS id, text AS name FROM documents"
names = lambda s, d: base(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"))


@query("casts", with_tables("", f"""SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN CAST(floor(value) AS BIGINT) ELSE user_id END AS as_int,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE CASE WHEN event_id % 5 = 1 THEN value ELSE CAST(user_id AS DOUBLE) END END AS as_number, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS as_date,
    substr(event_type, 1, 4) AS as_text FROM events"""))
def casts(s, d):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit(" NaN ")).when(F.col("event_id") % 5 == 1, F.col("value").cast("string")).otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".0")))
    day = F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    e = base(s, d, "events")
    return e.select(F.col("event_id").alias("id"), as_int(raw).alias("as_int"), as_number(raw).alias("as_number"), as_date(day).alias("as_date"), as_text(F.concat(F.lit("  "), "event_type", F.lit(" ")), 4).alias("as_text"))


@query("season_labels", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN concat('20', lpad(CAST(o_orderkey % 99 AS VARCHAR), 2, '0'), '-', lpad(CAST(o_orderkey % 99 + 1 AS VARCHAR), 2, '0')) ELSE concat(lpad(CAST(o_orderkey % 99 AS VARCHAR), 2, '0'), '00') END AS label,
    concat(year(o_orderdate), '-', lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0')) AS from_start,
    concat(year(o_orderdate) - CASE WHEN month(o_orderdate) >= 7 THEN 0 ELSE 1 END, '-', lpad(CAST((year(o_orderdate) - CASE WHEN month(o_orderdate) >= 7 THEN 0 ELSE 1 END + 1) % 100 AS VARCHAR), 2, '0')) AS of_date,
    concat('20', lpad(CAST(o_orderkey % 99 AS VARCHAR), 2, '0'), '-xx') AS spelled FROM orders""")
def season_labels(s, d):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    half = F.col("o_orderkey") % 99
    key = F.when(F.col("o_orderkey") % 2 == 0, F.concat(two(half), two(half + 1))).otherwise(F.concat(two(half), F.lit("00")))
    return base(s, d, "orders").select(F.col("o_orderkey").alias("id"), season_label(key).alias("label"), season_from_start_year(F.year("o_orderdate")).alias("from_start"), season_of_date("o_orderdate").alias("of_date"), normalise_season(F.concat(two(half), F.lit("/xx"))).alias("spelled"))


def _groups_sql(text: str) -> str:
    return f"CASE {text} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in {"GK": "['GK']", "DF": "['DF']", "MF,FW": "['MF','FW']", "DF,MF": "['DF','MF']", "FW": "['FW']", "Defender": "['DF']", "Midfield": "['MF']", "Attack": "['FW']", "Goalkeeper": "['GK']"}.items()) + " ELSE []::VARCHAR[] END"


def _resolve_sql(season: str, career: str) -> str:
    g, c = _groups_sql(season), f"({_groups_sql(career)})[1]"
    return f"CASE WHEN len({g}) = 0 THEN {c} WHEN list_contains({g}, {c}) THEN {c} ELSE ({g})[1] END"


@query("position_groups", with_tables("season_stats players", f"SELECT DISTINCT s.player_id, s.position AS season_label, p.position AS career_label, array_to_string({_groups_sql('s.position')}, ',') AS season_groups, {_resolve_sql('s.position', 'p.position')} AS resolved, coalesce(({_groups_sql('s.position')})[1], ({_groups_sql('p.position')})[1]) AS first_group FROM season_stats s JOIN players p ON s.player_id = p.id"))
def position_groups(s, d):
    rows = table(s, d, "season_stats").select("player_id", F.col("position").alias("season_label")).distinct().join(table(s, d, "players").select(F.col("id").alias("player_id"), F.col("position").alias("career_label")), "player_id")
    return rows.select("*", F.array_join(groups_in("season_label"), ",").alias("season_groups"), resolve_position_group("season_label", "career_label").alias("resolved"), position_group("season_label", "career_label").alias("first_group"))


@query("name_keys", f"WITH n AS ({NAMES}), k AS (SELECT id, {norm_sql('name')} AS normalized, {fold_sql('name')} AS folded FROM n) SELECT id, normalized, folded, CASE WHEN normalized <> '' THEN concat(substr(normalized, 1, 1), ' ', string_split(normalized, ' ')[-1]) END AS surname FROM k")
def name_keys(s, d):
    return names(s, d).select("id", normalize_name("name").alias("normalized"), fold("name").alias("folded"), surname_key("name").alias("surname"))


CLUB_NAME = "concat(p_name, CASE p_partkey % 7 WHEN 0 THEN ' F.C.' WHEN 1 THEN ' spor' WHEN 2 THEN ' U19' WHEN 3 THEN ' AC Club' ELSE ' SK' END)"
_tokens = lambda k: f"list_distinct(list_filter(string_split({k}, ' '), lambda x: len(x) > 1))"
_named = lambda t: f"list_filter({t}, lambda x: x NOT IN ({quoted(CLUB_NOISE)}))"


@query("club_keys", f"WITH n AS (SELECT p_partkey AS id, {CLUB_NAME} AS name FROM part), k AS (SELECT id, {key_sql(norm_sql('name'))} AS club_key FROM n) SELECT id, club_key, array_to_string(list_sort(CASE WHEN len({_named(_tokens('club_key'))}) > 0 THEN {_named(_tokens('club_key'))} ELSE {_tokens('club_key')} END), ' ') AS tokens, len(list_filter(string_split(club_key, ' '), lambda x: x IN ({quoted(YOUTH_MARKS)}))) > 0 AS youth FROM k")
def club_keys(s, d):
    n = base(s, d, "part").select(F.col("p_partkey").alias("id"), F.expr(CLUB_NAME).alias("name"))
    return n.select("id", club_key("name").alias("club_key"), F.array_join(F.sort_array(club_tokens("name")), " ").alias("tokens"), is_youth_team("name").alias("youth"))


@query("search_terms", f"WITH n AS ({NAMES}), k AS (SELECT id, {norm_sql('name')} AS k FROM n), w AS (SELECT id, k, list_filter(string_split(k, ' '), lambda x: len(x) >= 4) AS ws FROM k), o AS (SELECT id, k, ws, list_transform(list_sort(list_transform(ws, lambda x, i: {{'n': -len(x), 'i': i, 'x': x}})), lambda z: z.x) AS o FROM w) SELECT id, CASE WHEN len(ws) > 0 THEN array_to_string(o[1:2], ',') ELSE substr(k, 1, 30) END AS terms FROM o")
def terms(s, d):
    return names(s, d).select("id", F.array_join(search_terms("name"), ",").alias("terms"))


PAIRS = "SELECT a.p_partkey AS a_id, b.p_partkey AS b_id, a.p_name AS a, concat(CASE b.p_partkey % 4 WHEN 0 THEN substr(b.p_name, 1, 1) ELSE split_part(b.p_name, ' ', 2) END, ' ', split_part(b.p_name, ' ', CASE b.p_partkey % 4 WHEN 0 THEN 2 ELSE 1 END)) AS b FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey"


@query("same_pairs", f"WITH p AS ({PAIRS}), w AS (SELECT a_id, b_id, list_distinct(string_split(a, ' ')) AS a, list_distinct(string_split(b, ' ')) AS b FROM p), v AS (SELECT *, list_filter(a, lambda x: len(x) > 1) AS ra, list_filter(b, lambda x: len(x) > 1) AS rb FROM w) SELECT a_id, b_id, len(ra) > 0 AND len(rb) > 0 AND (list_has_all(rb, ra) OR list_has_all(ra, rb)) AND len(list_filter(b, lambda i: len(i) = 1 AND len(list_filter(ra, lambda w: starts_with(w, i))) = 0)) = 0 AS person, len(ra) > 0 AND len(rb) > 0 AND (list_has_all(rb, ra) OR list_has_all(ra, rb)) AS club FROM v")
def same_pairs(s, d):
    p = base(s, d, "part")
    other = p.select(F.col("p_partkey").alias("b_id"), F.expr("concat(CASE p_partkey % 4 WHEN 0 THEN substr(p_name, 1, 1) ELSE split_part(p_name, ' ', 2) END, ' ', split_part(p_name, ' ', CASE p_partkey % 4 WHEN 0 THEN 2 ELSE 1 END))").alias("b"), "p_size", "p_brand")
    return resolve.same_pairs(p.select(F.col("p_partkey").alias("a_id"), F.col("p_name").alias("a"), "p_size", "p_brand"), other, ["p_size", "p_brand"])


@query("resolve_country", with_tables("countries", "SELECT n.n_nationkey AS id, c.code AS country_code FROM nation n LEFT JOIN countries c ON n.n_nationkey % 5 = CAST(substr(c.code, 2) AS INT) AND n.n_nationkey % 4 <> 3"))
def resolve_country(s, d):
    c = table(s, d, "countries")
    spelled = F.when(F.col("k") == 0, F.upper("name_tr")).when(F.col("k") == 1, F.concat(F.lit("Alias "), F.lower("name"))).when(F.col("k") == 2, F.col("name")).otherwise("Atlantis")
    rows = base(s, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 4).alias("k"), F.concat(F.lit("R"), (F.col("n_nationkey") % 5).cast("string")).alias("code")).join(c, "code").select("id", spelled.alias("country"))
    return imports.resolve_country(rows, "country", c, table(s, d, "aliases")).select("id", "country_code")


@query("ages", with_tables("players", f"SELECT id, CASE WHEN birth_date IS NOT NULL THEN year({TODAY}) - year(birth_date) - CASE WHEN (month({TODAY}), day({TODAY})) < (month(birth_date), day(birth_date)) THEN 1 ELSE 0 END ELSE year({TODAY}) - birth_year END AS age, birth_date <= {TODAY} - INTERVAL 18 YEAR AND birth_date > {TODAY} - INTERVAL 24 YEAR AS in_range FROM players"))
def ages(s, d):
    before, after = birth_bounds(18, 23, AS_OF)
    return table(s, d, "players").select("id", age_at("birth_date", "birth_year", AS_OF).alias("age"), ((F.col("birth_date") <= before) & (F.col("birth_date") > after)).alias("in_range"))


@query("per_90", with_tables("season_stats", f"SELECT player_id, season, club_id, source, CASE WHEN minutes >= 900 THEN {r('goals * 90 / CAST(minutes AS DOUBLE)', 3)} END AS rate FROM season_stats"))
def per_90_query(s, d):
    return table(s, d, "season_stats").select("player_id", "season", "club_id", "source", per_90("goals", "minutes").alias("rate"))


@query("date_is_exact", with_tables("transfers", f"SELECT id, strftime(transfer_date, '%m-%d') NOT IN ({quoted(BUCKET_DAYS)}) AS exact FROM transfers"))
def exact(s, d):
    return table(s, d, "transfers").select("id", date_is_exact("transfer_date").alias("exact"))


ZONE = f"CASE WHEN location_x IS NULL OR location_y IS NULL THEN 'outside' WHEN location_x >= {SIX_X!r} AND abs(location_y - 0.5) <= {SIX_HALF!r} THEN 'six_yard' WHEN location_x >= {BOX_X!r} AND abs(location_y - 0.5) <= {BOX_HALF!r} THEN 'penalty_area' WHEN location_x >= {BOX_X!r} THEN 'wide' ELSE 'outside' END"


@query("zone_of", with_tables("shots", f"SELECT id, {ZONE} AS zone FROM shots"))
def zones(s, d):
    return table(s, d, "shots").select("id", zone_of("location_x", "location_y").alias("zone"))


# --- sources and sinks ------------------------------------------------------------------------------------------


@query("flatten_moves", "SELECT o_custkey AS api_id, 'P' AS name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_orderpriority AS type, o_orderkey % 10 AS out_team, 'c' AS out_name, o_orderkey % 7 AS in_team, 'd' AS in_name FROM orders")
def flatten_moves(s, d):
    end = lambda k, name: F.struct((F.col("o_orderkey") % k).alias("id"), F.lit(name).alias("name"))
    move = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("type"), F.struct(end(10, "c").alias("out"), end(7, "d").alias("in")).alias("teams"))
    feed = base(s, d, "orders").groupBy("o_custkey").agg(F.collect_list(move).alias("t")).select(F.to_json(F.struct(F.array(F.struct(F.struct(F.col("o_custkey").alias("id"), F.lit("P ").alias("name")).alias("player"), F.col("t").alias("transfers"))).alias("response"))).alias("j"))
    return files.flatten_moves(feed.select(F.from_json("j", files.MOVES_SCHEMA).alias("f")).select("f.*"))


@query("flatten_squads", with_tables("players", "SELECT current_club_id AS team_id, id AS api_id, full_name AS name, position, image_url AS photo FROM players WHERE current_club_id IS NOT NULL"))
def flatten_squads(s, d):
    p = table(s, d, "players").where("current_club_id is not null")
    member = F.struct("id", F.col("full_name").alias("name"), F.lit(None).cast("int").alias("age"), F.lit(None).cast("int").alias("number"), "position", F.col("image_url").alias("photo"))
    feed = p.groupBy("current_club_id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("page")).agg(F.collect_list(member).alias("players"))
    response = F.array(F.struct(F.struct(F.col("current_club_id").cast("long").alias("id"), F.lit("t").alias("name")).alias("team"), "players").alias("r"))
    return files.flatten_squads(feed.select(F.from_json(F.to_json(F.struct(response.alias("response"))), files.SQUADS_SCHEMA).alias("f")).select("f.*"))


NEW_SLICE = "SELECT player_id, season, club_id, source, minutes + 1 AS minutes FROM season_stats WHERE season = '1999' AND source = 'fbref' AND player_id % 2 = 0"


@query("replace_slice", with_tables("season_stats", f"SELECT player_id, season, club_id, source, minutes FROM season_stats WHERE NOT (season = '1999' AND source = 'fbref') UNION ALL {NEW_SLICE}"))
def replace_slice(s, d):
    rows = table(s, d, "season_stats").select("player_id", "season", "club_id", "source", "minutes")
    new = rows.where("season = '1999' and source = 'fbref' and player_id % 2 = 0").withColumn("minutes", F.col("minutes") + 1)
    scope = s.createDataFrame([("1999", "fbref")], "season string, source string")
    return tables.replace_slice(rows, new, scope, ["season", "source"])


UP = "FULL JOIN (SELECT p_partkey + 100 AS id, concat('new ', p_name) AS full_name, CAST(NULL AS VARCHAR) AS position FROM part WHERE p_partkey % 3 = 0) n ON o.id = n.id"


@query("upsert", with_tables("players", f"SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.full_name ELSE o.full_name END AS full_name, CASE WHEN o.id IS NOT NULL THEN o.position ELSE n.position END AS position FROM players o {UP}"))
def upsert(s, d):
    new = base(s, d, "part").where("p_partkey % 3 = 0").select((F.col("p_partkey") + 100).alias("id"), F.concat(F.lit("new "), "p_name").alias("full_name"), F.lit(None).cast("string").alias("position"))
    return tables.upsert(table(s, d, "players").select("id", "full_name", "position"), new, ["id"], ["full_name"])


@query("insert_ignore", with_tables("worklist", "SELECT source, entity, source_key, source_name FROM worklist WHERE ingest_order < 100 UNION ALL SELECT source, entity, source_key, source_name FROM (SELECT *, row_number() OVER (PARTITION BY source, entity, source_key ORDER BY ingest_order) AS n FROM worklist w WHERE ingest_order >= 100 AND NOT EXISTS (SELECT 1 FROM worklist o WHERE o.ingest_order < 100 AND o.source = w.source AND o.entity = w.entity AND o.source_key = w.source_key)) WHERE n = 1"))
def insert_ignore(s, d):
    w = table(s, d, "worklist")
    return tables.insert_ignore(w.where("ingest_order < 100").select("source", "entity", "source_key", "source_name"), w.where("ingest_order >= 100").select("source", "entity", "source_key", "source_name", "ingest_order"), ["source", "entity", "source_key"], "ingest_order")


# --- imports ----------------------------------------------------------------------------------------------------


def _snapshot_leagues(s, d):
    return base(s, d, "nation").select(F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("competition_id"), F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))).alias("name"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("code"), F.when(F.col("n_nationkey") % 5 == 4, "cup").otherwise("domestic_league").alias("type"), F.when(F.col("n_nationkey") % 2 == 0, "first_tier").otherwise("second").alias("sub_type")).join(table(s, d, "countries").select("code", F.col("name").alias("country_name")), "code")


@query("import_leagues", "SELECT concat('Nation ', n_nationkey) AS name, concat('R', n_regionkey) AS country_code, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END AS tier, concat('L', n_nationkey) AS transfermarkt_id FROM nation WHERE n_nationkey % 5 <> 4")
def import_leagues(s, d):
    return imports.import_leagues(_snapshot_leagues(s, d), table(s, d, "countries"), table(s, d, "aliases")).drop("logo_url")


@query("import_clubs", with_tables("leagues", "SELECT s_name AS name, l.id AS league_id, s_suppkey AS transfermarkt_id FROM supplier JOIN leagues l ON l.transfermarkt_id = concat('L', s_nationkey)"))
def import_clubs(s, d):
    c = base(s, d, "supplier").select(F.concat("s_suppkey", F.lit(".0")).alias("club_id"), F.col("s_name").alias("name"), F.concat(F.lit("L"), F.col("s_nationkey").cast("string")).alias("domestic_competition_id"))
    return imports.import_clubs(c, table(s, d, "leagues")).drop("logo_url")


def _club_map(s, d):
    return imports.id_map(table(s, d, "clubs"), "source_club", "club_id")


def _player_map(s, d):
    return imports.id_map(table(s, d, "players"), "source_player", "player_id")


@query("import_players", with_tables("clubs countries", "SELECT p_name AS full_name, make_date(1980, 1, CAST(1 + p_partkey % 28 AS INT)) AS birth_date, n.code AS nationality_code, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE lower(p_type) END AS position, c.id AS current_club_id, p_retailprice AS market_value_eur, p_partkey AS transfermarkt_id, CASE WHEN p_partkey % 2 = 0 THEN '2025-26' END AS last_season FROM part JOIN clubs c ON c.transfermarkt_id = 700000 + p_partkey % 150 LEFT JOIN countries n ON n.code = concat('R', p_partkey % 7)"))
def import_players(s, d):
    p = base(s, d, "part").join(table(s, d, "countries").select(F.col("code"), F.col("name").alias("nation")), F.concat(F.lit("R"), (F.col("p_partkey") % 7).cast("string")) == F.col("code"), "left")
    raw = p.select(F.col("p_partkey").alias("player_id"), F.col("p_name").alias("name"), F.concat(F.lit("1980-01-"), F.lpad((1 + F.col("p_partkey") % 28).cast("string"), 2, "0"), F.lit(" 00:00")).alias("date_of_birth"), F.coalesce("nation", F.lit("Atlantis")).alias("country_of_citizenship"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.lower("p_type")).alias("position"), F.lit("").alias("sub_position"), F.lit("left").alias("foot"), F.lit("180.0").alias("height_in_cm"), (700000 + F.col("p_partkey") % 150).cast("string").alias("current_club_id"), F.col("p_retailprice").alias("market_value_in_eur"), F.lit("nan").alias("contract_expiration_date"), F.when(F.col("p_partkey") % 2 == 0, "2025").otherwise("x").alias("last_season"))
    return imports.import_players(raw, _club_map(s, d), table(s, d, "countries"), table(s, d, "aliases")).select("full_name", "birth_date", "nationality_code", "position", "current_club_id", "market_value_eur", "transfermarkt_id", "last_season")


@query("import_transfers", with_tables("players clubs", f"SELECT p.id AS player_id, f.id AS from_club_id, t.id AS to_club_id, CAST(o_orderdate AS DATE) AS transfer_date, o_totalprice AS fee_eur, strftime(o_orderdate, '%m-%d') NOT IN ({quoted(BUCKET_DAYS)}) AS date_is_exact FROM orders JOIN players p ON p.transfermarkt_id = o_custkey + 800000 LEFT JOIN clubs f ON f.transfermarkt_id = 700000 + o_orderkey % 130 LEFT JOIN clubs t ON t.transfermarkt_id = 700000 + o_orderkey % 90"))
def import_transfers(s, d):
    o = base(s, d, "orders")
    raw = o.select((F.col("o_custkey") + 800000).alias("player_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("transfer_date"), (700000 + F.col("o_orderkey") % 130).alias("from_club_id"), (700000 + F.col("o_orderkey") % 90).alias("to_club_id"), F.col("o_totalprice").alias("transfer_fee"))
    return imports.import_transfers(raw, _player_map(s, d), _club_map(s, d)).drop("season", "sources")


@query("import_valuations", with_tables("players", "SELECT player_id, date, value_eur FROM (SELECT p.id AS player_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_totalprice AS value_eur, row_number() OVER (PARTITION BY p.id, date_trunc('month', o_orderdate) ORDER BY o_orderkey) AS n FROM orders JOIN players p ON p.transfermarkt_id = o_custkey + 800000 WHERE o_orderkey % 10 <> 3) WHERE n = 1"))
def import_valuations(s, d):
    raw = base(s, d, "orders").select((F.col("o_custkey") + 800000).alias("player_id"), F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderkey") % 10 != 3, F.col("o_totalprice").cast("string")).alias("market_value_in_eur"), F.col("o_orderkey").alias("ingest_order"))
    return imports.import_valuations(raw, _player_map(s, d))


def _games(s, d):
    o = base(s, d, "orders")
    text = lambda c: F.concat(c.cast("string"), F.lit(".0"))
    return o.select(text(F.col("o_orderkey") - F.when(F.col("o_orderkey") % 40 == 1, 1).otherwise(0)).alias("game_id"), F.concat(F.lit("L"), (F.col("o_orderkey") % 25).cast("string")).alias("competition_id"), F.year("o_orderdate").cast("string").alias("season"), F.lit("r1").alias("round"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), text(700000 + F.col("o_orderkey") % 12).alias("home_club_id"), text(700000 + (F.col("o_orderkey") * 7 + 1) % 10).alias("away_club_id"), text(F.col("o_orderkey") % 5).alias("home_club_goals"), F.lit("nan").alias("away_club_goals"), F.lit("").alias("home_club_formation"), F.lit("4-4-2").alias("away_club_formation"), F.lit(" park ").alias("stadium"), F.lit("1000.0").alias("attendance"), F.lit("ref").alias("referee"), F.col("o_orderkey").alias("ingest_order"))


GAMES = "g AS (SELECT o_orderkey AS k, o_orderkey - CASE WHEN o_orderkey % 40 = 1 THEN 1 ELSE 0 END AS id, l.id AS league_id, year(o_orderdate) AS y, CAST(o_orderdate AS DATE) AS date, h.id AS home, a.id AS away, CAST(o_orderkey % 5 AS INT) AS home_goals FROM orders LEFT JOIN leagues l ON l.transfermarkt_id = concat('L', o_orderkey % 25) LEFT JOIN clubs h ON h.transfermarkt_id = 700000 + o_orderkey % 12 LEFT JOIN clubs a ON a.transfermarkt_id = 700000 + (o_orderkey * 7 + 1) % 10), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS n FROM g WHERE league_id IS NOT NULL AND y >= 1996 AND home IS NOT NULL AND away IS NOT NULL) WHERE n = 1)"
_games_sql = lambda body: with_tables("leagues clubs", "").strip() + f", {GAMES} {body}"


@query("import_matches", _games_sql("SELECT id, league_id, concat(y, '-', lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0')) AS season, date, home AS home_club_id, away AS away_club_id, home_goals, 'park' AS stadium FROM m"))
def import_matches(s, d):
    return imports.import_matches(_games(s, d), table(s, d, "leagues"), _club_map(s, d), since=1996)[0].select("id", "league_id", "season", "date", "home_club_id", "away_club_id", "home_goals", "stadium")


@query("import_matches_rejects", _games_sql("SELECT CASE WHEN league_id IS NULL THEN 'league' WHEN y < 1996 THEN 'season' ELSE 'club' END AS reason, count(*) AS n FROM g WHERE league_id IS NULL OR y < 1996 OR home IS NULL OR away IS NULL GROUP BY 1"))
def import_matches_rejects(s, d):
    return imports.import_matches(_games(s, d), table(s, d, "leagues"), _club_map(s, d), since=1996)[1]


def _appearances(s, d):
    m = imports.import_matches(_games(s, d), table(s, d, "leagues"), _club_map(s, d), since=1996)[0]
    raw = base(s, d, "lineitem").select(F.col("l_orderkey").alias("game_id"), (F.col("l_partkey") + 800000).alias("player_id"), (F.col("l_suppkey") + 700000).alias("player_club_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_quantity").alias("minutes_played"), F.col("l_linenumber").alias("goals"), F.lit("").alias("assists"), F.lit("0").alias("yellow_cards"), F.lit("0").alias("red_cards"), (F.col("l_suppkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_quantity") * 1000 + F.datediff("l_shipdate", F.lit("1995-01-01"))).alias("ingest_order"))
    return imports.import_appearances(raw, m, _player_map(s, d), _club_map(s, d))


APPS = "x AS (SELECT p.id AS player_id, m.id AS match_id, l_suppkey AS club_id, CAST(l_shipdate AS DATE) AS played_on, CAST(l_quantity AS INT) AS minutes, l_linenumber AS goals, row_number() OVER (PARTITION BY p.id, m.id ORDER BY l_suppkey * 1000000 + l_linenumber * 100000 + l_quantity * 1000 + date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))) AS n FROM lineitem JOIN m ON m.id = l_orderkey JOIN players p ON p.transfermarkt_id = l_partkey + 800000)"


@query("import_appearances", with_tables("leagues clubs players", "").strip() + f", {GAMES}, {APPS} SELECT player_id, match_id, club_id, played_on, minutes, goals FROM x WHERE n = 1")
def import_appearances(s, d):
    return _appearances(s, d)[0].select("player_id", "match_id", "club_id", "played_on", "minutes", "goals")


@query("import_appearances_rejects", with_tables("leagues clubs players", "").strip() + f", {GAMES}, {APPS} SELECT CASE WHEN m.id IS NULL THEN 'match' ELSE 'player' END AS reason, count(*) AS n FROM lineitem LEFT JOIN m ON m.id = l_orderkey LEFT JOIN players p ON p.transfermarkt_id = l_partkey + 800000 WHERE m.id IS NULL OR p.id IS NULL GROUP BY 1 UNION ALL SELECT 'duplicate', count(*) FROM x WHERE n > 1 HAVING count(*) > 0")
def import_appearances_rejects(s, d):
    return _appearances(s, d)[1]


@query("widen_stats", with_tables("season_stats", "SELECT a.player_id, a.season, a.club_id, a.source, a.minutes, b.shots, c.fouls FROM season_stats a LEFT JOIN (SELECT * FROM season_stats WHERE player_id % 3 <> 0) b ON a.player_id = b.player_id AND a.season = b.season AND a.club_id = b.club_id AND a.source = b.source LEFT JOIN (SELECT * FROM season_stats WHERE minutes > 1000) c ON a.player_id = c.player_id AND a.season = c.season AND a.club_id = c.club_id AND a.source = c.source"))
def widen_stats(s, d):
    k = ["player_id", "season", "club_id", "source"]
    rows = table(s, d, "season_stats")
    return imports.widen_stats(rows.select(*k, "minutes"), rows.where("player_id % 3 <> 0").select(*k, "minutes", "shots"), None, rows.where("minutes > 1000").select(*k, "fouls"), keys=k)


def _source_stats(s, d):
    rows = table(s, d, "season_stats").where("source = 'fbref'")
    return rows.select(F.concat(F.lit("L"), F.col("league_id").cast("string")).alias("league"), F.concat(F.lit("T"), F.col("club_id").cast("string")).alias("team"), F.concat(F.lit("P"), F.col("player_id").cast("string")).alias("player"), F.lit(None).cast("int").alias("born"), "season", F.col("position").alias("pos"), "nation", F.col("minutes").alias("Playing Time Min"), F.col("matches").alias("Playing Time MP"), F.col("goals").alias("Performance Gls"), F.col("assists").alias("Performance Ast"), F.col("shots").alias("Standard Sh"), F.col("saves").alias("Performance Saves"), "club_id", "player_id")


@query("build_season_rows", with_tables("season_stats", "SELECT player_id, season, league_id, club_id, minutes, matches, goals, assists, shots, saves, position, nation FROM season_stats WHERE source = 'fbref' AND club_id % 10 <> 9 AND player_id % 11 <> 0"))
def build_season_rows(s, d):
    raw = _source_stats(s, d)
    clubs = raw.select("league", "team", "club_id").distinct().where("club_id % 10 <> 9")
    people = raw.select("player", "born", "club_id", "player_id").distinct().where("player_id % 11 <> 0")
    known = table(s, d, "leagues").select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("league"), F.col("id").alias("league_id"))
    rows = imports.build_season_rows(raw.drop("club_id", "player_id"), clubs, people, known)
    return rows.select("player_id", "season", "league_id", "club_id", "minutes", "matches", "goals", "assists", F.col("key_metrics")["shots"].alias("shots"), F.col("key_metrics")["saves"].alias("saves"), "position", "nation")


@query("dedupe_fullest", "SELECT player_id, season, minutes, n_dropped FROM (SELECT l_partkey AS player_id, year(l_shipdate) AS season, l_quantity AS minutes, row_number() OVER (PARTITION BY l_partkey, year(l_shipdate) ORDER BY l_quantity DESC) AS n, count(*) OVER (PARTITION BY l_partkey, year(l_shipdate)) - 1 AS n_dropped FROM lineitem) WHERE n = 1")
def dedupe_fullest(s, d):
    rows = base(s, d, "lineitem").select(F.col("l_partkey").alias("player_id"), F.year("l_shipdate").cast("long").alias("season"), F.col("l_quantity").alias("minutes"), F.col("l_orderkey").alias("ingest_order"))
    return imports.dedupe_fullest(rows, ["player_id", "season"])


@query("leagues_in", with_tables("leagues", "SELECT DISTINCT l.id AS league_id FROM supplier JOIN leagues l ON l.transfermarkt_id = concat('L', s_nationkey)"))
def leagues_in(s, d):
    known = table(s, d, "leagues").where("transfermarkt_id is not null").select(F.col("transfermarkt_id").alias("league"), F.col("id").alias("league_id"))
    return imports.leagues_in(base(s, d, "supplier").select(F.concat(F.lit("L"), F.col("s_nationkey").cast("string")).alias("league")), known)


@query("all_null_groups", with_tables("season_stats", "SELECT source FROM season_stats GROUP BY source HAVING count(xg) = 0"))
def all_null_groups(s, d):
    return imports.all_null_groups(table(s, d, "season_stats"), "source", "xg")


@query("import_shots", with_tables("shots", "SELECT s.id, s.player_id, s.club_id, m.match_id, s.played_on, s.xg, coalesce(lower(s.result) = 'goal', false) AS is_goal FROM shots s LEFT JOIN (SELECT played_on, club_id, max(id) AS match_id FROM (SELECT o_orderkey AS id, DATE '2024-01-01' + CAST(o_orderkey % 40 AS INT) AS played_on, unnest([o_orderkey % 10, (o_orderkey * 7 + 1) % 10]) AS club_id FROM orders) GROUP BY 1, 2) m ON m.played_on = s.played_on AND m.club_id = s.club_id WHERE s.club_id <> 3 AND s.player_id % 9 <> 0"))
def import_shots(s, d):
    raw = table(s, d, "shots").select(F.lit("L").alias("league"), F.concat(F.lit("T"), F.col("club_id").cast("string")).alias("team"), "player_id", F.lit("2024").alias("season"), F.col("played_on").cast("string").alias("date"), F.col("id").cast("string").alias("shot_id"), F.lit("5").alias("minute"), F.col("xg").cast("string").alias("xg"), "location_x", "location_y", F.lit("foot").alias("body_part"), F.lit("open").alias("situation"), "result", F.col("id").alias("ingest_order"))
    clubs = s.range(10).where("id <> 3").select(F.lit("L").alias("league"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("team"), F.col("id").alias("club_id"), F.lit(1).alias("league_id"))
    people = table(s, d, "shots").select(F.col("player_id").cast("string").alias("source_player"), "club_id", "player_id").distinct().where("player_id % 9 <> 0")
    m = base(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("date_add(DATE'2024-01-01', CAST(o_orderkey % 40 AS INT))").alias("date"), F.lit("2024").alias("season"), (F.col("o_orderkey") % 10).alias("home_club_id"), ((F.col("o_orderkey") * 7 + 1) % 10).alias("away_club_id"))
    return imports.import_shots(raw, clubs, people, m)[0].select("id", "player_id", "club_id", "match_id", "played_on", "xg", "is_goal")


@query("worklist_append", SQL["insert_ignore"])
def worklist_append(s, d):
    w = table(s, d, "worklist")
    c = ["source", "entity", "source_key", "source_name"]
    return imports.worklist_append(w.where("ingest_order < 100").select(*c), w.where("ingest_order >= 100").select(*c, "ingest_order"))


@query("worklist_resolved", with_tables("worklist", "SELECT source_key, CAST(target_id AS BIGINT) AS target_id FROM worklist WHERE source = 'BUILDING' AND entity = 'player' AND trim(target_id) <> ''"))
def worklist_resolved(s, d):
    return imports.worklist_resolved(table(s, d, "worklist"), "BUILDING", "player")


# --- peer metrics -----------------------------------------------------------------------------------------------

_FIELD = {"goals": "v.goals", "assists": "v.assists", "xg": "e.xg", "xa": "e.xa"} | {m: f"coalesce(e.{m}, v.{m})" for m in MAP_METRICS}
_TOTAL = {m: {"goal_contributions": "goals + assists"}.get(m, m) for m in COUNTING_METRICS if m in _FIELD or m == "goal_contributions"}
_RATES = [(m, r(f"CAST({t} AS DOUBLE) * 90 / minutes", 4)) for m, t in _TOTAL.items()]
_RATES += [(m, f"CASE WHEN shots >= 20 THEN {r(m, 4)} END") for m in SHOT_RATIOS] + [(m, f"CASE WHEN shots_on_target_against >= 30 THEN {r(m, 4)} END") for m in KEEPER_RATIOS]
_NEGATIVE = f"metric IN ({quoted(NEGATIVE_METRICS)})"
METRICS = {
    "ok": "SELECT * FROM season_stats WHERE minutes >= 900",
    "v": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, season ORDER BY CASE WHEN source = 'fbref' THEN 0 ELSE 1 END, minutes DESC, source, club_id) AS n FROM ok) WHERE n = 1",
    "e": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, season ORDER BY minutes DESC, club_id) AS n FROM ok WHERE source = 'understat') WHERE n = 1",
    "top": "SELECT player_id, season, max(minutes) AS minutes FROM ok GROUP BY ALL",
    "merged": f"SELECT v.player_id, v.season, top.minutes, coalesce(v.league_id, e.league_id) AS league_id, coalesce(v.club_id, e.club_id) AS club_id, {', '.join(f'{x} AS {m}' for m, x in _FIELD.items())}, coalesce(e.position, v.position) AS position_hint FROM v JOIN top USING (player_id, season) LEFT JOIN e USING (player_id, season)",
    "placed": f"SELECT m.*, {_resolve_sql('m.position_hint', 'p.position')} AS position_group FROM merged m JOIN players p ON p.id = m.player_id",
    "rates": f"SELECT player_id, season, position_group, x.metric, x.value FROM (SELECT *, unnest([{', '.join(f'{{metric: {m!r}, value: {x}}}' for m, x in _RATES)}]) AS x FROM placed WHERE position_group IS NOT NULL AND NOT (position_group = 'GK' AND saves IS NULL)) WHERE x.value IS NOT NULL",
    "windowed": "SELECT *, count(*) OVER g AS n, avg(value) OVER g AS mean, stddev_pop(value) OVER g AS sd, min(value) OVER g AS lo, max(value) OVER g AS hi, rank() OVER (PARTITION BY season, position_group, metric ORDER BY value) - 1 AS below, count(*) OVER (PARTITION BY season, position_group, metric, value) AS equal FROM rates WINDOW g AS (PARTITION BY season, position_group, metric)",
    "ranked": f"SELECT player_id, season, position_group, metric, value, CASE WHEN n < 2 THEN NULL WHEN lo = hi THEN 0.0::DOUBLE ELSE {r(f'CASE WHEN {_NEGATIVE} THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * (value - mean) / sd', 3)} END AS zscore, CASE WHEN n >= 2 THEN {r(f'CASE WHEN {_NEGATIVE} THEN 1 - (below + equal / 2.0::DOUBLE) / n ELSE (below + equal / 2.0::DOUBLE) / n END', 3)} END AS percentile, CASE WHEN n >= 2 THEN CAST(n AS INT) END AS sample_size FROM windowed",
    "long": "SELECT player_id, season, position_group, metric, percentile, value AS per90, sample_size FROM ranked WHERE percentile IS NOT NULL",
}
K3 = "player_id, season, position_group"


def over_metrics(body: str, names: str = "", extra: dict[str, str] | None = None) -> str:
    return with_tables(f"season_stats players {names}", body, METRICS | (extra or {}))


def placed_rows(s, d):
    return metrics.placed(metrics.merge_sources(season_rows(s, d)), table(s, d, "players"))


def metric_rows(s, d):
    return metrics.compute_metrics(season_rows(s, d), table(s, d, "players"))


def both_rows(s, d):
    """The metrics job's table, written once as in production, and its long form."""
    m = written(metric_rows(s, d), "metrics")
    return m, discovery.to_long(m)


def long_rows(s, d):
    return metrics.ranked_rates(placed_rows(s, d)).where("percentile is not null").select("player_id", "season", "position_group", "metric", "percentile", F.col("value").alias("per90"), "sample_size")


@query("merge_sources", over_metrics("SELECT player_id, season, minutes, league_id, club_id, goals, assists, xg, xa, shots, saves, position_hint FROM merged"))
def merge_sources(s, d):
    m = metrics.merge_sources(season_rows(s, d))
    return m.select("player_id", "season", "minutes", "league_id", "club_id", "goals", "assists", "xg", "xa", F.col("key_metrics")["shots"].alias("shots"), F.col("key_metrics")["saves"].alias("saves"), "position_hint")


@query("per90_values", over_metrics(f"SELECT {K3}, metric, value FROM rates"))
def per90_values(s, d):
    return metrics.per90_values(placed_rows(s, d))


@query("keeper_gate", over_metrics("SELECT p.player_id, p.season, count(r.metric) AS n FROM placed p LEFT JOIN rates r USING (player_id, season) WHERE p.position_group = 'GK' GROUP BY ALL"))
def keeper_gate(s, d):
    return metric_rows(s, d).where("position_group = 'GK'").select("player_id", "season", F.size("per90").cast("long").alias("n"))


@query("peer_rank", over_metrics(f"SELECT {K3}, metric, value, zscore, percentile, sample_size FROM ranked"))
def peer_rank(s, d):
    return metrics.ranked_rates(placed_rows(s, d))


_AXIS = [r(f"(coalesce(max(CASE WHEN metric = '{a}' THEN percentile END), 0.5) - 0.5) * 2", 4) for a in ROLE_AXES]
VECTORS = {"v8": f"SELECT {K3}, [{', '.join(_AXIS)}] AS v FROM long WHERE position_group <> 'GK' GROUP BY ALL", "vectors": "SELECT * FROM v8 WHERE sqrt(list_sum(list_transform(v, lambda x: x * x))) >= 0.05"}


@query("role_vector", over_metrics(f"SELECT {K3}, {', '.join(f'v[{i + 1}] AS a{i}' for i in range(8))} FROM vectors", extra=VECTORS))
def role_vector(s, d):
    return metrics.vectors_of(metric_rows(s, d)).select("player_id", "season", "position_group", *[F.col("embedding")[i].alias(f"a{i}") for i in range(8)])


@query("compute_metrics", over_metrics(f"SELECT p.player_id, p.season, p.position_group, p.league_id, p.club_id, p.minutes, count(r.metric) AS n_rates, count(r.percentile) AS n_ranked, sum(CAST(round(r.percentile * 1000) AS BIGINT)) AS sum_percentile, max(r.sample_size) AS largest FROM placed p LEFT JOIN ranked r USING ({K3}) WHERE p.position_group IS NOT NULL GROUP BY ALL"))
def compute_metrics(s, d):
    m = metric_rows(s, d)
    values = F.map_values("percentile")
    return m.select("player_id", "season", "position_group", "league_id", "club_id", "minutes", F.size("per90").cast("long").alias("n_rates"), F.size("percentile").cast("long").alias("n_ranked"), F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + F.round(x * 1000).cast("long"))).alias("sum_percentile"), F.array_max(F.map_values("sample_size")).alias("largest"))


@query("metrics_report", over_metrics("SELECT p.season, p.position_group, count(*) AS n, count(x.player_id) AS n_vectors FROM placed p LEFT JOIN vectors x USING (player_id, season) GROUP BY p.season, p.position_group", extra=VECTORS))
def metrics_report(s, d):
    rows = written(placed_rows(s, d), "placed")
    return metrics.metrics_report(metrics.metrics_of(rows), rows)


@query("league_strength", with_tables("leagues clubs people", f", b AS (SELECT c.league_id, median(market_value_eur) AS m FROM people p JOIN clubs c ON c.id = p.current_club_id WHERE market_value_eur > 0 GROUP BY 1 HAVING count(*) >= 5), x AS (SELECT league_id, log10(m) AS l, min(log10(m)) OVER () AS lo, max(log10(m)) OVER () AS hi FROM b) SELECT g.id, coalesce({r('0.05::DOUBLE + 0.95::DOUBLE * CASE WHEN hi <= lo THEN 1.0 ELSE (l - lo) / (hi - lo) END', 3)}, g.strength_coef) AS strength_coef, CASE WHEN x.league_id IS NOT NULL THEN 'market-value' END AS coef_source FROM leagues g LEFT JOIN x ON x.league_id = g.id"))
def league_strength(s, d):
    return metrics.league_strength(table(s, d, "leagues"), table(s, d, "clubs"), table(s, d, "people"), min_players=5).select("id", "strength_coef", "coef_source")


# --- discovery --------------------------------------------------------------------------------------------------

FAMILY = f"(metric IN ({quoted(KEEPER_METRICS)})) = (position_group = 'GK')"
STRONG = f"SELECT *, row_number() OVER (PARTITION BY {K3} ORDER BY percentile DESC, metric) AS rank FROM long WHERE sample_size >= 30 AND {FAMILY} AND metric NOT IN ({quoted(CONTEXT_METRICS)}) AND percentile >= 0.7"
WEAK = f"SELECT *, row_number() OVER (PARTITION BY {K3} ORDER BY percentile, metric) AS rank FROM long WHERE sample_size >= 30 AND {FAMILY} AND percentile <= 0.3"
PLACE = "CASE " + " ".join(f"WHEN position_group = '{g}' AND metric = '{m}' THEN {i}" for g, ms in RADAR_AXES.items() for i, m in enumerate(ms)) + " END"
AXES = {"axed": f"SELECT * FROM (SELECT *, {PLACE} AS axis FROM long) WHERE axis IS NOT NULL", "profile": f"SELECT {K3}, CASE WHEN count(*) FILTER (sample_size >= 30) >= 3 THEN sum(floor(percentile * 1000 + 0.5)) FILTER (sample_size >= 30) / 1000 / count(*) FILTER (sample_size >= 30) END AS profile, count(*) AS axes_measured FROM axed GROUP BY ALL"}


@query("strengths", over_metrics(f"SELECT {K3}, metric, percentile, per90, sample_size, CAST(rank AS INT) AS rank FROM ({STRONG}) WHERE rank <= 3"))
def strengths(s, d):
    return discovery.notes(long_rows(s, d), True)


@query("weaknesses", over_metrics(f"SELECT {K3}, metric, percentile, per90, sample_size, CAST(rank AS INT) AS rank FROM ({WEAK}) WHERE rank <= 2"))
def weaknesses(s, d):
    return discovery.notes(long_rows(s, d), False)


@query("differences", over_metrics(f"SELECT candidate_id, reference_id, season, position_group, metric, candidate_percentile, reference_percentile, gap, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, reference_id, season, position_group ORDER BY abs(gap) DESC, metric) AS rank FROM (SELECT c.player_id AS candidate_id, f.player_id AS reference_id, season, position_group, metric, c.percentile AS candidate_percentile, f.percentile AS reference_percentile, {r('c.percentile - f.percentile', 3)} AS gap FROM long c JOIN long f USING (season, position_group, metric) WHERE f.player_id = c.player_id + 5 AND c.sample_size >= 30 AND f.sample_size >= 30) WHERE abs(gap) >= 0.15) WHERE rank <= 3"))
def differences(s, d):
    m = placed_rows(s, d).select("player_id", "season", "position_group")
    pairs = m.select(F.col("player_id").alias("candidate_id"), (F.col("player_id") + 5).alias("reference_id"), "season", "position_group")
    return discovery.differences(pairs, long_rows(s, d))


PLACED = "FROM placed WHERE position_group IS NOT NULL"


@query("default_season", over_metrics(f"SELECT season, count(*) AS n {PLACED} GROUP BY season ORDER BY n DESC, season DESC LIMIT 1"))
def default_season(s, d):
    return discovery.default_season(metric_rows(s, d))


@query("latest_metrics", over_metrics(f"SELECT player_id, season, position_group, minutes FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC) AS n {PLACED}) WHERE n = 1"))
def latest_metrics(s, d):
    return discovery.latest_metrics(metric_rows(s, d)).select("player_id", "season", "position_group", "minutes")


@query("seasons_of", over_metrics(f"SELECT player_id, string_agg(season, ',' ORDER BY season DESC) AS seasons {PLACED} GROUP BY player_id"))
def seasons_of(s, d):
    return discovery.seasons_of(metric_rows(s, d)).select("player_id", F.array_join("seasons", ",").alias("seasons"))


@query("radar", over_metrics(f"SELECT {K3}, string_agg(metric, ',' ORDER BY axis) AS metrics, sum(CAST(round(percentile * 1000) AS BIGINT)) AS total FROM axed WHERE sample_size >= 30 GROUP BY ALL HAVING count(*) >= 3", extra=AXES))
def radar(s, d):
    return discovery.radar(long_rows(s, d)).select("player_id", "season", "position_group", F.array_join("axes.metric", ",").alias("metrics"), F.aggregate("axes.percentile", F.lit(0).cast("long"), lambda a, x: a + F.round(x * 1000).cast("long")).alias("total"))


@query("profile_strength", over_metrics(f"SELECT {K3}, {r('profile', 6)} AS profile, axes_measured FROM profile", extra=AXES))
def profile_strength(s, d):
    return discovery.profile_strength(long_rows(s, d)).withColumn("profile", rounded(F.col("profile"), 6))


CANDIDATES = "SELECT m.player_id, m.season, m.position_group, m.minutes, p.full_name, p.market_value_eur, p.birth_date, p.birth_year, c.name AS club_name, c.league_id AS club_league_id, l.name AS league_name, l.strength_coef FROM placed m JOIN players p ON p.id = m.player_id LEFT JOIN clubs c ON c.id = p.current_club_id LEFT JOIN leagues l ON l.id = m.league_id WHERE m.position_group IS NOT NULL"
FILTERED = f"{CANDIDATES} AND p.market_value_eur <= 20000 AND (p.birth_date > {TODAY} - INTERVAL 21 YEAR OR (p.birth_date IS NULL AND p.birth_year >= 1979)) AND c.league_id IN (0, 1, 2, 3, 15, 20)"


def candidate_rows(s, d, m=None, **filters):
    return discovery.candidates(metric_rows(s, d) if m is None else m, table(s, d, "players"), table(s, d, "clubs"), table(s, d, "leagues"), AS_OF, **filters)


@query("candidates", over_metrics(f"SELECT player_id, season, position_group, minutes, full_name, market_value_eur, club_name, league_name, strength_coef FROM ({FILTERED})", "clubs leagues"))
def candidates(s, d):
    return candidate_rows(s, d, max_value=20000, max_age=20, league_ids=[0, 1, 2, 3, 15, 20]).select("player_id", "season", "position_group", "minutes", "full_name", "market_value_eur", "club_name", "league_name", "strength_coef")


SIMILAR = "SELECT {k}, CAST(rank AS INT) AS rank, candidate_id, {d4} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY distance, candidate_id) AS rank FROM (SELECT {ak}, b.player_id AS candidate_id, round(list_cosine_distance(a.v, b.v), 9) AS distance FROM vectors a JOIN vectors b ON {on} AND a.player_id <> b.player_id)) WHERE rank <= 10"


@query("similar_players", over_metrics(SIMILAR.format(k="player_id, season, position_group", ak="a.player_id, a.season, a.position_group", on="a.season = b.season AND a.position_group = b.position_group", d4=r("distance", 4)), extra=VECTORS))
def similar_players(s, d):
    return discovery.similar_players(written(metrics.vectors_of(metric_rows(s, d)), "vectors"))


@query("similar_vectors", "WITH vectors AS (SELECT vec_id AS player_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) " + SIMILAR.format(k="player_id, label", ak="a.player_id, a.label", on="a.label = b.label", d4=r("distance", 4)))
def similar_vectors(s, d):
    v = base(s, d, "embeddings").select(F.col("vec_id").alias("player_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return discovery.similar_players(v, block=("label",))


PROGRESSION = AXES | {
    "fields": f"SELECT {K3}, CAST(count(*) FILTER (sample_size >= 30) AS INT) AS n_axes, max(sample_size) FILTER (sample_size >= 30) AS population FROM axed GROUP BY ALL",
    "steps": f"SELECT p.player_id, p.season, p.position_group, p.minutes, p.league_id, p.club_id, f.profile, coalesce(x.n_axes, 0) AS n_axes, coalesce(x.population, 0) AS population, count(*) OVER (PARTITION BY p.player_id, p.position_group) AS gn FROM placed p LEFT JOIN profile f USING ({K3}) LEFT JOIN fields x USING ({K3}) WHERE p.position_group IS NOT NULL",
    "prog": f"SELECT {K3}, CAST(row_number() OVER (PARTITION BY player_id ORDER BY season) AS INT) AS place, minutes, league_id, club_id, {r('profile', 3)} AS profile, n_axes, population, first(position_group) OVER (PARTITION BY player_id ORDER BY gn DESC, position_group) AS leading_group, {r('last_value(profile IGNORE NULLS) OVER w - first_value(profile IGNORE NULLS) OVER w', 3)} AS profile_delta FROM steps WINDOW w AS (PARTITION BY player_id ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
}


@query("progression", over_metrics("SELECT * FROM prog", extra=PROGRESSION))
def progression(s, d):
    m, long = both_rows(s, d)
    return discovery.progression(m, long)


@query("progression_flags", over_metrics("SELECT player_id, count(*) = 1 AS single_season, coalesce(max(nullif(population, 0)) / CAST(min(nullif(population, 0)) AS DOUBLE) >= 1.75, false) AS population_drifted, count(DISTINCT position_group) > 1 AS several_groups FROM prog GROUP BY player_id", extra=PROGRESSION))
def progression_flags(s, d):
    m, long = both_rows(s, d)
    return discovery.progression_flags(discovery.progression(m, long))


_ONE = "CASE WHEN len(groups) = 1 THEN groups[1] END"
COMPARE = {
    "sets": "SELECT p_partkey // 3 AS set_id, p_partkey % 3 AS place, p_partkey AS player_id FROM part",
    "latest": f"SELECT player_id, max(season) AS season {PLACED} GROUP BY player_id",
    "chosen": "SELECT set_id, player_id, season, position_group FROM sets JOIN latest USING (player_id) JOIN placed USING (player_id, season)",
    "heads": "SELECT set_id, count(DISTINCT player_id) AS n_players, list_sort(list(DISTINCT position_group)) AS groups FROM chosen GROUP BY set_id",
    "held": f"SELECT set_id, metric, count(*) AS n, n_players, groups, (SELECT 1) AS one FROM chosen JOIN long USING (player_id, season, position_group) JOIN heads USING (set_id) WHERE sample_size >= 30 AND metric NOT IN ({quoted(CONTEXT_METRICS)}) GROUP BY ALL",
    "spots": f"SELECT set_id, metric, n = n_players AS shared, {PLACE.replace('position_group', f'({_ONE})')} AS axis FROM held",
    "listed": "SELECT set_id, list(metric ORDER BY coalesce(axis, 99), metric) FILTER (shared) AS axes, list(metric ORDER BY axis) FILTER (shared AND axis IS NOT NULL) AS on_radar, list(metric ORDER BY metric) FILTER (NOT shared) AS dropped FROM spots GROUP BY set_id",
}


@query("compare", over_metrics("SELECT set_id, n_players, coalesce(array_to_string(axes, ','), '') AS axes, CASE WHEN len(on_radar) >= 3 THEN array_to_string(on_radar, ',') WHEN len(axes) >= 3 THEN array_to_string(axes[1:6], ',') ELSE '' END AS chart_axes, coalesce(array_to_string(dropped, ','), '') AS dropped, array_to_string(groups, ',') AS position_groups FROM heads LEFT JOIN listed USING (set_id)", extra=COMPARE))
def compare(s, d):
    m, long = both_rows(s, d)
    sets = base(s, d, "part").select(F.expr("p_partkey div 3").alias("set_id"), (F.col("p_partkey") % 3).alias("place"), F.col("p_partkey").alias("player_id"), F.lit(None).cast("string").alias("season"))
    out = discovery.compare(sets, m, long)
    return out.select("set_id", "n_players", *[F.array_join(c, ",").alias(c) for c in ("axes", "chart_axes", "dropped", "position_groups")])


AGE = f"CASE WHEN birth_date IS NOT NULL THEN year({TODAY}) - year(birth_date) - CASE WHEN (month({TODAY}), day({TODAY})) < (month(birth_date), day(birth_date)) THEN 1 ELSE 0 END ELSE year({TODAY}) - birth_year END"
_WEIGHT = "(0.4::DOUBLE + 0.6::DOUBLE * greatest(0.0, least(1.0, coalesce(strength_coef, 0.0))))"
_YOUTH = "greatest(0.0, least(1.0, (24 - age) / 8.0::DOUBLE))"
RISING = AXES | {
    "cands": f"SELECT *, {AGE} AS age FROM ({CANDIDATES})",
    "scored": f"SELECT {K3}, age, {r(f'0.7::DOUBLE * profile * {_WEIGHT} + 0.3::DOUBLE * {_YOUTH}', 4)} AS score, {r('profile', 3)} AS profile, {r(_WEIGHT, 3)} AS league_weight, {r(_YOUTH, 3)} AS youth, axes_measured FROM cands JOIN profile USING ({K3}) WHERE age BETWEEN 16 AND 23 AND profile IS NOT NULL",
    "recent": f"SELECT player_id, arg_min(value_eur, date) AS a, arg_max(value_eur, date) AS b, count(*) AS points FROM market_values WHERE date >= {TODAY} - INTERVAL 400 DAY GROUP BY player_id",
    "momentum": f"SELECT player_id, a AS from_eur, b AS to_eur, {r('CAST(b AS DOUBLE) / CAST(a AS DOUBLE)', 3)} AS change_ratio, points FROM recent WHERE points >= 2 AND a > 0",
}


def values(s, d):
    return table(s, d, "market_values").withColumn("value_eur", F.col("value_eur").cast("double"))


@query("rising_score", over_metrics(f"SELECT {K3}, score, league_weight, youth FROM scored", "clubs leagues market_values", RISING))
def rising_score(s, d):
    m, long = both_rows(s, d)
    rows = candidate_rows(s, d, m).withColumn("age", age_at("birth_date", "birth_year", AS_OF)).where("age <= 23").join(discovery.profile_strength(long), discovery.KEYS)
    rows = rows.withColumns(discovery.rising_score(F.col("profile"), F.col("age"), F.col("strength_coef")))
    return rows.where("score is not null").select(*discovery.KEYS, "score", "league_weight", "youth")


@query("value_momentum", over_metrics("SELECT player_id, CAST(from_eur AS DOUBLE) AS from_eur, CAST(to_eur AS DOUBLE) AS to_eur, change_ratio, points FROM momentum", "clubs leagues market_values", RISING))
def value_momentum(s, d):
    return discovery.value_momentum(values(s, d), AS_OF)


_RISING = f"SELECT {K3}, age, score, profile, league_weight, youth, axes_measured, change_ratio FROM ({{}}) LEFT JOIN momentum USING (player_id)"


@query("rising", over_metrics(_RISING.format("SELECT * FROM scored ORDER BY score DESC, player_id, season LIMIT 25"), "clubs leagues market_values", RISING))
def rising(s, d):
    m, long = both_rows(s, d)
    return discovery.rising(candidate_rows(s, d, m), long, values(s, d), AS_OF)


@query("rising_by_group", over_metrics(_RISING.format("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, position_group ORDER BY score DESC, player_id) AS n FROM scored) WHERE n <= 5"), "clubs leagues market_values", RISING))
def rising_by_group(s, d):
    m, long = both_rows(s, d)
    return discovery.rising(candidate_rows(s, d, m), long, values(s, d), AS_OF, limit=5, by=["season", "position_group"])


_TOP = "SELECT player_id, season, position_group, minutes, metric, percentile FROM ({}) ORDER BY percentile DESC, player_id, season LIMIT 25"
_BAR = f"SELECT {K3}, p.minutes, metric, percentile FROM ({{}}) b JOIN placed p USING ({K3})"


@query("discover_by_metric", over_metrics(_TOP.format(_BAR.format("SELECT * FROM long WHERE metric = 'tackles_won' AND percentile >= 0.7 AND sample_size >= 30"))))
def discover_by_metric(s, d):
    m, long = both_rows(s, d)
    return discovery.discover(m, long, "tackles_won")


@query("discover_best_strength", over_metrics(_TOP.format(_BAR.format(f"SELECT * FROM ({STRONG}) WHERE rank = 1"))))
def discover_best_strength(s, d):
    m, long = both_rows(s, d)
    return discovery.discover(m, long)


FLAGSHIP = over_metrics(f"SELECT {K3}, minutes, metric, percentile FROM (SELECT *, row_number() OVER (PARTITION BY season, position_group ORDER BY percentile DESC, player_id) AS n FROM ({_BAR.format(f'SELECT * FROM ({STRONG}) WHERE rank = 1')})) WHERE n <= 10")


@query("discover_best_by_group", FLAGSHIP)
def discover_best_by_group(s, d):
    m, long = both_rows(s, d)
    return discovery.discover(m, long, limit=10, by=["season", "position_group"])


@query("metric_coverage", over_metrics("SELECT metric, count(*) AS n FROM long GROUP BY metric"))
def metric_coverage(s, d):
    return discovery.metric_coverage(metric_rows(s, d))


@query("season_options", over_metrics(f"SELECT DISTINCT season {PLACED}"))
def season_options(s, d):
    return discovery.season_options(metric_rows(s, d))


# --- views ------------------------------------------------------------------------------------------------------

FORM = {
    "f": "SELECT a.player_id, a.match_id, a.played_on, coalesce(a.minutes, 0) AS minutes, coalesce(a.goals, 0) AS goals, coalesce(a.assists, 0) AS assists, c.name AS club_name, l.name AS league_name, CASE WHEN m.home_club_id = a.club_id THEN w.name ELSE h.name END AS opponent_name, coalesce(m.home_club_id = a.club_id, false) AS is_home, row_number() OVER (PARTITION BY a.player_id ORDER BY a.played_on DESC NULLS LAST, a.match_id DESC) AS back FROM appearances a JOIN matches m ON m.id = a.match_id LEFT JOIN clubs c ON c.id = a.club_id LEFT JOIN leagues l ON l.id = m.league_id LEFT JOIN clubs h ON h.id = m.home_club_id LEFT JOIN clubs w ON w.id = m.away_club_id",
    "form": "SELECT player_id, match_id, played_on, minutes, goals, assists, club_name, league_name, opponent_name, is_home, CAST(row_number() OVER (PARTITION BY player_id ORDER BY back DESC) AS INT) AS place FROM f WHERE back <= 20",
    "series": f"SELECT player_id, match_id, played_on, place, CAST(goals + assists AS DOUBLE) AS value, {r('avg(goals + assists) OVER (PARTITION BY player_id ORDER BY place ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 3)} AS rolling FROM form",
}
FORM_TABLES = "appearances matches clubs leagues"


def form_rows(s, d):
    return views.match_rows(table(s, d, "appearances"), table(s, d, "matches"), table(s, d, "clubs"), table(s, d, "leagues"), 20)


@query("match_rows", with_tables(FORM_TABLES, "SELECT * FROM form", FORM))
def match_rows(s, d):
    return form_rows(s, d)


@query("form_series", with_tables(FORM_TABLES, "SELECT * FROM series", FORM))
def form_series(s, d):
    return views.form_series(form_rows(s, d), "goal_contributions")


@query("trend_direction", with_tables(FORM_TABLES, f"SELECT player_id, {r('avg(rolling) FILTER (i > n - greatest(1, n // 3))', 6)} >= {r('avg(rolling) FILTER (i <= greatest(1, n // 3))', 6)} AS rising FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY place) AS i, count(*) OVER (PARTITION BY player_id) AS n FROM series) WHERE n >= 2 GROUP BY player_id", FORM))
def trend_direction(s, d):
    return views.trend_direction(views.form_series(form_rows(s, d), "goal_contributions"))


@query("season_trend", with_tables("appearances matches", f"SELECT player_id, season, count(*) AS matches, CAST(sum(minutes) AS BIGINT) AS minutes, {r('CAST(sum(minutes) AS DOUBLE) / count(*)', 1)} AS minutes_per_match, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists, CASE WHEN sum(minutes) >= 900 THEN {r('sum(goals) * 90 / CAST(sum(minutes) AS DOUBLE)', 3)} END AS goals_per_90, CASE WHEN sum(minutes) >= 900 THEN {r('sum(assists) * 90 / CAST(sum(minutes) AS DOUBLE)', 3)} END AS assists_per_90 FROM appearances JOIN matches m ON m.id = match_id GROUP BY player_id, season"))
def season_trend(s, d):
    return views.season_trend(table(s, d, "appearances"), table(s, d, "matches"))


XG = "CAST(sum(CAST(xg AS DECIMAL(18,6))) AS DOUBLE)"


@query("shot_totals", with_tables("shots", f"SELECT player_id, count(*) AS shots, count(*) FILTER (is_goal) AS goals, {r(XG, 2)} AS xg, {r(f'count(*) FILTER (is_goal) - {XG}', 2)} AS goals_minus_xg FROM shots GROUP BY player_id"))
def shot_totals(s, d):
    return views.shot_totals(table(s, d, "shots"))


def _zones_sql(source: str) -> str:
    return with_tables("shots", f"SELECT player_id, zone, count(*) AS shots, count(*) FILTER (is_goal) AS goals, {r(XG, 2)} AS xg, {r(f'{XG} / count(*)', 3)} AS xg_per_shot, CAST(row_number() OVER (PARTITION BY player_id ORDER BY count(*) DESC, zone) AS INT) AS rank FROM (SELECT *, {ZONE} AS zone FROM ({source})) GROUP BY player_id, zone")


@query("shot_zones", _zones_sql("SELECT * FROM shots"))
def shot_zones(s, d):
    return views.shot_zones(table(s, d, "shots"))


@query("shot_zones_recent", _zones_sql("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY played_on DESC NULLS LAST, id DESC) AS n FROM shots) WHERE n <= 20"))
def shot_zones_recent(s, d):
    return views.shot_zones(table(s, d, "shots"), n=20)


# season rows of about half of the clubs and leagues lose their club here, and clubs above 4 their live players, so that all fallbacks occur
SQUAD = {
    "st": "SELECT * REPLACE (CASE WHEN league_id % 2 = 0 AND club_id % 3 <> 2 THEN club_id END AS club_id) FROM season_stats",
    "pl": "SELECT * REPLACE (CASE WHEN current_club_id > 4 THEN NULL ELSE api_football_id END AS api_football_id) FROM players",
    "latest_club": "SELECT club_id, max(season) AS season FROM st GROUP BY club_id",
    "every": "SELECT current_club_id AS club_id, id AS player_id, 0 AS rank FROM pl WHERE current_club_id IS NOT NULL AND api_football_id IS NOT NULL UNION ALL SELECT DISTINCT club_id, player_id, 1 FROM st JOIN latest_club USING (club_id, season) UNION ALL SELECT current_club_id, id, 2 FROM pl WHERE current_club_id IS NOT NULL",
    "ofl": "SELECT id AS club_id, league_id FROM clubs",
    "live": "SELECT current_club_id AS club_id, league_id, count(*) AS live FROM pl JOIN ofl ON ofl.club_id = current_club_id WHERE api_football_id IS NOT NULL GROUP BY ALL",
    "srows": "SELECT s.player_id, s.season, s.club_id, o.league_id AS lid FROM st s JOIN ofl o USING (club_id)",
    "latest": "SELECT lid, max(season) AS season FROM srows GROUP BY lid",
    "seasonal": "SELECT lid, season, club_id, count(DISTINCT player_id) AS size FROM srows JOIN latest USING (lid, season) GROUP BY ALL",
    "filed": "SELECT o.league_id AS lid, o.club_id, count(p.id) AS size FROM ofl o LEFT JOIN pl p ON p.current_club_id = o.club_id GROUP BY ALL",
    "sized": "SELECT lid, club_id, size FROM seasonal UNION ALL SELECT lid, club_id, size FROM filed WHERE size > 0 AND lid NOT IN (SELECT lid FROM latest)",
    "members": "SELECT s.lid, s.club_id, coalesce(l.live, s.size) AS squad_size FROM sized s LEFT JOIN live l ON l.club_id = s.club_id UNION ALL SELECT league_id, club_id, live FROM live WHERE league_id NOT IN (SELECT lid FROM sized) UNION ALL SELECT league_id, club_id, 0 FROM ofl WHERE league_id NOT IN (SELECT lid FROM sized) AND league_id NOT IN (SELECT league_id FROM live)",
    "counted": "SELECT f.lid AS league_id, any_value(l.season) AS season, CASE WHEN any_value(l.season) IS NULL THEN count(DISTINCT f.club_id) ELSE (SELECT count(*) FROM seasonal x WHERE x.lid = f.lid) END AS clubs, CASE WHEN any_value(l.season) IS NULL THEN CAST(sum(f.size) AS BIGINT) ELSE (SELECT count(DISTINCT player_id) FROM srows JOIN latest USING (lid, season) WHERE lid = f.lid) END AS players FROM filed f LEFT JOIN latest l ON l.lid = f.lid GROUP BY f.lid",
}
SQUAD_TABLES = "season_stats players clubs leagues countries"


def squad_tables(s, d):
    p = table(s, d, "players").withColumn("api_football_id", F.when(F.coalesce(F.col("current_club_id") <= 4, F.lit(True)), F.col("api_football_id")))
    return table(s, d, "leagues"), table(s, d, "clubs"), p, table(s, d, "season_stats").withColumn("club_id", F.expr("CASE WHEN league_id % 2 = 0 AND club_id % 3 <> 2 THEN club_id END"))


@query("squads", with_tables(SQUAD_TABLES, "SELECT club_id, player_id, CASE rank WHEN 0 THEN 'live' WHEN 1 THEN 'season' ELSE 'registered' END AS source, CAST(row_number() OVER (PARTITION BY club_id ORDER BY market_value_eur DESC NULLS LAST, full_name, player_id) AS INT) AS place FROM (SELECT e.*, min(rank) OVER (PARTITION BY club_id) AS best FROM every e JOIN ofl USING (club_id)) e JOIN pl p ON p.id = e.player_id WHERE rank = best", SQUAD))
def squads(s, d):
    _, clubs, players, stats = squad_tables(s, d)
    return views.squads(clubs, players, stats)


@query("league_clubs", with_tables(SQUAD_TABLES, "SELECT m.lid AS league_id, m.club_id, m.squad_size, CASE WHEN m.lid IN (SELECT league_id FROM live) THEN 'live' WHEN m.lid IN (SELECT lid FROM latest) THEN 'season' ELSE 'registered' END AS squad_source, CAST(row_number() OVER (PARTITION BY m.lid ORDER BY m.squad_size DESC, c.name, m.club_id) AS INT) AS place FROM members m JOIN clubs c ON c.id = m.club_id", SQUAD))
def league_clubs(s, d):
    return views.league_clubs(*squad_tables(s, d))


@query("league_counts", with_tables(SQUAD_TABLES, "SELECT * FROM counted", SQUAD))
def league_counts(s, d):
    return views.league_counts(*squad_tables(s, d))


@query("league_nodes", with_tables(SQUAD_TABLES, "SELECT l.id AS league_id, l.name, country_code, tier, strength_coef, k.lat, k.lng, n.season, coalesce(n.clubs, 0) AS clubs, coalesce(n.players, 0) AS players, CAST(row_number() OVER (ORDER BY strength_coef DESC NULLS LAST, l.id) AS INT) AS place FROM leagues l JOIN countries k ON k.code = l.country_code LEFT JOIN counted n ON n.league_id = l.id WHERE k.lat IS NOT NULL", SQUAD))
def league_nodes(s, d):
    leagues, clubs, players, stats = squad_tables(s, d)
    return views.league_nodes(leagues, table(s, d, "countries"), clubs, players, stats)


@query("countries_with_leagues", with_tables("countries leagues", "SELECT code, name, name_tr, lat, lng FROM countries WHERE lat IS NOT NULL AND code IN (SELECT country_code FROM leagues)"))
def countries_with_leagues(s, d):
    return views.countries_with_leagues(table(s, d, "leagues"), table(s, d, "countries"))


ARCS = "SELECT fk.code AS from_country, tk.code AS to_country, count(*) AS transfers, sum(fee_eur) AS total_fee_eur FROM transfers t JOIN clubs f ON f.id = t.from_club_id JOIN clubs g ON g.id = t.to_club_id JOIN leagues fl ON fl.id = f.league_id JOIN leagues tl ON tl.id = g.league_id JOIN countries fk ON fk.code = fl.country_code JOIN countries tk ON tk.code = tl.country_code WHERE fk.code <> tk.code AND fk.lat IS NOT NULL AND tk.lat IS NOT NULL{} GROUP BY 1, 2 ORDER BY transfers DESC, 1, 2 LIMIT {}"


@query("transfer_arcs", with_tables("transfers clubs leagues countries", f"SELECT from_country, to_country, CAST(transfers AS BIGINT) AS transfers, CAST(total_fee_eur AS DOUBLE) AS total_fee_eur FROM ({ARCS.format('', 120)})"))
def transfer_arcs(s, d):
    return views.transfer_arcs(*(table(s, d, t) for t in ("transfers", "clubs", "leagues", "countries"))).withColumn("total_fee_eur", F.col("total_fee_eur").cast("double"))


@query("transfer_arcs_season", with_tables("transfers clubs leagues countries", f"SELECT from_country, to_country, CAST(transfers AS BIGINT) AS transfers, CAST(total_fee_eur AS DOUBLE) AS total_fee_eur FROM ({ARCS.format(chr(32) + 'AND season = ' + repr('1997'), 5)})"))
def transfer_arcs_season(s, d):
    return views.transfer_arcs(*(table(s, d, t) for t in ("transfers", "clubs", "leagues", "countries")), season="1997", top=5).withColumn("total_fee_eur", F.col("total_fee_eur").cast("double"))


BOARD = "SELECT t.id, t.player_id, p.full_name, transfer_date, date_is_exact, CAST(fee_eur AS DOUBLE) AS fee_eur, from_club_id, to_club_id, f.name AS from_name, g.name AS to_name FROM transfers t JOIN people p ON p.id = t.player_id LEFT JOIN clubs f ON f.id = from_club_id LEFT JOIN clubs g ON g.id = to_club_id WHERE coalesce(transfer_type, '') NOT IN ('Raise', 'End of career') AND transfer_date <= {} {} ORDER BY transfer_date DESC, date_is_exact DESC, t.fee_eur DESC NULLS LAST, t.id DESC LIMIT {} OFFSET {}"


def board_rows(s, d, **options):
    return views.transfer_board(table(s, d, "transfers"), table(s, d, "people"), table(s, d, "clubs"), AS_OF, **options).withColumn("fee_eur", F.col("fee_eur").cast("double"))


@query("transfer_board", with_tables("transfers people clubs", BOARD.format(TODAY, "", 50, 0)))
def transfer_board(s, d):
    return board_rows(s, d)


@query("transfer_board_league", with_tables("transfers people clubs", BOARD.format(TODAY, "AND fee_eur >= 100000 AND (f.league_id = 20 OR g.league_id = 20)", 40, 10)))
def transfer_board_league(s, d):
    return board_rows(s, d, league_id=20, min_fee=100000, limit=40, offset=10)


@query("transfer_board_club", with_tables("transfers people clubs", BOARD.format(TODAY, "AND g.id = 3", 50, 0)))
def transfer_board_club(s, d):
    return board_rows(s, d, club_id=3, direction="in")


@query("board_seasons", with_tables("transfers", "SELECT DISTINCT CASE WHEN regexp_matches(season, '^\\d{2}/') THEN concat('20', substr(season, 1, 2), '-', substr(season, 4)) ELSE season END AS season FROM transfers WHERE season IS NOT NULL AND coalesce(transfer_type, '') <> 'Raise'"))
def board_seasons(s, d):
    return views.board_seasons(table(s, d, "transfers"))


SEARCH = {
    "q": "SELECT DISTINCT split_part(p_name, ' ', 1 + CAST(p_partkey % 2 AS INT)) AS query FROM part UNION SELECT DISTINCT substr(p_name, 2, 2) FROM part UNION SELECT DISTINCT upper(substr(s_name, 3, 6)) FROM supplier UNION SELECT 'tion_1' UNION SELECT 'x'",
    "nm": "SELECT 'player' AS kind, p.id, full_name AS label, nullif(concat_ws(' · ', c.name, position), '') AS detail, CASE WHEN p.current_club_id IS NULL THEN 1 ELSE 0 END AS a, market_value_eur AS b, '' AS c FROM players p LEFT JOIN clubs c ON c.id = p.current_club_id UNION ALL SELECT 'club', k.id, k.name, l.name, 0, 0, k.name FROM clubs k LEFT JOIN leagues l ON l.id = k.league_id UNION ALL SELECT 'league', id, name, CASE WHEN tier = 1 THEN country_code ELSE concat(country_code, ' · ', tier, '. lig') END, tier, 0, name FROM leagues",
}


@query("search", with_tables("players clubs leagues", "SELECT query, kind, CAST(rank AS INT) AS rank, id, label, detail FROM (SELECT *, row_number() OVER (PARTITION BY query, kind ORDER BY CASE WHEN starts_with(lower(label), lower(query)) THEN 0 ELSE 1 END, a, b DESC NULLS LAST, c, id) AS rank FROM q JOIN nm ON length(query) >= 2 AND contains(lower(label), lower(query))) WHERE rank <= 6", SEARCH))
def search(s, d):
    p = base(s, d, "part")
    q = p.select(F.expr("split_part(p_name, ' ', 1 + CAST(p_partkey % 2 AS INT))").alias("query")).union(p.select(F.expr("substr(p_name, 2, 2)"))).union(base(s, d, "supplier").select(F.expr("upper(substr(s_name, 3, 6))"))).union(s.createDataFrame([("tion_1",), ("x",)], "query string"))
    return views.search(q.distinct(), table(s, d, "players"), table(s, d, "clubs"), table(s, d, "leagues"))


FOUND = f"FROM players p LEFT JOIN clubs c ON c.id = p.current_club_id WHERE contains(lower(full_name), 're') AND market_value_eur <= 40000 AND birth_date <= {TODAY} - INTERVAL 17 YEAR AND birth_date > {TODAY} - INTERVAL 31 YEAR AND p.id IN (SELECT player_id FROM season_stats WHERE minutes >= 1500)"


@query("search_players", with_tables("players clubs season_stats", f"SELECT p.id, full_name, position, c.name AS club_name, league_id, market_value_eur {FOUND} ORDER BY market_value_eur DESC NULLS LAST, full_name, p.id LIMIT 25"))
def search_players(s, d):
    return views.search_players(table(s, d, "players"), table(s, d, "clubs"), table(s, d, "season_stats"), AS_OF, q="RE", value_max=40000, age_min=17, age_max=30, minutes_min=1500)[0]


@query("search_players_total", with_tables("players clubs season_stats", f"SELECT count(*) AS total {FOUND}"))
def search_players_total(s, d):
    return views.search_players(table(s, d, "players"), table(s, d, "clubs"), table(s, d, "season_stats"), AS_OF, q="RE", value_max=40000, age_min=17, age_max=30, minutes_min=1500)[1]


@query("player_profiles", with_tables("players season_stats market_values clubs leagues", f", ss AS (SELECT player_id, count(*) AS n_seasons, max(season) AS newest, sum(CAST(round(coalesce(CASE WHEN minutes >= 900 THEN {r('goals * 90 / CAST(minutes AS DOUBLE)', 3)} END, 0) * 1000) AS BIGINT)) AS rates FROM season_stats GROUP BY 1), vv AS (SELECT player_id, count(*) AS n_values, min(date) AS first_value FROM market_values GROUP BY 1) SELECT p.id AS player_id, full_name, c.name AS club_name, l.name AS league_name, n_seasons, newest, rates, n_values, first_value FROM players p LEFT JOIN clubs c ON c.id = p.current_club_id LEFT JOIN leagues l ON l.id = c.league_id LEFT JOIN ss ON ss.player_id = p.id LEFT JOIN vv ON vv.player_id = p.id"))
def player_profiles(s, d):
    p = views.player_profiles(*(table(s, d, t) for t in ("players", "season_stats", "market_values", "clubs", "leagues")))
    rates = F.aggregate("seasons", F.lit(0).cast("long"), lambda a, x: a + F.round(F.coalesce(x["goals_per_90"], F.lit(0.0)) * 1000).cast("long"))
    return p.select("player_id", "full_name", "club_name", "league_name", F.when(F.col("seasons").isNotNull(), F.size("seasons").cast("long")).alias("n_seasons"), F.get("seasons.season", F.lit(0)).alias("newest"), rates.alias("rates"), F.when(F.col("values").isNotNull(), F.size("values").cast("long")).alias("n_values"), F.get("values.date", F.lit(0)).alias("first_value"))


@query("freshness", with_tables("transfers matches market_values season_stats", f"SELECT (SELECT max(transfer_date) FROM transfers WHERE transfer_date <= {TODAY}) AS last_transfer_on, (SELECT max(date) FROM matches) AS last_match_on, (SELECT max(date) FROM market_values) AS last_valuation_on, (SELECT max(season) FROM season_stats) AS latest_season"))
def freshness(s, d):
    return views.freshness(*(table(s, d, t) for t in ("transfers", "matches", "market_values", "season_stats")), AS_OF)


@query("latest_runs", with_tables("runs", "SELECT source, started_at, status, rows_written FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY started_at DESC, rows_written DESC) AS n FROM runs) WHERE n = 1"))
def latest_runs(s, d):
    return views.latest_runs(table(s, d, "runs"))


# --- quality ----------------------------------------------------------------------------------------------------

COUNTED = ("players", "clubs", "leagues", "matches", "transfers", "shots")


@query("row_counts", with_tables(" ".join(COUNTED), " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in COUNTED)))
def row_counts(s, d):
    return quality.row_counts({t: table(s, d, t) for t in COUNTED})


@query("match_coverage", with_tables("matches leagues", "SELECT l.name, count(DISTINCT m.id) AS matches, min(season) AS first_season, max(season) AS last_season FROM matches m JOIN leagues l ON l.id = m.league_id GROUP BY l.name ORDER BY matches DESC, l.name LIMIT 10"))
def match_coverage(s, d):
    return quality.match_coverage(table(s, d, "matches"), table(s, d, "leagues"))


@query("source_distribution", with_tables("season_stats", "SELECT source, season, count(*) AS n, count(xg) AS with_xg, count(*) FILTER (minutes >= 900) AS enough_minutes, count(DISTINCT club_id) AS clubs FROM season_stats GROUP BY ALL"))
def source_distribution(s, d):
    return quality.source_distribution(table(s, d, "season_stats"))


@query("cross_source", with_tables("season_stats", "SELECT season, count(*) FILTER (source = 'fbref') AS fbref_rows, count(*) FILTER (source = 'understat') AS understat_rows, count(DISTINCT player_id) AS players FROM season_stats GROUP BY season"))
def cross_source(s, d):
    return quality.cross_source(table(s, d, "season_stats"))


_ratio = lambda t, name, test, limit: f"SELECT '{t}' AS table_name, '{name}' AS rule, CAST(count(*) FILTER ({test}) AS DOUBLE) / count(*) AS ratio, {limit}::DOUBLE AS threshold, CAST(count(*) FILTER ({test}) AS DOUBLE) / count(*) > {limit} AS violated FROM {t}"


@query("null_ratios", with_tables("players clubs", " UNION ALL ".join([_ratio("players", "nationality_code", "nationality_code IS NULL", 0.05), _ratio("players", "age", "birth_date IS NULL AND birth_year IS NULL", 0.05), _ratio("players", "market_value_eur", "market_value_eur IS NULL", 0.35), _ratio("clubs", "league_id", "league_id IS NULL", 0.01)])))
def null_ratios(s, d):
    return quality.null_ratios({"players": table(s, d, "players"), "clubs": table(s, d, "clubs")})


_rule = lambda t, name, test, limit, source: f"SELECT '{t}' AS table_name, '{name}' AS rule, count(*) FILTER ({test}) AS violations, {limit} AS tolerance, count(*) FILTER ({test}) > {limit} AS violated FROM {source}"


@query("integrity", with_tables("season_stats appearances matches shots runs", " UNION ALL ".join([
    _rule("player_season_stats", "negative minutes", "minutes < 0", 0, "season_stats"), _rule("player_season_stats", "minutes over 60 matches", "minutes > 5400", 0, "season_stats"), _rule("player_season_stats", "goals over shots", "goals > shots", 50, "season_stats"),
    _rule("player_season_stats", "season row without club", "club_id IS NULL", 0, "season_stats"), _rule("player_season_stats", "season row without league", "league_id IS NULL", 0, "season_stats"), _rule("player_match_stats", "over 120 minutes in a match", "minutes > 120", 5, "appearances"),
    _rule("matches", "match without league", "league_id IS NULL", 0, "matches"), _rule("shots", "shot outside the pitch", "location_x < 0 OR location_x > 1 OR location_y < 0 OR location_y > 1", 0, "shots"), _rule("shots", "xg outside 0-1", "xg < 0 OR xg > 1", 0, "shots"),
    _rule("shots", "goal flag without goal", "is_goal AND lower(coalesce(result, '')) <> 'goal'", 0, "shots"), _rule("player_match_stats", "date differs from the match", "played_on IS DISTINCT FROM date", 0, "appearances JOIN matches ON matches.id = match_id"),
    _rule("ingest_runs", "last run failed", "status = 'failed'", 0, "(SELECT arg_max(status, started_at) AS status FROM runs GROUP BY source)"),
])))
def integrity(s, d):
    return quality.integrity({"player_season_stats": table(s, d, "season_stats"), "player_match_stats": table(s, d, "appearances"), "matches": table(s, d, "matches"), "shots": table(s, d, "shots"), "ingest_runs": table(s, d, "runs")}, AS_OF)


@query("worklist_status", with_tables("worklist", "SELECT source, entity, count(*) FILTER (trim(target_id) = '') AS pending, count(*) FILTER (trim(target_id) <> '') AS resolved FROM worklist GROUP BY ALL"))
def worklist_status(s, d):
    return quality.worklist_status(table(s, d, "worklist"))


# --- entity resolution ------------------------------------------------------------------------------------------

MISSING = "SELECT p_name AS player, p_size AS born, p_partkey % 10 AS club_id FROM part"


@query("create_missing", f"SELECT any_value({norm_sql('player')}) AS name_key, born AS birth_year, min(club_id) AS current_club_id, count(DISTINCT club_id) AS clubs FROM ({MISSING}) GROUP BY {norm_sql('player')}, born")
def create_missing(s, d):
    rows = base(s, d, "part").select(F.col("p_name").alias("player"), F.col("p_size").alias("born"), (F.col("p_partkey") % 10).alias("club_id"), F.lit("MF").alias("position"))
    new, ids = resolve.create_missing(rows)
    return new.join(ids.groupBy(F.col("player_id").alias("id")).agg(F.count_distinct("club_id").alias("clubs")), "id").select(normalize_name("full_name").alias("name_key"), "birth_year", "current_club_id", "clubs")


@query("create_missing_clubs", "SELECT DISTINCT n_name AS name, n_regionkey AS league_id FROM nation")
def create_missing_clubs(s, d):
    return resolve.create_missing_clubs(base(s, d, "nation").select(F.col("n_regionkey").alias("league_id"), F.col("n_name").alias("team"))).select("name", "league_id")


# people of this section have a name of their own: two words from the key, so that resolution has something to find
_word = lambda e: "concat(" + ", ".join(f"chr(CAST(97 + ({e}{m}) % {n} AS INT))" for m, n in (("", 26), (" * 7", 25), (" * 11", 23))) + f", CAST({e} AS STRING))"
_last = lambda e: f"concat('s', {_word(e)})"
FIRST, LAST = _word("(p_partkey % 40)"), _last("(p_partkey % 701)")
PERSON = f"SELECT p_partkey AS id, CONCAT({FIRST}, ' ', {LAST}) AS full_name, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 10 END AS current_club_id, CASE WHEN p_partkey % 4 = 1 THEN 9000000 + p_partkey END AS api_football_id FROM {{part}}"
_sql = lambda s, d, q: s.sql(q, part=base(s, d, "part"))
_duck = lambda q: q.replace("{part}", "part")


LEFT = "p_partkey % 10 AS club_id, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey END AS player_id FROM {part} WHERE p_partkey % 3 = 0 AND p_partkey % 10 <> 7 OR p_partkey % 90 = 7"


@query("mark_departures", f"WITH p AS ({_duck(PERSON)}), m AS (SELECT {_duck(LEFT)}), sure AS (SELECT club_id FROM m GROUP BY club_id HAVING count(player_id) >= greatest(5, count(*) // 2)) SELECT id, full_name, CASE WHEN current_club_id IN (SELECT club_id FROM sure) AND NOT EXISTS (SELECT 1 FROM m WHERE m.club_id = p.current_club_id AND m.player_id = p.id) THEN NULL ELSE current_club_id END AS current_club_id, api_football_id FROM p")
def mark_departures(s, d):
    return resolve.mark_departures(_sql(s, d, PERSON), _sql(s, d, f"SELECT {LEFT}"))


FLAT = "SELECT o_custkey AS api_id, CONCAT('An', CAST(o_custkey AS STRING), ' Player') AS name, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date, CASE o_orderpriority WHEN '1-URGENT' THEN 'Raise' WHEN '2-HIGH' THEN 'Loan' ELSE 'Free' END AS type, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 4 END AS out_team, CASE WHEN o_orderkey % 6 <> 0 THEN CONCAT('club', CAST(o_orderkey % 4 AS STRING)) END AS out_name, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey * 3 + 1) % 4 ELSE 77 END AS in_team, CASE WHEN o_orderkey % 5 <> 0 THEN CONCAT('club', CAST((o_orderkey * 3 + 1) % 4 AS STRING)) ELSE CONCAT('Player An', CAST(o_custkey AS STRING)) END AS in_name FROM {orders}"


@query("extract_moves", f"WITH f AS ({FLAT.replace('{orders}', 'orders')}), g AS (SELECT api_id, CAST(date AS DATE) AS day, out_team, CASE WHEN in_team <> 77 THEN in_team END AS in_team FROM f WHERE type <> 'Raise') SELECT api_id, min(day) AS date, out_team AS from_team, in_team AS to_team FROM g WHERE (out_team IS NOT NULL OR in_team IS NOT NULL) AND (out_team IS NULL OR in_team IS NULL OR out_team <> in_team) GROUP BY api_id, out_team, in_team")
def extract_moves(s, d):
    return resolve.extract_moves(s.sql(FLAT, orders=base(s, d, "orders"))).select("api_id", "date", "from_team", "to_team")


@query("resolve_move_players", f"WITH p AS ({_duck(PERSON)}), m AS (SELECT p_partkey AS id, 9000000 + p_partkey AS api_id, CONCAT(SUBSTRING({FIRST}, 1, 1), '. ', {LAST}) AS name FROM part), h AS (SELECT m.id, min(p.id) AS lo, max(p.id) AS hi FROM m JOIN p ON split_part(p.full_name, ' ', 2) = split_part(m.name, ' ', 2) AND (substr(p.full_name, 1, 1) = substr(m.name, 1, 1) OR substr(m.name, 1, 1) = 's') GROUP BY m.id) SELECT m.api_id, m.name, coalesce(p.id, CASE WHEN lo = hi THEN lo END) AS player_id FROM m LEFT JOIN p ON p.api_football_id = m.api_id LEFT JOIN h ON h.id = m.id")
def resolve_move_players(s, d):
    moves = _sql(s, d, f"SELECT 9000000 + p_partkey AS api_id, CONCAT(SUBSTRING({FIRST}, 1, 1), '. ', {LAST}) AS name FROM {{part}}")
    return resolve.resolve_move_players(moves, _sql(s, d, PERSON))


STORED = "SELECT o_orderkey AS id, o_custkey AS player_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 END AS from_club_id, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey + 1) % 4 END AS to_club_id, CAST(o_orderdate AS DATE) AS transfer_date, o_totalprice AS fee_eur, '97/98' AS season, CAST(NULL AS STRING) AS transfer_type, CAST(NULL AS STRING) AS from_club_name, CAST(NULL AS STRING) AS to_club_name, false AS date_is_exact FROM {orders} WHERE o_orderkey % 2 = 0"
MOVES = (
    "SELECT o_custkey AS player_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 4 END AS from_club_id, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 9 <> 0 THEN (o_orderkey + 1) % 4 END AS to_club_id, CAST(o_orderdate AS DATE) AS date, 'Loan' AS type, CAST(NULL AS STRING) AS from_name, CAST(NULL AS STRING) AS to_name FROM {orders} WHERE o_orderkey % 2 = 1 "
    # the other half of a move with one end: the same player, day and type with the ends swapped
    "UNION ALL SELECT o_custkey, CAST(NULL AS BIGINT), o_orderkey % 4, CAST(o_orderdate AS DATE), 'Loan', NULL, NULL FROM {orders} WHERE o_orderkey % 2 = 1 AND o_orderkey % 9 = 0"
)
_far = lambda q: q.replace("{orders}", "orders")


@query("merge_moves", f"""WITH s AS ({_far(STORED)}), m AS (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT * FROM ({_far(MOVES)}))), p AS (SELECT m.k, s.id FROM m JOIN s ON s.player_id = m.player_id AND abs(date_diff('day', m.date, s.transfer_date)) <= 150
    AND coalesce(m.from_club_id = s.from_club_id, true) AND coalesce(m.to_club_id = s.to_club_id, true) AND (coalesce(m.from_club_id = s.from_club_id, false) OR coalesce(m.to_club_id = s.to_club_id, false))),
    h AS (SELECT k, min(id) AS id FROM p GROUP BY k HAVING min(id) = max(id)), b AS (SELECT h.id, min(m.date) AS date FROM h JOIN m USING (k) GROUP BY h.id)
    SELECT s.player_id, coalesce(b.date, s.transfer_date) AS transfer_date, s.fee_eur, CASE WHEN b.id IS NOT NULL THEN 'merged' ELSE 'kept' END AS change FROM s LEFT JOIN b USING (id) UNION ALL SELECT player_id, date, NULL, 'new' FROM m WHERE k NOT IN (SELECT k FROM h)""")
def merge_moves(s, d):
    o = base(s, d, "orders")
    stored = s.sql(STORED, orders=o).withColumn("sources", F.array(F.lit("transfermarkt")))
    return resolve.merge_moves(stored, s.sql(MOVES, orders=o), table(s, d, "clubs")).select("player_id", "transfer_date", "fee_eur", "change")


RICH = f"SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 1 THEN CONCAT({_last('((p_partkey - 1) % 701)')}, ' ', {_word('((p_partkey - 1) % 40)')}) ELSE CONCAT({FIRST}, ' ', {LAST}) END AS full_name, CASE WHEN p_partkey % 3 = 0 THEN 'Defender' ELSE 'Attack' END AS position, p_partkey % 10 AS current_club_id, CASE WHEN p_partkey % 10 <> 1 THEN p_partkey END AS transfermarkt_id, CASE WHEN p_partkey % 10 = 1 THEN 9000000 + p_partkey END AS api_football_id, CAST(NULL AS STRING) AS image_url FROM {{part}}"


@query("merge_duplicates_live", f"WITH r AS ({_duck(RICH)}) SELECT k.id AS keeper_id, t.id AS thin_id FROM r t JOIN r k ON k.id = t.id - 1 WHERE t.id % 10 = 1")
def merge_duplicates_live(s, d):
    return resolve.merge_duplicates_live(_sql(s, d, RICH))[1].where("verdict = 'merged'").select("keeper_id", "thin_id")


THIN = "SELECT p_partkey AS id, p_name AS full_name, p_size % 3 + 1990 AS birth_year, CAST(NULL AS DATE) AS birth_date, CASE WHEN p_partkey % 2 = 0 THEN 'Attack' END AS position, p_partkey % 10 AS current_club_id, CAST(NULL AS BIGINT) AS transfermarkt_id, CASE WHEN p_partkey % 7 = 0 THEN p_partkey END AS api_football_id FROM {part}"


@query("merge_duplicates_thin", with_tables("season_stats", f", t AS ({_duck(THIN)}), w AS (SELECT id, CASE WHEN api_football_id IS NULL THEN min(id) FILTER (api_football_id IS NULL) OVER (PARTITION BY full_name, birth_year) ELSE id END AS keeper, api_football_id, count(*) FILTER (api_football_id IS NULL) OVER (PARTITION BY full_name, birth_year) AS n FROM t), x AS (SELECT s.player_id, s.season, s.club_id, s.source, s.minutes, w.keeper, CASE WHEN w.api_football_id IS NULL AND w.n > 1 THEN min(s.player_id) OVER (PARTITION BY w.keeper, s.season, s.club_id) ELSE s.player_id END AS first FROM season_stats s JOIN w ON w.id = s.player_id) SELECT keeper AS player_id, season, club_id, source, minutes FROM x WHERE player_id = first"))
def merge_duplicates_thin(s, d):
    rows = table(s, d, "season_stats").select("player_id", "season", "club_id", "source", "minutes")
    return resolve.merge_duplicates_thin(_sql(s, d, THIN), rows)[1]


@query("backfill_nationality", with_tables("season_stats players countries", ", m AS (SELECT player_id, min(upper(nation)) AS f, max(upper(nation)) AS l FROM season_stats JOIN players p ON p.id = player_id WHERE p.nationality_code IS NULL AND nation IS NOT NULL GROUP BY player_id), x AS (SELECT player_id, c.code FROM m JOIN countries c ON c.code = concat('R', substr(f, 2, 1)) WHERE f = l AND length(f) = 2) SELECT p.id, coalesce(p.nationality_code, x.code) AS nationality_code FROM players p LEFT JOIN x ON x.player_id = p.id"))
def backfill_nationality(s, d):
    codes = s.createDataFrame([(f"F{i}", f"r{i}") for i in range(7)], "fifa_code string, iso_code string")
    return resolve.backfill_nationality(table(s, d, "players"), table(s, d, "season_stats"), codes, table(s, d, "countries"))[0].select("id", "nationality_code")


@query("refresh_current_clubs", with_tables("people appearances transfers", f", a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY played_on DESC, match_id DESC) AS n FROM appearances WHERE club_id IS NOT NULL AND played_on >= {TODAY} - INTERVAL 430 DAY) WHERE n = 1), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY transfer_date DESC, id DESC) AS n FROM transfers WHERE transfer_date BETWEEN {TODAY} - INTERVAL 430 DAY AND {TODAY}) WHERE n = 1), x AS (SELECT p.id, p.current_club_id, CASE WHEN t.transfer_date >= coalesce(a.played_on, DATE '1900-01-01') THEN t.to_club_id WHEN a.club_id IS NOT NULL THEN a.club_id WHEN p.last_season = (SELECT max(last_season) FROM people) THEN p.current_club_id END AS resolved_club_id FROM people p LEFT JOIN a ON a.player_id = p.id LEFT JOIN t ON t.player_id = p.id) SELECT id, current_club_id, resolved_club_id, CASE WHEN current_club_id IS DISTINCT FROM resolved_club_id THEN CASE WHEN resolved_club_id IS NULL THEN 'cleared' ELSE 'moved' END END AS changed FROM x"))
def refresh_current_clubs(s, d):
    return resolve.refresh_current_clubs(table(s, d, "people"), table(s, d, "appearances"), table(s, d, "transfers"), AS_OF)
