"""Queries of the matchers, of files, of the run log and of the reports beside other results, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import INTEGRITY_RULES, NULL_RULES
from ..functions import club_key
from ..operators import imports, quality, resolve
from ..sources import files, tables
from ..sources.scratch import dropped, scratch_dir, stored
from .adapters import AS_OF, table, with_tables
from .queries import FIRST, LAST, PERSON, SQL, _word, base, key_sql, norm_sql, query

MANUAL = "source_key string, target_id long"


def both(sql: str) -> str:
    """The SQL of a projection without the braces around its inputs."""
    return sql.replace("{", "").replace("}", "")


def run(s, d, sql: str):
    """A projection over the given tables it names in braces, by Spark."""
    names = [n for n in ("part", "supplier", "orders", "nation") if f"{{{n}}}" in sql]
    return s.sql(sql, **{n: base(s, d, n) for n in names})


# --- clubs ------------------------------------------------------------------------------------------------------
# Clubs have three words of their own; each fifth shares the key of the club before it. Teams are spelled like their
# club with a legal form, by its last word, with a typing error, like nothing known, or are mapped by hand.

_CLUB = " || ' ' || ".join(_word(f"((s_suppkey - CASE WHEN s_suppkey % 5 = 4 THEN 1 ELSE 0 END) * {k} + {k})") for k in (3, 17, 29))
CLUBS = f"SELECT s_suppkey AS id, {_CLUB} AS name, CAST(floor(s_suppkey / 20) AS BIGINT) AS league_id FROM {{supplier}}"
TEAMS = (
    f"SELECT id, league_id, CASE id % 6 WHEN 0 THEN upper(name) || ' FC' WHEN 1 THEN split_part(name, ' ', 3) WHEN 2 THEN 'x' || name "
    f"WHEN 3 THEN 'qqqqqqq ' || repeat('q', CAST(1 + id % 7 AS INT)) WHEN 4 THEN 'hand ' || CAST(id AS STRING) ELSE name END AS team FROM ({CLUBS})"
)
HAND = f"SELECT league_id, team, CAST(league_id AS STRING) || '|' || team AS source_key, id AS target_id FROM ({TEAMS}) WHERE id % 6 = 4"
_MATCHED = f"""c AS ({both(CLUBS)}), n AS (SELECT DISTINCT league_id, team FROM ({both(TEAMS)})), h AS ({both(HAND)}),
    k AS (SELECT league_id, {key_sql(norm_sql('name'))} AS key, min(id) AS id, count(DISTINCT id) AS n FROM c GROUP BY 1, 2),
    t AS (SELECT *, {key_sql(norm_sql('team'))} AS key FROM n),
    o AS (SELECT t.*, h.target_id AS hand, CASE WHEN k.n = 1 THEN k.id END AS exact, coalesce(k.n > 1, false) AS ambiguous
        FROM t LEFT JOIN h USING (league_id, team) LEFT JOIN k USING (league_id, key)),
    w AS (SELECT o.league_id, o.team, min(k.id) AS id FROM o JOIN k ON k.league_id = o.league_id AND k.n = 1
        WHERE hand IS NULL AND exact IS NULL AND list_has_all(string_split(k.key, ' '), string_split(o.key, ' ')) GROUP BY ALL HAVING count(*) = 1),
    f AS (SELECT o.league_id, o.team, k.id FROM o JOIN k ON k.league_id = o.league_id AND k.n = 1 AND o.key = 'x' || k.key)
    SELECT o.league_id, o.team, coalesce(hand, exact, w.id, f.id) AS club_id, CASE WHEN hand IS NOT NULL THEN 'manual' WHEN exact IS NOT NULL THEN 'exact'
        WHEN w.id IS NOT NULL THEN 'token' WHEN f.id IS NOT NULL THEN 'fuzzy' ELSE 'unmatched' END AS tier, ambiguous
    FROM o LEFT JOIN w USING (league_id, team) LEFT JOIN f USING (league_id, team)"""


def matched_clubs(s, d):
    hand = run(s, d, HAND).select("source_key", "target_id")
    return resolve.match_clubs(run(s, d, TEAMS).select("league_id", "team"), run(s, d, CLUBS), hand)


@query("match_clubs", f"WITH {_MATCHED}")
def match_clubs(s, d):
    return matched_clubs(s, d).select("league_id", "team", "club_id", "tier", "ambiguous")


@query("match_report", f"WITH r AS (WITH {_MATCHED}) SELECT tier, count(*) AS n FROM r GROUP BY tier")
def match_report(s, d):
    return resolve.match_report(matched_clubs(s, d))


# a name behind letters of its own is nearest to the name itself: 2 * n of 2 * n + m letters agree. Of m = 1, the most that
# reach the bound and one more, the last is just under it.
@query("fuzzy_best", f"""WITH c AS (SELECT league_id, {key_sql(norm_sql('name'))} AS key, min(id) AS id FROM ({both(CLUBS)}) GROUP BY 1, 2),
    m AS (SELECT *, unnest([1, CAST(floor(length(key) * 3 / 11) AS INT), CAST(floor(length(key) * 3 / 11) AS INT) + 1]) AS m FROM c),
    r AS (SELECT DISTINCT league_id, repeat('=', m) || key AS key, id AS best_id, 2.0::DOUBLE * length(key) / (2 * length(key) + m) AS best_score FROM m)
    SELECT * FROM r WHERE best_score >= 0.88""")
def fuzzy_best(s, d):
    clubs = run(s, d, CLUBS).select("league_id", "id", club_key("name").alias("other"))
    most = F.floor(F.length("other") * 3 / 11).cast("int")
    names = clubs.select("league_id", F.explode(F.array(F.lit(1), most, most + 1)).alias("m"), "other")
    names = names.select("league_id", F.concat(F.expr("repeat('=', m)"), "other").alias("key")).distinct()
    return resolve.fuzzy_best(names, clubs, ["league_id"], ["league_id", "key"], "key", "other", "id", 0.88)


_TEAM = "CASE WHEN s_suppkey % 2 = 0 THEN 'FC ' ELSE 'Royal ' END || name || CASE WHEN s_suppkey % 8 = 3 THEN ' U19' ELSE '' END"
LISTING = f"""SELECT s_suppkey + 5000 AS team_id, CASE WHEN s_suppkey % 7 = 6 THEN 'nothing known' ELSE {_TEAM} END AS team
    FROM (SELECT s_suppkey, {_CLUB} AS name FROM {{supplier}})"""


@query("match_club_listing", f"""WITH c AS ({both(CLUBS)}), l AS (SELECT *, team_id - 5000 AS own FROM ({both(LISTING)}) WHERE team NOT LIKE '% U19' AND (team_id - 5000) % 5 <> 0),
    ck AS (SELECT id, {key_sql(norm_sql('name'))} AS key FROM c), lk AS (SELECT team_id, {key_sql(norm_sql('team'))} AS key FROM l),
    e AS (SELECT id, min(team_id) AS team_id, count(*) AS n FROM ck JOIN lk USING (key) GROUP BY id),
    x AS (SELECT id, min(team_id) AS team_id, count(*) AS n FROM ck JOIN lk ON list_has_all(string_split(lk.key, ' '), string_split(ck.key, ' ')) GROUP BY id),
    p AS (SELECT ck.id, CASE WHEN e.n = 1 THEN e.team_id WHEN e.n IS NULL AND x.n = 1 THEN x.team_id END AS team_id FROM ck LEFT JOIN e USING (id) LEFT JOIN x USING (id))
    SELECT id AS club_id, CASE WHEN id = min(id) OVER (PARTITION BY team_id) THEN team_id END AS team_id FROM p""")
def match_club_listing(s, d):
    taken = base(s, d, "supplier").where("s_suppkey % 5 = 0").select((F.col("s_suppkey") + 5000).alias("team_id"))
    return resolve.match_club_listing(run(s, d, CLUBS), run(s, d, LISTING), taken)


# --- players ----------------------------------------------------------------------------------------------------
# Each eighth player bears the name of the one before. Names are spelled like their player's, by initial, by surname
# alone, with a letter too many, are mapped by hand, or are nobody's.

_FULL = "split_part(full_name, ' ', 1)", "split_part(full_name, ' ', 2)"
_EVEN = "(p_partkey - CASE WHEN p_partkey % 8 = 3 THEN 1 ELSE 0 END)"
_NAME = f"{_word(f'({_EVEN} % 40)')} || ' s' || {_word(f'({_EVEN} % 701)')}"
PLAYERS = (
    f"SELECT p_partkey AS id, {_NAME} AS full_name, CAST(make_date(CAST(1970 + p_partkey % 30 AS INT), 3, 5) AS DATE) AS birth_date, "
    f"CASE WHEN p_partkey % 9 <> 0 THEN CAST(floor(p_partkey / 25) AS BIGINT) END AS current_club_id FROM {{part}}"
)
CALLED = (
    f"SELECT CASE WHEN id % 40 = 0 THEN 'Qqqq ' || repeat('q', CAST(1 + id % 9 AS INT)) WHEN id % 8 = 0 THEN upper(full_name) WHEN id % 8 = 1 THEN 'by hand' "
    f"WHEN id % 8 = 4 THEN substr(full_name, 1, 1) || '. ' || {_FULL[1]} WHEN id % 8 = 5 THEN 'Zz ' || {_FULL[1]} WHEN id % 8 = 6 THEN {_FULL[1]} "
    "WHEN id % 8 = 7 THEN 'x' || full_name ELSE full_name END AS player, CASE WHEN id % 8 IN (2, 4, 5) THEN year(birth_date) END AS born, "
    f"CASE WHEN id % 8 IN (3, 6, 7, 0) THEN current_club_id END AS club_id, CASE WHEN id % 8 = 1 THEN 'm' || CAST(id AS STRING) END AS source_key FROM ({PLAYERS})"
)
_ONE = lambda keys, name: f"{name} AS (SELECT {keys}, min(id) AS id FROM p WHERE {keys.split(', ')[-1]} IS NOT NULL GROUP BY {keys} HAVING min(id) = max(id))"


@query("match_players", f"""WITH p AS (SELECT id, {norm_sql('full_name')} AS key, year(birth_date) AS born, current_club_id AS club_id, substr({norm_sql('full_name')}, 1, 1) AS initial, string_split({norm_sql('full_name')}, ' ')[-1] AS surname FROM ({both(PLAYERS)})),
    r AS (SELECT *, substr(key, 1, 1) AS initial, string_split(key, ' ')[-1] AS surname FROM (SELECT DISTINCT *, {norm_sql('player')} AS key FROM ({both(CALLED)}))),
    {_ONE('key', 'a')}, {_ONE('key, born', 'b')}, {_ONE('key, club_id', 'c')}, {_ONE('born, initial, surname', 'e')}, {_ONE('born, surname', 'f')},
    m AS (SELECT r.*, CASE WHEN source_key IS NOT NULL THEN CAST(substr(source_key, 2) AS BIGINT) + 1 END AS hand, coalesce(a.id, b.id) AS exact, coalesce(c.id, e.id, f.id) AS token
        FROM r LEFT JOIN a USING (key) LEFT JOIN b USING (key, born) LEFT JOIN c USING (key, club_id) LEFT JOIN e USING (born, initial, surname) LEFT JOIN f USING (born, surname)),
    q AS (SELECT club_id, key, min(id) AS id, arg_min(born, id) AS born FROM p WHERE club_id IS NOT NULL GROUP BY ALL),
    g AS (SELECT m.player, m.born, m.club_id, q.id, q.key, m.key AS own FROM m JOIN q USING (club_id) WHERE hand IS NULL AND exact IS NULL AND token IS NULL AND coalesce(m.born = q.born, true)),
    i AS (SELECT player, born, club_id, min(id) AS id FROM g WHERE list_has_all(string_split(key, ' '), string_split(own, ' ')) OR list_has_all(string_split(own, ' '), string_split(key, ' ')) GROUP BY ALL HAVING count(*) = 1),
    z AS (SELECT player, born, club_id, min(id) AS id FROM g WHERE own = 'x' || key GROUP BY ALL)
    SELECT m.player, m.born, m.club_id, m.source_key, coalesce(hand, exact, token, i.id, z.id) AS player_id,
        CASE WHEN hand IS NOT NULL THEN 'manual' WHEN exact IS NOT NULL THEN 'exact' WHEN token IS NOT NULL OR i.id IS NOT NULL THEN 'token' WHEN z.id IS NOT NULL THEN 'fuzzy' ELSE 'unmatched' END AS tier
    FROM m LEFT JOIN i ON i.player = m.player AND i.born IS NOT DISTINCT FROM m.born AND i.club_id = m.club_id LEFT JOIN z ON z.player = m.player AND z.born IS NOT DISTINCT FROM m.born AND z.club_id = m.club_id""")
def match_players(s, d):
    called = run(s, d, CALLED)
    hand = called.where("source_key is not null").select("source_key", (F.expr("cast(substr(source_key, 2) as bigint)") + 1).alias("target_id"))
    return resolve.match_players(called, run(s, d, PLAYERS), hand).drop("score")


SQUADS = (
    f"SELECT p_partkey % 10 AS club_id, CASE WHEN p_partkey % 4 = 1 AND p_partkey % 3 = 0 THEN 9000000 + p_partkey ELSE 7000000 + p_partkey END AS api_id, "
    f"CASE WHEN p_partkey % 6 = 5 THEN 'Nobody q' || CAST(p_partkey AS STRING) WHEN p_partkey % 4 = 2 THEN {LAST} || ' ' || {FIRST} "
    f"WHEN p_partkey % 4 = 3 THEN substr({FIRST}, 1, 1) || '. ' || {LAST} ELSE {FIRST} || ' ' || {LAST} END AS name, 'Defender' AS position FROM {{part}}"
)
_SHORT = lambda key: f"substr({key}, 1, 1) || ' ' || string_split({key}, ' ')[-1]"
_AT_CLUB = lambda c, alias: (
    f"{alias} AS (SELECT s.row, min(p.id) AS lo, max(p.id) AS hi FROM s JOIN p ON p.{c} = s.{c} AND (p.live IS NOT NULL OR p.club_id = s.club_id) GROUP BY s.row)"
)


@query("match_squads", f"""WITH p AS (SELECT id, full_name, api_football_id AS live, current_club_id AS club_id, {norm_sql('full_name')} AS key, {_SHORT(norm_sql('full_name'))} AS short FROM ({both(PERSON)})),
    s AS (SELECT *, {norm_sql('name')} AS key, {_SHORT(norm_sql('name'))} AS short, row_number() OVER () AS row FROM ({both(SQUADS)})),
    a AS (SELECT live, max(id) AS id FROM p WHERE live IS NOT NULL GROUP BY live), {_AT_CLUB('key', 'k')}, {_AT_CLUB('short', 'h')},
    g AS (SELECT short, min(id) AS id FROM p GROUP BY short HAVING min(id) = max(id)),
    x AS (SELECT s.row, string_split(s.key, ' ') AS w, p.id, string_split(p.key, ' ') AS v FROM s JOIN p ON list_contains(string_split(s.key, ' '), string_split(p.key, ' ')[-1])),
    y AS (SELECT row, min(id) AS id FROM x WHERE list_has_all(v, list_filter(w, lambda t: len(t) > 1)) AND len(list_filter(w, lambda t: len(t) = 1 AND len(list_filter(v, lambda u: u[1] = t)) = 0)) = 0 GROUP BY row HAVING min(id) = max(id)),
    m AS (SELECT s.*, a.id AS a, k.hi AS k, CASE WHEN h.lo = h.hi THEN h.hi END AS h, g.id AS g, y.id AS y FROM s LEFT JOIN a ON a.live = s.api_id LEFT JOIN k USING (row) LEFT JOIN h USING (row) LEFT JOIN g ON g.short = s.short LEFT JOIN y USING (row))
    SELECT club_id, api_id, name, position, coalesce(a, k, h, g, y) AS player_id, CASE WHEN a IS NOT NULL THEN 'api' WHEN k IS NOT NULL THEN 'exact' WHEN h IS NOT NULL THEN 'surname' WHEN g IS NOT NULL THEN 'global' WHEN y IS NOT NULL THEN 'person' ELSE 'new' END AS tier FROM m""")
def match_squads(s, d):
    return resolve.match_squads(run(s, d, SQUADS), run(s, d, PERSON))


# --- files, the run log and the strict gate ---------------------------------------------------------------------


def _folder(s, name: str) -> str:
    return f"{scratch_dir(s)}/{name}-{uuid.uuid4().hex}"


@query("read_snapshot", "SELECT CAST(s_suppkey AS VARCHAR) AS club_id, concat('\"', s_name, '\", FC') AS name, CAST(s_nationkey AS VARCHAR) AS domestic_competition_id FROM supplier")
def read_snapshot(s, d):
    path = _folder(s, "snapshot")
    name = F.concat(F.lit('"'), "s_name", F.lit('", FC'))
    rows = base(s, d, "supplier").select(F.col("s_suppkey").alias("club_id"), name.alias("name"), F.col("s_nationkey").alias("domestic_competition_id"))
    rows.write.csv(path, header=True, escape='"')
    return files.read_snapshot(s, path, ("club_id", "name", "domestic_competition_id")).drop("ingest_order")


@query("read_reference_csv", "SELECT concat('N', n_nationkey) AS code, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS alias FROM nation")
def read_reference_csv(s, d):
    path = _folder(s, "reference")
    alias = F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), "n_name", F.lit(" ")))
    row = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit(","), alias)
    lines = base(s, d, "nation").select(F.col("n_nationkey").alias("at"), F.explode(F.array(F.concat(F.lit("# about "), "n_name"), row)).alias("value"))
    head = s.createDataFrame([(-2, "# codes"), (-1, "code,alias")], "at long, value string")
    head.union(lines).repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    return files.read_reference_csv(s, path, "code string, alias string")


HEADERS = [("Unnamed: 0", "player"), ("", "league"), ("Playing Time", "Min"), ("Standard", "Sh")]


@query("labelled_stats", 'SELECT p_partkey AS player, p_brand AS league, p_size AS "Playing Time Min", p_size * 2 AS "Standard Sh" FROM part')
def labelled_stats(s, d):
    rows = base(s, d, "part").select("p_partkey", "p_brand", "p_size", (F.col("p_size") * 2).alias("shots")).toDF(*files.flatten_headers(HEADERS))
    return files.require_labelled(rows, "league", "player")


@query("unlabelled_stats", "SELECT concat('rows without league, such as [', string_agg(concat('''', name, ''''), ', ' ORDER BY name), ']') AS refusal FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_size % 7 = 3 ORDER BY 1 LIMIT 5)")
def unlabelled_stats(s, d):
    rows = base(s, d, "part").select(F.when(F.col("p_size") % 7 != 3, F.col("p_brand")).alias("league"), F.col("p_name").alias("player"))
    refusal = None
    try:
        files.require_labelled(rows, "league", "player")
    except ValueError as e:
        refusal = str(e)
    return s.createDataFrame([(refusal,)], "refusal string")


@query("run_log", "SELECT 'orders' AS source, 'success' AS status, count(*) AS rows_written, concat(count(DISTINCT o_custkey), ' customers') AS notes FROM orders UNION ALL SELECT 'part', 'failed', count(*), concat('ValueError: ', max(p_size), ' is too large') FROM part")
def run_log(s, d):
    path = _folder(s, "runs")
    with tables.run_log(s, "orders", path) as stats:
        n, customers = base(s, d, "orders").agg(F.count("*"), F.count_distinct("o_custkey")).first()
        stats.add(n)
        stats.note(f"{customers} customers")
    try:
        with tables.run_log(s, "part", path) as stats:
            n, size = base(s, d, "part").agg(F.count("*"), F.max("p_size")).first()
            stats.add(n)
            raise ValueError(f"{size} is too large")
    except ValueError:
        pass
    return s.read.parquet(path).select("source", "status", "rows_written", "notes")


@query("enforce", f"WITH r AS ({SQL['integrity']}) SELECT string_agg(concat(table_name, ': ', rule), '; ' ORDER BY table_name, rule) AS refusal FROM r WHERE violated")
def enforce(s, d):
    facts = {"player_season_stats": "season_stats", "player_match_stats": "appearances", "matches": "matches", "shots": "shots", "ingest_runs": "runs"}
    refusal = None
    try:
        quality.enforce(quality.integrity({name: table(s, d, t) for name, t in facts.items()}, AS_OF))
    except quality.QualityError as e:
        refusal = str(e)
    return s.createDataFrame([(refusal,)], "refusal string")


FACTS = {"player_season_stats": "season_stats", "player_match_stats": "appearances", "matches": "matches", "shots": "shots", "players": "players", "clubs": "clubs"}


_WRITTEN = with_tables(" ".join(FACTS.values()), " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in FACTS.values()))


# the reports of a load job that counts while it writes are those that scan the tables afterwards
@query("load_checks", f"""SELECT 'rows' AS report, table_name, CAST(NULL AS VARCHAR) AS rule, CAST(n AS DOUBLE) AS found, false AS violated FROM ({_WRITTEN})
    UNION ALL SELECT 'nulls', table_name, rule, ratio, violated FROM ({SQL['null_ratios']})
    UNION ALL SELECT 'rules', table_name, rule, CAST(violations AS DOUBLE), violated FROM ({SQL['integrity']}) WHERE rule NOT IN ('date differs from the match', 'last run failed')""")
def load_checks(s, d):
    checks = quality.LoadChecks(AS_OF, [r for r in NULL_RULES if r[0] != "player_season_stats"], [r for r in INTEGRITY_RULES if r[0] != "players"])
    for name, t in FACTS.items():
        dropped(stored(checks.watch(name, table(s, d, t), t), t))
    report = lambda df, name, rule, found, violated: df.select(F.lit(name).alias("report"), "table_name", rule.alias("rule"), found.cast("double").alias("found"), violated.alias("violated"))
    out = report(checks.row_counts(s), "rows", F.lit(None).cast("string"), F.col("n"), F.lit(False))
    for name, df, found in (("nulls", checks.null_ratios(s), "ratio"), ("rules", checks.integrity(s), "violations")):
        out = out.unionByName(report(df, name, F.col("rule"), F.col(found), F.col("violated")))
    return out


_SEASONS = "SELECT player_id, club_id, source, season, max(minutes) AS minutes FROM season_stats WHERE club_id IS NOT NULL GROUP BY ALL"


@query("merge_partitions", with_tables("season_stats", f"""SELECT player_id, club_id, source, season, CASE WHEN season = '1999' AND player_id % 2 = 0 THEN minutes + 1 ELSE minutes END AS minutes FROM ({_SEASONS})
    UNION ALL SELECT player_id + 10000000, club_id, source, season, minutes + 1 FROM ({_SEASONS}) WHERE season = '1999' AND player_id % 2 = 1"""))
def merge_partitions(s, d):
    rows = table(s, d, "season_stats").where("club_id is not null").groupBy("player_id", "club_id", "source", "season").agg(F.max("minutes").alias("minutes"))
    path = _folder(s, "seasons")
    rows.repartition("season").write.partitionBy("season").parquet(path)
    own = s.read.schema(rows.schema).parquet(path)
    new = own.where("season = '1999'").withColumns({"minutes": F.col("minutes") + 1, "player_id": F.when(F.col("player_id") % 2 == 1, F.col("player_id") + 10_000_000).otherwise(F.col("player_id"))})
    tables.merge_partitions(s, path, new, ["player_id", "club_id", "source", "season"], ["season"], ["minutes"])
    return s.read.schema(rows.schema).parquet(path)


@query("unresolved_countries", "SELECT DISTINCT concat('Land ', p_brand) AS unresolved FROM part WHERE p_size % 3 = 0")
def unresolved_countries(s, d):
    spelled = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Land "), "p_brand")).otherwise(F.lit("ASIA"))
    rows = base(s, d, "part").select(spelled.alias("country"))
    return imports.unresolved(imports.resolve_country(rows, "country", table(s, d, "countries"), table(s, d, "aliases")), "country")
