import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchspark.operators import discovery, metrics, quality, views

DAY = datetime.date
STATS = "player_id int, season string, league_id int, club_id int, source string, minutes int, goals int, assists int, xg double, xa double, key_metrics map<string,double>, position string"
LONG = "player_id int, season string, position_group string, metric string, value double"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def rank(spark, metric, values):
    return {r.player_id: r for r in metrics.peer_rank(spark.createDataFrame([(i, "s", "FW", metric, v) for i, v in enumerate(values)], LONG)).collect()}


def test_sources_are_merged(spark):
    df = spark.createDataFrame([
        (1, "s", 1, 10, "fbref", 1000, 5, 2, None, None, {"shots": 30.0, "fouls": 9.0}, "MF"), (1, "s", 1, 11, "fbref", 950, 1, 1, None, None, {"shots": 1.0}, "DF"),
        (1, "s", None, 10, "understat", 1020, 6, 3, 4.5, 1.5, {"shots": 33.0}, "F M"), (2, "s", 2, 20, "understat", 900, 7, 0, 2.5, 0.5, None, None), (3, "s", 2, 20, "fbref", 899, 7, 0, None, None, None, None),
    ], STATS)
    got = {r.player_id: r for r in metrics.merge_sources(df).collect()}
    one = got[1]
    assert set(got) == {1, 2}
    assert (one.minutes, one.league_id, one.club_id, one.goals, one.xg, one.key_metrics, one.position_hint) == (1020, 1, 10, 5, 4.5, {"shots": 33.0, "fouls": 9.0}, "F M")
    assert (got[2].goals, got[2].xg, got[2].key_metrics) == (7, 2.5, {})


def test_rates_are_gated(spark):
    df = spark.createDataFrame([
        (1, "s", 1, 1, "fbref", 1800, 9, None, None, None, {"shots": 40.0, "goals_per_shot": 0.225}, "FW"), (2, "s", 1, 1, "fbref", 1800, 9, 1, None, None, {"shots": 8.0, "goals_per_shot": 0.5}, "FW"),
        (3, "s", 1, 1, "fbref", 1800, 0, 0, None, None, {"saves": 9.0, "shots_on_target_against": 11.0, "save_pct": 82.0}, "GK"), (4, "s", 1, 1, "fbref", 1800, 0, 0, None, None, {"saves": 60.0, "shots_on_target_against": 77.0, "save_pct": 78.0}, "GK"), (5, "s", 1, 1, "fbref", 1800, 3, 0, None, None, {"goals_against": 9.0}, "GK"),
    ], STATS)
    placed = metrics.placed(metrics.merge_sources(df), spark.createDataFrame([(i, None) for i in range(1, 6)], "id int, position string"))
    got = {(r.player_id, r.metric): r.value for r in metrics.per90_values(placed).collect()}
    assert got[1, "goals"] == 0.45 and got[1, "goals_per_shot"] == 0.225 and (1, "goal_contributions") not in got and (1, "assists") not in got
    assert (2, "goals_per_shot") not in got and got[2, "goal_contributions"] == 0.5
    assert (3, "save_pct") not in got and got[4, "save_pct"] == 78.0
    assert not any(p == 5 for p, _ in got)
    table = metrics.compute_metrics(df, spark.createDataFrame([(i, None) for i in range(1, 6)], "id int, position string"))
    assert table.where("player_id = 5").first().per90 == {} and table.count() == 5


def test_percentiles_are_midpoints(spark):
    got = rank(spark, "shots", [0.1, 0.2, 0.3, 0.9])
    assert [got[i].percentile for i in range(4)] == [0.125, 0.375, 0.625, 0.875] and {r.sample_size for r in got.values()} == {4}
    assert {(r.percentile, r.zscore) for r in rank(spark, "shots", [2.0] * 4).values()} == {(0.5, 0.0)}
    less = rank(spark, "fouls", [0.5, 1.0, 3.0])
    assert less[0].percentile > less[2].percentile and less[0].zscore > 0 > less[2].zscore
    z = rank(spark, "shots", [1.0, 2.0, 4.0])
    assert [z[i].zscore for i in range(3)] == [round((v - 7 / 3) / np.std([1, 2, 4]), 3) for v in (1, 2, 4)]


def test_metrics_of_one_holder_are_unranked(spark):
    got = metrics.peer_rank(spark.createDataFrame([(1, "s", "FW", "xg", 1.0), (1, "s", "FW", "shots", 1.0), (2, "s", "FW", "shots", 2.0), (3, "s", "MF", "shots", 9.0)], LONG)).collect()
    assert {(r.player_id, r.metric): r.sample_size for r in got} == {(1, "xg"): None, (1, "shots"): 2, (2, "shots"): 2, (3, "shots"): None}


def test_ranks_do_not_depend_on_order_or_partitions(spark):
    df = spark.createDataFrame([(i, "s", "FW", "shots", float(i * 7919 % 50)) for i in range(400)], LONG)
    assert rows(metrics.peer_rank(df.repartition(7))) == rows(metrics.peer_rank(df.orderBy(F.rand(3)).coalesce(1)))


def test_role_vectors(spark):
    df = spark.createDataFrame([({"assists": 1.0, "fouls": 0.0}, "FW"), ({"assists": 0.51}, "FW"), ({"assists": 1.0}, "GK"), ({}, "FW")], "p map<string,double>, g string")
    got = [r[0] for r in df.select(metrics.role_vector(F.col("p"), F.col("g"))).collect()]
    assert got == [[0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, -1.0], None, None, None]


def test_league_strength(spark):
    leagues = spark.createDataFrame([(1, 0.1), (2, None), (3, 0.7)], "id int, strength_coef double")
    clubs = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "id int, league_id int")
    players = spark.createDataFrame([(10, 1e7), (10, 1e5), (10, 1e6), (20, 1e4), (20, 1e4), (20, 0.0), (30, 5.0)], "current_club_id int, market_value_eur double")
    got = rows(metrics.league_strength(leagues, clubs, players, min_players=2), "id", "strength_coef", "coef_source")
    assert got == [(1, 1.0, "market-value"), (2, 0.05, "market-value"), (3, 0.7, None)]


MET = "player_id int, season string, position_group string, league_id int, club_id int, minutes int, per90 map<string,double>, zscore map<string,double>, percentile map<string,double>, sample_size map<string,int>"


def metric_row(player, percentile, season="2025-26", group="FW", sample=100, league=1, minutes=2000, samples=None):
    return (player, season, group, league, 1, minutes, {m: 0.5 for m in percentile}, {m: 0.0 for m in percentile}, percentile, {m: (samples or {}).get(m, sample) for m in percentile})


def table(spark, *made):
    return spark.createDataFrame(list(made), MET)


def test_notes_have_a_reason(spark):
    m = table(
        spark,
        metric_row(1, {"shots": 0.9, "xg": 0.95, "assists": 0.8, "goals": 0.75, "fouls": 0.99, "saves": 0.99, "crosses": 0.1, "yellow_cards": 0.05, "mystery": 1.0, "fouled": 0.2}, samples={"xg": 29}),
        metric_row(2, {"saves": 0.9, "goals": 0.99}, group="GK"),
    )
    long = discovery.to_long(m)
    assert [(r.metric, r.rank) for r in discovery.notes(long).where("player_id = 1").orderBy("rank").collect()] == [("shots", 1), ("assists", 2), ("goals", 3)]
    assert [r.metric for r in discovery.notes(long, False).where("player_id = 1").orderBy("rank").collect()] == ["yellow_cards", "crosses"]
    assert [r.metric for r in discovery.notes(long).where("player_id = 2").collect()] == ["saves"]


def test_differences_need_both_sides(spark):
    m = table(spark, metric_row(1, {"shots": 0.9, "xg": 0.5, "assists": 0.6, "goals": 0.9}, samples={"goals": 10}), metric_row(2, {"shots": 0.5, "xg": 0.4, "assists": 0.9, "goals": 0.1, "fouled": 0.1}))
    pairs = spark.createDataFrame([(1, 2, "2025-26", "FW")], "candidate_id int, reference_id int, season string, position_group string")
    assert [(r.metric, r.gap) for r in discovery.differences(pairs, discovery.to_long(m)).orderBy("rank").collect()] == [("shots", 0.4), ("assists", -0.3)]


def test_the_broadest_season_is_the_default(spark):
    m = table(spark, *[metric_row(i, {}, season="2025-26") for i in range(3)], metric_row(9, {}, season="2026"))
    assert discovery.default_season(m).first().season == "2025-26"
    assert rows(discovery.latest_metrics(m.unionByName(table(spark, metric_row(9, {}, season="2024-25")))).where("player_id = 9"), "season") == [("2026",)]
    assert discovery.seasons_of(m).where("player_id = 9").first().seasons == ["2026"]


def test_radar_needs_three_axes(spark):
    m = table(spark, metric_row(1, {"xg": 0.5, "shots": 0.6, "assists": 0.7, "saves": 0.9}), metric_row(2, {"xg": 0.5, "shots": 0.6}), metric_row(3, {"xg": 0.5, "shots": 0.6, "assists": 0.7}, samples={"xg": 5}))
    got = discovery.radar(discovery.to_long(m)).collect()
    assert [(r.player_id, [a.metric for a in r.axes]) for r in got] == [(1, ["xg", "shots", "assists"])]
    strength = {r.player_id: (r.profile, r.axes_measured) for r in discovery.profile_strength(discovery.to_long(m)).collect()}
    assert strength == {1: (pytest.approx(0.6), 3), 2: (None, 2), 3: (None, 3)}


def test_rising_scores(spark):
    df = spark.createDataFrame([(0.8, 20, 1.0), (0.8, 20, None), (0.8, 15, 1.0), (None, 20, 1.0), (0.8, 24, 2.0)], "p double, a int, c double")
    got = df.select(*[c.alias(n) for n, c in discovery.rising_score(F.col("p"), F.col("a"), F.col("c")).items()]).collect()
    assert [r.score for r in got] == [round(0.7 * 0.8 + 0.3 * 0.5, 4), round(0.7 * 0.8 * 0.4 + 0.3 * 0.5, 4), None, None, round(0.7 * 0.8, 4)]


def test_value_momentum(spark):
    now = DAY(2026, 1, 1)
    ago = lambda n: now - datetime.timedelta(days=n)
    v = spark.createDataFrame([(1, ago(500), 9.0), (1, ago(300), 1e6), (1, ago(10), 5e6), (2, ago(10), 1.0), (3, ago(20), 0.0), (3, ago(10), 1.0), (4, ago(20), None), (4, ago(10), 1.0)], "player_id int, date date, value_eur double")
    assert rows(discovery.value_momentum(v, now)) == [(1, 1e6, 5e6, 5.0, 2)]


def test_lists_filter_before_they_limit(spark):
    now = DAY(2026, 1, 1)
    m = table(spark, metric_row(1, {"shots": 0.9, "xg": 0.9, "assists": 0.9}), metric_row(2, {"shots": 0.95, "xg": 0.5, "assists": 0.5}, samples={"shots": 5}), metric_row(3, {"shots": 0.8, "xg": 0.99, "assists": 0.8}, league=2), metric_row(4, {"shots": 0.99}, minutes=500))
    players = spark.createDataFrame([(1, "A", DAY(2005, 1, 1), None, 5.0, 1), (2, "B", None, 2004, None, 1), (3, "C", DAY(2006, 6, 1), None, 50.0, None), (4, "D", DAY(1990, 1, 1), None, 5.0, 1)], "id int, full_name string, birth_date date, birth_year int, market_value_eur double, current_club_id int")
    clubs = spark.createDataFrame([(1, "Club", 7)], "id int, name string, league_id int")
    leagues = spark.createDataFrame([(1, "L1", 1.0), (2, "L2", None)], "id int, name string, strength_coef double")
    cands = lambda **f: discovery.candidates(m, players, clubs, leagues, now, **f)
    long = discovery.to_long(m)
    assert [r.player_id for r in discovery.discover(cands(), long, "shots").collect()] == [1, 3]
    assert [(r.player_id, r.metric) for r in discovery.discover(cands(), long).collect()] == [(3, "xg"), (1, "assists")]
    assert rows(cands(max_value=10.0), "player_id") == [(1,), (4,)]
    assert rows(cands(max_age=21), "player_id") == [(1,), (2,), (3,)]
    assert rows(cands(league_ids=[7]), "player_id") == [(1,), (2,), (4,)]
    assert {r.player_id: r.league_name for r in cands().collect()}[3] == "L2"
    values = spark.createDataFrame([], "player_id int, date date, value_eur double")
    assert [(r.player_id, r.change_ratio) for r in discovery.rising(cands(), long, values, now).collect()] == [(1, None), (3, None)]
    assert dict(rows(discovery.metric_coverage(m))) == {"shots": 4, "xg": 3, "assists": 3}


@pytest.mark.parametrize("tile", [3, 50])
def test_similar_players_match_brute_force(spark, tile):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 8))
    x[5] = x[6] * 2
    df = spark.createDataFrame([(i, "s", "FW" if i < 30 else "MF", [float(v) for v in x[i]]) for i in range(40)], "player_id long, season string, position_group string, embedding array<double>")
    got = discovery.similar_players(df, k=4, tile=tile).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for lo, hi in ((0, 30), (30, 40)):
        for i in range(lo, hi):
            far = sorted((round(1 - unit[i] @ unit[j], 9), j) for j in range(lo, hi) if j != i)[:4]
            assert [r.candidate_id for r in sorted((r for r in got if r.player_id == i), key=lambda r: r["rank"])] == [j for _, j in far]
    assert next(r.distance for r in got if r.player_id == 5 and r["rank"] == 1) == 0.0
    pool = df.where("player_id < 10").select("player_id", "season", "position_group")
    assert {r.candidate_id for r in discovery.similar_players(df, pool, k=4, tile=tile).collect()} <= set(range(10))


def test_progression(spark):
    p = {"xg": 0.5, "shots": 0.6, "assists": 0.7}
    m = table(spark, metric_row(1, p, "2023-24", sample=60), metric_row(1, {k: v + 0.2 for k, v in p.items()}, "2024-25", sample=500), metric_row(1, {"fouls": 0.5}, "2025-26", group="MF"), metric_row(2, p))
    prog = discovery.progression(m, discovery.to_long(m))
    got = [(r.season, r.place, r.profile, r.population, r.leading_group, r.profile_delta) for r in prog.where("player_id = 1").orderBy("place").collect()]
    assert got == [("2023-24", 1, 0.6, 60, "FW", 0.2), ("2024-25", 2, 0.8, 500, "FW", 0.2), ("2025-26", 3, None, 0, "FW", 0.2)]
    assert rows(discovery.progression_flags(prog)) == [(1, False, True, True), (2, True, False, False)]


def test_comparison_narrows_to_shared_axes(spark):
    m = table(spark, metric_row(1, {"xg": 0.5, "shots": 0.6, "assists": 0.7, "goals": 0.5, "fouls": 0.5}), metric_row(2, {"xg": 0.5, "shots": 0.6, "assists": 0.7, "tackles_won": 0.1}), metric_row(3, {"shots": 0.6, "assists": 0.7}, group="MF"))
    sets = spark.createDataFrame([(1, 0, 1, None), (1, 1, 2, None), (1, 2, 1, None), (2, 0, 1, None), (2, 1, 3, None), (3, 0, 99, None), (3, 1, 3, "2025-26")], "set_id int, place int, player_id int, season string")
    got = {r.set_id: r for r in discovery.compare(sets, m, discovery.to_long(m)).collect()}
    assert (got[1].axes, got[1].chart_axes, got[1].dropped) == (["xg", "shots", "assists"], ["xg", "shots", "assists"], ["goals", "tackles_won"])
    assert (got[2].axes, got[2].chart_axes, got[2].position_groups) == (["assists", "shots"], [], ["FW", "MF"])
    assert got[3].n_players == 1


def test_form_and_trend(spark):
    apps = spark.createDataFrame([(1, i, 1, DAY(2024, 1, 1) + datetime.timedelta(days=i), 90, i % 3, None) for i in range(1, 8)] + [(1, 99, 1, None, 10, 0, 0)], "player_id int, match_id int, club_id int, played_on date, minutes int, goals int, assists int")
    matches = spark.createDataFrame([(i, 5, "2023-24", 1 if i % 2 else 2, 2 if i % 2 else 1) for i in [*range(1, 8), 99]], "id int, league_id int, season string, home_club_id int, away_club_id int")
    clubs = spark.createDataFrame([(1, "Own"), (2, "Other")], "id int, name string")
    leagues = spark.createDataFrame([(5, "L")], "id int, name string")
    form = views.match_rows(apps, matches, clubs, leagues, 5)
    got = form.orderBy("place").collect()
    assert [r.match_id for r in got] == [3, 4, 5, 6, 7] and {(r.club_name, r.opponent_name, r.league_name) for r in got} == {("Own", "Other", "L")} and [r.is_home for r in got] == [True, False, True, False, True]
    series = views.form_series(form, "goals", 2)
    assert [(r.value, r.rolling) for r in series.orderBy("place").collect()] == [(0.0, 0.0), (1.0, 0.5), (2.0, 1.5), (0.0, 1.0), (1.0, 0.5)]
    assert rows(views.trend_direction(series)) == [(1, True)]
    trend = views.season_trend(apps, matches).first()
    assert (trend.matches, trend.minutes, trend.goals, trend.assists, trend.goals_per_90) == (8, 640, 7, 0, None)


def test_shots(spark):
    shots = spark.createDataFrame([(1, 1, DAY(2024, 1, 1), 0.5, 0.99, 0.5, True), (2, 1, DAY(2024, 1, 2), 0.1, 0.5, 0.5, False), (3, 1, None, None, None, None, False)], "id int, player_id int, played_on date, xg double, location_x double, location_y double, is_goal boolean")
    assert rows(views.shot_totals(shots)) == [(1, 3, 1, 0.6, 0.4)]
    assert [(r.zone, r.shots, r.goals) for r in views.shot_zones(shots).orderBy("rank").collect()] == [("outside", 2, 0), ("six_yard", 1, 1)]
    assert {r.zone for r in views.shot_zones(shots, n=1).collect()} == {"outside"}


def test_squads_and_leagues(spark):
    leagues = spark.createDataFrame([(1, "A", "TR"), (2, "B", "DE"), (3, "C", "XX"), (4, "D", "TR")], "id int, name string, country_code string").withColumns({"tier": F.lit(1), "strength_coef": F.when(F.col("id") == 1, 0.5)})
    clubs = spark.createDataFrame([(10, "A1", 1), (11, "A2", 1), (12, "A3", 1), (20, "B1", 2), (30, "C1", 3), (40, "D1", 4), (41, "D2", 4)], "id int, name string, league_id int")
    players = spark.createDataFrame([(1, "p1", 10, 900, 5.0), (2, "p2", 10, None, 9.0), (3, "p3", 11, None, None), (4, "p4", 20, None, 1.0), (5, "p5", 30, 901, 1.0)], "id int, full_name string, current_club_id int, api_football_id long, market_value_eur double")
    stats = spark.createDataFrame([(3, "2024-25", 11), (2, "2024-25", 11), (1, "2023-24", 12), (1, "2024-25", 10)], "player_id int, season string, club_id int")
    assert rows(views.squads(clubs, players, stats)) == [(10, 1, "live", 1), (11, 2, "season", 1), (11, 3, "season", 2), (12, 1, "season", 1), (20, 4, "registered", 1), (30, 5, "live", 1)]
    assert rows(views.league_clubs(leagues, clubs, players, stats)) == [(1, 10, 1, "live", 2), (1, 11, 2, "live", 1), (2, 20, 1, "registered", 1), (3, 30, 1, "live", 1), (4, 40, 0, "registered", 1), (4, 41, 0, "registered", 2)]
    assert rows(views.league_counts(leagues, clubs, players, stats)) == [(1, "2024-25", 2, 3), (2, None, 1, 1), (3, None, 1, 1), (4, None, 2, 0)]
    countries = spark.createDataFrame([("TR", 39.0, 35.0), ("DE", 51.0, 10.0), ("XX", None, None)], "code string, lat double, lng double")
    assert [r.league_id for r in views.league_nodes(leagues, countries, clubs, players, stats).orderBy("place").collect()] == [1, 2, 4]
    assert rows(views.countries_with_leagues(leagues, countries), "code") == [("DE",), ("TR",)]


def test_transfers(spark):
    now = DAY(2024, 9, 1)
    schema = "id int, player_id int, transfer_date date, fee_eur double, from_club_id int, to_club_id int, transfer_type string, season string, date_is_exact boolean"
    moves = spark.createDataFrame([(1, 1, DAY(2024, 8, 29), 7.5e5, 1, 2, None, "2024-25", True), (2, 1, DAY(2024, 8, 20), None, 2, None, "Loan", "24/25", False), (3, 1, DAY(2025, 3, 1), 1.0, 1, 2, None, "2024-25", True), (4, 1, DAY(2024, 8, 1), 1.0, 1, 2, "Raise", "x", True), (5, 1, DAY(2024, 8, 29), None, 1, 2, "N/A", "2024-25", True)], schema)
    players = spark.createDataFrame([(1, "P")], "id int, full_name string")
    clubs = spark.createDataFrame([(1, "A", 1), (2, "B", 2)], "id int, name string, league_id int")
    leagues = spark.createDataFrame([(1, "TR"), (2, "DE")], "id int, country_code string")
    countries = spark.createDataFrame([("TR", 1.0), ("DE", 2.0)], "code string, lat double")
    board = lambda **o: [r.id for r in views.transfer_board(moves, players, clubs, now, **o).collect()]
    assert board() == [1, 5, 2] and board(min_fee=1.0) == [1] and board(league_id=2, direction="in") == [1, 5] and board(club_id=2, direction="out") == [2] and board(limit=1, offset=1) == [5] and board(since=DAY(2024, 8, 25)) == [1, 5]
    assert [r.season for r in views.board_seasons(moves).collect()] == ["2024-25"]
    assert rows(views.transfer_arcs(moves, clubs, leagues, countries)) == [("TR", "DE", 4, 750002.0)]
    assert rows(views.transfer_arcs(moves, clubs, leagues, countries, season="24/25")) == []


def test_search(spark):
    players = spark.createDataFrame([(1, "Şükrü Kaya", "Attack", 1, 5.0), (2, "Ali Sukrucan", None, None, 99.0), (3, "Sukru Z", None, 1, 9.0)], "id int, full_name string, position string, current_club_id int, market_value_eur double")
    clubs = spark.createDataFrame([(1, "Sükrüspor", 1)], "id int, name string, league_id int")
    leagues = spark.createDataFrame([(1, "Sukru Lig", "TR", 2)], "id int, name string, country_code string, tier int")
    q = spark.createDataFrame([("SUKRU",), ("x",), ("ka",), ("nothing here",)], "query string")
    got = rows(views.search(q, players, clubs, leagues), "query", "kind", "rank", "id", "detail")
    assert got == [("SUKRU", "club", 1, 1, "Sukru Lig"), ("SUKRU", "league", 1, 1, "TR · 2. lig"), ("SUKRU", "player", 1, 3, "Sükrüspor"), ("SUKRU", "player", 2, 1, "Sükrüspor · Attack"), ("SUKRU", "player", 3, 2, None), ("ka", "player", 1, 1, "Sükrüspor · Attack")]
    assert views.search(q, players, clubs, leagues, n=1).where("kind = 'player' and query = 'SUKRU'").count() == 1


def test_quality_gate(spark):
    stats = spark.createDataFrame([(1, -5, 3, 2.0, None, 1), (2, 90, 1, 2.0, 1, 1)], "player_id int, minutes int, goals int, shots double, club_id int, league_id int")
    runs = spark.createDataFrame([("a", DAY(2024, 1, 1), "success"), ("a", DAY(2024, 1, 2), "failed"), ("b", DAY(2024, 1, 1), "failed"), ("b", DAY(2024, 1, 2), "running")], "source string, started_at date, status string")
    apps = spark.createDataFrame([(1, DAY(2024, 1, 1), 90), (2, None, 130)], "match_id int, played_on date, minutes int")
    matches = spark.createDataFrame([(1, DAY(2024, 1, 2), 1), (2, None, 1)], "id int, date date, league_id int")
    checks = quality.integrity({"player_season_stats": stats, "ingest_runs": runs, "player_match_stats": apps, "matches": matches}, DAY(2024, 1, 1))
    found = {r.rule: r.violations for r in checks.where("violations > 0").collect()}
    assert found == {"negative minutes": 1, "goals over shots": 1, "season row without club": 1, "last run failed": 1, "over 120 minutes in a match": 1, "date differs from the match": 1}
    with pytest.raises(quality.QualityError, match="negative minutes"):
        quality.enforce(checks)
    assert not checks.where("rule = 'goals over shots' or rule = 'over 120 minutes in a match'").where("violated").count()
    quality.enforce(checks.where("not violated"))
    players = spark.createDataFrame([(None, None, None, None)], "nationality_code string, birth_date date, birth_year int, market_value_eur double")
    ratios = quality.null_ratios({"players": players, "clubs": spark.createDataFrame([], "league_id int")})
    assert {r.rule: (r.ratio, r.violated) for r in ratios.collect()} == {"nationality_code": (1.0, True), "age": (1.0, True), "market_value_eur": (1.0, True), "league_id": (None, False)}
    work = spark.createDataFrame([("s", "club", ""), ("s", "club", "5"), ("s", "club", None)], "source string, entity string, target_id string")
    assert rows(quality.worklist_status(work)) == [("s", "club", 2, 1)]


def test_ranks_over_many_ranges_with_a_hot_value(spark):
    rng = np.random.default_rng(2)
    table = [(i, s, "FW", m, float(v)) for s in ("a", "b") for m in ("x", "fouls") for i, v in enumerate(np.where(rng.random(400) < 0.5, 0.0, rng.integers(0, 40, 400) / 8))]
    table += [(9, "c", "GK", "x", 1.0), (9, "d", "GK", "x", 2.0), (8, "d", "GK", "x", 2.0)]
    want = {}
    for s, g, m in {r[1:4] for r in table}:
        own = np.array([r[4] for r in table if r[1:4] == (s, g, m)])
        for i, v in {(r[0], r[4]) for r in table if r[1:4] == (s, g, m)}:
            rank = ((own < v).sum() + (own == v).sum() / 2) / len(own)
            z = 0.0 if own.std() == 0 else (v - own.mean()) / own.std()
            want[s, m, i] = (len(own), 1 - rank if m == "fouls" else rank, -z if m == "fouls" else z) if len(own) > 1 else (None, None, None)
    long = spark.createDataFrame(table, LONG)
    for parts in (1, 3, 40):
        got = metrics.peer_rank(long, negative=("fouls",), parts=parts).collect()
        assert len(got) == len(table)
        for r in got:
            n, p, z = want[r.season, r.metric, r.player_id]
            assert r.sample_size == n and (n is None) == (r.zscore is None) == (r.percentile is None)
            assert n is None or abs(r.percentile - p) < 6e-4 and abs(r.zscore - z) < 6e-4


def test_medians_are_exact(spark):
    rng = np.random.default_rng(3)
    groups = {1: [7.0] * 100_000, 2: [1.0, 2.0], 3: rng.integers(-1000, 10**9, 501).astype(float).tolist(), 4: [0.0, -5.0, 3.0, 0.5], 5: [1e-9, 4.0, 4.0], 6: (2.0 ** rng.integers(-5, 30, 1000)).tolist()}
    df = spark.createDataFrame([(g, v) for g, own in groups.items() for v in own] + [(7, None), (1, None)], "g int, v double")
    assert {r.g: (r.n, r.median) for r in metrics.medians(df, "g", "v").collect()} == {g: (len(own), float(np.median(own))) for g, own in groups.items()}


def test_match_rows_are_cut_before_they_are_joined(spark):
    apps = spark.createDataFrame([(1, i, DAY(2024, 1, 1) + datetime.timedelta(days=i), 5, 90, 1, 0) for i in range(30)] + [(1, 99, DAY(2025, 1, 1), 5, 90, 9, 9)], "player_id int, match_id int, played_on date, club_id int, minutes int, goals int, assists int")
    matches = spark.createDataFrame([(i, 3, 5, 6) for i in range(30)], "id int, league_id int, home_club_id int, away_club_id int")
    clubs, leagues = spark.createDataFrame([(5, "A"), (6, "B")], "id int, name string"), spark.createDataFrame([(3, "L")], "id int, name string")
    df = views.match_rows(apps, matches, clubs, leagues, 4)
    assert [(r.match_id, r.place, r.opponent_name) for r in sorted(df.collect(), key=lambda r: r.place)] == [(26, 1, "B"), (27, 2, "B"), (28, 3, "B"), (29, 4, "B")]
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    limit = min(depth(x) for x in plan.splitlines() if "WindowGroupLimit" in x)
    joins = [x for x in plan.splitlines() if "Join" in x and "LeftSemi" not in x]
    assert len(joins) == 4 and all(depth(x) < limit for x in joins)


def test_a_hot_run_of_letters_is_many_parts(spark):
    names = spark.createDataFrame([("player", i, f"mara{'bcdefgh'[i % 7]} {i}") for i in range(900)] + [("club", 1, "ma"), ("club", 2, "am")], "kind string, id int, folded string")
    needles = [f"mar{x}{y} {z}" for x in "a" for y in "bcdefgh" for z in range(140)] + ["mar", "ma", "xyz", "marz"]
    df = spark.createDataFrame([(n,) for n in needles], "needle string")
    want = {(n, r.kind, r.id) for r in names.collect() for n in needles if n in r.folded}
    for part in (50, 10_000):
        pairs = views.gram_pairs(df, names, ["kind", "id"], part=part)
        hits = pairs.join(names, ["kind", "id"]).where(F.contains("folded", F.col("needle"))).select("needle", "kind", "id").collect()
        assert len(hits) == len(want) and {tuple(r) for r in hits} == want
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    hot = views.gram_pairs(df.where("needle = 'mar'"), names, ["kind", "id"], part=50).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    for k, v in before.items():
        spark.conf.set(k, v)
    assert sum(r["count"] for r in hot) == 900 and len(hot) > 1
    alone = views.gram_pairs(df, names, ["kind", "id"]).groupBy("needle").count().where("needle like 'marab %'").agg(F.max("count")).first()[0]
    assert alone <= 150  # met by the rarest of its runs, not by "mar", which all 900 have


def test_tiles_are_passed_over_without_losing_a_neighbour(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 6))
    x = np.repeat(centres, 40, axis=0) + 0.15 * rng.normal(size=(1200, 6))
    x[100:140], x[600] = x[100], 0  # a crowd of one vector, and one without a direction
    table = [(i, "s", "FW" if i < 1180 else "GK", v) for i, v in enumerate(x.tolist())]
    vectors = spark.createDataFrame(table, "player_id long, season string, position_group string, embedding array<double>")
    pool = vectors.where("player_id % 3 != 1").select("player_id", "season", "position_group")
    key = ["player_id", "season", "position_group", "rank", "candidate_id", "distance"]
    for own in (None, pool):
        whole, cut = (rows(discovery.similar_players(vectors, own, k=5, tile=tile), *key) for tile in (5000, 40))
        assert whole == cut and len(whole) == 1200 * 5
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    far = np.round(1 - unit[:1180] @ unit[:1180].T, 9)
    np.fill_diagonal(far, np.inf)
    want = {i: np.lexsort((np.arange(1180), far[i]))[:5].tolist() for i in range(1180)}
    found = {}
    for r in rows(discovery.similar_players(vectors, k=5, tile=40), *key):
        found.setdefault(r[0], []).append((r[3], r[4]))
    assert all([c for _, c in sorted(found[i])] == want[i] for i in range(1180))
    visits, cands = discovery.tile_visits(vectors, k=5, tile=40)
    tiles = cands.select("season", "position_group", "p", "s").distinct().count()
    assert visits.count() < 0.5 * 1200 * tiles


def test_metrics_look_their_ranks_up_without_a_shuffle(spark):
    rng = np.random.default_rng(5)
    stats = [(i, s, 1, 1, ("fbref", "understat", "other")[i % 3], 900 + 90 * int(rng.integers(0, 4)), int(rng.integers(0, 4)), None, 1.5 if i % 3 == 1 else None, None, {"shots": float(rng.integers(10, 40)), "fouls": float(rng.integers(0, 5)), "saves": 3.0 if i % 5 else None}, ("GK", "DF", "MF", "FW", "?")[i % 5 if i < 59 else 2]) for i in range(60) for s in ("a", "b")]
    stats.append((99, "c", 1, 1, "fbref", 900, 1, 1, None, None, {}, "FW"))
    placed = metrics.placed(metrics.merge_sources(spark.createDataFrame(stats, STATS)), spark.createDataFrame([(i, None) for i in range(100)], "id int, position string"))
    looked, ranged = metrics.metrics_of(placed), metrics.metrics_of(placed, most=0)
    as_rows = lambda df: sorted((tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r) for r in df.collect()), key=repr)
    assert looked.schema.simpleString() == ranged.schema.simpleString() and as_rows(looked) == as_rows(ranged)
    assert any(r.percentile for r in looked.collect()) and looked.where("player_id = 99").first().percentile == {} and looked.where("player_id = 99").first().per90["goals"] == 0.1
    assert "hashpartitioning" not in looked._jdf.queryExecution().executedPlan().toString()
    long = metrics.per90_values(placed)
    assert rows(metrics.peer_rank(long)) == rows(metrics.peer_rank(long, parts=3))


def test_equal_vectors_are_compared_as_one_class(spark, monkeypatch):
    rng = np.random.default_rng(9)
    kinds = rng.integers(-2, 3, (12, 3)).astype(float)
    kinds[0] = 0
    x = kinds[rng.integers(0, 12, 300)]
    vectors = spark.createDataFrame([(i, "s", "FW", v) for i, v in enumerate(x.tolist())], "player_id long, season string, position_group string, embedding array<double>")
    seen, plain = [], discovery.nearest_rows
    monkeypatch.setattr(discovery, "nearest_rows", lambda df, *a: seen.append(df.count()) or plain(df, *a))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    far = np.round(1 - unit @ unit.T, 9)
    np.fill_diagonal(far, np.inf)
    for allowed in (list(range(300)), [i for i in range(300) if i % 4 == 3]):
        pool = None if len(allowed) == 300 else vectors.where("player_id % 4 = 3")
        got = {}
        for r in rows(discovery.similar_players(vectors, pool, k=6, tile=5), "player_id", "rank", "candidate_id"):
            got.setdefault(r[0], []).append(r[1:])
        for i in range(300):
            want = sorted((far[i, j] + 0.0, j) for j in allowed if j != i)[:6]
            assert [c for _, c in sorted(got[i])] == [j for _, j in want]
    assert max(seen) <= len(np.unique(x, axis=0)) <= 12
