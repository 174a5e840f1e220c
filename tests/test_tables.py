import datetime
import json

import pytest
from pyspark.sql import functions as F

from pitchspark.operators import imports, quality
from pitchspark.sources import files, tables


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_snapshots_name_missing_columns(spark, tmp_path):
    (tmp_path / "clubs.csv").write_text("club_id,name\n1,A\n2,\"B, C\"\n")
    with pytest.raises(ValueError, match="domestic_competition_id.*club_id"):
        files.read_snapshot(spark, str(tmp_path / "clubs.csv"), ("club_id", "domestic_competition_id"))
    assert rows(files.read_snapshot(spark, str(tmp_path / "clubs.csv"), ("club_id",)), "name") == [("A",), ("B, C",)]


def test_reference_files_have_comments_and_a_mark(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("﻿# note\ncode,alias\nTR, Turkey \n# x\nDE,\n".encode())
    assert rows(files.read_reference_csv(spark, str(tmp_path / "r.csv"), "code string, alias string")) == [("DE", None), ("TR", "Turkey")]


def test_feeds_are_flattened(spark, tmp_path):
    move = {"date": "2024-07-12", "type": "Free", "teams": {"out": {"id": 1, "name": "A"}, "in": {"id": None, "name": "B"}}}
    (tmp_path / "f.json").write_text(json.dumps({"response": [{"player": {"id": 5, "name": " P "}, "transfers": [move, move]}, {"player": {"id": 6, "name": "Q"}, "transfers": []}]}))
    flat = files.flatten_moves(spark.read.schema(files.MOVES_SCHEMA).json(str(tmp_path / "f.json"), multiLine=True))
    assert rows(flat) == [(5, "P", "2024-07-12", "Free", 1, "A", None, "B")] * 2
    (tmp_path / "s.json").write_text(json.dumps({"response": [{"team": {"id": 9, "name": "T"}, "players": [{"id": 1, "name": "X", "position": "GK", "photo": None}]}]}))
    assert rows(files.flatten_squads(spark.read.schema(files.SQUADS_SCHEMA).json(str(tmp_path / "s.json"), multiLine=True))) == [(9, 1, "X", "GK", None)]


def test_headers_and_labels(spark):
    assert files.flatten_headers([("Standard", "Sh"), ("Unnamed: 3", "born"), "pos"]) == ["Standard Sh", "born", "pos"]
    df = spark.createDataFrame([("L", "A"), (None, "B")], "league string, team string")
    with pytest.raises(ValueError, match="B"):
        files.require_labelled(df, "league", "team")
    assert files.require_labelled(df.where("team = 'A'"), "league", "team").count() == 1


def test_replacing_touches_its_scope_alone(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x")], "source string, league int, v string")
    new = spark.createDataFrame([("a", 1, "y")], old.schema)
    scope = spark.createDataFrame([("a", 1)], "source string, league int")
    assert rows(tables.replace_slice(old, new, scope, ["source", "league"])) == [("a", 1, "y"), ("a", 2, "x"), ("b", 1, "x")]
    assert tables.replace_slice(old, new.limit(0), scope.limit(0), ["source", "league"]).count() == 3
    path = str(tmp_path / "t")
    tables.write_slice(old, path, ["source", "league"])
    tables.write_slice(new, path, ["source", "league"])
    assert rows(spark.read.parquet(path), "source", "league", "v") == [("a", 1, "y"), ("a", 2, "x"), ("b", 1, "x")]


def test_upsert_protects_curated_columns(spark):
    old = spark.createDataFrame([(1, "A", 0.9), (2, "B", None)], "id int, name string, coef double")
    new = spark.createDataFrame([(1, None, 0.1, 0), (3, "C", 0.2, 1), (3, "D", 0.3, 2)], "id int, name string, coef double, o int")
    assert rows(tables.upsert(old, new, ["id"], ["name"], "o")) == [(1, None, 0.9), (2, "B", None), (3, "C", 0.2)]
    assert rows(tables.insert_ignore(old, new, ["id"], "o")) == [(1, "A", 0.9), (2, "B", None), (3, "C", 0.2)]


def files_of(path):
    return {str(p.relative_to(path)): (p.stat().st_mtime_ns, p.read_bytes()) for p in path.rglob("*.parquet")}


def test_merging_rewrites_touched_partitions_alone(spark, tmp_path):
    old = [(i, f"s{i % 6}", i, "curated") for i in range(60)] + [(100, None, 1, "curated")]
    new = [(i, "s2", 500 + i, "new") for i in range(0, 40, 2)] + [(100, None, 7, "new"), (101, "s9", 8, "new")]
    schema = "id int, season string, minutes int, note string"
    frames = [spark.createDataFrame(x, schema) for x in (old, new)]
    for update, order in ((["minutes"], None), (None, "minutes")):
        path = tmp_path / f"t{order}"
        frames[0].repartition(2, "season").write.partitionBy("season").parquet(str(path))
        before = files_of(path)
        fresh = frames[1]
        assert tables.merge_partitions(spark, str(path), fresh, ["id", "season"], ["season"], update, order) == 3
        after = files_of(path)
        kept = [f for f in before if "season=s2" not in f and "__HIVE_DEFAULT" not in f]
        assert len(kept) == 5 and all(after[f] == before[f] for f in kept)
        assert all(f not in after for f in before if f not in kept) and any("season=s9" in f for f in after)
        same = lambda a, b: a[:2] == b[:2] and a[1] is not None  # noqa: E731  a null matches no key
        want = [r for r in new if not any(same(r, x) for x in old)] + [r if not update else next(((*r[:2], x[2], r[3]) for x in new if same(r, x)), r) for r in old]
        assert rows(spark.read.schema(schema).parquet(str(path)), "id", "season", "minutes", "note") == sorted(want, key=repr)
        assert tables.merge_partitions(spark, str(path), fresh.where("false"), ["id", "season"], ["season"], update, order) == 0
        assert files_of(path) == after
    with pytest.raises(ValueError, match="which partition"):
        tables.merge_partitions(spark, str(path), frames[1], ["id"], ["season"], ["minutes"])


def test_a_load_counts_while_it_writes(spark, tmp_path):
    day = datetime.date(2024, 1, 1)
    stats = spark.createDataFrame([(1, -5, 3, {"shots": 2.0}, None, 1), (2, 90, 1, {"shots": 2.0}, 1, 1), (3, None, 1, None, 1, None)], "player_id int, minutes int, goals int, key_metrics map<string,double>, club_id int, league_id int")
    players = spark.createDataFrame([(None, None, 2000, None), ("TR", datetime.date(2025, 1, 1), None, 5.0)], "nationality_code string, birth_date date, birth_year int, market_value_eur double")
    watched = {"player_season_stats": stats, "players": players, "clubs": spark.createDataFrame([], "league_id int")}
    checks = quality.LoadChecks(day)
    for name, df in watched.items():
        for part in (0, 1) if name == "players" else (None,):
            own = df if part is None else df.where(f"birth_year is {'not ' * part}null")
            out = checks.watch(name, own)
            assert out.columns == own.columns
            out.write.mode("append").parquet(str(tmp_path / name))
    assert rows(checks.row_counts(spark)) == rows(quality.row_counts(watched))
    assert rows(checks.null_ratios(spark)) == rows(quality.null_ratios(watched))
    assert rows(checks.integrity(spark)) == rows(quality.integrity(watched, day)) and checks.integrity(spark).where("violated").count() > 2


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    with tables.run_log(spark, "job", path) as stats:
        stats.add(3)
        stats.note("fine")
    with pytest.raises(KeyError), tables.run_log(spark, "job", path):
        raise KeyError("gone")
    got = spark.read.parquet(path).orderBy("started_at").collect()
    assert [(r.status, r.rows_written, r.notes) for r in got] == [("success", 3, "fine"), ("failed", 0, "KeyError: 'gone'")]


@pytest.fixture(scope="module")
def world(spark):
    countries = spark.createDataFrame([("TR", "Turkey", "Türkiye", 39.0, 35.0), ("DE", "Germany", "Almanya", 51.0, 10.0), ("XX", "Nowhere", None, None, None)], "code string, name string, name_tr string, lat double, lng double")
    aliases = spark.createDataFrame([("Germany", "TR"), ("Atlantis", "ZZ"), ("Turkiye Cum.", "TR")], "alias string, code string")
    return countries, aliases


def test_country_precedence(spark, world):
    df = spark.createDataFrame([("turkey",), (" TÜRKIYE CUM. ",), ("germany",), ("Almanya",), ("Atlantis",), (None,)], "c string").withColumn("c", F.replace("c", F.lit("Ü"), F.lit("U")))
    out = imports.resolve_country(df, "c", *world)
    assert dict(rows(out)) == {"turkey": "TR", " TURKIYE CUM. ": "TR", "germany": "TR", "Almanya": "DE", "Atlantis": None, None: None}
    assert rows(imports.unresolved(out, "c")) == [("Atlantis",)]


def test_snapshot_imports(spark, world):
    comp = spark.createDataFrame([("GB1", "premier-league", "Germany2", "domestic_league", "first_tier"), ("TR1", "super-lig", "Turkey", "domestic_league", "first_tier"), ("TRP", "cup", "Turkey", "cup", "x")], "competition_id string, name string, country_name string, type string, sub_type string")
    leagues = imports.import_leagues(comp, *world)
    assert rows(leagues, "name", "country_code", "tier", "transfermarkt_id") == [("Super Lig", "TR", 1, "TR1")]
    assert leagues.first().logo_url.endswith("/tr1.png")
    stored = spark.createDataFrame([(7, "TR1")], "id int, transfermarkt_id string")
    clubs = spark.createDataFrame([("10", "A", "TR1"), ("11", "B", "ZZ9")], "club_id string, name string, domestic_competition_id string")
    assert rows(imports.import_clubs(clubs, stored), "name", "league_id", "transfermarkt_id") == [("A", 7, 10)]
    club_map = spark.createDataFrame([(10, 100)], "source_club long, club_id long")
    people = spark.createDataFrame([("1", "P", "2000-01-02", "Turkey", "Attack", " ", "left", "180.0", "10", "5e6", "bad", "2025", " "), ("2", "Q", None, "Oz", None, None, None, None, "99", None, None, None, None)],
        "player_id string, name string, date_of_birth string, country_of_citizenship string, position string, sub_position string, foot string, height_in_cm string, current_club_id string, market_value_in_eur string, contract_expiration_date string, last_season string, image_url string")
    got = imports.import_players(people, club_map, *world)
    assert rows(got) == [("P", datetime.date(2000, 1, 2), "TR", "Attack", None, "left", 180, 100, 5e6, None, 1, "2025-26", None)]
    player_map = spark.createDataFrame([(1, 1000)], "source_player long, player_id long")
    moves = spark.createDataFrame([("1", "2024-07-01", "24/25", "10", "77", "1.5"), ("1", "2024-08-05", None, None, "10", None), ("3", "2024-01-01", None, None, None, None)], "player_id string, transfer_date string, transfer_season string, from_club_id string, to_club_id string, transfer_fee string")
    got = imports.import_transfers(moves, player_map, club_map)
    assert rows(got, "player_id", "from_club_id", "to_club_id", "fee_eur", "season", "date_is_exact") == [(1000, 100, None, 1.5, "24/25", False), (1000, None, 100, None, None, True)]
    stored = got.limit(1).withColumns({"player_id": F.lit(1000), "sources": F.array(F.lit("transfermarkt"), F.lit("live"))}).unionByName(got)
    assert imports.replace_transfers(stored, got).count() == 3
    vals = spark.createDataFrame([("1", "2024-01-01", "5", 0), ("1", "2024-01-01", "6", 1), ("1", "2024-02-01", None, 2), ("9", "2024-01-01", "1", 3)], "player_id string, date string, market_value_in_eur string, ingest_order long")
    assert rows(imports.import_valuations(vals, player_map)) == [(1000, datetime.date(2024, 1, 1), 5.0)]


def test_match_imports(spark):
    names = "game_id competition_id season round date home_club_id away_club_id home_club_goals away_club_goals home_club_formation away_club_formation stadium attendance referee".split()
    game = lambda o, **k: tuple({"game_id": "1", "competition_id": "L1", "season": "2023", "date": "2024-05-01", "home_club_id": "10", "away_club_id": "11.0"} .get(n) if n not in k else k[n] for n in names) + (o,)
    games = spark.createDataFrame([game(0), game(1, date="2024-05-02"), game(2, game_id="2", competition_id="ZZ"), game(3, game_id="3", home_club_id="99"), game(4, game_id="4", season="2010"), game(5, game_id="nan"), game(6, game_id="12.0", date="bad")], ", ".join(f"{n} string" for n in names) + ", ingest_order long")
    leagues = spark.createDataFrame([(5, "L1")], "id int, transfermarkt_id string")
    clubs = spark.createDataFrame([(10, 100), (11, 110)], "source_club long, club_id long")
    kept, why = imports.import_matches(games, leagues, clubs, since=2020)
    assert rows(kept, "id", "league_id", "season", "date", "home_club_id", "away_club_id") == [(1, 5, "2023-24", datetime.date(2024, 5, 1), 100, 110), (12, 5, "2023-24", None, 100, 110)]
    assert rows(why) == [("club", 1), ("id", 1), ("league", 1), ("season", 1)]
    apps = spark.createDataFrame([("1", "7", "10", "2024-05-01", "90", "1", "", 0), ("1", "7", "10", "2024-05-01", "80", "0", "", 1), ("2", "7", "10", None, "1", None, None, 2), ("1", "8", "10", None, "1", None, None, 3), ("12", "7", "55", "x", "45.0", None, None, 4)], "game_id string, player_id string, player_club_id string, date string, minutes_played string, goals string, assists string, ingest_order long").withColumns({"yellow_cards": F.lit("0"), "red_cards": F.lit(None).cast("string")})
    players = spark.createDataFrame([(7, 700)], "source_player long, player_id long")
    got, why = imports.import_appearances(apps, kept, players, clubs)
    assert rows(got, "player_id", "match_id", "club_id", "minutes", "goals") == [(700, 1, 100, 90, 1), (700, 12, None, 45, None)]
    assert rows(why) == [("duplicate", 1), ("match", 1), ("player", 1)]


def test_season_statistics(spark):
    std = spark.createDataFrame([("L", "2425", "T", "P", 2000, "MF", "TUR", 900.0, 10, 5, 3, 0), ("L", "2425", "U", "P", 2000, "MF", "TUR", 1200.0, 12, 1, 1, 1)], "league string, season string, team string, player string, born int, pos string, nation string, `Playing Time Min` double, `Playing Time MP` int, `Performance Gls` int, `Performance Ast` int, ingest_order int")
    shooting = spark.createDataFrame([("L", "2425", "T", "P", 40.0, 999.0), ("L", "2425", "T", "P", 50.0, 1.0)], "league string, season string, team string, player string, `Standard Sh` double, `Playing Time Min` double")
    wide = imports.widen_stats(std, shooting, None)
    assert wide.count() == 2 and sorted(wide.columns) == sorted([*std.columns, "Standard Sh"])
    other = std.drop("Performance Ast")
    assert imports.concat_leagues([wide, other]).count() == 4
    clubs = spark.createDataFrame([("L", "T", 1), ("L", "U", None)], "league string, team string, club_id int")
    people = spark.createDataFrame([("P", 2000, 1, 77)], "player string, born int, club_id int, player_id int")
    leagues = spark.createDataFrame([("L", 3)], "league string, league_id int")
    got = imports.build_season_rows(wide, clubs, people, leagues)
    assert [(r.player_id, r.league_id, r.minutes, r.goals, r.key_metrics, r.position, r.nation) for r in got.collect()] == [(77, 3, 900, 5, {"shots": 40.0}, "MF", "TUR")]
    assert rows(imports.leagues_in(std, leagues)) == [(3,)]
    assert rows(imports.all_null_groups(wide.withColumn("x", F.when(F.col("team") == "U", 1)), "team", "x")) == [("T",)]
    full = spark.createDataFrame([(1, "s", 1, "f", 10, 0), (1, "s", 1, "f", 30, 1), (1, "s", 1, "f", 30, 2), (2, "s", 1, "f", None, 3)], "player_id int, season string, club_id int, source string, minutes int, ingest_order int").withColumn("tag", F.col("ingest_order"))
    assert rows(imports.dedupe_fullest(full), "player_id", "minutes", "n_dropped", "tag") == [(1, 30, 2, 1), (2, None, 0, 3)]


def test_shots_are_linked_by_day_and_club(spark):
    shot = lambda i, team, day, player="9", result="Goal", o=0: ("L", team, "2024", day, i, "5", ".3", ".9", ".5", "foot", "open", result, player, o)
    shots = spark.createDataFrame([shot("1", "T", "2024-05-01"), shot("1", "T", "2024-05-01", result="Saved", o=1), shot("2", "T", "2024-05-02", result=None), shot("3", "U", "2024-05-01"), shot("4", "T", "2024-05-01", player="8"), shot(None, "T", "2024-05-01")],
        "league string, team string, season string, date string, shot_id string, minute string, xg string, location_x string, location_y string, body_part string, situation string, result string, player_id string, ingest_order int")
    clubs = spark.createDataFrame([("L", "T", 1, 3)], "league string, team string, club_id int, league_id int")
    people = spark.createDataFrame([("9", 1, 90)], "source_player string, club_id int, player_id int")
    matches = spark.createDataFrame([(50, "2024", datetime.date(2024, 5, 1), 2, 1)], "id int, season string, date date, home_club_id int, away_club_id int")
    got, why = imports.import_shots(shots, clubs, people, matches)
    assert rows(got, "id", "match_id", "is_goal", "xg") == [(1, 50, True, 0.3), (2, None, False, 0.3)]
    assert rows(why) == [("club", 1), ("id", 1), ("player", 1)]


def test_worklist_lists_entities_once(spark):
    schema = "source string, entity string, source_key string, source_name string, target_id string"
    listed = spark.createDataFrame([("u", "player", "1", "A", " 7 ")], schema)
    batch = spark.createDataFrame([("u", "player", "2", "first", "", 0), ("u", "player", "2", "again", "", 1), ("u", "player", "1", "A", "", 2)], schema + ", ingest_order int")
    out = imports.worklist_append(listed, batch)
    assert rows(out, "source_key", "source_name") == [("1", "A"), ("2", "first")]
    assert imports.worklist_append(out, batch).count() == 2
    assert rows(imports.worklist_resolved(out, "u", "player")) == [("1", 7)]
