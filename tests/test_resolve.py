import datetime
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pitchspark.functions import same_club, same_person
from pitchspark.operators import resolve

DAY = datetime.date


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def manual(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source_key string, target_id long")


def test_club_tiers(spark):
    clubs = spark.createDataFrame([(1, "Manchester City FC", 1), (2, "Manchester United", 1), (3, "Royal Antwerp", 1), (4, "AC Milan", 1), (5, "Milan FC", 1), (6, "Borussia Moenchengladbach", 1), (7, "Antwerp", 2)], "id int, name string, league_id int")
    names = spark.createDataFrame([(1, "manchester city"), (1, "Manchester"), (1, "Antwerp"), (1, "Milan"), (1, "Borussia Monchengladbach"), (1, "Nobody"), (1, "By Hand")], "league_id int, team string")
    got = {r.team: r for r in resolve.match_clubs(names, clubs, manual(spark, ("1|by hand", 2))).collect()}
    assert {t: (r.club_id, r.tier) for t, r in got.items()} == {
        "manchester city": (1, "exact"), "Manchester": (None, "unmatched"), "Antwerp": (3, "token"), "Milan": (None, "unmatched"), "Borussia Monchengladbach": (6, "fuzzy"), "Nobody": (None, "unmatched"), "By Hand": (2, "manual"),
    }
    assert got["Milan"].ambiguous and not got["Nobody"].ambiguous
    assert dict(rows(resolve.match_report(resolve.match_clubs(names, clubs, manual(spark, ("1|by hand", 2)))))) == {"exact": 1, "token": 1, "fuzzy": 1, "manual": 1, "unmatched": 3}


def test_fuzzy_is_the_difflib_ratio(spark):
    left = spark.createDataFrame([(1, "borussia"), (2, "a"), (3, "")], "block int, a string")
    right = spark.createDataFrame([(1, "borusia", 3), (1, "borussya", 1), (1, "borusia", 2), (2, "", 4), (3, "", 5)], "block int, b string, id int")
    got = resolve.fuzzy_best(left, right, ["block"], ["a"], "a", "b", "id", 0.0).collect()
    best = max(SequenceMatcher(None, "borussia", b).ratio() for b in ("borusia", "borussya"))
    assert {r.a: r.best_id for r in got} == {"borussia": 2, "a": 4} and max(r.best_score for r in got) == best


def odd_name(rng, known):
    """A new name, or a known one with some letters changed, lost, swapped or added."""
    name = list(rng.choice(known)) if known and rng.random() < 0.5 else [rng.choice("abcdeimnorst é-Z9ß") for _ in range(rng.randrange(0, 26))]
    for _ in range(rng.randrange(5)):
        at = rng.randrange(len(name) + 1)
        name[at : at + rng.randrange(2)] = rng.choice(["", "a", "xx", "é", "aaaaaa", " "])
    return "".join(name)


def test_the_letter_bound_loses_no_match_and_spares_most_pairs(spark):
    rng, known = random.Random(11), []
    for _ in range(2000):
        known.append(odd_name(rng, known))
    left = spark.createDataFrame([(i % 5, i, n) for i, n in enumerate(known[:1000])], "block int, row int, a string")
    right = spark.createDataFrame([(i % 5, i, n) for i, n in enumerate(known[1000:])], "block int, id int, b string")
    for accept in (0.88, 0.6):
        want, n_close = {}, 0
        for i, a in enumerate(known[:1000]):
            for j in range(i % 5, 1000, 5):
                m = SequenceMatcher(None, a, known[1000 + j])
                if (a or known[1000 + j]) and m.quick_ratio() >= accept:
                    n_close += 1
                    score = m.ratio()
                    if score >= accept:
                        want[i] = max(want.get(i, (0, 0)), (score, -j))
        got = {r.row: (r.best_score, -r.best_id) for r in resolve.fuzzy_best(left, right, ["block"], ["row"], "a", "b", "id", accept).collect()}
        assert got == want and len(want) > 20
        compared = resolve.fuzzy_pairs(left, right, ["block"], "a", "b", accept).count()  # what difflib sees
        assert n_close <= compared <= 2 * n_close and compared < 1000 * 200 * (0.02 if accept > 0.8 else 0.2)


def test_words_inside_words(spark):
    inner = spark.createDataFrame([(1, "b a"), (1, ""), (2, "c"), (1, "a a")], "g int, a string")
    outer = spark.createDataFrame([(1, "a b c"), (1, "b"), (2, "c d"), (1, "aa b")], "g int, b string")
    assert rows(resolve.word_pairs(inner, outer, ["g"], "a", "b"), "a", "b") == [("a a", "a b c"), ("b a", "a b c"), ("c", "c d")]


def test_player_tiers(spark):
    players = spark.createDataFrame(
        [(1, "Ana Only", DAY(2000, 1, 1), 10), (2, "Twin Name", DAY(1999, 1, 1), 10), (3, "Twin Name", DAY(2001, 1, 1), 11), (4, "Same Same", None, 12), (5, "Same Same", None, 13), (6, "Bert Initialson", DAY(1998, 1, 1), 14), (7, "Carl Surnamed", DAY(1997, 1, 1), 14), (8, "Maria Long Inside Name", DAY(1996, 1, 1), 15), (9, "Fuzzy Spellington", DAY(1995, 1, 1), 16)],
        "id int, full_name string, birth_date date, current_club_id int",
    )
    names = spark.createDataFrame(
        [("ana ONLY", None, None, None), ("Twin Name", 2001, None, None), ("Same Same", None, 13, None), ("Same Same", None, 99, None), ("B. Initialson", 1998, None, None), ("Z Surnamed", 1997, None, None), ("Inside Name", None, 15, None), ("Inside Name", 1990, 15, None), ("Fuzzy Spelington", None, 16, None), ("!!", None, 16, None), ("!!", None, 14, None), ("By Hand", None, None, "id77")],
        "player string, born int, club_id int, source_key string",
    )
    got = {(r.player, r.born, r.club_id): (r.player_id, r.tier) for r in resolve.match_players(names, players, manual(spark, ("id77", 4))).collect()}
    assert got == {
        ("ana ONLY", None, None): (1, "exact"), ("Twin Name", 2001, None): (3, "exact"), ("Same Same", None, 13): (5, "token"), ("Same Same", None, 99): (None, "unmatched"), ("B. Initialson", 1998, None): (6, "token"), ("Z Surnamed", 1997, None): (7, "token"),
        ("Inside Name", None, 15): (8, "token"), ("Inside Name", 1990, 15): (None, "unmatched"), ("Fuzzy Spelington", None, 16): (9, "fuzzy"), ("!!", None, 16): (9, "token"), ("!!", None, 14): (None, "unmatched"), ("By Hand", None, None): (4, "manual"),
    }


def test_missing_players_are_created_once(spark):
    df = spark.createDataFrame([("Efe U.", 2001, 3, "MF"), ("EFE U", 2001, 1, "FW"), ("Efe U", None, 2, None)], "player string, born int, club_id int, position string")
    new, ids = resolve.create_missing(df)
    assert rows(new, "full_name", "birth_year", "position", "current_club_id") == [("EFE U", 2001, "FW", 1), ("Efe U", None, None, 2)]
    assert ids.count() == 3 and ids.select("player_id").distinct().count() == 2
    assert resolve.create_missing_clubs(spark.createDataFrame([(1, "A"), (1, "A"), (None, "B")], "league_id int, team string")).count() == 1


PLAYERS = "id int, full_name string, current_club_id int, api_football_id long"


def test_squads_and_departures(spark):
    players = spark.createDataFrame([(1, "Alex Nubel", 1, 501), (2, "Exact Name", 1, None), (3, "Short Surname", 1, None), (4, "Else Where", 9, None), (5, "Hyeon-gyu Oh", 9, None), (6, "Gone Away", 1, None), (7, "Two Same", 8, None), (8, "Tim Same", 7, None)], PLAYERS)
    squad = spark.createDataFrame([(1, 501, "Whoever", "GK"), (1, 502, "exact name", "DF"), (1, 503, "S. Surname", "DF"), (1, 504, "E. Where", "MF"), (1, 505, "Oh Hyeon-Gyu", "FW"), (1, 506, "T. Same", "FW"), (1, 507, "New Comer", "FW")], "club_id int, api_id long, name string, position string")
    got = resolve.match_squads(squad, players)
    assert {r.name: (r.player_id, r.tier) for r in got.collect()} == {"Whoever": (1, "api"), "exact name": (2, "exact"), "S. Surname": (3, "surname"), "E. Where": (4, "global"), "Oh Hyeon-Gyu": (5, "person"), "T. Same": (None, "new"), "New Comer": (None, "new")}
    after = resolve.mark_departures(players, got)
    assert {r.id for r in after.where("current_club_id is null").collect()} == {6}
    few = got.where("tier in ('api', 'exact')")
    assert resolve.mark_departures(players, few).where("current_club_id is null").count() == 0


def test_club_listing_gives_an_id_once(spark):
    clubs = spark.createDataFrame([(1, "Caykur Rizespor"), (2, "Ajax"), (3, "Amedspor"), (4, "Royal Twins"), (5, "Twins Royal")], "id int, name string")
    listing = spark.createDataFrame([(10, "Rizespor"), (11, "FC Ajax"), (12, "Ajax Cape Town"), (13, "Amedspor U19"), (14, "Twins Royal FK"), (15, "Taken")], "team_id int, team string")
    got = dict(rows(resolve.match_club_listing(clubs, listing, spark.createDataFrame([(15,)], "team_id int"))))
    assert got == {1: 10, 2: 11, 3: None, 4: 14, 5: None}


def test_moves_are_extracted_once(spark):
    flat = spark.createDataFrame(
        [(1, "Salih Ucan", "2024-07-13", "Free", 5, "A", 6, "B"), (1, "Salih Ucan", "2024-07-12", "Free", 5, "A", 6, "B"), (1, "Salih Ucan", "2024-01-01", "Raise", 5, "A", 7, "C"), (1, "Salih Ucan", "2024-01-01", "End of career", 5, "A", None, None), (1, "Salih Ucan", "2024-02-01", None, 5, "A", 9, "Ucan Salih"), (1, "Salih Ucan", "2024-03-01", "x", 5, "A", 5, "A"), (2, "No Day", "soon", "x", 1, "A", 2, "B"), (3, "", "2024-01-01", "x", 1, "A", 2, "B")],
        "api_id long, name string, date string, type string, out_team long, out_name string, in_team long, in_name string",
    )
    assert rows(resolve.extract_moves(flat), "api_id", "date", "from_team", "to_team", "to_name") == [(1, DAY(2024, 2, 1), 5, None, None), (1, DAY(2024, 7, 12), 5, 6, "B")]


def test_move_players(spark):
    players = spark.createDataFrame([(1, "Dusan Vlahovic", None, 9), (2, "Ana Twin", None, None), (3, "Anna Twin", None, None), (4, "Leandro Trossard", None, None)], PLAYERS)
    moves = spark.createDataFrame([(9, "Whoever"), (8, "L. Trossard"), (7, "A. Twin"), (None, "Nobody")], "api_id long, name string")
    assert rows(resolve.resolve_move_players(moves, players), "name", "player_id") == [("A. Twin", None), ("L. Trossard", 4), ("Nobody", None), ("Whoever", 1)]


STORED = "id long, player_id int, from_club_id int, to_club_id int, transfer_date date, fee_eur double, season string, transfer_type string, sources array<string>, from_club_name string, to_club_name string, date_is_exact boolean"
MOVES = "player_id int, from_club_id int, to_club_id int, date date, type string, from_name string, to_name string"


def test_one_move_of_two_sources_is_merged(spark):
    clubs = spark.createDataFrame([(1, "Juventus"), (2, "Besiktas JK"), (3, "Ajax")], "id int, name string")
    old = spark.createDataFrame([(10, 1, 1, None, DAY(2024, 7, 1), 9.5, "24/25", None, ["transfermarkt"], None, None, False), (11, 2, 1, 3, DAY(2024, 1, 1), None, None, None, None, None, None, False), (12, 3, 1, 2, DAY(2023, 1, 1), 1.0, None, None, None, None, None, True)], STORED)
    new = spark.createDataFrame([(1, None, 2, DAY(2024, 8, 11), "Free", "Juventus FC", "Besiktas"), (1, None, 2, DAY(2024, 8, 20), "Free", "Juventus", "Besiktas"), (2, 1, 2, DAY(2024, 2, 1), "Loan", "Juventus", None), (3, 1, 2, DAY(2024, 2, 1), "Loan", None, None), (None, 1, 2, DAY(2024, 2, 1), "x", None, None), (4, None, None, DAY(2024, 2, 1), "x", "A", "B")], MOVES)
    got = {(r.player_id, r.change): r for r in resolve.merge_moves(old, new, clubs).collect()}
    assert {(p, c) for p, c in got} == {(1, "merged"), (2, "kept"), (2, "new"), (3, "kept"), (3, "new")}
    m = got[1, "merged"]
    assert (m.id, m.transfer_date, m.date_is_exact, m.season, m.transfer_type, m.fee_eur, m.to_club_id, m.sources, m.from_club_name) == (10, DAY(2024, 8, 11), True, "2024-25", "Free", 9.5, 2, ["api-football", "transfermarkt"], "Juventus FC")
    assert (got[2, "new"].season, got[2, "new"].sources) == ("2023-24", ["api-football"])


def test_moves_with_one_end_each_are_two(spark):
    clubs = spark.createDataFrame([(5, "Ajax")], "id int, name string")
    old = spark.createDataFrame([], STORED)
    new = spark.createDataFrame([(1, 5, None, DAY(2024, 8, 1), "Free", None, None), (1, None, 5, DAY(2024, 8, 1), "Free", None, None), (1, None, 5, DAY(2024, 8, 1), "Free", None, None)], MOVES)
    out = resolve.merge_moves(old, new, clubs)
    assert rows(out, "from_club_id", "to_club_id", "change") == [(5, None, "new"), (None, 5, "new")]
    assert out.select("id").distinct().count() == 2


def test_rows_that_differ_in_nulls_keep_their_matches(spark):
    players = spark.createDataFrame([(1, "Ana Onlya", DAY(2000, 1, 1), 7), (2, "Bea Twina", DAY(2001, 1, 1), 7), (3, "Bea Twina", DAY(2002, 1, 1), 8)], "id int, full_name string, birth_date date, current_club_id int")
    names = spark.createDataFrame([("Bea Twinb", 7, None, None), ("Bea Twinb", None, 7, None)], "player string, born int, club_id int, source_key string")
    got = {(r.born, r.club_id): (r.player_id, r.tier) for r in resolve.match_players(names, players, manual(spark)).collect()}
    assert got == {(7, None): (None, "unmatched"), (None, 7): (2, "fuzzy")}
    quick = resolve.match_players(names, players, manual(spark), scores=True)
    assert {(r.born, r.club_id): (r.player_id, r.tier) for r in quick.collect()} == got


PEOPLE = "id int, full_name string, position string, birth_year int, birth_date date, current_club_id int, transfermarkt_id long, api_football_id long, image_url string"


def test_duplicates_merge_into_rich_records(spark):
    players = spark.createDataFrame([(1, "Alexander Nubel", None, None, None, 5, 100, None, None), (2, "A. Nubel", "Goalkeeper", None, None, 6, None, 900, "img"), (3, "Kim Min", "Defender", None, None, 1, 101, None, "x"), (4, "Min Kim", "Attack", None, None, 1, 102, None, None), (5, "Kim Min", "Attacker", None, None, 7, None, 901, None), (6, "Min Kim", None, None, None, 7, None, 902, None)], PEOPLE)
    out, verdicts = resolve.merge_duplicates_live(players)
    assert rows(verdicts) == [(2, 1, "merged"), (5, 4, "merged"), (6, None, "ambiguous")]
    assert rows(out, "id", "position", "current_club_id", "api_football_id", "image_url") == [(1, "Goalkeeper", 6, 900, "img"), (3, "Defender", 1, None, "x"), (4, "Attack", 7, 901, None), (6, None, 7, 902, None)]


def test_thin_duplicates_merge_with_their_seasons(spark):
    players = spark.createDataFrame([(1, "Efe U", None, 2001, None, None, None, None, None), (2, "EFE U.", "MF", 2001, None, 4, None, None, None), (3, "Efe U", "FW", 2001, None, 5, 77, None, None), (4, "Efe U", "FW", 2002, None, 5, None, None, None)], PEOPLE)
    stats = spark.createDataFrame([(1, "s1", 1, 10), (2, "s1", 1, 20), (2, "s2", 1, 30), (3, "s1", 1, 40)], "player_id int, season string, club_id int, minutes int")
    kept, moved = resolve.merge_duplicates_thin(players, stats)
    assert rows(kept, "id", "position", "current_club_id") == [(1, "MF", 4), (3, "FW", 5), (4, "FW", 5)]
    assert rows(moved) == [(1, "s1", 1, 10), (1, "s2", 1, 30), (3, "s1", 1, 40)]


def test_nationality_needs_agreement(spark):
    players = spark.createDataFrame([(1, None), (2, None), (3, None), (4, "DE"), (5, None)], "id int, nationality_code string")
    stats = spark.createDataFrame([(1, " tur "), (1, "TUR"), (2, "TUR"), (2, "GER"), (3, "ZZZ"), (4, "TUR"), (5, None)], "player_id int, nation string")
    codes = spark.createDataFrame([("TUR", "tr"), ("GER", "DE"), ("ZZZ", "ZZ")], "fifa_code string, iso_code string")
    out, report = resolve.backfill_nationality(players, stats, codes, spark.createDataFrame([("TR",), ("DE",)], "code string"))
    assert rows(out) == [(1, "TR"), (2, None), (3, None), (4, "DE"), (5, None)]
    assert rows(report) == [("conflict", 1), ("filled", 1), ("unmapped", 1)]


def test_current_clubs(spark):
    now = DAY(2024, 6, 1)
    players = spark.createDataFrame([(1, 9, "2023-24"), (2, 9, "2023-24"), (3, 9, "2023-24"), (4, 9, "2019-20"), (5, 9, "2023-24"), (6, 3, "2023-24")], "id int, current_club_id int, last_season string")
    apps = spark.createDataFrame([(1, DAY(2024, 5, 1), 1, 3), (2, DAY(2024, 5, 1), 2, 3), (5, DAY(2020, 1, 1), 3, 3), (6, DAY(2024, 5, 1), 4, 3), (6, DAY(2024, 5, 1), 5, 4)], "player_id int, played_on date, match_id int, club_id int")
    moves = spark.createDataFrame([(1, DAY(2024, 5, 1), 1, None), (2, DAY(2024, 4, 1), 2, 8), (5, DAY(2024, 7, 1), 3, 8)], "player_id int, transfer_date date, id int, to_club_id int")
    got = rows(resolve.refresh_current_clubs(players, apps, moves, now))
    assert got == [(1, 9, None, "cleared"), (2, 9, 3, "moved"), (3, 9, 9, None), (4, 9, None, "cleared"), (5, 9, 9, None), (6, 3, 4, "moved")]


def test_person_pairs_do_not_depend_on_partitions(spark):
    names = spark.createDataFrame([(i, f"given{i % 3} family{i}") for i in range(60)], "id int, full_name string")
    other = spark.createDataFrame([(100 + i, f"family{i} given{i % 3}") for i in range(0, 60, 2)], "id int, full_name string")
    want = {(i, 100 + i) for i in range(0, 60, 2)}
    for n in (1, 5):
        assert {tuple(r) for r in resolve.person_pairs(names.repartition(n), other.orderBy(F.rand(n))).collect()} == want


def test_namesakes_form_no_pairs(spark):
    """Crowds of one name, of one word and of turned words: counts and verdicts as of all pairs, from pairs of classes alone."""
    left = [(i, "Joao Silva" if i % 2 else "Silva Joao", "Silva" if i % 2 else "Joao") for i in range(600)] + [(1000, "Silva", "Silva"), (1001, "J. Silva", "Silva"), (1002, "Rare Bird", "Bird"), (1003, "Nobody", None), (1004, None, None)]
    right = [(i, "Joao Silva", "Silva") for i in range(3000)] + [(5000, "Bird Rare", "Rare"), (5001, "Silva", None), (5002, "", "")]
    schema = "id int, full_name string, surname string"
    l, r = spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema).repartition(5)
    got = {x.id: (x.n, x.low, x.high, x.n_same, x.low_same) for x in resolve.person_matches(l, r, "surname").collect()}
    crowd = lambda surname: (3001, 0, 5001, 3000 if surname == "Silva" else 0, 0 if surname == "Silva" else None)
    assert got == {i: crowd(s) for i, _, s in left[:600]} | {1000: crowd("Silva"), 1001: (3000, 0, 2999, 3000, 0), 1002: (1, 5000, 5000, 0, None)}
    names = lambda df: df.select(resolve._name("full_name").alias("name")).where("name is not null").distinct()
    assert resolve.class_pairs(names(l), names(r)).count() == 6  # of 1.8 million pairs of rows


def test_matches_are_those_of_pairs(spark):
    rng = random.Random(3)
    made = lambda n, at: [(at + i, " ".join(rng.choice(["ana", "bo", "c", "d.", "eve", "fox", "b"]) for _ in range(rng.randrange(4))), rng.choice(["x", "y", None])) for i in range(n)]
    left, right = made(80, 0), made(80, 100)
    l, r = (spark.createDataFrame(x, "id int, full_name string, own string") for x in (left, right))
    pairs = l.select(F.col("id").alias("a"), F.col("full_name").alias("an"), F.col("own").alias("ao")).crossJoin(r.select(F.col("id").alias("b"), F.col("full_name").alias("bn"), F.col("own").alias("bo")))
    pairs = [(x.a, x.b, x.ao == x.bo and x.ao is not None) for x in pairs.where(same_person("an", "bn")).collect()]
    assert {(x.left_id, x.right_id) for x in resolve.person_pairs(l, r).collect()} == {p[:2] for p in pairs} and len(pairs) > 50
    want = {}
    for a, b, same in pairs:
        want.setdefault(a, []).append((b, same))
    got = {x.id: (x.n, x.low, x.high, x.n_same, x.low_same, x.high_same) for x in resolve.person_matches(l, r, "own").collect()}
    ends = lambda bs: (min(bs), max(bs)) if bs else (None, None)
    assert got == {a: (len(bs), *ends([b for b, _ in bs]), sum(s for _, s in bs), *ends([b for b, s in bs if s])) for a, bs in want.items()}


def test_ids_are_never_shared(spark):
    rows_ = spark.createDataFrame([(f"name {i % 40}", i % 40 if i % 3 else None, i) for i in range(240)], "a string, b int, c int")
    keys = {(x.a, x.b) for x in rows_.collect()}
    free = {(x.a, x.b): x.id for x in resolve.with_ids(rows_, ["a", "b"]).collect()}
    assert len(set(free.values())) == len(keys) and all(i > 0 for i in free.values())
    taken = spark.createDataFrame([(i,) for i in range(0, 256, 2)], "id long")
    for bits, used in ((8, None), (9, taken)):  # so few bits that many keys clash
        out = resolve.with_ids(rows_.repartition(3), ["a", "b"], taken=used, bits=bits).collect()
        ids = {}
        for x in out:
            ids.setdefault((x.a, x.b), set()).add(x.id)
        assert len(out) == 240 and set(ids) == keys and all(len(i) == 1 for i in ids.values())
        assert len(set.union(*ids.values())) == len(keys) and not (used is not None and set.union(*ids.values()) & set(range(0, 256, 2)))
        again = {(x.a, x.b): x.id for x in resolve.with_ids(rows_.orderBy(F.rand(2)), ["a", "b"], taken=used, bits=bits).collect()}
        assert all(ids[k] == {v} for k, v in again.items())  # the same in every run
    with pytest.raises(ValueError, match="too few"):
        resolve.with_ids(rows_, ["a", "b"], bits=2)
    new, own = resolve.create_missing(spark.createDataFrame([(f"P{i}", 2000, 1, None) for i in range(30)], "player string, born int, club_id int, position string"), bits=6)
    assert new.select("id").distinct().count() == new.count() == 30 and own.select("player_id").distinct().count() == 30


@pytest.mark.parametrize("tile", [4096, 7])
def test_pairs_of_a_block_are_judged_once_a_pair_of_names(spark, tile):
    names = ["ali kaya", "kaya ali", "a kaya", "kaya", None, "", "mehmet kaya", "fc kaya"]
    left = spark.createDataFrame([(i, names[i * 7 % 8], "x" if i < 40 else "y" if i < 60 else None) for i in range(64)], "a_id int, a string, k string").coalesce(1)
    right = spark.createDataFrame([(i, names[i * 5 % 8], "x" if i < 40 else "y" if i < 60 else None) for i in range(64)], "b_id int, b string, k string").coalesce(1)
    plain = left.join(right, "k").where("a_id < b_id").select("a_id", "b_id", same_person("a", "b").alias("person"), same_club("a", "b").alias("club"))
    got = resolve.same_pairs(left, right, ["k"], tile)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() == 40 * 39 // 2 + 20 * 19 // 2
    assert len({r[0] for r in got.select(F.spark_partition_id()).distinct().collect()}) > 1
