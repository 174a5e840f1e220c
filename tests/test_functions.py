import datetime

import pytest
from pyspark.sql import functions as F

from pitchspark import functions as fn


def values(spark, rows, *columns):
    width = len(rows[0]) if isinstance(rows[0], tuple) else 1
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"c{i} string" for i in range(width)))
    out = df.withColumn("i", F.monotonically_increasing_id()).orderBy("i").select(*columns).collect()
    return [tuple(r) if len(columns) > 1 else r[0] for r in out]


def test_tolerant_casts(spark):
    raw = ["12.0", " 7 ", "", "NaN", "na", "None", "x", "-3.9", None]
    assert values(spark, raw, fn.as_int("c0")) == [12, 7, None, None, None, None, None, -3, None]
    assert values(spark, raw, fn.as_number("c0")) == [12.0, 7.0, None, None, None, None, None, -3.9, None]
    assert values(spark, ["2024-02-30", "2024-02-29 10:00", "x", None], fn.as_date("c0")) == [None, datetime.date(2024, 2, 29), None, None]
    assert values(spark, ["  abcdef ", "nan", " "], fn.as_text("c0", 3)) == ["abc", None, None]


def test_seasons(spark):
    assert values(spark, ["2526", "2627", "9900", "2026", "2025", "2025-26"], fn.season_label("c0")) == ["2025-26", "2026-27", "2099-00", "2026", "2025", "2025-26"]
    assert values(spark, ["2025", "1999", " 2009 ", "25", "nan", None], fn.season_from_start_year("c0")) == ["2025-26", "1999-00", "2009-10", None, None, None]
    assert values(spark, ["2026-08-11", "2026-06-30", "1999-07-01", None], fn.season_of_date(F.to_date("c0"))) == ["2026-27", "2025-26", "1999-00", None]
    assert values(spark, ["26/27", "2026-27", "2026"], fn.normalise_season("c0")) == ["2026-27", "2026-27", "2026"]


def test_positions(spark):
    rows = [("MF,FW", "Attack"), ("MF", "Goalkeeper"), ("DF", "Attack"), (None, None), ("??", None), ("FW/MF", "Defender"), (None, "Centre-Back"), ("GK", None), ("left winger", None)]
    assert values(spark, rows, fn.resolve_position_group("c0", "c1")) == ["FW", "MF", "DF", None, None, "FW", "DF", "GK", "FW"]
    assert values(spark, ["MF,FW", "DF", "DF,DF", "", None], fn.groups_in("c0")) == [["MF", "FW"], ["DF"], ["DF"], [], []]
    assert values(spark, [("?", "Keeper")], fn.position_group("c0", "c1")) == ["GK"]


def test_names(spark):
    raw = ["Đorđe Petrović", "Martin Ødegaard", "Işık ŞAĞLAM", "João  Félix-Sequeira", "O'Neil", "Łukasz ßæ", "日本"]
    assert values(spark, raw, fn.normalize_name("c0")) == ["dorde petrovic", "martin odegaard", "isik saglam", "joao felix sequeira", "o neil", "lukasz ssae", ""]
    assert values(spark, ["Ånge É"], fn.fold("c0")) == ["ange e"]
    clubs = ["Manchester City FC", "Manchester United", "Real Madrid CF", "Atletico de Madrid", "FC", "AFC Football Club"]
    assert values(spark, clubs, fn.club_key("c0")) == ["manchester city", "manchester united", "real madrid", "atletico de madrid", "fc", "afc football club"]
    assert values(spark, ["A. Nübel", "", "Pelé"], fn.surname_key("c0")) == ["a nubel", None, "p pele"]
    assert values(spark, ["Besiktas Jimnastik Kulubu", "Caykur Rizespor", "Yeni Corumspor", "Yeni Spor", "FC X"], fn.search_terms("c0")) == [["besiktas"], ["rizespor", "caykur"], ["corumspor"], ["yeni", "spor"], ["fc x"]]


def test_same_person(spark):
    yes = [("Hyeon-gyu Oh", "Oh Hyeon-Gyu"), ("A. Nübel", "Alexander Nubel"), ("Salih Ucan", "Ucan Salih"), ("Neymar", "Neymar Jr Santos")]
    no = [("B. Nübel", "Alexander Nubel"), ("John Smith", "John Smyth"), ("", "X Y"), ("A B", "A B"), (None, "A")]
    assert values(spark, yes + no, fn.same_person("c0", "c1")) == [True] * len(yes) + [False] * len(no)


def test_same_club(spark):
    yes = [("Rizespor", "Caykur Rizespor"), ("Gençlerbirliği S.K.", "Genclerbirligi"), ("Darıca Gençlerbirliği", "Gençlerbirliği")]
    no = [("Manchester City", "Manchester United"), ("", "X")]
    assert values(spark, yes + no, fn.same_club("c0", "c1")) == [True] * 3 + [False] * 2
    assert values(spark, ["Amedspor U19", "Ajax II", "Barcelona", "Jong B"], fn.is_youth_team("c0")) == [True, True, False, True]


@pytest.mark.parametrize(
    ("born", "year", "as_of", "age"),
    [("2000-06-15", None, "2024-06-14", 23), ("2000-06-15", None, "2024-06-15", 24), ("2004-02-29", None, "2023-02-28", 18), (None, "2001", "2024-01-01", 23), (None, None, "2024-01-01", None)],
)
def test_age(spark, born, year, as_of, age):
    df = spark.createDataFrame([(born, year)], "b string, y string").select(F.to_date("b").alias("b"), F.col("y").cast("int").alias("y"))
    assert df.select(fn.age_at("b", "y", datetime.date.fromisoformat(as_of))).first()[0] == age


def test_birth_bounds_clip_leap_days(spark):
    before, after = fn.birth_bounds(18, 23, datetime.date(2024, 2, 29))
    assert tuple(spark.range(1).select(before, after).first()) == (datetime.date(2006, 2, 28), datetime.date(2000, 2, 29))
    assert fn.birth_bounds(None, None, datetime.date(2024, 1, 1)) == (None, None)


def test_rates_dates_and_zones(spark):
    df = spark.createDataFrame([(9, 1800), (9, 899), (None, 1800), (1, None)], "g int, m int")
    assert [r[0] for r in df.select(fn.per_90("g", "m")).collect()] == [0.45, None, None, None]
    days = ["2024-07-01", "2024-06-30", "2024-01-01", "2024-12-31", "2024-07-02", None]
    assert values(spark, days, fn.date_is_exact(F.to_date("c0"))) == [False, False, False, False, True, False]
    spots = [(0.99, 0.5), (0.96, 0.5), (0.9, 0.5), (0.85, 0.5), (0.8, 0.5), (0.95, 0.05), (0.9, 0.95), (None, 0.5)]
    shots = spark.createDataFrame(spots, "x double, y double")
    assert [r[0] for r in shots.select(fn.zone_of("x", "y")).collect()] == ["six_yard", "six_yard", "penalty_area", "penalty_area", "outside", "wide", "wide", "outside"]
