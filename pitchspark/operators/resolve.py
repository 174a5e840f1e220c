"""Entity resolution (E1-E14): waterfalls of equi-joins; a candidate counts where it is the only one of its key."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import FUZZY_ACCEPT, NON_MOVES, RECENT_DAYS, SAME_MOVE_DAYS
from ..functions import club_key, normalize_name, position_group, same_person, season_of_date, surname_key
from ..functions.text import as_date, club_tokens, is_youth_team, name_words, row_key, same_tokens, same_words, subset
from ..sources.scratch import stored
from ..sources.tables import latest_rows


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity of two keys."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def same_pairs(left: DataFrame, right: DataFrame, block: Sequence[str], tile: int = 4096) -> DataFrame:
    """a_id, b_id, person, club: ``same_person`` and ``same_club`` of all pairs with a_id < b_id that share ``block``.

    Left: a_id, a (name), block; right: b_id, b, block. Verdicts depend on names alone, so the rows of a block that are named
    alike are one row with their ids, each pair of names is judged once, and only then spread into its pairs of ids. A block
    of more than ``tile`` left rows is cut into parts, each of which meets the whole right side in tasks of its own.
    """
    block = list(block)
    where = [*block, "part"]
    cut = lambda i: F.pmod(F.xxhash64(i), F.col("parts")).cast("int")
    sizes = left.groupBy(*block).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lefts = left.join(sizes, block).select(*block, cut("a_id").alias("part"), "a_id", "a").repartition(n, *where)
    lefts = lefts.groupBy(*where, "a").agg(F.collect_list("a_id").alias("a_ids"), F.min("a_id").alias("low"))
    rights = right.join(sizes, block).select(*block, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), cut("b_id").alias("slice"), "b_id", "b").repartition(n, *where)
    rights = rights.groupBy(*where, "slice", "b").agg(F.collect_list("b_id").alias("b_ids"), F.max("b_id").alias("high"))
    known = lambda df, c: df.withColumns({f"{c}_words": name_words(c), f"{c}_tokens": club_tokens(c)})
    met = known(lefts, "a").join(known(rights, "b"), where).where("low < high")
    club = F.coalesce(same_tokens(F.col("a_tokens"), F.col("b_tokens")), F.lit(False))
    judged = met.select("a_ids", "b_ids", same_words(F.col("a_words"), F.col("b_words")).alias("person"), club.alias("club"))
    spread = judged.select(F.explode("a_ids").alias("a_id"), "b_ids", "person", "club")
    return spread.select("a_id", F.explode("b_ids").alias("b_id"), "person", "club").where("a_id < b_id")


#: Letters with a bit of their own; all others share one. Counts of a letter up to ``LEVELS`` are told apart.
LETTERS, LEVELS = "abcdefghijklmnopqrstuvwxyz0123456789 ", 4


def letter_bits(c: Column | str) -> Column:
    """n, rest, b1, b2, ...: length of a text, and bit i of b_k says whether letter i occurs k times; ``rest`` counts what occurs more often."""
    text = F.col(c) if isinstance(c, str) else c
    place = lambda x: F.when(F.instr(F.lit(LETTERS), x) > 0, F.instr(F.lit(LETTERS), x) - 1).otherwise(len(LETTERS))
    codes = F.transform(F.filter(F.split(text, ""), lambda x: x != ""), place)
    every = F.sequence(F.lit(0), F.lit(len(LETTERS)))
    counts = F.transform(F.array(codes), lambda own: F.transform(every, lambda i: F.size(F.filter(own, lambda x: x == i))))
    level = lambda n, k: F.aggregate(F.transform(n, lambda x, i: F.when(x >= k, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    rest = lambda n: F.aggregate(n, F.lit(0), lambda s, x: s + F.greatest(x - LEVELS, F.lit(0)))
    bits = F.transform(counts, lambda n: F.struct(F.length(text).alias("n"), rest(n).alias("rest"), *[level(n, k).alias(f"b{k}") for k in range(1, LEVELS + 1)]))
    return F.get(bits, 0)


def ratio_bound(a: Column, b: Column) -> Column:
    """What the ratio of two texts cannot exceed, from their ``letter_bits``: as many letters as both have match at most."""
    shared = F.least(a["rest"], b["rest"])
    for k in range(1, LEVELS + 1):
        shared = shared + F.bit_count(a[f"b{k}"].bitwiseAND(b[f"b{k}"]))
    return 2.0 * shared / (a["n"] + b["n"])


def fuzzy_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], a: str, b: str, accept: float, where: Column | str | None = None) -> DataFrame:
    """Pairs of ``left`` and ``right`` that share ``on`` and whose letters allow a ratio of ``accept``.

    Letters are counted once a name; a pair is a few operations on longs inside the join, which hands on no other pair.
    """
    near = (F.col("_a.n") + F.col("_b.n") > 0) & (ratio_bound(F.col("_a"), F.col("_b")) >= accept)
    met = left.withColumn("_a", letter_bits(a)).join(right.withColumn("_b", letter_bits(b)), list(on))
    return (met if where is None else met.where(where)).where(near).drop("_a", "_b")


def fuzzy_best(left: DataFrame, right: DataFrame, on: Sequence[str], by: Sequence[str], a: str, b: str, candidate: str, accept: float = FUZZY_ACCEPT, where: Column | str | None = None) -> DataFrame:
    """by, best_id, best_score: the most similar candidate of each row of ``left`` that reaches ``accept``, the lowest id of equals.

    ``left`` has text ``a``, ``right`` text ``b`` and ``candidate``; both share the block ``on``. Only what ``fuzzy_pairs``
    lets through is compared letter by letter; with ``accept`` 0 that is the whole block.
    """
    scored = fuzzy_pairs(left, right, on, a, b, accept, where).withColumn("score", fuzzy_ratio(F.col(a), F.col(b))).where(F.col("score") >= accept)
    best = F.max_by(F.struct(candidate, "score"), F.struct("score", -F.col(candidate))).alias("_best")
    return scored.groupBy(*by).agg(best).select(*by, F.col(f"_best.{candidate}").alias("best_id"), F.col("_best.score").alias("best_score"))


def word_pairs(inner: DataFrame, outer: DataFrame, on: Sequence[str], a: str, b: str) -> DataFrame:
    """Pairs that share ``on`` where the words of ``a`` are all among those of ``b``: met by the longest word of ``a``."""
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    longest = F.array_max(F.transform(words(a), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    met = inner.where(F.size(words(a)) > 0).withColumn("_word", longest).join(outer.withColumn("_word", F.explode(F.array_distinct(words(b)))), [*on, "_word"])
    return met.where(subset(words(a), words(b))).drop("_word")


def only(df: DataFrame, keys: list[str], c: str, out: str) -> DataFrame:
    """keys, out: the value of ``c`` where a key has a single one."""
    return df.groupBy(*keys).agg(F.min(c).alias(out), F.max(c).alias("_last")).where(F.col(out) == F.col("_last")).drop("_last")


def match_clubs(names: DataFrame, clubs: DataFrame, manual: DataFrame, accept: float = FUZZY_ACCEPT, scores: bool = False) -> DataFrame:
    """league_id, team, club_id, tier, score, ambiguous for each distinct (league_id, team).

    Tiers: manual (source_key 'league|name'), exact key, single candidate whose words contain the name's, fuzzy,
    unmatched. Keys of several clubs of a league are no candidates. With ``scores`` all pairs of a league are compared, so
    that what stays unmatched shows how near it came; without, only pairs whose letters allow ``accept``, and it shows 0.
    """
    rows = names.select("league_id", "team").distinct().withColumns({"key": club_key("team"), "source_key": F.concat_ws("|", F.col("league_id").cast("string"), normalize_name("team"))})
    keyed = clubs.where("league_id is not null").select("league_id", club_key("name").alias("key"), "id")
    single = only(keyed, ["league_id", "key"], "id", "exact_id")
    several = keyed.groupBy("league_id", "key").agg(F.count_distinct("id").alias("n")).where("n > 1").select("league_id", "key", F.lit(True).alias("ambiguous"))
    by_hand = manual.select("source_key", F.col("target_id").alias("manual_id"))
    rows = rows.join(by_hand, "source_key", "left").join(single, ["league_id", "key"], "left").join(several, ["league_id", "key"], "left")
    left = rows.where("manual_id is null and exact_id is null").select("league_id", "team", "key")
    others = single.select("league_id", F.col("key").alias("other"), F.col("exact_id").alias("id"))
    inside = word_pairs(left, others, ["league_id"], "key", "other").groupBy("league_id", "team").agg(F.min("id").alias("token_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    open_rows = left.join(inside, ["league_id", "team"], "left_anti")
    best = fuzzy_best(open_rows, others, ["league_id"], ["league_id", "team"], "key", "other", "id", 0.0 if scores else accept)
    rows = rows.join(inside, ["league_id", "team"], "left").join(best, ["league_id", "team"], "left")
    good = F.col("best_score") >= accept
    tier = F.when(F.col("manual_id").isNotNull(), "manual").when(F.col("exact_id").isNotNull(), "exact").when(F.col("token_id").isNotNull(), "token").when(good, "fuzzy").otherwise("unmatched")
    club = F.coalesce("manual_id", "exact_id", "token_id", F.when(good, F.col("best_id")))
    return rows.select("league_id", "team", club.alias("club_id"), tier.alias("tier"), F.coalesce("best_score", F.lit(0.0)).alias("score"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def match_players(names: DataFrame, players: DataFrame, manual: DataFrame, accept: float = FUZZY_ACCEPT, scores: bool = False) -> DataFrame:
    """player, born, club_id, source_key, player_id, tier, score for each distinct (player, born, club_id, source_key).

    ``source_key`` may be null: then the normalised name is the key of manual mappings. Tiers: manual; the only
    player of that name; the only one of it born that year; or at that club; the only one of that year, initial and
    surname; of that year and surname; the only squad-mate whose words contain the name's or the other way round;
    the most similar squad-mate. Birth years come from full dates alone, and squad-mates with another year are out.
    ``scores``: as in ``match_clubs``.
    """
    keys = ["player", "born", "club_id", "source_key"]
    rows = names.select(*keys).distinct().withColumn("row", row_key(*keys))
    key = normalize_name("player")
    rows = rows.withColumns({"key": key, "lookup": F.coalesce(F.nullif("source_key", F.lit("")), key)})
    parts = F.split("key", " ")
    rows = rows.withColumns({"initial": F.substring("key", 1, 1), "surname": F.when(F.col("key") != "", F.element_at(parts, -1))})
    known = players.select("id", normalize_name("full_name").alias("key"), F.year("birth_date").alias("born"), F.col("current_club_id").alias("club_id"))
    known = known.withColumns({"initial": F.substring("key", 1, 1), "surname": F.when(F.col("key") != "", F.element_at(F.split("key", " "), -1))})
    rows = rows.join(manual.select(F.col("source_key").alias("lookup"), F.col("target_id").alias("m_id")), "lookup", "left")
    tiers = [("m_id", "manual")]
    for columns, out, tier in (
        (["key"], "name_id", "exact"),
        (["key", "born"], "year_id", "exact"),
        (["key", "club_id"], "club_name_id", "token"),
        (["born", "initial", "surname"], "initial_id", "token"),
        (["born", "surname"], "surname_id", "token"),
    ):
        rows = rows.join(only(known.dropna(subset=columns), columns, "id", out), columns, "left")
        tiers.append((out, tier))
    left = rows.where(F.coalesce(*[F.col(c) for c, _ in tiers]).isNull()).select("row", "key", "club_id", F.col("born").alias("year"))
    squad = known.where("club_id is not null").groupBy("club_id", "key").agg(F.min_by(F.struct("id", "born"), "id").alias("p")).select("club_id", F.col("key").alias("other"), "p.id", "p.born")
    same_year = F.expr("year is null or born is null or year = born")
    met = word_pairs(left, squad, ["club_id"], "key", "other").unionByName(word_pairs(squad, left, ["club_id"], "other", "key"))
    # a name without words is inside every other: a club has one such squad-mate at most, and few rows are so called
    for a, b in ((left.where("key = ''"), squad), (left, squad.where("other = ''"))):
        met = met.unionByName(a.join(b, "club_id"))
    inside = met.where(same_year).select("row", "id").distinct().groupBy("row").agg(F.min("id").alias("inside_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    best = fuzzy_best(left.join(inside, "row", "left_anti"), squad, ["club_id"], ["row"], "key", "other", "id", 0.0 if scores else accept, same_year)
    rows = rows.join(inside, "row", "left").join(best, "row", "left")
    tiers.append(("inside_id", "token"))
    good = F.col("best_score") >= accept
    label = F.when(good, "fuzzy").otherwise("unmatched")
    for c, tier in reversed(tiers):
        label = F.when(F.col(c).isNotNull(), tier).otherwise(label)
    player = F.coalesce(*[F.col(c) for c, _ in tiers], F.when(good, F.col("best_id")))
    return rows.select(*keys, player.alias("player_id"), label.alias("tier"), F.coalesce("best_score", F.lit(0.0)).alias("score"))


def match_report(matched: DataFrame) -> DataFrame:
    """tier, n."""
    return matched.groupBy("tier").agg(F.count("*").alias("n"))


def new_id(*keys: Column | str) -> Column:
    """A positive id from the key itself, nulls included: the same in every run and task, without a global order."""
    return F.shiftrightunsigned(F.xxhash64(F.to_json(F.struct(*keys))), 1)


ID_BITS = 63


def with_ids(rows: DataFrame, keys: Sequence[str], out: str = "id", taken: DataFrame | None = None, bits: int = ID_BITS) -> DataFrame:
    """``rows`` with an id of their ``keys``: that of ``new_id``, unless other keys, or ``taken`` (id), have it.

    Distinct keys of one id are found by one count. They are ranked by key: the first keeps the id where it isn't taken, the
    others are numbered anew, with the round in the hash, until none is left. Among 10**9 keys one pair or none is
    expected, so that a round more is a few rows.
    """
    text = F.to_json(F.struct(*keys))
    number = lambda i: F.shiftrightunsigned(F.xxhash64(*([F.lit(i)] if i else []), "_key"), 64 - bits)
    keyed = rows.withColumn("_key", text)
    every = stored(keyed.select("_key").distinct().withColumn("_id", number(0)), "ids")
    used = every.select("_id").limit(0) if taken is None else taken.select(F.col(taken.columns[0]).alias("_id"))

    def clashing(ids: DataFrame) -> DataFrame:
        several = ids.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id")
        return stored(ids.join(several.union(ids.join(used, "_id", "left_semi").select("_id")).distinct(), "_id", "left_semi"), "clashes")

    given, open_ids, i = every, clashing(every), 0
    while not open_ids.isEmpty():
        i += 1
        if i > 64:
            raise ValueError(f"{bits} bits are too few for the ids")
        rank = F.row_number().over(Window.partitionBy("_id").orderBy("_key"))  # the rows of a clash
        ranked = open_ids.withColumn("rank", rank).join(used.select("_id", F.lit(True).alias("gone")).distinct(), "_id", "left")
        again = ranked.where("rank > 1 or gone").select("_key", number(i).alias("_new"))
        given = stored(given.join(again, "_key", "left").select("_key", F.coalesce("_new", "_id").alias("_id")), "ids")
        open_ids = clashing(given)
    if not i:
        return keyed.withColumn(out, number(0)).drop("_key")
    return keyed.join(given, "_key").withColumn(out, F.col("_id")).drop("_key", "_id")


def create_missing(unmatched: DataFrame, taken: DataFrame | None = None, bits: int = ID_BITS) -> tuple[DataFrame, DataFrame]:
    """(new thin players, their rows' ids): one player a normalised name and birth year, at however many clubs.

    ``unmatched``: player, born, club_id, position. A new player takes name, position and club of the lowest club's row.
    Ids: ``with_ids``; two players never share one, nor have one that is ``taken``.
    """
    rows = with_ids(unmatched.withColumn("name_key", normalize_name("player")), ["name_key", "born"], "id", taken, bits)
    first = F.min_by(F.struct("player", "position", "club_id"), F.struct("club_id", "player"))
    new = rows.groupBy("id", F.col("born").alias("birth_year")).agg(first.alias("f")).select("id", F.col("f.player").alias("full_name"), "birth_year", "f.position", F.col("f.club_id").alias("current_club_id"))
    return new, rows.select("player", "born", "club_id", F.col("id").alias("player_id")).distinct()


def create_missing_clubs(unmatched: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """id, name, league_id: one new club a league and team. Ids: ``with_ids``."""
    new = unmatched.where("league_id is not null").select("league_id", F.col("team").alias("name")).distinct()
    return with_ids(new, ["league_id", "name"], "id", taken).select("id", "name", "league_id")


def _name(c: Column | str) -> Column:
    """The words of a name in one order: names of one class are one person's spelling, whatever their order."""
    return F.array_join(F.array_sort(name_words(c)), " ")


def class_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_name, right_name of all ``same_person`` pairs of distinct classes (name).

    The real words of one side contain the other's, so the rarest word of the smaller side is among the larger's:
    each side's rarest word is looked up in all words of the other. Words are counted over classes, not rows.
    """
    words = lambda df: df.select("name", F.explode(F.filter(F.split("name", " "), lambda x: F.length(x) > 1)).alias("token"))
    lw, rw = words(left), words(right)
    frequency = lw.union(rw).groupBy("token").agg(F.count("*").alias("n"))
    rarest = lambda df: df.join(frequency, "token").groupBy("name").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    as_left, as_right = (lambda df: df.withColumnRenamed("name", "left_name")), (lambda df: df.withColumnRenamed("name", "right_name"))
    met = as_left(rarest(lw)).join(as_right(rw), "token").select("left_name", "right_name").union(as_left(lw).join(as_right(rarest(rw)), "token").select("left_name", "right_name"))
    return met.distinct().where(same_words(F.split("left_name", " "), F.split("right_name", " ")))


def person_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id of all ``same_person`` pairs. Sides: id, full_name. Pairs of name classes are found first, then their rows."""
    l, r = (df.select(F.col("id").alias(f"{side}_id"), _name("full_name").alias(f"{side}_name")) for side, df in (("left", left), ("right", right)))
    pairs = class_pairs(l.select(F.col("left_name").alias("name")).distinct(), r.select(F.col("right_name").alias("name")).distinct())
    return pairs.join(l, "left_name").join(r, "right_name").select("left_id", "right_id").distinct()


def person_matches(left: DataFrame, right: DataFrame, same: str | None = None) -> DataFrame:
    """id, n, low, high of the ``same_person`` rows of ``right`` for each row of ``left`` that has some.

    Sides: id, full_name, and ``same``: n_same, low_same and high_same are of those that agree with the row in it. Classes
    of names meet, each with its number of rows, lowest and highest id, and rows look up their class: of any number of
    namesakes no pair is formed.
    """
    extra = [same] if same else []
    l = left.select("id", _name("full_name").alias("name"), *extra)
    r = right.select("id", _name("full_name").alias("name"), *extra).groupBy("name", *extra).agg(F.count_distinct("id").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    names = lambda df: df.select("name").distinct()
    pairs = class_pairs(names(l), names(r))
    met = names(l).withColumnRenamed("name", "left_name").join(pairs, "left_name").join(r.withColumnRenamed("name", "right_name"), "right_name")
    sums = [F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")]
    out = l.join(met.groupBy(F.col("left_name").alias("name")).agg(*sums), "name")
    if same:
        own = met.where(F.col(same).isNotNull()).groupBy(F.col("left_name").alias("name"), same).agg(*[F.sum("n").alias("n_same"), F.min("low").alias("low_same"), F.max("high").alias("high_same")])
        out = out.join(own, ["name", same], "left").withColumn("n_same", F.coalesce("n_same", F.lit(0)))
    return out.drop("name", *extra)


def match_squads(squad: DataFrame, players: DataFrame) -> DataFrame:
    """Squad rows with player_id and tier. ``squad``: club_id, api_id, name, position. ``players``: id, full_name, current_club_id, api_football_id.

    Tiers: live id; exact name, then the only surname key, among the club's candidates (its players, and all with a
    live id); the only surname key anywhere; the only ``same_person``. The rest is new (created or reported).
    """
    rows = squad.withColumns({"row": row_key("club_id", "api_id", "name"), "key": normalize_name("name"), "short": surname_key("name")})
    p = players.select("id", "api_football_id", "current_club_id", normalize_name("full_name").alias("key"), surname_key("full_name").alias("short"))
    live = p.where("api_football_id is not null")
    rows = rows.join(live.groupBy(F.col("api_football_id").alias("api_id")).agg(F.max("id").alias("api_hit")), "api_id", "left")
    for column, how in (("key", F.max("id")), ("short", None)):
        sides = []
        for part, keys in ((p.where("api_football_id is null and current_club_id is not null").withColumnRenamed("current_club_id", "club_id"), ["club_id", column]), (live, [column])):
            own = part.dropna(subset=[column])
            agg = [F.max("id").alias("hi"), F.min("id").alias("lo")]
            sides.append((own.groupBy(*keys).agg(*agg), keys))
        (at_club, club_keys), (anywhere, keys) = sides
        rows = rows.join(at_club.select(*club_keys, F.col("hi").alias("c_hi"), F.col("lo").alias("c_lo")), club_keys, "left").join(anywhere.select(*keys, F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo")), keys, "left")
        hi, lo = F.greatest("c_hi", "a_hi"), F.least("c_lo", "a_lo")
        rows = rows.withColumn(f"{column}_hit", hi if how is not None else F.when(hi == lo, hi)).drop("c_hi", "c_lo", "a_hi", "a_lo")
    rows = rows.join(only(p.dropna(subset=["short"]), ["short"], "id", "global_hit"), "short", "left")
    hits = ["api_hit", "key_hit", "short_hit", "global_hit"]
    left = rows.where(F.coalesce(*hits).isNull()).select(F.col("row").alias("id"), F.col("name").alias("full_name"))
    found = person_matches(left.distinct(), players.select("id", "full_name"))
    person = found.where("low = high").select(F.col("id").alias("row"), F.col("low").alias("person_hit"))
    rows = rows.join(person, "row", "left")
    tier = F.lit("new")
    for c in reversed([*hits, "person_hit"]):
        tier = F.when(F.col(c).isNotNull(), c.removesuffix("_hit")).otherwise(tier)
    return rows.select(squad.columns + [F.coalesce(*hits, "person_hit").alias("player_id"), F.regexp_replace(F.regexp_replace(tier, "^key$", "exact"), "^short$", "surname").alias("tier")])


def mark_departures(players: DataFrame, matched: DataFrame) -> DataFrame:
    """``players`` with a null club for those still filed at a club whose live squad lacks them.

    ``matched``: squad rows with club_id, player_id. A club counts once at least max(5, half its squad) rows matched.
    """
    sizes = matched.groupBy("club_id").agg(F.count("*").alias("n"), F.count("player_id").alias("hit"))
    sure = sizes.where(F.col("hit") >= F.greatest(F.lit(5), F.floor(F.col("n") / 2))).select(F.col("club_id").alias("current_club_id"), F.lit(True).alias("sure"))
    present = matched.where("player_id is not null").select(F.col("club_id").alias("current_club_id"), F.col("player_id").alias("id"), F.lit(True).alias("present")).distinct()
    rows = players.join(sure, "current_club_id", "left").join(present, ["current_club_id", "id"], "left")
    gone = F.coalesce("sure", F.lit(False)) & F.col("present").isNull()
    return rows.withColumn("current_club_id", F.when(~gone, F.col("current_club_id"))).select(players.columns)


def match_club_listing(clubs: DataFrame, listing: DataFrame, taken: DataFrame) -> DataFrame:
    """club_id, team_id (null: rejected) for each of ``clubs`` (id, name) from ``listing`` (team_id, team).

    Taken ids and youth sides are out. The only team of the same key wins; without one of that key the only team whose
    words contain the club's or the other way round. A team that several clubs claim goes to the lowest club.
    """
    free = listing.join(taken.select("team_id").distinct(), "team_id", "left_anti").where(~is_youth_team("team"))
    c = clubs.select(F.col("id").alias("club_id"), club_key("name").alias("key"), club_tokens("name").alias("tokens"))
    t = free.select("team_id", club_key("team").alias("key"), club_tokens("team").alias("tokens"))
    exact = c.join(t.select("key", "team_id"), "key").groupBy("club_id").agg(F.min("team_id").alias("exact_id"), F.count_distinct("team_id").alias("n_exact"))
    words = lambda df, key: df.select(key, F.explode("tokens").alias("token"))
    frequency = words(c, "club_id").select("token").union(words(t, "team_id").select("token")).groupBy("token").agg(F.count("*").alias("n"))
    rare = lambda df, key: words(df, key).join(frequency, "token").groupBy(key).agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    pairs = rare(c, "club_id").join(words(t, "team_id"), "token").select("club_id", "team_id").union(words(c, "club_id").join(rare(t, "team_id"), "token").select("club_id", "team_id")).distinct()
    near = pairs.join(c.select("club_id", F.col("tokens").alias("a")), "club_id").join(t.select("team_id", F.col("tokens").alias("b")), "team_id").where(same_tokens(F.col("a"), F.col("b")))
    near = near.groupBy("club_id").agg(F.min("team_id").alias("near_id"), F.count("*").alias("n_near"))
    rows = clubs.select(F.col("id").alias("club_id")).join(exact, "club_id", "left").join(near, "club_id", "left")
    pick = F.when(F.col("n_exact") == 1, F.col("exact_id")).when(F.col("n_exact").isNull() & (F.col("n_near") == 1), F.col("near_id"))
    rows = rows.select("club_id", pick.alias("team_id"))
    owner = rows.where("team_id is not null").groupBy("team_id").agg(F.min("club_id").alias("club_id"))
    return rows.select("club_id").join(owner, "club_id", "left")


def extract_moves(flat: DataFrame) -> DataFrame:
    """Moves of a flattened feed: api_id, name, date, type, from_team, to_team, from_name, to_name.

    Renewals, retirements, moves within a club and rows without a day, name or end go; an end named after the player
    is no club. Of a player's repeats between two ends the earliest counts.
    """
    rows = flat.withColumn("day", as_date("date")).where("name != '' and day is not null and (out_team is not null or in_team is not null)")
    rows = rows.where(~F.lower(F.coalesce("type", F.lit(""))).isin(*NON_MOVES))
    for side in ("out", "in"):
        own = F.coalesce(F.col(f"{side}_name") != "", F.lit(False)) & same_person("name", f"{side}_name")
        rows = rows.withColumns({f"{side}_team": F.when(~own, F.col(f"{side}_team")), f"{side}_name": F.when(~own, F.nullif(F.col(f"{side}_name"), F.lit("")))})
    rows = rows.where("coalesce(cast(out_team as string), cast(in_team as string), out_name, in_name) is not null and (out_team is null or in_team is null or out_team != in_team)")
    end = lambda side: F.coalesce(F.col(f"{side}_team").cast("string"), F.col(f"{side}_name"), F.lit(""))
    keys = [F.coalesce(F.col("api_id").cast("string"), F.col("name")).alias("who"), end("out").alias("a"), end("in").alias("b")]
    row = F.struct("api_id", "name", F.col("day").alias("date"), F.nullif("type", F.lit("")).alias("type"), F.col("out_team").alias("from_team"), F.col("in_team").alias("to_team"), F.col("out_name").alias("from_name"), F.col("in_name").alias("to_name"))
    return rows.groupBy(*keys).agg(F.min_by(row, F.struct("day", "type", "out_name", "in_name")).alias("m")).select("m.*")


def resolve_move_players(moves: DataFrame, players: DataFrame) -> DataFrame:
    """``moves`` with player_id: by live id, else the only ``same_person`` of that surname; null where there are several."""
    by_id = players.where("api_football_id is not null").groupBy(F.col("api_football_id").alias("api_id")).agg(F.min("id").alias("live_id"))
    rows = moves.withColumn("row", row_key(*moves.columns)).join(by_id, "api_id", "left")
    last = lambda c: F.element_at(F.split(normalize_name(c), " "), -1)
    named = rows.where("live_id is null").select(F.col("row").alias("id"), F.col("name").alias("full_name")).distinct().withColumn("surname", last("full_name"))
    found = person_matches(named, players.select("id", "full_name", last("full_name").alias("surname")), "surname")
    rows = rows.join(found.where("low_same = high_same").select(F.col("id").alias("row"), F.col("low_same").alias("name_id")), "row", "left")
    return rows.withColumn("player_id", F.coalesce("live_id", "name_id")).select(*moves.columns, "player_id")


def merge_moves(stored: DataFrame, moves: DataFrame, clubs: DataFrame, days: int = SAME_MOVE_DAYS, source: str = "api-football") -> DataFrame:
    """``stored`` moves with live ones merged in, and a ``change`` column: kept, merged or new.

    ``stored``: id, player_id, from_club_id, to_club_id, transfer_date, fee_eur, season, transfer_type, sources (array),
    from_club_name, to_club_name, date_is_exact. ``moves``: player_id, from_club_id, to_club_id, date, type, from_name,
    to_name; rows without a player or without both clubs are left out. A live move is a stored one when it is the only
    stored move of the player within ``days`` whose ends are compatible, at least one of them surely (by id, else by
    key). All moves meet the same snapshot; of several that hit one row the earliest merges and the others are repeats.
    """
    live = moves.where("player_id is not null and (from_club_id is not null or to_club_id is not null)")
    ends = ["player_id", "from_club_id", "to_club_id", "date", "type", "from_name", "to_name"]
    live = live.withColumn("move", row_key(*ends)).dropDuplicates(["move"])
    names = clubs.select(F.col("id").alias("_club"), club_key("name").alias("_key"))
    old = stored.where("transfer_date is not null")
    for side in ("from", "to"):
        old = old.join(names.withColumnsRenamed({"_club": f"{side}_club_id", "_key": f"{side}_known"}), f"{side}_club_id", "left")
    old = old.select("player_id", "id", "transfer_date", *[c for s in ("from", "to") for c in (F.col(f"{s}_club_id").alias(f"old_{s}"), F.coalesce(f"{s}_known", club_key(F.coalesce(f"{s}_club_name", F.lit("")))).alias(f"old_{s}_key"))])
    pairs = live.join(old, "player_id").where(F.abs(F.datediff("date", "transfer_date")) <= days)

    def fits(side: str) -> tuple[Column, Column]:
        ids = F.col(f"{side}_club_id").isNotNull() & F.col(f"old_{side}").isNotNull()
        key, old_key = club_key(F.coalesce(f"{side}_name", F.lit(""))), F.col(f"old_{side}_key")
        keys = (key != "") & (old_key != "")
        same = F.when(ids, F.col(f"{side}_club_id") == F.col(f"old_{side}")).otherwise(key == old_key)
        return ~(ids | keys) | same, (ids | keys) & same

    (from_ok, from_sure), (to_ok, to_sure) = fits("from"), fits("to")
    hits = only(pairs.where(from_ok & to_ok & (from_sure | to_sure)), ["move"], "id", "id")
    matched = live.join(hits, "move")
    best = matched.groupBy("id").agg(F.min_by(F.struct("date", "type", "from_club_id", "to_club_id", "from_name", "to_name"), F.struct("date", "move")).alias("m"))
    rows = stored.join(best, "id", "left")
    hit = F.col("m").isNotNull()
    away = lambda side: F.when(F.col(f"m.{side}_club_id").isNull(), F.col(f"m.{side}_name"))
    merged = {
        "transfer_date": F.coalesce("m.date", "transfer_date"),
        "date_is_exact": F.when(hit, True).otherwise(F.col("date_is_exact")),
        "season": F.coalesce(season_of_date(F.col("m.date")), "season"),
        "transfer_type": F.coalesce("m.type", "transfer_type"),
        "from_club_id": F.coalesce("from_club_id", "m.from_club_id"),
        "to_club_id": F.coalesce("to_club_id", "m.to_club_id"),
        "from_club_name": F.coalesce("from_club_name", away("from")),
        "to_club_name": F.coalesce("to_club_name", away("to")),
        "sources": F.when(hit, F.array_sort(F.array_union(F.coalesce("sources", F.array().cast("array<string>")), F.array(F.lit(source))))).otherwise(F.col("sources")),
    }
    rows = rows.withColumns({**{c: merged[c] for c in merged}, "change": F.when(hit, "merged").otherwise("kept")}).drop("m")
    fresh = live.join(hits.select("move"), "move", "left_anti").select(
        new_id(*ends).alias("id"), "player_id", "from_club_id", "to_club_id", F.col("date").alias("transfer_date"), F.lit(None).cast("double").alias("fee_eur"), season_of_date("date").alias("season"), F.col("type").alias("transfer_type"),
        F.array(F.lit(source)).alias("sources"), F.when(F.col("from_club_id").isNull(), F.col("from_name")).alias("from_club_name"), F.when(F.col("to_club_id").isNull(), F.col("to_name")).alias("to_club_name"), F.lit(True).alias("date_is_exact"), F.lit("new").alias("change"),
    )
    return rows.select(fresh.columns).unionByName(fresh)


def merge_duplicates_live(players: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(players after merging, thin_id, keeper_id, verdict). Thin records have a live id and no snapshot id.

    A thin record's only ``same_person`` among snapshot records inherits its live id and club, and photo and position
    where it has none; of several the only one of the same position group. A record that several thin ones name takes
    the lowest of them; the others are ambiguous, as are thin records with several candidates.
    """
    thin = players.where("transfermarkt_id is null and api_football_id is not null")
    rich = players.where("transfermarkt_id is not null")
    side = lambda df: df.select("id", "full_name", position_group("position").alias("own_group"))
    found = person_matches(side(thin), side(rich), "own_group").withColumnRenamed("id", "thin_id")
    keeper = F.when(F.col("n") == 1, F.col("low")).when(F.col("n_same") == 1, F.col("low_same"))
    found = found.select("thin_id", keeper.alias("keeper_id"))
    first = found.where("keeper_id is not null").groupBy("keeper_id").agg(F.min("thin_id").alias("thin_id"))
    verdicts = found.select("thin_id").join(first, "thin_id", "left").select("thin_id", "keeper_id", F.when(F.col("keeper_id").isNotNull(), "merged").otherwise("ambiguous").alias("verdict"))
    gone = verdicts.where("keeper_id is not null")
    gift = gone.join(thin.select(F.col("id").alias("thin_id"), F.col("api_football_id").alias("t_api"), F.col("current_club_id").alias("t_club"), F.col("image_url").alias("t_image"), F.col("position").alias("t_position")), "thin_id").select(F.col("keeper_id").alias("id"), "t_api", "t_club", "t_image", "t_position")
    out = players.join(gone.select(F.col("thin_id").alias("id")), "id", "left_anti").join(gift, "id", "left")
    has = F.col("t_api").isNotNull()
    out = out.withColumns({"api_football_id": F.coalesce("t_api", "api_football_id"), "current_club_id": F.when(has, F.col("t_club")).otherwise(F.col("current_club_id")), "image_url": F.coalesce("image_url", "t_image"), "position": F.coalesce("position", "t_position")})
    return out.select(players.columns), verdicts


def merge_duplicates_thin(players: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(players, season rows) after merging records of one name and birth year that have no ids and no full date.

    The lowest id keeps, and takes position and club from the next where it has none; season rows move to it, less
    those of a season and club that it, or a lower id, has.
    """
    thin = players.where("transfermarkt_id is null and api_football_id is null and birth_date is null and birth_year is not null").withColumn("key", normalize_name("full_name"))
    by_id = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("id", c)))), lambda s: s[c])
    groups = thin.groupBy("key", "birth_year").agg(F.min("id").alias("keeper"), F.count("*").alias("n"), F.get(by_id("position"), F.lit(0)).alias("g_position"), F.get(by_id("current_club_id"), F.lit(0)).alias("g_club")).where("n > 1")
    mapping = thin.select("id", "key", "birth_year").join(groups, ["key", "birth_year"]).select("id", "keeper", "g_position", "g_club")
    kept = players.join(mapping.where("id != keeper").select("id"), "id", "left_anti").join(mapping.where("id = keeper").drop("keeper"), "id", "left")
    kept = kept.withColumns({"position": F.coalesce("position", "g_position"), "current_club_id": F.coalesce("current_club_id", "g_club")}).select(players.columns)
    rows = stats.join(mapping.select(F.col("id").alias("player_id"), "keeper"), "player_id", "left")
    owner = F.coalesce("keeper", "player_id")
    moved = rows.where("keeper is not null")
    first = moved.groupBy("keeper", "season", "club_id").agg(F.min("player_id").alias("first"))
    moved = moved.alias("m").join(first.alias("f"), F.expr("m.keeper = f.keeper and m.season <=> f.season and m.club_id <=> f.club_id and m.player_id = f.first"), "left_semi")
    same = lambda df: df.withColumn("player_id", owner).select(stats.columns)
    return kept, same(rows.where("keeper is null")).unionByName(same(moved))


def backfill_nationality(players: DataFrame, stats: DataFrame, code_map: DataFrame, countries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(players, outcome and n): players without a nationality take the one that all their season rows name.

    ``code_map``: fifa_code, iso_code. Outcomes: filled, conflict (several names), unmapped (no known country).
    """
    missing = players.where("nationality_code is null").select(F.col("id").alias("player_id"))
    nation = F.upper(F.trim("nation"))
    named = stats.where("trim(nation) != ''").join(missing, "player_id", "left_semi").groupBy("player_id").agg(F.min(nation).alias("fifa"), F.max(nation).alias("last"))
    usable = code_map.select(F.upper(F.trim("fifa_code")).alias("fifa"), F.upper(F.trim("iso_code")).alias("iso")).where("fifa != '' and iso != ''")
    usable = usable.join(countries.select(F.col("code").alias("iso")), "iso", "left_semi").groupBy("fifa").agg(F.max("iso").alias("iso"))
    found = named.join(usable, "fifa", "left").withColumn("outcome", F.when(F.col("fifa") != F.col("last"), "conflict").when(F.col("iso").isNull(), "unmapped").otherwise("filled"))
    fill = found.where("outcome = 'filled'").select(F.col("player_id").alias("id"), "iso")
    out = players.join(fill, "id", "left").withColumn("nationality_code", F.coalesce("nationality_code", "iso")).select(players.columns)
    return out, found.groupBy("outcome").agg(F.count("*").alias("n"))


def refresh_current_clubs(players: DataFrame, appearances: DataFrame, transfers: DataFrame, as_of: datetime.date, days: int = RECENT_DAYS) -> DataFrame:
    """id, current_club_id, resolved_club_id, changed ('moved', 'cleared' or null) for every player.

    A transfer on or after the last recent appearance decides, even to no club; else that appearance's club; else the
    profile's, while it is about the newest season; else nothing.
    """
    since = as_of - datetime.timedelta(days=days)
    seen = appearances.where(F.col("played_on").isNotNull() & F.col("club_id").isNotNull() & (F.col("played_on") >= F.lit(since)))
    seen = latest_rows(seen.select("player_id", "played_on", "match_id", "club_id"), ["player_id"], ["played_on", "match_id"]).select(F.col("player_id").alias("id"), "played_on", F.col("club_id").alias("seen_club"))
    moved = transfers.where(F.col("transfer_date").between(F.lit(since), F.lit(as_of)))
    moved = latest_rows(moved.select("player_id", "transfer_date", "id", "to_club_id"), ["player_id"], ["transfer_date", "id"]).select(F.col("player_id").alias("id"), "transfer_date", F.col("to_club_id").alias("to_club"))
    newest = players.agg(F.max("last_season").alias("newest"))
    rows = players.select("id", "current_club_id", "last_season").join(seen, "id", "left").join(moved, "id", "left").crossJoin(F.broadcast(newest))
    club = (
        F.when(F.col("transfer_date").isNotNull() & (F.col("played_on").isNull() | (F.col("transfer_date") >= F.col("played_on"))), F.col("to_club"))
        .when(F.col("seen_club").isNotNull(), F.col("seen_club"))
        .when(F.col("last_season") == F.col("newest"), F.col("current_club_id"))
    )
    rows = rows.select("id", "current_club_id", club.alias("resolved_club_id"))
    changed = F.when(~F.col("current_club_id").eqNullSafe(F.col("resolved_club_id")), F.when(F.col("resolved_club_id").isNull(), "cleared").otherwise("moved"))
    return rows.withColumn("changed", changed)
