"""Positions, rates and shot zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MIN_MINUTES, POSITION_WORDS
from .text import col

# A pitch of 105 x 68 m: the box is 16.5 m deep and 40.3 m wide, the six-yard box 5.5 m and 18.3 m.
BOX_X, BOX_HALF = 1 - 16.5 / 105, 40.3 / 2 / 68
SIX_X, SIX_HALF = 1 - 5.5 / 105, 18.3 / 2 / 68


def rounded(c: Column, digits: int) -> Column:
    """Half up on the scaled double: cheap, and never -0.0."""
    scale = 10**digits
    return F.floor(c * F.lit(float(scale)) + F.lit(0.5)) / F.lit(float(scale))


def per_90(total: Column | str, minutes: Column | str, min_minutes: int = MIN_MINUTES) -> Column:
    minutes = col(minutes)
    return F.when(minutes >= min_minutes, rounded(col(total) * 90 / minutes, 3))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def groups_in(c: Column | str) -> Column:
    """Distinct position groups that a label mentions, in its order; empty where there are none.

    A whole label is looked up first, then each part between ',' and '/', first whole and then for a word
    inside it; a label without such a part counts by the first word inside it.
    """
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(g).alias("g")) for w, g in POSITION_WORDS])
    first = lambda test: F.get(F.filter(words, test), F.lit(0))["g"]
    same = lambda t: first(lambda x: x["w"] == t)
    inside = lambda t: first(lambda x: F.contains(t, x["w"]))

    def found(text: Column) -> Column:
        parts = F.transform(F.split(F.translate(text, "/", ","), ","), lambda p: F.trim(p))
        by_part = F.array_distinct(F.filter(F.transform(parts, lambda p: F.coalesce(same(p), inside(p))), lambda g: g.isNotNull()))
        whole = same(text)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(let(by_part, lambda b: F.when(F.size(b) > 0, b).otherwise(F.filter(F.array(inside(text)), lambda g: g.isNotNull()))))

    return let(F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit("")))), found)


def resolve_position_group(season: Column | str, career: Column | str) -> Column:
    """The season's label narrows the choice, the career's picks from it; either alone is the fallback."""
    pick = lambda g: F.when((F.size(g["s"]) == 0) | F.array_contains(g["s"], F.get(g["c"], F.lit(0))), F.get(g["c"], F.lit(0))).otherwise(F.get(g["s"], F.lit(0)))
    return let(F.struct(groups_in(season).alias("s"), groups_in(career).alias("c")), pick)


def position_group(*labels: Column | str) -> Column:
    """The first group that any of the labels mentions."""
    return F.coalesce(*[F.get(groups_in(x), F.lit(0)) for x in labels])


def zone_of(x: Column | str, y: Column | str) -> Column:
    x, y = col(x), col(y)
    near = lambda half: F.abs(y - 0.5) <= half
    return (
        F.when(x.isNull() | y.isNull(), "outside")
        .when((x >= SIX_X) & near(SIX_HALF), "six_yard")
        .when((x >= BOX_X) & near(BOX_HALF), "penalty_area")
        .when(x >= BOX_X, "wide")
        .otherwise("outside")
    )
