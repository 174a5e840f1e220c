"""Seasons, ages and window dates."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BUCKET_DAYS
from .text import col


def _span(year: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


def season_label(c: Column | str) -> Column:
    """'2526' is '2025-26' (consecutive halves); '2026' is one calendar year and stays."""
    c = col(c).cast("string")
    start, end = F.substring(c, 1, 2), F.substring(c, 3, 2)
    spans = c.rlike(r"^\d{4}$") & ((start.try_cast("int") + 1) % 100 == end.try_cast("int"))
    return F.when(spans, F.concat(F.lit("20"), start, F.lit("-"), end)).otherwise(c)


def season_from_start_year(c: Column | str) -> Column:
    """'2025' is '2025-26'; anything but four digits is null."""
    c = F.trim(col(c).cast("string"))
    return F.when(c.rlike(r"^\d{4}$"), _span(c.try_cast("int")))


def season_of_date(c: Column | str) -> Column:
    """The season a date falls in; July starts one."""
    c = col(c)
    return _span(F.year(c) - F.when(F.month(c) >= 7, 0).otherwise(1))


def normalise_season(c: Column | str) -> Column:
    """'26/27' is '2026-27'; other spellings stay."""
    return F.regexp_replace(col(c), r"^(\d{2})/(.*)$", "20$1-$2")


def age_at(birth_date: Column | str, birth_year: Column | str, as_of: datetime.date) -> Column:
    """Whole years at ``as_of``, or the difference of years where only that is known."""
    d, today = col(birth_date), F.lit(as_of)
    early = (F.month(today) < F.month(d)) | ((F.month(today) == F.month(d)) & (F.dayofmonth(today) < F.dayofmonth(d)))
    return F.when(d.isNotNull(), F.year(today) - F.year(d) - F.when(early, 1).otherwise(0)).otherwise(F.year(today) - col(birth_year))


def birth_bounds(age_min: int | None, age_max: int | None, as_of: datetime.date) -> tuple[Column | None, Column | None]:
    """(born on or before, born after) of an age range; 29 February counts as the 28th in other years."""
    before = F.add_months(F.lit(as_of), -12 * age_min) if age_min is not None else None
    after = F.add_months(F.lit(as_of), -12 * (age_max + 1)) if age_max is not None else None
    return before, after


def date_is_exact(c: Column | str) -> Column:
    """False for null and for the days that stand for a whole window."""
    c = col(c)
    return c.isNotNull() & ~F.coalesce(F.date_format(c, "MM-dd"), F.lit("")).isin(*BUCKET_DAYS)
