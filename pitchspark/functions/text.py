"""Tolerant casts, name keys and name predicates. All are built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CLUB_NOISE, GENERIC_WORDS, LEGAL_FORMS, YOUTH_MARKS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _latin() -> dict[str, str]:
    """Latin letters with marks and the plain letter each is written with."""
    plain = {"đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ð": "d", "Ð": "D"}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha() and len(unicodedata.normalize("NFC", chr(code))) == 1:
            plain[chr(code)] = base
    return plain


LATIN = _latin()
FOLD_FROM, FOLD_TO = "".join(LATIN), "".join(LATIN.values())
LIGATURES = (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "Th"))


def _null_like(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(F.lower(t).isin("", "nan", "na", "none"), None).otherwise(t)


def as_number(c: Column | str) -> Column:
    """Double of a number or its text; null-like or other text is null."""
    n = _null_like(col(c)).try_cast("double")
    return F.when(~F.isnan(n), n)


def as_int(c: Column | str) -> Column:
    """Whole part of a number or its text: '12.0' is 12."""
    return as_number(c).try_cast("bigint")


def as_date(c: Column | str) -> Column:
    """Date of the first ten characters; anything else is null."""
    return F.try_to_date(F.substring(F.trim(col(c).cast("string")), 1, 10), "yyyy-MM-dd")


def as_text(c: Column | str, n: int) -> Column:
    """Trimmed text of at most ``n`` characters; empty text and 'nan' are null."""
    t = F.trim(col(c).cast("string"))
    return F.when(F.lower(t).isin("", "nan"), None).otherwise(F.substring(t, 1, n))


def plain(c: Column | str) -> Column:
    c = F.translate(col(c), FOLD_FROM, FOLD_TO)
    for a, b in LIGATURES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def fold(c: Column | str) -> Column:
    """Unaccented lower case, as the search compares."""
    return F.lower(plain(c))


def normalize_name(c: Column | str) -> Column:
    """Unaccented lower-case words joined by single blanks. Scripts other than Latin are dropped."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def club_key(c: Column | str) -> Column:
    """Normalised name without legal forms; the whole name where nothing else is left."""
    name = normalize_name(c)
    left = F.array_join(F.filter(_words(name), lambda x: ~x.isin(*LEGAL_FORMS)), " ")
    return F.when(left != "", left).otherwise(name)


def is_youth_team(c: Column | str) -> Column:
    return F.exists(_words(club_key(c)), lambda x: x.isin(*YOUTH_MARKS))


def club_tokens(c: Column | str) -> Column:
    """Distinct words of two letters or more that name a club; its noise words where there are no others."""
    words = F.array_distinct(F.filter(_words(club_key(c)), lambda x: F.length(x) > 1))
    named = F.filter(words, lambda x: ~x.isin(*CLUB_NOISE))
    return F.when(F.size(named) > 0, named).otherwise(words)


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def same_tokens(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & (subset(a, b) | subset(b, a))


def same_club(a: Column | str, b: Column | str) -> Column:
    """Whether two names could denote one club: the words of one contain those of the other. It decides nothing alone."""
    return F.coalesce(same_tokens(club_tokens(a), club_tokens(b)), F.lit(False))


def name_words(c: Column | str) -> Column:
    return F.array_distinct(_words(normalize_name(c)))


def same_words(a: Column, b: Column) -> Column:
    """``same_person`` of word arrays."""
    real = lambda w: F.filter(w, lambda x: F.length(x) > 1)
    fits = lambda initials, words: F.forall(F.filter(initials, lambda x: F.length(x) == 1), lambda i: F.exists(words, lambda w: w.startswith(i)))
    ra, rb = real(a), real(b)
    return F.coalesce((F.size(ra) > 0) & (F.size(rb) > 0) & (subset(ra, rb) | subset(rb, ra)) & fits(a, rb) & fits(b, ra), F.lit(False))


def same_person(a: Column | str, b: Column | str) -> Column:
    """Whether two spellings plausibly name one person: order is free, initials must fit a word of the other side."""
    return same_words(name_words(a), name_words(b))


def surname_key(c: Column | str) -> Column:
    """'initial surname' of a name; null for an empty one."""
    words = _words(normalize_name(c))
    return F.when(F.size(words) > 0, F.concat(F.substring(F.get(words, F.lit(0)), 1, 1), F.lit(" "), F.element_at(words, -1)))


def search_terms(c: Column | str) -> Column:
    """The one or two longest distinctive words of four letters or more; else the whole name, cut to 30."""
    name = normalize_name(c)
    words = F.filter(_words(name), lambda x: F.length(x) >= 4)
    named = F.filter(words, lambda x: ~x.isin(*GENERIC_WORDS))
    pool = F.when(F.size(named) > 0, named).otherwise(words)
    ranked = F.sort_array(F.transform(pool, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    terms = F.slice(F.transform(ranked, lambda s: s["x"]), 1, 2)
    whole = F.when(name != "", F.array(F.substring(name, 1, 30))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(terms) > 0, terms).otherwise(whole)


def row_key(*columns: Column | str) -> Column:
    """128-bit hash of a row that tells a null from every value, and the same values in other columns apart."""
    parts = [x for c in columns for x in (F.isnull(c), F.col(c) if isinstance(c, str) else c)]
    return F.concat_ws("-", F.hex(F.xxhash64(*parts)), F.hex(F.xxhash64(F.lit(1), *parts)))
