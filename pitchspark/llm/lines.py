"""Line dedup (3): lines spread over many sites, by HyperLogLog sketches a line hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ROW, keyed, on_row, quoted, row_key, small, stored

#: A line of at least so many words on at least so many distinct sites is boilerplate.
MIN_SITES, MIN_WORDS = 8, 1
#: log2 of a sketch's registers; estimates within so many standard errors of the threshold are counted exactly.
LOG_K, BAND = 10, 4
_SPACE = r"\x20\x09-\x0D"


def hashed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The row's key, site, lines: of each row its 128-bit line hashes (h, g) in order, null under ``min_words`` words."""
    # anchored and possessive: linear in the longest of lines
    worded = f"^[{_SPACE}]*+" + f"[^{_SPACE}]++[{_SPACE}]++" * (min_words - 1) + f"[^{_SPACE}]"
    hashed = lambda x: F.when(x.rlike(worded), F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g")))
    lines = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), hashed)
    return docs.select(*row_key(), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), lines.alias("lines"))


def boilerplate_lines(hashed: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h, g, first (row's key, at): lines on ``min_sites`` distinct sites, and where each first occurs."""
    lines = hashed.select(*ROW, "site", F.posexplode("lines").alias("at", "x")).where("x is not null").select(*ROW, "site", "at", "x.h", "x.g")
    spread = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"), F.min(F.struct(*ROW, "at")).alias("first"), F.count("*").alias("n"))
    error = BAND * 1.04 / (1 << LOG_K) ** 0.5
    seen = spread.where(F.col("n") >= min_sites).select("h", "g", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    seen = stored(seen.where(F.col("sites") >= min_sites * (1 - error) - 1), "spread")
    sure = F.col("sites") > min_sites * (1 + error) + 1
    near = seen.where(~sure)
    exact = lines.join(small(near.select("h", "g")), ["h", "g"], "left_semi").select("h", "g", "site").distinct().groupBy("h", "g").agg(F.count("*").alias("exact"))
    return seen.where(sure).select("h", "g", "first").union(near.join(exact.where(F.col("exact") >= min_sites), ["h", "g"], "left_semi").select("h", "g", "first"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows and columns of ``docs``, with text (and n_chars, where there is one) less boilerplate; n_lines, n_removed added.

    A site is a value of ``source``. Of a line on many sites its first occurrence (smallest doc_id, nulls
    first, then hash of the text, then place) stays, so nothing is lost; the others go. Lines are compared exactly, by
    128-bit hashes; lines of fewer than ``min_words`` words stay, so blank ones do. Texts are split and hashed once;
    only hashes and the places of removed lines travel, never the lines.

    A null text stays null, with one line; an empty one stays. A document that loses all its lines keeps its
    row, with an empty text. A very long text is split within its row. Null sources are one site. Rows that share a
    doc_id, or have none, keep their own lines; rows that repeat id and text are alike, and all of them hold a first
    occurrence or none does. Existing columns n_lines and n_removed are replaced. An empty table gives an empty result.
    """
    hashed = stored(hashed_lines(docs, min_words), "lines")
    common = stored(boilerplate_lines(hashed, min_sites), "boilerplate")
    at = hashed.select(*ROW, F.posexplode("lines").alias("at", "x")).where("x is not null").select(*ROW, "at", "x.h", "x.g")
    gone = at.join(small(common), ["h", "g"]).where(~F.struct(*ROW, "at").eqNullSafe(F.col("first")))
    gone = stored(gone.groupBy(*ROW).agg(F.collect_set("at").alias("_gone")), "places")
    if gone.agg(F.coalesce(F.sum(F.size("_gone") + 5), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    old = F.col("_row.text")
    lines = F.split(old, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone")
    left = F.element_at(F.transform(F.array(lines), lambda own: F.transform(places, lambda i: F.get(own, i))), 1)
    out = on_row(keyed(docs), gone, "left")
    n_lines = F.coalesce(F.size(lines), F.lit(1)).cast("long")
    n_removed = F.when(old.isNull() | F.col("_gone").isNull(), 0).otherwise(F.size(lines) - F.size(places)).cast("long")
    text = F.when(F.col("_gone").isNotNull(), F.array_join(left, "\n")).otherwise(old)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("_gone").isNotNull(), F.length("text")).otherwise(F.col("_row.n_chars"))
        changed["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType)
    extra = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = out.select("_row", "_gone", text.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))
    return out.select(*[changed.get(c, F.col(f"_row.{quoted(c)}")).alias(c) for c in extra], "n_lines", "n_removed")


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """Rows and columns of ``docs``, texts less the lines that spread over many sites. Odd rows: as in ``line_dedup``."""
    return line_dedup(docs).select(*map(quoted, docs.columns))
