"""Quality rules (5): thresholds from mergeable quantile sketches per language and source. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, keyed, on_row, row_key, small, stored
from .spans import let as _let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A sketch bin is a leading bit and so many bits after it: relative error under 1/16.
BIN_BITS = 4
#: A group's quartiles are averaged with its language's, and a language's with those of all, as if these were so many documents.
PRIOR = 200
#: Tukey fences: quartile + SPREAD * interquartile range + slack (in thousandths a word or line); lower fences likewise.
SPREAD = 3
UPPER_SLACK = {"symbols": 150, "dup_lines": 400, "word_length": 1500}
LOWER_SLACK = {"word_length": 1500}


def _repeat_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more (windows compared by 64-bit hashes)."""
    n = F.size(words) - (WINDOW - 1)

    def covered(windows: Column) -> Column:
        def places(ordered: Column) -> Column:
            same = lambda i, j: F.get(ordered, i)["h"] == F.get(ordered, j)["h"]
            twice = F.filter(ordered, lambda x, i: F.coalesce(same(i, i + 1), F.lit(False)) | F.coalesce((i > 0) & same(i, F.greatest(i - 1, F.lit(0))), F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["p"]))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

        marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(marked, lambda o: _let(places(o), total))).otherwise(0)

    def hashed(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))

    return F.when(n >= 2, _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(hashed(h), covered))).otherwise(0)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the row's key, and the base measures of ``docs``, from the whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    bare = lambda chars: F.length(F.translate(text, chars, ""))
    return docs.select(
        "doc_id",
        "lang",
        "source",
        *row_key(),
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r"))).alias("w"),
        bare(" \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length(text) - bare(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
    ).select(
        "doc_id", "lang", "source", *ROW, F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("l.n").cast("long").alias("n_lines")
    )


def _bin(v: Column) -> Column:
    """The lower end of the sketch bin of a whole number >= 0: exact under 2 ** BIN_BITS, then BIN_BITS leading bits."""
    shift = F.greatest(F.length(F.bin(v)) - (BIN_BITS + 1), F.lit(0))
    return (v / F.pow(F.lit(2.0), shift)).cast("long") * F.pow(F.lit(2.0), shift).cast("long")


def sketches(passed: DataFrame) -> DataFrame:
    """lang, source, feature, bin, n: a histogram sketch a group; sketches merge by adding n. Feature '' counts documents."""
    values = F.transform(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in UPPER_SLACK]), lambda x: x)
    rows = passed.select("lang", "source", F.explode(values).alias("x")).select("lang", "source", F.col("x.feature").alias("feature"), _bin(F.col("x.v")).alias("bin"))
    return rows.groupBy("lang", "source", "feature", "bin").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, by: list[str], name: str) -> DataFrame:
    """by, feature, name (n, q1, q3) of each group. A sketch has some hundred bins."""

    merged = sketch.groupBy(*by, "feature", "bin").agg(F.sum("n").alias("n"))
    run = merged.withColumn("upto", F.sum("n").over(Window.partitionBy(*by, "feature").orderBy("bin"))).withColumn("total", F.sum("n").over(Window.partitionBy(*by, "feature")))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bin")))
    return run.groupBy(*by, "feature").agg(F.struct(F.max("total").alias("n"), at(1).alias("q1"), at(3).alias("q3")).alias(name))


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source, fences: by feature the lowest and highest value of each group's kept documents.

    A group's quartiles are its own, averaged with those of its language, and these with those of all, by the number of
    documents and ``PRIOR``: the weight of the others falls smoothly as a group grows.
    """
    own = _quartiles(sketch, ["lang", "source"], "own").alias("o")
    of_lang = _quartiles(sketch, ["lang"], "of_lang").alias("l")
    every = F.broadcast(_quartiles(sketch, [], "of_all")).alias("a")  # a row a feature
    rows = own.join(of_lang, F.expr("o.lang <=> l.lang and o.feature = l.feature")).join(every, F.expr("o.feature = a.feature"))

    def near(q: str) -> str:
        wide = f"((of_lang.n * of_lang.{q} + {PRIOR} * of_all.{q}) div (of_lang.n + {PRIOR}))"
        return f"((own.n * own.{q} + {PRIOR} * {wide}) div (own.n + {PRIOR}))"

    rows = rows.select("o.lang", "o.source", "o.feature", F.expr(near("q1")).alias("q1"), F.expr(near("q3")).alias("q3"))
    spread = SPREAD * (F.col("q3") - F.col("q1"))
    slack = lambda by: F.element_at(F.create_map(*[F.lit(x) for kv in by.items() for x in kv]), F.col("feature"))
    upper = F.col("q3") + spread + slack(UPPER_SLACK)
    lower = F.col("q1") - spread - slack({f: 1 << 60 for f in UPPER_SLACK} | LOWER_SLACK)
    bounds = F.struct("feature", F.struct(lower.cast("long").alias("low"), upper.cast("long").alias("high")))
    return rows.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(bounds)).alias("fences"))


def judged(docs: DataFrame) -> DataFrame:
    """The measures of every row, with base_failed and kept."""
    per = lambda a, b: (F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1))).cast("long")
    m = measures(docs).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    m = m.withColumns({"symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "word_length": per("word_chars", "n_words")})
    m = stored(m, "measures")
    sketch = stored(sketches(m.where("not base_failed")), "sketches")
    inside = F.lit(True)
    for f in UPPER_SLACK:
        inside = inside & F.col(f).between(F.col("fences")[f]["low"], F.col("fences")[f]["high"])
    groups = small(stored(fences(sketch), "fences")).alias("g")
    out = m.alias("m").join(groups, F.expr("m.lang <=> g.lang and m.source <=> g.source and not m.base_failed"), "left")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return out.select("m.*", kept.alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row.

    Documents that pass the base rules feed one sketch a (language, source) and feature: symbols a word,
    repeated lines a line, characters a word, in thousandths. A document is kept when all its features lie
    within the ``fences`` of its group, read by one join.

    Null or empty texts have no words and fail. Null languages and sources are groups of their own, null ids documents
    like others. Very long texts are measured within their row. Repeated rows are judged each. An empty table gives an
    empty result. Other columns are ignored.
    """
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the rules keep; columns are unchanged. Each row stands for itself, with a null or repeated doc_id too."""
    bad = judged(docs).where("not kept").select(*ROW).distinct()
    return on_row(keyed(docs), small(stored(bad, "rejected")), "left_anti").select("_row.*")
