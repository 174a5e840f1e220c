"""Benchmark decontamination (7): winnowed fingerprints, joined, then extended to every shared span."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, ROW, count_words, gram_hashes, keyed, on_row, row_key, slices, small, stored, word_hashes

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _winnow(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of windows with one minimum: its first window and that minimum."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = grams[:n].copy()
    for j in range(1, width):
        np.minimum(low, grams[j : j + n], out=low)
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    return first, low[first]


def _spans(df: DataFrame, window: int, k: int, shorter: list[int] | None) -> DataFrame:
    """The columns beside ``text``, len, start, print, spans: a row for each run of windows of ``window`` words with one fingerprint.

    ``spans`` holds the hashes of those windows in order. Texts of fewer words, and every length in
    ``shorter``, have a row a window whose fingerprint is its own hash. ``shorter`` None: items, which
    have one such row when they are short.
    """
    width = window - k + 1

    def run(batches):
        for batch in (s for b in batches for s in slices(b)):
            words, counts = word_hashes(batch.column("text").to_pylist(), ALNUM)
            ids, lens, starts, prints, spans = [], [], [], [], []
            ends = np.cumsum(counts)
            for row, (e, c) in enumerate(zip(ends, counts, strict=True)):
                w = words[e - c : e]
                first, low = _winnow(gram_hashes(w, k), width)
                if len(first):
                    whole = gram_hashes(w, window)
                    ids.append(np.full(len(first), row))
                    lens.append(np.full(len(first), window))
                    starts.append(first)
                    prints.append(low)
                    spans += np.split(whole, first[1:])
                for n in ([int(c)] if 0 < c < window else []) if shorter is None else shorter:
                    own = gram_hashes(w, n)
                    ids.append(np.full(len(own), row))
                    lens.append(np.full(len(own), n))
                    starts.append(np.arange(len(own)))
                    prints.append(own)
                    spans += list(own.reshape(-1, 1))
            join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
            offsets = np.cumsum([0] + [len(s) for s in spans]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(join(ids), pa.int64())) for c in keys),
                    pa.array(join(lens), pa.int32()),
                    pa.array(join(starts), pa.int64()),
                    pa.array(join(prints).view(np.int64), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(join(spans).view(np.int64), pa.int64())),
                ],
                [*keys, "len", "start", "print", "spans"],
            )

    keys = [c for c in df.columns if c != "text"]
    return df.mapInArrow(run, ", ".join(f"{c} long" for c in keys) + ", len int, start long, print long, spans array<long>")


def _word_counts(rows: DataFrame) -> DataFrame:
    """The row's key and n_words of every row."""

    def run(batches):
        for batch in (s for b in batches for s in slices(b)):
            n_words = pa.array(count_words(batch.column("text").to_pylist(), ALNUM))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ROW), n_words], [*ROW, "n_words"])

    return rows.mapInArrow(run, "_doc long, _text long, _more long, n_words long")


def contaminated_spans(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(row's key, start, len, span) of every occurrence of an item's window, and (item_id, len, span) of the items.

    Winnowing keeps the smallest hash of ``k`` words in each window of ``window`` words, so any shared span of
    ``window`` words shares a fingerprint. Items of fewer words are looked up whole.
    """
    bench = stored(_spans(items.select(F.col("item_id").cast("long").alias("id"), "text"), window, k, None), "benchmark")
    shorter = sorted(r.len for r in bench.where(F.col("len") < window).select("len").distinct().collect())
    # fingerprints are 12 bytes each: broadcast where their number allows, else the join shuffles
    prints = small(stored(bench.select("len", "print").distinct(), "prints"))
    rows = _spans(docs.select(*row_key(), "text"), window, k, shorter)
    near = rows.join(prints, ["len", "print"], "left_semi").select(*ROW, "len", "start", F.posexplode("spans").alias("at", "span"))
    known = bench.select(F.col("id").alias("item_id"), "len", F.explode("spans").alias("span")).distinct()
    known = stored(known, "windows")
    spans = small(stored(known.select("len", "span").distinct(), "spans"))
    hits = near.join(spans, ["len", "span"], "left_semi").select(*ROW, (F.col("start") + F.col("at")).alias("start"), "len", "span")
    return stored(hits, "hits"), known


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z. A word inside
    any occurrence of ``window`` consecutive words of an item, or of a whole shorter item, is hit.
    Null or empty texts have no words; items without words occur nowhere. Very long texts are read in parts of one row.
    Rows that share a doc_id, or have none, are judged each by its text; repeated rows get the same result each. An
    empty benchmark hits nothing; an empty table gives an empty result. Other columns are ignored.
    """
    hits, known = contaminated_spans(docs, items, window, k)
    ends = hits.select(*ROW, "start", (F.col("start") + F.col("len")).alias("end")).groupBy(*ROW, "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy(*ROW).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.col("start"))))
    covered = ends.withColumn("fresh", fresh).groupBy(*ROW).agg(F.sum("fresh").alias("n_hit"))
    found = hits.select(*ROW, "len", "span").distinct().join(known, ["len", "span"]).select(*ROW, "item_id").distinct()
    found = found.groupBy(*ROW).agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items"))
    out = on_row(on_row(_word_counts(docs.select(*row_key(), "text")), covered, "left"), found, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        F.col("_doc").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Rows of ``docs`` without those that hold a benchmark window; columns are unchanged. Odd rows: as in ``decontaminate``."""
    hits, _ = contaminated_spans(docs, items, window, k)
    return on_row(keyed(docs), small(stored(hits.select(*ROW).distinct(), "leaks")), "left_anti").select("_row.*")
