"""Best-fit packing (6): tokenised pieces, and bulk-synchronous best fit in rounds of Spark jobs over runs of equal pieces and gaps."""

from __future__ import annotations

import json
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import released
from .common import dropped, scratch_dir, slices, stored

END_ID, MAX_TOKENS = 2, 1024
#: Pieces of one length are ranked in so many parts at least, and in more from this many pieces a part on.
SALTS, PIECES_A_PART = 64, 1 << 20
#: Rounds after which the driver lets go of what finished rounds broadcast.
RELEASE = 4
#: Width of a range of sizes in a sweep; a gap takes several equal pieces a round up to this share of a sequence.
BLOCK, SHARE = 64, 8


def _bytes_of_chars() -> dict[str, int]:
    """Byte-level BPE writes byte b as a printable character: itself, or the next from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a byte-level BPE JSON file, run by tiktoken: ids equal, several times as fast."""
    import tiktoken

    spec = json.loads(open(path, encoding="utf-8").read())
    of = _bytes_of_chars()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, doc (a number of the row), piece, start, length, ids_crc32 (and ids): the first piece of a long text takes the remainder."""

    def run(batches):
        bpe = encoder(tokenizer)
        for batch in (s for b in batches for s in slices(b)):
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*bpe.encode(text or "", allowed_special="all"), end_id], "<u4")
                cuts = [0, *range(len(ids) % max_tokens or max_tokens, len(ids), max_tokens), len(ids)]
                for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(i)
                    piece.append(j)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        kept.append(ids[a:b])
            at = pa.array(row, pa.int64())
            columns = [batch.column("doc_id").take(at), batch.column("doc").take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "doc", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    numbered = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("doc"), "text")
    return numbered.mapInArrow(run, "doc_id long, doc long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _few(df: DataFrame) -> DataFrame:
    """Runs of pieces and gaps in one partition: a few for each size, whatever the input, so that a round need not shuffle them."""
    return df.coalesce(1)


def sweep(left: DataFrame, gaps: DataFrame, size: int) -> DataFrame:
    """length, first, n, k, gap, sequence, offset: one round of matches of pieces and gaps.

    ``left`` has runs of equal pieces (length, first rank, n) and what holds for the round (n_gaps, share), ``gaps`` runs
    of equal gaps (gap, first sequence, n). Both are sorted by size, the largest first and gaps before pieces, in ``BLOCK``-wide ranges of sizes. In that order a
    piece takes the nearest open gap before it, its successor; where several want one, the highest rank has it and the
    others move on to the next: gaps open and pieces close levels of a running sum, whose totals are carried from
    range to range, and a piece meets the gap that last opened its level. A gap takes one piece a round, or ``k`` equal
    ones that fill 1 / ``share`` of a sequence at most where they outnumber the gaps so far.
    """
    k = F.greatest(F.lit(1), F.least(F.floor(F.col("n") / F.col("n_gaps")), F.floor(size / F.col("share") / F.col("length"))))
    pieces = left.select((k * F.col("length")).alias("size"), F.lit(0).alias("up"), F.floor(F.col("n") / k).alias("w"), F.col("first").alias("ref"), "length", k.cast("long").alias("k"))
    opened = gaps.select(F.col("gap").alias("size"), F.lit(1).alias("up"), F.col("n").alias("w"), F.col("sequence").alias("ref"), F.lit(0).alias("length"), F.lit(1).alias("k"))
    events = _few(opened.unionByName(pieces)).withColumns({"block": F.floor(F.col("size") / BLOCK), "step": F.when(F.col("up") == 1, F.col("w")).otherwise(-F.col("w"))})
    order = [F.desc("size"), F.desc("up"), F.asc("ref")]
    carry = events.groupBy("block").agg(F.sum("step").alias("step"))
    upto = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select("block", F.coalesce(F.sum("step").over(upto), F.lit(0)).alias("carry"))
    inside = F.sum("step").over(Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    events = events.withColumn("inside", inside).join(carry.hint("merge"), "block").withColumn("at", F.col("carry") + F.col("inside"))
    events = events.withColumns({"low": F.least("at", F.col("at") - F.col("step")), "high": F.greatest("at", F.col("at") - F.col("step"))})
    # levels between two neighbouring bounds of runs behave alike: a cell
    bounds = events.agg(F.array_sort(F.array_union(F.collect_set("low"), F.collect_set("high"))).alias("bounds"))
    place = lambda c: F.array_position("bounds", F.col(c)) - 1
    cells = events.crossJoin(F.broadcast(bounds)).withColumn("cell", F.explode(F.sequence(place("low"), place("high") - 1)))
    cells = cells.withColumns({"level": F.get("bounds", F.col("cell").cast("int")), "wide": F.get("bounds", (F.col("cell") + 1).cast("int")) - F.get("bounds", F.col("cell").cast("int"))})
    cells = cells.select("cell", "level", "wide", "size", "up", "ref", "length", "k", "low", "high")
    before = F.lag(F.struct("up", "size", "ref", "low")).over(Window.partitionBy("cell").orderBy(*order))
    met = cells.withColumn("before", before).where("up = 0 and before.up = 1")
    met = met.groupBy("length", "ref", "k", F.col("before.size").alias("gap"), F.col("before.ref").alias("open")).agg(
        F.sum("wide").alias("w"),
        F.min(F.col("high") - F.col("level") - F.col("wide")).alias("skip"),
        F.min(F.col("before.ref") + F.col("level") - F.col("before.low")).alias("sequence"),
    )
    return met.select(
        F.col("length").cast("long"), (F.col("ref") + F.col("skip") * F.col("k")).alias("first"), (F.col("w") * F.col("k")).alias("n"), "k", F.col("gap").cast("long"), F.col("open").cast("long"), "sequence", (size - F.col("gap")).cast("long").alias("offset")
    )


def _after(left: DataFrame, gaps: DataFrame, placed: DataFrame) -> DataFrame:
    """kind, size, ref, n: the runs of pieces and of gaps after a round; pieces leave a run's head, gaps its tail."""
    used = placed.groupBy("length").agg(F.sum("n").alias("used"))
    rest = left.join(used.hint("merge"), "length", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    rest = rest.select(F.lit("piece").alias("kind"), F.col("length").alias("size"), (F.col("first") + F.col("used")).alias("ref"), (F.col("n") - F.col("used")).alias("n"))
    filled = placed.groupBy(F.col("open").alias("sequence")).agg(F.sum(F.col("n") / F.col("k")).cast("long").alias("used"))
    kept = gaps.join(filled.hint("merge"), "sequence", "left")
    kept = kept.select(F.lit("gap").alias("kind"), F.col("gap").alias("size"), F.col("sequence").alias("ref"), (F.col("n") - F.coalesce("used", F.lit(0))).alias("n"))
    fresh = placed.select(F.lit("gap").alias("kind"), (F.col("gap") - F.col("k") * F.col("length")).alias("size"), F.col("sequence").alias("ref"), (F.col("n") / F.col("k")).cast("long").alias("n"))
    return rest.union(kept).union(fresh).where("n > 0 and size > 0")


def best_fit(counts: DataFrame, size: int) -> DataFrame:
    """round, length, first, n, k, gap, open, sequence, offset: where runs of equal pieces go, from length, n.

    Rounds of ``sweep``: gaps shrink by what they took, and the rounds go on until no piece is left. Where no gap holds
    a piece, as many sequences open as the rest needs at least. The state, at most ``size`` runs of pieces and some
    runs of gaps for each, is a table that every round writes anew.
    """
    spark = counts.sparkSession
    plan = f"{scratch_dir(spark)}/plan-{uuid.uuid4().hex}"
    table = stored(_few(counts.select(F.lit("piece").alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("ref"), "n")), "state")
    opened, number, before, bundle = 0, 0, None, True
    while True:
        state = _few(table)
        sizes = state.groupBy("kind", "size").agg(F.sum("n").alias("n")).collect()  # at most a row a kind and size
        lengths = {r["size"]: r.n for r in sizes if r.kind == "piece"}
        if not lengths:
            break
        n, least = sum(lengths.values()), min(lengths)
        bundle, before = n != before, n
        n_gaps = sum(r.n for r in sizes if r.kind == "gap" and r["size"] >= least)
        fresh = 0 if n_gaps else -(-sum(x * m for x, m in lengths.items()) // size)
        # a table, not constants: the code that Spark generates is the same for all rounds
        facts = f"SELECT * FROM VALUES ({least}L, {n_gaps + fresh}L, {SHARE if bundle else size + 1}L) AS t(least, n_gaps, share)"
        facts = F.broadcast(spark.sql(facts))
        left = state.where("kind = 'piece'").select(F.col("size").alias("length"), F.col("ref").alias("first"), "n").crossJoin(facts)
        gaps = state.where("kind = 'gap'").crossJoin(facts).where("size >= least").select(F.col("size").alias("gap"), F.col("ref").alias("sequence"), "n")
        if fresh:
            gaps = _few(spark.sql(f"SELECT * FROM VALUES ({size}L, {opened}L, {fresh}L) AS t(gap, sequence, n)"))
            opened += fresh
        _few(sweep(left, gaps, size)).write.parquet(f"{plan}/round={number}")
        placed = _few(spark.read.schema(PLAN).parquet(f"{plan}/round={number}"))
        table, last = stored(_few(_after(left, gaps, placed)), "state"), table
        dropped(last)
        number += 1
        if number % RELEASE == 0:
            released(spark)
    dropped(table)
    return spark.read.schema(f"{PLAN}, round int").parquet(plan) if number else spark.createDataFrame([], f"{PLAN}, round int")


PLAN = "length long, first long, n long, k long, gap long, open long, sequence long, offset long"


def pack(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) for every piece of every row.

    Pieces of equal length are interchangeable, so they are ranked within their length, and the rounds of ``best_fit``
    move runs of ranks, which all pieces look up. Ranks come from counts of (length, salt): no length meets in one
    task. The table of runs has at most a few for each pair of lengths, whatever the input. Full pieces are sequences
    of their own, with negative numbers.

    A null or empty text is the end id alone; repeated rows and null ids are packed each; an empty table gives no rows.
    A very long text is cut into pieces of ``max_tokens``. Special tokens spelled in a text keep their ids. Other
    columns are ignored.
    """
    every = stored(pieces(docs, tokenizer, max_tokens, end_id, with_ids), "pieces")
    full = every.where(F.col("length") == max_tokens)
    parts = max(SALTS, every.count() // PIECES_A_PART)
    cut = every.where(F.col("length") < max_tokens).withColumn("salt", F.pmod(F.xxhash64("doc", "piece"), F.lit(parts)).cast("int"))
    per = stored(cut.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = best_fit(per.groupBy("length").agg(F.sum("n").alias("n")), max_tokens).drop("round", "gap", "open")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc", "piece")) - 1
    ranked = cut.withColumn("own", own).join(per.select("length", "salt", before.alias("before")), ["length", "salt"])
    placed = ranked.withColumn("rank", F.col("own") + F.col("before")).join(F.broadcast(plan), "length").where("rank >= first and rank < first + n")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    sequence = F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("k"))
    offset = F.col("offset") + (F.col("rank") - F.col("first")) % F.col("k") * F.col("length")
    placed = placed.select(*columns, sequence.alias("sequence_id"), offset.alias("offset"), *["ids"] * with_ids)
    alone = full.select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)
    return placed.unionByName(alone)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, input_ids, doc_ids, lengths from ``pack(..., with_ids=True)``; a sequence is bounded by max_tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return grouped.select("sequence_id", F.flatten(F.col("p.ids")).alias("input_ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
