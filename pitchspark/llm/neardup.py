"""MinHash near-dedup (2): HyperMinHash registers, banding, collision-corrected estimates, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, ROW, dropped, keyed, mix, on_row, row_key, shingle_set, slices, small, stored, word_hashes

ROUNDS, BUCKETS, MANTISSA = 16, 16, 10
ROWS = 6
EMPTY = -1
_SEEDS = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
#: Chance that two different minima share leading zeros and mantissa.
COLLISION = 2.0 / 3.0 / (1 << MANTISSA)


def _registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set, one row a set: leading-zero count and mantissa bits of each bucket's minimum."""
    shingles = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.full((len(sets), BUCKETS, ROUNDS), EMPTY, np.int16)
    for t, seed in enumerate(_SEEDS):
        x = mix(shingles ^ seed)
        low = np.full(len(sets) * BUCKETS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(low, owner * BUCKETS + (x >> np.uint64(60)).astype(np.int64), x & np.uint64((1 << 60) - 1))
        part, power = np.frexp(low.astype(np.float64))
        zeros = 60 - np.minimum(power, 60)
        register = (zeros << MANTISSA) + ((part * 2 - 1) * (1 << MANTISSA)).clip(0, (1 << MANTISSA) - 1).astype(np.int32)
        register[low == np.iinfo(np.uint64).max] = 0xFFFF
        out[:, :, t] = register.astype(np.uint16).view(np.int16).reshape(len(sets), BUCKETS)
    return out.reshape(len(sets), BUCKETS * ROUNDS)


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    words, counts = word_hashes(texts, NOT_SPACE)
    ends = np.cumsum(counts)
    return [shingle_set(words[e - c : e], k) for e, c in zip(ends, counts, strict=True)]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """The row's key, n_shingles, set_key (equal for equal shingle sets, null for empty ones), sig (registers)."""
    import hashlib

    def run(batches):
        for batch in (s for b in batches for s in slices(b)):
            sets = _sets(batch.column("text").to_pylist(), k)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ROW),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.md5(s.tobytes()).hexdigest() if len(s) else None for s in sets], pa.string()),
                    _lists(list(_registers(sets)), pa.int16()),
                ],
                [*ROW, "n_shingles", "set_key", "sig"],
            )

    return docs.select(*row_key(), "text").mapInArrow(run, "_doc long, _text long, _more long, n_shingles long, set_key string, sig array<short>")


def _shingles(ids: DataFrame, reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """id, shingles of the texts that stand for the classes ``ids``; several rows where their row is repeated."""

    def run(batches):
        for batch in (s for b in batches for s in slices(b)):
            sets = _sets(batch.column("text").to_pylist(), k)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists([s.view(np.int64) for s in sets], pa.int64())], ["id", "shingles"])

    wanted = stored(reps.select("id", *ROW).join(small(ids), "id", "left_semi"), "wanted")
    return on_row(docs.select(*row_key(), "text"), small(wanted), "inner").select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for every end of ``edges`` (u, v); large-star and small-star rounds."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            out = stored(e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v")).groupBy("id").agg(F.min("component").alias("component")), "labels")
            dropped(e)
            return out
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        e, last = stored(star, "edges"), e
        dropped(last)


def _ends(pairs: DataFrame) -> DataFrame:
    return stored(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "ids")


def _linked(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets reach the similarity; the register estimate only spares hopeless ones."""
    side = lambda df, c, name: df.select(F.col("id").alias(c), F.col(name).alias(f"{name}_{c}"))
    pairs = stored(pairs, "pairs")
    ids = _ends(pairs)
    own = reps.select("id", "sig").join(small(ids), "id", "left_semi")
    near = pairs.join(side(own, "u", "sig"), "u").join(side(own, "v", "sig"), "v")
    same = F.aggregate(F.zip_with("sig_u", "sig_v", lambda a, b: F.when((a == b) & (a != EMPTY), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    used = F.aggregate(F.zip_with("sig_u", "sig_v", lambda a, b: F.when((a != EMPTY) | (b != EMPTY), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    near = near.select("u", "v", same.alias("same"), used.alias("used"))
    j = percent / 100
    estimate = (F.col("same") / F.greatest("used", F.lit(1)) - COLLISION) / (1 - COLLISION)
    near = stored(near.where(estimate >= j - 5 * F.sqrt(j * (1 - j) / F.greatest("used", F.lit(1)))).select("u", "v"), "near")
    likely = _ends(near)
    shingles = _shingles(likely, reps, docs, k)
    full = near.join(side(shingles, "u", "shingles"), "u").join(side(shingles, "v", "shingles"), "v")
    full = full.select("u", "v", F.size(F.array_intersect("shingles_u", "shingles_v")).cast("long").alias("common"), (F.size("shingles_u") + F.size("shingles_v")).cast("long").alias("total"))
    out = stored(full.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("u", "v"), "links")
    dropped(pairs, ids, near, likely)
    return out


def _prefix_pairs(open_ids: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of different components among ``open_ids`` (id, component) that can reach the similarity, by prefix filter.

    Shingles are ordered rarest first. Sets of that similarity share one of the first n - ceil(percent * n / 100) + 1 of
    each, so only those are met. What stands before the first shared one is in one set alone, which bounds what they can
    share: a text with many shingles of its own meets nobody. Of a shingle's holders those outside its largest
    component meet the rest. Exact: no pair of the similarity is missed.
    """
    sets = _shingles(stored(open_ids.select("id"), "ids"), reps, docs, k).dropDuplicates(["id"])
    sets = stored(sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("t")), "tokens")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "t"))
    ranked = sets.join(sets.groupBy("t").agg(F.count("*").alias("df")), "t").withColumn("rank", rank)
    first = ranked.where((F.col("df") > 1) & (F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).select("id", "n", "t", (F.col("n") - F.col("rank") + 1).alias("left"))
    posts = stored(first.join(open_ids, "id"), "posts")
    share = posts.groupBy("t", "component").agg(F.count("*").alias("c"))
    major = share.groupBy("t").agg(F.max_by("component", "c").alias("major"), F.count("*").alias("kinds")).where("kinds > 1").select("t", "major")
    held = posts.join(major, "t")
    minor = held.where("component != major").select("t", F.col("id").alias("x"), F.col("n").alias("xn"), F.col("left").alias("xleft"), F.col("component").alias("xc"))
    # common shingles of a pair of the similarity: at least percent * (n + xn) / (100 + percent)
    fits = F.least("left", "xleft") * (100 + percent) >= (F.col("n") + F.col("xn")) * percent
    pairs = held.join(minor, "t").where((F.col("component") != F.col("xc")) & fits).select(F.least("id", "x").alias("u"), F.greatest("id", "x").alias("v")).distinct()
    out = stored(pairs, "pairs")
    dropped(sets, posts)
    return out


def _judged(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The row's key, n_shingles, low (smallest doc_id of its component) and head (the key of the row that stays)."""
    sigs = stored(signatures(docs, k), "signatures")
    # equal sets have equal registers: a task sends one row a set, however many copies it has
    rep, sig = F.min(F.struct(*ROW)).alias("rep"), F.min_by("sig", F.struct(*ROW)).alias("sig")
    every = sigs.where("set_key is not null").groupBy("set_key").agg(rep, F.min("_doc").alias("low"), sig)
    every = stored(every.withColumn("id", F.monotonically_increasing_id()), "classes")
    classes, reps = every.select("set_key", "id", "rep", "low"), every.select("id", "rep.*", "sig")
    n_bands = BUCKETS * ROUNDS // ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.struct(i.alias("i"), F.slice("sig", i * ROWS + 1, F.lit(ROWS)).alias("r")))
    bands = F.transform(F.filter(bands, lambda b: F.array_max(b["r"]) != EMPTY), lambda b: F.xxhash64(b["i"], b["r"]))
    members = reps.select("id", F.explode(bands).alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(members.join(shared, "bucket"), "shared")
    # a bucket's head is its member with most company: of edited copies the one nearest to all
    company = shared.groupBy("id").agg(F.sum("n").alias("company"))
    heads = shared.join(company, "id").groupBy("bucket").agg(F.max_by("id", F.struct(F.col("company"), -F.col("id"))).alias("head"))
    members = stored(shared.join(heads, "bucket").select("bucket", "id", "head"), "members")
    dropped(shared)
    pairs = members.where("id != head").select(F.least("head", "id").alias("u"), F.greatest("head", "id").alias("v")).distinct()
    links = _linked(pairs, reps, docs, k, percent)
    labels = components(links)
    named = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    # the head was compared with all: a bucket is open where the others are in several components
    others = named.where("id != head")
    open_buckets = others.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("bucket")
    open_ids = stored(others.join(open_buckets, "bucket").select("id", "component").distinct(), "open")
    if not open_ids.isEmpty():
        more = _linked(_prefix_pairs(open_ids, reps, docs, k, percent), reps, docs, k, percent)
        last, labels = labels, components(links.union(more))
        dropped(last, more)
    dropped(members, links, open_ids)
    linked = classes.join(labels, "id").select("set_key", "component", "rep", "low")
    of_component = linked.groupBy("component").agg(F.min("low").alias("all_low"), F.min("rep").alias("head"))
    of_class = classes.join(linked.select("set_key", "component").join(of_component, "component"), "set_key", "left")
    of_class = of_class.select("set_key", F.coalesce("head", "rep").alias("head"), F.when(F.col("head").isNull(), F.col("low")).otherwise(F.col("all_low")).alias("low"))
    keys = stored(sigs.select(*ROW, "n_shingles", "set_key"), "keys")
    dropped(sigs)
    return keys.join(of_class, "set_key", "left").select(*ROW, "n_shingles", "low", "head")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Words are runs outside ASCII white space after lower-casing A-Z. Texts with equal sets are one class.
    Class representatives meet in bands of ``ROWS`` registers. In each bucket all are compared with its head, and
    links contract components. Texts that still share a bucket with another component are joined by an exact prefix
    filter. Pairs inside a component are never listed, so crowds of copies stay linear. Estimates prune at five
    standard deviations, full sets decide. A pair at exactly the similarity meets in no band with probability
    under 3e-6.

    Null or empty texts: n_shingles 0, own component, kept. Very long texts are hashed in parts, their sets whole.
    Rows that share a doc_id, or have none, are compared each by its text; a null doc_id is passed over where its
    component has others, and is kept where it has none. Repeated rows share a component. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = _judged(docs, k, percent).select(F.col("_doc").alias("doc_id"), "n_shingles", F.coalesce("low", "_doc").alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` with one document of each group left: the smallest doc_id (nulls first), then hash of the text.

    Its columns are unchanged. Of rows that repeat id and text one stays. Null or empty texts all stay. Other odd rows:
    as in ``near_duplicates``.
    """
    rows = stored(_judged(docs, k, percent), "judged")
    gone = rows.where("head is not null").where(~F.struct(*ROW).eqNullSafe(F.col("head"))).select(*ROW).distinct()
    left = on_row(keyed(docs), small(stored(gone, "gone")), "left_anti")
    twice = stored(rows.where(F.struct(*ROW).eqNullSafe(F.col("head"))).groupBy(*ROW).agg(F.count("*").alias("n")).where("n > 1").select(*ROW), "twice")
    if not twice.isEmpty():
        once = on_row(left, small(twice), "left_semi").dropDuplicates(ROW)
        left = on_row(left, small(twice), "left_anti").unionByName(once)
    return left.select("_row.*")
