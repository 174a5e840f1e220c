"""Conversation prefix trie (13): sorted conversations, common prefixes of neighbours, and member intervals by range minima.

Distinct conversations are sorted by their turns in ranges. ``lcp[i]`` counts the turns that conversation i shares with the one
before it. Every candidate prefix, one for each neighbour pair and each end, finds the left and the right end of its members by
two binary searches over a sparse table of range minima of ``lcp``; each search is independent of all others, so a block is a
few vector operations. Sums over a node's members and subtree are differences of running sums.

A node that reaches over the edge of a block leaves a partial row a block, under a hash of its prefix; they are at most as
many as the turns that the two sides of an edge share, and are added up by that hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, small, stored

WORD = r"[^\x20\x09-\x0D]++"
#: Turns of distinct conversations in a block, about; a block is one task's memory, some 300 bytes a turn.
BLOCK_TURNS = 1 << 18
#: Conversations in a block at least, where more blocks would only give more tasks.
BLOCK_LEAST = 256
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

NODE = (
    "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)


def conversations(table: DataFrame) -> DataFrame:
    """conv_id, own: the turns of each conversation in order, each (turn, key, words); ``key`` is 128 bits of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = table.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"),
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))


def shared_heads(convs: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """conv_id, keys, words of conversations that begin with the first h turns of conversation ``conv_id - conv_id % group``.

    h is the CRC-32 of the decimal id modulo ``most + 1``; the conversation's own turns follow from its turn h on.
    """
    heads = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    own = convs.select("conv_id", base.alias("base"), h.alias("h"), "own").join(heads, "base", "left")
    none = F.slice("own", 1, 0)
    seq = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    out = own.select("conv_id", seq.alias("seq"))
    return out.select("conv_id", F.transform("seq", lambda t: t["key"]).alias("keys"), F.transform("seq", lambda t: t["words"]).alias("words"))


def _class(keys: str = "keys") -> list[Column]:
    """128 bits of a whole sequence."""
    return [F.xxhash64(F.lit(1), F.size(keys), keys).alias("h"), F.xxhash64(F.lit(2), F.size(keys), keys).alias("g")]


def ends(members: DataFrame, parts: int) -> DataFrame:
    """h, g, ends_sha256 of (h, g, conv_id): the hash of each class's ids, ascending, comma-joined.

    Ids are sorted in ranges of (class, id), so that a class with most of the rows is many tasks; each writes its ids as
    text, and only those pieces meet, to be hashed one after the other as they stream by.
    """

    def pieces(batches):
        for b in batches:
            if not b.num_rows:
                continue
            h, g, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
            last = np.append(first[1:], len(h))
            text = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(first, last, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(g[first]), pa.array(ids[first]), pa.array(text, pa.string())], ["h", "g", "first", "text"])

    def hashed(batches):
        now, digest = None, None
        for b in batches:
            done = []
            for h, g, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (h, g) == now:
                    digest.update(b"," + text.encode())
                    continue
                if now:
                    done.append((*now, digest.hexdigest()))
                now, digest = (h, g), hashlib.sha256(text.encode())
            yield _rows(done)
        if now:
            yield _rows([(*now, digest.hexdigest())])

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["h", "g", "ends_sha256"])

    texts = members.select("h", "g", "conv_id").repartitionByRange(parts, "h", "g", "conv_id").sortWithinPartitions("h", "g", "conv_id")
    texts = texts.mapInArrow(pieces, "h long, g long, first long, text string")
    return texts.repartition(parts, "h", "g").sortWithinPartitions("h", "g", "first").mapInArrow(hashed, "h long, g long, ends_sha256 string")


class _Minima:
    """Sparse table: row k holds the minima of 2**k values from each place on."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 * (width := 1 << (len(self.rows) - 1)) <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of values[first..last], both included."""
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.rows[0].dtype)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            out[at] = np.minimum(self.rows[level][first[at]], self.rows[level][last[at] - (1 << int(level)) + 1])
        return out

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The least l for which values[l + 1 .. at] all reach ``bound``."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            start = at - (1 << k) + 1
            ok = start >= 0
            ok[ok] = self.rows[k][start[ok]] >= bound[ok]
            at[ok] -= 1 << k
        return at

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The greatest r for which values[at + 1 .. r] all reach ``bound``."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            ok = at + 1 < len(self.rows[k])
            ok[ok] = self.rows[k][at[ok] + 1] >= bound[ok]
            at[ok] += 1 << k
        return at


def neighbours_lcp(keys: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Turns that each sequence but the first shares with the one before it; ``keys`` has a row a turn."""
    lens = np.diff(offs)
    shared = np.minimum(lens[:-1], lens[1:])
    owner = np.repeat(np.arange(len(shared)), shared)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(shared) - shared, shared)
    apart = np.flatnonzero((keys[offs[:-2][owner] + step] != keys[offs[1:-1][owner] + step]).any(axis=1))
    np.minimum.at(shared, owner[apart], step[apart])
    return shared


def _prefix_keys(raw: list[bytes], upto: int) -> list[bytes]:
    """Hashes of the first 0, 1, ... ``upto`` turns."""
    digest, out = hashlib.blake2b(digest_size=16), []
    for d in range(upto + 1):
        out.append(digest.digest())
        if d < upto:
            digest.update(raw[d])
    return out


def block_nodes(keys: np.ndarray, offs: np.ndarray, words: np.ndarray, n: np.ndarray, conv: np.ndarray, own_ends: np.ndarray, before: int, after: int) -> pa.Table:
    """The nodes of one block of sorted distinct sequences, those over its edges as partial rows with a key.

    ``before`` and ``after``: turns shared with the neighbouring blocks, -1 where there is none.
    """
    c, lens = len(n), np.diff(offs)
    lcp = np.concatenate([[before], neighbours_lcp(keys, offs), [after]]).astype(np.int64)
    inner = lcp.copy()
    inner[0] = inner[-1] = -2
    minima, convs = _Minima(inner), _Minima(conv)

    # a candidate a neighbour pair, and one an end of a sequence
    at, depth = np.concatenate([np.arange(1, c), np.arange(c)]), np.concatenate([lcp[1:-1], lens])
    left, right = minima.left(at, depth), minima.right(at, depth)
    _, pick, of = np.unique(left * c + right, return_index=True, return_inverse=True)
    splits = np.bincount(of[: c - 1], minlength=len(pick))
    left, right, deep = left[pick], right[pick], depth[pick]
    low = np.maximum(np.where(left > 0, lcp[left], -1), np.where(right < c - 1, lcp[right + 1], -1))
    parent = np.maximum(low, 0)
    up_left, up_right = minima.left(left, parent), minima.right(left, parent)
    least, up_least = convs.least(left, right), convs.least(up_left, up_right)

    upto = np.concatenate([[0], np.cumsum(words)])  # words of all turns before a place
    total = upto[offs[1:]] - upto[offs[:-1]]
    known = np.minimum(np.maximum(lcp[:-1], 0), lens)
    fresh = total - (upto[offs[:-1] + known] - upto[offs[:-1]])
    run = lambda x: np.concatenate([[0], np.cumsum(x)])
    n_upto, said, new, leaf = run(n), run(n * total), run(fresh), run(lens > lcp[1:])

    i = np.repeat(np.arange(len(pick)), deep - low)
    d = np.arange(len(i)) - np.repeat(np.cumsum(deep - low) - (deep - low), deep - low) + low[i] + 1
    l, r = left[i], right[i]
    starts = (l > 0) | (d > before)
    head = upto[offs[l] + np.maximum(d - 1, 0)] - upto[offs[l]]
    members = n_upto[r + 1] - n_upto[l]
    distinct = np.where(starts, total[l] - head + new[r + 1] - new[l + 1], new[r + 1] - new[l])
    ends_here = starts & (lens[l] == d)
    children = np.where(d == deep[i], splits[i], 0) + np.where(starts, 1 - ends_here, d == before)

    def over(first, last, depth):
        return np.where((first == 0) & (depth <= before), 1, np.where((last == c - 1) & (depth <= after), 2, 0))

    raw = lambda k: [keys[j].tobytes() for j in range(offs[k], offs[k + 1])]
    spine = [_prefix_keys(raw(0), before), _prefix_keys(raw(c - 1), after)]

    def named(side, depth):
        out = np.full(len(side), None, object)
        for j in np.flatnonzero(side):
            out[j] = spine[side[j] - 1][depth[j]]
        return pa.array(out, pa.binary())

    same = d - 1 > low[i]
    up = np.where(d == 0, 0, over(np.where(same, l, up_left[i]), np.where(same, r, up_right[i]), d - 1))
    digests = np.full(len(i), "", object)
    digests[ends_here] = own_ends[l[ends_here]]
    return pa.table(
        [
            named(over(l, r, d), d), named(up, d - 1), pa.array(least[i]), pa.array(d),
            pa.array(np.where(same, least[i], up_least[i]), mask=(d == 0) | (up > 0)), pa.array(members), pa.array(children),
            pa.array(leaf[r + 1] - leaf[l]), pa.array(said[r + 1] - said[l] - members * head - distinct), pa.array(digests, pa.string()),
        ],
        [x.split()[0] for x in NODE.split(", ")],
    )


def _nodes_of(table: pa.Table) -> pa.Table:
    table = table.sort_by("at").combine_chunks()
    column = lambda name: table.column(name).to_numpy()
    lists = table.column("keys").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    words = table.column("words").combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    offs = lists.offsets.to_numpy().astype(np.int64)
    flat = b"".join(lists.flatten().to_pylist())
    keys = np.frombuffer(flat, np.uint64).reshape(-1, 2)
    own_ends = table.column("ends_sha256").to_numpy()
    return block_nodes(keys, offs - offs[0], words.flatten().to_numpy().astype(np.int64), column("n"), column("conv_id"), own_ends, int(column("before")[0]), int(column("after")[0]))


def _lcp(a: str, b: str) -> Column:
    """Turns that two different sequences share; -1 where either is missing."""
    apart = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(F.col(a).isNull() | F.col(b).isNull(), -1).otherwise(apart - 1).cast("long")


def trie_nodes(rebuilt: DataFrame, blocks: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``rebuilt`` has conv_id, keys (a hash a turn) and words (a count a turn). ``blocks``: sorted ranges, by default as many
    as the turns of distinct sequences ask for.
    """
    spark = rebuilt.sparkSession
    rebuilt = stored(rebuilt.select("conv_id", "keys", "words", *_class()), "rebuilt")
    # equal conversations are one row from here on, counted before they are shuffled
    classes = stored(rebuilt.groupBy("keys", "words", "h", "g").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "classes")
    rows, turns = classes.agg(F.count("*"), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks or max(1, -(-turns // BLOCK_TURNS), min(tasks, -(-rows // BLOCK_LEAST)))
    hashed = classes.join(ends(rebuilt, max(tasks, blocks)), ["h", "g"]).select("keys", "words", "n", "conv_id", "ends_sha256")
    ordered = hashed.repartitionByRange(blocks, "keys").sortWithinPartitions("keys").withColumn("at", F.monotonically_increasing_id())
    ordered = stored(ordered.withColumn("block", F.shiftright("at", 33)), "sorted")
    edges = ordered.groupBy("block").agg(F.min_by("keys", "at").alias("first"), F.max_by("keys", "at").alias("last"))
    order = Window.orderBy("block")  # a row a block
    edges = edges.withColumns({"_last": F.lag("last").over(order), "_first": F.lead("first").over(order)})
    edges = stored(edges.select("block", _lcp("_last", "first").alias("before"), _lcp("last", "_first").alias("after")), "edges")
    found = stored(ordered.join(small(edges), "block").groupBy("block").applyInArrow(_nodes_of, NODE), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    crossing = found.where("key is not null").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums, F.max("ends_sha256").alias("ends_sha256")
    )
    crossing = stored(crossing, "crossing")
    every = found.where("key is null").unionByName(crossing.withColumn("parent_conv_id", F.lit(None).cast("long")))
    parents = small(crossing.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up")))
    linked = every.where("parent_key is not null").join(parents, "parent_key").withColumn("parent_conv_id", F.col("_up"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = every.where("parent_key is null").select(*out).unionByName(linked.select(*out))
    dropped(rebuilt, classes, ordered, edges)
    return nodes.withColumn("ends_sha256", F.when(F.col("ends_sha256") == "", EMPTY_SHA).otherwise(F.col("ends_sha256")))


def prefix_trie(table: DataFrame, blocks: int | None = None) -> DataFrame:
    """The nodes of the trie of ``table`` (conv_id, turn, role, text), its conversations rebuilt by ``shared_heads``.

    Turns go by turn, nulls first, then by hash of role and text; a null role or text is empty, and repeated rows are turns
    each. Rows without a conv_id belong to no conversation and take no part. Texts of any length are hashed in the scan. A
    conversation's hashes, 16 bytes a turn, stand in one row. A conversation without turns ends at the root. An empty table
    has no members and gives no node. Other columns are ignored.
    """
    return trie_nodes(shared_heads(conversations(table)), blocks)
