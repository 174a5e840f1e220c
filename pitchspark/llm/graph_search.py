"""Approximate nearest neighbours (12): a hierarchical navigable small-world graph per shard, shard results merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, small, stored

#: Vectors of a shard, about: a task builds and holds one shard.
SHARD_ROWS = 1 << 14
#: Links that a vector chooses a level, links it holds at most on the lowest level, and nearest vectors that it chooses among.
CHOSEN, HELD, AMONG = 24, 64, 64
#: Width of a search's beam on the lowest level, vectors opened a step, and queries walked at once.
BEAM, OPENED, AT_ONCE = 192, 4, 256
#: Queries of a block: what one search task holds beside its shard.
BLOCK_QUERIES = 1 << 11
#: A level holds this share of the one below.
SHRINK = 16


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """``vectors`` with one more component that makes all norms equal, so that the largest inner product is the nearest."""
    norms = (vectors.astype(np.float64) ** 2).sum(1)
    return np.concatenate([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1).astype(np.float32)


def _apart(x: np.ndarray, near: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Which of each row's candidates (nearest first) to link: those nearer to the row than to all chosen before; then the nearest."""
    own = x[near]
    between = own @ own.transpose(0, 2, 1)
    rows, width = near.shape
    taken, free = np.zeros((rows, width), bool), score > -np.inf
    for j in range(width):
        take = free[:, j] & (taken.sum(1) < most)
        taken[:, j] = take
        # a later candidate that is nearer to this one than to the row is left out
        free[:, j + 1 :] &= ~(take[:, None] & (between[:, j, j + 1 :] > score[:, j + 1 :]))
    rest = (score > -np.inf) & ~taken
    room = most - taken.sum(1)
    return taken | (rest & (np.cumsum(rest, axis=1) <= room[:, None]))


def _linked(x: np.ndarray, members: np.ndarray, held: int, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one level, a row a member of at most ``held`` numbers of members, padded by -1; and the pairs chosen so far.

    ``above``: the pairs that the levels above chose. Their members keep them as long links, which lead from crowd to crowd.
    """
    n = len(members)
    if n == 1:
        return np.full((1, 1), -1, np.int32), above
    own, among = x[members], min(AMONG, n - 1)
    ends = []
    for at in range(0, n, AT_ONCE):
        score = own[at : at + AT_ONCE] @ own.T
        score[np.arange(len(score)), np.arange(at, at + len(score))] = -np.inf
        near = np.argpartition(-score, among - 1, axis=1)[:, :among]
        near_score = np.take_along_axis(score, near, 1)
        order = np.argsort(-near_score, axis=1, kind="stable")
        near, near_score = np.take_along_axis(near, order, 1), np.take_along_axis(near_score, order, 1)
        row, col = np.nonzero(_apart(own, near, near_score, CHOSEN))
        ends.append(np.stack([row + at, near[row, col]]))
    source, target = np.unique(np.concatenate([*ends, np.searchsorted(members, above)], axis=1), axis=1)
    # links go both ways; a vector that few chose keeps its place with those that it chose
    chosen_by = np.bincount(target, minlength=n)
    a, b = np.concatenate([source, target]), np.concatenate([target, source])
    first = np.concatenate([np.zeros(len(source)), 1 + chosen_by[source]])
    order = np.lexsort((first, a))
    a, b = a[order], b[order]
    _, pick = np.unique(a.astype(np.int64) * n + b, return_index=True)
    pick.sort()
    a, b = a[pick], b[pick]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    a, b, place = a[place < held], b[place < held], place[place < held]
    out = np.full((n, int(place.max()) + 1), -1, np.int32)
    out[a, place] = members[b]
    return out, members[np.stack([source, target])]


def build(vectors: np.ndarray, draw: np.ndarray) -> dict:
    """The graph of a shard: lifted vectors, and for each level its members and their links as flat arrays.

    ``draw`` (0 to 1, a number a vector) says how high each reaches.
    """
    x = _lifted(vectors)
    height = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(SHRINK)).astype(np.int32)
    levels, pairs = [], np.empty((2, 0), np.int32)
    for level in range(int(height.max()), -1, -1):
        members = np.flatnonzero(height >= level).astype(np.int32)
        links, pairs = _linked(x, members, HELD, pairs)
        levels.insert(0, (members, links))
    return {"x": x, "levels": levels}


def _walk(x: np.ndarray, q: np.ndarray, links: np.ndarray, place: np.ndarray | None, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all ``q`` side by side: numbers and scores of the ``beam`` best found, best first, padded by -1.

    ``start`` has the numbers to start from, a row a query; ``place`` says which row of ``links`` a number has.
    """
    n, rows = len(x), np.arange(len(q))[:, None]
    seen = np.zeros((len(q), n + 1), bool)
    best = start
    score = np.where(start >= 0, np.einsum("qd,qkd->qk", q, x[start]), -np.inf).astype(np.float32)
    seen[rows, start] = True
    opened = np.zeros(best.shape, bool)
    alive = np.arange(len(q))
    done_best, done_score = np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), -np.inf, np.float32)
    step = min(OPENED, beam)
    while True:
        order = np.argsort(-score, axis=1, kind="stable")[:, :beam]
        best, score, opened = (np.take_along_axis(a, order, 1) for a in (best, score, opened))
        closed = opened | (best < 0)
        rank = np.cumsum(~closed, axis=1)
        going = rank[:, -1] > 0
        if not going.all():
            over = alive[~going]
            done_best[over, : best.shape[1]], done_score[over, : best.shape[1]] = best[~going], score[~going]
            alive, best, score, opened, closed, rank, seen, q = (a[going] for a in (alive, best, score, opened, closed, rank, seen, q))
            if not len(alive):
                return done_best, done_score
        rows = np.arange(len(alive))[:, None]
        now = ~closed & (rank <= step)
        opened = opened | now
        row, col = np.nonzero(now)
        number = best[row, col]
        reach = np.full((len(alive), step, links.shape[1]), -1, np.int32)
        reach[row, rank[row, col] - 1] = links[number if place is None else place[number]]
        reach = reach.reshape(len(alive), -1)
        reach.sort(axis=1)
        reach[:, 1:][reach[:, 1:] == reach[:, :-1]] = -1
        reach[seen[rows, reach]] = -1
        seen[rows, reach] = True
        seen[:, n] = False
        width = int((reach >= 0).sum(1).max())
        if not width:
            continue
        reach = -np.sort(-reach, axis=1)[:, :width]
        fresh = np.matmul(x[reach], q[:, :, None])[:, :, 0]
        fresh[reach < 0] = -np.inf
        best, score = np.concatenate([best, reach], axis=1), np.concatenate([score, fresh], axis=1)
        opened = np.concatenate([opened, np.zeros(reach.shape, bool)], axis=1)


def search(graph: dict, queries: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the ``k`` best that the graph finds for each query, from the highest level down."""
    x, levels = graph["x"], graph["levels"]
    found, scores = [], []
    for at in range(0, len(queries), AT_ONCE):
        q = queries[at : at + AT_ONCE].astype(np.float32)
        q = np.concatenate([q, np.zeros((len(q), 1), np.float32)], axis=1)
        start = np.full((len(q), 1), levels[-1][0][0], np.int32)
        for members, links in levels[:0:-1]:
            place = np.zeros(len(x), np.int32)
            place[members] = np.arange(len(members))
            start, _ = _walk(x, q, links, place, start, 8)
        best, score = _walk(x, q, levels[0][1], None, start, max(beam, k))
        found.append(best[:, :k])
        scores.append(score[:, :k])
    return np.concatenate(found), np.concatenate(scores)


def vectors_of(table: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, vector (array<double>), dim, h, g (128 bits of the vector) of the rows that take part."""
    v = F.transform(F.col(column).cast("array<double>"), lambda x: x + 0.0)  # one zero
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = table.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    return rows.withColumns({"dim": F.size("vector"), "h": F.xxhash64("vector"), "g": F.xxhash64(F.lit(1), "vector")})


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """h, g, dim, vector, ids: a row a distinct vector, with the ``k`` smallest ids that have it.

    Each task sends at most ``k`` rows of a vector, however many have it; of more, none can be among the first ``k`` of a list.
    """
    place = F.row_number().over(Window.partitionBy("h", "g", "vector").orderBy("vec_id"))
    few = rows.dropDuplicates(["vec_id", "h", "g"]).withColumn("place", place).where(F.col("place") <= k)
    return few.groupBy("h", "g", "vector", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


INDEX = "dim int, shard long, vectors binary, ids array<array<long>>, members array<array<int>>, links array<array<int>>"
HIT = "h long, g long, vec_id long, score double"


def _index_row(table: pa.Table) -> pa.Table:
    """The graph of one shard in one row: vectors, members of each level, and each level's links row by row."""
    dim = table.column("dim")[0].as_py()
    vectors = table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    scale = np.abs(vectors).max()
    draw = (table.column("g").to_numpy().view(np.uint64) >> np.uint64(11)) / float(1 << 53)
    graph = build(vectors / scale, draw)
    levels = graph["levels"]
    return pa.table(
        [
            pa.array([dim], pa.int32()), pa.array([table.column("shard")[0].as_py()], pa.int64()), pa.array([vectors.tobytes()], pa.binary()),
            pa.array([table.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
            pa.array([[m for m, _ in levels]], pa.list_(pa.list_(pa.int32()))), pa.array([[x.reshape(-1) for _, x in levels]], pa.list_(pa.list_(pa.int32()))),
        ],
        [x.split()[0] for x in INDEX.split(", ")],
    )


def _searcher(k: int, beam: int):
    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        found = {"h": [], "g": [], "vec_id": [], "score": []}
        if queries.num_rows and index.num_rows:
            dim = index.column("dim")[0].as_py()
            vectors = np.frombuffer(index.column("vectors")[0].as_py(), np.float64).reshape(-1, dim)
            members = [np.array(m.values.to_numpy()) for m in index.column("members")[0]]
            links = [x.values.to_numpy().reshape(len(m), -1) for m, x in zip(members, index.column("links")[0], strict=True)]
            graph = {"x": _lifted(vectors / np.abs(vectors).max()), "levels": list(zip(members, links, strict=True))}
            lists = index.column("ids").combine_chunks().flatten()
            id_offs, ids = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            id_offs = id_offs - id_offs[0]
            q = queries.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            near, _ = search(graph, q / np.abs(q).max(axis=1, keepdims=True), beam, k + k // 2)
            score = np.zeros(near.shape)
            for j in range(dim):  # in the vectors' order, in double precision
                score += q[:, j, None] * vectors[near, j]
            row, col = np.nonzero(near >= 0)
            number, score = near[row, col], score[row, col]
            many = np.diff(id_offs)[number]
            row, score = np.repeat(row, many), np.repeat(score, many)
            own = ids[np.repeat(id_offs[number], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
            order = np.lexsort((own, -score, row))
            row, score, own = row[order], score[order], own[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            row = row[first]
            found = {"h": queries.column("h").to_numpy()[row], "g": queries.column("g").to_numpy()[row], "vec_id": own[first], "score": score[first]}
        return pa.table({c: pa.array(v, pa.float64() if c == "score" else pa.int64()) for c, v in found.items()})

    return run


def nearest(table: DataFrame, every: int = 20, k: int = 20, column: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = BEAM, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest that the graphs find for each row whose vec_id is divisible by ``every``.

    Nearness is the inner product in double precision, the largest first, ties to the smaller vec_id; a query's own id is no
    candidate. Distinct vectors are dealt to shards by hash. A shard's graph is built in one task and stored as flat arrays in
    one row; a query visits every shard, and the best of all shards count. Equal vectors are one vertex, so crowds of
    copies cost no more than one; their ids are told apart in the end.

    Rows with a null id or vector, a zero vector, or a null or non-finite component take no part. Vectors of different
    lengths never meet. Rows that repeat id and vector count once; of rows that share an id with different vectors each is a
    query of its own, and none finds the others. An empty table gives an empty result. Other columns are ignored.
    """
    some = k + 1  # a query's own id may be among them
    rows = vectors_of(table, column)
    classes = stored(distinct_vectors(rows, some), "vectors")
    shards = small(stored(classes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).alias("shards")), "shards"))
    dealt = classes.join(shards, "dim").select("dim", F.pmod("h", F.col("shards")).alias("shard"), "g", "vector", "ids")
    index = stored(dealt.groupBy("dim", "shard").applyInArrow(_index_row, INDEX), "graphs")
    asking = stored(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h", "g").distinct(), "asking")
    wanted = asking.select("h", "g").distinct()
    queries = stored(classes.join(wanted, ["h", "g"], "left_semi").select("h", "g", "dim", "vector"), "queries")
    blocks = max(1, -(-queries.count() // block))
    asked = queries.join(shards, "dim").select("h", "g", "dim", "vector", F.pmod("g", F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    keys = ["dim", "shard", "block"]
    hits = asked.groupBy(*keys).cogroup(graphs.groupBy(*keys)).applyInArrow(_searcher(some, beam), HIT)
    hits = stored(hits, "hits")
    place = F.row_number().over(Window.partitionBy("h", "g").orderBy(F.desc("score"), "vec_id"))
    best = hits.withColumn("place", place).where(F.col("place") <= some).groupBy("h", "g")
    best = best.agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    lists = asking.join(best, ["h", "g"]).select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    dropped(queries, index)
    return lists.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
