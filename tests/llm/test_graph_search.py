"""Graph search against brute force: exact on small tables, recall on large ones."""

import numpy as np
import pytest

from pitchspark.llm import graph_search, queries

DATA = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, every=20, k=20):
    """query_id, rank, vec_id, score of all pairs."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for i, v in good:
        if i % every == 0:
            scored = []
            for j, w in good:
                if j != i and len(w) == len(v):
                    total = 0.0
                    for a, b in zip(v, w, strict=True):
                        total += float(np.float32(a)) * float(np.float32(b))
                    scored.append((-total, j))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = lambda *s: rng.normal(size=s).astype(np.float32).tolist()
    rows = [(i, x) for i, x in enumerate(v(70, 8))] + [(i, x) for i, x in zip(range(100, 112), v(12, 5), strict=True)]
    rows += [(200, None), (220, []), (240, [0.0] * 8), (260, [1.0, None] + [1.0] * 6), (280, [float("nan")] + [1.0] * 7), (300, [float("inf")] + [1.0] * 7), (None, v(8))]
    rows += [(320, v(3)), rows[0], rows[0], rows[7], (340, [0.0, -0.0, 1.0]), (341, [-0.0, 0.0, 1.0]), (342, [2e30, 1.0, 1e-30])]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS h", "2 AS dim", "3 AS shard", "4 AS vector", "5 AS ids")
    for shard_rows, block in ((1000, 1000), (20, 2)):
        assert got(graph_search.nearest(table, shard_rows=shard_rows, block=block)) == plain(rows)
    assert graph_search.nearest(table.where("false")).collect() == []


def test_crowds_of_one_vector_are_one_vertex(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(0, 900)] + [(2000 + i, x) for i, x in enumerate(rng.normal(size=(60, 4)).astype(np.float32).tolist())]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert got(graph_search.nearest(table, shard_rows=25, block=3)) == plain(rows)
    few = graph_search.distinct_vectors(graph_search.vectors_of(table), 21)
    assert max(len(r.ids) for r in few.collect()) == 21
    assert "WindowGroupLimit" in few._jdf.queryExecution().executedPlan().toString()


def test_recall_on_the_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    v = np.array([r.embedding for r in table.orderBy("vec_id").collect()], np.float64)
    found = {}
    for r in queries.op12_nearest_neighbours(spark, DATA).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, len(v), 20):
        score = v @ v[q]
        score[q] = -np.inf
        rows = sorted(found[q])
        assert [r[0] for r in rows] == list(range(1, 21)) and all(abs(s - score[i]) < 1e-12 for _, i, s in rows)
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        hits += len({i for _, i, _ in rows} & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.97 * 20 * len(found) and len(found) == -(-len(v) // 20)


@pytest.mark.parametrize("kind", ["crowds", "lengths"])
def test_recall_in_crowds_and_with_unequal_lengths(kind):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(4000, 16))
    v = np.repeat(10 * rng.normal(size=(40, 16)), 100, axis=0) + 0.1 * v if kind == "crowds" else v * rng.exponential(size=(4000, 1))
    v /= np.abs(v).max()
    graph, hits = graph_search.build(v, rng.random(4000)), 0
    near, _ = graph_search.search(graph, v[:400], graph_search.BEAM, 20)
    for q in range(400):
        hits += len(set(near[q].tolist()) & set(np.argsort(-(v @ v[q]))[:20].tolist()))
    assert hits >= 0.95 * 20 * 400
