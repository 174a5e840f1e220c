"""Periodic runs against a comparison of every text with itself at every distance."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pitchspark.llm import periodic, queries

DATA = "/root/testdata/sf0.001"


def plain_runs(words):
    """(start, end, smallest period) of every run of two periods and more."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, out = np.array([codes[w] for w in words], np.int32), {}
    for p in range(1, len(words) // 2 + 1):
        edges = np.flatnonzero(np.diff((ids[:-p] == ids[p:]).astype(np.int8), prepend=0, append=0))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= p:
                out.setdefault((s, e + p), p)
    return sorted((s, e, p) for (s, e), p in out.items())


def plain(rows, planted=True):
    out = []
    for d, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(d).encode()) if d is not None else 1
        if planted and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = sorted((s, e - s, p) for s, e, p in plain_runs(words) if e - s >= 12)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((d, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha(listed), sha(left)))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def odd_words(rng):
    """Words of few letters, with regions of small periods inside longer ones, broken and shifted."""
    kind, n = rng.randrange(7), rng.choice([0, 1, 11, 12, 13, 60, 200, 500])
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return ["a"] * n
    if kind == 2:
        u, v, out = [rng.choice("abc") for _ in range(rng.randrange(1, 7))], [rng.choice("abc") for _ in range(rng.randrange(1, 5))], []
        while len(out) < n:
            out += u * rng.randrange(1, 40) + v * rng.randrange(30)
        return out[:n]
    if kind == 3:
        u = [rng.choice("ab") for _ in range(rng.randrange(1, 5))]
        block = u * rng.randrange(5, 40) + u[: rng.randrange(len(u) + 1)]
        return [rng.choice("ab") for _ in range(rng.randrange(4))] + block * rng.randrange(2, 5) + block[: rng.randrange(len(block))] + ["z"] * rng.randrange(2)
    if kind == 4:
        a, b = ["a"], ["a", "b"]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 5:
        b = [0]
        while len(b) < n:
            b = b + [1 - x for x in b]
        return [f"w{x}" for x in b[:n]]
    u = [f"w{rng.randrange(1000)}" for _ in range(rng.randrange(1, 120))]
    return [f"w{rng.randrange(1000)}" for _ in range(50)] + (u * 8)[:n] + ["end"]


@pytest.mark.parametrize("seed", range(6))
def test_every_run_of_odd_texts(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "  ".join(odd_words(rng))) for i in range(60)] + [(None, "a b " * 9), (3, None), (3, ""), (3, "\x85a b\x1c " * 8), (3, "é É\n\t" * 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for planted in (False, True):
        assert got(periodic.periodic_runs(table, planted=planted, outputs=False)) == plain(rows, planted)


def test_two_regions_of_one_root_that_meet_out_of_phase():
    texts = []
    for q in range(1, 6):
        root = [0] * (q - 1) + [1]
        texts += [root * a + root[:c] + root * b + root[:c] + root * b + [2] for a in (16, 25) for b in (16, 33) for c in range(1, q + 1)]
    texts.sort(key=len, reverse=True)
    sizes = np.array([len(t) for t in texts])
    words = np.array([hash(("w", x)) for k, t in enumerate(texts) for x in [*t, f"end {k}"]])
    found, at = periodic.all_runs(words, sizes), 0
    for t in texts:
        own = sorted((s - at, e - at, p) for s, e, p in found.tolist() if at <= s < at + len(t) + 1)
        assert own == plain_runs(t)
        at += len(t) + 1


def test_equal_contexts_are_chosen_alike():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 4000)
    words[2000:3000] = words[500:1500]
    for t in (4, 8, 16, 32):
        windows = periodic._windows(words, t)
        chosen = set(periodic.synchronising_set(windows, t, np.zeros(len(windows), bool)).tolist())
        assert all((i in chosen) == (i + 1500 in chosen) for i in range(500, 1500 - 2 * t))
        assert all(any(i + j in chosen for j in range(t)) for i in range(0, len(words) - 3 * t))


def test_runs_and_texts_are_given_out(spark):
    text = "x " + "to be or not " * 4 + "to y"
    table = spark.createDataFrame([(5, text)], "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS runs", "3 AS n_runs")
    row = periodic.periodic_runs(table).first()
    assert [tuple(r) for r in row.runs] == [(1, 17, 4)] and row.collapsed == "x to be or not y" and row.n_words == 19
    assert periodic.periodic_runs(table.where("false")).count() == 0


def test_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op11_periodic_runs(spark, DATA)) == plain(rows)
