"""The conversation trie against a plain one."""

import hashlib
import math
import random
import re
import zlib

import pytest

from pitchspark.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
DATA = "/root/testdata/sf0.001"


def plain(rows):
    """Every node by its whole prefix, subtrees walked."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest(), r or "", x or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    nodes, below = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for p in nodes:
        below.setdefault(p[:-1], []).append(p) if p else None

    def subtree(p):
        found = [p]
        for q in found:
            found += below.get(q, [])
        return found

    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, members in nodes.items():
        own_ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(p))))
        inside = subtree(p)
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(below.get(p, [])), sum(q not in below for q in inside),
            sum((len(nodes[q]) - 1) * words(q) for q in inside), hashlib.sha256(own_ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,convs,shift", [(1, 1, 0), (2, 40, 0), (3, 90, 0), (4, 90, -50)])
def test_nodes_are_those_of_a_plain_trie(spark, seed, convs, shift):
    rng = random.Random(seed)
    rows = [
        (c + shift, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", " x y\tz", None, "d"]))
        for c in range(convs) if rng.random() > 0.1 for t in range(rng.choice([1, 2, 3, 5, 9]))
    ]
    rows += [(None, 1, "user", "no conversation"), *rows[:3]]
    table = spark.createDataFrame(rows, SCHEMA)
    for blocks in (1, 7):
        assert got(prefix_trie.prefix_trie(table, blocks)) == plain(rows)


def test_crowds_of_copies_and_a_long_conversation_over_many_blocks(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(3)]
    rows += [(500 + c, t, "user", "long ") for c in range(3) for t in range(200 + c)]
    rows += [(700 + c, t, "user", f"same {t}" if t < 2 else f"own {c}") for c in range(60) for t in range(4)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert got(prefix_trie.prefix_trie(table, 16)) == plain(rows)


def test_extra_columns_and_an_empty_table(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "é b")]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS keys", "3 AS words", "4 AS h", "5 AS block", "6 AS own")
    assert got(prefix_trie.prefix_trie(table)) == plain(rows)
    assert prefix_trie.prefix_trie(table.where("false")).collect() == []


def test_the_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert got(queries.op13_prefix_trie(spark, DATA)) == plain([tuple(r) for r in table.collect()])
