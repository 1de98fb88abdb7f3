"""The prefix trie against dictionaries of prefixes and against its SQL; running values over many tasks."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tidemark.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, k1 string, node string, depth string, part string, length string"


def tables():
    rng = random.Random(9)
    rows = []
    stock = ["hi", "hello é", "", None, "日本 🙂", "what now"]
    for c in [*range(60), 75, 77, 102, 10**9 + 1, 10**9 + 3]:
        if c in (20, 35):
            continue  # a base that is absent
        turns = [(c, t if rng.random() < 0.95 or t else None, ("user", "assistant", None)[t % 3 if rng.random() < 0.9 else 2], rng.choice(stock[: 2 + c % 5])) for t in range(rng.randrange(1, 12))]
        rows += turns
    long = [(200, t, "user", f"{t % 7}") for t in range(1500)]
    rows += long + [(205, *r[1:]) for r in long] + [(206, *r[1:]) for r in long[:700]] + [(None, 1, "user", "lost")]
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 420) for t in range(4)]
    return rows


def expected(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t, role or "", text or ""))
    for c in own:  # turns are distinct within a conversation, but for equal ones
        own[c] = [(r, x) for _, r, x in sorted(own[c], key=lambda v: (v[0] is not None, v[0] or 0))]
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    nodes = defaultdict(lambda: [[], [], set(), 0])
    for c in sorted(built):
        key = 0
        ids = [0]
        for r, x in built[c]:
            key = hashlib.sha256(f"{key}|{len(r)}|{r}|{x}".encode()).hexdigest()
            ids.append(key)
        for d, k in enumerate(ids):
            nodes[k][0].append(c)
            nodes[k][3] = (d, ids[d - 1] if d else None, len(built[c][d - 1][1].encode()) if d else 0)
            if d + 1 < len(ids):
                nodes[k][2].add(ids[d + 1])
        nodes[ids[-1]][1].append(c)
    below = {}
    for k in sorted(nodes, key=lambda k: -nodes[k][3][0]):
        members, _, children, (d, _, size) = nodes[k]
        leaves = sum(below[c][0] for c in children) or 1
        below[k] = (leaves, sum(below[c][1] for c in children) + (len(members) - 1) * size)
    return sorted(
        ((m[0], d, nodes[up][0][0] if d else None, len(m), len(ch), *below[k], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()) for k, (m, ends, ch, (d, up, _)) in nodes.items()), key=str
    )


@pytest.fixture(scope="module")
def rows():
    # ties between different turns would need the hash's order
    seen, out = set(), []
    for r in tables():
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            out.append(r)
    return out + [(50, 30, "user", "same")] * 3


@pytest.fixture()
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


def test_every_node(spark, rows, many_tasks):
    want = expected(rows)
    got = prefix_trie.trie_query(frame_of(spark, rows).repartition(5))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert max(r[3] for r in want) > 150 and max(r[6] for r in want) > 1000


def test_a_sketch_that_is_full_changes_nothing(spark, rows):
    turns, convs = prefix_trie.spliced(prefix_trie.numbered_turns(frame_of(spark, rows)))
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(turns, convs, most_cells=1 << 12).collect()), key=str) == expected(rows)


def test_sketch_proves_only_singletons(spark):
    rng = np.random.default_rng(4)
    keys = rng.integers(-(2**63), 2**63 - 1, (3000, 2))
    keys[1000:2000] = keys[:1000]
    frame = spark.createDataFrame([(int(a), int(b), 0, 0, 1) for a, b in keys], "k1 bigint, k2 bigint, x1 bigint, x2 bigint, depth bigint").repartition(4)
    cells = prefix_trie.sketch(frame, 3000)
    alone = {(r["k1"], r["k2"]) for r in prefix_trie.screened(frame, cells).filter("alone").collect()}
    single = {tuple(map(int, k)) for k in keys[2000:]}
    assert alone <= single and len(alone) > 950


def test_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    got = prefix_trie.trie_query(spark.read.parquet(f"{folder}/conversations.parquet"))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({prefix_trie.ORACLE})").fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_as_they_are_and_empty(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (3, 0, "u", "z")]
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in prefix_trie.trie_of(frame_of(spark, rows)).collect()}
    assert got == {(1, 0): (None, 3, 2, 2, 1), (1, 1): (1, 2, 1, 1, 1), (1, 2): (1, 1, 0, 1, 0), (3, 1): (1, 1, 0, 1, 0)}
    assert prefix_trie.trie_query(frame_of(spark, [])).count() == 0
