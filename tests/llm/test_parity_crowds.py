"""Groups of many documents that share passages but don't link: all links are kept, meetings don't grow as squares."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import parity_join


def words(rng, n, stock=5000):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


def templated(rng, n, shared=160, own=40, first=0):
    page = words(rng, shared)
    return [(first + k, f"{page} {words(rng, own, 10**9)}") for k in range(n)]


def brute(rows):
    sets = [(d, set(map(int, parity_join.shingle_set(t)))) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    return {d: find(d) for d, _ in rows}


def components(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    return {r["doc_id"]: r["component_id"] for r in parity_join.near_query(frame).collect()}


def mixed(rng):
    """Templates with own parts of all sizes, near copies among them, and chains of edits."""
    rows = templated(rng, 60)
    page = words(rng, 120)
    for own in (5, 12, 25, 31, 40, 60):
        rows += [(len(rows) + k, f"{page} {words(rng, own, 10**9)}") for k in range(25)]
    for k in range(40):
        text = rng.choice(rows[:60])[1].split(" ")
        for _ in range(rng.randrange(6)):
            text[rng.randrange(len(text))] = f"n{rng.randrange(10**9)}"
        rows.append((len(rows), " ".join(text)))
    text = words(rng, 150).split(" ")
    for k in range(30):
        text[(7 * k) % 150] = f"c{k}"
        rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("crowd", [0, 8])
def test_links_of_crowds_are_whole(spark, monkeypatch, crowd):
    monkeypatch.setattr(parity_join, "CROWD", crowd)
    monkeypatch.setattr(parity_join, "SALT_ROWS", 16)
    monkeypatch.setattr(parity_join, "SPLIT_ROWS", 32)
    rows = mixed(random.Random(3 + crowd))
    want = brute(rows)
    assert components(spark, rows) == want
    assert len(set(want.values())) < len(rows) - 40


def test_a_template_makes_no_squares(spark, monkeypatch):
    met = []
    real = parity_join.ParityJoin._met

    def counting(self, labelled, state):
        out = real(self, labelled, state)
        unbounded = labelled.join(state.select("key", "outside", "members"), "key").agg(F.sum(F.col("outside") * F.col("members") / F.col("members"))).first()[0]
        met.append(unbounded or 0)
        return out

    monkeypatch.setattr(parity_join.ParityJoin, "_met", counting)
    monkeypatch.setattr(parity_join, "CROWD", 64)
    rows = templated(random.Random(1), 400)
    assert components(spark, rows) == {d: d for d, _ in rows}
    assert sum(met) < 64 * len(rows)  # the groups of hundreds that the page makes are left to rare shingles, which nobody shares
