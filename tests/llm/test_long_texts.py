"""One very long text through each operator that works on rows where they lie."""

import hashlib
import random
import re
import time

import pytest

from tidemark.llm import digest_index, extendible, host_rules, mixing, parity_join, secret_tests

SCHEMA = "doc_id bigint, text string, source string"


def base_by_hand(text):
    out = []
    for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m.group(1)) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(out))


def test_fifty_thousand_spans(spark):
    rng = random.Random(4)
    runs = []
    for k in range(50_000):
        runs.append("".join(rng.choices("0123456789abcdef", k=32)) if k % 3 else rng.choice(["password: 'hunter22é'", "🙂 token=abcdef", "AKIA" + "Q7" * 9, "plain"]))
    text = " ".join(runs)
    docs = spark.createDataFrame([(1, text, "a"), (2, "secret = abc", "a"), (3, None, "a")], SCHEMA)
    began = time.time()
    got = {r["doc_id"]: r for r in secret_tests.secret_query(docs).collect()}
    assert time.time() - began < 90
    want = base_by_hand(text)
    assert got[1]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[1]["n_hex"] == want.count("hex:") > 30_000
    assert got[3]["spans"] == "" == got[2]["spans"]


def test_a_run_of_many_parts(spark):
    rng = random.Random(8)
    keys = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40)) for _ in range(300)]
    text = "/-/".join(keys)  # one run of mixed signs
    row = secret_tests.secret_query(spark.createDataFrame([(1, text, "a")], SCHEMA)).first()
    found = {tuple(map(int, s.split(":")[1:])) for s in row["spans"].split(",") if s}
    assert len(found) > 270 and all(text[a:b].strip("/-") in keys for a, b in found)


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    return [(1, text, "a"), (2, text.replace(" ", "\n "), "b"), (3, "short text", "a"), (4, text[: len(text) // 2], "b"), (5, text + " end", "a")]


def test_other_operators(spark, long_rows):
    docs = spark.createDataFrame(long_rows, SCHEMA)
    rules = {r["doc_id"]: r for r in host_rules.host_query(docs).collect()}
    assert rules[1]["n_words"] == rules[2]["n_words"] == 400_000 and not rules[1]["base_failed"]
    dedup = {r["doc_id"]: r for r in digest_index.dedup_query(spark, docs).collect()}
    assert dedup[1]["keep_id"] == 2 and dedup[2]["kept"] and dedup[5]["kept"]
    shards = {r["doc_id"]: r for r in extendible.assign_shards(docs, 1 << 20).collect()}
    assert shards[1]["bytes"] == len(long_rows[0][1]) and shards[1]["oversize"]
    near = {r["doc_id"]: r["component_id"] for r in parity_join.near_query(docs).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}
    mixed = {r["doc_id"]: r for r in mixing.mixing_query(docs).collect()}
    assert mixed[1]["size"] == 400_000 and all(r["taken"] <= 2 * r["size"] for r in mixed.values())
