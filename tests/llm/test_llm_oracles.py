"""Operators against their DuckDB SQL where the driver's small tables leave a branch untouched."""

import random

import duckdb

from tidemark.llm import extendible, host_rules

FOLDER = "/root/testdata/sf0.01"


def _rows(frame, columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.select(*columns).collect())


def test_shards_that_split(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    limit = 64 << 10
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet' WHERE strlen(coalesce(text, '')) <= {limit}")
    fitting = docs.filter(f"octet_length(coalesce(text, '')) <= {limit}")
    columns = ["doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_rows", "oversize"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({extendible.oracle(limit)})").fetchall())
    assert _rows(extendible.sharding_query(fitting, limit), columns) == want
    assert len({r[2] for r in want}) > 30 and len({r[3] for r in want}) > 1


def test_hosts_with_unlike_verdicts(spark):
    rng = random.Random(5)
    good = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(60))
    rows = []
    for host, n, share in (("all bad", 30, 1.0), ("mostly bad", 40, 0.8), ("even", 50, 0.5), ("mostly good", 40, 0.2), ("all good", 60, 0.0), ("one bad page", 1, 1.0), ("one good page", 1, 0.0), (None, 20, 0.9)):
        rows += [(len(rows) + k, "short text" if k < share * n else good(), host) for k in range(n)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({host_rules.ORACLE})").fetchall())
    got = _rows(host_rules.host_query(frame), columns)
    assert got == want
    of = {r[0]: r for r in got}
    lost = {host for doc, _, host in rows if not of[doc][6] and not of[doc][7]}
    assert lost == {"mostly bad", None}  # whole documents that go with their host
    assert {host for doc, _, host in rows if of[doc][7]} == {"even", "mostly good", "all good", "one good page"}
