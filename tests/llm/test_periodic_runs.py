"""Periodic runs against a brute-force search by periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from tidemark.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24):
    """Every stretch that keeps a period and can't grow, less those that have a smaller one."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least, 3 * q):
                found.setdefault((start, length), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def looped(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = looped(doc_id, WORD.findall(text or ""))
    runs = brute(words)
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def texts():
    rng = random.Random(11)
    word = lambda n: f"w{rng.randrange(n)}"
    line = " ".join(word(30) for _ in range(9))
    out = [None, "", " \n\t ", "one", "a " * 23, "a " * 24, "a " * 2000, "a b " * 12, "x " + "a b c " * 9 + "a b y", "é 日本 🙂\x0b" * 40]
    out += [" ".join(word(k) for _ in range(200)) for k in (1, 2, 2, 3, 5)]  # few different words
    out += [f"{line}\n" * 8, f"{line} " * 2 + line, (f"{line} x " + f"{line} y ") * 5, f"{line} {word(9)} {line} {word(9)} {line}"]
    out.append(" ".join([("p q r " * 9), line, "p q r p q " * 6, line, ("s t " * 13 + "u ") * 5]))
    a, b = "a", "a b"  # a Fibonacci word, which is full of runs
    for _ in range(10):
        a, b = b, f"{b} {a}"
    out.append(b)
    for _ in range(40):  # loops in loops, with faults
        inner = [word(4) for _ in range(rng.randrange(1, 9))]
        words = [word(6)] + (inner * rng.randrange(2, 9) + [word(3)] * rng.randrange(3)) * rng.randrange(1, 7)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = word(9)
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def rows():
    own = texts()
    return [(k, t) for k, t in enumerate(own)] + [(1000 + 7 * k, t) for k, t in enumerate(own)] + [(None, own[8]), (3, own[8]), (3, own[8])]


def test_every_run(rows):
    words = [WORD.findall(t or "") for _, t in rows]
    assert periodic_runs.batch_runs(words) == [brute(w) for w in words]
    assert sum(map(len, map(brute, words))) > 150
    for least in (4, 7, 10):
        assert periodic_runs.batch_runs(words, least) == [brute(w, least) for w in words]


def test_query(spark, rows):
    frame = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], "doc_id bigint, text string, runs string, collapsed string").repartition(3)
    got = sorted((tuple(r) for r in periodic_runs.runs_query(frame).collect()), key=str)
    assert got == sorted((expected(d, t) for d, t in rows), key=str)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 5


def test_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 30000")  # brute force takes squares
    got = sorted(tuple(r) for r in periodic_runs.runs_query(docs).collect())
    assert got == sorted(expected(r["doc_id"], r["text"]) for r in docs.collect())


def test_very_long_text(spark):
    line = " ".join(f"w{k}" for k in range(50))
    text = " ".join(f"v{k}" for k in range(60_000)) + f" {line}" * 3000 + " end"
    row = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(60_000, 150_000, 50)] and len(row["collapsed"].split()) == 60_051


def test_empty_table_and_bad_length(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert periodic_runs.runs_query(empty).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(empty, least=3)
