"""Subword quality scores: a plain computation with the same weights, held-out accuracy, edge cases."""

import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import subword_quality as sq

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.01"


def plain_occurrences(text):
    """Trigrams, four-grams, words and pairs, one at a time, as strings."""
    words = WORD.findall(text)
    grams = [f" {w} "[k : k + n] for w in words for n in (3, 4) for k in range(len(w) + 3 - n)]
    return grams, words, list(zip(words, words[1:], strict=False))


def buckets_of(text):
    return [sorted(b.tolist()) for _, b in sq.occurrences(f" {text} ", np.zeros(1, np.int64))]


def test_occurrences_are_those_of_plain_reading():
    rng = random.Random(2)
    for _ in range(40):
        text = "".join(rng.choice("ab é日🙂\n\t  .") for _ in range(rng.randrange(60)))
        grams, words, pairs = plain_occurrences(text)
        three, four, own, two = buckets_of(text)
        assert len(three) + len(four) == len(grams) and len(own) == len(words) and len(two) == len(pairs)
        assert own == sorted(b for w in words for b in buckets_of(w)[2])
        assert three + four == sorted(b for w in words for b in buckets_of(w)[0]) + sorted(b for w in words for b in buckets_of(w)[1])
        assert two == sorted(b for u, v in pairs for b in buckets_of(f"{u} {v}")[3])
    assert buckets_of("one one")[3] == buckets_of("two two")[3] != buckets_of("one two")[3]


def test_scores_by_plain_sums():
    rng = np.random.default_rng(3)
    model = sq.SubwordModel(rng.integers(-(10**6), 10**6, sq.BUCKETS), 0.25)
    texts = ["", None, "a", "two words", "word " * 90_000, "x" * 700_000, "é 日本 🙂 " * 50, "ab\n" * 100_000 + "c"]
    want = []
    for text in texts:
        total = seen = 0
        for piece in sq.pieces(text or ""):
            for _, b in sq.occurrences(piece, np.zeros(1, np.int64)):
                total, seen = total + int(model.odds[b].sum()), seen + len(b)
        want.append(1 / (1 + np.exp(-(total / (sq.FIXED * max(seen, 1)) + 0.25))))
    got = model.scores(texts)
    assert got.tolist() == pytest.approx(want, abs=1e-12)
    assert got.tolist() == [float(model.scores([t])[0]) for t in texts]  # however texts are batched
    assert "".join(p[1:-1] for p in sq.pieces(texts[4])) == texts[4]


def test_held_out_accuracy_and_what_is_learned(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    clashing = docs.selectExpr("doc_id", "text", "1 AS score", "2 AS label", "3 AS held_out", "4 AS dice", "5 AS copy")
    got = {r["doc_id"]: r for r in sq.quality_query(clashing, labels).collect()}
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    tested = [d for d in truth if got[d]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for d, r in got.items())
    assert sum(got[d]["predicted"] == truth[d] for d in tested) / len(tested) > 0.96
    assert min(sum(truth[d] == k for d in tested) for k in (0, 1)) > 5
    # labels of held-out documents change nothing
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    again = {r["doc_id"]: r["score"] for r in sq.quality_query(docs.repartition(7), turned).collect()}
    assert again == {d: r["score"] for d, r in got.items()}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "some text"), (4, "some text"), (4, "some text"), (5, "long " * 300_000)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = sq.quality_query(docs, none).collect()
    assert len(rows) == 7 and {r["score"] for r in rows} == {0.5} and not any(r["held_out"] for r in rows if r["doc_id"] is None)
    odd = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (1, None), (5, 1), (5, 1), (99, 0)], "doc_id bigint, quality int")
    scores = [(r["doc_id"], r["score"]) for r in sq.quality_query(docs, odd).collect()]
    assert len(scores) == 7 and len({s for d, s in scores if d in (1, 2, 3)}) == 1 and len({s for d, s in scores if d in (4, None)}) == 1
    assert sq.quality_query(docs.limit(0), odd).count() == 0
