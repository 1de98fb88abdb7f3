"""Rows with null or shared doc_ids in near deduplication."""

import random

from tidemark.llm import parity_join

SCHEMA = "doc_id bigint, text string"


def _words(rng, n):
    return [rng.choice("river stone light green house walk under early morning bright little cloud paper".split()) + str(rng.randrange(50)) for _ in range(n)]


def _near(words, k):
    return [*words[:k], "changed", *words[k + 1 :]]


def test_one_of_each_knows_rows_by_id_and_text(spark):
    rng = random.Random(11)
    a, b, c, d, e, f = (_words(rng, 200) for _ in range(6))
    text = " ".join
    rows = [
        (3, text(a)), (5, text(_near(a, 90))), (5, text(b)),  # one id on a near copy and on a text of its own
        (7, text(c)), (None, text(_near(c, 50))), (None, text(_near(c, 120))),  # near copies without an id
        (None, text(d)), (None, text(_near(d, 60))), (None, text(_near(d, 60))),  # a group without any id
        (9, text(e)), (9, text(_near(e, 70))), (9, text(e).upper()),  # near texts that share the group's id
        (1, text(f)), (1, text(f)), (None, ""), (None, None), (2, " "),
    ]
    left = [(r.doc_id, r.text) for r in parity_join.one_of_each(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]
    whole = [r for r in left if (r[1] or "").strip()]
    assert len(left) - len(whole) == 3
    assert len(whole) == 6
    assert (3, text(a)) in whole and (5, text(b)) in whole and (7, text(c)) in whole and (1, text(f)) in whole
    assert sum(r[0] is None for r in whole) == 1 and sum(r[0] == 9 for r in whole) == 1
