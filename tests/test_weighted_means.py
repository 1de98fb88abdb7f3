"""Exponentially weighted means against the plain definition."""

import random

import pytest

from tidemark.operators import news


@pytest.mark.parametrize("span", [10, 3])
def test_every_event(spark, span):
    rng = random.Random(span)
    rows = [(asset, n, rng.uniform(-1, 1)) for asset, count in (("A", 500), ("B", 64), ("C", 65), ("D", 1), (None, 130), ("E", 9)) for n in range(1, count + 1)]
    frame = spark.createDataFrame(rows, "asset string, n int, sentiment double").repartition(3)
    got = {(r.asset, r.n): r.sentiment_ewm for r in news.weighted_means(frame, span).collect()}
    seen, want = {}, {}
    for asset, n, x in rows:
        seen.setdefault(asset, []).append(x)
        decay = 1 - 2 / (min(span, n) + 1)
        weights = [decay**k for k in range(n)]
        want[asset, n] = sum(w * v for w, v in zip(weights, reversed(seen[asset]), strict=True)) / sum(weights)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
