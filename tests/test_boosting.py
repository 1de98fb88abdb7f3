"""Boosted trees against a plain booster, and the two ways of fitting against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.boosting import BoostConfig


def plain_booster(x, y, rounds, step, depth, least=20):
    """Trees by exhaustive search over all midpoints (or percentiles), in floating point."""
    edges = []
    for k in range(x.shape[1]):
        distinct = sorted(set(x[:, k].tolist()))
        mids = [(a + b) / 2 for a, b in zip(distinct, distinct[1:], strict=False)]
        if len(distinct) > 255:
            mids = sorted(set(np.percentile(x[:, k], np.linspace(0, 100, 256)[1:-1], method="midpoint").tolist()))
        edges.append(mids)
    guess, trees = np.full(len(y), y.mean()), []

    def grow(rows, rest, level):
        total = rest[rows].sum()
        best = (0.0, None)
        if level < depth:
            for k, mids in enumerate(edges):
                for t in mids:
                    left = rows[x[rows, k] <= t]
                    n, m = len(left), len(rows) - len(left)
                    if n < least or m < least:
                        continue
                    s = rest[left].sum()
                    gain = s * s / n + (total - s) ** 2 / m - total**2 / len(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, (k, t))
        if best[1] is None:
            return step * total / len(rows)
        k, t = best[1]
        return (k, t, grow(rows[x[rows, k] <= t], rest, level + 1), grow(rows[x[rows, k] > t], rest, level + 1))

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(rounds):
        tree = grow(np.arange(len(y)), y - guess, 0)
        guess = guess + np.array([value(tree, r) for r in x])
        trees.append(tree)
    return lambda rows: y.mean() + sum(np.array([value(t, r) for r in rows]) for t in trees)


def sample(seed, n, kinds=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, kinds))
    x[:, 0] = np.round(x[:, 0], 1)
    return x, 0.01 * (np.sin(2 * x[:, 0]) + (x[:, 1] > 0.3) * x[:, 2] + 0.3 * rng.normal(size=n))


@pytest.mark.parametrize(("n", "rounds"), [(60, 12), (130, 10), (400, 4)])
def test_equals_a_plain_booster(n, rounds):
    x, y = sample(n, n)
    fresh, _ = sample(n + 1, 50)
    model = boosting.fit_arrays(x, y, BoostConfig(rounds=rounds))
    want = plain_booster(x, y, rounds, 0.05, 3)
    assert model.predict(fresh) == pytest.approx(want(fresh), abs=1e-9)
    shuffled = np.random.default_rng(0).permutation(n)
    again = boosting.fit_arrays(x[shuffled], y[shuffled], BoostConfig(rounds=rounds))
    assert (again.feature == model.feature).all() and (again.threshold == model.threshold).all()


def test_learns_and_copes_with_constants():
    x, y = sample(5, 3000)
    model = boosting.fit_arrays(x[:2000], y[:2000])
    assert np.mean((y[2000:] - model.predict(x[2000:])) ** 2) < 0.4 * np.var(y[2000:])
    flat = boosting.fit_arrays(np.ones((60, 2)), np.full(60, 0.5), BoostConfig(rounds=3))
    assert flat.predict(np.zeros((2, 2))).tolist() == [0.5, 0.5]


def frame_of(spark, sizes):
    rows = []
    for k, n in enumerate(sizes):
        x, y = sample(10 + k, n)
        rows += [(f"s{k}", i, "train" if i < 0.7 * n else "test", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "symbol string, i int, part string, a double, b double, c double, y double").repartition(5)


def test_groups_in_tasks_and_grown_together_agree(spark):
    frame, config = frame_of(spark, [100, 300, 60, 450]), BoostConfig(rounds=12)
    columns = ["a", "b", "c"]
    of = lambda rows: {(r["symbol"], r["i"]): r["p"] for r in rows.collect()}
    one = of(boosting.boosted_predictions(frame, "symbol", columns, "y", "p", config))
    two = of(boosting.boosted_predictions(frame, "symbol", columns, "y", "p", config, group_rows=200))
    assert {k for k, _ in one} == {"s0", "s1", "s3"}  # s2 has 42 train rows
    assert two == pytest.approx(one, abs=1e-12)
    local = frame.filter("symbol = 's3'").toPandas().sort_values("i")
    train, test = local[local.part == "train"], local[local.part == "test"]
    model = boosting.fit_arrays(train[columns].to_numpy(), train.y.to_numpy(), config)
    assert [one["s3", i] for i in test.i] == pytest.approx(model.predict(test[columns].to_numpy()).tolist(), abs=1e-12)


def test_pooled(spark):
    frame = frame_of(spark, [300]).filter("part = 'train'")
    config = BoostConfig(rounds=11)
    a = boosting.fit_pooled(frame, ["a", "b"], "y", 210, config)
    b = boosting.fit_pooled(frame, ["a", "b"], "y", 210, config, group_rows=100)
    assert (a.feature == b.feature).all() and a.value == pytest.approx(b.value, abs=1e-15) and a.threshold == pytest.approx(b.threshold)
    out = boosting.predict_groups(frame.withColumn("g", F.lit(0)), "g", ["a", "b"], {0: a}, "p").toPandas()
    assert out.p.to_numpy() == pytest.approx(a.predict(out[["a", "b"]].to_numpy()))


def jobs_of(spark, work):
    spark.sparkContext.setJobGroup("counted", "")
    try:
        before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
        out = work()
        return out, len(set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_equal_rows_count_once_and_all_rounds_take_few_jobs(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 6, size=(3000, 2)).astype(float)
    y = 0.01 * np.sin(x[:, 0]) + 0.003 * rng.normal(size=3000)
    frame = spark.createDataFrame([(0, *map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "k int, a double, b double, y double").repartition(3)
    config = BoostConfig(rounds=60)
    models, jobs = jobs_of(spark, lambda: boosting.fit_large(frame, "k", ["a", "b"], "y", {0: 3000}, config, group_rows=500))
    want = boosting.fit_arrays(x, y, config)
    assert (models[0].feature == want.feature).all() and models[0].value == pytest.approx(want.value, abs=1e-12)
    assert jobs < 20  # before: four a round


def test_a_level_is_a_job(spark):
    frame = frame_of(spark, [300]).filter("part = 'train'").withColumn("k", F.lit(0))
    config = BoostConfig(rounds=21)
    models, jobs = jobs_of(spark, lambda: boosting.fit_large(frame, "k", ["a", "b", "c"], "y", {0: 210}, config, group_rows=100))
    rows = frame.toPandas()
    want = boosting.fit_arrays(rows[["a", "b", "c"]].to_numpy(), rows.y.to_numpy(), config)
    assert (models[0].feature == want.feature).all() and models[0].value == pytest.approx(want.value, abs=1e-12)
    assert jobs < 3 * 21 + 20


def test_sums_beyond_doubles_are_exact():
    rest = np.array([2**52 + 1, 2**52 + 1, -(2**53) - 3, 5, 2**54 + 1])
    rows = boosting._Rows(np.array([[0], [0], [0], [1], [1]], np.uint8), rest, np.array([1, 2, 3, 4, 5]))
    sums = rows.sums(rows.start(3), 0)
    assert sums[0, 0, 0, :2].tolist() == [-1, 2**54 + 6] and sums[1, 0, 0, :2].tolist() == [6, 9]
