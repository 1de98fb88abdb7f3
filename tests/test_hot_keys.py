"""Hot symbols are many tasks and give the rows of one window: as-of joins, rolling features, drawdowns, running values."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, research, scans, temporal

START = dt.datetime(2024, 1, 1)


@pytest.fixture()
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def market(spark):
    rng = random.Random(2)
    rows = []
    for symbol, n in (("HOT", 700), ("A", 90), ("B", 30), (None, 5)):
        close = 50.0
        for k in range(n):
            close *= 1 + rng.uniform(-0.03, 0.031)
            rows.append((symbol, START + dt.timedelta(days=k), close * 0.99, close * 1.02, close * 0.97, close, rng.uniform(1, 9) if k % 11 else 0.0))
    return spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double").repartition(5)


def rounded(frame):
    kinds = dict(frame.dtypes)
    columns = [F.round(c, 9).alias(c) if kinds[c] == "double" else F.col(c) for c in frame.columns]
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


@pytest.mark.parametrize("hot_rows", [300, 40, 7])  # slices longer and shorter than the windows
@pytest.mark.parametrize("features", [bars.quant_features, bars.dataset_features, bars.regime_features, bars.forward_target, bars.three_day_labels, bars.us_equity_labels])
def test_features_in_slices(market, features, hot_rows, many_tasks):
    one, cut = features(market), features(market, hot_rows=hot_rows)
    assert cut.columns == one.columns
    assert rounded(cut) == rounded(one)


def test_slices_are_many_tasks(market, many_tasks):
    seen = []

    def features(rows):
        seen.append(rows.groupBy("symbol").count().agg(F.max("count"), F.count(F.lit(1))).first())
        return rows

    scans.sliced(market, features, 5, hot_rows=50)
    assert max(r[0] for r in seen) <= 90 and sum(r[1] for r in seen) > 14


def sides(spark, seed, n):
    rng = random.Random(seed)
    time = lambda: START + dt.timedelta(minutes=rng.randrange(6000))
    key = lambda: rng.choice(["HOT"] * 8 + ["x", "y", None])
    left = [(key(), time() if rng.random() > 0.02 else None, k) for k in range(n)]
    right = [(key(), time() if rng.random() > 0.02 else None, rng.choice([None, *range(6)]), k) for k in range(n)]
    return spark.createDataFrame(left, "key string, t timestamp_ntz, row int"), spark.createDataFrame(right, "key string, known timestamp_ntz, tie int, v int")


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("hot_rows", [400, 60, 5])
def test_asof_finds_hot_keys(spark, forward, hot_rows, many_tasks):
    left, right = sides(spark, hot_rows, 500)
    args = (left, right, ["key"], "t", "known", ["v", "tie"], ["tie", "v"])
    plain = temporal.asof_join(*args, forward=forward)
    dealt = temporal.asof_join(*args, forward=forward, hot_rows=hot_rows)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
    assert "bucket" in dealt._jdf.queryExecution().optimizedPlan().toString() and "bucket" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_spans_have_about_equal_rows(spark, many_tasks):
    left, right = sides(spark, 1, 3000)
    both = left.select(F.col("key").alias("k_key"), "t").unionAll(right.select("key", "known"))
    hot = scans.hot_keys(both, ["k_key"], 700)
    assert [r.k_key for r in hot.collect()] == ["HOT"]
    sizes = temporal._in_spans(both, ["k_key"], hot, F.unix_micros(F.col("t").cast("timestamp")), 700).filter("bucket >= 0").groupBy("bucket").count().collect()
    assert len(sizes) > 5 and max(r["count"] for r in sizes) < 950


def test_equity_as_a_scan(spark, many_tasks):
    rng = random.Random(3)
    rows = [(name, START + dt.timedelta(hours=k), rng.uniform(-0.05, 0.052) if k % 17 else None) for name, n in (("big", 900), ("small", 40), (None, 60)) for k in range(n)]
    frame = spark.createDataFrame(rows, "name string, timestamp timestamp_ntz, net_return double").repartition(4)
    for group in (["name"], ["name", "kind"]):
        own = frame.withColumn("kind", F.lit("k"))
        one, two = research.equity_curve(own, group), research.equity_curve(own, group, hot_rows=50)
        assert two.columns == one.columns and rounded(two) == rounded(one)


def test_running_values(spark, many_tasks):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}", k, rng.randrange(-99, 99), rng.uniform(0.9, 1.1)) for k in range(3000)]
    frame = spark.createDataFrame(rows, "key string, at bigint, a bigint, b double").repartition(6)
    got = scans.running(frame, "key", [F.col("at")], "test", {"a": "sum", "b": "product"})
    state, want = {}, {}
    for key, at, a, b in sorted(rows):
        n, s, p = state.get(key, (0, 0, 1.0))
        state[key] = want[key, at] = (n + 1, s + a, p * b)
    found = {(r.key, r["at"]): (r.run_place, r.run_a, r.run_b) for r in got.collect()}
    assert found.keys() == want.keys() and all(found[k][:2] == want[k][:2] and found[k][2] == pytest.approx(want[k][2]) for k in want)
    top = {(r.key, r["at"]): r.run_a for r in scans.running(frame, "key", [F.col("at")], "test", {"a": "max"}).collect()}
    peak = {}
    for key, at, a, _ in sorted(rows):
        peak[key] = max(peak.get(key, a), a)
        assert top[key, at] == peak[key]
    assert scans.running(frame.limit(0), "key", [F.col("at")], "none").count() == 0


@pytest.mark.parametrize("kind", ["normal", "few values", "one value", "long tail"])
def test_percentiles_by_counts(spark, kind):
    rng = random.Random(5)
    draw = {"normal": lambda: rng.gauss(0, 1), "few values": lambda: float(rng.randrange(4)), "one value": lambda: 7.0, "long tail": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-8, 8)}[kind]
    values = [draw() for _ in range(4001)] + [None] * 9
    frame = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    shares = [0.0, 0.1, 0.333, 0.5, 0.8, 1.0]
    want = frame.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0]
    for collected in (300, 10):
        assert scans.percentiles(frame, F.col("x"), shares, collected) == pytest.approx(want, rel=1e-12)
    assert scans.percentiles(frame.filter("x IS NULL"), F.col("x"), [0.5]) == [None]


def test_reports_of_large_frames(spark):
    rng = random.Random(6)
    rows = [(k, rng.gauss(0, 1), rng.gauss(0, 1), abs(rng.gauss(0.02, 0.01)), rng.uniform(-1, 1)) for k in range(900)]
    frame = spark.createDataFrame(rows, "k int, expected_return double, actual double, volatility_20 double, sentiment_mean double")
    assert rounded(research.bucket_summary(frame, "expected_return", "actual", hot_rows=10)) == rounded(research.bucket_summary(frame, "expected_return", "actual"))
    one, two = research.rank_opportunities(frame), research.rank_opportunities(frame, hot_rows=10)
    assert two.columns == one.columns and rounded(two) == rounded(one)
