"""Boosted models per fold, per symbol and pooled; default experiments and their refusals."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.operators import boosting, models
from tidemark.operators.boosting import BoostConfig
from tidemark.operators.models import ExperimentConfig, ModelConfig

START = dt.datetime(2025, 1, 1)


def series(seed, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 0.02 * np.sign(x[:, 0]) + 0.01 * (x[:, 1] > 0.5) + 0.005 * rng.normal(size=n)
    return x, y, [START + dt.timedelta(hours=k) for k in range(n)]


def test_walk_forward_by_boosted_trees(spark):
    x, y, times = series(4)
    rows = [(t, "A", *map(float, x[k]), float(y[k]), t + dt.timedelta(hours=3)) for k, t in enumerate(times)] + [(START, "A", None, 1.0, 1.0, 1.0, START)]
    frame = spark.createDataFrame(rows, "timestamp timestamp_ntz, symbol string, a double, b double, c double, target_return double, target_timestamp timestamp_ntz")
    config = ModelConfig(rounds=15)
    for group_rows in (boosting.GROUP_ROWS, 100):  # fitted in tasks; grown together
        got = models.walk_forward_regression(frame, ["a", "b", "c"], 200, 50, 50, cost_bps=5.0, config=config, group_rows=group_rows).orderBy("fold").collect()
        assert [r.fold for r in got] == [0, 1, 2, 3]
        for k, r in enumerate(got):
            train, test = slice(50 * k, 50 * k + 197), slice(50 * k + 200, 50 * k + 250)  # three targets reach into the test
            p = boosting.fit_arrays(x[train], y[train], BoostConfig(rounds=15)).predict(x[test])
            gross = np.mean(np.sign(p) * y[test])
            assert (r.train_end, r.test_start, r.test_end, r.rows) == (times[50 * k + 196], times[50 * k + 200], times[50 * k + 249], 50)
            want = (np.abs(p - y[test]).mean(), 1 - np.mean((p - y[test]) ** 2) / y[test].var(), np.mean(np.sign(p) == np.sign(y[test])), gross, gross - 0.001)
            assert (r.mae, r.r2, r.directional_accuracy, r.mean_strategy_return, r.net_mean_strategy_return) == pytest.approx(want)
    assert models.walk_forward_regression(frame, ["a"], 500, 50, 50).count() == 0
    with pytest.raises(ValueError):
        models.walk_forward_regression(frame, ["a"], 0, 50, 50)


def test_a_model_for_each_symbol(spark):
    rows, want = [], {}
    for k, (symbol, n) in enumerate((("A", 120), ("B", 90), ("C", 79))):
        x, y, times = series(k, n)
        rows += [(symbol, t, *map(float, x[i]), float(y[i]), "kept") for i, t in enumerate(times)]
        cut = int(n * 0.7)
        if n >= 80:
            p = boosting.fit_arrays(x[:cut], y[:cut], BoostConfig(rounds=20)).predict(x[cut:])
            want |= {(symbol, times[cut + i]): v for i, v in enumerate(p.tolist())}
    frame = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, a double, b double, c double, target_return double, note string")
    got = models.fit_predict_oos(frame, ["a", "b", "c"], config=ModelConfig(rounds=20)).collect()
    assert {(r.symbol, r.timestamp): r.expected_return for r in got} == pytest.approx(want)
    assert all(r.signal == np.sign(r.expected_return) and r.note == "kept" for r in got)
    with pytest.raises(ValueError, match="enough rows"):
        models.fit_predict_oos(frame.filter("symbol = 'C'"), ["a"])
    with pytest.raises(ValueError, match="nothing"):
        models.fit_predict_oos(frame, ["nothing"])


def experiment_frame(spark, n=180, symbols=("AAA", "BBB")):
    rng = np.random.default_rng(3)
    names = ["ret_1", "ret_5", "close_to_ma10", "range_pct", "vol_10", "volume_ratio_20", "sentiment", "novelty", "trend_regime"]
    rows = []
    for s in symbols:
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        for k in range(n):
            t = START + dt.timedelta(days=k)
            rows.append((t, s, float(close[k] + rng.normal()), float(close[k]), float(rng.normal(0, 0.02)), t + dt.timedelta(days=3), *map(float, rng.normal(0, 1, len(names)))))
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, symbol string, open double, close double, target_return double, target_timestamp timestamp_ntz, " + ", ".join(f"{c} double" for c in names))


def test_default_specs():
    specs = models.default_experiment_specs(["ret_1", "vol_10", "sentiment", "trend_regime", "other"])
    assert specs == {"quant_only": ["ret_1", "vol_10"], "sentiment_only": ["sentiment"], "quant_plus_sentiment": ["ret_1", "vol_10", "sentiment"], "combined_regime": ["ret_1", "vol_10", "sentiment", "trend_regime"]}
    assert set(models.default_experiment_specs(["novelty"])) == {"sentiment_only", "combined_regime"}
    with pytest.raises(ValueError):
        models.default_experiment_specs(["trend_regime", "volume"])


def test_pooled_evaluation(spark):
    frame, config = experiment_frame(spark), ExperimentConfig(model=ModelConfig(rounds=5))
    row = models.evaluate_pooled(frame, ["ret_1", "ret_5"], config=config).first()
    one = models.run_experiment(frame, "x", ["ret_1", "ret_5"], config=config).first()
    assert row.symbols == 2 and row.asDict() == {"symbols": 2, **{k: v for k, v in one.asDict().items() if k != "name"}}
    with pytest.raises(ValueError, match="test|train"):
        models.evaluate_pooled(frame.filter(F.col("timestamp") < START + dt.timedelta(days=20)), ["ret_1"])
    with pytest.raises(ValueError, match="absent"):
        models.evaluate_pooled(frame, ["absent"])
    with pytest.raises(ValueError):
        models.run_experiment(frame, "none", [])


def test_suite_from_csv(spark, tmp_path):
    frame = experiment_frame(spark, 130)
    frame.toPandas().to_csv(tmp_path / "in.csv", index=False)
    out = jobs.run_suite_from_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "out" / "report.json"), ExperimentConfig(model=ModelConfig(rounds=3)))
    names = [r.name for r in out.collect()]
    assert sorted(names) == ["combined_regime", "quant_only", "quant_plus_sentiment", "sentiment_only"]
    saved = json.loads((tmp_path / "out" / "report.json").read_text())
    assert [r["name"] for r in saved] == names and list(saved[0]) == ["name", "rows", "mean_return", "sharpe", "max_drawdown", "win_rate", "directional_accuracy"]
    sharpes = [r["sharpe"] for r in saved if r["sharpe"] is not None]
    assert sharpes == sorted(sharpes, reverse=True)
    # bars alone get their features and target here
    bars = frame.select("timestamp", "symbol", "open", F.greatest("open", "close").alias("high"), F.least("open", "close").alias("low"), "close", F.lit(5.0).alias("volume"))
    bars.toPandas().to_csv(tmp_path / "bars.csv", index=False)
    again = jobs.run_suite_from_csv(spark, str(tmp_path / "bars.csv"), str(tmp_path / "bars.json"), ExperimentConfig(model=ModelConfig(rounds=3)))
    assert {r.name for r in again.collect()} == {"quant_only", "combined_regime"}


def counted(frame):
    """The frame, and a counter of its rows that were computed."""
    seen = frame.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(run, frame.schema), seen


def test_a_suite_computes_its_frame_once(spark):
    frame, seen = counted(experiment_frame(spark))
    config = ExperimentConfig(model=ModelConfig(rounds=3))
    rows = models.run_suite(frame, {"one": ["ret_1"], "two": ["ret_1", "vol_10"]}, config=config).collect()
    assert [r.name for r in rows] == ["one", "two"] and seen.value == 360
    with pytest.raises(ValueError, match="absent"):
        models.run_suite(frame, {"one": ["absent"]}, config=config)


def test_pooled_evaluation_computes_its_frame_few_times(spark):
    frame, seen = counted(experiment_frame(spark))
    models.evaluate_pooled(frame, ["ret_1"], config=ExperimentConfig(model=ModelConfig(rounds=3))).collect()
    assert seen.value <= 2 * 360  # for the cut and for the rows


def test_large_symbols_take_few_jobs(spark):
    rng = np.random.default_rng(6)
    rows = [(s, START + dt.timedelta(minutes=k), float(rng.integers(0, 40)), float(rng.normal())) for s in "AB" for k in range(600)]
    frame = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, x double, target_return double")
    context = spark.sparkContext
    context.setJobGroup("symbols", "")
    try:
        got = models.fit_predict_oos(frame, ["x"], config=ModelConfig(rounds=50), group_rows=200).collect()
        assert len(context.statusTracker().getJobIdsForGroup("symbols")) < 30  # before: four a round
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    for s in "AB":
        own = [r for r in rows if r[0] == s]
        x, y = np.array([[r[2]] for r in own]), np.array([r[3] for r in own])
        want = boosting.fit_arrays(x[:420], y[:420], BoostConfig(rounds=50)).predict(x[420:])
        found = [r.expected_return for r in sorted((r for r in got if r.symbol == s), key=lambda r: r.timestamp)]
        assert found == pytest.approx(want.tolist(), abs=1e-12)
