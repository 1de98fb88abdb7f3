"""Domain operators on hand-made tables with exact results."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import scalars
from tidemark.operators import audits, bars, facts, macro, models, news, panel, research, temporal
from tidemark.schema import require_columns


def day(n, hour=0, month=1, year=2024):
    return dt.datetime(year, month, 1) + dt.timedelta(days=n - 1, hours=hour)


@pytest.fixture(scope="module")
def ten(spark):
    rows = [("A", day(k), float(k), float(k) + 0.5, float(k) - 0.5, float(k), 100.0 + k) for k in range(10, 18)]
    return spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double")


def test_missing_columns_are_named(ten):
    with pytest.raises(ValueError, match=r"\['asset', 'value'\]"):
        require_columns(ten, ["symbol", "value", "asset"], "bars")


def test_asof_takes_the_last_known_and_allows_exact_times(spark):
    left = spark.createDataFrame([(1, "k", day(1)), (2, "k", day(3)), (3, "k", day(9)), (4, None, day(9)), (5, "z", day(9))], "i int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("k", day(3), 1, 10.0), ("k", day(3), 2, 20.0), ("k", day(5), 1, None), (None, day(2), 1, 7.0)], "k string, at timestamp_ntz, tie int, v double")
    for parts in (1, 4):
        out = temporal.asof_join(left.repartition(parts), right.repartition(parts), ["k"], "t", "at", ["v"], ["tie"])
        got = {r.i: (r.pit_time, r.pit_v) for r in out.collect()}
        assert got == {1: (None, None), 2: (day(3), 20.0), 3: (day(5), None), 4: (day(2), 7.0), 5: (None, None)}
    ahead = temporal.asof_join(left, right, ["k"], "t", "at", ["v"], ["tie"], forward=True)
    assert {r.i: r.pit_v for r in ahead.collect() if r.pit_time}.keys() == {1, 2}
    assert temporal.asof_join(left.limit(0), right, ["k"], "t", "at", ["v"]).count() == 0


def test_asof_never_sees_the_future(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(k, rng.choice("ab"), day(rng.randrange(1, 60), rng.randrange(24))) for k in range(300)], "i int, k string, decision_time timestamp_ntz")
    right = spark.createDataFrame([(rng.choice("ab"), day(rng.randrange(1, 60), rng.randrange(24)), float(k)) for k in range(200)], "k string, information_time timestamp_ntz, v double")
    out = temporal.asof_join(left, right, ["k"], "decision_time", "information_time", ["v"], ["v"])
    assert out.count() == 300
    temporal.assert_no_future_information(out)
    with pytest.raises(ValueError):
        temporal.assert_no_future_information(out.withColumn("pit_time", F.expr("decision_time + INTERVAL 1 DAY")))


@pytest.mark.parametrize("forward", [False, True])
def test_asof_in_buckets_is_the_same(spark, forward):
    rng = random.Random(17)
    when = lambda: rng.choice([None, day(1) + dt.timedelta(hours=rng.randrange(2000))])
    left = spark.createDataFrame([(k, rng.choice(["a", "b", None, "only left"]), when()) for k in range(300)], "id int, key string, t timestamp_ntz")
    right = spark.createDataFrame([(rng.choice(["a", "b", None, "only right"]), when(), rng.choice([None, rng.randrange(5)])) for _ in range(120)], "key string, known timestamp_ntz, v int")
    plain, dealt = (temporal.asof_join(left, right, ["key"], "t", "known", ["v"], ["v"], forward=forward, bucket_days=n) for n in (None, 3))
    key = lambda r: r.id
    assert sorted(plain.collect(), key=key) == sorted(dealt.collect(), key=key)
    assert plain.columns == dealt.columns


def test_written_tables_are_cleared(spark):
    out = session.written(spark.range(5).toDF("v"), "x")
    path = out.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    session.clear_written(spark)
    assert not os.path.exists(path)


def test_numbers_are_dense_and_ordered(spark):
    rows = spark.createDataFrame([(k,) for k in random.Random(2).sample(range(1000), 500)], "v int").repartition(7)
    out = temporal.number_decisions(rows, ["v"]).orderBy("v").collect()
    assert [r._decision_id for r in out] == list(range(500))


def test_numbers_keep_every_row_of_a_large_table(spark):
    rows = spark.range(0, 3_000_000, 1, 16).select(F.pmod(F.xxhash64("id"), F.lit(2_000_003)).alias("v"), F.col("id").alias("key"), F.md5(F.col("id").cast("string")).alias("more"))
    out = temporal.number_decisions(rows, ["v"])
    got = out.agg(F.count(F.lit(1)), F.count_distinct("_decision_id"), F.min("_decision_id"), F.max("_decision_id"), F.count_distinct("key")).first()
    assert tuple(got) == (3_000_000, 3_000_000, 0, 2_999_999, 3_000_000)
    again = out.select("_decision_id", "key").join(out.select("_decision_id", F.col("key").alias("other")), "_decision_id")
    assert again.filter("key <> other").isEmpty()


def test_events_without_sentiment_do_not_count(spark, ten):
    items = spark.createDataFrame([("A", day(11, 12), 0.8, 0.5), ("A", day(12, 12), None, 0.9), ("A", day(12, 13), float("nan"), 0.9)], "asset string, timestamp timestamp_ntz, sentiment double, credibility double")
    got = news.sentiment_state(ten, items).orderBy("timestamp").collect()
    assert (got[3].sentiment_mean, got[3].sentiment_count, got[3].source_credibility) == (0.8, 1, 0.5)


def test_bins_leave_out_pairs_without_an_outcome(spark):
    rows = spark.createDataFrame([(0.05, 1), (0.07, None), (0.95, 0), (1.5, 1), (None, 1)], "p double, y int")
    got = {r.bin: (r.rows, r.observed_rate) for r in research.probability_bins(rows, "p", "y").collect()}
    assert got[1] == (1, 1.0) and got[10] == (1, 0.0) and sum(n for n, _ in got.values()) == 2


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(float(k % 17), k) for k in range(300)] + [(3.0, 7)] * 5, "x double, k int")
    one, two = (research.bootstrap_mean(rows.repartition(n), "x", rounds=200).first() for n in (1, 5))
    assert tuple(one) == tuple(two) and one["low"] < one["mean"] < one["high"]


def test_cut_time_is_the_ranked_timestamp(spark):
    for n in (1, 2, 7, 90):
        times = [day(1) + dt.timedelta(hours=7 * k) for k in range(n)]
        frame = spark.createDataFrame([(t,) for t in times] * 2, "timestamp timestamp_ntz")
        assert research._cut_time(frame, 0.7).first()["_cut"] == times[min(max(int(n * 0.7), 1), n - 1)]


def test_ridge_walk_forward_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = x @ [0.5, -0.2, 0.1] + rng.normal(scale=0.3, size=400)
    times = [day(1) + dt.timedelta(hours=k) for k in range(400)]
    rows = [(t, "A", *map(float, x[k]), float(y[k]), t + dt.timedelta(hours=3)) for k, t in enumerate(times)] + [(day(1), "A", None, 1.0, 1.0, 1.0, day(2))]
    frame = spark.createDataFrame(rows, "timestamp timestamp_ntz, symbol string, a double, b double, c double, target_return double, target_timestamp timestamp_ntz")
    got = models.walk_forward_ridge(frame, ["a", "b", "c"], 200, 50, 50, cost_bps=5.0).orderBy("fold").collect()
    assert [r.fold for r in got] == [0, 1, 2, 3]
    for k, r in enumerate(got):
        train, test = slice(50 * k, 50 * k + 197), slice(50 * k + 200, 50 * k + 250)  # three targets reach into the test
        mean, spread = x[train].mean(axis=0), x[train].std(axis=0)
        z = (x[train] - mean) / spread
        w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y[train] - y[train].mean()))
        p = (x[test] - mean) / spread @ w + y[train].mean()
        gross = np.mean(np.sign(p) * y[test])
        assert (r.train_end, r.test_start, r.test_end, r.rows) == (times[50 * k + 196], times[50 * k + 200], times[50 * k + 249], 50)
        want = (np.abs(p - y[test]).mean(), 1 - np.mean((p - y[test]) ** 2) / y[test].var(), np.mean(np.sign(p) == np.sign(y[test])), gross, gross - 0.001)
        assert (r.mae, r.r2, r.directional_accuracy, r.mean_strategy_return, r.net_mean_strategy_return) == pytest.approx(want)
    assert models.walk_forward_ridge(frame, ["a"], 500, 50, 50).count() == 0
    with pytest.raises(ValueError):
        models.walk_forward_ridge(frame, ["a"], 0, 50, 50)


def test_symbols_have_ridge_models_of_their_own(spark):
    rows = [(s, day(1) + dt.timedelta(hours=k), float(k % 9), slope * (k % 9)) for s, slope, n in (("A", 1.0, 100), ("B", -2.0, 100), ("C", 1.0, 60)) for k in range(n)]
    got = models.fit_predict_ridge(spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, x double, target_return double"), ["x"]).collect()
    assert {r.symbol for r in got} == {"A", "B"} and len(got) == 60
    assert all(abs(r.expected_return - r.target_return) < 0.6 and r.signal == np.sign(r.expected_return) for r in got)


def test_experiments_refuse_few_rows(spark):
    rows = spark.createDataFrame([("A", day(1), 1.0, 0.1, day(2))] * 20, "symbol string, timestamp timestamp_ntz, x double, target_return double, target_timestamp timestamp_ntz")
    with pytest.raises(ValueError, match="usable"):
        models.run_experiment(rows, "few", ["x"])


def test_panel_refuses_two_bars_of_one_time(spark, ten):
    with pytest.raises(ValueError, match="duplicate"):
        panel.unified_panel(ten.unionAll(ten), *(spark.createDataFrame([], "x int") for _ in range(3)), [], [])


def test_features_are_carried_over_epochs_of_other_metrics(spark):
    early = quarters(range(10, 16))
    rows = [*early, (1, "assets", "USD", None, early[2][4], early[2][5] + dt.timedelta(days=9), 7.0), (1, "assets", "USD", None, early[4][4], early[5][5] + dt.timedelta(days=400), 8.0)]
    decisions = spark.createDataFrame([("a", 1, early[0][5] - dt.timedelta(days=1)), ("b", 1, early[2][5] + dt.timedelta(days=10)), ("c", 1, early[5][5] + dt.timedelta(days=500)), ("d", None, day(1))], "_decision_id string, cik bigint, decision_time timestamp_ntz")
    got = {r._decision_id: (r.sec_revenue_quarter, r.sec_assets_instant) for r in panel.sec_features(decisions, spark.createDataFrame(rows, FACTS), ["assets", "revenue"]).collect()}
    assert got == {"a": (None, None), "b": (12.0, 7.0), "c": (15.0, 8.0), "d": (None, None)}


def test_forward_labels(ten):
    rows = bars.forward_target(ten).orderBy("timestamp").collect()
    assert (rows[0].entry_price, rows[0].target_return, rows[0].entry_timestamp, rows[0].target_timestamp) == (11.0, 13 / 11 - 1, day(11), day(13))
    assert rows[-1].target_return is None and rows[-1].forward_positive == 0
    last = bars.three_day_labels(ten).orderBy("timestamp").collect()[-1]
    assert last.positive_3d_return is None and last.label_available is False


def test_sessions_follow_daylight_saving(spark):
    times = [dt.datetime(2024, 3, 8), dt.datetime(2024, 3, 11), dt.datetime(2024, 11, 4)]
    close, opening = scalars.session_times(F.col("t"))
    got = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").select(close, opening).collect()
    assert [tuple(r) for r in got] == [(dt.datetime(2024, 3, 8, 21), dt.datetime(2024, 3, 8, 14, 30)), (dt.datetime(2024, 3, 11, 20), dt.datetime(2024, 3, 11, 13, 30)), (dt.datetime(2024, 11, 4, 21), dt.datetime(2024, 11, 4, 14, 30))]


def test_quant_features_warm_up(ten):
    rows = bars.quant_features(ten, (3,)).orderBy("timestamp").collect()
    assert rows[0].return_1 is None and rows[1].return_1 == pytest.approx(0.1)
    assert rows[2].momentum_3 is None and rows[3].momentum_3 == pytest.approx(0.3)
    assert rows[1].distance_sma_3 is None and rows[2].distance_sma_3 == pytest.approx(12 / 11 - 1)
    assert rows[2].atr_3 == pytest.approx((1.0 + 1.5 + 1.5) / 3)


def test_news_window_bounds(spark, ten):
    items = spark.createDataFrame([("A", day(12), 0.5), ("A", day(11), 9.0), ("A", day(12, 1), -3.0), ("B", day(12), 7.0)], "asset string, timestamp timestamp_ntz, sentiment double")
    got = {r.timestamp: (r.news_count_24h, r.sentiment_mean_24h) for r in news.news_window(ten, items).collect()}
    assert got[day(12)] == (1, 0.5) and got[day(11)] == (1, 9.0) and got[day(13)] == (1, -3.0) and got[day(10)] == (0, 0.0)


def test_sentiment_state_and_event_study(spark, ten):
    items = spark.createDataFrame([("A", day(11, 12), 0.8), ("A", day(12, 12), -0.9)], "asset string, timestamp timestamp_ntz, sentiment double")
    got = news.sentiment_state(ten, items).orderBy("timestamp").collect()
    assert got[0].sentiment_mean is None and got[0].sentiment_count == 0
    assert got[2].sentiment_mean == 0.8 and got[3].sentiment_mean == -0.9 and got[3].sentiment_shock == pytest.approx(-0.85)
    decay = 1 - 2 / 3
    assert got[3].sentiment_ewm == pytest.approx((0.8 * decay - 0.9) / (decay + 1))
    study = news.event_study(spark.createDataFrame([("A", day(10, 10)), ("A", day(30)), ("Q", day(10))], "symbol string, timestamp timestamp_ntz"), ten, (1, 9)).collect()
    assert len(study) == 1 and study[0].base_time == day(11) and study[0].return_1 == pytest.approx(1 / 11) and study[0].return_9 is None


FACTS = "cik bigint, metric string, unit string, start timestamp_ntz, end timestamp_ntz, information_time timestamp_ntz, val_num double"


def quarters(values, late=45):
    ends = [dt.datetime(2022 + k // 4, 3 * (k % 4) + 3, 30) for k in range(len(values))]
    return [(1, "revenue", "USD", e - dt.timedelta(days=90), e, e + dt.timedelta(days=late), float(v)) for e, v in zip(ends, values, strict=True)]


def test_growth(spark):
    rows = quarters([100, 110, 120, 130, 150, 165])
    got = facts.derived_features(spark.createDataFrame(rows, FACTS)).orderBy("end").collect()
    assert got[1].qoq_growth == pytest.approx(0.1) and got[4].yoy_growth == pytest.approx(0.5)
    assert [g.ttm for g in got] == [None, None, None, 460.0, 510.0, 565.0]
    gap = facts.derived_features(spark.createDataFrame(rows[:2] + rows[3:], FACTS)).orderBy("end").collect()
    assert gap[2].qoq_growth is None and all(g.ttm is None for g in gap)


def test_canonical_tag_and_revisions(spark):
    schema = "cik bigint, tag string, unit string, start timestamp_ntz, end timestamp_ntz, information_time timestamp_ntz, val_num double, accn string"
    rows = [
        (1, "Revenues", "USD", day(1), day(90), day(100), 90.0, "a"), (1, "RevenueFromContractWithCustomerExcludingAssessedTax", "USD", day(1), day(90), day(100), 100.0, "a"),
        (1, "Revenues", "USD", day(1), day(90), day(130), 95.0, "b"), (1, "LongTermDebtCurrent", "USD", None, day(90), day(100), 5.0, "a"), (1, "Unknown", "USD", None, day(90), day(100), 1.0, "a"),
    ]
    got = {(r.metric, r.information_time): (r.val_num, r.period_type) for r in facts.resolve_observations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("revenue", day(100)): (100.0, "duration"), ("revenue", day(130)): (95.0, "duration"), ("debt_current", day(100)): (5.0, "instant")}


@pytest.mark.parametrize(("days", "kind"), [(69, "other_duration"), (70, "quarter"), (120, "quarter"), (121, "other_duration"), (150, "half_year"), (240, "nine_month"), (320, "annual"), (390, "annual"), (391, "other_duration")])
def test_duration_edges(spark, days, kind):
    row = facts.period_semantics(spark.createDataFrame([(1, "revenue", "USD", day(1), day(1) + dt.timedelta(days=days), day(1), 1.0)], FACTS)).first()
    assert row.duration_kind == kind and row.feature_name == f"sec_revenue_{kind}"


def test_panel_sees_the_revision_only_when_it_is_known(spark):
    rows = quarters([100, 110, 120, 130])
    revised = (*rows[3][:5], dt.datetime(2023, 3, 15, 12), 999.0)
    frame = spark.createDataFrame([*rows, revised, (1, "assets", "USD", None, dt.datetime(2022, 12, 31), dt.datetime(2023, 2, 1), 7.0)], FACTS)
    decisions = spark.createDataFrame([(0, 1, dt.datetime(2023, 3, 15, 11)), (1, 1, dt.datetime(2023, 3, 15, 12)), (2, None, dt.datetime(2023, 3, 15, 12)), (3, 1, dt.datetime(2000, 1, 1))], "_decision_id bigint, cik bigint, decision_time timestamp_ntz")
    got = {r._decision_id: r for r in panel.sec_features(decisions, frame, ["assets", "revenue"]).collect()}
    assert (got[0].sec_revenue_quarter, got[0].sec_revenue_ttm) == (130.0, 460.0) and (got[1].sec_revenue_quarter, got[1].sec_revenue_ttm) == (999.0, 1329.0)
    assert got[1].sec_assets_instant == 7.0 and got[1].sec_revenue_quarter_age_days == 0.0
    assert got[2].sec_revenue_quarter is None and got[3].sec_revenue_quarter is None and len(got) == 4


def test_macro_late_revision_of_an_older_date_does_not_displace_a_newer_one(spark):
    v = [("S", day(1), 100.0, day(10)), ("S", day(1), 101.0, day(20)), ("S", day(5), 110.0, day(15))]
    vintages = spark.createDataFrame(v, "series_id string, date timestamp_ntz, value double, realtime_start timestamp_ntz")
    decisions = spark.createDataFrame([(k, day(k, 9)) for k in (10, 11, 15, 16, 25)], "_decision_id bigint, decision_time timestamp_ntz")
    got = {r._decision_id: r.macro_S for r in macro.macro_wide(decisions, vintages, ["S"]).collect()}
    assert got == {10: None, 11: 100.0, 15: 100.0, 16: 110.0, 25: 110.0}
    raw = spark.createDataFrame([("EFFR", "2024-01-01", {"EFFR_20240105": "5.3", "EFFR_20240106": ".", "X_20240105": "1"})], "series_id string, date string, values map<string,string>")
    assert [r.value for r in macro.unpivot_vintages(raw).collect()] == [5.3]


def test_cross_section(spark):
    rows = [(s, day(1), v) for s, v in (("A", 4.0), ("B", 2.0), ("C", 2.0), ("D", 1.0), ("E", None))]
    got = {r.symbol: r.cross_rank for r in research.rank_cross_section(spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, s double"), "s").collect()}
    assert got == {"A": 1.0, "B": 0.625, "C": 0.625, "D": 0.25, "E": None}
    ten_rows = spark.createDataFrame([(str(k), day(1), float(k)) for k in range(10)], "symbol string, timestamp timestamp_ntz, s double")
    sides = research.top_bottom_portfolio(ten_rows, "s").groupBy("side").agg(F.sum("weight").alias("w")).collect()
    assert {r.side: round(r.w, 9) for r in sides} == {1: 1.0, -1: -1.0}


def test_backtest(ten):
    predicted = ten.withColumn("p", F.when(F.col("timestamp") == F.lit(day(10)).cast("timestamp_ntz"), 1.0).otherwise(float("nan")))
    rows = research.signals(predicted, "p", cost_bps=5).orderBy("timestamp").collect()
    assert (rows[0].entry, rows[0].exit, rows[0].signal) == (11.0, 13.0, 1) and rows[0].cost == pytest.approx(0.001)
    assert rows[1].signal == 0 and rows[1].net_return == 0.0
    assert research.portfolio(predicted, "p", most=1).agg(F.sum("longs")).first()[0] == 1


def test_drawdown_and_summary(spark):
    frame = spark.createDataFrame([("x", day(k), r) for k, r in enumerate((0.1, -0.5, 0.2, 0.0), 1)], "name string, timestamp timestamp_ntz, net_return double")
    row = research.summarize(frame, ["name"]).first()
    assert row.max_drawdown == pytest.approx(-0.5) and row.win_rate == 0.5 and row.observations == 4


def test_purged_split_keeps_targets_out_of_the_test(ten):
    frame = bars.forward_target(ten).select("symbol", "timestamp", "target_timestamp")
    got = {r.timestamp: r.part for r in research.purged_split(frame, 0.6, 1).collect()}
    assert [got[day(k)] for k in range(10, 18)] == [None, None, None, None, "test", "test", "test", "test"]
    got = {r.timestamp: r.part for r in research.purged_split(frame, 0.75).collect()}
    assert [got[day(k)] for k in range(10, 13)] == ["train", "train", "train"] and got[day(13)] is None


def test_gate_and_sizing(spark):
    results = spark.createDataFrame([("a", 50, 2.0, 0.1), ("b", 500, 0.5, 0.01), ("c", 500, None, 0.2)], "name string, rows int, sharpe double, mean_return double")
    assert research.select_candidate(results).first().name == "b"
    lit = lambda v: F.lit(float(v))
    sized = scalars.position_size(lit(100), lit(95), lit(115), lit(100_000), 0.5)
    row = spark.range(1).select(*(c.alias(n) for n, c in sized.items())).first()
    assert (row.quantity, row.risk_amount, row.reward_to_risk) == (100.0, 500.0, 3.0) and row.warnings == []
    future = scalars.position_size(lit(5000), lit(4990), lit(5020), lit(100_000), 1.0, None, 1.0, None, lit(50))
    assert spark.range(1).select(future["quantity"]).first()[0] == 2.0


def test_audits(spark, ten):
    assert audits.readiness(ten, 5, 1).first().status == "READY_WITH_WARNINGS" and audits.readiness(ten).first().status == "NOT_READY"
    broken = ten.unionAll(ten.limit(1)).withColumn("high", F.when(F.col("close") == 12, 1.0).otherwise(F.col("high")))
    row = audits.audit_bars(broken).first()
    assert (row.duplicate_keys, row.invalid_ohlc_rows, row.status) == (1, 1, "FAIL")
    assert audits.audit_bars(ten, "crypto").first().status == "PASS"
    master = spark.createDataFrame([("A", 1, "common_equity", True, False, True, False)], "symbol string, cik bigint, security_type string, is_common_equity boolean, is_etf boolean, is_leveraged boolean, is_inverse boolean")
    assert audits.validate_security_master(master).first().violations == "invalid_common_equity,leveraged_conflict"


def test_universe_map(spark):
    universe = spark.createDataFrame([("aapl.us",), ("MSFT",), ("NONE",)], "symbol string")
    entities = spark.createDataFrame([(1, "AAPL; aapl.x"), (2, "MSFT"), (3, "GOOG;MSFT")], "cik bigint, tickers string")
    got = {(r.symbol, r.cik): r.mapping_status for r in facts.universe_map(universe, entities).collect()}
    assert got == {("aapl.us", 1): "unique", ("MSFT", 2): "ambiguous", ("MSFT", 3): "ambiguous"}


def test_panel_master_and_context(spark):
    mapping = spark.createDataFrame([("aapl", 1, "unique"), ("MSFT", 2, "ambiguous"), ("SPY", None, "unique")], "symbol string, cik bigint, mapping_status string")
    symbols = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    got = {r.symbol: r.cik for r in audits.panel_master(mapping, symbols("AAPL", "SPY"), ("SPY",)).collect()}
    assert got == {"AAPL": 1, "SPY": None}
    with pytest.raises(ValueError, match="MSFT"):
        audits.panel_master(mapping, symbols("AAPL", "MSFT"))
    assert audits.universes(spark).filter("asset_class = 'crypto'").count() == 10
    with pytest.raises(ValueError):
        scalars.PortfolioContext(0.0).validate()
    sized = scalars.PortfolioContext(100_000.0, 0.5).size(F.lit(100.0), F.lit(95.0), F.lit(115.0))
    assert spark.range(1).select(sized["quantity"]).first()[0] == 100.0


def test_universe_profiles(spark):
    rows = spark.createDataFrame([("tqqq.us",), ("BRK-WS",), ("ABC_D",), ("AAPL",)], "symbol string")
    got = {r.symbol: r.why for r in rows.withColumn("why", audits.classify_profile(F.col("symbol"), "core_equity_etf")).collect()}
    assert got == {"tqqq.us": "profile_excluded_leveraged_inverse", "BRK-WS": "profile_excluded_non_common_pattern", "ABC_D": "profile_excluded_non_common_pattern", "AAPL": None}
    assert rows.filter(audits.classify_profile(F.col("symbol")).isNotNull()).isEmpty()
    with pytest.raises(ValueError):
        audits.classify_profile(F.col("symbol"), "other")


def test_sizing_refuses_bad_arguments():
    for bad in ({"risk_percent": 0}, {"risk_percent": 100}, {"cap_percent": 0}, {"cap_percent": 101}, {"increment": 0}):
        with pytest.raises(ValueError):
            scalars.position_size(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0), **bad)


def test_promotion_always_gives_a_row(spark):
    kind = "name string, rows bigint, mean_return double, sharpe double"
    none = research.promotion_decision(spark.createDataFrame([], kind)).first()
    assert (none.name, none.eligible, none.reasons) == (None, False, "no experiment results")
    good = research.promotion_decision(spark.createDataFrame([("a", 200, 0.1, 1.0), ("b", 200, 0.1, 2.0)], kind)).first()
    assert (good.name, good.eligible) == ("b", True) and good.reasons.startswith("passes")


def test_periods_without_any_match_come_back_empty(spark):
    seen = spark.createDataFrame(quarters([1, 2]), FACTS).withColumn("period_type", F.lit("duration"))
    decisions = spark.createDataFrame([(1, day(1, year=2023)), (9, day(1)), (None, day(1))], "cik bigint, decision_time timestamp_ntz")
    assert temporal.align_periods(decisions, seen).count() == 2
    none = temporal.align_periods(decisions.filter("cik = 9"), seen).collect()
    assert [(r.cik, r.metric, r.pit_val_num, r.available) for r in none] == [(9, None, None, False)]


def test_legacy_tags_put_all_debt_together():
    tags = facts.tag_metrics()
    assert tags["LongTermDebt"] == tags["LongTermDebtCurrent"] == "debt" and len(set(tags.values())) == 8


def test_fact_audits(spark):
    rows = spark.createDataFrame(quarters([1, 2]), FACTS).withColumns({"filed": F.col("information_time"), "tag": F.lit("t"), "accn": F.lit(None).cast("string"), "taxonomy": F.lit(None).cast("string"), "form": F.lit("10-Q")})
    row = audits.audit_facts(rows.unionAll(rows)).first()
    assert (row.rows, row.required_nulls.accn, row.required_nulls.cik, row.time_parse_failures, row.exact_duplicates, row.status) == (4, 4, 0, 0, 2, "PASS_WITH_WARNINGS")
    parts = audits.audit_company_facts(rows)
    assert parts["totals"].first().nulls.taxonomy == 2 and parts["taxonomies"].first().taxonomy == "NA" and parts["forms"].first().rows == 2


def test_diagnosis_has_the_interval(spark):
    rows = spark.createDataFrame([(float(k % 5), float(k % 7)) for k in range(100)] + [(None, 1.0)], "p double, a double")
    row = research.diagnose_predictions(rows, "p", "a", 200).first()
    assert row.pairs == 100 and row.low < row.mean_actual < row.high


def test_research_summary_and_card(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", -1.0), ("c", None)], "name string, sharpe double")
    assert tuple(models.research_summary(rows).first()) == (3, 1, "a", 1.0)
    models.ModelCard("m", ("x",), 5, {"mae": 0.1}).save(str(tmp_path / "cards" / "m.json"))
    assert '"mae": 0.1' in (tmp_path / "cards" / "m.json").read_text()


def test_asof_by_period_shuffles_no_grid_and_matches_the_merge(spark):
    rng = random.Random(4)
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)
    decisions = [(rng.choice([1, 2, 3, None]), day(rng.randrange(60)) if rng.random() > 0.05 else None, k) for k in range(80)]
    seen = [(rng.choice([1, 2, 4, None]), rng.choice("mn"), rng.choice([None, day(0)]), day(90), day(rng.randrange(50)) if rng.random() > 0.1 else None, rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(150)]
    seen.append((3, "only", None, day(90), None, 5.0))
    left = spark.createDataFrame(decisions, "cik int, decision_time timestamp_ntz, row int")
    right = spark.createDataFrame(seen, "cik int, metric string, start timestamp_ntz, end timestamp_ntz, information_time timestamp_ntz, val_num double")
    identity = ("metric", "start", "end")
    grid = left.join(right.select("cik", *identity).distinct(), "cik")
    want = temporal.asof_join(grid, right, ["cik", *identity], "decision_time", "information_time", ["val_num"], ["val_num"])
    for most in (0, 12, 64):
        got = temporal.asof_by_period(left, right, identity=identity, most_revisions=most)
        assert sorted(map(str, got.drop("available").collect())) == sorted(map(str, want.select(*got.drop("available").columns).collect()))
        assert got.filter("available <> (pit_time IS NOT NULL)").isEmpty()
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()  # before: a window over all rows of decisions and periods


def test_company_features_compute_observations_once(spark):
    rows = [(c, m, "USD", dt.datetime(2020 + k // 4, 1 + 3 * (k % 4), 1), dt.datetime(2020 + k // 4, 3 + 3 * (k % 4), 28), dt.datetime(2020 + k // 4, 3 + 3 * (k % 4), 28) + dt.timedelta(days=30), float(k)) for c in (1, 2) for m in ("revenue", "net_income") for k in range(9)]
    frame = spark.createDataFrame(rows, "cik int, metric string, unit string, start timestamp_ntz, end timestamp_ntz, information_time timestamp_ntz, val_num double")
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = panel.epoch_features(frame.mapInArrow(run, frame.schema)).collect()
    assert len(got) == 36 and seen.value == 36  # before: once a branch
    assert {r.ttm for r in got if r.cik == 1 and r.metric == "revenue"} == {None, *(4.0 * k - 6 for k in range(3, 9))}
