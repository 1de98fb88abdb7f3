"""Readers, parsers, sinks and streams."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import feeds, files
from tidemark.streaming import ingest


def test_market_directory(spark, tmp_path):
    head = "timestamp,open,high,low,close,volume,symbol\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_text(head + "2024-01-01,1,2,0.5,1.5,10,A\n2024-01-01,1,2,0.5,1.6,10,A\n2024-01-02,x,2,0.5,1.5,10,A\nbad,1,2,0.5,1.5,10,A\n2024-01-03,1,2,0.5,1.5,,A\n")
    (tmp_path / "b.csv").write_text(head + "2024-01-01,1,2,0.5,9.0,10,A\n2024-01-01,1,2,0.5,3,10,B\n")
    got = {(r.symbol, r.timestamp.day): r.close for r in files.load_market_directory(spark, str(tmp_path)).collect()}
    assert got == {("A", 1): 9.0, ("A", 3): 1.5, ("B", 1): 3.0}
    got = {(r.symbol, r.timestamp.day): r.close for r in files.load_market_csv(spark, str(tmp_path / "a" / "one.csv")).collect()}
    assert got[("A", 1)] == 1.6


def test_company_facts_and_submissions(spark, tmp_path):
    fact = {"end": "2023-12-31", "val": 5, "accn": "x", "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-02-01"}
    document = {"cik": 7, "entityName": "N", "facts": {"us-gaap": {"Assets": {"label": "l", "description": "d", "units": {"USD": [fact, fact]}}}}}
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("deep/CIK7.json", json.dumps(document))
        z.writestr("CIK8.json", json.dumps(document | {"cik": 8}))
    with zipfile.ZipFile(tmp_path / "f.zip") as z:
        z.extractall(tmp_path / "land")
    assert feeds.read_company_facts(spark, str(tmp_path / "land")).count() == 4
    rows = files.load_facts(feeds.read_company_facts(spark, str(tmp_path / "land"), [7])).collect()
    assert len(rows) == 2 and rows[0].val_num == 5.0 and rows[0].start is None and rows[0].end == dt.datetime(2023, 12, 31)
    filing = {"cik": 7, "name": "N", "tickers": ["A", "B"], "exchanges": ["X"], "filings": {"recent": {"accessionNumber": ["1", "2"], "acceptanceDateTime": ["2024-01-01T10:00:00Z", "t"], "filingDate": ["2024-01-01", "2024-01-02"], "form": ["8-K", "8-K"]}}}
    (tmp_path / "s.json").write_text(json.dumps(filing))
    raw = spark.read.schema(feeds.SUBMISSIONS).json(str(tmp_path / "s.json"))
    assert [r.accessionNumber for r in feeds.explode_submissions(raw).orderBy("position").collect()] == ["1", "2"]
    assert feeds.entity_master(raw).first().tickers == "A;B"
    assert files.acceptance_index(feeds.explode_submissions(raw)).filter("acceptance_time IS NULL").count() == 1


def test_small_feeds(spark, tmp_path):
    raw = spark.createDataFrame([("S", json.dumps({"observations": [{"date": "2024-01-01", "value": "."}, {"date": "2024-01-02", "value": "2.5"}]}))], "series_id string, body string")
    assert [r.value for r in feeds.parse_observations(raw).orderBy("timestamp").collect()] == [None, 2.5]
    klines = spark.createDataFrame([("BTC", json.dumps([[1704067200000, "1", "2", "0.5", "1.5", "9"]]))], "symbol string, body string")
    row = feeds.parse_klines(klines).first()
    assert row.timestamp == dt.datetime(2024, 1, 1) and (row.open, row.volume) == (1.0, 9.0)
    (tmp_path / "aapl.us.txt").write_text("<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>\nAAPL.US,D,20240102,000000,1,2,0.5,1.5,7,0\n")
    (tmp_path / "msft.us.txt").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,8\n")
    got = {r.symbol: (r.timestamp.day, r.close, r.volume) for r in feeds.read_price_files(spark, str(tmp_path)).collect()}
    assert got == {"aapl.us": (2, 1.5, 7.0), "msft.us": (2, 1.5, 8.0)}


def test_world_events(spark):
    cells = [""] * 61
    cells[0], cells[1], cells[26], cells[30], cells[34], cells[59], cells[60] = "9", "20240101", "010", "1.5", "-2", "20240101120000", "http://u"
    lines = spark.createDataFrame([("\t".join(cells), 1), ("\t".join(cells), 2), ("short", 1)], "value string, file int")
    events = feeds.dedupe_events(feeds.parse_events(lines), ["file"])
    row = events.first()
    assert events.count() == 1 and row.GoldsteinScale == 1.5 and row.availability_time == dt.datetime(2024, 1, 1, 12) and feeds.audit_events(events).first().status == "PASS"


def test_world_events_have_all_fields(spark):
    cells = [""] * 61
    cells[0], cells[1], cells[29], cells[30], cells[31], cells[32], cells[33], cells[34], cells[59] = "123", "20260902", "1", "2.5", "4", "2", "3", "1.2", "20260902153000"
    lines = spark.createDataFrame([("\t".join(cells),), ("a\tb",), ("",)], "value string")
    events = feeds.parse_events(lines)
    row = events.first()
    assert len(feeds.EVENT_FIELDS) == 61 == len(set(feeds.EVENT_FIELDS)) and len(events.columns) == 63
    assert (feeds.EVENT_FIELDS[0], feeds.EVENT_FIELDS[-1]) == ("GlobalEventID", "SOURCEURL")
    assert (row.GlobalEventID, row.QuadClass, row.NumMentions, row.NumSources, row.NumArticles, row.AvgTone, row.Actor1Name) == (123, 1, 4, 2, 3, 1.2, None)
    assert (row.event_date, row.availability_time) == (dt.date(2026, 9, 2), dt.datetime(2026, 9, 2, 15, 30))
    assert tuple(feeds.malformed_events(lines).first()) == (3, 2)


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for folder, close in (("x y", 1.0), ("z", 2.0)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "bars.csv").write_text(f"timestamp,open,high,low,close,volume,symbol\n2024-01-02,{close},{close},{close},{close},5,q\n")
    universe = spark.createDataFrame([(str(tmp_path / "x y" / "bars.csv"), "AA"), (str(tmp_path / "z" / "bars.csv"), "BB")], "path string, symbol string")
    got = files.load_market_for_universe(spark, universe, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)).collect()
    assert sorted((r.symbol, r.close) for r in got) == [("AA", 1.0), ("BB", 2.0)]


def test_selected_universe_leaves_out_leveraged_symbols(spark):
    names = ["spxl.us", "TNA", "AGQ.US", "SPXU", "AAPL", "MSFT.US"]
    rows = [(n, "True", "true", 1e6 - k, 100) for k, n in enumerate(names)] + [("GE", "false", "true", 9e9, 100)]
    frame = spark.createDataFrame(rows, "symbol string, selected string, eligible string, median_dollar_volume_lookback double, rows int")
    assert [r.symbol for r in files.selected_universe(frame).collect()] == ["SPXU", "AAPL", "MSFT.US"]


def test_sinks_and_synthetic_bars(spark, tmp_path):
    made = files.synthetic_bars(spark, ["A", "B"], 30)
    assert made.count() == 60 and made.filter("high < low").count() == 0
    assert made.orderBy("symbol", "timestamp").collect() == files.synthetic_bars(spark, ["A", "B"], 30).orderBy("symbol", "timestamp").collect()
    files.write_table(made.coalesce(1), str(tmp_path / "csv"), "csv")
    again = files.read_csv(spark, str(tmp_path / "csv"))
    report = files.manifest(spark, str(tmp_path / "csv" / "*.csv"), files.clean_bars(again).withColumn("_file", F.lit(again.select("_file").first()[0])))
    row = report.first()
    assert row.rows == 60 and row.symbols == "A;B" and len(row.sha256) == 64
    assert files.write_report(made.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "r.json")) == {"n": 60}


def test_streams(spark, tmp_path):
    rows = [(str(k % 5), dt.datetime(2024, 1, 1, 0, k), 1.0) for k in range(20)]
    spark.createDataFrame(rows, "id string, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    for name, frame, mode, count in (("once", ingest.dedupe_stream(stream, "id", "ts"), "append", 5), ("hours", ingest.windowed_counts(stream, "ts", ["id"], "10 minutes"), "complete", 10)):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        assert spark.table(name).count() == count
    seen = spark.createDataFrame([("1", dt.datetime(2024, 1, 1), 4.0)], "id string, information_time timestamp, v double")
    query = ingest.asof_stream(stream.withColumnRenamed("ts", "decision_time"), lambda: seen, str(tmp_path / "out"), str(tmp_path / "check"), ["id"], ["v"])
    query.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 20 and out.filter("pit_v = 4.0").count() == 4


def test_files_keep_rows_of_other_files(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text("timestamp,open,high,low,close,volume,symbol\n" + f"2024-01-02,1,1,1,{k + 1},5,A\n" * 2)
    assert sorted(r.close for r in files.load_market_files(spark, str(tmp_path)).collect()) == [1.0, 2.0]
    assert [r.close for r in files.load_market_directory(spark, str(tmp_path)).collect()] == [2.0]


def test_observation_and_vintage_loaders(spark):
    raw = spark.createDataFrame([("1", "assets", "USD", None, "2024-01-01", "2024-02-01", "5"), ("x", "assets", "USD", None, "2024-01-01", "2024-02-01", "5"), ("2", "cash", "USD", None, "2024-01-01", "2024-02-01", "6")], "cik string, metric string, unit string, start string, end string, information_time string, val_num string")
    assert [(r.cik, r.val_num, r.period_type) for r in files.load_observations(raw, [1, 2], ["assets"]).collect()] == [(1, 5.0, "duration")]
    vintages = spark.createDataFrame([("S", "2024-01-01", "1", "2024-01-05")], "series_id string, observation_date string, value string, realtime_start string")
    assert files.load_vintages(vintages).count() == 1
    with pytest.raises(ValueError, match="available_date_conservative"):
        files.load_vintages(vintages, strict=True)


def test_price_archive_and_manifests(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "20240105.export.zip", "w") as z:
        z.writestr("data/us/aa.us.txt", "<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>\nAA.US,D,20240102,000000,1,2,0.5,1.5,100,0\n")
        z.writestr("bb.us.csv", "Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,100\n")
    (tmp_path / "bars.txt").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,2.5,100\n")
    got = feeds.import_price_archive(spark, str(tmp_path / "20240105.export.zip"), str(tmp_path / "out"))
    assert got == {"imported": ["aa.us", "bb.us"], "imported_count": 2, "skipped": 0}
    assert {(r.symbol, r.close) for r in feeds.download_daily(spark, "AA", str(tmp_path / "bars.txt")).collect()} == {("AA", 2.5)}
    row = feeds.archive_manifest(spark, str(tmp_path / "*.zip")).first()
    assert row.day == dt.date(2024, 1, 5) and len(row.sha256) == 64
    assert feeds.event_archive_name(dt.date(2026, 9, 2)) == "20260902.export.CSV.zip"


def test_settings(monkeypatch):
    assert files.require_env("A", {"A": " x "}) == "x"
    with pytest.raises(ValueError):
        files.require_env("A", {})
