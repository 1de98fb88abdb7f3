"""Composite jobs over small files."""

import datetime as dt

from tidemark import jobs
from tidemark.sources import feeds, files


def test_dataset_and_panel(spark, tmp_path):
    files.write_table(files.synthetic_bars(spark, ["A", "B"], 12).coalesce(1), str(tmp_path / "market"), "csv")
    (tmp_path / "news.csv").write_text("timestamp,asset,sentiment\n2024-01-02 00:00:00,A,0.5\n")
    data, ready = jobs.assemble_research_dataset(spark, str(tmp_path / "market"), str(tmp_path / "news.csv"))
    assert data.count() == 24 and data.agg({"news_count_24h": "sum"}).first()[0] == 1 and ready.first().status == "NOT_READY"
    (tmp_path / "observations.csv").write_text("cik,metric,unit,start,end,information_time,val_num\n1,assets,USD,,2023-12-31,2024-01-03 12:00:00,5\n")
    (tmp_path / "vintages.csv").write_text("series_id,observation_date,value,realtime_start,realtime_end\nEFFR,2023-12-01,5.3,2024-01-01,2024-01-31\n")
    (tmp_path / "master.csv").write_text("symbol,cik\nA,1\n")
    paths = {n: str(tmp_path / f"{n}.csv") for n in ("observations", "vintages", "master")} | {"market": str(tmp_path / "market")}
    panel = jobs.build_panel(spark, paths, ["assets"], ["EFFR"]).orderBy("symbol", "decision_time").collect()
    a = [r for r in panel if r.symbol == "A"]
    assert len(panel) == 18 and [r.sec_assets_instant for r in a][:4] == [None, None, 5.0, 5.0] and a[0].decision_time == dt.datetime(2024, 1, 1, 21)
    assert [r.macro_EFFR for r in a][:2] == [None, 5.3] and all(r.sec_assets_instant is None for r in panel if r.symbol == "B")


def test_fact_events(spark):
    fact = "cik string, tag string, unit string, start string, end string, filed string, accn string, val string"
    raw = spark.createDataFrame([("1", "Assets", "USD", None, "2023-12-31", "2024-02-01", "x", "5"), ("1", "Assets", "USD", None, "2023-12-31", "2024-02-05", "y", "6"), ("1", "Odd", "USD", None, "2023-12-31", "2024-02-01", "x", "5")], fact)
    filings = spark.createDataFrame([(1, "x", "2024-02-01 16:30:00", "2024-02-01", 0), (1, "x", "2024-02-01 17:30:00", "2024-02-01", 1)], "cik bigint, accessionNumber string, acceptanceDateTime string, filingDate string, position int")
    seen = jobs.canonical_observations(jobs.pit_fact_events(raw, filings))
    assert {r.information_time: r.val_num for r in seen.collect()} == {dt.datetime(2024, 2, 1, 17, 30): 5.0, dt.datetime(2024, 2, 5): 6.0}
    asked = spark.createDataFrame([(1, dt.datetime(2024, 2, 1)), (1, dt.datetime(2024, 2, 2)), (2, dt.datetime(2024, 3, 1))], "cik bigint, decision_time timestamp")
    assert [r.pit_val_num for r in jobs.asof_facts(seen, asked).collect()] == [5.0]


def test_event_archives_and_vintages(spark, tmp_path):
    cells = [""] * feeds.GDELT_FIELDS
    for k, ids in enumerate((("1", "2"), ("2", "3"))):
        rows = []
        for i in ids:
            cells[0], cells[1], cells[26], cells[59] = i, "20240101", "010", "20240101120000"
            rows.append("\t".join(cells))
        (tmp_path / f"{k}.tsv").write_text("\n".join(rows) + "\n")
    assert jobs.process_event_archives(spark, str(tmp_path / "*.tsv"), str(tmp_path / "out"), "plain_events") == {"files": 2, "output_rows": 3, "duplicate_ids": 1, "malformed_lines": 0, "damaged_files": 0}
    pages = {0: [{"date": "2024-01-01", "S_20240105": "1.5"}, {"date": "2024-01-02", "S_20240105": "."}], 2: [{"date": "2024-01-03", "S_20240106": "2"}]}
    got = jobs.macro_vintages(spark, lambda series, offset: pages[offset], {"S": "short"}, page=2).orderBy("date").collect()
    assert [(r.value, r.feature_name, r.available_date_conservative.day) for r in got] == [(1.5, "short", 6), (2.0, "short", 7)]
