"""ZIP entries as splits, imports straight from archives, and repeated ingest through the id index."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark import jobs
from tidemark.sources import archives, feeds
from tidemark.sources.id_index import IdIndex


def make(path, entries, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, content in entries.items():
            z.writestr(name, content)
    return str(path)


def damage(path, needle):
    raw = bytearray(open(path, "rb").read())
    at = raw.index(needle)
    raw[at : at + 4] = bytes(b ^ 0x5A for b in raw[at : at + 4])
    open(path, "wb").write(raw)


def test_entries_are_splits(spark, tmp_path):
    big = "\n".join(f"line {k} é" for k in range(70_000))
    entries = {"a/one.txt": "x\r\ny\n", "a/b/two.TXT": big, "skip.csv": "no", "empty.txt": "", "last.txt": "no end"}
    path = make(tmp_path / "one.zip", entries)
    got = archives.read_zip(spark, path, (".txt",), part_bytes=1)
    assert got.rdd.getNumPartitions() == 4 and got.filter("error IS NOT NULL").count() == 0
    rows = {(r.entry, r.line): r.value for r in got.filter("entry <> 'a/b/two.TXT'").collect()}
    assert rows == {("a/one.txt", 1): "x", ("a/one.txt", 2): "y", ("last.txt", 1): "no end"}
    two = got.filter("entry = 'a/b/two.TXT'").orderBy("line").collect()
    assert [r.value for r in two] == big.split("\n") and [r.line for r in two] == list(range(1, 70_001))
    whole = {r.entry: r.value for r in archives.read_zip(spark, path, (), whole=True).collect()}
    assert whole == entries


def test_damaged_entries_are_told(spark, tmp_path):
    path = make(tmp_path / "bad.zip", {"good.txt": "fine", "worse.txt": "ABCDEFGH" * 5, "also.txt": "fine too"}, zipfile.ZIP_STORED)
    damage(path, b"ABCDEFGH")
    (tmp_path / "broken.zip").write_bytes(b"not an archive at all")
    rows = archives.read_zip(spark, f"{tmp_path}/b*.zip").collect()
    assert {r.entry for r in rows if r.error is None} == {"good.txt", "also.txt"}
    assert [(r.entry, r.value) for r in rows if r.error and r.entry] == [("worse.txt", None)]
    assert [r.archive.split("/")[-1] for r in rows if r.entry is None] == ["broken.zip"]
    assert archives.read_zip(spark, f"{tmp_path}/none*.zip").count() == 0


def company(cik, value):
    fact = {"start": None, "end": "2023-12-31", "val": value, "accn": f"a{cik}", "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-02-01"}
    return json.dumps({"cik": cik, "entityName": f"E{cik}", "facts": {"us-gaap": {"Assets": {"label": "A", "description": "d", "units": {"USD": [fact, fact]}}}}})


def test_company_facts_and_filings_from_archives(spark, tmp_path):
    docs = {f"deep/CIK{k:010d}.json": company(k, 10.0 * k) for k in range(1, 5)} | {"deep/CIK0000000009.json": "{not json", "readme.txt": "x"}
    path = make(tmp_path / "facts.zip", docs)
    assert feeds.import_company_facts(spark, path, str(tmp_path / "facts")) == {"rows": 8, "documents": 4, "skipped": 1}
    assert feeds.import_company_facts(spark, path, str(tmp_path / "some"), ciks=[2, 3, 77]) == {"rows": 4, "documents": 2, "skipped": 0}
    assert {r.cik for r in spark.read.parquet(str(tmp_path / "some")).collect()} == {2, 3}
    filing = {"cik": "5", "name": "Five", "tickers": ["A", "B"], "exchanges": ["X"], "sic": "1", "sicDescription": "d", "filings": {"recent": {"accessionNumber": ["p", "q"], "acceptanceDateTime": ["2024-01-01T10:00:00Z", None], "filingDate": ["2024-01-01", "2024-01-02"], "form": ["10-K", "8-K"]}}}
    path = make(tmp_path / "filings.zip", {"CIK0000000005.json": json.dumps(filing)})
    assert feeds.import_submissions(spark, path, str(tmp_path / "filings"), str(tmp_path / "entities")) == {"rows": 2, "entities": 1, "skipped": 0}
    assert [(r.cik, r.position, r.accessionNumber) for r in spark.read.parquet(str(tmp_path / "filings")).orderBy("position").collect()] == [(5, 0, "p"), (5, 1, "q")]
    assert spark.read.parquet(str(tmp_path / "entities")).first().tickers == "A;B"


def test_prices_from_an_archive(spark, tmp_path):
    short = "Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\n"
    long = "<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>\nBB.US,D,20240103,000000,2,3,1,2.5,20,0\n"
    path = make(tmp_path / "prices.zip", {"data/us/AA.US.txt": short, "data/us/deep/bb.us.txt": long})
    assert feeds.import_price_archive(spark, path, str(tmp_path / "out")) == {"imported": ["aa.us", "bb.us"], "imported_count": 2, "skipped": 0}
    rows = {r.symbol: (r.timestamp, r.close, r.volume) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {"aa.us": (dt.datetime(2024, 1, 2), 1.5, 10.0), "bb.us": (dt.datetime(2024, 1, 3), 2.5, 20.0)}


def event(number, day="20240101"):
    cells = [""] * feeds.GDELT_FIELDS
    cells[0], cells[1], cells[26], cells[59] = str(number), day, "010", f"{day}120000"
    return "\t".join(cells)


def test_second_run_reads_only_new_archives(spark, tmp_path, monkeypatch):
    for day, ids in (("20240101", (1, 2, 2)), ("20240102", (2, 3))):
        make(tmp_path / f"{day}.export.CSV.zip", {f"{day}.export.CSV": "\n".join(event(i, day) for i in ids) + "\nbad line\n"})
    run = lambda: jobs.process_event_archives(spark, f"{tmp_path}/*.zip", str(tmp_path / "out"), "world_events")
    assert run() == {"files": 2, "output_rows": 3, "duplicate_ids": 2, "malformed_lines": 2, "damaged_files": 0}
    assert run() == {"files": 0, "output_rows": 0, "duplicate_ids": 0, "malformed_lines": 0, "damaged_files": 0}
    make(tmp_path / "20240103.export.CSV.zip", {"20240103.export.CSV": "\n".join(event(i, "20240103") for i in (3, 4, 1, 5))})
    stopped = RuntimeError("lost before the manifest")
    with monkeypatch.context() as patch:
        patch.setattr(IdIndex, "commit", lambda *a: (_ for _ in ()).throw(stopped))
        with pytest.raises(RuntimeError):
            run()
    assert run() == {"files": 1, "output_rows": 2, "duplicate_ids": 2, "malformed_lines": 0, "damaged_files": 0}
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.GlobalEventID for r in out.collect()) == [1, 2, 3, 4, 5]
    index = IdIndex(spark, "world_events")
    per_file = {r.file.split("/")[-1][:8]: (r.rows, r.new_ids, r.duplicate_ids) for r in index.manifest().collect()}
    assert per_file == {"20240101": (3, 2, 1), "20240102": (2, 1, 1), "20240103": (4, 2, 2)}
    before = sorted(r.id for r in index.ids().collect())
    index.compact()
    assert sorted(r.id for r in IdIndex(spark, "world_events").ids().collect()) == before == [1, 2, 3, 4, 5]
    assert len(spark.table("world_events").inputFiles()) <= index.buckets
    plan = index.fresh(spark.range(10).toDF("x"), "x").select("x")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert run()["files"] == 0 and F is not None


def test_digests_by_blocks(spark, tmp_path, monkeypatch):
    import hashlib

    from tidemark.sources import files

    content = bytes(range(256)) * 12_000  # about three blocks
    (tmp_path / "20240105.big").write_bytes(content)
    (tmp_path / "20240106.big").write_bytes(b"x")
    got = {r.file.rsplit("/", 1)[1]: (r.length, r.sha256) for r in files.file_digests(spark, f"{tmp_path}/*.big").collect()}
    assert len(content) > 2 * archives.BLOCK
    assert got == {"20240105.big": (len(content), hashlib.sha256(content).hexdigest()), "20240106.big": (1, hashlib.sha256(b"x").hexdigest())}
    assert {r.day for r in feeds.archive_manifest(spark, f"{tmp_path}/*.big").collect()} == {dt.date(2024, 1, 5), dt.date(2024, 1, 6)}


def test_vintages_are_fetched_by_series(spark, tmp_path):
    def client(series, offset):
        rows = [{"date": f"2024-01-{k + 1:02d}", f"{series}_20240201": str(k), f"{series}_20240301": "." if k % 2 else f"{k}.5"} for k in range(7 if series == "A" else 3)]
        return rows[offset : offset + 3]

    counts = jobs.download_macro_vintages(spark, client, str(tmp_path / "out"), {"A": "a rate", "B": "an index"}, page=3)
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert counts == {"rows": back.count(), "series": {"A": 11, "B": 5}}
    assert {(r.series_id, r.feature_name) for r in back.select("series_id", "feature_name").distinct().collect()} == {("A", "a rate"), ("B", "an index")}
    fetched = jobs.fetch_vintages(spark, client, ["A", "B"], 3)
    assert fetched.rdd.getNumPartitions() == 2 and fetched.count() == 10
