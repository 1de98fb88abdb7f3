"""Market files are audited, catalogued and researched one by one, as they lie there."""

import json

import pytest

from tidemark import jobs
from tidemark.operators import audits
from tidemark.sources import files

HEAD = "timestamp,symbol,open,high,low,close,volume\n"


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "market"
    (root / "deep").mkdir(parents=True)
    (root / "clean.csv").write_text(HEAD + "2026-01-01,AAA,100,102,99,101,1000\n2026-01-02,AAA,101,103,100,102,1100\n")
    (root / "bad.csv").write_text(HEAD + "2026-01-01,AAA,100,99,98,100,1000\n2026-01-01,AAA,100,99,98,100,1000\n2026-01-02,AAA,x,103,100,102,5\n")
    (root / "binance_btcusdt_daily.csv").write_text(HEAD + "2020-03-12,BTCUSDT,7934.58,7966.17,4410,4800,1000\n2020-03-13,BTCUSDT,4800,5600,4300,5600,1200\n")
    # other columns in another order
    (root / "deep" / "adjusted.csv").write_text("symbol,timestamp,adjusted_close,close,low,high,open,volume\nBBB,2026-01-01,9,10,9,11,10,5\nBBB,2026-01-02,9,30,9,31,10,5\nCCC,2026-01-02,9,10,9,11,10,5\n")
    return str(root)


def test_audit_by_file(spark, folder, tmp_path, capsys):
    rows = {r.file.rsplit("/", 1)[1]: r for r in audits.audit_market_files(files.read_csv_folder(spark, folder)).collect()}
    of = lambda name: (rows[name].rows, rows[name].duplicate_keys, rows[name].invalid_ohlc_rows, rows[name].unreadable_rows, rows[name].extreme_return_rows, rows[name].has_adjusted_close, rows[name].asset_class, rows[name].status)
    assert of("clean.csv") == (2, 0, 0, 0, 0, False, "equity", "PASS_WITH_WARNINGS")
    assert of("bad.csv") == (3, 1, 2, 1, 0, False, "equity", "FAIL")
    assert of("binance_btcusdt_daily.csv") == (2, 0, 0, 0, 0, False, "crypto", "PASS")
    assert of("adjusted.csv") == (3, 0, 0, 0, 1, True, "equity", "PASS_WITH_WARNINGS")
    assert rows["clean.csv"].warnings == ["no adjusted close"] and rows["adjusted.csv"].symbols == 2

    class Args:
        market, out = folder, str(tmp_path / "report" / "audit.json")

    assert jobs._audit_market(spark, Args) == 2
    assert len(json.loads((tmp_path / "report" / "audit.json").read_text())) == 4 and "failures: 1; warnings: 2" in capsys.readouterr().out
    (tmp_path / "fine").mkdir()
    (tmp_path / "fine" / "a.csv").write_text(HEAD + "2026-01-01,AAA,100,102,99,101,1000\n")
    Args.market, Args.out = str(tmp_path / "fine"), ""
    assert jobs._audit_market(spark, Args) == 0
    (tmp_path / "none").mkdir()
    Args.market = str(tmp_path / "none")
    with pytest.raises(ValueError, match="no CSV"):
        jobs._audit_market(spark, Args)


def test_catalog_by_file(spark, folder, capsys):
    class Args:
        market, out = folder, ""

    assert jobs._catalog(spark, Args) == 0
    printed = capsys.readouterr().out
    assert printed.count("'file'") == 4 and "BBB;CCC" in printed


def test_universe_map_and_research(spark, tmp_path):
    (tmp_path / "universe.csv").write_text("symbol,selected\nAAA.US,True\nBBB.US,True\nCCC.US,False\nDDD.US,True\n")
    (tmp_path / "entities.csv").write_text("cik,entity_name,tickers,exchanges,sic,sicDescription\n1,One,AAA;A,X,1,d\n2,Two,bbb,X,1,d\n3,Three,BBB,X,1,d\n4,Four,,X,1,d\n")
    got = {(r.symbol, r.cik): r.mapping_status for r in jobs.universe_mapping(spark, str(tmp_path / "universe.csv"), str(tmp_path / "entities.csv")).collect()}
    assert got == {("AAA.US", 1): "unique", ("BBB.US", 2): "ambiguous", ("BBB.US", 3): "ambiguous"}
    bars = files.synthetic_bars(spark, ["A", "B"], 150)
    few = jobs.initial_research(jobs.supervised_dataset(bars), list(jobs.INITIAL_FEATURES)).collect()
    assert [(r.name, r.status) for r in few] == [("initial", "NOT_READY")] and few[0].metrics["symbols"] == 2 and few[0].warnings
    some = {r.name: r.metrics for r in jobs.initial_research(jobs.supervised_dataset(bars), list(jobs.INITIAL_FEATURES), least_train=100).collect()}
    assert set(some) == {"naive_zero", "ridge_quant"} and some["naive_zero"]["sign_accuracy"] == 0.0
    assert all(0 < m["mae"] <= m["rmse"] and m["rows_train"] > m["rows_test"] > 0 for m in some.values())
