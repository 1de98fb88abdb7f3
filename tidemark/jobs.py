"""Composite jobs over files: dataset assembly, fact events, observations, the panel. ``python -m tidemark.jobs --help``."""

from __future__ import annotations

import argparse
import hashlib
import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import DEFAULT_SERIES
from tidemark.operators import audits, bars, facts, macro, models, news, panel, research, temporal
from tidemark.schema import require_columns, to_number, to_time
from tidemark.session import written
from tidemark.sources import archives, feeds, files
from tidemark.sources.id_index import IdIndex


def supervised_dataset(market: DataFrame, horizon: int = 3) -> DataFrame:
    return bars.forward_target(bars.dataset_features(market), horizon)


def assemble_research_dataset(spark: SparkSession, folder: str, news_csv: str | None = None, horizon: int = 3, lookback_hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """The supervised dataset of a folder of bars, with news when given, and its readiness row."""
    market = files.load_market_directory(spark, folder)
    data = supervised_dataset(market, horizon)
    if news_csv:
        raw = files.read_csv(spark, news_csv)
        numbers = [c for c in ("sentiment", "sentiment_change", "surprise") if c in raw.columns]
        items = raw.select(to_time("timestamp").alias("timestamp"), "asset", *(to_number(c).alias(c) for c in numbers)).dropna(subset=["timestamp", "asset"])
        data = news.news_window(data, items, lookback_hours)
    return data, audits.readiness(market)


def prepare_research_frame(market: DataFrame, sentiment: DataFrame | None = None, horizon: int = 3) -> DataFrame:
    frame = bars.forward_target(bars.regime_features(bars.quant_features(market)), horizon)
    return news.add_sentiment(frame, sentiment) if sentiment is not None else frame


def pit_fact_events(raw_facts: DataFrame, raw_submissions: DataFrame, ciks: DataFrame | None = None) -> DataFrame:
    """Facts with a metric and the time they became known; ``raw_submissions`` has ``position``."""
    typed = facts.with_metric(files.load_facts(raw_facts, ciks))
    index = files.acceptance_index(raw_submissions)
    return facts.attach_information_time(typed, index)


def canonical_observations(events: DataFrame) -> DataFrame:
    return facts.resolve_observations(events.dropna(subset=["cik", "information_time"]))


def asof_facts(observations: DataFrame, decisions: DataFrame) -> DataFrame:
    """For each decision the last known fact of every metric and unit of its entity; entities without facts drop out."""
    grid = decisions.dropna(subset=["cik", "decision_time"]).join(observations.select("cik", "metric", "unit").distinct(), "cik")
    return temporal.asof_join(grid, observations, ["cik", "metric", "unit"], "decision_time", "information_time", ["val_num", "start", "end"], ["end", "val_num"]).filter(F.col("pit_time").isNotNull())


def process_event_archives(spark: SparkSession, pattern: str, out: str, index: str = "world_event_ids") -> dict[str, int]:
    """New world-event files (archives or plain text) as Parquet by day, each event id once over all runs.

    Files that an earlier run committed to the id index are not read again.  A run writes a folder
    of its own, and what a lost run left there goes first, so it can be repeated at any time.  Counts are those of this run.
    """
    ids = IdIndex(spark, index)
    _drop_uncommitted(spark, out, ids)
    if pattern.endswith(".zip"):
        listed = spark.createDataFrame([(p,) for p in archives.matching(pattern)], "file string")
    else:
        listed = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("file"))  # names only
    paths = sorted(r["file"] for r in ids.pending(listed).collect())  # a name a file, as any listing
    if not paths:
        return {"files": 0, "output_rows": 0, "duplicate_ids": 0, "malformed_lines": 0, "damaged_files": 0}
    if pattern.endswith(".zip"):
        lines = archives.read_zip(spark, ",".join(paths)).withColumnRenamed("archive", "file")
    else:
        lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value", F.lit(None).cast("string").alias("error"))
    lines = written(lines.select("file", "line", "value", "error"), "event-lines")
    sound = lines.filter("error IS NULL")
    events = written(feeds.parse_events(sound.select("file", "line", "value")), "events")
    once = feeds.dedupe_events(events, ["file", "DATEADDED", "SOURCEURL", "line"])
    fresh = written(ids.fresh(once, "GlobalEventID"), "events-fresh")
    batch = hashlib.sha256("\n".join(paths).encode()).hexdigest()[:16]
    files.write_table(fresh.drop("line"), f"{out.rstrip('/')}/batch={batch}", partition_by=("event_date",))
    named = spark.createDataFrame([(p,) for p in paths], "file string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    count = lambda rows, name: rows.groupBy(plain("file").alias("_f")).agg(F.count(F.lit(1)).alias(name))
    per_file = named.withColumn("_f", plain("file")).join(count(events, "rows"), "_f", "left").join(count(fresh, "new_ids"), "_f", "left").fillna(0, ["rows", "new_ids"])
    per_file = written(per_file.withColumn("duplicate_ids", F.col("rows") - F.col("new_ids")), "event-files")
    ids.commit(batch, fresh.filter("GlobalEventID IS NOT NULL").select(F.col("GlobalEventID").alias("id")), per_file)
    sums = per_file.agg(F.sum("new_ids").alias("new"), F.sum("duplicate_ids").alias("twice")).first()
    return {
        "files": len(paths), "output_rows": sums["new"], "duplicate_ids": sums["twice"],
        "malformed_lines": feeds.malformed_events(sound).first()["malformed"], "damaged_files": lines.filter("error IS NOT NULL").select("file").distinct().count(),
    }


def _drop_uncommitted(spark: SparkSession, out: str, ids: IdIndex) -> None:
    """Folders of runs that were lost before their commit."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return
    good = {f"batch={r['batch']}" for r in ids.manifest().select("batch").distinct().collect()}  # a row a run
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("batch=") and name not in good:
            system.delete(status.getPath(), True)


def build_panel(spark: SparkSession, paths: dict[str, str], metrics: list[str], series: list[str] = tuple(DEFAULT_SERIES), session: str = "us_equity_daily") -> DataFrame:
    """The unified panel from files: ``market`` (folder), ``observations``, ``vintages``, ``master`` (CSV or Parquet)."""

    def table(name: str) -> DataFrame:
        return files.read_csv(spark, paths[name]) if paths[name].endswith(".csv") else spark.read.parquet(paths[name])

    market = files.load_market_directory(spark, paths["market"])
    raw = table("observations")
    observed = raw.select(F.expr("try_cast(cik AS BIGINT)").alias("cik"), "metric", "unit", *(to_time(c).alias(c) for c in ("start", "end", "information_time")), to_number("val_num").alias("val_num"))
    master = table("master").select("symbol", F.expr("try_cast(cik AS BIGINT)").alias("cik"))
    return panel.unified_panel(market, observed.dropna(subset=["cik", "metric", "end", "information_time"]), files.load_vintages(table("vintages")), master, metrics, list(series), session)


def fetch_vintages(spark: SparkSession, get: Callable[[str, int], list[dict]], series: list[str], page: int = 2000) -> DataFrame:
    """``series_id, date, values`` through ``get(series_id, offset)``, a caller's client that returns one page of wide rows.

    A series is a task, which pages until a short page and hands each page on; the client is sent to the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                offset = 0
                while True:
                    rows = get(name, offset)
                    values = [[(k, None if v is None else str(v)) for k, v in row.items() if k != "date"] for row in rows]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([row["date"] for row in rows], pa.string()), pa.array(values, pa.map_(pa.string(), pa.string()))], ["series_id", "date", "values"])
                    if len(rows) < page:
                        break
                    offset += len(rows)

    names = spark.createDataFrame([(s,) for s in series], "series_id string").repartition(max(len(series), 1))
    return names.mapInArrow(run, "series_id string, date string, values map<string,string>")


def macro_vintages(spark: SparkSession, get: Callable[[str, int], list[dict]], series: dict[str, str] = DEFAULT_SERIES, page: int = 2000) -> DataFrame:
    """Vintages of all series, typed, with their feature names and when they may be used."""
    long = macro.unpivot_vintages(fetch_vintages(spark, get, list(series), page))
    names = F.create_map(*(v for k, x in series.items() for v in (F.lit(k), F.lit(x))))
    typed = long.withColumn("date", to_time("date")).withColumn("feature_name", names[F.col("series_id")])
    return macro.with_availability(typed.dropDuplicates(["series_id", "date", "value", "realtime_start", "realtime_end"]))


def download_macro_vintages(spark: SparkSession, get: Callable[[str, int], list[dict]], out: str, series: dict[str, str] = DEFAULT_SERIES, page: int = 2000) -> dict[str, int]:
    """Write the vintages of all series as CSV; rows in all and by series. Each page is fetched once."""
    fetched = written(macro_vintages(spark, get, series, page), "vintages")
    files.write_table(fetched, out, "csv")
    counts = {r["series_id"]: r["n"] for r in fetched.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a series
    return {"rows": sum(counts.values()), "series": {s: counts.get(s, 0) for s in series}}


def portfolio_research(spark: SparkSession, folder: str, features: list[str], most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns of the equal-weight portfolio of out-of-sample predictions per symbol, and their summary."""
    market = files.load_market_files(spark, folder)
    frame = supervised_dataset(market)
    scored = models.fit_predict_oos(frame, features)
    returns = research.portfolio(scored, "expected_return", most=most)
    return returns, research.summarize(returns.withColumn("name", F.lit("portfolio")), ["name"])


def run_ladder(spark: SparkSession, folder: str, sentiment: DataFrame | None = None) -> DataFrame:
    """All feature sets of a folder of bars, best Sharpe ratio first."""
    return research.rank_experiments(models.run_suite(prepare_research_frame(files.load_market_directory(spark, folder), sentiment)))


def _show(rows: DataFrame) -> None:
    for row in rows.collect():  # reports have few rows
        print(row.asDict())


def _panel(spark, args) -> int:
    built = build_panel(spark, vars(args), args.metrics.split(","), session=args.session)
    files.write_table(built, args.out)
    files.write_report(audits.panel_report(spark.read.parquet(args.out), ["forward_return_3d"]), f"{args.out.rstrip('/')}.report.json")
    return 0


def _assess(spark, args) -> int:
    row = audits.readiness(files.load_market_directory(spark, args.market)).first()
    print(row.asDict())
    return 2 if row["status"] == "NOT_READY" else 0


def _events(spark, args) -> int:
    print(process_event_archives(spark, args.pattern, args.out, args.index))
    return 0


def _fact_events(spark, args) -> int:
    submissions = feeds.explode_submissions(spark.read.schema(feeds.SUBMISSIONS).option("multiLine", True).json(args.submissions))
    raw = feeds.read_company_facts(spark, args.facts).withColumn("val", F.col("val").cast("string"))
    files.write_table(pit_fact_events(raw, submissions, files.load_sec_map(spark, args.universe) if args.universe else None), args.out)
    return 0


def _observations(spark, args) -> int:
    events = spark.read.parquet(args.events)
    files.write_table(canonical_observations(events), args.out)
    print({"input_rows": events.count(), "output_rows": spark.read.parquet(args.out).count()})
    return 0


def _asof(spark, args) -> int:
    decisions = files.read_csv(spark, args.decisions).select(F.expr("try_cast(cik AS BIGINT)").alias("cik"), to_time("decision_time").alias("decision_time"))
    files.write_table(asof_facts(spark.read.parquet(args.observations), decisions), args.out)
    return 0


def _audit_facts(spark, args) -> int:
    row = audits.audit_facts(spark.read.parquet(args.events)).first()
    print(row.asDict(recursive=True))
    return 2 if row["status"] == "FAIL" else 0


def _diagnose(spark, args) -> int:
    _show(audits.duplicate_counts(spark.read.parquet(args.events)))
    return 0


def _audit_macro(spark, args) -> int:
    row = macro.audit_vintages(files.load_vintages(files.read_csv(spark, args.vintages))).first()
    print(row.asDict())
    return 2 if row["status"] == "FAIL" else 0


def _audit_market(spark, args) -> int:
    """Every file for itself, as it lies there; 2 where one fails."""
    rows = audits.audit_market_files(files.read_csv_folder(spark, args.market)).orderBy("file")
    found = files.write_report_rows(rows, args.out) if args.out else [r.asDict() for r in rows.collect()]  # a row a file
    for row in found:
        print(row)
    fails, warnings = (sum(r["status"] == s for r in found) for s in ("FAIL", "PASS_WITH_WARNINGS"))
    print(f"{len(found)} files audited; failures: {fails}; warnings: {warnings}")
    return 2 if fails else 0


def _catalog(spark, args) -> int:
    raw = files.read_csv_folder(spark, args.market).select(F.col("_file").alias("file"), "symbol", to_time("timestamp").alias("timestamp"))
    rows = audits.catalog(raw).orderBy("file")
    _show(rows)
    if args.out:
        files.write_table(rows, args.out, "csv")
    return 0


def universe_mapping(spark: SparkSession, universe: str, entities: str) -> DataFrame:
    """The selected symbols of a universe report with the entities whose tickers have their root."""
    report = files.read_csv(spark, universe)
    require_columns(report, ["selected", "symbol"], "universe report")
    selected = report.filter(F.lower(F.trim("selected")) == "true").select("symbol").distinct()
    known = files.read_csv(spark, entities).drop("_file", "_line").withColumn("cik", F.expr("try_cast(cik AS BIGINT)"))
    return facts.universe_map(selected, known.fillna("", ["tickers"]))


def _universe_map(spark, args) -> int:
    mapped = written(universe_mapping(spark, args.universe, args.entities), "universe-map")
    files.write_table(mapped, args.out, "csv")
    counts = mapped.agg(F.count_distinct("symbol").alias("mapped"), F.count_if(F.col("mapping_status") == "unique").alias("unique"), F.count_if(F.col("mapping_status") == "ambiguous").alias("ambiguous")).first()
    selected = files.read_csv(spark, args.universe).filter(F.lower(F.trim("selected")) == "true").select("symbol").distinct().count()
    print(counts.asDict() | {"selected": selected, "unmapped": selected - counts["mapped"]})
    return 0


INITIAL_FEATURES = ("ret_1", "ret_3", "ret_5", "vol_10", "close_to_ma10", "range_pct", "volume_ratio_20")


def initial_research(dataset: DataFrame, features: list[str], target: str = "target_return", least_train: int = 500) -> DataFrame:
    """Records ``name, status, metrics, warnings``: expecting nothing, and ridge regression, on the last 30 % of the rows by time and symbol."""
    known = [c for c in features if c in dataset.columns]
    usable = dataset.dropna(subset=[*known, target, "entry_price", "exit_price"])
    numbered = temporal.number_decisions(usable, ["timestamp", "symbol"])
    rows, symbols = numbered.agg(F.count(F.lit(1)), F.count_distinct("symbol")).first()
    spark, schema = dataset.sparkSession, "name string, status string, metrics map<string,double>, warnings array<string>"
    if rows < least_train + 1:
        return spark.createDataFrame([("initial", "NOT_READY", {"rows": float(rows), "symbols": float(symbols)}, [f"{least_train + 1} usable rows are needed"])], schema)
    cut = int(rows * 0.7)
    train, test = numbered.filter(F.col("_decision_id") < cut), numbered.filter(F.col("_decision_id") >= cut)
    scored = models.naive_zero(models.predict(models.fit_ridge(train, known, target), test, known, "ridge_quant"), "naive_zero")
    records = []
    for name in ("naive_zero", "ridge_quant"):
        a, p = F.col(target), F.col(name)
        sums = scored.agg(F.avg(F.abs(a - p)).alias("mae"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"), F.avg((F.signum(a) == F.signum(p)).cast("double")).alias("sign_accuracy")).first()
        records.append((name, "OK", {"rows_train": float(cut), "rows_test": float(rows - cut), **sums.asDict()}, []))
    return spark.createDataFrame(records, schema)


def _initial_research(spark, args) -> int:
    records = initial_research(supervised_dataset(files.load_market_directory(spark, args.market), args.horizon), list(INITIAL_FEATURES), least_train=args.least_train)
    files.write_report_rows(records, f"{args.out}/records.json")
    files.write_table(files.flatten_records(records, ["rows", "rows_train", "rows_test", "mae", "rmse", "sign_accuracy"]), f"{args.out}/summary", "csv")
    _show(records)
    return 0


def _manifest(spark, args) -> int:
    raw = files.read_csv_folder(spark, args.market).select("_file", "symbol", to_time("timestamp").alias("timestamp"))
    files.write_report_rows(files.manifest(spark, f"{args.market.rstrip('/')}/*.csv", raw.dropna(subset=["timestamp"])), args.out)
    return 0


def _company_facts(spark, args) -> int:
    ciks = [r["cik"] for r in files.load_sec_map(spark, args.universe).collect()] if args.universe else None  # a universe's list
    print(feeds.import_company_facts(spark, args.archive, args.out, ciks))
    return 0


def _submissions(spark, args) -> int:
    print(feeds.import_submissions(spark, args.archive, args.out, args.entities))
    return 0


def _audit_company_facts(spark, args) -> int:
    parts = audits.audit_company_facts(spark.read.parquet(args.facts), args.top)
    for part in parts.values():
        _show(part)
    return 2 if not parts["totals"].first()["rows"] else 0


def _audit_events(spark, args) -> int:
    row = feeds.audit_events(spark.read.parquet(args.events)).first()
    print(row.asDict())
    return 2 if row["status"] == "FAIL" else 0


def run_suite_from_csv(spark: SparkSession, source: str, out: str, config: models.ExperimentConfig = models.ExperimentConfig()) -> DataFrame:
    """The default experiments on a table of features and targets, or of bars, best Sharpe ratio first; also written as a JSON report."""
    raw = files.read_csv(spark, source)
    if "target_return" in raw.columns:
        times = [c for c in ("timestamp", "target_timestamp") if c in raw.columns]
        numbers = [c for c in raw.columns if c not in (*times, "symbol", "_file", "_line")]
        frame = raw.select("symbol", *(to_time(c).alias(c) for c in times), *(to_number(c).alias(c) for c in numbers))
    else:
        frame = supervised_dataset(files.clean_bars(raw), config.hold)
    frame = written(frame, "suite-frame")
    results = models.run_suite(frame, models.default_experiment_specs(frame.columns), config=config)
    ranked = [r.asDict() for r in research.rank_experiments(results).collect()]  # a row an experiment
    Path(out).parent.mkdir(parents=True, exist_ok=True)
    Path(out).write_text(json.dumps(ranked, indent=2))
    return spark.createDataFrame([tuple(r.values()) for r in ranked], results.schema)


def _suite(spark, args) -> int:
    _show(run_suite_from_csv(spark, args.source, args.out))
    return 0


def _universe(spark, args) -> int:
    stats = audits.universe_statistics(files.load_market_directory(spark, args.market))
    files.write_table(audits.screen_universe(stats, most=args.most, profile=args.profile), args.out, "csv")
    return 0


def _experiments(spark, args) -> int:
    results = run_ladder(spark, args.market)
    files.write_table(results, args.out, "csv")
    _show(research.promotion_decision(results))
    return 0


def _portfolio(spark, args) -> int:
    returns, summary = portfolio_research(spark, args.market, args.features.split(","), args.most)
    files.write_table(returns, args.out)
    _show(summary)
    return 0


def _price_archive(spark, args) -> int:
    print(feeds.import_price_archive(spark, args.archive, args.out))
    return 0


#: Job, what runs it, its positional arguments, its options with defaults.
JOBS = {
    "panel": (_panel, (), {"market": None, "observations": None, "vintages": None, "master": None, "out": None, "metrics": "assets,revenue,net_income", "session": "us_equity_daily"}),
    "assess": (_assess, ("market",), {}),
    "events": (_events, ("pattern", "out"), {"index": "world_event_ids"}),
    "fact-events": (_fact_events, ("facts", "submissions", "out"), {"universe": ""}),
    "observations": (_observations, ("events", "out"), {}),
    "asof": (_asof, ("observations", "decisions", "out"), {}),
    "audit-facts": (_audit_facts, ("events",), {}),
    "diagnose-duplicates": (_diagnose, ("events",), {}),
    "audit-macro": (_audit_macro, ("vintages",), {}),
    "audit-market": (_audit_market, ("market",), {"out": ""}),
    "catalog": (_catalog, ("market",), {"out": ""}),
    "manifest": (_manifest, ("market", "out"), {}),
    "universe-map": (_universe_map, ("universe", "entities", "out"), {}),
    "company-facts": (_company_facts, ("archive", "out"), {"universe": ""}),
    "submissions": (_submissions, ("archive", "out", "entities"), {}),
    "audit-company-facts": (_audit_company_facts, ("facts",), {"top": 20}),
    "audit-events": (_audit_events, ("events",), {}),
    "initial-research": (_initial_research, ("market", "out"), {"horizon": 3, "least_train": 500}),
    "suite": (_suite, ("source", "out"), {}),
    "universe": (_universe, ("market", "out"), {"most": 500, "profile": "core_equity_etf"}),
    "experiments": (_experiments, ("market", "out"), {}),
    "portfolio": (_portfolio, ("market", "out"), {"features": "ret_1,ret_3,ret_5,vol_10", "most": 5}),
    "price-archive": (_price_archive, ("archive", "out"), {}),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, (_, places, options) in JOBS.items():
        one = jobs.add_parser(name)
        for place in places:
            one.add_argument(place)
        for option, default in options.items():
            one.add_argument(f"--{option}", default=default, required=default is None, type=type(default) if default is not None else str)
    args = parser.parse_args(argv)
    from tidemark.session import build_session

    return JOBS[args.job][0](build_session(f"tidemark-{args.job}"), args)


if __name__ == "__main__":
    raise SystemExit(main())
