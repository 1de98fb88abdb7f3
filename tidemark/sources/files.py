"""CSV, JSON and Parquet readers of the logical tables, and sinks."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import PANEL_LEVERAGED
from tidemark.functions.scalars import ticker_root
from tidemark.operators.bars import keep_last
from tidemark.operators.macro import with_availability
from tidemark.operators.temporal import latest_per
from tidemark.schema import MARKET_BAR, require_columns, to_number, to_time

BAR_COLUMNS = [part.split()[0] for part in MARKET_BAR.split(", ")]
PRICES = ("open", "high", "low", "close")


def data_root(env: dict | None = None) -> Path:
    """Folder of all data: ``TIDEMARK_DATA`` or ``data`` here."""
    return Path((env or os.environ).get("TIDEMARK_DATA", "data"))


def load_env(path: str) -> dict[str, str]:
    """``KEY=value`` lines of a file; variables that are set win."""
    found = {}
    for line in Path(path).read_text().splitlines():
        key, _, value = line.strip().partition("=")
        if key and not key.startswith("#"):
            found[key] = os.environ.get(key, value.strip().strip("\"'"))
    return found


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",", header: bool = True, recursive: bool = False) -> DataFrame:
    """All columns as strings plus ``_file`` and ``_line``, which ascends within a file's splits as they are read."""
    reader = spark.read.option("header", header).option("sep", sep).option("recursiveFileLookup", recursive).option("mode", "PERMISSIVE")
    if recursive:
        reader = reader.option("pathGlobFilter", "*.csv")
    return reader.csv(path).withColumns({"_file": F.col("_metadata.file_path"), "_line": F.monotonically_increasing_id()})


def csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file, header``: the CSV files below a folder with their first line, which tasks read."""
    from tidemark.sources.archives import first_line

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder).select("path")  # names only
    return listed.mapInArrow(first_line, "file string, header string")


def read_csv_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files below a folder as strings with ``_file`` and ``_line``, whatever order or set of columns each has; a column that a file lacks is null.

    ``_columns`` names the columns of the row's file.
    """
    found = csv_files(spark, folder).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()  # names, as any listing
    if not found:
        raise ValueError(f"no CSV files in {folder}")
    parts = []
    for row in sorted(found, key=lambda r: r["header"] or ""):
        names = [c.strip() for c in (row["header"] or "").split(",")]
        parts.append(read_csv(spark, row["files"]).toDF(*names, "_file", "_line").withColumn("_columns", F.array(*map(F.lit, names))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def clean_bars(raw: DataFrame, across_files: bool = True) -> DataFrame:
    """Numbers and times parsed, rows without time, price or symbol dropped, the last of equal keys kept."""
    require_columns(raw, BAR_COLUMNS, "bars")
    typed = raw.select(to_time("timestamp").alias("timestamp"), *(to_number(c).alias(c) for c in (*PRICES, "volume")), "symbol", *(c for c in ("_file", "_line") if c in raw.columns))
    full = typed.dropna(subset=["timestamp", *PRICES, "symbol"])
    place = [c for c in ("_file", "_line") if c in raw.columns]
    keys = ["symbol", "timestamp"] + ([] if across_files or "_file" not in place else ["_file"])
    return keep_last(full, keys, place or ["volume"]).select(*BAR_COLUMNS)


def load_market_csv(spark: SparkSession, path: str) -> DataFrame:
    return clean_bars(read_csv(spark, path))


def load_market_directory(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files below a folder; of one (symbol, time) the last file's row, by path, counts."""
    raw = read_csv(spark, folder, recursive=True)
    if raw.isEmpty():
        raise ValueError(f"no CSV files in {folder}")
    return clean_bars(raw)


def load_market_files(spark: SparkSession, folder: str) -> DataFrame:
    """As ``load_market_directory``, but only repeats within a file are dropped."""
    return clean_bars(read_csv(spark, folder, recursive=True), across_files=False)


def load_market_for_universe(spark: SparkSession, universe: DataFrame, start, end) -> DataFrame:
    """Bars of the universe's files under the universe's symbols, between two times (inclusive).

    A file is known by its whole path: rows carry the path as Spark names it, and so do the universe's entries.
    """
    listed = [r["path"] for r in universe.select("path").distinct().collect()]  # one entry per universe file
    plain = lambda c: F.regexp_replace(F.expr(f"url_decode(replace({c}, '+', '%2B'))"), "^file:/+", "/")
    raw = read_csv(spark, sorted(listed)).withColumn("_path", plain("_file"))
    names = universe.select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), F.col("symbol").alias("_symbol")).distinct()
    named = raw.join(names, "_path").withColumn("symbol", F.col("_symbol"))
    return clean_bars(named.select(*BAR_COLUMNS, "_file", "_line")).filter(F.col("timestamp").between(start, end))


def selected_universe(candidates: DataFrame, most: int = 25) -> DataFrame:
    """Selected, eligible, not leveraged; the most liquid ``most`` (the operator's own limit)."""
    true = lambda c: F.lower(F.trim(F.col(c).cast("string"))) == "true"
    rows = candidates.filter(true("selected") & true("eligible")).withColumn("symbol", F.upper(F.trim("symbol")))
    rows = rows.filter(~ticker_root(F.col("symbol")).isin(*PANEL_LEVERAGED))
    return rows.orderBy(F.desc("median_dollar_volume_lookback"), F.desc("rows"), "symbol").limit(most)


def load_facts(raw: DataFrame, ciks: DataFrame | None = None) -> DataFrame:
    """Company facts typed; with ``ciks`` only theirs (semi-join)."""
    typed = raw.withColumns({**{c: to_time(c) for c in ("start", "end", "filed")}, "cik": F.expr("try_cast(cik AS BIGINT)"), "val_num": to_number("val")})
    return typed.join(ciks.select("cik").distinct(), "cik", "left_semi") if ciks is not None else typed


def load_observations(raw: DataFrame, ciks: list[int] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """Canonical company observations typed, without rows that lack a key or value; ``period_type`` is duration where the table has none."""
    require_columns(raw, ["cik", "metric", "unit", "start", "end", "information_time", "val_num"], "observations")
    typed = raw.withColumns({"cik": F.expr("try_cast(cik AS BIGINT)"), **{c: to_time(c) for c in ("start", "end", "information_time")}, "val_num": to_number("val_num")})
    kept = typed.dropna(subset=["cik", "metric", "unit", "information_time", "end", "val_num"])
    if "period_type" not in raw.columns:
        kept = kept.withColumn("period_type", F.lit("duration"))
    if ciks is not None:
        kept = kept.filter(F.col("cik").isin(ciks))
    return kept.filter(F.col("metric").isin(metrics)) if metrics is not None else kept


def load_sec_map(spark: SparkSession, path: str) -> DataFrame:
    """The distinct ciks of a mapping file, to be joined with."""
    return read_csv(spark, path).select(F.expr("try_cast(cik AS BIGINT)").alias("cik")).filter("cik IS NOT NULL").distinct()


def load_vintages(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Vintages typed, ``observation_date`` taken for ``date``, availability filled (``strict``: required), rows without key dropped."""
    named = raw.withColumnRenamed("observation_date", "date") if "date" not in raw.columns else raw
    needed = ["series_id", "date", "value", "realtime_start"]
    require_columns(named, [*needed, "available_date_conservative"] if strict else needed, "vintages")
    times = [c for c in ("date", "realtime_start", "realtime_end", "available_date_conservative") if c in named.columns]
    typed = named.withColumns({**{c: to_time(c) for c in times}, "value": to_number("value")})
    return with_availability(typed.dropna(subset=["series_id", "date", "realtime_start"]))


def load_security_master(raw: DataFrame) -> DataFrame:
    from tidemark.operators.audits import validate_security_master

    flags = ("is_common_equity", "is_etf", "is_leveraged", "is_inverse", "is_adr")
    typed = raw.withColumns({**{c: F.expr(f"coalesce(try_cast(`{c}` AS BOOLEAN), false)") for c in flags}, **{c: to_time(c) for c in ("active_from", "active_to") if c in raw.columns}})
    verdict = validate_security_master(typed).first()
    if verdict["status"] != "PASS":
        raise ValueError(f"security master: {verdict['violations']}")
    return typed


def acceptance_index(submissions: DataFrame) -> DataFrame:
    """Last row of every (cik, accession) as a table to join with."""
    typed = submissions.select("cik", F.col("accessionNumber").alias("accn"), to_time("acceptanceDateTime").alias("acceptance_time"), to_time("filingDate").alias("filing_date"), "position")
    return latest_per(typed, ["cik", "accn"], [F.desc("position")])


# sinks ---------------------------------------------------------------------


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(fmt).save(path)


def write_report(row: DataFrame, path: str) -> dict:
    """One-row report as a JSON document."""
    found = row.limit(1).toJSON().first()
    document = json.loads(found) if found else {}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(document, indent=2, sort_keys=True))
    return document


def flatten_records(records: DataFrame, metrics: list[str]) -> DataFrame:
    """Experiment records ``name, status, metrics map, warnings array`` as a flat table."""
    return records.select("name", "status", *(F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics), F.array_join("warnings", "; ").alias("warnings"))


def append_journal(records: DataFrame, path: str) -> None:
    stamped = records if "recorded_at" in records.columns else records.withColumn("recorded_at", F.current_timestamp())
    stamped.write.mode("append").json(path)


def require_env(name: str, env: dict | None = None) -> str:
    value = (os.environ if env is None else env).get(name, "").strip()
    if not value:
        raise ValueError(f"{name} is not set")
    return value


def write_report_rows(rows: DataFrame, path: str) -> list[dict]:
    """A report of several rows as a JSON list; for reports, which are small by kind."""
    documents = [json.loads(r) for r in rows.toJSON().collect()]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(documents, indent=2, sort_keys=True))
    return documents


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """``file, length, sha256`` of the files of a pattern: a file is read as a stream in the task that it is dealt to, and is never one row; empty files are not listed."""
    from tidemark.sources.archives import digests

    listed = spark.read.format("binaryFile").load(pattern).select("path")  # names only
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return listed.repartition(tasks, "path").mapInArrow(digests, "file string, length bigint, sha256 string")


def manifest(spark: SparkSession, pattern: str, bars: DataFrame) -> DataFrame:
    """Per file: SHA-256 of its bytes beside rows, symbols and span of its bars (``bars`` has ``_file``); ``error`` where it has none."""
    files = file_digests(spark, pattern).withColumnRenamed("file", "_file")
    stats = bars.groupBy("_file").agg(F.count(F.lit(1)).alias("rows"), F.array_join(F.array_sort(F.collect_set("symbol")), ";").alias("symbols"), F.min("timestamp").cast("string").alias("start"), F.max("timestamp").cast("string").alias("end"))
    return files.join(stats, "_file", "left").withColumn("error", F.when(F.col("rows").isNull(), "no readable bars")).withColumnRenamed("_file", "file")


def synthetic_bars(spark: SparkSession, symbols: list[str], periods: int, seed: int = 7) -> DataFrame:
    """Seeded bars: a price per symbol that drifts by hashed steps."""
    grid = spark.range(periods).withColumnRenamed("id", "i").crossJoin(spark.createDataFrame([(s,) for s in symbols], "symbol string"))
    noise = lambda salt: (F.pmod(F.xxhash64("symbol", "i", F.lit(seed), F.lit(salt)), F.lit(20001)) - 10000) / 1e6
    base = 100 + F.pmod(F.xxhash64("symbol", F.lit(seed)), F.lit(50)) + F.col("i") * 0.05
    out = grid.withColumns({"timestamp": F.timestamp_seconds(F.lit(1704067200) + F.col("i") * 86400), "open": base * (1 + noise("o")), "close": base * (1 + noise("c"))})
    return out.withColumns({"high": F.greatest("open", "close") * 1.001, "low": F.least("open", "close") * 0.999, "volume": (1_000_000 + F.pmod(F.xxhash64("symbol", "i"), F.lit(500_000))).cast("double")}).select(*BAR_COLUMNS)
