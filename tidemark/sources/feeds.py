"""Parsers of raw feeds: company facts, filings, macro observations, klines, price archives, world events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.temporal import latest_per
from tidemark.session import written
from tidemark.sources.archives import read_zip
from tidemark.sources.files import file_digests

FACT = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string,frame:string>"
COMPANY_FACTS = f"cik bigint, entityName string, facts map<string,map<string,struct<label:string,description:string,units:map<string,array<{FACT}>>>>>"
SUBMISSIONS = (
    "cik bigint, name string, tickers array<string>, exchanges array<string>, sic string, sicDescription string, "
    "filings struct<recent:struct<accessionNumber:array<string>,acceptanceDateTime:array<string>,filingDate:array<string>,form:array<string>>>"
)
# Fields of a world event in file order.
ACTOR = ("Code", "Name", "CountryCode", "KnownGroupCode", "EthnicCode", "Religion1Code", "Religion2Code", "Type1Code", "Type2Code", "Type3Code")
GEO = ("Type", "FullName", "CountryCode", "ADM1Code", "ADM2Code", "Lat", "Long", "FeatureID")
EVENT_FIELDS = (
    "GlobalEventID", "SQLDATE", "MonthYear", "Year", "FractionDate",
    *(f"Actor1{a}" for a in ACTOR), *(f"Actor2{a}" for a in ACTOR),
    "IsRootEvent", "EventCode", "EventBaseCode", "EventRootCode", "QuadClass", "GoldsteinScale", "NumMentions", "NumSources", "NumArticles", "AvgTone",
    *(f"Actor1Geo_{g}" for g in GEO), *(f"Actor2Geo_{g}" for g in GEO), *(f"ActionGeo_{g}" for g in GEO),
    "DATEADDED", "SOURCEURL",
)
EVENT_NUMBERS = {
    "bigint": ("GlobalEventID",),
    "int": ("MonthYear", "Year", "IsRootEvent", "QuadClass", "NumMentions", "NumSources", "NumArticles"),
    "double": ("FractionDate", "GoldsteinScale", "AvgTone", *(f"{who}Geo_{g}" for who in ("Actor1", "Actor2", "Action") for g in ("Lat", "Long"))),
}
GDELT_FIELDS = len(EVENT_FIELDS)


def explode_company_facts(raw: DataFrame) -> DataFrame:
    """One row per fact of the nested document (taxonomy, tag, unit, fact)."""
    a = raw.select("cik", F.col("entityName").alias("entity_name"), F.explode("facts").alias("taxonomy", "tags"))
    b = a.select("cik", "entity_name", "taxonomy", F.explode("tags").alias("tag", "body"))
    c = b.select("cik", "entity_name", "taxonomy", "tag", "body.label", "body.description", F.explode("body.units").alias("unit", "items"))
    d = c.select("*", F.explode("items").alias("f")).drop("items")
    return d.select("cik", "entity_name", "taxonomy", "tag", "label", "description", "unit", "f.start", "f.end", "f.filed", "f.form", "f.frame", "f.fy", "f.fp", "f.accn", "f.val")


def read_company_facts(spark: SparkSession, path: str, ciks: list[int] | None = None) -> DataFrame:
    raw = spark.read.schema(COMPANY_FACTS).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return explode_company_facts(raw.filter(F.col("cik").isin(ciks)) if ciks else raw)


def _documents(spark: SparkSession, archive: str, schema: str, ciks: list[int] | None) -> DataFrame:
    """``entry, doc, error`` of the JSON entries of archives; with ``ciks`` only the entries named after them are inflated as rows."""
    raw = read_zip(spark, archive, (".json",), whole=True)
    if ciks is not None:
        named = F.expr("try_cast(regexp_extract(entry, 'CIK0*([0-9]+)[^/]*$', 1) AS BIGINT)")
        raw = raw.filter(named.isin(ciks) | F.col("entry").isNull())
    parsed = raw.withColumn("doc", F.from_json("value", schema))
    # a text that is no JSON object gives a document without any field
    none = F.coalesce(F.to_json("doc"), F.lit("{}")) == "{}"
    return parsed.select("entry", "doc", F.when(F.col("error").isNull() & none, "no document").otherwise(F.col("error")).alias("error"))


def import_company_facts(spark: SparkSession, archive: str, out: str, ciks: list[int] | None = None) -> dict[str, int]:
    """Company facts of an archive of documents as Parquet rows; how many rows, documents, and entries that were skipped."""
    docs = written(_documents(spark, archive, COMPANY_FACTS, ciks), "company-facts")
    explode_company_facts(docs.filter("error IS NULL").select("doc.*")).write.mode("overwrite").parquet(out)
    counts = docs.agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad")).first()
    return {"rows": spark.read.parquet(out).count(), "documents": counts["good"], "skipped": counts["bad"]}


def import_submissions(spark: SparkSession, archive: str, filings: str, entities: str) -> dict[str, int]:
    """Recent filings of an archive of filers, and the filers themselves, as Parquet rows."""
    docs = written(_documents(spark, archive, SUBMISSIONS.replace("cik bigint", "cik string"), None), "submissions")
    good = docs.filter("error IS NULL").select("doc.*").withColumn("cik", F.expr("try_cast(cik AS BIGINT)"))
    explode_submissions(good).write.mode("overwrite").parquet(filings)
    entity_master(good).write.mode("overwrite").parquet(entities)
    return {"rows": spark.read.parquet(filings).count(), "entities": spark.read.parquet(entities).count(), "skipped": docs.filter("error IS NOT NULL").count()}


def explode_submissions(raw: DataFrame) -> DataFrame:
    """Parallel arrays of a filer's recent filings as rows, numbered by ``position``."""
    recent = "filings.recent"
    fields = ["accessionNumber", "acceptanceDateTime", "filingDate", "form"]
    zipped = F.arrays_zip(*(F.col(f"{recent}.{f}").alias(f) for f in fields))
    return raw.select("cik", F.posexplode(zipped).alias("position", "f")).select("cik", "position", *(F.col("f").getField(f).alias(f) for f in fields))


def entity_master(raw: DataFrame) -> DataFrame:
    return raw.select("cik", F.col("name").alias("entity_name"), F.array_join("tickers", ";").alias("tickers"), F.array_join("exchanges", ";").alias("exchanges"), "sic", "sicDescription")


def parse_observations(raw: DataFrame) -> DataFrame:
    """``series_id, body`` (JSON with observations): ``"."`` is a null value whose row stays."""
    schema = "observations array<struct<date:string,value:string>>"
    rows = raw.select("series_id", F.explode(F.from_json("body", schema)["observations"]).alias("o"))
    return rows.select(F.expr("try_cast(o.date AS TIMESTAMP_NTZ)").alias("timestamp"), F.expr("try_cast(o.value AS DOUBLE)").alias("value"), "series_id")


def parse_klines(raw: DataFrame) -> DataFrame:
    """``symbol, body`` (JSON array of arrays: open time in ms, then OHLCV as strings) as bars."""
    rows = raw.select("symbol", F.explode(F.from_json("body", "array<array<string>>")).alias("k"))
    number = lambda i: F.get("k", F.lit(i)).cast("double")
    return rows.select(F.timestamp_millis(F.get("k", F.lit(0)).cast("long")).cast("timestamp_ntz").alias("timestamp"), *(number(i + 1).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"))), "symbol")


def parse_prices(lines: DataFrame) -> DataFrame:
    """``value, symbol`` of price files as bars; both header dialects, dates yyyyMMdd or yyyy-MM-dd."""
    cells = lines.filter(~F.col("value").rlike("(?i)^<?(ticker|date)")).withColumn("c", F.split("value", ","))
    long = F.size("c") >= 9  # ticker, per, date, time, OHLCV, openint
    at = lambda short, wide: F.when(long, F.get("c", F.lit(wide))).otherwise(F.get("c", F.lit(short)))
    day = F.coalesce(F.try_to_timestamp(at(0, 2), F.lit("yyyyMMdd")), F.try_to_timestamp(at(0, 2), F.lit("yyyy-MM-dd")))
    prices = ("open", "high", "low", "close", "volume")
    typed = cells.select(day.cast("timestamp_ntz").alias("timestamp"), *(at(i + 1, i + 4).alias(c) for i, c in enumerate(prices)), "symbol")
    return typed.withColumns({c: F.expr(f"try_cast({c} AS DOUBLE)") for c in prices}).filter(F.col("timestamp").isNotNull())


def _ticker(path: str):
    return F.lower(F.regexp_extract(path, r"([^/]+)\.(?i:txt|csv)$", 1))


def read_price_files(spark: SparkSession, path: str) -> DataFrame:
    """Bars of price files below a folder, ticker from the file name."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).withColumn("_path", F.col("_metadata.file_path"))
    return parse_prices(lines.select("value", _ticker("_path").alias("symbol")))


def download_daily(spark: SparkSession, symbol: str, path: str) -> DataFrame:
    """Bars of one price file under the symbol as given."""
    return parse_prices(spark.read.text(path).withColumn("symbol", F.lit(symbol)))


def import_price_archive(spark: SparkSession, archive: str, out: str) -> dict:
    """Bars of an archive of price files by symbol; the symbols, how many there are, and entries that were skipped."""
    entries = read_zip(spark, archive, (".txt", ".csv"))
    parse_prices(entries.filter("error IS NULL").select("value", _ticker("entry").alias("symbol"))).write.mode("overwrite").partitionBy("symbol").parquet(out)
    symbols = sorted(r[0] for r in spark.read.parquet(out).select(F.col("symbol").cast("string")).distinct().collect())  # one name a file
    return {"imported": symbols, "imported_count": len(symbols), "skipped": entries.filter("error IS NOT NULL").count()}


def event_archive_name(day) -> str:
    """File name of a day's world-event archive."""
    return f"{day:%Y%m%d}.export.CSV.zip"


def archive_manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """Per archive: bytes, SHA-256 and the day in its name."""
    day = F.try_to_timestamp(F.regexp_extract("file", r"(\d{8})[^/]*$", 1), F.lit("yyyyMMdd")).cast("date")
    return file_digests(spark, pattern).select("file", "length", "sha256", day.alias("day"))


def parse_events(lines: DataFrame) -> DataFrame:
    """Tab-separated world events: all fields, the event date and the time of availability; empty fields are null.

    Lines of another number of fields are no events; ``malformed_events`` counts them.
    """
    cells = lines.withColumn("c", F.split("value", "\t", -1)).filter(F.size("c") == GDELT_FIELDS)
    kinds = {name: kind for kind, names in EVENT_NUMBERS.items() for name in names}
    field = lambda i, n: F.nullif(F.get("c", F.lit(i)), F.lit(""))
    number = lambda i, n: F.expr(f"try_cast(get(c, {i}) AS {kinds[n]})")
    named = cells.select(*((number if n in kinds else field)(i, n).alias(n) for i, n in enumerate(EVENT_FIELDS)), *(c for c in lines.columns if c != "value"))
    added = F.coalesce(F.try_to_timestamp("DATEADDED", F.lit("yyyyMMddHHmmss")), F.try_to_timestamp("DATEADDED", F.lit("yyyyMMdd")))
    return named.withColumns({"event_date": F.try_to_timestamp("SQLDATE", F.lit("yyyyMMdd")).cast("date"), "availability_time": added})


def malformed_events(lines: DataFrame) -> DataFrame:
    """One row: lines, and those that don't have the fields of an event."""
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.size(F.split("value", "\t", -1)) != GDELT_FIELDS).alias("malformed"))


def dedupe_events(events: DataFrame, order: list[str]) -> DataFrame:
    """One row per event id over all files: the first by file order."""
    return latest_per(events, ["GLOBALEVENTID"], [F.col(c) for c in order])


def audit_events(events: DataFrame) -> DataFrame:
    out = events.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("GLOBALEVENTID").alias("ids"), F.count_if(F.col("GLOBALEVENTID").isNull() | F.col("availability_time").isNull()).alias("bad_rows"), F.count_if(F.col("EventCode").isNull()).alias("missing_codes")
    )
    return out.withColumn("status", F.when((F.col("rows") == 0) | (F.col("bad_rows") > 0) | (F.col("ids") < F.col("rows")), "FAIL").otherwise("PASS"))
