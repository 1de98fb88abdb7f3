"""What counts as a repeated fact at each grain."""

from pyspark.sql import functions as F

from tidemark.operators import audits, facts

SCHEMA = "cik bigint, taxonomy string, tag string, metric string, unit string, start string, end string, filed timestamp_ntz, form string, accn string, val string, val_num double, information_time timestamp_ntz"


def rows(spark):
    base = (1, "us-gaap", "Assets", "assets", "USD", None, "2024-12-31", "10-K", "a", "100", 100.0)
    changed = [{}, {}, {7: "10-K/A"}, {1: "ifrs"}, {2: "AssetsOther"}, {8: "b"}, {9: "100.0"}]
    data = []
    for change in changed:
        row = [change.get(k, v) for k, v in enumerate(base)]
        data.append((*row[:7], "2025-02-01", *row[7:], "2025-02-01 18:00:00"))
    data.append((*base[:7], "2025-03-01", *base[7:], "2025-02-01 18:00:00"))  # filed differs
    schema = SCHEMA.replace("timestamp_ntz", "string")
    frame = spark.createDataFrame(data, schema)
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("filed", "information_time")})


def test_grains(spark):
    counts = {r["grain"]: (r["rows"], r["duplicates"]) for r in audits.duplicate_counts(rows(spark)).collect()}
    # rows that differ in form, filed, taxonomy, tag, accession or value are no source duplicates
    assert counts == {"source_exact": (8, 1), "metric_alias": (8, 6), "economic": (8, 7)}
    row = audits.audit_facts(rows(spark)).first()
    # the filing key has no tag or taxonomy
    assert (row.exact_duplicates, row.economic_duplicates, row.status, len(row.warnings)) == (3, 7, "PASS_WITH_WARNINGS", 2)
    assert audits.duplicate_samples(rows(spark)).count() == 1


def test_resolve_report_counts_all_members(spark):
    frame = rows(spark)
    eligible = facts.with_metric(frame)
    row = facts.resolve_report(frame, eligible, facts.resolve_observations(frame)).first()
    # every row of a repeated source identity counts, not all but one
    assert (row.input_rows, row.eligible_rows, row.output_rows, row.rows_reduced, row.ciks) == (8, 8, 1, 7, 1)
    assert (row.collision_rows, row.exact_source_duplicates) == (8, 6)


def test_status(spark):
    frame = rows(spark)
    assert audits.audit_facts(frame.limit(0)).first().status == "FAIL"
    late = audits.audit_facts(frame.limit(1).withColumn("information_time", F.expr("filed + INTERVAL 2 DAYS"))).first()
    assert (late.late_rows, late.status) == (1, "PASS_WITH_WARNINGS")
    none = audits.audit_facts(frame.withColumn("information_time", F.lit(None).cast("timestamp_ntz"))).first()
    assert none.status == "FAIL" and none.required_nulls.information_time == 8
    fine = audits.audit_facts(frame.limit(1)).first()
    assert (fine.status, fine.warnings) == ("PASS", [])
