"""The driver's entry points."""

import __spark_entry__
from tidemark.plans import catalogue


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 60


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0 and "pit_sentiment" in frame.columns
