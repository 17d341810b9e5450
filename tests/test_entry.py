"""Driver contract: entry() runs on sf0.001; every oracle has a query."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 5
    assert df.columns[:2] == ["rank", "feature"]


def test_oracles_have_queries():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 100


def test_queries_pin_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = E.queries()["a14_datetime_trend"](spark, "/root/testdata/sf0.001").collect()
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC" and len(rows) == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
