"""Readiness report."""
from lineaweave.operators import readiness as RD


def test_readiness_reports_failures_and_catalog_gaps(spark):
    ok_df = spark.createDataFrame([(1,)], "x int")
    sources = {"lineage": (lambda: ok_df, True, "grant lineage"),
               "billing": (lambda: spark.read.parquet("/nonexistent/path/x.parquet"), False, "grant billing")}
    visible = spark.createDataFrame([("cat_a",), ("cat_b",), ("system",)], "catalog string")
    meta = spark.createDataFrame([("cat_a",)], "table_catalog string")
    df, overall = RD.source_readiness(spark, sources, visible, meta)
    rows = {r.check: r for r in df.collect()}
    assert rows["lineage"].ok and not rows["billing"].ok and rows["billing"].hint == "grant billing"
    assert rows["catalog metadata"].detail == "1/2 sampled catalog(s) expose metadata"
    assert "cat_b" in rows["catalog metadata"].hint
    assert overall is True


def test_required_failure_fails_overall(spark):
    sources = {"lineage": (lambda: spark.read.parquet("/nonexistent/x.parquet"), True, "grant")}
    _, overall = RD.source_readiness(spark, sources)
    assert overall is False
