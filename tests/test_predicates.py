"""Scalar predicates and helpers."""
import calendar
import datetime as dt

from pyspark.sql import functions as F

from lineaweave.functions import predicates as P

from lineage_data import lineage_rows


def test_entity_id_validation(spark):
    rows = [("JOB", "12345"), ("JOB", "1; DROP TABLE x --"), ("PIPELINE", "1; DROP TABLE x --"),
            ("NOTEBOOK", "1; DROP TABLE x --"), ("DASHBOARD_V3", "1; DROP TABLE x --"),
            ("PIPELINE", "0a1b2c3d-0000-1111-2222-333344445555"), ("NOTEBOOK", "/Users/a@b.com/nb 1"),
            ("job", " 42 ")]
    df = spark.createDataFrame(rows, "entity_type string, entity_id string")
    got = [r[0] for r in df.select(P.valid_entity_id("entity_type", "entity_id")).collect()]
    assert got == [True, False, False, False, False, True, True, True]
    ok, bad = P.flag_invalid_ids(df)
    assert ok.count() == 4 and bad.count() == 4


def test_identifier_validation(spark):
    df = spark.createDataFrame([("main",), ("main;DROP",), ("my_schema'--",), ("",)], "x string")
    assert [r[0] for r in df.select(P.valid_identifier("x")).collect()] == [True, False, False, False]
    full = spark.createDataFrame([("a.b.c",), ("a.b",), ("a.b.c;",)], "x string")
    assert [r[0] for r in full.select(P.valid_full_name("x")).collect()] == [True, False, False]


def test_medallion(spark):
    df = spark.createDataFrame([("Bronze",), ("silver_v2",), ("sales_gold",), ("goldilocks",), (None,)], "s string")
    got = [tuple(r) for r in df.select(P.medallion("s"), P.medallion_rank(P.medallion("s"))).collect()]
    assert got == [("bronze", 1), ("silver", 2), ("gold", 3), (None, 4), (None, 4)]


def test_freshness_and_discount(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 30, 11, 59, 30),), (dt.datetime(2024, 1, 30, 11, 15),),
                                (dt.datetime(2024, 1, 30, 1, 0),), (dt.datetime(2024, 1, 27, 12, 0),), (None,)],
                               "t timestamp_ntz")
    fresh, age = P.freshness("t", "2024-01-30 12:00:00")
    got = [tuple(r) for r in df.select(fresh, age).collect()]
    assert got == [(True, "just now"), (True, "45m ago"), (True, "11h ago"), (False, "3d ago"), (False, None)]
    c = spark.createDataFrame([(10.0,)], "c double")
    assert c.select(P.discounted("c", 25)).first()[0] == 7.5
    assert c.select(P.discounted("c", 150)).first()[0] == 0.1
    assert c.select(P.discounted("c", -5)).first()[0] == 10.0


def test_filter_rows_and_shared_as(spark):
    df = spark.createDataFrame([("Alpha", 1, None), ("beta", 22, "x")], "a string, b int, c string")
    assert P.filter_rows(df, "  ALP ").count() == 1
    assert P.filter_rows(df, "22").count() == 1
    assert P.filter_rows(df, "").count() == 2
    s = spark.createDataFrame([("gold", None, "t1"), ("gold", "pub", "t2"), ("gold", "pub", None)],
                              "sch string, a_sch string, a_tbl string")
    assert [r[0] for r in s.select(P.shared_as("sch", "a_sch", "a_tbl")).collect()] == ["gold.t1", "pub.t2", None]


def test_window_internal_and_scope(spark):
    ev = lineage_rows(spark, [
        ("c.s.a", "c.s.b", None, None),
        ("c.s.__materialization_mat_x", "c.s.b", None, None),
        (None, "c.s.b", None, None, "/Volumes/c/s/v/f"),
        (None, None, None, None, None, "dbfs:/Volumes/c/s/v/_tmp"),
        (None, None, None, None, None, "/Volumes/c/sx/v/f"),
        ("d.q.a", "d.q.b", None, None),
    ])
    assert P.drop_internal(ev).count() == 5
    # events sit at 2024-01-10 12:00; the bound is midnight of as_of - days, strict
    assert P.within_window(ev, "2024-01-31", 20).count() == 0
    assert P.within_window(ev, "2024-01-31", 21).count() == 6
    assert P.within_window(ev, "2024-01-30", 20).count() == 6
    edge = ev.withColumn("event_time", F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"))
    assert P.within_window(edge, "2024-01-30", 20).count() == 0
    assert P.scope_filter(ev, "c", "s").count() == 4    # dbfs write path counts, 'sx' does not
    assert P.scope_filter(ev, "d").count() == 1


def test_timestamp_helpers_ignore_session_time_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            # 02:30 on 2024-03-10 does not exist in Los Angeles (DST gap)
            df = spark.range(1).select(F.expr("TIMESTAMP_NTZ '2024-03-10 02:30:00'").alias("t"))
            r = df.select(P.ntz_micros("t").alias("m"),
                          P.instant_to_ntz(P.ntz_to_instant("t")).cast("string").alias("back"),
                          F.unix_micros(P.ntz_to_instant("t")).alias("u")).first()
            want = calendar.timegm((2024, 3, 10, 2, 30, 0)) * 1_000_000
            assert r.m == r.u == want
            assert r.back == "2024-03-10 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
