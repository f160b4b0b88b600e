"""Plan-shape checks: the properties the design relies on at scale."""
import io
from contextlib import redirect_stdout

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from lineaweave.functions import predicates as P
from lineaweave.operators import cost as CO
from lineaweave.operators import graph as G
from lineaweave.operators import requests as RQ
from lineaweave.operators import traverse as TV
from lineaweave.plans import common as C
from lineaweave.session import checkpoint_dir
from lineaweave.sources import scans as S

SF = "/root/testdata/sf0.01"


def _plan(df, mode="formatted"):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_window_and_scope_reach_the_scan(spark):
    p = _plan(G.table_edges(C.lineage(spark, SF), "main", "bronze"))
    assert "GreaterThan(event_time," in p and "EqualTo(target_table_catalog,main)" in p
    # projection pruned: metadata columns not read
    assert "created_by" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_scope_predicate_reaches_the_scan(spark):
    p = _plan(P.scope_filter(C.lineage(spark, SF), "main", "bronze"))
    pushed = next(line for line in p.split("\n") if line.startswith("PushedFilters:"))
    for test in ("EqualTo(target_table_schema,bronze)", "EqualTo(source_table_catalog,main)",
                 "StringStartsWith(source_path,dbfs:/Volumes/main/bronze/)",
                 "StringStartsWith(target_path,/Volumes/main/bronze/)"):
        assert test in pushed


def test_price_list_broadcast_by_size_with_range_residual(spark):
    p = _plan(CO.job_cost(C.fx(spark, SF, "usage"), C.fx(spark, SF, "list_prices"), C.COST_AS_OF, C.COST_DAYS))
    assert "BroadcastHashJoin" in p and "price_end_time" in p
    assert "usage_metadata:struct<job_id:string>" in p   # nested pruning


def test_trace_rows_scan_log_once_without_shuffle(spark):
    ev = C.lineage(spark, SF)
    reached = TV.trace_many(ev, [C.SEED], 16)
    p = _plan(TV._flag_rows(ev, reached), "simple")
    assert p.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in p


def test_quota_window_partitioned_by_user_and_bucket(spark):
    p = _plan(RQ.over_quota(C.fx(spark, SF, "request_log"), 8, 86400), "simple")
    assert "Window" in p and "bucket" in p.split("Window")[1].split("\n")[0]


@pytest.fixture(scope="module")
def by_date(spark):
    path = f"{checkpoint_dir(spark)}/test-by-date-{uuid.uuid4().hex}"
    return path.removeprefix("file:"), S.write_partitioned(C.fx(spark, SF, "table_lineage"), path)


def test_window_prunes_the_folders_of_other_dates(spark, by_date):
    path, ev = by_date
    windowed = S.scan_table_lineage(ev, C.AS_OF, 20)
    line = next(x for x in _plan(windowed).split("\n") if x.startswith("PartitionFilters:"))
    assert "event_date" in line and "2024-01-11" in line
    n = windowed.count()
    # what other folders hold is never opened: a broken file there does no harm, one inside the window does
    start = dt.date(2024, 1, 31) - dt.timedelta(days=20)
    old, new = (min(d for d in os.listdir(path) if d.startswith("event_date=") and (d < f"event_date={start}") == before)
                for before in (True, False))
    assert n < ev.count()
    with open(f"{path}/{old}/part-broken.parquet", "w") as f:
        f.write("no parquet")
    again = spark.read.schema(ev.schema).parquet(path)
    assert S.scan_table_lineage(again, C.AS_OF, 20).count() == n
    with pytest.raises(Exception, match="part-broken"):
        again.select("created_by").distinct().count()
    os.remove(f"{path}/{old}/part-broken.parquet")
    assert new > old


def test_dates_prune_at_run_time(spark, by_date):
    _, ev = by_date
    days = spark.createDataFrame([(dt.date(2024, 1, 20), "late"), (dt.date(2024, 1, 21), "late"), (dt.date(2024, 1, 5), "done")],
                                 "event_date date, state string").where("state = 'late'")
    got = S.scan_on_dates(ev, days)
    assert "dynamicpruning" in _plan(got).lower()
    want = ev.where(F.col("event_date").isin(dt.date(2024, 1, 20), dt.date(2024, 1, 21))).count()
    assert got.count() == want > 0
