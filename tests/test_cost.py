"""Cost attach (C2) and price validity."""
import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lineaweave.operators import cost as CO
from lineaweave.session import materialize

COST = "entity_type string, entity_id string, cost_usd double"


def _graph_nodes(spark, kinds=("JOB", "PIPELINE", "NOTEBOOK", "QUERY")):
    """Two entities of each kind and two tables."""
    rows = [(f"entity:{k}:{k.lower()}/{i}", k, f"{k.lower()}/{i}") for k in kinds for i in (7, 8)]
    rows += [(f"lake.raw.events{i}", None, None) for i in (1, 2)]
    return spark.createDataFrame(rows, "id string, entity_type string, entity_id string")


def test_cost_goes_to_jobs_and_pipelines_of_the_same_type_and_id(spark):
    nodes = _graph_nodes(spark)
    # a cost for every kind, and one whose id exists under another type only
    cost = [(k, f"{k.lower()}/7", 10.0 + i) for i, k in enumerate(("JOB", "PIPELINE", "NOTEBOOK"))] + [("JOB", "pipeline/8", 77.0)]
    got = {r.id: r.cost_usd for r in CO.attach_cost(nodes, spark.createDataFrame(cost, COST)).collect()}
    assert len(got) == nodes.count()
    assert {i: c for i, c in got.items() if c is not None} == {"entity:JOB:job/7": 10.0, "entity:PIPELINE:pipeline/7": 11.0}


def test_cost_of_an_earlier_run_does_not_stay(spark):
    once = CO.attach_cost(_graph_nodes(spark), spark.createDataFrame([("JOB", "job/7", 3.0), ("JOB", "job/8", 5.0)], COST))
    again = CO.attach_cost(once, spark.createDataFrame([("JOB", "job/8", 6.5)], COST))
    assert {r.id: r.cost_usd for r in again.where("cost_usd IS NOT NULL").collect()} == {"entity:JOB:job/8": 6.5}
    none = CO.attach_cost(again, spark.createDataFrame([], COST))
    assert none.where("cost_usd IS NOT NULL").count() == 0 and none.count() == again.count()


def _usage(spark, rows):
    return spark.createDataFrame(rows, "job_id string, pipeline_id string, sku_name string, usage_unit string, "
                                       "usage_quantity decimal(18,4), usage_start_time timestamp_ntz, usage_date date")


def _prices(spark, rows):
    return spark.createDataFrame(rows, "sku_name string, usage_unit string, price decimal(18,4), "
                                       "price_start_time timestamp_ntz, price_end_time timestamp_ntz")


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
@pytest.mark.parametrize("days", [1, 7, 400])
def test_price_intervals_equal_brute_force(spark, threshold, days):
    """Overlapping, open, empty, reversed and null intervals; usage at both bounds, outside all and without a time."""
    r = random.Random(days)
    t0 = dt.datetime(1969, 11, 1)

    def at(hours):
        return t0 + dt.timedelta(hours=hours)
    prices = []
    for i in range(40):
        a = r.randrange(3000)
        b = r.choice([None, a, a - 50, a + 1, a + r.randrange(1, 2500)])
        prices.append((f"S{i % 3}", r.choice(["DBU", "GB"]), Decimal(i + 1), at(a), None if b is None else at(b)))
    prices += [("S0", "DBU", Decimal(99), None, None), ("S1", "GB", Decimal(98), None, at(900))]
    bounds = [t for p in prices for t in p[3:] if t is not None]
    usage = [(f"j{i}", None, f"S{i % 4}", r.choice(["DBU", "GB"]), Decimal(1), r.choice([at(r.randrange(-100, 6000)), r.choice(bounds), None]), None)
             for i in range(150)]
    want = sorted((u[0], p[2]) for u in usage for p in prices if u[5] is not None and u[2:4] == p[:2] and p[3] is not None
                  and p[3] <= u[5] and (p[4] is None or u[5] < p[4]))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        listed = materialize(_prices(spark, prices), "test-prices")  # stored, so that its size is known
        got = CO.price_usage(_usage(spark, usage), listed, bin_days=days)
        assert ("_bin" in got._jdf.queryExecution().analyzed().toString()) == (threshold == "-1")
        assert sorted((x.job_id, x.price) for x in got.collect()) == want and len(want) > 100
        assert got.columns == [*_usage(spark, usage).columns, "price", "amount"]
        none = CO.price_usage(_usage(spark, usage).where("job_id IS NULL"), listed, bin_days=days)
        assert none.count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_amount_is_exact(spark):
    rows = [("j", None, "S", "DBU", Decimal("0.1000"), dt.datetime(2020, 5, 1), None)] * 3
    priced = CO.price_usage(_usage(spark, rows), _prices(spark, [("S", "DBU", Decimal("0.7000"), dt.datetime(2020, 1, 1), None)]))
    assert priced.agg(F.sum("amount")).first()[0] == Decimal("0.21")
