"""Serverless cost attribution.

Usage rows are priced by the list price valid at their start time: an
equi-join on (sku, unit) with a residual range predicate
``start <= t < end (NULL end = open)``. The price list is one row per
(sku, unit, validity interval) — tiny next to usage — and the planner's
size check (``autoBroadcastJoinThreshold``) broadcasts it; when it is not
small, usage and validity intervals meet in time bins, so that the usage of a
handful of SKUs is dealt by (sku, unit, bin). Money stays
DECIMAL until the final round so sums do not depend on order."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scans as S

# Fixed value: SKU pattern that marks serverless job compute.
JOB_SKU_PATTERN = "%JOBS_SERVERLESS%"


#: Days of a time bin where the price list is too large to broadcast.
BIN_DAYS = 7


def _fits_broadcast(df: DataFrame) -> bool:
    """The planner's own check: estimated size against ``autoBroadcastJoinThreshold``."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def _bin(ts: str, days: int):
    return F.floor(F.datediff(F.col(ts), F.lit("1970-01-01").cast("date")) / days).cast("int")


def _binned(usage: DataFrame, prices: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_bin``: usage in the bin of its start, each price once
    for every bin its validity touches, open and long ones cut to the bins
    that the usage spans (two numbers)."""
    usage = usage.withColumn("_bin", _bin("usage_start_time", days))
    lo, hi = usage.agg(F.min("_bin"), F.max("_bin")).first()
    lo, hi = (0, -1) if lo is None else (lo, hi)
    first = F.greatest(_bin("price_start_time", days), F.lit(lo))
    last = F.least(F.coalesce(_bin("price_end_time", days), F.lit(hi)), F.lit(hi))
    spans = prices.where(F.col("price_start_time").isNotNull()).withColumn("_first", first).withColumn("_last", last)
    bins = F.explode(F.sequence("_first", "_last"))
    return usage, spans.where(F.col("_first") <= F.col("_last")).withColumn("_bin", bins).drop("_first", "_last")


def price_usage(usage: DataFrame, prices: DataFrame, bin_days: int = BIN_DAYS) -> DataFrame:
    """Usage rows joined to the price valid at usage_start_time, with
    ``amount = usage_quantity * price`` (DECIMAL). A price list beyond the
    broadcast threshold is joined by (sku, unit, bin of ``bin_days``) with the
    exact bounds on top; the result is the same."""
    columns, same_bin = usage.columns, F.lit(True)
    if not _fits_broadcast(prices):
        usage, prices = _binned(usage, prices, bin_days)
        same_bin = F.col("u._bin") == F.col("p._bin")
    u = usage.alias("u")
    p = prices.alias("p")
    cond = (same_bin & (F.col("u.sku_name") == F.col("p.sku_name")) & (F.col("u.usage_unit") == F.col("p.usage_unit"))
            & (F.col("u.usage_start_time") >= F.col("p.price_start_time"))
            & (F.col("p.price_end_time").isNull() | (F.col("u.usage_start_time") < F.col("p.price_end_time"))))
    return (u.join(p, cond)
            .select(*[F.col(f"u.{c}") for c in columns], F.col("p.price").alias("price"),
                    (F.col("u.usage_quantity") * F.col("p.price")).alias("amount")))


def _cost_by(priced: DataFrame, id_col: str) -> DataFrame:
    return (priced.filter(F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).alias("id"))
            .agg(F.round(F.sum("amount"), 2).cast("double").alias("cost_usd")))


def job_cost(usage: DataFrame, prices: DataFrame, as_of: str | _dt.date, days: int = 30) -> DataFrame:
    """Cost per job over serverless job SKUs in the usage-date window."""
    u = S.scan_usage(usage, as_of, days).filter(F.col("sku_name").like(JOB_SKU_PATTERN))
    return _cost_by(price_usage(u, S.scan_prices(prices)), "job_id")


def pipeline_cost(usage: DataFrame, prices: DataFrame, as_of: str | _dt.date, days: int = 30) -> DataFrame:
    """Cost per pipeline over any SKU in the usage-date window."""
    u = S.scan_usage(usage, as_of, days)
    return _cost_by(price_usage(u, S.scan_prices(prices)), "pipeline_id")


def entity_cost(usage: DataFrame, prices: DataFrame, as_of: str | _dt.date, days: int = 30) -> DataFrame:
    """Both roll-ups keyed by (entity_type, entity_id) for C2."""
    j = job_cost(usage, prices, as_of, days).select(F.lit("JOB").alias("entity_type"),
                                                    F.col("id").alias("entity_id"), "cost_usd")
    p = pipeline_cost(usage, prices, as_of, days).select(F.lit("PIPELINE").alias("entity_type"),
                                                         F.col("id").alias("entity_id"), "cost_usd")
    return j.unionByName(p)


def attach_cost(nodes: DataFrame, cost: DataFrame) -> DataFrame:
    """JOB nodes take their job cost, PIPELINE nodes their pipeline
    cost, every other node NULL (left equi-join on (type, id); replaces any
    cost already present)."""
    c = cost.select("entity_type", "entity_id", F.col("cost_usd").alias("_cost"))
    base = nodes.drop("cost_usd") if "cost_usd" in nodes.columns else nodes
    return (base.join(c, ["entity_type", "entity_id"], "left")
            .withColumn("cost_usd", F.when(F.col("entity_type").isin("JOB", "PIPELINE"), F.col("_cost")))
            .drop("_cost"))
