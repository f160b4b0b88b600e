"""Request-log analytics.

The reference keeps the latest 1,000 latency samples in process memory;
here the request log is a DataFrame (ts, user_key, latency_ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.predicates import ntz_micros

# Sample window and advisory threshold.
SAMPLE_SIZE = 1000
P99_ADVISORY_MS = 2000.0


def latency_summary(log: DataFrame, n: int = SAMPLE_SIZE) -> DataFrame:
    """P50/P95/P99 of the latest ``n`` samples as index picks
    (sorted s: s[k//2], s[int(k*.95)], s[int(k*.99)], 0 when empty),
    rounded to 0.1, and the sample count. The latest-n cut is a bounded
    top-k; the ranking then runs over at most n rows."""
    latest = log.orderBy(F.desc("ts"), F.desc("latency_ms")).limit(n).select("latency_ms")
    ranked = (latest.withColumn("i", F.row_number().over(Window.orderBy("latency_ms")) - 1)
              .withColumn("k", F.count("*").over(Window.partitionBy())))

    def pick(q):
        idx = F.floor(F.col("k") * q) if q != 0.5 else F.floor(F.col("k") / 2)
        return F.coalesce(F.round(F.max(F.when(F.col("i") == idx, F.col("latency_ms"))), 1), F.lit(0.0))

    return ranked.agg(pick(0.5).alias("p50_ms"), pick(0.95).alias("p95_ms"), pick(0.99).alias("p99_ms"),
                      F.count("*").alias("sample_count"))


def latency_by_user(log: DataFrame, accuracy: int = 10000) -> DataFrame:
    """E17 variant for large groups: per-user approximate percentiles
    (``percentile_approx`` is a mergeable sketch: partial aggregation,
    no group is ever collected)."""
    return log.groupBy("user_key").agg(
        F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], accuracy).alias("p"),
        F.count("*").alias("sample_count")).select(
        "user_key", F.col("p")[0].alias("p50_ms"), F.col("p")[1].alias("p95_ms"),
        F.col("p")[2].alias("p99_ms"), "sample_count")


def request_rate(log: DataFrame, now_ts: str, secs: int = 60) -> DataFrame:
    """Total requests and requests in the last ``secs`` seconds before
    ``now_ts`` (all requests, not only the retained sample)."""
    now = F.expr(f"TIMESTAMP_NTZ '{now_ts}'")
    lo = F.expr(f"TIMESTAMP_NTZ '{now_ts}' - INTERVAL {secs} SECONDS")
    recent = (F.col("ts") > lo) & (F.col("ts") <= now)
    return log.agg(F.count("*").alias("total"), F.count(F.when(recent, 1)).alias("last_window"))


def latency_advisory(summary: DataFrame, p99_ms: float = P99_ADVISORY_MS) -> DataFrame:
    """Advisory flag and reason from the latency summary."""
    hot = F.col("p99_ms") > p99_ms
    return summary.select("*", hot.alias("advise_upgrade"),
                          F.when(hot, F.concat(F.lit("P99 latency "), F.format_string("%.0f", "p99_ms"),
                                               F.lit(f"ms (>{p99_ms / 1000:g}s)"))).alias("reason"))


def over_quota(log: DataFrame, n: int = 60, secs: int = 60, bucket_secs: int = 3600) -> DataFrame:
    """Users with more than ``n`` requests inside some sliding
    ``secs``-second window (microsecond-exact frame).

    Skew-safe: the window runs per (user, time bucket) instead of per user,
    so one very busy user is spread over many tasks. Each bucket also sees
    a copy of the previous bucket's last ``secs`` seconds as context rows
    (counted in frames, never reported), which keeps every frame exact."""
    width = max(bucket_secs, secs) * 1_000_000
    span = secs * 1_000_000
    ts_type = log.schema["ts"].dataType.simpleString()
    us = ntz_micros("ts") if ts_type == "timestamp_ntz" else F.unix_micros(F.col("ts"))  # no time-zone shift
    base = log.select("user_key", us.alias("us"))
    base = base.withColumn("bucket", F.floor(F.col("us") / width))
    ctx = (base.filter(F.col("us") >= (F.col("bucket") + 1) * width - span)
           .select("user_key", "us", (F.col("bucket") + 1).alias("bucket"), F.lit(True).alias("ctx")))
    rows = base.withColumn("ctx", F.lit(False)).unionByName(ctx)
    w = Window.partitionBy("user_key", "bucket").orderBy("us").rangeBetween(-(span - 1), 0)
    counted = rows.withColumn("in_window", F.count("*").over(w)).filter(~F.col("ctx"))
    return (counted.groupBy("user_key").agg(F.max("in_window").alias("max_in_window"),
                                            F.count(F.when(F.col("in_window") > n, 1)).alias("n_over"))
            .filter(F.col("max_in_window") > n))
