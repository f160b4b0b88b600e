"""The demo medallion workload (A9-A12, C15, E14-E16): landing CSV ingest,
a parquet hop, bronze generation, daily and per-customer roll-ups, the
executive summary via scalar subqueries and the 360 view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER_SCHEMA = T.StructType([
    T.StructField("order_id", T.IntegerType()),
    T.StructField("customer_id", T.IntegerType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("order_ts", T.TimestampNTZType()),
])
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def write_landing(orders: DataFrame, path: str, files: int = 4) -> str:
    """Land order rows as headered CSV files (the ingest source)."""
    (orders.select("order_id", "customer_id", "amount", "order_ts").repartition(files)
     .write.mode("overwrite").option("header", "true").option("timestampNTZFormat", TS_FORMAT).csv(path))
    return path


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """A9 (batch form): declared schema, header, source-file column."""
    return (spark.read.schema(ORDER_SCHEMA).option("header", "true")
            .option("timestampNTZFormat", TS_FORMAT).csv(path)
            .select("*", F.col("_metadata.file_path").alias("src_file")))


def ingest_orders_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Streaming ingest of the landing folder with the same schema and
    the source file of every row."""
    return (spark.readStream.schema(ORDER_SCHEMA).option("header", "true")
            .option("timestampNTZFormat", TS_FORMAT).option("maxFilesPerTrigger", files_per_trigger)
            .csv(path).select("*", F.col("_metadata.file_path").alias("src_file")))


def parquet_roundtrip(df: DataFrame, path: str) -> DataFrame:
    """A10: write a relation to a parquet path and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def publish(df: DataFrame, name: str, table: bool = False, path: str | None = None) -> DataFrame:
    """Publish a relation under a name: a session view, or a table of the
    catalog (``saveAsTable``) when ``table`` is set, managed or, with ``path``, in that folder."""
    if table:
        writer = df.write.mode("overwrite")
        (writer if path is None else writer.option("path", path)).saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def gen_bronze_orders(ids: DataFrame) -> DataFrame:
    """Bronze orders from ids (``spark.range`` or any id column):
    customer 100 + id % 7, amount round((id * 7.7) % 800, 2) in exact
    decimal arithmetic, timestamp 2026-06-15 09:00 plus id minutes."""
    i = F.col("id")
    amount = F.round((i.cast("decimal(20,0)") * F.lit(7.7).cast("decimal(2,1)")) % F.lit(800), 2)
    ts = F.expr("TIMESTAMP_NTZ '2026-06-15 09:00:00' + CAST(id AS BIGINT) * INTERVAL '1' MINUTE")
    return ids.select(i.alias("order_id"), (F.lit(100) + i % 7).alias("customer_id"),
                      amount.cast("double").alias("amount"), ts.alias("order_ts"))


def _money_sum(c: str) -> F.Column:
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def orders_daily(orders: DataFrame) -> DataFrame:
    """Orders and revenue per order date."""
    return orders.groupBy(F.to_date("order_ts").alias("order_date")).agg(
        F.count("*").alias("orders"), _money_sum("amount").alias("revenue"))


def gold_orders(orders: DataFrame) -> DataFrame:
    """Orders and revenue per customer."""
    return orders.groupBy("customer_id").agg(F.count("*").alias("orders"), _money_sum("amount").alias("revenue"))


def executive_summary(gold: DataFrame, daily: DataFrame) -> DataFrame:
    """Three scalar subqueries (Catalyst plans each as its own
    aggregate; no join). Money is summed as DECIMAL so the result does not
    depend on summation order."""
    spark = gold.sparkSession
    return spark.sql(
        "SELECT (SELECT CAST(sum(CAST(revenue AS DECIMAL(18, 2))) AS DOUBLE) FROM {g}) AS customer_revenue, "
        "(SELECT CAST(sum(CAST(revenue AS DECIMAL(18, 2))) AS DOUBLE) FROM {d}) AS daily_revenue, "
        "(SELECT count(*) FROM {g}) AS customers", g=gold, d=daily)


def orders_360(gold: DataFrame, summary: DataFrame) -> DataFrame:
    """Every gold row with the summary's daily revenue attached as a
    scalar subquery (the one-row relation is never joined)."""
    spark = gold.sparkSession
    return spark.sql("SELECT g.*, (SELECT daily_revenue FROM {e}) AS daily_revenue FROM {g} g",
                     g=gold, e=summary)
