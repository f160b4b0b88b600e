"""Scans of the input relations (A1-A8): projection, window and exclusion
filters expressed so they reach the parquet scan (pushdown + pruning)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P

LINEAGE_COLS = ("source_table_full_name", "target_table_full_name", "source_type", "target_type",
                "source_path", "target_path", "entity_type", "entity_id", "event_time", "created_by")
SCOPE_COLS = ("source_table_catalog", "source_table_schema", "target_table_catalog", "target_table_schema")

# Namespaces hidden from listings.
SKIP_CATALOGS = ("system", "__databricks_internal")
SKIP_SCHEMAS = ("information_schema", "default")


def _partition_prune(df: DataFrame, as_of, days: int) -> DataFrame:
    """Event logs partitioned by ``event_date`` prune whole directories."""
    if "event_date" in df.columns:
        start = P.window_start(as_of, days)
        df = df.filter(F.col("event_date") >= F.lit(start))
    return df


def scan_table_lineage(ev: DataFrame, as_of: str | _dt.date, days: int, with_scope: bool = True,
                       exclude_internal: bool = True) -> DataFrame:
    """A1: table-lineage events inside the lookback window, internal backing
    tables excluded, pruned to the columns the operators read."""
    ev = _partition_prune(ev, as_of, days)
    ev = P.within_window(ev, as_of, days, "event_time")
    if exclude_internal:
        ev = P.drop_internal(ev)
    cols = list(LINEAGE_COLS) + (list(SCOPE_COLS) if with_scope else [])
    return ev.select(*cols)


def write_partitioned(ev: DataFrame, path: str, time_col: str = "event_time") -> DataFrame:
    """An event log stored with one folder per ``event_date``, read back as
    the relation A1 and A2 scan. Rows are dealt by date and a hash of the row
    first, so a date has few files and a busy date more than one writer."""
    salt = F.pmod(F.xxhash64(*[c for c in ev.columns]), F.lit(4))
    dated = ev.withColumn("event_date", F.to_date(time_col))
    dated.repartition("event_date", salt).write.mode("overwrite").partitionBy("event_date").parquet(path)
    return ev.sparkSession.read.schema(dated.schema).parquet(path)


def scan_on_dates(ev: DataFrame, dates: DataFrame) -> DataFrame:
    """Events of the dates in ``dates(event_date)``, for catch-up runs: on a
    log partitioned by ``event_date`` the date set prunes folders at run time
    (dynamic partition pruning)."""
    wanted = dates.select("event_date").distinct()
    return ev.join(wanted, "event_date", "left_semi")


def scan_column_lineage(cl: DataFrame, as_of: str | _dt.date, days: int) -> DataFrame:
    """A2: column-lineage events inside the lookback window (internal tables
    are not excluded here, as in the reference)."""
    cl = _partition_prune(cl, as_of, days)
    cl = P.within_window(cl, as_of, days, "event_time")
    return cl.select("source_table_full_name", "source_column_name", "target_table_full_name",
                     "target_column_name", *SCOPE_COLS)


def list_catalogs(tables_meta: DataFrame) -> DataFrame:
    """A5: catalogs present in the metadata, minus system catalogs, sorted."""
    return (tables_meta.select(F.col("table_catalog").alias("catalog")).distinct()
            .filter(~F.col("catalog").isin(*SKIP_CATALOGS)).orderBy("catalog"))


def list_schemas(tables_meta: DataFrame, catalog: str | None = None) -> DataFrame:
    """A5: (catalog, schema) pairs minus information_schema/default, sorted."""
    df = tables_meta
    if catalog is not None:
        df = df.filter(F.col("table_catalog") == catalog)
    return (df.select(F.col("table_catalog").alias("catalog"), F.col("table_schema").alias("schema"))
            .distinct()
            .filter(~F.col("schema").isin(*SKIP_SCHEMAS) & ~F.col("catalog").isin(*SKIP_CATALOGS))
            .orderBy("catalog", "schema"))


def list_tables(tables_meta: DataFrame) -> DataFrame:
    """A3: table inventory over every catalog in one scan: name, fqdn,
    catalog, schema, table_type (default TABLE)."""
    return (tables_meta
            .filter(~F.col("table_catalog").isin(*SKIP_CATALOGS)
                    & ~F.col("table_schema").isin(*SKIP_SCHEMAS)
                    & P.not_internal_table("table_name"))
            .select(F.col("table_name").alias("name"),
                    F.concat_ws(".", "table_catalog", "table_schema", "table_name").alias("fqdn"),
                    F.col("table_catalog").alias("catalog"),
                    F.col("table_schema").alias("schema"),
                    F.coalesce(F.col("table_type"), F.lit("TABLE")).alias("table_type")))


def list_columns(columns_meta: DataFrame, table: str | None = None) -> DataFrame:
    """A4: column metadata (name, type, nullable, ordinal) ordered by
    ordinal; optionally for one ``cat.schema.table``."""
    df = columns_meta
    if table is not None:
        cat, sch, name = table.split(".")
        df = df.filter((F.col("table_catalog") == cat) & (F.col("table_schema") == sch)
                       & (F.col("table_name") == name))
    return (df.select(F.concat_ws(".", "table_catalog", "table_schema", "table_name").alias("table"),
                      F.col("column_name").alias("name"), F.col("data_type").alias("type"),
                      (F.col("is_nullable") == "YES").alias("nullable"),
                      F.col("ordinal_position").cast("int").alias("ordinal"))
            .orderBy("table", "ordinal"))


def scan_usage(usage: DataFrame, as_of: str | _dt.date | None = None, days: int | None = None) -> DataFrame:
    """Billing usage with nested ids projected (nested schema pruning)."""
    if as_of is not None and days is not None:
        start = P.window_start(as_of, days)
        usage = usage.filter(F.col("usage_date") > F.lit(start))
    return usage.select(F.col("usage_metadata.job_id").alias("job_id"),
                        F.col("usage_metadata.dlt_pipeline_id").alias("pipeline_id"),
                        "sku_name", "usage_unit", "usage_quantity", "usage_start_time", "usage_date")


def scan_prices(prices: DataFrame) -> DataFrame:
    """List prices with the nested default price projected."""
    return prices.select("sku_name", "usage_unit",
                         F.col("pricing.effective_list.default").alias("price"),
                         "price_start_time", "price_end_time")


def scan_entities(jobs: DataFrame, pipelines: DataFrame, audit: DataFrame) -> DataFrame:
    """One registry of (entity_type, entity_id, name, owner) from the job
    and pipeline registries and the audit log's notebook paths (map access).
    A notebook id seen with several paths resolves to the smallest path."""
    j = jobs.select(F.lit("JOB").alias("entity_type"), F.col("job_id").alias("entity_id"),
                    F.col("name"),
                    F.coalesce(F.col("run_as_user_name"), F.col("creator_user_name")).alias("owner"))
    p = pipelines.select(F.lit("PIPELINE").alias("entity_type"), F.col("pipeline_id").alias("entity_id"),
                         F.col("name"), F.lit(None).cast("string").alias("owner"))
    nb = (audit.select(F.col("request_params")["notebookId"].alias("entity_id"),
                       F.col("request_params")["path"].alias("path"))
          .filter(F.col("entity_id").isNotNull() & F.col("path").isNotNull())
          .groupBy("entity_id").agg(F.min("path").alias("path"))
          .select(F.lit("NOTEBOOK").alias("entity_type"), "entity_id",
                  F.element_at(F.split("path", "/"), -1).alias("name"),
                  F.lit(None).cast("string").alias("owner")))
    return j.unionByName(p).unionByName(nb)
