"""Data readiness report of the input relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Catalogs never sampled for metadata readability.
SYSTEM_CATALOGS = ("system", "samples", "__databricks_internal")


def probe(loader: Callable[[], DataFrame]) -> tuple[bool, bool, str]:
    """(reachable, non_empty, detail) of one relation: a ``limit(1)`` read."""
    try:
        df = loader()
        non_empty = len(df.limit(1).take(1)) > 0
        return True, non_empty, "reachable"
    except Exception as e:  # unreachable relation: report, do not raise
        return False, False, str(e)


def source_readiness(spark: SparkSession, sources: dict[str, tuple[Callable[[], DataFrame], bool, str]],
                     visible_catalogs: DataFrame | None = None, tables_meta: DataFrame | None = None,
                     sample: int | None = None) -> tuple[DataFrame, bool]:
    """One row per relation (check, ok, required, detail, hint) plus a
    catalog-metadata row: visible catalogs (with ``sample``, so many of them by name;
    system catalogs skipped) that expose no metadata rows are named in the
    hint. Overall ok = every required check ok."""
    rows = []
    for name, (loader, required, hint) in sources.items():
        reach, non_empty, detail = probe(loader)
        rows.append((name, reach, required, detail, None if reach else hint, non_empty))
    if visible_catalogs is not None and tables_meta is not None:
        vis = (visible_catalogs.select(F.col("catalog")).distinct()
               .filter(~F.col("catalog").isin(*SYSTEM_CATALOGS)))
        vis = vis if sample is None else vis.orderBy("catalog").limit(sample)
        have = tables_meta.select(F.col("table_catalog").alias("catalog")).distinct()
        flagged = vis.join(have.select("catalog", F.lit(True).alias("readable")), "catalog", "left")
        res = flagged.agg(F.count("*").alias("n"), F.count("readable").alias("ok"),
                          F.array_join(F.array_sort(F.collect_list(
                              F.when(F.col("readable").isNull(), F.col("catalog")))), ", ").alias("missing")).first()
        ok = res["ok"] > 0 or res["n"] == 0
        hint = (f"Visible but no table metadata: {res['missing']}" if res["missing"] else None)
        rows.append(("catalog metadata", ok, True, f"{res['ok']}/{res['n']} sampled catalog(s) expose metadata",
                     hint, res["ok"] > 0))
    df = spark.createDataFrame(rows, "check string, ok boolean, required boolean, detail string, "
                                     "hint string, non_empty boolean")
    overall = all(r[1] for r in rows if r[2])
    return df, overall
