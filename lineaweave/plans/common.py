"""Shared parameters, loaders and oracle SQL snippets for registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.predicates import INTERNAL_NAME_RE, window_start
from ..sources import fixtures as FX
from ..sources import scans as S

# Query parameters (deterministic `as_of` instead of current_date()).
AS_OF = "2024-01-31"
DAYS = 90
SEED = "analytics.gold.t7"
SCOPE_CATALOG, SCOPE_SCHEMA = "main", "bronze"
CATALOG_SCOPE = "analytics"
MAX_HOPS = None  # walks end where nothing new is reached
ORACLE_HOPS = 40  # recursive SQL needs a bound on cycles; beyond the depth of the inputs it changes nothing
COST_AS_OF, COST_DAYS = "2002-01-01", 3000
COLUMN_SEED = ("analytics.mart.t7", "c2")
NOW_TS = "2024-01-30 12:00:00"

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def fx(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return FX.fixture(spark, sf, name)


def lineage(spark: SparkSession, sf: str, as_of: str = AS_OF, days: int = DAYS) -> DataFrame:
    return S.scan_table_lineage(fx(spark, sf, "table_lineage"), as_of, days)


def column_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return S.scan_column_lineage(fx(spark, sf, "column_lineage"), AS_OF, DAYS)


# ---------------------------------------------------------------- oracle SQL

def oracle(fixtures: tuple[str, ...], ctes: list[tuple[str, str]], final: str, recursive: bool = False) -> str:
    parts = [f"{f} AS ({FX.fixture_sql_duckdb(f)})" for f in fixtures]
    parts += [f"{n} AS ({q})" for n, q in ctes]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + final if parts else final


def ts_bound(as_of: str = AS_OF, days: int = DAYS) -> str:
    return f"TIMESTAMP '{window_start(as_of, days).isoformat()} 00:00:00'"


def not_internal_sql(col: str) -> str:
    return f"({col} IS NULL OR NOT regexp_matches({col}, '{INTERNAL_NAME_RE}'))"


EV_SQL = (f"SELECT * FROM table_lineage WHERE event_time > {ts_bound()} AND "
          f"{not_internal_sql('source_table_full_name')} AND {not_internal_sql('target_table_full_name')}")


def truthy(x: str) -> str:
    return f"({x} IS NOT NULL AND {x} <> '')"


def norm_id_sql(name: str, path: str) -> str:
    p = f"(CASE WHEN starts_with({path}, 'dbfs:/Volumes/') THEN substr({path}, 6) ELSE {path} END)"
    return f"""(CASE WHEN {truthy(name)} THEN {name}
      WHEN NOT {truthy(path)} THEN NULL
      WHEN starts_with({p}, '/Volumes/') AND len(string_split({p}, '/')) >= 5
        THEN split_part({p}, '/', 3) || '.' || split_part({p}, '/', 4) || '.' || split_part({p}, '/', 5)
      WHEN starts_with({p}, '/Volumes/') THEN 'volume:' || {p}
      WHEN strpos({p}, '://') > 0
        THEN 'path:' || split_part({p}, '://', 1) || '://' || split_part(substr({p}, strpos({p}, '://') + 3), '/', 1)
      ELSE 'path:' || {path} END)"""


def norm_type_sql(name: str, path: str, typ: str) -> str:
    p = f"(CASE WHEN starts_with({path}, 'dbfs:/Volumes/') THEN substr({path}, 6) ELSE {path} END)"
    return f"""(CASE WHEN {truthy(name)} THEN (CASE WHEN {truthy(typ)} THEN {typ} ELSE 'TABLE' END)
      WHEN NOT {truthy(path)} THEN NULL
      WHEN starts_with({p}, '/Volumes/') THEN 'VOLUME' ELSE 'PATH' END)"""


def norm_rows_sql(src_rel: str) -> str:
    """Normalised rows (src, src_type, tgt, tgt_type, ekey) of a relation."""
    return f"""SELECT *, {norm_id_sql('source_table_full_name', 'source_path')} AS src,
      {norm_type_sql('source_table_full_name', 'source_path', 'source_type')} AS src_type,
      {norm_id_sql('target_table_full_name', 'target_path')} AS tgt,
      {norm_type_sql('target_table_full_name', 'target_path', 'target_type')} AS tgt_type,
      CASE WHEN {truthy('entity_type')} AND {truthy('entity_id')}
           THEN 'entity:' || entity_type || ':' || entity_id END AS ekey
    FROM {src_rel}"""


def routed_edges_sql(erows: str) -> str:
    """Read-after-write routed entity edges over an entity-row relation."""
    return f"""
      SELECT ekey AS source, tgt AS target FROM {erows} WHERE tgt IS NOT NULL
      UNION SELECT r.src, r.tgt FROM {erows} r
        WHERE r.src IS NOT NULL AND r.tgt IS NOT NULL
          AND EXISTS (SELECT 1 FROM {erows} x WHERE x.ekey = r.ekey AND x.tgt = r.src)
      UNION SELECT r.src, r.ekey FROM {erows} r
        WHERE r.src IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM {erows} x WHERE x.ekey = r.ekey AND x.tgt = r.src)"""


def label_sql(idc: str, typ: str) -> str:
    raw = f"regexp_replace({idc}, '^path:', '')"
    bucket = f"(CASE WHEN strpos({raw}, '://') > 0 THEN split_part(substr({raw}, strpos({raw}, '://') + 3), '/', 1) ELSE {raw} END)"
    return f"(CASE WHEN {typ} = 'PATH' THEN {bucket} ELSE string_split({idc}, '.')[-1] END)"


def classify_sql(nodes: str, edges: str) -> str:
    """Degree counts and status for table nodes (entities get NULLs)."""
    return f"""SELECT n.*,
      CASE WHEN n.node_type = 'table' THEN coalesce(u.c, 0) ELSE 0 END AS upstream_count,
      CASE WHEN n.node_type = 'table' THEN coalesce(d.c, 0) ELSE 0 END AS downstream_count,
      CASE WHEN n.node_type <> 'table' THEN NULL
           WHEN coalesce(u.c, 0) = 0 AND coalesce(d.c, 0) = 0 THEN 'orphan'
           WHEN coalesce(u.c, 0) = 0 THEN 'root'
           WHEN coalesce(d.c, 0) = 0 THEN 'leaf' ELSE 'connected' END AS lineage_status
    FROM {nodes} n
    LEFT JOIN (SELECT target AS id, count(*) AS c FROM {edges} GROUP BY target) u ON u.id = n.id
    LEFT JOIN (SELECT source AS id, count(*) AS c FROM {edges} GROUP BY source) d ON d.id = n.id"""


def owner_sql() -> str:
    return "arg_max(created_by, struct_pack(t := event_time, c := created_by)) FILTER (WHERE created_by IS NOT NULL)"
