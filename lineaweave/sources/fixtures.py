"""Stand-in input relations derived from the driver's test tables.

The lineage domain's inputs (table/column lineage event logs, catalog
metadata, billing usage, entity registries, sharing inventories, request
log, demo orders) are derived from the TPC-H-ish tables as documented in
FIXTURES.md. Each derivation only reshapes rows into the schema an operator
expects; none of them does an operator's work.

Each derivation is one SQL text run by Spark (DataFrame parameters) and by
DuckDB (the driver's pre-registered views) so both engines see identical
inputs. Dialect differences (struct / map constructors, inline VALUES,
timestamp-without-zone literals) are isolated in ``_dialect``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events")


def _dialect(d: str) -> dict[str, str]:
    if d == "spark":
        return {
            "ts": "TIMESTAMP_NTZ",
            "usage_meta": "named_struct('job_id', job_id, 'dlt_pipeline_id', dlt_pipeline_id)",
            "pricing": "named_struct('effective_list', named_struct('default', price))",
            "audit_map": "map('notebookId', nb_id, 'path', nb_path)",
        }
    return {
        "ts": "TIMESTAMP",
        "usage_meta": "struct_pack(job_id := job_id, dlt_pipeline_id := dlt_pipeline_id)",
        "pricing": "struct_pack(effective_list := struct_pack(\"default\" := price))",
        "audit_map": "MAP([ 'notebookId', 'path' ], [ nb_id, nb_path ])",
    }


# name -> (base tables read, SQL template). Placeholders {t} name input
# relations; {ts} etc. come from the dialect.
_SQL: dict[str, tuple[tuple[str, ...], str]] = {}

_SQL["table_lineage"] = (("events",), """
SELECT source_table_full_name, target_table_full_name,
       split_part(source_table_full_name, '.', 1) AS source_table_catalog,
       split_part(source_table_full_name, '.', 2) AS source_table_schema,
       split_part(target_table_full_name, '.', 1) AS target_table_catalog,
       split_part(target_table_full_name, '.', 2) AS target_table_schema,
       CASE WHEN source_table_full_name IS NULL THEN 'PATH'
            WHEN source_table_full_name LIKE 'main.raw.%' THEN 'STREAMING_TABLE'
            ELSE 'TABLE' END AS source_type,
       CASE WHEN target_table_full_name IS NULL THEN 'PATH'
            WHEN target_table_full_name LIKE 'main.raw.%' THEN 'STREAMING_TABLE'
            ELSE 'TABLE' END AS target_type,
       source_path, target_path, entity_type, entity_id, event_time, created_by
FROM (
  SELECT
    CASE e5 WHEN 0 THEN 'main.raw.t' || us WHEN 1 THEN 'main.bronze.t' || us
            WHEN 2 THEN 'main.silver.t' || us WHEN 3 THEN 'analytics.gold.t' || us
            ELSE CASE e25 WHEN 9 THEN 'main.bronze.t' || us
                          WHEN 19 THEN 'main.silver.__materialization_mat_' || us
                          WHEN 24 THEN 'main.silver.t' || us END END AS source_table_full_name,
    CASE e5 WHEN 0 THEN 'main.bronze.t' || ks WHEN 1 THEN 'main.silver.t' || ks
            WHEN 2 THEN 'analytics.gold.t' || ks WHEN 3 THEN 'analytics.mart.t' || ks
            ELSE CASE WHEN e25 IN (4, 14) THEN 'main.raw.t' || us
                      WHEN e25 = 19 THEN 'analytics.gold.t' || us
                      WHEN e25 = 24 THEN 'main.silver.t' || us END END AS target_table_full_name,
    CASE WHEN e25 = 4 THEN '/Volumes/main/raw/landing/f' || us || '.csv'
         WHEN e25 = 14 THEN 's3://bucket' || CAST(u % 5 AS STRING) || '/x' END AS source_path,
    CASE WHEN e25 = 9 THEN 'dbfs:/Volumes/main/raw/landing/_tmp' END AS target_path,
    CASE WHEN e7 = 0 THEN NULL WHEN e7 <= 3 THEN 'JOB' WHEN e7 <= 5 THEN 'PIPELINE'
         ELSE 'NOTEBOOK' END AS entity_type,
    CASE WHEN e7 = 0 THEN NULL WHEN e7 IN (4, 5) THEN 'p' || CAST(u % 20 AS STRING)
         ELSE CAST(e5 * 100 + u % 20 AS STRING) END AS entity_id,
    ts AS event_time,
    'user' || CAST(u % 9 AS STRING) AS created_by
  FROM (SELECT event_id AS e, user_id AS u, ts, event_id % 5 AS e5, event_id % 25 AS e25,
               event_id % 7 AS e7, CAST(user_id AS STRING) AS us,
               CAST((user_id * 7 + event_id % 2) % 150 AS STRING) AS ks
        FROM {events}) b
) r
""")

_SQL["column_lineage"] = (("events",), """
SELECT source_table_full_name, source_column_name, target_table_full_name, target_column_name,
       split_part(source_table_full_name, '.', 1) AS source_table_catalog,
       split_part(source_table_full_name, '.', 2) AS source_table_schema,
       split_part(target_table_full_name, '.', 1) AS target_table_catalog,
       split_part(target_table_full_name, '.', 2) AS target_table_schema,
       event_time
FROM (
  SELECT
    CASE e5 WHEN 0 THEN 'main.raw.t' || us WHEN 1 THEN 'main.bronze.t' || us
            WHEN 2 THEN 'main.silver.t' || us ELSE 'analytics.gold.t' || us END
      AS source_table_full_name,
    CASE e5 WHEN 0 THEN 'main.bronze.t' || ks WHEN 1 THEN 'main.silver.t' || ks
            WHEN 2 THEN 'analytics.gold.t' || ks ELSE 'analytics.mart.t' || ks END
      AS target_table_full_name,
    CASE WHEN e % 3 = 0 THEN 'C' ELSE 'c' END || CAST(e % 4 AS STRING) AS source_column_name,
    'c' || CAST((e + e % 2) % 4 AS STRING) AS target_column_name,
    ts AS event_time
  FROM (SELECT event_id AS e, ts, event_id % 5 AS e5, CAST(user_id AS STRING) AS us,
               CAST((user_id * 7 + event_id % 2) % 150 AS STRING) AS ks
        FROM {events} WHERE event_id % 5 < 4) b
) r
""")

_USERS = "(SELECT user_id AS u, CAST(user_id AS STRING) AS us, min(ts) AS first_ts, max(ts) AS last_ts FROM {events} GROUP BY user_id)"


def _user_tables(cat: str, sch: str) -> str:
    return f"""
  SELECT '{cat}' AS table_catalog, '{sch}' AS table_schema, 't' || us AS table_name,
         CASE u % 4 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'MATERIALIZED_VIEW' ELSE 'MANAGED' END AS table_type,
         'user' || CAST(u % 9 AS STRING) AS table_owner,
         CASE WHEN u % 3 = 0 THEN NULL ELSE '{sch} table ' || us END AS comment,
         first_ts AS created, last_ts AS last_altered
  FROM {_USERS} x"""


_SQL["tables"] = (("events", "nation", "region"), " UNION ALL ".join(
    [_user_tables(c, s) for c, s in (("main", "raw"), ("main", "bronze"), ("main", "silver"),
                                     ("analytics", "gold"), ("analytics", "mart"))]
    + ["""
  SELECT 'main', 'bronze', 'orphan' || CAST(n_nationkey AS STRING),
         CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 'EXTERNAL' END, NULL, NULL,
         CAST(NULL AS {ts}), CAST(NULL AS {ts})
  FROM {nation}""", """
  SELECT 'main', 'silver', '__materialization_mat_' || CAST(n_nationkey AS STRING), 'MANAGED',
         NULL, NULL, CAST(NULL AS {ts}), CAST(NULL AS {ts})
  FROM {nation}""", """
  SELECT 'main', 'default', 'd' || CAST(r_regionkey AS STRING), 'MANAGED', NULL, NULL,
         CAST(NULL AS {ts}), CAST(NULL AS {ts})
  FROM {region}"""]))


def _column_rows(ordinal: int, dtype: str) -> str:
    nullable = "YES" if ordinal % 2 == 0 else "NO"
    return f"""
  SELECT table_catalog, table_schema, table_name, 'c{ordinal - 1}' AS column_name,
         '{dtype}' AS data_type, '{dtype.lower()}' AS full_data_type,
         '{nullable}' AS is_nullable, CAST({ordinal} AS INT) AS ordinal_position
  FROM ({{tables_inner}}) t"""


_SQL["columns"] = (("events", "nation", "region"), " UNION ALL ".join(
    _column_rows(o, d) for o, d in ((1, "BIGINT"), (2, "STRING"), (3, "DOUBLE"), (4, "TIMESTAMP"))))

_SQL["usage"] = (("lineitem",), """
SELECT {usage_meta} AS usage_metadata, sku_name, usage_unit, usage_quantity,
       usage_start_time, usage_date
FROM (
  SELECT CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_suppkey % 20 AS STRING) END AS job_id,
         CASE WHEN l_linenumber % 3 = 0 THEN 'p' || CAST(l_suppkey % 20 AS STRING) END AS dlt_pipeline_id,
         CASE l_returnflag WHEN 'A' THEN 'PREMIUM_JOBS_SERVERLESS_COMPUTE'
                           WHEN 'R' THEN 'STANDARD_JOBS_SERVERLESS_COMPUTE'
                           ELSE 'PREMIUM_JOBS_COMPUTE' END AS sku_name,
         'DBU' AS usage_unit,
         CAST(l_quantity AS DECIMAL(18, 4)) AS usage_quantity,
         l_shipdate AS usage_start_time,
         CAST(l_shipdate AS DATE) AS usage_date
  FROM {lineitem}) u
""")

# Fixed list-price rows (FIXTURES.md 2.4): sku, unit, price, start, end.
_PRICE_ROWS = [
    ("PREMIUM_JOBS_SERVERLESS_COMPUTE", "DBU", "0.35", "1990-01-01 00:00:00", "2000-01-01 00:00:00"),
    ("PREMIUM_JOBS_SERVERLESS_COMPUTE", "DBU", "0.45", "2000-01-01 00:00:00", None),
    ("STANDARD_JOBS_SERVERLESS_COMPUTE", "DBU", "0.20", "1990-01-01 00:00:00", None),
    ("PREMIUM_JOBS_COMPUTE", "DBU", "0.15", "1990-01-01 00:00:00", None),
]


def _prices_sql() -> str:
    rows = []
    for sku, unit, price, start, end in _PRICE_ROWS:
        end_sql = f"{{ts}} '{end}'" if end else "CAST(NULL AS {ts})"
        rows.append(f"SELECT '{sku}' AS sku_name, '{unit}' AS usage_unit, "
                    f"CAST({price} AS DECIMAL(18, 4)) AS price, {{ts}} '{start}' AS price_start_time, "
                    f"{end_sql} AS price_end_time")
    return ("SELECT sku_name, usage_unit, {pricing} AS pricing, price_start_time, price_end_time "
            "FROM (" + " UNION ALL ".join(rows) + ") p")


_SQL["list_prices"] = ((), _prices_sql())

_SQL["jobs"] = (("nation", "region"), " UNION ALL ".join(
    f"""
  SELECT CAST({h} * 100 + n_nationkey AS STRING) AS job_id,
         CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 'job ' || CAST({h} * 100 + n_nationkey AS STRING) END AS name,
         CASE WHEN n_nationkey % 2 = 1 THEN NULL ELSE 'runner' || CAST(n_nationkey AS STRING) END AS run_as_user_name,
         'creator' || CAST(n_nationkey AS STRING) AS creator_user_name
  FROM {{nation}} WHERE n_nationkey < 20""" for h in range(5)) + """
  UNION ALL
  SELECT '1; DROP TABLE x --', 'poisoned', NULL, 'creator' || CAST(r_regionkey AS STRING)
  FROM {region} WHERE r_regionkey = 4""")

_SQL["pipelines"] = (("nation",), """
SELECT 'p' || CAST(n_nationkey AS STRING) AS pipeline_id,
       'pipeline ' || lower(n_name) AS name
FROM {nation} WHERE n_nationkey < 20 AND n_nationkey % 6 <> 5
""")

_SQL["audit"] = (("nation",), " UNION ALL ".join(
    f"""
  SELECT {{audit_map}} AS request_params FROM (
    SELECT CAST({h} * 100 + n_nationkey AS STRING) AS nb_id,
           CASE WHEN n_nationkey % 7 = 6 THEN NULL
                ELSE '/Workspace/Users/dev/nb_' || lower(n_name) || '_{h}' END AS nb_path
    FROM {{nation}} WHERE n_nationkey < 20 AND n_nationkey % 4 <> 3) a""" for h in range(5)))

_SQL["table_share_usage"] = (("nation",), """
SELECT 'analytics' AS catalog_name, 'gold' AS schema_name, 't' || CAST(n_nationkey AS STRING) AS table_name,
       'share' || CAST(n_regionkey AS STRING) AS share_name,
       CASE WHEN n_nationkey % 3 = 0 THEN 'pub' END AS shared_as_schema,
       CASE WHEN n_nationkey % 2 = 0 THEN 'p' || CAST(n_nationkey AS STRING) END AS shared_as_table,
       CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END AS cdf_enabled
FROM {nation}
""")

_SQL["share_recipient_privileges"] = (("customer", "nation"), """
SELECT DISTINCT share_name, recipient_name, privilege_type FROM (
  SELECT 'share' || CAST(n.n_regionkey AS STRING) AS share_name, c.c_mktsegment AS recipient_name,
         CASE WHEN c.c_nationkey % 4 = 0 THEN 'MODIFY' ELSE 'SELECT' END AS privilege_type,
         n.n_regionkey AS rk, length(c.c_mktsegment) AS sl
  FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey) x
WHERE (rk + sl) % 2 = 0
""")

_SQL["shares"] = (("region",), """
SELECT 'share' || CAST(r_regionkey AS STRING) AS share_name,
       'owner' || CAST(r_regionkey % 2 AS STRING) AS share_owner,
       lower(r_name) AS comment, 'admin' AS created_by
FROM {region}
""")

_SQL["recipients"] = (("customer",), """
SELECT recipient_name,
       CASE WHEN length(recipient_name) % 2 = 0 THEN 'TOKEN' ELSE 'OAUTH' END AS authentication_type,
       'owner' || CAST(length(recipient_name) % 3 AS STRING) AS recipient_owner,
       CAST(NULL AS STRING) AS comment
FROM (SELECT DISTINCT c_mktsegment AS recipient_name FROM {customer}) r
""")

_SQL["providers"] = (("region",), """
SELECT 'prov' || CAST(r_regionkey AS STRING) AS provider_name,
       CASE r_regionkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'azure' ELSE 'gcp' END AS cloud,
       'region-' || CAST(r_regionkey AS STRING) AS region,
       lower(r_name) AS comment
FROM {region} WHERE r_regionkey < 4
""")

_SQL["catalog_provider_share_usage"] = (("nation",), """
SELECT DISTINCT catalog_name, provider_name, share_name FROM (
  SELECT CASE WHEN n_nationkey < 2 THEN 'main' ELSE 'ext' || CAST(n_regionkey AS STRING) END AS catalog_name,
         CASE WHEN n_nationkey < 2 THEN 'prov0' ELSE 'prov' || CAST(n_regionkey AS STRING) END AS provider_name,
         CASE WHEN n_nationkey < 2 THEN 'share' || CAST(n_nationkey AS STRING)
              ELSE 'share' || CAST(n_regionkey AS STRING) END AS share_name
  FROM {nation}) x
""")

_SQL["request_log"] = (("events",), """
SELECT event_id AS request_id, ts, 'user' || CAST(user_id AS STRING) AS user_key, value AS latency_ms
FROM {events}
""")

_SQL["bronze_orders"] = (("orders",), """
SELECT CAST(o_orderkey AS INT) AS order_id, CAST(o_custkey AS INT) AS customer_id,
       o_totalprice AS amount, o_orderdate AS order_ts
FROM {orders}
""")

FIXTURES = tuple(_SQL)


def _render(name: str, dialect: str, names: dict[str, str]) -> str:
    deps, text = _SQL[name]
    fmt = dict(_dialect(dialect))
    fmt.update(names)
    if name == "columns":
        inner = _render("tables", dialect, names)
        text = text.replace("{tables_inner}", inner.replace("{", "{{").replace("}", "}}"))
    return text.format(**fmt)


def fixture_sql_duckdb(name: str) -> str:
    """The derivation as DuckDB SQL over the driver's registered views."""
    return _render(name, "duckdb", {t: t for t in BASE_TABLES})


def oracle_with(body: str, *fixtures: str) -> str:
    """Prefix an oracle query with CTEs for the fixtures it reads."""
    ctes = ",\n".join(f"{f} AS ({fixture_sql_duckdb(f)})" for f in fixtures)
    return f"WITH {ctes}\n{body}" if fixtures else body


def load_base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_STORED: dict[tuple[int, str, str], str] = {}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derivation as a stored parquet relation, like the event logs and
    metadata tables it stands in for: derived once per session into the
    checkpoint folder and read back, so operator scans see plain columns
    (pushdown, pruning, file statistics) rather than the derivation."""
    from ..session import checkpoint_dir
    key = (id(spark._jsparkSession), sf_dir.rstrip("/"), name)
    path = _STORED.get(key)
    if path is None:
        import uuid
        path = f"{checkpoint_dir(spark).rstrip('/')}/fixture-{name}-{uuid.uuid4().hex}"
        derive(spark, sf_dir, name).write.mode("overwrite").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(path)


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derivation as a lazy Spark DataFrame over the base tables."""
    deps, _ = _SQL[name]
    if name == "columns":
        deps = _SQL["tables"][0]
    params = {t: f"{{{t}}}" for t in BASE_TABLES}
    text = _render(name, "spark", params)
    dfs = {t: load_base(spark, sf_dir, t) for t in deps}
    return spark.sql(text, **dfs)
