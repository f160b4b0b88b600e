"""Registered queries over the lineage event logs: scans, refs, edges,
roll-ups, the whole-log graph and its view modes, and traces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import refs as R
from ..operators import closure as CL
from ..operators import graph as G
from ..operators import traverse as TV
from ..session import checkpoint_dir, materialize
from ..sources import scans as S
from . import common as C
from .common import register

TL = ("table_lineage",)
EV = ("ev", C.EV_SQL)


def _s(col: str) -> F.Column:
    return F.col(col).cast("string").alias(col)


# ---------------------------------------------------------------- scans

@register("scan_table_lineage", C.oracle(TL, [EV], """
SELECT source_table_full_name, target_table_full_name, source_type, target_type, source_path,
       target_path, entity_type, entity_id, CAST(event_time AS VARCHAR) AS event_time, created_by FROM ev"""))
def q_scan_table_lineage(spark, sf):
    """A1 + B1 + B2: windowed, internal-free lineage rows."""
    ev = C.lineage(spark, sf)
    return ev.select("source_table_full_name", "target_table_full_name", "source_type", "target_type",
                     "source_path", "target_path", "entity_type", "entity_id", _s("event_time"), "created_by")


@register("scan_table_lineage_partitioned", C.oracle(TL, [], f"""
SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS event_date, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities
FROM table_lineage WHERE event_time > {C.ts_bound(C.AS_OF, 20)}
  AND {C.not_internal_sql('source_table_full_name')} AND {C.not_internal_sql('target_table_full_name')} GROUP BY 1"""))
def q_scan_partitioned(spark, sf):
    """A1 over a log with one folder per event_date: a 20-day window reads only its folders."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/lineage-by-date-{uuid.uuid4().hex}"
    ev = S.scan_table_lineage(S.write_partitioned(C.fx(spark, sf, "table_lineage"), path), C.AS_OF, 20)
    return ev.groupBy(F.to_date("event_time").cast("string").alias("event_date")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("entity_id").alias("n_entities"))


@register("scan_table_lineage_short_window", C.oracle(TL, [], f"""
SELECT count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities FROM table_lineage
WHERE event_time > {C.ts_bound(C.AS_OF, 20)} AND {C.not_internal_sql('source_table_full_name')}
  AND {C.not_internal_sql('target_table_full_name')}"""))
def q_scan_short(spark, sf):
    """B1 with a 20-day window (events span 30 days)."""
    ev = C.lineage(spark, sf, C.AS_OF, 20)
    return ev.agg(F.count("*").alias("n_rows"), F.countDistinct("entity_id").alias("n_entities"))


@register("scan_column_lineage", C.oracle(("column_lineage",), [], f"""
SELECT source_table_full_name, source_column_name, target_table_full_name, target_column_name
FROM column_lineage WHERE event_time > {C.ts_bound()}"""))
def q_scan_column_lineage(spark, sf):
    """A2: windowed column-lineage rows."""
    return C.column_lineage(spark, sf).select("source_table_full_name", "source_column_name",
                                              "target_table_full_name", "target_column_name")


# ---------------------------------------------------------------- refs

_REF_ORACLE = C.oracle(TL, [EV, ("r", C.norm_rows_sql("ev")),
                            ("ids", "SELECT src AS id, src_type AS t FROM r WHERE src IS NOT NULL "
                                    "UNION ALL SELECT tgt, tgt_type FROM r WHERE tgt IS NOT NULL"),
                            ("n", "SELECT id, min(t) AS node_type FROM ids GROUP BY id")], f"""
SELECT id AS node_id, node_type, {C.label_sql('id', 'node_type')} AS name,
       CASE WHEN len(string_split(id, '.')) = 3 THEN split_part(id, '.', 1) ELSE '' END AS catalog,
       CASE WHEN len(string_split(id, '.')) = 3 THEN split_part(id, '.', 2) ELSE '' END AS schema,
       CASE WHEN len(string_split(id, '.')) = 3 THEN split_part(id, '.', 3) ELSE '' END AS table_name,
       CASE node_type WHEN 'MANAGED' THEN 'TABLE' WHEN 'TABLE' THEN 'TABLE' WHEN 'EXTERNAL' THEN 'TABLE'
         WHEN 'VIEW' THEN 'VIEW' WHEN 'MATERIALIZED_VIEW' THEN 'MAT VIEW' WHEN 'EXTERNAL_LINEAGE' THEN 'CROSS-SCHEMA'
         WHEN 'STREAMING_TABLE' THEN 'STREAMING' WHEN 'VOLUME' THEN 'VOLUME' WHEN 'PATH' THEN 'STORAGE'
         ELSE 'TABLE' END AS type_label,
       node_type IN ('EXTERNAL_LINEAGE', 'VOLUME', 'PATH') AS cross_schema
FROM n""")


@register("node_refs", _REF_ORACLE)
def q_node_refs(spark, sf):
    """B5 + B6 + B7 + B10: every distinct normalised endpoint with its type,
    display name, fqdn split and type label."""
    rows = G.normalize_rows(C.lineage(spark, sf))
    refs = G._ref_nodes(rows)
    cat, sch, name = R.split_fqdn("id")
    label, cross = R.type_label("table_type")
    return refs.select(F.col("id").alias("node_id"), F.col("table_type").alias("node_type"),
                       R.node_label(F.col("id"), F.col("table_type")).alias("name"),
                       cat.alias("catalog"), sch.alias("schema"), name.alias("table_name"),
                       label.alias("type_label"), cross.alias("cross_schema"))


# ---------------------------------------------------------------- edges / roll-ups

def _te_sql(where: str) -> str:
    return C.oracle(TL, [EV], f"""
SELECT DISTINCT source_table_full_name AS source, target_table_full_name AS target, entity_type, entity_id
FROM ev WHERE source_table_full_name IS NOT NULL AND target_table_full_name IS NOT NULL
  AND source_table_full_name <> target_table_full_name AND ({where})""")


@register("table_edges_schema", _te_sql(
    f"(target_table_catalog = '{C.SCOPE_CATALOG}' AND target_table_schema = '{C.SCOPE_SCHEMA}') OR "
    f"(source_table_catalog = '{C.SCOPE_CATALOG}' AND source_table_schema = '{C.SCOPE_SCHEMA}')"))
def q_table_edges_schema(spark, sf):
    """E5 (schema scope)."""
    return G.table_edges(C.lineage(spark, sf), C.SCOPE_CATALOG, C.SCOPE_SCHEMA)


@register("table_edges_catalog", _te_sql(
    f"target_table_catalog = '{C.CATALOG_SCOPE}' OR source_table_catalog = '{C.CATALOG_SCOPE}'"))
def q_table_edges_catalog(spark, sf):
    """E5 (catalog scope)."""
    return G.table_edges(C.lineage(spark, sf), C.CATALOG_SCOPE)


@register("table_edges_capped", C.oracle(TL, [EV], """
SELECT * FROM (SELECT DISTINCT source_table_full_name AS source, target_table_full_name AS target, entity_type, entity_id
  FROM ev WHERE source_table_full_name IS NOT NULL AND target_table_full_name IS NOT NULL
    AND source_table_full_name <> target_table_full_name) x
ORDER BY source NULLS FIRST, target NULLS FIRST, entity_type NULLS FIRST, entity_id NULLS FIRST LIMIT 1000"""))
def q_table_edges_capped(spark, sf):
    """The recorded-pairs scan with a cap made deterministic by a
    total order (cap 1,000 so it binds at every scale)."""
    return G.table_edges(C.lineage(spark, sf), limit=1000)


_CE = f"""SELECT DISTINCT source_table_full_name AS source_table, source_column_name AS source_column,
       target_table_full_name AS target_table, target_column_name AS target_column
FROM column_lineage WHERE event_time > {C.ts_bound()}
  AND source_table_full_name IS NOT NULL AND target_table_full_name IS NOT NULL
  AND source_table_full_name <> target_table_full_name
  AND source_column_name IS NOT NULL AND target_column_name IS NOT NULL"""


@register("column_edges_schema", C.oracle(("column_lineage",), [], _CE + """
  AND ((target_table_catalog = 'main' AND target_table_schema = 'silver')
       OR (source_table_catalog = 'main' AND source_table_schema = 'silver'))"""))
def q_column_edges(spark, sf):
    """Distinct column edges of schema main.silver."""
    return G.column_edges(C.column_lineage(spark, sf), "main", "silver")


@register("column_edges_of", C.oracle(("column_lineage",), [("ce", _CE + """
  AND ((target_table_catalog = 'main' AND target_table_schema = 'silver')
       OR (source_table_catalog = 'main' AND source_table_schema = 'silver'))""")], """
SELECT * FROM ce WHERE (source_table = 'main.silver.t7' AND source_column = 'c1')
                    OR (target_table = 'main.silver.t7' AND target_column = 'c1')"""))
def q_column_edges_of(spark, sf):
    """Edges of one (table, column), exact match either side."""
    return G.column_edges_of(G.column_edges(C.column_lineage(spark, sf), "main", "silver"), "main.silver.t7", "c1")


@register("dedupe_rows", C.oracle(TL, [EV], f"""
SELECT source_table_full_name, target_table_full_name, source_path, target_path, entity_type, entity_id,
       CAST(max(event_time) AS VARCHAR) AS event_time, {C.owner_sql()} AS created_by
FROM ev GROUP BY ALL"""))
def q_dedupe(spark, sf):
    """One row per 6-key with newest event and its owner."""
    d = G.dedupe_rows(C.lineage(spark, sf))
    return d.select(*G.ROW_KEY, _s("event_time"), "created_by")


@register("entity_rollup", C.oracle(TL, [EV, ("r", C.norm_rows_sql("ev"))], f"""
SELECT ekey, entity_type, entity_id,
       count(DISTINCT src) AS n_sources, count(DISTINCT tgt) AS n_targets,
       CAST(max(event_time) AS VARCHAR) AS last_run, {C.owner_sql()} AS owner
FROM r WHERE ekey IS NOT NULL GROUP BY ekey, entity_type, entity_id"""))
def q_entity_rollup(spark, sf):
    """Per-entity distinct sources/targets, last run, owner."""
    r = G.entity_rollup(G.normalize_rows(C.lineage(spark, sf)))
    return r.withColumn("last_run", F.col("last_run").cast("string"))


# ---------------------------------------------------------------- whole-log graph

_FULL_CTES = [EV, ("r", C.norm_rows_sql("ev")),
              ("er", "SELECT * FROM r WHERE ekey IS NOT NULL"),
              ("edges", C.routed_edges_sql("er") + """
      UNION SELECT src, tgt FROM r WHERE ekey IS NULL AND src IS NOT NULL AND tgt IS NOT NULL"""),
              ("ids", "SELECT src AS id, src_type AS t FROM r WHERE src IS NOT NULL "
                      "UNION ALL SELECT tgt, tgt_type FROM r WHERE tgt IS NOT NULL"),
              ("nodes", f"""
      SELECT id, 'table' AS node_type, {C.label_sql('id', 'min(t)')} AS name, min(t) AS table_type,
             CAST(NULL AS VARCHAR) AS entity_type, CAST(NULL AS VARCHAR) AS entity_id, CAST(NULL AS VARCHAR) AS last_run, CAST(NULL AS VARCHAR) AS owner
      FROM ids GROUP BY id
      UNION ALL
      SELECT ekey, 'entity', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), entity_type, entity_id, CAST(max(event_time) AS VARCHAR),
             {C.owner_sql()}
      FROM er GROUP BY ekey, entity_type, entity_id"""),
              ("cls", C.classify_sql("nodes", "edges"))]


def full_graph(spark, sf) -> G.Graph:
    """The whole windowed log as one graph (trace builder over every row)."""
    rows = materialize(G.normalize_rows(G.dedupe_rows(C.lineage(spark, sf))), "log-rows")
    return G.build_trace_graph(rows)


_NODE_OUT = ("id", "node_type", "name", "table_type", "entity_type", "entity_id", "last_run", "owner",
             "upstream_count", "downstream_count", "lineage_status")


def _node_out(nodes: DataFrame) -> DataFrame:
    return nodes.select(*[F.col(c).cast("string").alias(c) if c == "last_run" else F.col(c) for c in _NODE_OUT])


@register("graph_nodes", C.oracle(TL, _FULL_CTES, "SELECT " + ", ".join(_NODE_OUT) + " FROM cls"))
def q_graph_nodes(spark, sf):
    """B5 + E2 + E1 over the whole log: table and entity nodes with degree
    counts and root/leaf/orphan/connected status."""
    return _node_out(full_graph(spark, sf).nodes)


@register("graph_edges", C.oracle(TL, _FULL_CTES, "SELECT source, target FROM edges"))
def q_graph_edges(spark, sf):
    """Read-after-write routed edge set of the whole log."""
    return full_graph(spark, sf).edges


@register("full_view_edges", C.oracle(TL, _FULL_CTES, "SELECT e.source, e.target FROM edges e"))
def q_full_view_edges(spark, sf):
    """V3: the full view keeps every edge, entities included."""
    return G.full_view(full_graph(spark, sf)).edges


_COLLAPSE = """
SELECT DISTINCT source, target FROM (
  SELECT source, target FROM edges WHERE NOT starts_with(source, 'entity:') AND NOT starts_with(target, 'entity:')
  UNION ALL
  SELECT i.source, o.target FROM edges i JOIN edges o ON i.target = o.source
  WHERE NOT starts_with(i.source, 'entity:') AND starts_with(i.target, 'entity:')
    AND NOT starts_with(o.target, 'entity:')) x
WHERE source <> target"""


@register("tables_view_edges", C.oracle(TL, _FULL_CTES, _COLLAPSE))
def q_tables_view(spark, sf):
    """Entity-mediated edges collapsed to table -> table."""
    g = full_graph(spark, sf)
    return G.tables_view(G.Graph(g.nodes, materialize(g.edges, "graph-edges"))).edges


@register("pipelines_view_edges", C.oracle(TL, _FULL_CTES, """
SELECT DISTINCT w.source, r.target FROM edges w JOIN edges r ON w.target = r.source
WHERE starts_with(w.source, 'entity:') AND NOT starts_with(w.target, 'entity:')
  AND starts_with(r.target, 'entity:') AND w.source <> r.target"""))
def q_pipelines_view(spark, sf):
    """V2 / C11: entity -> entity dependencies through shared tables."""
    return G.pipelines_view(full_graph(spark, sf)).edges


# ---------------------------------------------------------------- traces

def _walk_sql(direction: str, seed_sql: str, max_hops: int = C.ORACLE_HOPS) -> list:
    if direction == "up":
        adj = "SELECT DISTINCT target_table_full_name AS node, source_table_full_name AS nbr FROM ev"
    else:
        adj = "SELECT DISTINCT source_table_full_name AS node, target_table_full_name AS nbr FROM ev"
    adj += " WHERE source_table_full_name IS NOT NULL AND target_table_full_name IS NOT NULL"
    name = f"w_{direction}"
    return [(f"adj_{direction}", adj),
            (f"{name}(seed, node, hop)", f"""
      SELECT seed, seed, 0 FROM ({seed_sql}) s
      UNION SELECT w.seed, a.nbr, w.hop + 1 FROM {name} w JOIN adj_{direction} a ON a.node = w.node
      WHERE w.hop < {max_hops}"""),
            (f"m_{direction}", f"SELECT seed, node, min(hop) AS hop FROM {name} GROUP BY seed, node")]


_SEED_SQL = f"SELECT '{C.SEED}' AS seed"


@register("trace_up", C.oracle(TL, [EV] + _walk_sql("up", _SEED_SQL),
                               "SELECT node, CAST(hop AS INT) AS hop FROM m_up", recursive=True))
def q_trace_up(spark, sf):
    """Ancestors of the seed with their minimum hop."""
    return TV.trace(C.lineage(spark, sf), C.SEED, "up", C.MAX_HOPS).withColumn("hop", F.col("hop").cast("int"))


@register("trace_down", C.oracle(TL, [EV] + _walk_sql("down", _SEED_SQL),
                                 "SELECT node, CAST(hop AS INT) AS hop FROM m_down", recursive=True))
def q_trace_down(spark, sf):
    """Descendants of the seed with their minimum hop."""
    return TV.trace(C.lineage(spark, sf), C.SEED, "down", C.MAX_HOPS).withColumn("hop", F.col("hop").cast("int"))


_MANY_SEEDS = """SELECT table_catalog || '.' || table_schema || '.' || table_name AS seed FROM tables
  WHERE table_catalog = 'analytics' AND table_schema = 'gold'
    AND NOT regexp_matches(table_name, '^(__materialization_mat_|event_log_|__apply_changes)')"""


@register("trace_many", C.oracle(TL + ("tables",), [EV] + _walk_sql("up", _MANY_SEEDS)
                                 + _walk_sql("down", _MANY_SEEDS), """
SELECT seed, node, 'up' AS direction, CAST(hop AS INT) AS hop FROM m_up
UNION ALL SELECT seed, node, 'down', CAST(hop AS INT) FROM m_down""", recursive=True))
def q_trace_many(spark, sf):
    """All gold tables traced at once, both directions, one loop."""
    from ..sources import scans as S
    seeds = (S.list_tables(C.fx(spark, sf, "tables"))
             .filter((F.col("catalog") == "analytics") & (F.col("schema") == "gold"))
             .select(F.col("fqdn").alias("seed")))
    out = TV.trace_many(C.lineage(spark, sf), seeds, C.MAX_HOPS)
    return out.withColumn("hop", F.col("hop").cast("int"))


_ALL_SEEDS = f"""SELECT DISTINCT table_catalog || '.' || table_schema || '.' || table_name AS seed FROM tables
  WHERE table_catalog NOT IN ({', '.join(f"'{c}'" for c in S.SKIP_CATALOGS)})
    AND table_schema NOT IN ({', '.join(f"'{c}'" for c in S.SKIP_SCHEMAS)})
    AND NOT regexp_matches(table_name, '^(__materialization_mat_|event_log_|__apply_changes)')"""


def _cone_sql(direction: str) -> list:
    a, b = ("target", "source") if direction == "up" else ("source", "target")
    return [(f"c_{direction}(seed, node)", f"""SELECT seed, seed FROM ({_ALL_SEEDS}) s
      UNION SELECT w.seed, ev.{b}_table_full_name FROM c_{direction} w JOIN ev ON ev.{a}_table_full_name = w.node
      WHERE ev.{b}_table_full_name IS NOT NULL""")]


def _all_cones(spark, sf):
    seeds = S.list_tables(C.fx(spark, sf, "tables")).select(F.col("fqdn").alias("seed"))
    return CL.seed_cones(C.lineage(spark, sf), seeds)


@register("cone_pairs", C.oracle(TL + ("tables",), [EV] + _cone_sql("up") + _cone_sql("down"), """
SELECT seed, node, 'up' AS direction FROM c_up UNION ALL SELECT seed, node, 'down' FROM c_down""", recursive=True))
def q_cone_pairs(spark, sf):
    """D4 over every table of the catalogs, as sets of seeds: no hop limit."""
    return CL.seed_nodes(_all_cones(spark, sf))


@register("cone_counts", C.oracle(TL + ("tables",), [EV] + _cone_sql("up") + _cone_sql("down"), """
SELECT node, 'up' AS direction, count(*) AS n_seeds FROM c_up GROUP BY node
UNION ALL SELECT node, 'down', count(*) FROM c_down GROUP BY node""", recursive=True))
def q_cone_counts(spark, sf):
    """D4 over every table: of how many tables each node is an ancestor or descendant, from bitmaps alone."""
    return CL.seed_counts(_all_cones(spark, sf))


@register("cone_sizes", C.oracle(TL + ("tables",), [EV] + _cone_sql("up") + _cone_sql("down"), """
SELECT seed, 'up' AS direction, count(*) AS n_nodes FROM c_up GROUP BY seed
UNION ALL SELECT seed, 'down', count(*) FROM c_down GROUP BY seed""", recursive=True))
def q_cone_sizes(spark, sf):
    """D4 over every table: the size of each table's cones."""
    return CL.cone_sizes(_all_cones(spark, sf))


_TRACE_CTES = ([EV] + _walk_sql("up", _SEED_SQL) + _walk_sql("down", _SEED_SQL) + [
    ("tr", f"""SELECT * FROM ev WHERE target_table_full_name IN (SELECT node FROM m_up WHERE hop < {C.ORACLE_HOPS})
      UNION SELECT * FROM ev WHERE source_table_full_name IN (SELECT node FROM m_down WHERE hop < {C.ORACLE_HOPS})"""),
    ("r", C.norm_rows_sql("tr")),
    ("er", "SELECT * FROM r WHERE ekey IS NOT NULL"),
    ("edges", C.routed_edges_sql("er") + """
      UNION SELECT src, tgt FROM r WHERE ekey IS NULL AND src IS NOT NULL AND tgt IS NOT NULL"""),
    ("ids", "SELECT src AS id, src_type AS t FROM r WHERE src IS NOT NULL "
            "UNION ALL SELECT tgt, tgt_type FROM r WHERE tgt IS NOT NULL"),
    ("colsn", """SELECT table_catalog || '.' || table_schema || '.' || table_name AS id, count(*) AS n
      FROM columns GROUP BY ALL"""),
    ("nodes", f"""
      SELECT ids.id, 'table' AS node_type, {C.label_sql('ids.id', 'min(t)')} AS name, min(t) AS table_type,
             CAST(NULL AS VARCHAR) AS entity_type, CAST(NULL AS VARCHAR) AS entity_id, CAST(NULL AS VARCHAR) AS last_run, CAST(NULL AS VARCHAR) AS owner,
             CASE WHEN min(t) IN ('VOLUME', 'PATH') THEN 0 ELSE coalesce(max(colsn.n), 0) END AS n_columns
      FROM ids LEFT JOIN colsn ON colsn.id = ids.id GROUP BY ids.id
      UNION ALL
      SELECT ekey, 'entity', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), entity_type, entity_id, CAST(max(event_time) AS VARCHAR),
             {C.owner_sql()}, 0
      FROM er GROUP BY ekey, entity_type, entity_id"""),
    ("cls", C.classify_sql("nodes", "edges"))])


def _trace_graph(spark, sf) -> G.Graph:
    return TV.trace_graph(C.lineage(spark, sf), C.SEED, C.MAX_HOPS,
                          columns_meta=C.fx(spark, sf, "columns"), window_days=C.DAYS)


@register("trace_nodes", C.oracle(TL + ("columns",), _TRACE_CTES,
                                  "SELECT " + ", ".join(_NODE_OUT) + ", CAST(n_columns AS INT) AS n_columns FROM cls",
                                  recursive=True))
def q_trace_nodes(spark, sf):
    """D3: nodes of the seed's full cone with columns, degrees, status."""
    nodes = _trace_graph(spark, sf).nodes
    return nodes.select(*[F.col(c).cast("string").alias(c) if c == "last_run" else F.col(c) for c in _NODE_OUT],
                        F.size("columns").alias("n_columns"))


@register("trace_edges", C.oracle(TL + ("columns",), _TRACE_CTES, "SELECT source, target FROM edges",
                                  recursive=True))
def q_trace_edges(spark, sf):
    """D3: routed edges of the seed's full cone."""
    return _trace_graph(spark, sf).edges


@register("trace_meta", C.oracle(TL, [EV] + _walk_sql("up", _SEED_SQL) + _walk_sql("down", _SEED_SQL), f"""
SELECT (EXISTS (SELECT 1 FROM ev WHERE target_table_full_name IN (SELECT node FROM m_up WHERE hop >= {C.ORACLE_HOPS}))
        OR EXISTS (SELECT 1 FROM ev WHERE source_table_full_name IN (SELECT node FROM m_down WHERE hop >= {C.ORACLE_HOPS})))
       AS truncated, CAST({C.DAYS} AS INT) AS lineage_window_days""", recursive=True))
def q_trace_meta(spark, sf):
    """D3 meta: truncated flag and window days."""
    g = TV.trace_graph(C.lineage(spark, sf), C.SEED, C.MAX_HOPS, window_days=C.DAYS)
    return g.meta


@register("trace_meta_shallow", C.oracle(TL, [EV] + _walk_sql("up", _SEED_SQL, 2)
                                         + _walk_sql("down", _SEED_SQL, 2), """
SELECT (EXISTS (SELECT 1 FROM ev WHERE target_table_full_name IN (SELECT node FROM m_up WHERE hop >= 2))
        OR EXISTS (SELECT 1 FROM ev WHERE source_table_full_name IN (SELECT node FROM m_down WHERE hop >= 2)))
       AS truncated, count_up, count_down FROM
  (SELECT count(*) AS count_up FROM m_up), (SELECT count(*) AS count_down FROM m_down)""", recursive=True))
def q_trace_meta_shallow(spark, sf):
    """L4: a 2-hop trace is truncated; node counts per direction."""
    ev = C.lineage(spark, sf)
    reached = TV.trace_many(ev, [C.SEED], 2)
    more = TV.truncation_rows(ev, reached, 2).select(F.lit(None).cast("string").alias("direction"),
                                                     F.lit(1).alias("more"))
    both = reached.select("direction", F.lit(0).alias("more")).unionByName(more)
    return both.agg((F.max("more") > 0).alias("truncated"),
                    F.count(F.when(F.col("direction") == "up", 1)).alias("count_up"),
                    F.count(F.when(F.col("direction") == "down", 1)).alias("count_down"))
