"""Registered queries: layering and map placement, export reports, the
request log, the demo medallion workload and data readiness."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as CA
from ..operators import cost as CO
from ..operators import graph as G
from ..operators import layering as LY
from ..operators import medallion as MD
from ..operators import readiness as RD
from ..operators import reports as RP
from ..operators import requests as RQ
from ..session import checkpoint_dir, materialize
from . import common as C
from .common import register
from .graph_queries import _scope_ctes, scope_graph
from .catalog_queries import _REG, _REG_FX, _registry
from .graph_queries import _COST_FX, _COSTS_CTES, _cost

TL = ("table_lineage",)
SC_FX = TL + ("tables", "columns")
SCOPE = ("main", "bronze")

# DuckDB layering oracle: SCCs from the transitive closure, longest path on
# the condensation.
_LAYER_CTES = _scope_ctes(*SCOPE) + [
    ("ce0", """SELECT DISTINCT source, target FROM edges WHERE source <> target
        AND source IN (SELECT id FROM cls) AND target IN (SELECT id FROM cls)"""),
    ("conn", "SELECT source AS id FROM ce0 UNION SELECT target FROM ce0"),
    ("tc(s, t)", "SELECT source, target FROM ce0 UNION SELECT tc.s, e.target FROM tc JOIN ce0 e ON e.source = tc.t"),
    ("mutual", "SELECT a.s AS id, a.t AS v FROM tc a JOIN tc b ON a.s = b.t AND a.t = b.s"),
    ("comp", "SELECT c.id, least(c.id, coalesce(min(m.v), c.id)) AS comp FROM conn c "
             "LEFT JOIN mutual m ON m.id = c.id GROUP BY c.id"),
    ("cedge", """SELECT DISTINCT ca.comp AS s, cb.comp AS t FROM ce0 JOIN comp ca ON ca.id = ce0.source
        JOIN comp cb ON cb.id = ce0.target WHERE ca.comp <> cb.comp"""),
    ("lp(c, l)", """SELECT DISTINCT comp, 0 FROM comp WHERE comp NOT IN (SELECT t FROM cedge)
        UNION SELECT e.t, lp.l + 1 FROM lp JOIN cedge e ON e.s = lp.c"""),
    ("clayer", "SELECT c, max(l) AS layer FROM lp GROUP BY c"),
    ("layers", """SELECT n.id, CAST(cl.layer AS INT) AS layer, comp.id IS NULL AS orphan
        FROM cls n LEFT JOIN comp ON comp.id = n.id LEFT JOIN clayer cl ON cl.c = comp.comp"""),
]


def _written(g: G.Graph) -> G.Graph:
    """A graph whose plan is cut, for queries that read it several times."""
    return G.Graph(materialize(g.nodes, "graph-nodes"), materialize(g.edges, "graph-edges"))


def _layers(spark, sf):
    g = _written(scope_graph(spark, sf, *SCOPE))
    return g, LY.layer_nodes(g.nodes, g.edges)


@register("layer_nodes", C.oracle(SC_FX, _LAYER_CTES, "SELECT id, coalesce(layer, -1) AS layer, orphan FROM layers",
                                  recursive=True))
def q_layer_nodes(spark, sf):
    """D11 + D12: longest-path layer of every node of the main.bronze scope
    graph (cycles condensed to components), orphans flagged."""
    out = _layers(spark, sf)[1]
    return out.withColumn("layer", F.coalesce("layer", F.lit(-1)))


@register("map_slots", C.oracle(SC_FX, _LAYER_CTES + [
    ("lab", "SELECT l.*, lower(coalesce(n.name, n.id)) AS k FROM layers l JOIN cls n ON n.id = l.id"),
    ("pr", "SELECT greatest(coalesce(max(layer) + 1, 0), 4) AS per_row FROM layers WHERE NOT orphan")], """
SELECT id, layer, CAST(row_number() OVER (PARTITION BY layer ORDER BY k, id) - 1 AS INT) AS slot,
       -1 AS grid_row, -1 AS grid_col FROM lab WHERE NOT orphan
UNION ALL
SELECT id, -1, -1,
       CAST(floor((row_number() OVER (ORDER BY k, id) - 1) / (SELECT per_row FROM pr)) AS INT),
       CAST((row_number() OVER (ORDER BY k, id) - 1) % (SELECT per_row FROM pr) AS INT)
FROM lab WHERE orphan""", recursive=True))
def q_map_slots(spark, sf):
    """D14 + P6: map placement — slot within layer by lower(name), orphan grid."""
    g, layers = _layers(spark, sf)
    out = LY.map_slots(g.nodes, layers)
    return out.select("id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("layer", "slot", "grid_row", "grid_col")])


# Boxes of a map: a node's label with its resolved name, its type and status.
_BOX_CTES = [("reg", _REG),
    ("regg", "SELECT DISTINCT ON (entity_type, entity_id) entity_type, entity_id, name FROM reg ORDER BY entity_type, entity_id, name NULLS LAST"),
    ("named", """SELECT n.*, CASE WHEN NOT regexp_full_match(n.entity_id, '[A-Za-z0-9_./@ +:-]{1,512}') THEN n.entity_type || ' ' || left(n.entity_id, 12)
        WHEN n.entity_type = 'NOTEBOOK' AND contains(n.entity_id, '/') THEN string_split(n.entity_id, '/')[-1]
        WHEN n.entity_type = 'NOTEBOOK' THEN coalesce(r.name, 'Notebook ' || left(n.entity_id, 12))
        WHEN n.entity_type IN ('JOB', 'PIPELINE') AND r.name <> '' THEN r.name
        ELSE n.entity_type || ' ' || left(n.entity_id, 12) END AS shown
      FROM cls n LEFT JOIN regg r ON r.entity_type = n.entity_type AND r.entity_id = n.entity_id"""),
    ("box", """SELECT id, node_type AS kind, CASE node_type WHEN 'entity' THEN shown ELSE name END AS label,
        CASE node_type WHEN 'entity' THEN entity_type ELSE table_type END AS type, coalesce(lineage_status, '') AS status FROM named""")]


def _names(spark, sf, nodes):
    """Display names of the entities among ``nodes``."""
    ents = nodes.filter(F.col("node_type") == "entity").select("entity_type", "entity_id").distinct()
    return CA.resolve_names(ents, _registry(spark, sf))


@register("report_lineage_map", C.oracle(SC_FX + _REG_FX, _LAYER_CTES + _BOX_CTES + [
    ("lab", "SELECT l.*, lower(coalesce(n.name, n.id)) AS k FROM layers l JOIN cls n ON n.id = l.id"),
    ("pr", "SELECT greatest(coalesce(max(layer) + 1, 0), 4) AS per_row FROM layers WHERE NOT orphan"),
    ("slots", """
SELECT id, layer, CAST(row_number() OVER (PARTITION BY layer ORDER BY k, id) - 1 AS INT) AS slot,
       -1 AS grid_row, -1 AS grid_col FROM lab WHERE NOT orphan
UNION ALL
SELECT id, -1, -1,
       CAST(floor((row_number() OVER (ORDER BY k, id) - 1) / (SELECT per_row FROM pr)) AS INT),
       CAST((row_number() OVER (ORDER BY k, id) - 1) % (SELECT per_row FROM pr) AS INT)
FROM lab WHERE orphan""")], """
SELECT b.id, b.kind, b.label, b.type, b.status, s.layer, s.slot, s.grid_row, s.grid_col
FROM box b JOIN slots s ON s.id = b.id""", recursive=True))
def q_report_lineage_map(spark, sf):
    """Lineage-map rows of the main.bronze scope: node, kind, label,
    layer and slot (or orphan grid cell)."""
    g, layers = _layers(spark, sf)
    m = RP.lineage_map(g.nodes, LY.map_slots(g.nodes, layers), _names(spark, sf, g.nodes))
    return m.select("id", "kind", "label", "type", "status",
                    *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("layer", "slot", "grid_row", "grid_col")])


_MAPS_CTES = _scope_ctes("analytics", None) + [
    ("und", "SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges"),
    ("tbl", """SELECT id, CASE WHEN len(string_split(id, '.')) = 3 THEN split_part(id, '.', 2) ELSE '' END AS schema
        FROM cls WHERE node_type = 'table'"""),
    ("nb", "SELECT t.schema, u.b AS id FROM tbl t JOIN und u ON u.a = t.id"),
    ("enb", "SELECT nb.schema, u.b AS id FROM nb JOIN und u ON u.a = nb.id WHERE starts_with(nb.id, 'entity:')"),
    ("member", "SELECT schema, id FROM tbl UNION SELECT schema, id FROM nb UNION SELECT schema, id FROM enb"),
    ("sube", """SELECT DISTINCT ms.schema FROM edges e JOIN member ms ON ms.id = e.source
        JOIN member mt ON mt.id = e.target AND mt.schema = ms.schema"""),
    ("top", """SELECT schema, n, row_number() OVER (ORDER BY n DESC, schema) AS rank FROM (
        SELECT schema, count(*) AS n FROM tbl WHERE schema IN (SELECT schema FROM sube) GROUP BY schema) x
        ORDER BY n DESC, schema LIMIT 12""")]


@register("schema_maps_top", C.oracle(SC_FX, _MAPS_CTES, """
SELECT m.schema, m.id, CAST(t.rank AS INT) AS rank FROM member m JOIN top t ON t.schema = m.schema"""))
def q_schema_maps_top(spark, sf):
    """D13 with the report's top 12 schemas by table count: map membership in
    the analytics catalog graph, empty maps skipped."""
    m = LY.schema_maps(scope_graph(spark, sf, "analytics", None), 12)
    return m.select("schema", "id", F.col("rank").cast("int").alias("rank"))


_ALL_MAPS_CTES = _MAPS_CTES[:-1] + [
    ("ranked", """SELECT schema, row_number() OVER (ORDER BY count(*) DESC, schema) AS rank FROM tbl
        WHERE schema IN (SELECT schema FROM sube) GROUP BY schema""")]


_ALL_MAPS = C.oracle(SC_FX, _ALL_MAPS_CTES, """
SELECT m.schema, m.id, CAST(r.rank AS INT) AS rank FROM member m JOIN ranked r ON r.schema = m.schema""")


@register("schema_maps", _ALL_MAPS)
@register("schema_maps_all", _ALL_MAPS)
def q_schema_maps(spark, sf):
    """Map membership of every schema of the analytics catalog graph,
    with its rank by table count; empty maps skipped."""
    m = LY.schema_maps(scope_graph(spark, sf, "analytics", None))
    return m.select("schema", "id", F.col("rank").cast("int").alias("rank"))


# Every map by itself: closure, condensation and longest paths with the schema as a key.
_PLACED_CTES = _ALL_MAPS_CTES + [
    ("mem", "SELECT m.schema, m.id, r.rank FROM member m JOIN ranked r ON r.schema = m.schema"),
    ("me", """SELECT DISTINCT a.schema, e.source, e.target FROM edges e JOIN mem a ON a.id = e.source
        JOIN mem b ON b.id = e.target AND b.schema = a.schema WHERE e.source <> e.target"""),
    ("mt(k, s, t)", "SELECT schema, source, target FROM me UNION SELECT mt.k, mt.s, e.target FROM mt JOIN me e ON e.schema = mt.k AND e.source = mt.t"),
    ("mc", """SELECT x.k, x.id, least(x.id, coalesce(min(b.s), x.id)) AS comp
        FROM (SELECT schema AS k, source AS id FROM me UNION SELECT schema, target FROM me) x
        LEFT JOIN (SELECT a.k, a.s, a.t FROM mt a JOIN mt b ON b.k = a.k AND b.s = a.t AND b.t = a.s) b ON b.k = x.k AND b.t = x.id
        GROUP BY x.k, x.id"""),
    ("md", """SELECT DISTINCT me.schema AS k, a.comp AS s, b.comp AS t FROM me JOIN mc a ON a.k = me.schema AND a.id = me.source
        JOIN mc b ON b.k = me.schema AND b.id = me.target WHERE a.comp <> b.comp"""),
    ("ml(k, c, l)", """SELECT DISTINCT k, comp, 0 FROM mc WHERE NOT EXISTS (SELECT 1 FROM md WHERE md.k = mc.k AND md.t = mc.comp)
        UNION SELECT ml.k, md.t, ml.l + 1 FROM ml JOIN md ON md.k = ml.k AND md.s = ml.c"""),
    ("placed", """SELECT mem.schema, mem.rank, mem.id, d.layer, lower(coalesce(n.name, n.id)) AS label_key,
          greatest(coalesce(max(d.layer) OVER (PARTITION BY mem.schema) + 1, 0), 4) AS wide
        FROM mem JOIN cls n ON n.id = mem.id LEFT JOIN mc ON mc.k = mem.schema AND mc.id = mem.id
        LEFT JOIN (SELECT k, c, max(l) AS layer FROM ml GROUP BY k, c) d ON d.k = mc.k AND d.c = mc.comp"""),
    ("spot", "SELECT *, row_number() OVER (PARTITION BY schema, layer ORDER BY label_key, id) - 1 AS at FROM placed")]


@register("report_schema_maps", C.oracle(SC_FX + _REG_FX, _PLACED_CTES + _BOX_CTES, """
SELECT s.schema, s.rank::INT AS rank, s.id, b.kind, b.label, b.type, b.status, coalesce(s.layer, -1)::INT AS layer,
  CASE WHEN s.layer IS NULL THEN -1 ELSE s.at END::INT AS slot, CASE WHEN s.layer IS NULL THEN s.at // s.wide ELSE -1 END::INT AS grid_row,
  CASE WHEN s.layer IS NULL THEN s.at % s.wide ELSE -1 END::INT AS grid_col
FROM spot s JOIN box b ON b.id = s.id""", recursive=True))
def q_report_schema_maps(spark, sf):
    """P6 over all schemas of the analytics catalog: every schema's map,
    layered and placed in the same rounds, with resolved labels."""
    g = _written(scope_graph(spark, sf, "analytics", None))
    m = RP.lineage_map(g.nodes, LY.placed_schema_maps(g), _names(spark, sf, g.nodes))
    return m.select("schema", "rank", "id", "kind", "label", "type", "status",
                    *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("layer", "slot", "grid_row", "grid_col")])


# ---------------------------------------------------------------- reports

_TE_BRONZE = f"""SELECT DISTINCT source_table_full_name AS source, target_table_full_name AS target, entity_type, entity_id
    FROM ev WHERE source_table_full_name IS NOT NULL AND target_table_full_name IS NOT NULL
      AND source_table_full_name <> target_table_full_name
      AND ((target_table_catalog = 'main' AND target_table_schema = 'bronze')
           OR (source_table_catalog = 'main' AND source_table_schema = 'bronze'))"""
_CE_BRONZE = f"""SELECT DISTINCT source_table_full_name AS source_table, source_column_name AS source_column,
       target_table_full_name AS target_table, target_column_name AS target_column
    FROM column_lineage WHERE event_time > {C.ts_bound()}
      AND source_table_full_name IS NOT NULL AND target_table_full_name IS NOT NULL
      AND source_table_full_name <> target_table_full_name
      AND source_column_name IS NOT NULL AND target_column_name IS NOT NULL
      AND ((target_table_catalog = 'main' AND target_table_schema = 'bronze')
           OR (source_table_catalog = 'main' AND source_table_schema = 'bronze'))"""
_RP_CTES = _scope_ctes(*SCOPE) + [("te", _TE_BRONZE), ("cedges", _CE_BRONZE)]
_RP_FX = SC_FX + ("column_lineage",)


def _report_inputs(spark, sf):
    g = scope_graph(spark, sf, *SCOPE)
    te = G.table_edges(C.lineage(spark, sf), *SCOPE)
    ce = G.column_edges(C.column_lineage(spark, sf), *SCOPE)
    return g, te, ce


@register("report_summary", C.oracle(_RP_FX, _RP_CTES, """
SELECT 'tables' AS metric, count(*) AS value FROM cls WHERE node_type = 'table'
UNION ALL SELECT 'entities', count(*) FROM cls WHERE node_type = 'entity'
UNION ALL SELECT 'table_edges', count(*) FROM te
UNION ALL SELECT 'orphans', count(*) FROM cls WHERE node_type = 'table' AND lineage_status = 'orphan'
UNION ALL SELECT 'column_edges', count(*) FROM cedges""", recursive=False))
def q_report_summary(spark, sf):
    """Export KPIs of the main.bronze scope."""
    g, te, ce = _report_inputs(spark, sf)
    return RP.summary(g.nodes, te, ce)


@register("report_schema_breakdown", C.oracle(_RP_FX, _RP_CTES, """
SELECT CASE WHEN len(string_split(id, '.')) = 3 THEN split_part(id, '.', 2) ELSE '' END AS schema,
       count(*) AS tables, count(*) FILTER (WHERE lineage_status = 'orphan') AS orphans
FROM cls WHERE node_type = 'table' GROUP BY 1"""))
def q_report_breakdown(spark, sf):
    """Tables and orphans per schema."""
    return RP.schema_breakdown(scope_graph(spark, sf, *SCOPE).nodes)


@register("report_tables", C.oracle(_RP_FX, _RP_CTES, """
SELECT id AS full_name, name,
  CASE WHEN len(string_split(id, '.')) = 3 THEN split_part(id, '.', 1) ELSE '' END AS catalog,
  CASE WHEN len(string_split(id, '.')) = 3 THEN split_part(id, '.', 2) ELSE '' END AS schema,
  table_type AS type, coalesce(owner, '') AS owner, upstream_count AS upstream, downstream_count AS downstream,
  lineage_status AS status,
  CAST(CASE WHEN column_sig = '' THEN 0 ELSE len(string_split(column_sig, ',')) END AS INT) AS columns,
  coalesce(comment, '') AS comment, coalesce(created_at, '') AS created, '' AS updated_x
FROM cls WHERE node_type = 'table'""".replace(", '' AS updated_x", """,
  coalesce((SELECT CAST(m.last_altered AS VARCHAR) FROM meta m
            WHERE m.table_catalog || '.' || m.table_schema || '.' || m.table_name = cls.id), '') AS updated""")))
def q_report_tables(spark, sf):
    """The Tables sheet (13 columns)."""
    return RP.tables_report(scope_graph(spark, sf, *SCOPE).nodes)


@register("report_lineage", C.oracle(_RP_FX + _REG_FX, _RP_CTES + [("reg", _REG), ("regg", """
SELECT entity_type, entity_id, min(name) AS rname FROM reg GROUP BY ALL""")], """
SELECT te.source,
  CASE WHEN te.entity_type IS NULL OR te.entity_id IS NULL THEN '—'
       ELSE coalesce(
         CASE WHEN NOT regexp_full_match(te.entity_id, '[A-Za-z0-9_./@ +:-]{1,512}')
                THEN te.entity_type || ' ' || substr(te.entity_id, 1, 12)
              WHEN te.entity_type IN ('JOB', 'PIPELINE')
                THEN coalesce(CASE WHEN r.rname <> '' THEN r.rname END, te.entity_type || ' ' || substr(te.entity_id, 1, 12))
              WHEN te.entity_type = 'NOTEBOOK' AND strpos(te.entity_id, '/') > 0 THEN string_split(te.entity_id, '/')[-1]
              WHEN te.entity_type = 'NOTEBOOK' THEN coalesce(r.rname, 'Notebook ' || substr(te.entity_id, 1, 12))
              ELSE te.entity_type || ' ' || substr(te.entity_id, 1, 12) END,
         te.entity_type || ' ' || substr(te.entity_id, 1, 8)) END AS via,
  te.target
FROM te LEFT JOIN regg r ON r.entity_type = te.entity_type AND r.entity_id = te.entity_id"""))
def q_report_lineage(spark, sf):
    """P3 + C14 + B13: recorded pairs with the via label (resolved name)."""
    g, te, _ = _report_inputs(spark, sf)
    ents = te.select("entity_type", "entity_id").distinct().filter(F.col("entity_type").isNotNull())
    names = CA.resolve_names(ents, _registry(spark, sf))
    return RP.lineage_report(te, names)


@register("report_pipelines", C.oracle(_RP_FX + _REG_FX + _COST_FX, _RP_CTES + _BOX_CTES + _COSTS_CTES, """
SELECT n.entity_type AS type, n.shown AS name, n.entity_id, coalesce(n.last_run, '') AS last_run, coalesce(n.owner, '') AS owner, c.cost_usd
FROM named n LEFT JOIN costs c ON c.entity_type = n.entity_type AND c.entity_id = n.entity_id WHERE n.node_type = 'entity'"""))
def q_report_pipelines(spark, sf):
    """The Pipelines sheet with resolved names and 30-day cost."""
    nodes = materialize(scope_graph(spark, sf, *SCOPE).nodes, "graph-nodes")
    cost = CO.entity_cost(*_cost(spark, sf), C.COST_AS_OF, C.COST_DAYS)
    return RP.pipelines_report(CO.attach_cost(nodes, cost), _names(spark, sf, nodes))


@register("report_column_lineage", C.oracle(_RP_FX, _RP_CTES, "SELECT * FROM cedges"))
def q_report_columns(spark, sf):
    """P5: column lineage rows of the schema scope."""
    _, _, ce = _report_inputs(spark, sf)
    return RP.column_lineage_report(ce)


@register("report_export_lineage", C.oracle(_RP_FX, _RP_CTES, """
SELECT DISTINCT source, target FROM (
  SELECT source, target FROM edges WHERE NOT starts_with(source, 'entity:') AND NOT starts_with(target, 'entity:')
  UNION ALL
  SELECT i.source, o.target FROM edges i JOIN edges o ON i.target = o.source
  WHERE NOT starts_with(i.source, 'entity:') AND starts_with(i.target, 'entity:')
    AND NOT starts_with(o.target, 'entity:')) x WHERE source <> target"""))
def q_report_export(spark, sf):
    """Client export Lineage rows = collapsed edges of the scope graph."""
    return RP.export_lineage_rows(scope_graph(spark, sf, *SCOPE).edges)


@register("write_report", C.oracle(_RP_FX, _RP_CTES, """
SELECT 'summary' AS report, 5::BIGINT AS rows
UNION ALL SELECT 'tables', count(*) FROM cls WHERE node_type = 'table'
UNION ALL SELECT 'pipelines', count(*) FROM cls WHERE node_type = 'entity'
UNION ALL SELECT 'lineage', count(*) FROM te
UNION ALL SELECT 'column_lineage', count(*) FROM cedges"""))
def q_write_report(spark, sf):
    """Write every report relation of the main.bronze export to a
    folder (parquet) and read the written inventory back."""
    g, te, ce = _report_inputs(spark, sf)
    reports = {"summary": RP.summary(g.nodes, te, ce), "tables": RP.tables_report(g.nodes),
               "lineage": RP.lineage_report(te), "pipelines": RP.pipelines_report(g.nodes),
               "column_lineage": RP.column_lineage_report(ce)}
    import uuid
    out = f"{checkpoint_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    RP.write_report(reports, out)
    parts = [spark.read.parquet(f"{out}/{n}").agg(F.count("*").alias("rows")).select(F.lit(n).alias("report"), "rows")
             for n in reports]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


# ---------------------------------------------------------------- request log

def _log(spark, sf):
    return C.fx(spark, sf, "request_log")


_LAT = """SELECT * FROM (SELECT latency_ms FROM request_log ORDER BY ts DESC, latency_ms DESC LIMIT 1000) x"""


_LAT_CTES = [("s", _LAT), ("r", """
SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS k FROM s""")]
_LAT_SUMMARY = """
SELECT coalesce(round(max(latency_ms) FILTER (WHERE i = floor(k / 2)), 1), 0.0) AS p50_ms,
       coalesce(round(max(latency_ms) FILTER (WHERE i = floor(k * 0.95)), 1), 0.0) AS p95_ms,
       coalesce(round(max(latency_ms) FILTER (WHERE i = floor(k * 0.99)), 1), 0.0) AS p99_ms,
       count(*) AS sample_count FROM r"""


@register("latency_summary", C.oracle(("request_log",), _LAT_CTES, _LAT_SUMMARY))
def q_latency_summary(spark, sf):
    """P50/P95/P99 index picks over the latest 1,000 requests."""
    return RQ.latency_summary(_log(spark, sf))


@register("latency_by_user", C.oracle(("request_log",), [("r", """
SELECT user_key, latency_ms, row_number() OVER (PARTITION BY user_key ORDER BY latency_ms) AS i,
       count(*) OVER (PARTITION BY user_key) AS k FROM request_log""")], """
SELECT user_key, max(latency_ms) FILTER (WHERE i = (50 * k + 99) // 100) AS p50_ms,
       max(latency_ms) FILTER (WHERE i = (95 * k + 99) // 100) AS p95_ms,
       max(latency_ms) FILTER (WHERE i = (99 * k + 99) // 100) AS p99_ms, count(*) AS sample_count
FROM r GROUP BY user_key"""))
def q_latency_by_user(spark, sf):
    """E17 variant: per-user percentiles by a mergeable sketch of accuracy
    10,000, which is exact for users of fewer samples."""
    return RQ.latency_by_user(_log(spark, sf))


@register("request_rate", C.oracle(("request_log",), [], f"""
SELECT count(*) AS total, count(*) FILTER (WHERE ts > TIMESTAMP '{C.NOW_TS}' - INTERVAL 60 SECOND
                                            AND ts <= TIMESTAMP '{C.NOW_TS}') AS last_window FROM request_log"""))
def q_request_rate(spark, sf):
    """Total requests and requests in the last 60 s."""
    return RQ.request_rate(_log(spark, sf), C.NOW_TS, 60)


@register("latency_advisory", C.oracle(("request_log",), _LAT_CTES + [("t", _LAT_SUMMARY)], """
SELECT *, p99_ms > 2000 AS advise_upgrade, CASE WHEN p99_ms > 2000
  THEN 'P99 latency ' || CAST(CAST(round(p99_ms) AS BIGINT) AS VARCHAR) || 'ms (>2s)' END AS reason FROM t"""))
def q_latency_advisory(spark, sf):
    """Upgrade advisory from the latency summary (p99 > 2 s)."""
    return RQ.latency_advisory(RQ.latency_summary(_log(spark, sf)))


def _quota_sql(n: int, secs: int) -> str:
    return C.oracle(("request_log",), [("w", f"""
SELECT user_key, count(*) OVER (PARTITION BY user_key ORDER BY epoch_us(ts)
       RANGE BETWEEN {secs * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS c FROM request_log""")], f"""
SELECT user_key, max(c) AS max_in_window, count(*) FILTER (WHERE c > {n}) AS n_over
FROM w GROUP BY user_key HAVING max(c) > {n}""")


@register("over_quota_minute", _quota_sql(1, 60))
def q_over_quota_minute(spark, sf):
    """Users with more than 1 request in a sliding 60-s window."""
    return RQ.over_quota(_log(spark, sf), 1, 60)


@register("over_quota_day", _quota_sql(8, 86400))
def q_over_quota_day(spark, sf):
    """Users with more than 8 requests in a sliding 24-h window."""
    return RQ.over_quota(_log(spark, sf), 8, 86400)


# ---------------------------------------------------------------- demo workload

def _bronze(spark, sf):
    return C.fx(spark, sf, "bronze_orders")


_DAILY = """SELECT CAST(CAST(order_ts AS DATE) AS VARCHAR) AS order_date, count(*) AS orders,
       CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS revenue FROM bronze_orders GROUP BY 1"""
_GOLD = """SELECT customer_id, count(*) AS orders, CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS revenue
FROM bronze_orders GROUP BY customer_id"""


@register("orders_daily", C.oracle(("bronze_orders",), [], _DAILY))
def q_orders_daily(spark, sf):
    """Orders and revenue per day."""
    return MD.orders_daily(_bronze(spark, sf)).withColumn("order_date", F.col("order_date").cast("string"))


@register("gold_orders", C.oracle(("bronze_orders",), [], _GOLD))
def q_gold_orders(spark, sf):
    """Orders and revenue per customer."""
    return MD.gold_orders(_bronze(spark, sf))


@register("executive_summary", C.oracle(("bronze_orders",), [("d", _DAILY), ("g", _GOLD)], """
SELECT (SELECT CAST(sum(CAST(revenue AS DECIMAL(18, 2))) AS DOUBLE) FROM g) AS customer_revenue,
       (SELECT CAST(sum(CAST(revenue AS DECIMAL(18, 2))) AS DOUBLE) FROM d) AS daily_revenue,
       (SELECT count(*) FROM g) AS customers"""))
def q_executive_summary(spark, sf):
    """Executive summary from three scalar subqueries."""
    b = _bronze(spark, sf)
    return MD.executive_summary(MD.gold_orders(b), MD.orders_daily(b))


@register("orders_360", C.oracle(("bronze_orders",), [("d", _DAILY), ("g", _GOLD)], """
SELECT g.*, (SELECT CAST(sum(CAST(revenue AS DECIMAL(18, 2))) AS DOUBLE) FROM d) AS daily_revenue FROM g"""))
def q_orders_360(spark, sf):
    """Gold rows with the summary's daily revenue (scalar subquery)."""
    b = _bronze(spark, sf)
    gold = MD.gold_orders(b)
    s = MD.executive_summary(gold, MD.orders_daily(b))
    return MD.orders_360(gold, s)


@register("gen_bronze_orders", C.oracle((), [], """
SELECT o_orderkey AS order_id, 100 + o_orderkey % 7 AS customer_id,
       CAST(round((CAST(o_orderkey AS DECIMAL(20, 0)) * 7.7) % 800, 2) AS DOUBLE) AS amount,
       CAST(TIMESTAMP '2026-06-15 09:00:00' + to_minutes(CAST(o_orderkey AS INTEGER)) AS VARCHAR) AS order_ts
FROM orders"""))
def q_gen_bronze(spark, sf):
    """Bronze orders generated from every order key."""
    ids = C.fx(spark, sf, "bronze_orders").select(F.col("order_id").cast("bigint").alias("id"))
    return MD.gen_bronze_orders(ids).withColumn("order_ts", F.col("order_ts").cast("string"))


def _scratch(spark, tag):
    import uuid
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@register("ingest_orders_csv", C.oracle(("bronze_orders",), [], """
SELECT order_id, customer_id, amount, CAST(order_ts AS VARCHAR) AS order_ts, true AS from_csv FROM bronze_orders"""))
def q_ingest_csv(spark, sf):
    """Orders landed as CSV, read back with the declared schema, header
    and source-file column."""
    path = MD.write_landing(_bronze(spark, sf), _scratch(spark, "landing"))
    df = MD.read_landing(spark, path)
    return df.select("order_id", "customer_id", "amount", F.col("order_ts").cast("string").alias("order_ts"),
                     F.col("src_file").endswith(".csv").alias("from_csv"))


@register("parquet_roundtrip", C.oracle(("bronze_orders",), [], """
SELECT customer_id, count(*) AS orders FROM bronze_orders GROUP BY customer_id"""))
def q_parquet_roundtrip(spark, sf):
    """A10 + A11: parquet hop of the bronze orders, published as a view,
    aggregated from the published name."""
    back = MD.parquet_roundtrip(_bronze(spark, sf), _scratch(spark, "hop"))
    pub = MD.publish(back, "lw_silver_orders")
    return pub.groupBy("customer_id").agg(F.count("*").alias("orders"))


@register("published_table", C.oracle(("bronze_orders",), [], """
SELECT customer_id, count(*) AS orders FROM bronze_orders GROUP BY customer_id"""))
def q_published_table(spark, sf):
    """The bronze orders as a table of the catalog, aggregated from its name."""
    pub = MD.publish(_bronze(spark, sf), f"lw_silver_{uuid.uuid4().hex}", table=True, path=_scratch(spark, "published"))
    return pub.groupBy("customer_id").agg(F.count("*").alias("orders"))


# ---------------------------------------------------------------- readiness

_PROBED = ("table_lineage", "column_lineage", "tables", "columns", "usage", "list_prices",
           "table_share_usage", "share_recipient_privileges", "catalog_provider_share_usage")
_REQUIRED = ("table_lineage", "tables")


def _readiness_sql() -> str:
    probes = " UNION ALL ".join(
        f"""SELECT '{n}' AS "check", true AS ok, {str(n in _REQUIRED).lower()} AS required, 'reachable' AS detail,
        CAST(NULL AS VARCHAR) AS hint, (SELECT count(*) FROM {n}) > 0 AS non_empty""" for n in _PROBED)
    return C.oracle(_PROBED, [
        ("vis", """SELECT DISTINCT c FROM (SELECT source_table_catalog AS c FROM table_lineage UNION ALL
           SELECT target_table_catalog FROM table_lineage) x WHERE c IS NOT NULL
           AND c NOT IN ('system', 'samples', '__databricks_internal')"""),
        ("cat", """SELECT count(*) AS n, count(*) FILTER (WHERE h) AS have, string_agg(c, ', ' ORDER BY c) FILTER (WHERE NOT h) AS missing
           FROM (SELECT c, c IN (SELECT table_catalog FROM tables) AS h FROM vis) y"""),
        ("every", probes + """ UNION ALL SELECT 'missing_relation', false, false, 'not reachable', 'optional relation not provided', false
           UNION ALL SELECT 'catalog metadata', have > 0 OR n = 0, true, have || '/' || n || ' sampled catalog(s) expose metadata',
             'Visible but no table metadata: ' || missing, have > 0 FROM cat""")], """
SELECT *, (SELECT bool_and(ok) FROM every WHERE required) AS overall_ok FROM every""")


@register("source_readiness", _readiness_sql())
def q_readiness(spark, sf):
    """R1 + F4: reachability / emptiness probes of every input relation and
    the catalog-metadata check (catalogs seen in lineage vs metadata)."""
    sources = {n: ((lambda n=n: C.fx(spark, sf, n)), n in _REQUIRED, f"grant read access to {n}") for n in _PROBED}
    sources["missing_relation"] = ((lambda: spark.read.parquet(f"{sf}/no_such_relation.parquet")), False,
                                   "optional relation not provided")
    ev = C.fx(spark, sf, "table_lineage")
    visible = (ev.select(F.col("source_table_catalog").alias("catalog"))
               .unionByName(ev.select(F.col("target_table_catalog").alias("catalog"))).filter("catalog IS NOT NULL"))
    df, overall = RD.source_readiness(spark, sources, visible, C.fx(spark, sf, "tables"))
    # an error's text names paths and versions: the registered form says only that there was one
    return df.withColumn("detail", F.when(F.col("ok"), F.col("detail")).otherwise("not reachable")).withColumn("overall_ok", F.lit(overall))
