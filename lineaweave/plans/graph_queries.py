"""Registered queries: scope graphs, focus / highlight subgraphs, column
traces and cost attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import cost as CO
from ..operators import graph as G
from ..operators import traverse as TV
from . import common as C
from .common import register
from .lineage_queries import _FULL_CTES, _TRACE_CTES, full_graph

TL = ("table_lineage",)
EV = ("ev", C.EV_SQL)


# ---------------------------------------------------------------- scope graph

def _scope_pred_sql(catalog: str, schema: str | None) -> str:
    def bare(col):
        return f"(CASE WHEN starts_with({col}, 'dbfs:/Volumes/') THEN substr({col}, 6) ELSE {col} END)"
    if schema is None:
        tables = f"(target_table_catalog = '{catalog}' OR source_table_catalog = '{catalog}')"
        prefix = f"/Volumes/{catalog}/"
    else:
        tables = (f"((target_table_catalog = '{catalog}' AND target_table_schema = '{schema}') OR "
                  f"(source_table_catalog = '{catalog}' AND source_table_schema = '{schema}'))")
        prefix = f"/Volumes/{catalog}/{schema}/"
    return (f"(coalesce({tables}, false) OR coalesce(starts_with({bare('source_path')}, '{prefix}'), false) "
            f"OR coalesce(starts_with({bare('target_path')}, '{prefix}'), false))")


def _scope_ctes(catalog: str, schema: str | None) -> list:
    meta_where = (f"table_schema = '{schema}'" if schema is not None
                  else "table_schema NOT IN ('information_schema', 'default')")
    return [
        EV,
        ("meta", f"""SELECT * FROM tables WHERE table_catalog = '{catalog}' AND {meta_where}
           AND NOT regexp_matches(table_name, '{P.INTERNAL_TABLE_RE}')"""),
        ("sids", "SELECT DISTINCT table_catalog || '.' || table_schema || '.' || table_name AS id FROM meta"),
        ("rin", C.norm_rows_sql(f"(SELECT * FROM ev WHERE {_scope_pred_sql(catalog, schema)})")),
        ("flag", """SELECT r.*, coalesce(r.src IN (SELECT id FROM sids), false) AS sl,
                           coalesce(r.tgt IN (SELECT id FROM sids), false) AS tl FROM rin r"""),
        ("keep", "SELECT DISTINCT entity_type, entity_id FROM flag WHERE ekey IS NOT NULL AND (sl OR tl)"),
        ("er", "SELECT * FROM (" + C.norm_rows_sql(
            "(SELECT * FROM ev e WHERE EXISTS (SELECT 1 FROM keep k WHERE k.entity_type = e.entity_type "
            "AND k.entity_id = e.entity_id))") + ") x WHERE ekey IS NOT NULL"),
        ("dr", "SELECT * FROM flag WHERE ekey IS NULL AND (sl OR tl)"),
        ("pairs", "SELECT DISTINCT src, tgt FROM dr WHERE src IS NOT NULL AND tgt IS NOT NULL"),
        ("es", "SELECT DISTINCT ekey, src AS t FROM er WHERE src IS NOT NULL"),
        ("et", "SELECT DISTINCT ekey, tgt AS t FROM er WHERE tgt IS NOT NULL"),
        ("covered", """SELECT DISTINCT p.src, p.tgt FROM pairs p JOIN es ON es.t = p.src
                       JOIN et ON et.ekey = es.ekey AND et.t = p.tgt"""),
        ("edges", C.routed_edges_sql("er") + """
           UNION SELECT p.src, p.tgt FROM pairs p
           WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.src = p.src AND c.tgt = p.tgt)"""),
        ("ext", """SELECT id FROM (
             SELECT src AS id FROM dr WHERE src IS NOT NULL AND NOT sl
             UNION SELECT tgt FROM dr WHERE tgt IS NOT NULL AND NOT tl
             UNION SELECT t FROM es UNION SELECT t FROM et) x
           WHERE id NOT IN (SELECT id FROM sids)"""),
        ("typed", """SELECT id, min(t) AS t FROM (
             SELECT src AS id, src_type AS t FROM rin UNION ALL SELECT tgt, tgt_type FROM rin
             UNION ALL SELECT src, src_type FROM er UNION ALL SELECT tgt, tgt_type FROM er) x
           WHERE id IS NOT NULL GROUP BY id"""),
        ("colsig", """SELECT table_catalog || '.' || table_schema || '.' || table_name AS id,
             string_agg(column_name || ':' || data_type || ':' || CAST(is_nullable = 'YES' AS VARCHAR), ','
                        ORDER BY ordinal_position) AS sig_local,
             string_agg(column_name || ':' || full_data_type || ':' || CAST(is_nullable = 'YES' AS VARCHAR), ','
                        ORDER BY ordinal_position) AS sig_ext
           FROM columns GROUP BY ALL"""),
        ("nodes", f"""
           SELECT m.table_catalog || '.' || m.table_schema || '.' || m.table_name AS id, 'table' AS node_type,
                  m.table_name AS name, coalesce(m.table_type, 'TABLE') AS table_type, m.table_owner AS owner,
                  m.comment, CAST(m.created AS VARCHAR) AS created_at,
                  CAST(NULL AS VARCHAR) AS entity_type, CAST(NULL AS VARCHAR) AS entity_id,
                  CAST(NULL AS VARCHAR) AS last_run, coalesce(c.sig_local, '') AS column_sig
           FROM meta m LEFT JOIN colsig c
             ON c.id = m.table_catalog || '.' || m.table_schema || '.' || m.table_name
           UNION ALL
           SELECT x.id, 'table', {C.label_sql('x.id', "coalesce(y.t, 'EXTERNAL_LINEAGE')")},
                  coalesce(y.t, 'EXTERNAL_LINEAGE'), NULL,
                  CASE coalesce(y.t, 'EXTERNAL_LINEAGE')
                    WHEN 'VOLUME' THEN 'Volume in ' || (CASE WHEN len(string_split(x.id, '.')) >= 2
                        THEN split_part(x.id, '.', 1) || '.' || split_part(x.id, '.', 2) ELSE 'external' END)
                    WHEN 'PATH' THEN 'External storage: ' || regexp_replace(x.id, '^path:', '')
                    ELSE 'Cross-schema reference from ' || (CASE WHEN len(string_split(x.id, '.')) >= 2
                        THEN split_part(x.id, '.', 1) || '.' || split_part(x.id, '.', 2) ELSE 'external' END) END,
                  NULL, NULL, NULL, NULL,
                  CASE WHEN coalesce(y.t, 'EXTERNAL_LINEAGE') IN ('VOLUME', 'PATH') THEN ''
                       ELSE coalesce(c.sig_ext, '') END
           FROM ext x LEFT JOIN typed y ON y.id = x.id LEFT JOIN colsig c ON c.id = x.id
           UNION ALL
           SELECT ekey, 'entity', NULL, NULL, {C.owner_sql()}, NULL, NULL, entity_type, entity_id,
                  CAST(max(event_time) AS VARCHAR), ''
           FROM er GROUP BY ekey, entity_type, entity_id"""),
        ("cls", C.classify_sql("nodes", "edges")),
    ]


_SCOPE_OUT = ("id", "node_type", "name", "table_type", "owner", "comment", "created_at", "entity_type",
              "entity_id", "last_run", "column_sig", "upstream_count", "downstream_count", "lineage_status")


def scope_graph(spark, sf, catalog: str, schema: str | None) -> G.Graph:
    return G.build_scope_graph(C.lineage(spark, sf), C.fx(spark, sf, "tables"), catalog, schema,
                               columns_meta=C.fx(spark, sf, "columns"))


def _column_sig(col: str = "columns") -> F.Column:
    return F.array_join(F.transform(col, lambda c: F.concat_ws(":", c["name"], c["type"],
                                                                c["nullable"].cast("string"))), ",")


def _scope_nodes_out(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "node_type", "name", "table_type", "owner", "comment",
                        F.col("created_at").cast("string").alias("created_at"), "entity_type", "entity_id",
                        F.col("last_run").cast("string").alias("last_run"),
                        _column_sig().alias("column_sig"),
                        "upstream_count", "downstream_count", "lineage_status")


def _reg_scope(tag: str, catalog: str, schema: str | None):
    ctes = _scope_ctes(catalog, schema)
    fixtures = TL + ("tables", "columns")

    @register(f"scope_nodes_{tag}", C.oracle(fixtures, ctes, "SELECT " + ", ".join(_SCOPE_OUT) + " FROM cls"))
    def q_nodes(spark, sf):
        return _scope_nodes_out(scope_graph(spark, sf, catalog, schema).nodes)

    @register(f"scope_edges_{tag}", C.oracle(fixtures, ctes, "SELECT source, target FROM edges"))
    def q_edges(spark, sf):
        return scope_graph(spark, sf, catalog, schema).edges

    q_nodes.__doc__ = (f"D5 nodes of scope {catalog}.{schema or '*'}: in-scope tables with metadata and "
                       "columns, external stubs, entities with all their rows, degrees and status.")
    q_edges.__doc__ = f"D5 edges of scope {catalog}.{schema or '*'}: routed, entity-covered pairs dropped."


_reg_scope("bronze", "main", "bronze")
_reg_scope("raw", "main", "raw")
_reg_scope("analytics", "analytics", None)


# ---------------------------------------------------------------- focus / highlight

FOCUS_TABLE = "main.silver.t7"
FOCUS_DEPTH = 2


def _focus_sql(direction: str, depth: int) -> tuple[str, str]:
    a, b = ("source", "target") if direction == "up" else ("target", "source")
    return (f"f_{direction}(node, d)", f"""
      SELECT '{FOCUS_TABLE}', 0
      UNION SELECT e.{a}, f.d + CASE WHEN starts_with(e.{a}, 'entity:') THEN 0 ELSE 1 END
      FROM f_{direction} f JOIN edges e ON e.{b} = f.node
      WHERE (starts_with(f.node, 'entity:') OR f.d < {depth})
        AND f.d + CASE WHEN starts_with(e.{a}, 'entity:') THEN 0 ELSE 1 END <= {depth}""")


_FOCUS_CTES = _FULL_CTES + [
    _focus_sql("up", FOCUS_DEPTH), _focus_sql("down", FOCUS_DEPTH),
    ("reached", "SELECT node AS id FROM f_up UNION SELECT node FROM f_down"),
    ("fids", """SELECT id FROM reached
       UNION SELECT e.source FROM edges e JOIN reached r ON e.target = r.id WHERE starts_with(r.id, 'entity:')
       UNION SELECT e.target FROM edges e JOIN reached r ON e.source = r.id WHERE starts_with(r.id, 'entity:')"""),
]


@register("focus_nodes", C.oracle(TL, _FOCUS_CTES, "SELECT id FROM cls WHERE id IN (SELECT id FROM fids)",
                                  recursive=True))
def q_focus_nodes(spark, sf):
    """D6 + D7: nodes within 2 table hops of main.silver.t7 (entities
    transparent) plus every neighbour of each entity reached."""
    return TV.focus(full_graph(spark, sf), FOCUS_TABLE, FOCUS_DEPTH).nodes.select("id")


@register("focus_edges", C.oracle(TL, _FOCUS_CTES, """SELECT source, target FROM edges
    WHERE source IN (SELECT id FROM fids) AND target IN (SELECT id FROM fids)""", recursive=True))
def q_focus_edges(spark, sf):
    """D6 + D7: edges induced on the focus node set."""
    return TV.focus(full_graph(spark, sf), FOCUS_TABLE, FOCUS_DEPTH).edges


_HL_CTES = _FULL_CTES + [
    ("h_up(id)", f"SELECT '{FOCUS_TABLE}' UNION SELECT e.source FROM h_up h JOIN edges e ON e.target = h.id"),
    ("h_down(id)", f"SELECT '{FOCUS_TABLE}' UNION SELECT e.target FROM h_down h JOIN edges e ON e.source = h.id"),
    ("hl", "SELECT id FROM h_up UNION SELECT id FROM h_down"),
]


@register("highlight_table", C.oracle(TL, _HL_CTES, """SELECT source, target FROM edges
    WHERE source IN (SELECT id FROM hl) AND target IN (SELECT id FROM hl)""", recursive=True))
def q_highlight_table(spark, sf):
    """D8 (table): edges inside the full transitive up + down closure."""
    _, edges = TV.highlight(full_graph(spark, sf), FOCUS_TABLE)
    return edges


HL_ENTITY = "entity:PIPELINE:p7"


@register("highlight_entity", C.oracle(TL, _FULL_CTES + [("hl", f"""
    SELECT '{HL_ENTITY}' AS id UNION SELECT source FROM edges WHERE target = '{HL_ENTITY}'
    UNION SELECT target FROM edges WHERE source = '{HL_ENTITY}'""")], "SELECT id FROM hl"))
def q_highlight_entity(spark, sf):
    """D8 (entity): the entity and its direct sources and targets."""
    ids, _ = TV.highlight(full_graph(spark, sf), HL_ENTITY)
    return ids


# ---------------------------------------------------------------- column traces

_CE_ALL = f"""SELECT DISTINCT source_table_full_name AS source_table, source_column_name AS source_column,
       target_table_full_name AS target_table, target_column_name AS target_column,
       source_table_full_name || '.' || lower(source_column_name) AS skey,
       target_table_full_name || '.' || lower(target_column_name) AS tkey
FROM column_lineage WHERE event_time > {C.ts_bound()}
  AND source_table_full_name IS NOT NULL AND target_table_full_name IS NOT NULL
  AND source_table_full_name <> target_table_full_name
  AND source_column_name IS NOT NULL AND target_column_name IS NOT NULL"""


def _col_trace_sql(table: str, column: str, directions=("up", "down")) -> str:
    key = f"{table}.{column.lower()}"
    ctes = [("ce", _CE_ALL),
            ("cu(k)", f"SELECT '{key}' UNION SELECT ce.skey FROM cu JOIN ce ON ce.tkey = cu.k"),
            ("cd(k)", f"SELECT '{key}' UNION SELECT ce.tkey FROM cd JOIN ce ON ce.skey = cd.k")]
    parts = []
    if "up" in directions:
        parts.append("SELECT source_table, source_column, target_table, target_column FROM ce "
                     "WHERE tkey IN (SELECT k FROM cu)")
    if "down" in directions:
        parts.append("SELECT source_table, source_column, target_table, target_column FROM ce "
                     "WHERE skey IN (SELECT k FROM cd)")
    return C.oracle(("column_lineage",), ctes, " UNION ".join(parts), recursive=True)


def _all_col_edges(spark, sf) -> DataFrame:
    return G.column_edges(C.column_lineage(spark, sf))


@register("column_trace", _col_trace_sql(*C.COLUMN_SEED))
def q_column_trace(spark, sf):
    """Transitive column trace of (analytics.mart.t7, c2), both ways,
    case-insensitive column match."""
    return TV.trace_column(_all_col_edges(spark, sf), *C.COLUMN_SEED)


@register("column_impact", _col_trace_sql("main.bronze.t7", "C1", ("down",)))
def q_column_impact(spark, sf):
    """Downstream impact of changing main.bronze.t7.C1."""
    return TV.column_impact(_all_col_edges(spark, sf), "main.bronze.t7", "C1")


_SCH_CTES = _TRACE_CTES + [("gs", """SELECT DISTINCT split_part(id, '.', 1) AS catalog, split_part(id, '.', 2) AS schema
    FROM nodes WHERE node_type = 'table' AND len(string_split(id, '.')) = 3""")]


def _trace_nodes(spark, sf):
    return TV.trace_graph(C.lineage(spark, sf), C.SEED, C.MAX_HOPS).nodes


@register("schemas_in_graph", C.oracle(TL + ("columns",), _SCH_CTES, "SELECT catalog, schema FROM gs",
                                       recursive=True))
def q_schemas_in_graph(spark, sf):
    """Distinct catalog.schema pairs of the seed trace graph."""
    return TV.schemas_in_graph(_trace_nodes(spark, sf))


@register("column_edges_for_graph", C.oracle(TL + ("columns", "column_lineage"), _SCH_CTES, f"""
SELECT DISTINCT source_table_full_name AS source_table, source_column_name AS source_column,
       target_table_full_name AS target_table, target_column_name AS target_column
FROM column_lineage c WHERE event_time > {C.ts_bound()}
  AND source_table_full_name IS NOT NULL AND target_table_full_name IS NOT NULL
  AND source_table_full_name <> target_table_full_name
  AND source_column_name IS NOT NULL AND target_column_name IS NOT NULL
  AND (EXISTS (SELECT 1 FROM gs WHERE gs.catalog = c.target_table_catalog AND gs.schema = c.target_table_schema)
       OR EXISTS (SELECT 1 FROM gs WHERE gs.catalog = c.source_table_catalog AND gs.schema = c.source_table_schema))""",
                                             recursive=True))
def q_column_edges_for_graph(spark, sf):
    """Column edges of every schema in the seed trace graph, one semi-join."""
    return TV.column_edges_for_graph(C.column_lineage(spark, sf), _trace_nodes(spark, sf))


# ---------------------------------------------------------------- cost

def _usage_window_sql() -> str:
    from ..functions.predicates import window_start
    return f"DATE '{window_start(C.COST_AS_OF, C.COST_DAYS).isoformat()}'"


_PRICED = f"""SELECT u.usage_metadata.job_id AS job_id, u.usage_metadata.dlt_pipeline_id AS pipeline_id,
       u.sku_name, u.usage_start_time, u.usage_quantity, lp.pricing.effective_list."default" AS price,
       u.usage_quantity * lp.pricing.effective_list."default" AS amount
FROM (SELECT * FROM usage WHERE usage_date > {_usage_window_sql()}) u
  ASOF JOIN list_prices lp ON lp.sku_name = u.sku_name AND lp.usage_unit = u.usage_unit AND lp.price_start_time <= u.usage_start_time
WHERE coalesce(lp.price_end_time > u.usage_start_time, true)"""

_COST_FX = ("usage", "list_prices")


def _cost(spark, sf):
    return C.fx(spark, sf, "usage"), C.fx(spark, sf, "list_prices")


@register("price_usage", C.oracle(_COST_FX, [("priced", _PRICED)], """
SELECT sku_name, CAST(price AS DOUBLE) AS price, count(*) AS n_rows,
       CAST(round(sum(amount), 2) AS DOUBLE) AS amount
FROM priced GROUP BY sku_name, price"""))
def q_price_usage(spark, sf):
    """Usage priced by the list price valid at its start time (equi +
    range join), summarised per (sku, price)."""
    from ..sources import scans as S
    u, p = _cost(spark, sf)
    priced = CO.price_usage(S.scan_usage(u, C.COST_AS_OF, C.COST_DAYS), S.scan_prices(p))
    return (priced.groupBy("sku_name", F.col("price").cast("double").alias("price"))
            .agg(F.count("*").alias("n_rows"), F.round(F.sum("amount"), 2).cast("double").alias("amount")))


@register("job_cost", C.oracle(_COST_FX, [("priced", _PRICED)], """
SELECT job_id AS id, CAST(round(sum(amount), 2) AS DOUBLE) AS cost_usd FROM priced
WHERE job_id IS NOT NULL AND sku_name LIKE '%JOBS_SERVERLESS%' GROUP BY job_id"""))
def q_job_cost(spark, sf):
    """Serverless job cost per job id."""
    u, p = _cost(spark, sf)
    return CO.job_cost(u, p, C.COST_AS_OF, C.COST_DAYS)


@register("pipeline_cost", C.oracle(_COST_FX, [("priced", _PRICED)], """
SELECT pipeline_id AS id, CAST(round(sum(amount), 2) AS DOUBLE) AS cost_usd FROM priced
WHERE pipeline_id IS NOT NULL GROUP BY pipeline_id"""))
def q_pipeline_cost(spark, sf):
    """Pipeline cost per pipeline id, any SKU."""
    u, p = _cost(spark, sf)
    return CO.pipeline_cost(u, p, C.COST_AS_OF, C.COST_DAYS)


_COSTS_CTES = [
    ("priced", _PRICED),
    ("costs", """SELECT 'JOB' AS entity_type, job_id AS entity_id, CAST(round(sum(amount), 2) AS DOUBLE) AS cost_usd
        FROM priced WHERE job_id IS NOT NULL AND sku_name LIKE '%JOBS_SERVERLESS%' GROUP BY job_id
        UNION ALL SELECT 'PIPELINE', pipeline_id, CAST(round(sum(amount), 2) AS DOUBLE)
        FROM priced WHERE pipeline_id IS NOT NULL GROUP BY pipeline_id""")]

_ATTACH_CTES = _FULL_CTES + _COSTS_CTES + [
    ("ent", """SELECT n.id, n.entity_type, n.entity_id,
        CASE WHEN n.entity_type IN ('JOB', 'PIPELINE') THEN c.cost_usd END AS cost_usd
        FROM cls n LEFT JOIN costs c ON c.entity_type = n.entity_type AND c.entity_id = n.entity_id
        WHERE n.node_type = 'entity'""")]


def _attached(spark, sf) -> DataFrame:
    u, p = _cost(spark, sf)
    nodes = full_graph(spark, sf).nodes.filter(F.col("node_type") == "entity")
    return CO.attach_cost(nodes, CO.entity_cost(u, p, C.COST_AS_OF, C.COST_DAYS))


@register("attach_cost", C.oracle(TL + _COST_FX, _ATTACH_CTES, "SELECT id, entity_type, entity_id, cost_usd FROM ent"))
def q_attach_cost(spark, sf):
    """JOB / PIPELINE entity nodes of the whole-log graph with their
    cost, other entity types NULL."""
    return _attached(spark, sf).select("id", "entity_type", "entity_id", "cost_usd")


@register("discounted_cost", C.oracle(TL + _COST_FX, _ATTACH_CTES, """
SELECT id, cost_usd, round(cost_usd * (1 - 15.0 / 100), 2) AS discounted FROM ent WHERE cost_usd IS NOT NULL"""))
def q_discounted(spark, sf):
    """15 % discount applied to priced entity nodes (clamped 0-99)."""
    a = _attached(spark, sf).filter(F.col("cost_usd").isNotNull())
    return a.select("id", "cost_usd", P.discounted("cost_usd", 15).alias("discounted"))
