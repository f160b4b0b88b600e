"""Registered queries: metadata inventory, stats, search/preview, entity
registries and names, id validation, freshness, sharing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import catalog as CA
from ..operators import sharing as SH
from ..sources import scans as S
from . import common as C
from .common import register
from .lineage_queries import _FULL_CTES, full_graph

_SKIP_CATS = ", ".join(f"'{c}'" for c in S.SKIP_CATALOGS)

TL = ("table_lineage",)

_INV = f"""SELECT table_name AS name, table_catalog || '.' || table_schema || '.' || table_name AS fqdn,
       table_catalog AS catalog, table_schema AS schema, coalesce(table_type, 'TABLE') AS table_type
FROM tables WHERE table_catalog NOT IN ({_SKIP_CATS})
  AND table_schema NOT IN ('information_schema', 'default')
  AND NOT regexp_matches(table_name, '{P.INTERNAL_TABLE_RE}')"""


def _inv(spark, sf):
    return S.list_tables(C.fx(spark, sf, "tables"))


@register("list_tables", C.oracle(("tables",), [], _INV))
def q_list_tables(spark, sf):
    """A3: table inventory across catalogs."""
    return _inv(spark, sf)


@register("list_columns", C.oracle(("tables", "columns"), [], """
SELECT table_catalog || '.' || table_schema || '.' || table_name AS "table", column_name AS name,
       data_type AS type, is_nullable = 'YES' AS nullable, ordinal_position AS ordinal
FROM columns WHERE table_catalog = 'main' AND table_schema = 'silver' AND table_name = 't7'"""))
def q_list_columns(spark, sf):
    """A4: columns of main.silver.t7 in ordinal order."""
    return S.list_columns(C.fx(spark, sf, "columns"), "main.silver.t7")


@register("list_catalogs", C.oracle(("tables",), [], f"""
SELECT DISTINCT table_catalog AS catalog FROM tables WHERE table_catalog NOT IN ({_SKIP_CATS})"""))
def q_list_catalogs(spark, sf):
    """A5: catalogs."""
    return S.list_catalogs(C.fx(spark, sf, "tables"))


@register("list_schemas", C.oracle(("tables",), [], f"""
SELECT DISTINCT table_catalog AS catalog, table_schema AS schema FROM tables
WHERE table_schema NOT IN ('information_schema', 'default') AND table_catalog NOT IN ({_SKIP_CATS})"""))
def q_list_schemas(spark, sf):
    """A5: schemas per catalog."""
    return S.list_schemas(C.fx(spark, sf, "tables"))


_REG = """SELECT 'JOB' AS entity_type, job_id AS entity_id, name, coalesce(run_as_user_name, creator_user_name) AS owner
  FROM jobs
  UNION ALL SELECT 'PIPELINE', pipeline_id, name, NULL FROM pipelines
  UNION ALL SELECT 'NOTEBOOK', entity_id, string_split(min(path), '/')[-1], NULL FROM (
    SELECT request_params['notebookId'] AS entity_id, request_params['path'] AS path FROM audit) a
    WHERE entity_id IS NOT NULL AND path IS NOT NULL GROUP BY entity_id"""
_REG_FX = ("jobs", "pipelines", "audit")


def _registry(spark, sf):
    return S.scan_entities(C.fx(spark, sf, "jobs"), C.fx(spark, sf, "pipelines"), C.fx(spark, sf, "audit"))


@register("scan_entities", C.oracle(_REG_FX, [], _REG))
def q_scan_entities(spark, sf):
    """One entity registry from jobs, pipelines and audit map paths."""
    return _registry(spark, sf)


@register("invalid_ids", C.oracle(_REG_FX, [("reg", _REG)], """
SELECT entity_type, entity_id FROM reg WHERE NOT coalesce(CASE upper(entity_type)
  WHEN 'JOB' THEN regexp_full_match(trim(entity_id), '[0-9]{1,32}')
  WHEN 'PIPELINE' THEN regexp_full_match(trim(entity_id), '[a-fA-F0-9-]{8,64}')
  WHEN 'NOTEBOOK' THEN regexp_full_match(trim(entity_id), '[A-Za-z0-9_./@ +-]{1,512}')
  ELSE regexp_full_match(trim(entity_id), '[A-Za-z0-9_./@ +-]{1,256}') END, false)"""))
def q_invalid_ids(spark, sf):
    """Registry rows whose id fails its type's validation pattern."""
    return CA.invalid_ids(_registry(spark, sf)).select("entity_type", "entity_id")


@register("resolve_names", C.oracle(TL + _REG_FX, _FULL_CTES + [("reg", _REG), ("regg", """
SELECT DISTINCT ON (entity_type, entity_id) entity_type, entity_id, name AS rname, nullif(owner, '') AS rowner FROM reg
ORDER BY entity_type, entity_id, name NULLS LAST, owner NULLS FIRST""")], """
SELECT n.id, n.entity_type, n.entity_id,
  CASE WHEN NOT regexp_full_match(n.entity_id, '[A-Za-z0-9_./@ +:-]{1,512}')
         THEN n.entity_type || ' ' || substr(n.entity_id, 1, 12)
       WHEN n.entity_type IN ('JOB', 'PIPELINE')
         THEN coalesce(CASE WHEN r.rname <> '' THEN r.rname END, n.entity_type || ' ' || substr(n.entity_id, 1, 12))
       WHEN n.entity_type = 'NOTEBOOK' AND strpos(n.entity_id, '/') > 0 THEN string_split(n.entity_id, '/')[-1]
       WHEN n.entity_type = 'NOTEBOOK' THEN coalesce(r.rname, 'Notebook ' || substr(n.entity_id, 1, 12))
       ELSE n.entity_type || ' ' || substr(n.entity_id, 1, 12) END AS display_name,
  CASE WHEN regexp_full_match(n.entity_id, '[A-Za-z0-9_./@ +:-]{1,512}') AND n.entity_type = 'JOB'
       THEN r.rowner END AS registry_owner
FROM cls n LEFT JOIN regg r ON r.entity_type = n.entity_type AND r.entity_id = n.entity_id
WHERE n.node_type = 'entity'"""))
def q_resolve_names(spark, sf):
    """C14 + B13: display names and owners of every entity node in one join."""
    ents = full_graph(spark, sf).nodes.filter(F.col("node_type") == "entity")
    return CA.resolve_names(ents, _registry(spark, sf)).select(
        "id", "entity_type", "entity_id", "display_name", "registry_owner")


@register("freshness", C.oracle(TL, _FULL_CTES, f"""
SELECT id, CAST(last_run AS TIMESTAMP)::DATE = DATE '{C.NOW_TS[:10]}' AS fresh,
  CASE WHEN mins < 1 THEN 'just now' WHEN mins < 60 THEN CAST(mins AS VARCHAR) || 'm ago'
       WHEN mins < 1440 THEN CAST(floor(mins / 60) AS BIGINT)::VARCHAR || 'h ago'
       ELSE CAST(floor(mins / 1440) AS BIGINT)::VARCHAR || 'd ago' END AS age
FROM (SELECT id, last_run, CAST(floor((epoch_us(TIMESTAMP '{C.NOW_TS}') - epoch_us(CAST(last_run AS TIMESTAMP)))
        / 60000000) AS BIGINT) AS mins FROM cls WHERE node_type = 'entity') x"""))
def q_freshness(spark, sf):
    """Freshness flag and relative age of entity last runs."""
    ents = full_graph(spark, sf).nodes.filter(F.col("node_type") == "entity")
    fresh, age = P.freshness("last_run", C.NOW_TS)
    return ents.select("id", fresh.alias("fresh"), age.alias("age"))


@register("catalog_stats", C.oracle(("tables",), [("inv", _INV)], """
SELECT catalog, count(DISTINCT schema) AS n_schemas, count(*) AS n_tables FROM inv GROUP BY catalog"""))
def q_catalog_stats(spark, sf):
    """Schemas and tables per catalog."""
    return CA.catalog_stats(_inv(spark, sf))


@register("schema_stats", C.oracle(("tables",), [("inv", _INV), ("s", """
SELECT catalog, schema, count(*) AS n_tables, lower(schema) AS l FROM inv GROUP BY catalog, schema""")], """
SELECT catalog, schema, n_tables,
  CASE WHEN l = 'bronze' OR starts_with(l, 'bronze_') OR ends_with(l, '_bronze') THEN 'bronze'
       WHEN l = 'silver' OR starts_with(l, 'silver_') OR ends_with(l, '_silver') THEN 'silver'
       WHEN l = 'gold' OR starts_with(l, 'gold_') OR ends_with(l, '_gold') THEN 'gold' END AS tier,
  CASE WHEN l = 'bronze' OR starts_with(l, 'bronze_') OR ends_with(l, '_bronze') THEN 1
       WHEN l = 'silver' OR starts_with(l, 'silver_') OR ends_with(l, '_silver') THEN 2
       WHEN l = 'gold' OR starts_with(l, 'gold_') OR ends_with(l, '_gold') THEN 3 ELSE 4 END AS tier_rank
FROM s"""))
def q_schema_stats(spark, sf):
    """E10 + B9: tables per schema with medallion tier and display rank."""
    return CA.schema_stats(_inv(spark, sf))


@register("inventory_totals", C.oracle(("tables",), [("inv", _INV)], """
SELECT count(DISTINCT catalog) AS n_catalogs, count(*) AS n_tables FROM inv"""))
def q_totals(spark, sf):
    """Catalog and table totals."""
    return CA.totals(_inv(spark, sf))


def _search_sql(q: str, k: int) -> str:
    return C.oracle(("tables",), [("inv", _INV), ("sc", f"""
SELECT name, fqdn, catalog, schema, table_type,
  CASE WHEN lower(name) = '{q}' THEN 1000.0
       WHEN starts_with(lower(name), '{q}') THEN 500.0 + (1.0 - length(name) / 100.0)
       WHEN strpos(lower(name), '{q}') > 0 THEN 200.0 + (1.0 - length(name) / 100.0)
       WHEN strpos(lower(fqdn), '{q}') > 0 THEN 100.0 END AS score FROM inv""")],
                    f"SELECT * FROM sc WHERE score > 0 ORDER BY score DESC, fqdn ASC LIMIT {k}")


@register("search_tables", _search_sql("t1", 12))
def q_search(spark, sf):
    """Top-12 ranked search for 't1'."""
    return CA.search_tables(_inv(spark, sf), "T1", 12)


@register("search_tables_fqdn", _search_sql("bronze.orphan2", 12))
def q_search_fqdn(spark, sf):
    """Fqdn-only matches score 100."""
    return CA.search_tables(_inv(spark, sf), "bronze.orphan2", 12)


@register("search_graph", C.oracle(TL, _FULL_CTES, """
SELECT id, name FROM cls WHERE node_type <> 'entity' AND strpos(lower(name), 'landing') > 0"""))
def q_search_graph(spark, sf):
    """In-graph search of table nodes by name."""
    return CA.search_graph(full_graph(spark, sf).nodes, "Landing").select("id", "name")


@register("preview_tables", C.oracle(("tables",), [("inv", _INV)], """
SELECT * FROM inv WHERE strpos(lower(name), 't1') > 0 OR strpos(lower(fqdn), 't1') > 0
  OR strpos(lower(catalog), 't1') > 0 OR strpos(lower(schema), 't1') > 0 OR strpos(lower(table_type), 't1') > 0
ORDER BY name DESC NULLS LAST, fqdn, catalog, schema, table_type LIMIT 500"""))
def q_preview(spark, sf):
    """T3 + B14: any-column filter ' T1 ', sort by name descending, first 500."""
    return CA.preview(_inv(spark, sf), " T1 ", "name", ascending=False, n=500)


# ---------------------------------------------------------------- sharing (F1-F8)

_SO = """SELECT t.catalog_name || '.' || t.schema_name || '.' || t.table_name AS full_name, t.share_name,
       coalesce(r.recipients, '') AS recipients,
       CASE WHEN t.shared_as_table IS NOT NULL AND t.shared_as_table <> ''
            THEN (CASE WHEN t.shared_as_schema IS NOT NULL AND t.shared_as_schema <> '' THEN t.shared_as_schema
                       ELSE t.schema_name END) || '.' || t.shared_as_table END AS shared_as,
       coalesce(lower(CAST(t.cdf_enabled AS VARCHAR)) = 'true', false) AS cdf_enabled
FROM table_share_usage t LEFT JOIN (
  SELECT share_name, array_to_string(list_sort(list(recipient_name)), ',') AS recipients
  FROM share_recipient_privileges WHERE privilege_type = 'SELECT' GROUP BY share_name) r
ON r.share_name = t.share_name"""
_FC = """SELECT c.catalog_name, coalesce(min(c.provider_name), 'unknown') AS provider_name,
       arg_min(p.cloud, c.provider_name) AS cloud, arg_min(p.region, c.provider_name) AS region,
       array_to_string(list_sort(list(DISTINCT c.share_name)), ',') AS share_names
FROM catalog_provider_share_usage c LEFT JOIN providers p ON c.provider_name = p.provider_name
GROUP BY c.catalog_name"""
_SH_FX = ("table_share_usage", "share_recipient_privileges")
_FC_FX = ("catalog_provider_share_usage", "providers")


def _sh(spark, sf, name):
    return C.fx(spark, sf, name)


@register("shared_out", C.oracle(_SH_FX, [], _SO))
def q_shared_out(spark, sf):
    """F1 + B15 + C13: outbound shared tables with recipients, alias, CDF."""
    return SH.shared_out(_sh(spark, sf, "table_share_usage"), _sh(spark, sf, "share_recipient_privileges"))


@register("foreign_catalogs", C.oracle(_FC_FX, [], _FC))
def q_foreign_catalogs(spark, sf):
    """F2 + C12: inbound foreign catalogs with provider cloud/region."""
    return SH.foreign_catalogs(_sh(spark, sf, "catalog_provider_share_usage"), _sh(spark, sf, "providers"))


@register("overlay_audience", C.oracle(_SH_FX + _FC_FX, [("so", _SO), ("fc", _FC)], """
SELECT a.requested, a.audience,
  CASE WHEN a.audience IN ('provider', 'both') THEN (SELECT count(*) FROM so) ELSE 0 END AS n_shared_out,
  CASE WHEN a.audience IN ('recipient', 'both') THEN (SELECT count(*) FROM fc) ELSE 0 END AS n_foreign
FROM (SELECT 'provider' AS requested, 'provider' AS audience UNION ALL SELECT 'recipient', 'recipient'
      UNION ALL SELECT 'both', 'both' UNION ALL SELECT 'everyone', 'both') a"""))
def q_overlay_audience(spark, sf):
    """audience switch (provider / recipient / both; invalid -> both)."""
    parts = []
    for req in ("provider", "recipient", "both", "everyone"):
        aud, so, fc = SH.sharing_overlay(req, _sh(spark, sf, "table_share_usage"),
                                         _sh(spark, sf, "share_recipient_privileges"),
                                         _sh(spark, sf, "catalog_provider_share_usage"), _sh(spark, sf, "providers"))
        n_so = so.agg(F.count("*").alias("n")) if so is not None else None
        n_fc = fc.agg(F.count("*").alias("n")) if fc is not None else None
        a = (n_so.select(F.col("n").alias("n_shared_out")) if n_so is not None
             else spark.range(1).select(F.lit(0).cast("bigint").alias("n_shared_out")))
        b = (n_fc.select(F.col("n").alias("n_foreign")) if n_fc is not None
             else spark.range(1).select(F.lit(0).cast("bigint").alias("n_foreign")))
        row = spark.sql("SELECT (SELECT n_shared_out FROM {a}) AS n_shared_out, "
                        "(SELECT n_foreign FROM {b}) AS n_foreign", a=a, b=b)
        parts.append(row.select(F.lit(req).alias("requested"), F.lit(aud).alias("audience"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("share_recipients", C.oracle(("share_recipient_privileges",), [], """
SELECT share_name, recipient_name FROM share_recipient_privileges WHERE privilege_type = 'SELECT'"""))
def q_share_recipients(spark, sf):
    """A share's recipients as pairs, however many it has."""
    return SH.share_recipients(_sh(spark, sf, "share_recipient_privileges"))


@register("sharing_available", C.oracle(("table_share_usage",), [("p", "SELECT count(*) >= 0 AS readable FROM table_share_usage")], """
SELECT a.audience, a.audience <> 'recipient' AND p.readable AS available
FROM (VALUES ('provider'), ('recipient'), ('both')) AS a(audience), p"""))
def q_sharing_available(spark, sf):
    """overlay availability per audience — a relation the audience needs
    is readable (here the recipient side's relation is missing)."""
    loaders = {"table_share_usage": lambda: _sh(spark, sf, "table_share_usage"),
               "catalog_provider_share_usage": lambda: spark.read.parquet(f"{sf}/no_such_relation.parquet")}
    rows = [(a, SH.sharing_available(a, loaders)) for a in ("provider", "recipient", "both")]
    return spark.createDataFrame(rows, "audience string, available boolean")


@register("overlay_edges", C.oracle(TL + _SH_FX + _FC_FX, _FULL_CTES + [("so", _SO), ("fc", _FC)], """
SELECT DISTINCT so.full_name AS source, 'sharing:share:' || so.share_name AS target FROM so
  WHERE so.full_name IN (SELECT id FROM cls WHERE node_type = 'table')
UNION SELECT DISTINCT 'sharing:share:' || p.share_name, 'sharing:recipient:' || p.recipient_name
  FROM share_recipient_privileges p WHERE p.privilege_type = 'SELECT'
   AND p.share_name IN (SELECT share_name FROM so WHERE full_name IN (SELECT id FROM cls WHERE node_type = 'table'))
UNION SELECT DISTINCT 'sharing:provider:' || fc.provider_name, n.id FROM cls n
  JOIN fc ON fc.catalog_name = split_part(n.id, '.', 1) WHERE n.node_type = 'table'"""))
def q_overlay_edges(spark, sf):
    """F5 + F6 + C16: sharing overlay edges on the whole-log graph."""
    nodes = full_graph(spark, sf).nodes
    priv = _sh(spark, sf, "share_recipient_privileges")
    so = SH.shared_out(_sh(spark, sf, "table_share_usage"), priv)
    fc = SH.foreign_catalogs(_sh(spark, sf, "catalog_provider_share_usage"), _sh(spark, sf, "providers"))
    return SH.overlay_out(nodes, so, priv).unionByName(SH.overlay_in(nodes, fc)).distinct()


_OVERLAY_CTES = _FULL_CTES + [("so", _SO), ("fc", _FC),
    ("hit", "SELECT so.* FROM so WHERE so.full_name IN (SELECT id FROM cls WHERE node_type = 'table')"),
    ("grants", "SELECT DISTINCT share_name, recipient_name FROM share_recipient_privileges WHERE privilege_type = 'SELECT'"),
    ("foreign_in", """SELECT n.id, fc.* FROM cls n JOIN fc ON fc.catalog_name = split_part(n.id, '.', 1)
       WHERE n.node_type = 'table'""")]


def _overlay(spark, sf, make):
    priv = _sh(spark, sf, "share_recipient_privileges")
    so = SH.shared_out(_sh(spark, sf, "table_share_usage"), priv)
    fc = SH.foreign_catalogs(_sh(spark, sf, "catalog_provider_share_usage"), _sh(spark, sf, "providers"))
    return make(full_graph(spark, sf).nodes, so, fc, priv)


@register("overlay_nodes", C.oracle(TL + _SH_FX + _FC_FX, _OVERLAY_CTES, """
SELECT 'sharing:' || sharing_kind || ':' || label AS id, 'sharing' AS node_type, sharing_kind, label, sub FROM (
  SELECT 'share' AS sharing_kind, share_name AS label, min('as ' || nullif(shared_as, '')) AS sub FROM hit GROUP BY share_name
  UNION ALL SELECT DISTINCT 'recipient', recipient_name, CAST(NULL AS VARCHAR) FROM grants
    WHERE share_name IN (SELECT share_name FROM hit)
  UNION ALL SELECT 'provider', provider_name, min(CASE WHEN coalesce(region, '') <> ''
    THEN trim(coalesce(cloud, '') || ' ' || region) END) FROM foreign_in GROUP BY provider_name) x"""))
def q_overlay_nodes(spark, sf):
    """F5 + F6 + S1: share, recipient and provider nodes on the whole-log graph."""
    return _overlay(spark, sf, SH.overlay_nodes)


@register("overlay_badges", C.oracle(TL + _SH_FX + _FC_FX, _OVERLAY_CTES + [("outb", """
SELECT h.full_name AS id, count(DISTINCT h.share_name) AS n_shares, count(DISTINCT g.recipient_name) AS n_recipients
FROM hit h LEFT JOIN grants g ON g.share_name = h.share_name GROUP BY h.full_name""")], """
SELECT coalesce(o.id, i.id) AS id, n_shares, n_recipients,
       CASE WHEN n_recipients > 0 THEN n_recipients ELSE n_shares END AS shown,
       i.provider_name AS in_provider, i.share_names AS in_shares
FROM outb o FULL JOIN foreign_in i ON i.id = o.id"""))
def q_overlay_badges(spark, sf):
    """F5 + F6: sharing badges of the whole-log graph's tables."""
    return _overlay(spark, sf, SH.overlay_badges)


@register("overview_shares", C.oracle(("shares",) + _SH_FX, [], """
SELECT s.share_name, s.share_owner AS owner, s.comment, coalesce(t.n, 0) AS num_tables,
       coalesce(r.recipients, '') AS recipients
FROM shares s
LEFT JOIN (SELECT share_name, count(*) AS n FROM table_share_usage GROUP BY share_name) t ON t.share_name = s.share_name
LEFT JOIN (SELECT share_name, array_to_string(list_sort(list(recipient_name)), ',') AS recipients
           FROM share_recipient_privileges WHERE privilege_type = 'SELECT' GROUP BY share_name) r
  ON r.share_name = s.share_name"""))
def q_overview_shares(spark, sf):
    """shares with table counts and recipients."""
    return SH.overview_shares(_sh(spark, sf, "shares"), _sh(spark, sf, "table_share_usage"),
                              _sh(spark, sf, "share_recipient_privileges"))


@register("overview_recipients", C.oracle(("recipients",), [], """
SELECT recipient_name, authentication_type, recipient_owner AS owner, comment FROM recipients"""))
def q_overview_recipients(spark, sf):
    """recipients list."""
    return _sh(spark, sf, "recipients").select("recipient_name", "authentication_type",
                                               F.col("recipient_owner").alias("owner"), "comment")


@register("overview_providers", C.oracle(("providers",), [], "SELECT provider_name, cloud, region, comment FROM providers"))
def q_overview_providers(spark, sf):
    """providers list."""
    return _sh(spark, sf, "providers").select("provider_name", "cloud", "region", "comment")


@register("overview_foreign", C.oracle(("catalog_provider_share_usage",), [], """
SELECT catalog_name, min(provider_name) AS provider_name,
       array_to_string(list_sort(list(share_name)), ',') AS share_names
FROM catalog_provider_share_usage GROUP BY catalog_name"""))
def q_overview_foreign(spark, sf):
    """foreign catalogs grouped (share names kept with duplicates)."""
    return SH.overview_foreign(_sh(spark, sf, "catalog_provider_share_usage"))


@register("overview_shared_tables", C.oracle(("table_share_usage",), [], """
SELECT catalog_name || '.' || schema_name || '.' || table_name AS full_name, share_name FROM table_share_usage"""))
def q_overview_shared_tables(spark, sf):
    """tables published into shares."""
    return _sh(spark, sf, "table_share_usage").select(
        F.concat_ws(".", "catalog_name", "schema_name", "table_name").alias("full_name"), "share_name")


@register("overview_totals", C.oracle(("shares", "recipients", "providers", "catalog_provider_share_usage",
                                       "table_share_usage"), [], """
SELECT 'shares' AS metric, count(*) AS value FROM shares
UNION ALL SELECT 'recipients', count(*) FROM recipients
UNION ALL SELECT 'providers', count(*) FROM providers
UNION ALL SELECT 'foreign_catalogs', count(DISTINCT catalog_name) FROM catalog_provider_share_usage
UNION ALL SELECT 'shared_tables', count(*) FROM table_share_usage"""))
def q_overview_totals(spark, sf):
    """F8: overview totals as (metric, value)."""
    return SH.overview_totals(*[_sh(spark, sf, n) for n in ("shares", "recipients", "providers",
                                                             "catalog_provider_share_usage", "table_share_usage")])
