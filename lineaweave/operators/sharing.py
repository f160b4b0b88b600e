"""Sharing inventories and the sharing overlay.

Recipient lists per share are kept as (share, recipient) pair relations;
a sorted comma string is produced only at the output of a report row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P


def share_recipients(privileges: DataFrame) -> DataFrame:
    """(share_name, recipient_name) pairs granted SELECT."""
    return privileges.filter(F.col("privilege_type") == "SELECT").select("share_name", "recipient_name")


def _sorted_list(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Per key, the values as a sorted comma string (duplicates kept)."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias(out))


def shared_out(table_share_usage: DataFrame, privileges: DataFrame) -> DataFrame:
    """outbound shared tables: full name, share, sorted recipients,
    alias (B15) and CDF flag."""
    rec = _sorted_list(share_recipients(privileges), "share_name", "recipient_name", "recipients")
    t = table_share_usage
    return (t.join(rec, "share_name", "left")
            .select(F.concat_ws(".", "catalog_name", "schema_name", "table_name").alias("full_name"),
                    "share_name", F.coalesce("recipients", F.lit("")).alias("recipients"),
                    P.shared_as("schema_name", "shared_as_schema", "shared_as_table").alias("shared_as"),
                    P.cdf_flag("cdf_enabled").alias("cdf_enabled")))


def foreign_catalogs(usage: DataFrame, providers: DataFrame) -> DataFrame:
    """Inbound foreign catalogs: provider (smallest name, or
    'unknown'), its cloud and region (left join), distinct share names
    sorted."""
    j = usage.join(providers.select("provider_name", "cloud", "region"), "provider_name", "left")
    return (j.groupBy("catalog_name").agg(
        F.coalesce(F.min("provider_name"), F.lit("unknown")).alias("provider_name"),
        F.min_by("cloud", "provider_name").alias("cloud"),
        F.min_by("region", "provider_name").alias("region"),
        F.array_join(F.array_sort(F.collect_set("share_name")), ",").alias("share_names")))


AUDIENCES = ("provider", "recipient", "both")


def sharing_overlay(audience: str, table_share_usage, privileges, usage, providers):
    """audience switch — 'provider' gives outbound only, 'recipient'
    inbound only, 'both' (or anything else) both. Returns (audience,
    shared_out or None, foreign_catalogs or None)."""
    aud = audience if audience in AUDIENCES else "both"
    out = shared_out(table_share_usage, privileges) if aud in ("provider", "both") else None
    inn = foreign_catalogs(usage, providers) if aud in ("recipient", "both") else None
    return aud, out, inn


def sharing_available(audience: str, loaders: dict) -> bool:
    """the overlay is available when at least one sharing relation the
    audience needs can be read (``loaders``: name -> callable returning the
    DataFrame; a ``limit(1)`` probe each, never a full read)."""
    from .readiness import probe
    aud = audience if audience in AUDIENCES else "both"
    need = {"provider": ("table_share_usage",), "recipient": ("catalog_provider_share_usage",),
            "both": ("table_share_usage", "catalog_provider_share_usage")}[aud]
    return any(probe(loaders[n])[0] for n in need if n in loaders)


def overlay_out(nodes: DataFrame, so: DataFrame, privileges: DataFrame) -> DataFrame:
    """Sharing edges for shared tables present among the graph's
    table nodes: table -> share, share -> each recipient."""
    hit = _shared_tables(nodes, so)
    t2s = hit.select(F.col("full_name").alias("source"),
                     F.concat(F.lit("sharing:share:"), "share_name").alias("target"))
    s2r = (hit.select("share_name").distinct().join(share_recipients(privileges), "share_name")
           .select(F.concat(F.lit("sharing:share:"), "share_name").alias("source"),
                   F.concat(F.lit("sharing:recipient:"), "recipient_name").alias("target")))
    return t2s.unionByName(s2r).distinct()


def overlay_in(nodes: DataFrame, fc: DataFrame) -> DataFrame:
    """Provider -> table edges for table nodes whose catalog is a
    foreign (shared-in) catalog."""
    return (_foreign_tables(nodes, fc.select("catalog_name", "provider_name"))
            .select(F.concat(F.lit("sharing:provider:"), "provider_name").alias("source"),
                    F.col("id").alias("target")).distinct())


def _shared_tables(nodes: DataFrame, so: DataFrame) -> DataFrame:
    tables = nodes.filter(F.col("node_type") == "table").select(F.col("id").alias("full_name"))
    return so.join(tables, "full_name", "left_semi")


def _foreign_tables(nodes: DataFrame, fc: DataFrame) -> DataFrame:
    t = nodes.filter(F.col("node_type") == "table").select("id", F.split(F.col("id"), r"\.").getItem(0).alias("catalog_name"))
    return t.join(fc, "catalog_name")


def overlay_nodes(nodes: DataFrame, so: DataFrame, fc: DataFrame, privileges: DataFrame) -> DataFrame:
    """The nodes that the overlay adds to a graph, one row per
    id: shares of tables in view (``sub``: the alias a table has there, the
    smallest of several), their recipients, and providers of catalogs in view
    (``sub``: cloud and region)."""
    hit = _shared_tables(nodes, so)
    alias = F.when(F.coalesce("shared_as", F.lit("")) != "", F.concat(F.lit("as "), F.col("shared_as")))
    shares = hit.groupBy("share_name").agg(F.min(alias).alias("sub")).select(
        F.lit("share").alias("sharing_kind"), F.col("share_name").alias("label"), "sub")
    recipients = (share_recipients(privileges).join(hit.select("share_name").distinct(), "share_name", "left_semi")
                  .select(F.lit("recipient").alias("sharing_kind"), F.col("recipient_name").alias("label"),
                          F.lit(None).cast("string").alias("sub")).distinct())
    place = F.when(F.coalesce("region", F.lit("")) != "", F.trim(F.concat_ws(" ", "cloud", "region")))
    providers = _foreign_tables(nodes, fc).groupBy("provider_name").agg(F.min(place).alias("sub")).select(
        F.lit("provider").alias("sharing_kind"), F.col("provider_name").alias("label"), "sub")
    every = shares.unionByName(recipients).unionByName(providers)
    return every.select(F.concat_ws(":", F.lit("sharing"), "sharing_kind", "label").alias("id"),
                        F.lit("sharing").alias("node_type"), "sharing_kind", "label", "sub")


def overlay_badges(nodes: DataFrame, so: DataFrame, fc: DataFrame, privileges: DataFrame) -> DataFrame:
    """Badges of the table nodes that are shared out or in. Out: the
    numbers of distinct shares and recipients and the number shown (recipients,
    or shares where nobody has a grant). In: provider and share names of the
    table's catalog. Numbers come from pairs; no list is built for a table."""
    pairs = _shared_tables(nodes, so).select(F.col("full_name").alias("id"), "share_name").distinct()
    n_shares = pairs.groupBy("id").agg(F.count("*").alias("n_shares"))
    granted = share_recipients(privileges).distinct()
    n_rec = pairs.join(granted, "share_name").groupBy("id").agg(F.countDistinct("recipient_name").alias("n_recipients"))
    n_rec0 = F.coalesce("n_recipients", F.lit(0))
    out = n_shares.join(n_rec, "id", "left").select("id", "n_shares", n_rec0.alias("n_recipients"), F.when(
        n_rec0 > 0, n_rec0).otherwise(F.col("n_shares")).alias("shown"))
    inn = _foreign_tables(nodes, fc).select("id", F.col("provider_name").alias("in_provider"), F.col("share_names").alias("in_shares"))
    return out.join(inn, "id", "full")


def overview_shares(shares: DataFrame, table_share_usage: DataFrame, privileges: DataFrame) -> DataFrame:
    """shares with owner, comment, table count and sorted recipients."""
    nt = table_share_usage.groupBy("share_name").agg(F.count("*").alias("num_tables"))
    rec = _sorted_list(share_recipients(privileges), "share_name", "recipient_name", "recipients")
    return (shares.join(nt, "share_name", "left").join(rec, "share_name", "left")
            .select("share_name", F.col("share_owner").alias("owner"), "comment",
                    F.coalesce("num_tables", F.lit(0)).alias("num_tables"),
                    F.coalesce("recipients", F.lit("")).alias("recipients")))


def overview_foreign(usage: DataFrame) -> DataFrame:
    """foreign catalogs with (first) provider and share names (kept
    with duplicates, sorted)."""
    return usage.groupBy("catalog_name").agg(
        F.min("provider_name").alias("provider_name"),
        F.array_join(F.array_sort(F.collect_list("share_name")), ",").alias("share_names"))


def overview_totals(shares, recipients, providers, usage, table_share_usage) -> DataFrame:
    """F8: overview totals as (metric, value) rows."""
    parts = [
        shares.select(F.lit("shares").alias("metric"), F.lit(1).alias("one")),
        recipients.select(F.lit("recipients").alias("metric"), F.lit(1).alias("one")),
        providers.select(F.lit("providers").alias("metric"), F.lit(1).alias("one")),
        usage.select("catalog_name").distinct().select(F.lit("foreign_catalogs").alias("metric"), F.lit(1).alias("one")),
        table_share_usage.select(F.lit("shared_tables").alias("metric"), F.lit(1).alias("one")),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("metric").agg(F.count("*").alias("value"))
