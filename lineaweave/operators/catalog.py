"""Catalog inventory statistics, search and preview (E9-E11, T1-T3),
entity name resolution (C14) and id validation reports (B8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import refs as R


def catalog_stats(inventory: DataFrame) -> DataFrame:
    """Per catalog, distinct schemas and tables of the inventory (A3)."""
    return inventory.groupBy("catalog").agg(F.countDistinct("schema").alias("n_schemas"),
                                            F.count("*").alias("n_tables"))


def schema_stats(inventory: DataFrame) -> DataFrame:
    """Per (catalog, schema): table count, medallion tier and the
    display rank (bronze < silver < gold < others)."""
    return (inventory.groupBy("catalog", "schema").agg(F.count("*").alias("n_tables"))
            .withColumn("tier", P.medallion("schema"))
            .withColumn("tier_rank", P.medallion_rank("tier")))


def totals(inventory: DataFrame) -> DataFrame:
    """Number of catalogs and tables."""
    return inventory.agg(F.countDistinct("catalog").alias("n_catalogs"), F.count("*").alias("n_tables"))


def search_tables(inventory: DataFrame, query: str, k: int = 12) -> DataFrame:
    """Ranked table search, case-insensitive. Score 1000 for an exact
    name, 500 + (1 - len/100) for a name prefix, 200 + (1 - len/100) for a
    name substring, 100 for an fqdn substring; top ``k`` by score, ties by
    fqdn (a bounded top-k: TakeOrderedAndProject)."""
    q = query.lower()
    if not q.strip():
        return inventory.limit(0).withColumn("score", F.lit(None).cast("double"))
    name = F.lower("name")
    fq = F.lower("fqdn")
    ln = F.length("name").cast("double")
    score = (F.when(name == q, F.lit(1000.0))
             .when(name.startswith(q), 500.0 + (1.0 - ln / 100.0))
             .when(name.contains(q), 200.0 + (1.0 - ln / 100.0))
             .when(fq.contains(q), F.lit(100.0)))
    return (inventory.withColumn("score", score).filter(F.col("score") > 0)
            .orderBy(F.desc("score"), F.asc("fqdn")).limit(k))


def search_graph(nodes: DataFrame, query: str) -> DataFrame:
    """Table nodes of a graph whose name contains ``query`` (any case)."""
    t = nodes.filter(F.col("node_type") != "entity")
    if not query:
        return t
    return t.filter(F.lower("name").contains(query.lower()))


def preview(df: DataFrame, text: str = "", key: str | None = None, ascending: bool = True,
            n: int | None = None) -> DataFrame:
    """Filter (B14), sort by one column (numeric order for numeric
    columns, binary string order otherwise; remaining columns break ties)
    and keep the first ``n`` rows, all by default. Without a key the order is
    that of all columns from the left."""
    out = P.filter_rows(df, text)
    first = [] if key is None else [F.col(key).asc_nulls_first() if ascending else F.col(key).desc_nulls_last()]
    rest = [F.col(c).asc_nulls_first() for c in df.columns if c != key]
    out = out.orderBy(*first, *rest)
    return out if n is None else out.limit(n)


def resolve_names(entities: DataFrame, registry: DataFrame) -> DataFrame:
    """C14: display name and owner of entity nodes in one left join with the
    registry (A7) instead of one lookup per entity.

    JOB: registry name when present (owner = run-as, else creator);
    PIPELINE: registry name; NOTEBOOK: last path segment of a path-like id,
    else of the audit path, else ``Notebook {id[:12]}``; anything else, or an
    id failing the safe-id pattern, falls back to ``{TYPE} {id[:12]}``."""
    # one row of a repeated entity: the smallest name (null last) with its own owner
    pick = F.min(F.struct(F.col("name").isNull().alias("none"), "name", "owner")).alias("_r")
    reg = registry.groupBy("entity_type", "entity_id").agg(pick).select(
        "entity_type", "entity_id", F.col("_r.name").alias("_rname"), F.nullif(F.col("_r.owner"), F.lit("")).alias("_rowner"))
    safe = F.coalesce(F.col("entity_id").rlike(P.SAFE_ENTITY_ID_RE), F.lit(False))
    j = entities.join(reg, ["entity_type", "entity_id"], "left")
    et, eid = F.col("entity_type"), F.col("entity_id")
    fallback = F.concat(et, F.lit(" "), F.substring(eid, 1, 12))
    nb_path_id = F.instr(eid, "/") > 0
    name = (F.when(~safe, fallback)
            .when(et == "JOB", F.coalesce(F.when(F.col("_rname") != "", F.col("_rname")), fallback))
            .when(et == "PIPELINE", F.coalesce(F.when(F.col("_rname") != "", F.col("_rname")), fallback))
            .when((et == "NOTEBOOK") & nb_path_id, F.element_at(F.split(eid, "/"), -1))
            .when(et == "NOTEBOOK", F.coalesce(F.col("_rname"),
                                               F.concat(F.lit("Notebook "), F.substring(eid, 1, 12))))
            .otherwise(fallback))
    owner = F.when(safe & (et == "JOB"), F.col("_rowner"))
    return j.withColumn("display_name", name).withColumn("registry_owner", owner).drop("_rname", "_rowner")


def invalid_ids(df: DataFrame, etype: str = "entity_type", eid: str = "entity_id") -> DataFrame:
    """Quarantined rows whose entity id fails its type's pattern."""
    return P.flag_invalid_ids(df, etype, eid)[1]


def via_label(etype: str = "entity_type", eid: str = "entity_id", name: str | None = None) -> F.Column:
    """B13 via-label of a recorded pair: resolved name, else
    ``{TYPE} {id[:8]}``, "—" without an entity."""
    return R.entity_label(etype, eid, name, width=8)
