"""Graph assembly from lineage rows: normalisation, entity roll-up, edge
routing, degree classification, column attachment, and the two builders
(trace graph, scope graph).

A graph is a pair of DataFrames: ``nodes`` (one row per node id, table and
entity nodes in one schema with a ``node_type`` discriminator) and
``edges(source, target)`` (a set). Nothing is collected: per-entity source
and target *sets* are kept as (entity, table) pair relations, never as
arrays, so a hot entity touching millions of tables is just more rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import refs as R
from ..session import materialize
from .skew import cut, fanout_join, heavy_keys

ROW_KEY = ("source_table_full_name", "target_table_full_name", "source_path", "target_path",
           "entity_type", "entity_id")

#: Tables of a class that a list holds on average: two lists stand for about CELL * CELL pairs of tables, and a task has those of one source at a time.
CELL = 256
#: Lists of a side in a cell of their join.
LISTS = 64
#: Pairs of tables that one task makes on average.
PAIRS = 10_000_000


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    meta: DataFrame | None = None


def normalize_rows(ev: DataFrame) -> DataFrame:
    """Attach normalised endpoint ids/types (B5) and the entity key to each
    lineage row: src, src_type, tgt, tgt_type, ekey (NULL for direct rows)."""
    src, stype = R.normalize_ref("source_table_full_name", "source_path", "source_type", F.col("_src_ref"))
    tgt, ttype = R.normalize_ref("target_table_full_name", "target_path", "target_type", F.col("_tgt_ref"))
    ent = R.has_entity("entity_type", "entity_id")
    refs = {"_src_ref": R.path_ref(F.col("source_table_full_name"), F.col("source_path")),
            "_tgt_ref": R.path_ref(F.col("target_table_full_name"), F.col("target_path"))}
    return ev.withColumns(refs).select(
        *ev.columns,
        src.alias("src"), stype.alias("src_type"), tgt.alias("tgt"), ttype.alias("tgt_type"),
        F.when(ent, R.entity_key("entity_type", "entity_id")).alias("ekey"))


def owner_agg(col: str = "created_by", order: str = "event_time"):
    """Deterministic owner: created_by of the newest event (ties -> larger
    name), NULLs ignored."""
    return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.struct(F.col(order), F.col(col))))


def dedupe_rows(ev: DataFrame) -> DataFrame:
    """One row per (source, target, source path, target path, entity
    type, entity id), newest event time and its owner kept. Partial
    aggregation runs map-side before the shuffle."""
    return (ev.groupBy(*ROW_KEY).agg(
        F.min("source_type").alias("source_type"), F.min("target_type").alias("target_type"),
        F.max("event_time").alias("event_time"), owner_agg().alias("created_by")))


def entity_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("ekey").isNotNull())


def entity_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-entity source and target sets as distinct (ekey, table) pairs."""
    er = entity_rows(rows)
    sources = er.filter(F.col("src").isNotNull()).select("ekey", F.col("src").alias("table")).distinct()
    targets = er.filter(F.col("tgt").isNotNull()).select("ekey", F.col("tgt").alias("table")).distinct()
    return sources, targets


def entity_rollup(rows: DataFrame) -> DataFrame:
    """Per entity (type, id): distinct source and target counts, last
    run and owner. Counts come from the pair relations (no set collected)."""
    er = entity_rows(rows)
    base = er.groupBy("ekey", "entity_type", "entity_id").agg(
        F.max("event_time").alias("last_run"), owner_agg().alias("owner"))
    sources, targets = entity_pairs(rows)
    ns = sources.groupBy("ekey").agg(F.count("*").alias("n_sources"))
    nt = targets.groupBy("ekey").agg(F.count("*").alias("n_targets"))
    return (base.join(ns, "ekey", "left").join(nt, "ekey", "left")
            .select("ekey", "entity_type", "entity_id",
                    F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
                    F.coalesce("n_targets", F.lit(0)).alias("n_targets"),
                    "last_run", "owner"))


def route_edges(erows: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """C9 (read-after-write routing) over entity rows:
    entity -> target always; a source the entity also writes becomes a
    direct source -> target edge; any other source feeds the entity.
    ``targets`` are the rows' (entity, target) pairs, if they are at hand."""
    targets = entity_pairs(erows)[1] if targets is None else targets
    flagged = (erows.filter(F.col("src").isNotNull())
               .join(targets.select("ekey", F.col("table").alias("src"), F.lit(True).alias("_raw")),
                     ["ekey", "src"], "left"))
    out_edges = erows.filter(F.col("tgt").isNotNull()).select(
        F.col("ekey").alias("source"), F.col("tgt").alias("target"))
    raw_edges = flagged.filter(F.col("_raw") & F.col("tgt").isNotNull()).select(
        F.col("src").alias("source"), F.col("tgt").alias("target"))
    in_edges = flagged.filter(F.col("_raw").isNull()).select(
        F.col("src").alias("source"), F.col("ekey").alias("target"))
    return out_edges.unionByName(raw_edges).unionByName(in_edges)


def direct_pairs(rows: DataFrame) -> DataFrame:
    return (rows.filter(F.col("ekey").isNull() & F.col("src").isNotNull() & F.col("tgt").isNotNull())
            .select(F.col("src").alias("source"), F.col("tgt").alias("target")).distinct())


def uncovered_pairs(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Direct pairs (s, t) not covered by any entity that reads s and
    writes t. Two equi-joins (s -> entity, then (entity, t) semi) instead of
    materialising every entity's sources x targets. A table that many pairs
    and many entities read is dealt over several tasks."""
    via = (fanout_join(pairs, sources.select(F.col("table").alias("source"), "ekey"), ["source"])
           .join(targets.select("ekey", F.col("table").alias("target")), ["ekey", "target"], "left_semi")
           .select("source", "target"))
    return pairs.join(via, ["source", "target"], "left_anti")


def classify(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """upstream/downstream degree over the edge set and lineage status
    for table nodes (entity neighbours count as edges). Entity nodes carry
    0 counts and a NULL status."""
    up = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("_up"))
    down = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("_down"))
    is_table = F.col("node_type") == "table"
    u = F.coalesce("_up", F.lit(0))
    d = F.coalesce("_down", F.lit(0))
    return (nodes.join(up, "id", "left").join(down, "id", "left")
            .withColumn("upstream_count", F.when(is_table, u).otherwise(F.lit(0)))
            .withColumn("downstream_count", F.when(is_table, d).otherwise(F.lit(0)))
            .withColumn("lineage_status", F.when(~is_table, F.lit(None))
                        .when((u == 0) & (d == 0), "orphan").when(u == 0, "root")
                        .when(d == 0, "leaf").otherwise("connected"))
            .drop("_up", "_down"))


def column_arrays(columns_meta: DataFrame, type_col: str = "data_type", foreign: str | None = None) -> DataFrame:
    """Per (catalog, schema, table) the ordered array of
    struct(name, type, nullable). Bounded by a table's column count. With
    ``foreign``, ``_foreign`` is the same array with types of that column."""
    def ordered(raw, kind):
        rows = F.array_sort(F.transform(raw, lambda c: F.struct(c["ordinal"].alias("ordinal"), c["name"].alias("name"),
                                                                c[kind].alias("type"), c["nullable"].alias("nullable"))))
        return F.transform(rows, lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"), c["nullable"].alias("nullable")))

    types = [F.col(type_col).alias("type")] + ([] if foreign is None else [F.col(foreign).alias("foreign")])
    return (columns_meta
            .groupBy(F.col("table_catalog"), F.col("table_schema"), F.col("table_name"))
            .agg(F.collect_list(F.struct(
                F.col("ordinal_position").cast("int").alias("ordinal"),
                F.col("column_name").alias("name"), *types,
                (F.col("is_nullable") == "YES").alias("nullable"))).alias("_cols"))
            .select(F.concat_ws(".", "table_catalog", "table_schema", "table_name").alias("id"),
                    ordered("_cols", "type").alias("columns"),
                    *([] if foreign is None else [ordered("_cols", "foreign").alias("_foreign")])))


def attach_columns(nodes: DataFrame, columns_meta: DataFrame, type_col: str = "data_type",
                   skip_types: tuple[str, ...] = ("VOLUME", "PATH"), foreign: str | None = None) -> DataFrame:
    """Left-join ordered column arrays onto table nodes keyed by the
    full (catalog, schema, table) id — never the bare name. Volume and path
    nodes get none. Column metadata is semi-joined to the graph's ids
    before it is grouped, so only the graph's tables are aggregated."""
    wanted = nodes.select("id").distinct()
    meta = (columns_meta.withColumn("_id", F.concat_ws(".", "table_catalog", "table_schema", "table_name"))
            .join(wanted.select(F.col("id").alias("_id")), "_id", "left_semi").drop("_id"))
    cols = column_arrays(meta, type_col, foreign)
    joined = nodes.join(cols, "id", "left")
    if foreign is not None:
        joined = joined.withColumn("columns", F.when(F.col("_local").isNotNull(), F.col("columns")).otherwise(F.col("_foreign"))).drop("_foreign")
    keep = (F.col("node_type") == "table") & ~F.coalesce(F.col("table_type").isin(*skip_types), F.lit(False))
    empty = F.array().cast("array<struct<name:string,type:string,nullable:boolean>>")
    return joined.withColumn("columns", F.when(keep, F.coalesce(F.col("columns"), empty)).otherwise(empty))


NODE_COLS = ("id", "node_type", "name", "full_name", "table_type", "owner", "comment", "created_at",
             "updated_at", "entity_type", "entity_id", "last_run")


def _table_node(df: DataFrame) -> DataFrame:
    return df.select(
        "id", F.lit("table").alias("node_type"), "name", F.col("id").alias("full_name"), "table_type",
        F.col("owner").cast("string").alias("owner"), F.col("comment").cast("string").alias("comment"),
        F.col("created_at"), F.col("updated_at"),
        F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("string").alias("entity_id"),
        F.col("last_run"))


def _entity_nodes(erows: DataFrame, ts_type: str) -> DataFrame:
    e = erows.groupBy("ekey", "entity_type", "entity_id").agg(
        F.max("event_time").alias("last_run"), owner_agg().alias("owner"))
    return e.select(
        F.col("ekey").alias("id"), F.lit("entity").alias("node_type"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("full_name"),
        F.lit(None).cast("string").alias("table_type"), "owner", F.lit(None).cast("string").alias("comment"),
        F.lit(None).cast(ts_type).alias("created_at"), F.lit(None).cast(ts_type).alias("updated_at"),
        "entity_type", "entity_id", "last_run")


def _ref_nodes(rows: DataFrame) -> DataFrame:
    """Distinct endpoint refs with a deterministic type (smallest seen)."""
    refs = (rows.select(F.col("src").alias("id"), F.col("src_type").alias("t"))
            .unionByName(rows.select(F.col("tgt").alias("id"), F.col("tgt_type").alias("t")))
            .filter(F.col("id").isNotNull()))
    return refs.groupBy("id").agg(F.min("t").alias("table_type"))


def _ts_type(rows: DataFrame) -> str:
    return rows.schema["event_time"].dataType.simpleString()


def build_trace_graph(rows: DataFrame, columns_meta: DataFrame | None = None,
                      cost: DataFrame | None = None) -> Graph:
    """D3 assembly over normalised, deduplicated rows: lightweight table
    nodes for every endpoint, entity nodes, routed edges (every direct pair
    kept), degree classification, optional columns and cost."""
    ts = _ts_type(rows)
    refs = _ref_nodes(rows)
    tables = _table_node(refs.select(
        "id", R.node_label(F.col("id"), F.col("table_type")).alias("name"), "table_type",
        F.lit(None).alias("owner"), F.lit(None).alias("comment"),
        F.lit(None).cast(ts).alias("created_at"), F.lit(None).cast(ts).alias("updated_at"),
        F.lit(None).cast(ts).alias("last_run")))
    erows = entity_rows(rows)
    nodes = tables.unionByName(_entity_nodes(erows, ts))
    edges = route_edges(erows).unionByName(direct_pairs(rows)).distinct()
    return _finish(nodes, edges, columns_meta, cost, "data_type")


def _finish(nodes, edges, columns_meta, cost, type_col) -> Graph:
    if columns_meta is not None:
        nodes = attach_columns(nodes, columns_meta, type_col)
    if cost is not None:
        from .cost import attach_cost
        nodes = attach_cost(nodes, cost)
    return Graph(classify(nodes, edges), edges)


#: What a scope graph reads of a normalised row.
_REF_COLS = ("src", "src_type", "tgt", "tgt_type", "ekey", "entity_type", "entity_id")


def build_scope_graph(ev_all: DataFrame, tables_meta: DataFrame, catalog: str, schema: str | None = None,
                      columns_meta: DataFrame | None = None, cost: DataFrame | None = None,
                      max_tables: int | None = None) -> Graph:
    """Lineage graph of one schema (or a whole catalog).

    ``ev_all`` is the windowed, internal-free lineage scan (A1) over every
    catalog. Steps: in-scope tables from metadata; scope-filtered rows with
    local flags; entities touching a local table, with *all* their rows
    (follow-up semi-join on (type, id)); direct pairs with a local side that
    no entity covers; external stubs; read-after-write routing; degrees."""
    from ..functions import predicates as P
    from ..sources.scans import SKIP_SCHEMAS

    meta = tables_meta.filter((F.col("table_catalog") == catalog) & P.not_internal_table("table_name"))
    meta = meta.filter(F.col("table_schema") == schema) if schema is not None else \
        meta.filter(~F.col("table_schema").isin(*SKIP_SCHEMAS))
    if max_tables is not None and schema is None:
        n = meta.count()
        if n > max_tables:
            raise ValueError(f"catalog {catalog!r} has {n} tables, over the {max_tables}-table limit")
    scope_ids = meta.select(F.concat_ws(".", "table_catalog", "table_schema", "table_name").alias("id")).distinct()

    rows_in = normalize_rows(ev_all.filter(P.scope_predicate(catalog, schema)))
    loc_s = scope_ids.select(F.col("id").alias("src"), F.lit(True).alias("src_local"))
    loc_t = scope_ids.select(F.col("id").alias("tgt"), F.lit(True).alias("tgt_local"))
    flagged = materialize(rows_in.select(*_REF_COLS).join(loc_s, "src", "left").join(loc_t, "tgt", "left")
                          .withColumn("src_local", F.coalesce("src_local", F.lit(False)))
                          .withColumn("tgt_local", F.coalesce("tgt_local", F.lit(False))), "scope-rows")
    rows_in = flagged

    # Entities touching a local table; C7: all their rows, any scope.
    keep = (flagged.filter(F.col("ekey").isNotNull() & (F.col("src_local") | F.col("tgt_local")))
            .select("entity_type", "entity_id").distinct())
    erows = normalize_rows(ev_all.join(keep, ["entity_type", "entity_id"], "left_semi"))
    erows = materialize(entity_rows(erows).select(*_REF_COLS, "event_time", "created_by"), "scope-erows")

    # Direct rows with at least one local side.
    drows = flagged.filter(F.col("ekey").isNull() & (F.col("src_local") | F.col("tgt_local")))
    pairs = drows.filter(F.col("src").isNotNull() & F.col("tgt").isNotNull()) \
        .select(F.col("src").alias("source"), F.col("tgt").alias("target")).distinct()
    # read several times below, so written once each
    sources, targets = (materialize(p, "scope-pairs") for p in entity_pairs(erows))
    edges = materialize(route_edges(erows, targets).unionByName(uncovered_pairs(pairs, sources, targets)).distinct(), "scope-edges")

    # External stubs: non-local endpoints of kept direct rows and entities.
    ext = (drows.filter(F.col("src").isNotNull() & ~F.col("src_local")).select(F.col("src").alias("id"))
           .unionByName(drows.filter(F.col("tgt").isNotNull() & ~F.col("tgt_local")).select(F.col("tgt").alias("id")))
           .unionByName(sources.select(F.col("table").alias("id")))
           .unionByName(targets.select(F.col("table").alias("id")))
           .distinct().join(scope_ids, "id", "left_anti"))
    typed = _ref_nodes(rows_in.select("src", "src_type", "tgt", "tgt_type")
                       .unionByName(erows.select("src", "src_type", "tgt", "tgt_type")))
    stubs = (ext.join(typed, "id", "left")
             .withColumn("table_type", F.coalesce("table_type", F.lit("EXTERNAL_LINEAGE"))))
    ts = _ts_type(ev_all)
    stub_nodes = _table_node(stubs.select(
        "id", R.node_label(F.col("id"), F.col("table_type")).alias("name"), "table_type",
        F.lit(None).alias("owner"), R.stub_comment(F.col("id"), F.col("table_type")).alias("comment"),
        F.lit(None).cast(ts).alias("created_at"), F.lit(None).cast(ts).alias("updated_at"),
        F.lit(None).cast(ts).alias("last_run")))
    local_nodes = _table_node(meta.select(
        F.concat_ws(".", "table_catalog", "table_schema", "table_name").alias("id"),
        F.col("table_name").alias("name"),
        F.coalesce(F.col("table_type"), F.lit("TABLE")).alias("table_type"),
        F.col("table_owner").alias("owner"), F.col("comment"),
        F.col("created").cast(ts).alias("created_at"), F.col("last_altered").cast(ts).alias("updated_at"),
        F.lit(None).cast(ts).alias("last_run")))
    nodes = local_nodes.unionByName(stub_nodes).unionByName(_entity_nodes(erows, ts))
    if columns_meta is not None:
        # in-scope tables use data_type, external stubs full_data_type
        local_ids = scope_ids.select("id", F.lit(True).alias("_local"))
        nodes = materialize(nodes.join(local_ids, "id", "left"), "scope-nodes")
        nodes = attach_columns(nodes, columns_meta, "data_type", foreign="full_data_type").drop("_local")
    if cost is not None:
        from .cost import attach_cost
        nodes = attach_cost(nodes, cost)
    return Graph(classify(nodes, edges), edges)


def capped(df: DataFrame, limit: int | None) -> DataFrame:
    """T4: an optional row cap made deterministic by a total order over
    every column (a bounded top-k, TakeOrderedAndProject)."""
    if limit is None:
        return df
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in df.columns]).limit(limit)


def table_edges(ev: DataFrame, catalog: str | None = None, schema: str | None = None,
                limit: int | None = None) -> DataFrame:
    """E5: distinct recorded (source, target, entity_type, entity_id) table
    pairs, both sides present, no self pairs; optional catalog/schema scope
    on either side's table and optional deterministic cap (T4)."""
    df = ev.filter(F.col("source_table_full_name").isNotNull() & F.col("target_table_full_name").isNotNull()
                   & (F.col("source_table_full_name") != F.col("target_table_full_name")))
    if catalog is not None:
        if schema is None:
            df = df.filter((F.col("target_table_catalog") == catalog) | (F.col("source_table_catalog") == catalog))
        else:
            df = df.filter(((F.col("target_table_catalog") == catalog) & (F.col("target_table_schema") == schema))
                           | ((F.col("source_table_catalog") == catalog) & (F.col("source_table_schema") == schema)))
    return capped(df.select(F.col("source_table_full_name").alias("source"),
                            F.col("target_table_full_name").alias("target"),
                            "entity_type", "entity_id").distinct(), limit)


def column_edges(cl: DataFrame, catalog: str | None = None, schema: str | None = None,
                 limit: int | None = None) -> DataFrame:
    """Distinct column edges with both tables and columns present and
    different tables; optional schema scope on either side and optional
    deterministic cap (T4)."""
    df = cl.filter(F.col("source_table_full_name").isNotNull() & F.col("target_table_full_name").isNotNull()
                   & (F.col("source_table_full_name") != F.col("target_table_full_name"))
                   & F.col("source_column_name").isNotNull() & F.col("target_column_name").isNotNull())
    if catalog is not None:
        if schema is None:
            df = df.filter((F.col("target_table_catalog") == catalog) | (F.col("source_table_catalog") == catalog))
        else:
            df = df.filter(((F.col("target_table_catalog") == catalog) & (F.col("target_table_schema") == schema))
                           | ((F.col("source_table_catalog") == catalog) & (F.col("source_table_schema") == schema)))
    return capped(df.select(F.col("source_table_full_name").alias("source_table"),
                            F.col("source_column_name").alias("source_column"),
                            F.col("target_table_full_name").alias("target_table"),
                            F.col("target_column_name").alias("target_column")).distinct(), limit)


def column_edges_of(edges: DataFrame, table: str, column: str) -> DataFrame:
    """Column edges touching exactly (table, column) on either side."""
    return edges.filter(((F.col("source_table") == table) & (F.col("source_column") == column))
                        | ((F.col("target_table") == table) & (F.col("target_column") == column)))


def table_classes(pairs: DataFrame) -> DataFrame:
    """(table, cls) over distinct pairs (e, table): tables with the same
    entities are one class, named by its smallest table. Sets are compared by
    size and two hashes; then every pair is looked up at the class's table,
    and a table that differs after all is a class of its own."""
    bits = [F.bit_xor(F.xxhash64(F.lit(k), "e")).alias(f"_{k}") for k in range(2)]
    same = ["_n", "_0", "_1"]
    # written: the names below must come from one and the same grouping
    prints = materialize(pairs.groupBy("table").agg(F.count("*").alias("_n"), *bits), "class-prints")
    named = materialize(prints.join(prints.groupBy(*same).agg(F.min("table").alias("cls")), same).select("table", "cls"), "class-names")
    odd = (pairs.join(named, "table").join(pairs.select("e", F.col("table").alias("cls")), ["e", "cls"], "left_anti")
           .select("table").distinct().withColumn("_odd", F.lit(True)))
    return named.join(odd, "table", "left").select("table", F.when(F.col("_odd"), F.col("table")).otherwise(F.col("cls")).alias("cls"))


def class_lists(classes: DataFrame, cls: str, names: str) -> DataFrame:
    """(cls, names): the tables of every class in lists of about ``CELL``. A class goes over as many tasks as it has lists."""
    table = next(c for c in classes.columns if c != cls)
    large = heavy_keys(classes, [cls], CELL)
    parts = cut(classes, large, [table]) if large.n else classes.withColumn("part", F.lit(0))
    return parts.groupBy(cls, "part").agg(F.collect_list(table).alias(names)).drop("part")


def expanded(linked: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target) of every linked pair of classes (a, b), without self pairs.

    Lists of names are joined, and each pair of lists is opened where it ends up. The join's input is small beside what it
    makes, and Spark deals rows to tasks by the bytes of the input; so the pairs of lists are dealt out once more, over
    a number of tasks that follows from the number of pairs to make."""
    n = (linked.join(sources.groupBy("a").agg(F.count("*").alias("_s")), "a").join(targets.groupBy("b").agg(F.count("*").alias("_t")), "b")
         .agg(F.sum(F.col("_s").cast("double") * F.col("_t"))).first()[0] or 0)
    few = linked.sparkSession.sparkContext.defaultParallelism
    tasks = max(math.ceil(n / PAIRS), min(few, math.ceil(n / CELL / CELL)), 1)
    lists = fanout_join(linked, class_lists(sources, "a", "_sources"), ["a"], LISTS)
    lists = fanout_join(lists.select("b", "_sources"), class_lists(targets, "b", "_targets"), ["b"], LISTS)
    # a table is in one list only, so the first two names stand for the pair of lists
    lists = lists.select("_sources", "_targets").repartition(tasks, F.col("_sources")[0], F.col("_targets")[0])
    # transform has no generated code, so a task opens the first list a name at a time and holds the rows of one name, not of all
    one = lists.select(F.explode(F.transform("_sources", lambda name: name)).alias("source"), "_targets")
    return one.select("source", F.explode("_targets").alias("target")).filter(F.col("source") != F.col("target"))


def collapse_to_tables(edges: DataFrame) -> DataFrame:
    """C10 / V1 edges: table -> table pass-through edges plus, per entity,
    its sources joined to its targets (no self pairs, distinct).

    Sources with the same readers, and targets with the same writers, are one
    class each. Only linked pairs of classes are made distinct; they are then
    expanded to their tables, each pair of tables once, so the pairs
    themselves, as many as the result has, are neither shuffled nor compared. Direct edges that a pair
    of classes stands for are left out before. A hub entity's or a large
    class's pairs are dealt over several tasks."""
    ent_s = R.is_entity_id("source")
    ent_t = R.is_entity_id("target")
    direct = edges.filter(~ent_s & ~ent_t & (F.col("source") != F.col("target"))).select("source", "target").distinct()
    ins = materialize(edges.filter(~ent_s & ent_t).select(F.col("target").alias("e"), F.col("source").alias("table")).distinct(), "collapse-ins")
    outs = materialize(edges.filter(ent_s & ~ent_t).select(F.col("source").alias("e"), F.col("target").alias("table")).distinct(), "collapse-outs")
    sources = materialize(table_classes(ins).toDF("source", "a"), "collapse-sources")
    targets = materialize(table_classes(outs).toDF("target", "b"), "collapse-targets")
    reads = ins.join(sources.where("source = a").select(F.col("a").alias("table")), "table", "left_semi").select("e", F.col("table").alias("a"))
    writes = outs.join(targets.where("target = b").select(F.col("b").alias("table")), "table", "left_semi").select("e", F.col("table").alias("b"))
    linked = materialize(fanout_join(reads, writes, ["e"]).select("a", "b").distinct(), "collapse-linked")
    rest = (direct.join(sources, "source", "left").join(targets, "target", "left")
            .join(linked, ["a", "b"], "left_anti").select("source", "target"))
    return rest.unionByName(expanded(linked, sources, targets))


def pipeline_deps(edges: DataFrame) -> DataFrame:
    """C11 / V2 edges: entity A -> entity B when A writes a table B reads, A != B.
    A hub table's pairs are dealt over several tasks."""
    ent_s = R.is_entity_id("source")
    ent_t = R.is_entity_id("target")
    writes = edges.filter(ent_s & ~ent_t).select(F.col("source").alias("a"), F.col("target").alias("t")).distinct()
    reads = edges.filter(~ent_s & ent_t).select(F.col("source").alias("t"), F.col("target").alias("b")).distinct()
    return (fanout_join(writes, reads, ["t"]).filter(F.col("a") != F.col("b"))
            .select(F.col("a").alias("source"), F.col("b").alias("target")).distinct())


def tables_view(g: Graph) -> Graph:
    """V1: table nodes with collapsed edges."""
    return Graph(g.nodes.filter(F.col("node_type") != "entity"), collapse_to_tables(g.edges))


def pipelines_view(g: Graph) -> Graph:
    """V2: entity nodes with pipeline dependency edges."""
    return Graph(g.nodes.filter(F.col("node_type") == "entity"), pipeline_deps(g.edges))


def full_view(g: Graph) -> Graph:
    """V3: the graph as is."""
    return g
