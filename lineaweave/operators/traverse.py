"""Iterative graph traversal on DataFrames.

The kernel is a breadth-first loop of joins keyed by ``seed`` so one loop
serves one seed or millions of seeds:

    frontier(seed, node) ⋈ adjacency(node, nbr) -> distinct (seed, nbr)
                         ▷ left-anti visited(seed, node)  -> next frontier

Each hop's frontier is written to the checkpoint folder and read back
(``session.materialize``): lineage is cut, a lost executor never replays
earlier hops, and the planner sees the frontier's real size, so a small
frontier is broadcast under ``autoBroadcastJoinThreshold`` while a large
one is shuffled to the adjacency, which is partitioned once and cached. Hub
nodes are cut into parts of the adjacency first, and the frontier's rows of a
hub are repeated for each part, so a hub's neighbours are read by many tasks.
Only an emptiness probe returns to the driver. Spark's recursive CTE is not used: it only allows
UNION ALL, which never reaches a fixpoint on cyclic lineage."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize
from . import graph as G
from .skew import Hubs, cut, heavy_keys, repeated


def reach(adj: DataFrame, seeds: DataFrame, max_hops: int | None = None, keys: tuple[str, ...] = ("seed",),
          route: tuple[str, ...] = (), hubs: Hubs | None = None) -> DataFrame:
    """Breadth-first reach.

    ``adj(*route, node, nbr)`` distinct directed pairs; ``seeds(*keys,
    node)`` start nodes. Returns ``(*keys, node, hop)`` with the minimum
    hop count of every node reachable from each key (hop 0 = the seed),
    up to ``max_hops``. ``route`` columns (a subset of ``keys``) select the
    adjacency a key walks on, so e.g. up- and down-walks of many seeds run
    in one loop. ``hubs``, where given, are the nodes that ``adj`` has
    in parts (its column ``part``, 0 for all others); see ``split_hubs``. Terminates on cycles (visited anti-join) and when a hop
    adds nothing. Each hop is appended once to the walk's folder, which one
    scan reads as the visited set and, at the end, as the result; nothing is
    written again. One count (the emptiness probe) per hop."""
    keys = tuple(keys)
    step = [*route, "node"] if hubs is None else [*route, "node", "part"]
    adj = adj.select(*step, "nbr")
    spark = adj.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/lw-reach-{uuid.uuid4().hex}"
    paths: list[str] = []

    def append(df: DataFrame) -> DataFrame:
        path = f"{base}/h{len(paths)}"
        df.write.parquet(path)
        paths.append(path)
        return spark.read.schema(df.schema).parquet(path)
    first = append(seeds.select(*keys, "node").distinct().withColumn("hop", F.lit(0)))
    schema, frontier = first.schema, first.drop("hop")
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        visited = spark.read.schema(schema).parquet(*paths).select(*keys, "node")
        if hubs is not None:
            frontier = repeated(frontier, hubs, list(keys))
        nxt = (frontier.join(adj, step).select(*keys, F.col("nbr").alias("node")).distinct()
               .join(visited, [*keys, "node"], "left_anti").withColumn("hop", F.lit(hop)))
        nxt = append(nxt)
        if nxt.count() == 0:
            break
        frontier = nxt.drop("hop")
    return spark.read.schema(schema).parquet(*paths)


def split_hubs(adj: DataFrame, route: tuple[str, ...] = (), heavy: int | None = None) -> tuple[DataFrame, Hubs | None]:
    """``adj`` partitioned for ``reach`` and its hubs: nodes of more than
    ``heavy`` neighbours are cut into parts by a hash of the neighbour (None,
    and no parts, where there are none)."""
    key = [*route, "node"]
    hubs = heavy_keys(adj, key, heavy)
    if hubs.n == 0:
        return adj.repartition(*key), None
    return cut(adj, hubs, ["nbr"]).repartition(*key, "part"), hubs


def seeds_frame(spark: SparkSession, seeds: list[str] | DataFrame) -> DataFrame:
    """Seeds as a (seed, node) frame; a DataFrame with a ``seed`` column is
    used as is (the multi-seed path never touches the driver)."""
    if isinstance(seeds, DataFrame):
        return seeds.select(F.col("seed"), F.col("seed").alias("node"))
    return spark.createDataFrame([(s, s) for s in seeds], "seed string, node string")


def lineage_adjacency(ev: DataFrame, direction: str) -> DataFrame:
    """Table-name adjacency of the lineage log (L3: only ``*_full_name``
    columns are walked, so volumes and paths are endpoints, not frontier).
    ``up`` maps target -> source, ``down`` source -> target."""
    s, t = F.col("source_table_full_name"), F.col("target_table_full_name")
    df = ev.filter(s.isNotNull() & t.isNotNull())
    if direction == "up":
        df = df.select(t.alias("node"), s.alias("nbr"))
    else:
        df = df.select(s.alias("node"), t.alias("nbr"))
    return df.distinct()


def trace_many(ev: DataFrame, seeds: list[str] | DataFrame, max_hops: int | None = None,
               directions: tuple[str, ...] = ("up", "down"), heavy: int | None = None) -> DataFrame:
    """(seed, node, direction, hop) for every seed's ancestors
    ('up') and descendants ('down'), each direction with its own visited
    set (true ancestors and descendants, also on cyclic graphs). Both
    directions of every seed advance in the same loop."""
    spark = ev.sparkSession
    sf = seeds_frame(spark, seeds)
    s, t = F.col("source_table_full_name"), F.col("target_table_full_name")
    pairs = (ev.filter(s.isNotNull() & t.isNotNull()).select(s.alias("s"), t.alias("t")).distinct()
             .persist(StorageLevel.MEMORY_AND_DISK))  # one scan of the log serves both directions
    views = {"up": pairs.select(F.col("t").alias("node"), F.col("s").alias("nbr")),
             "down": pairs.select(F.col("s").alias("node"), F.col("t").alias("nbr"))}
    adj = reduce(DataFrame.unionByName, [views[d].withColumn("direction", F.lit(d)) for d in directions])
    adj, hubs = split_hubs(adj, ("direction",), heavy)
    adj = adj.persist(StorageLevel.MEMORY_AND_DISK)
    start = reduce(DataFrame.unionByName, [sf.withColumn("direction", F.lit(d)) for d in directions])
    r = reach(adj, start, max_hops, keys=("direction", "seed"), route=("direction",), hubs=hubs)
    adj.unpersist()    # the result is written parquet; the caches are no longer needed
    pairs.unpersist()
    return r.select("seed", "node", "direction", "hop")


def trace(ev: DataFrame, seed: str, direction: str, max_hops: int | None = None) -> DataFrame:
    """D1 (direction='up') / D2 (direction='down') for one seed: (node, hop)."""
    return trace_many(ev, [seed], max_hops, (direction,)).select("node", "hop")


def _flag_rows(ev: DataFrame, reached: DataFrame) -> DataFrame:
    """One pass over the log: each row with the up-walk hop of its target
    (``_hu``) and the down-walk hop of its source (``_hd``), NULL when not
    reached. The reached sets are checkpointed, so the planner broadcasts
    them when a cone is small and shuffles otherwise."""
    up = reached.filter(F.col("direction") == "up").groupBy(
        F.col("node").alias("target_table_full_name")).agg(F.min("hop").alias("_hu"))
    dn = reached.filter(F.col("direction") == "down").groupBy(
        F.col("node").alias("source_table_full_name")).agg(F.min("hop").alias("_hd"))
    return (ev.join(up, "target_table_full_name", "left").join(dn, "source_table_full_name", "left")
            .filter(F.col("_hu").isNotNull() | F.col("_hd").isNotNull()))


def trace_rows(ev: DataFrame, reached: DataFrame, max_hops: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows a trace collects, and the truncation flag, from one scan.

    Up rows: events whose target is a node expanded by the up walk (hop <
    max_hops); down rows: events whose source was expanded downward.
    Truncated: an event still matches a node found at the hop limit."""
    lim = F.lit(max_hops if max_hops is not None else 1 << 30)
    flagged = materialize(_flag_rows(ev, reached), "trace-flagged")
    rows = flagged.filter((F.col("_hu") < lim) | (F.col("_hd") < lim)).drop("_hu", "_hd")
    meta = flagged.agg(F.count(F.when((F.col("_hu") >= lim) | (F.col("_hd") >= lim), 1)).__gt__(0)
                       .alias("truncated"))
    return rows, meta


def truncation_rows(ev: DataFrame, reached: DataFrame, max_hops: int | None) -> DataFrame:
    """Events still matching a node found at the hop limit (one ``x``
    column); non-empty means the walk stopped short of the full cone."""
    lim = F.lit(max_hops if max_hops is not None else 1 << 30)
    return (_flag_rows(ev, reached).filter((F.col("_hu") >= lim) | (F.col("_hd") >= lim))
            .select(F.lit(1).alias("x")))


def trace_graph(ev: DataFrame, seed: str, max_hops: int | None = None, columns_meta: DataFrame | None = None,
                cost: DataFrame | None = None, window_days: int | None = None) -> G.Graph:
    """D3: full cone of one seed as a graph — up and down walks, the rows
    they reach deduplicated (E8), nodes, read-after-write routed edges,
    degree status, optional columns/cost, and a one-row meta frame."""
    reached = materialize(trace_many(ev, [seed], max_hops), "reached")
    rows, meta = trace_rows(ev, reached, max_hops)
    rows = materialize(G.normalize_rows(G.dedupe_rows(rows)), "trace-rows")
    g = G.build_trace_graph(rows, columns_meta, cost)
    g.meta = meta.withColumn("lineage_window_days", F.lit(window_days).cast("int"))
    return g


def graph_reach(edges: DataFrame, seeds: DataFrame, directions: tuple[str, ...] = ("up", "down"),
                max_hops: int | None = None) -> DataFrame:
    """Reach over a graph's own edge set (tables and entities alike), all
    requested directions in one loop: (direction, seed, node, hop)."""
    parts = []
    for d in directions:
        a, b = ("target", "source") if d == "up" else ("source", "target")
        parts.append(edges.select(F.lit(d).alias("direction"), F.col(a).alias("node"), F.col(b).alias("nbr")))
    adj = reduce(DataFrame.unionByName, parts).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    start = reduce(DataFrame.unionByName, [seeds.select(F.lit(d).alias("direction"), "seed", "node")
                                           for d in directions])
    out = reach(adj, start, max_hops, keys=("direction", "seed"), route=("direction",))
    adj.unpersist()  # the result is written parquet
    return out


def induced_edges(edges: DataFrame, node_set: DataFrame) -> DataFrame:
    """Edges with both ends in ``node_set(id)``."""
    ids = node_set.select("id").distinct()
    return (edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi")
            .join(ids.select(F.col("id").alias("target")), "target", "left_semi"))


def highlight(g: G.Graph, node: str) -> tuple[DataFrame, DataFrame]:
    """Highlight set of a selected node and the edges inside it. A table
    highlights its full transitive up and down closure; an entity only its
    direct sources and targets."""
    spark = g.edges.sparkSession
    seeds = seeds_frame(spark, [node])
    if node.startswith("entity:"):
        one = (g.edges.filter(F.col("target") == node).select(F.col("source").alias("id"))
               .unionByName(g.edges.filter(F.col("source") == node).select(F.col("target").alias("id"))))
        ids = one.unionByName(spark.createDataFrame([(node,)], "id string")).distinct()
    else:
        ids = graph_reach(g.edges, seeds).select(F.col("node").alias("id")).distinct()
    return ids, induced_edges(g.edges, ids)


def depth_reach(edges: DataFrame, node: str, depth: int | None) -> DataFrame:
    """Nodes within ``depth`` table hops of ``node``, up and down in one
    loop (``direction`` column), entity nodes transparent: stepping onto an
    entity costs 0, onto a table 1 (a 0-1 BFS in rounds). Each round first
    closes the zero-cost steps, then takes one table hop; a table at the
    depth limit is not expanded at all. Exact minimum table-hop distance."""
    spark = edges.sparkSession
    parts = []
    for d in ("up", "down"):
        a, b = ("target", "source") if d == "up" else ("source", "target")
        parts.append(edges.select(F.lit(d).alias("direction"), F.col(a).alias("node"), F.col(b).alias("nbr")))
    adj = reduce(DataFrame.unionByName, parts).distinct()
    ent = F.col("nbr").startswith("entity:")
    to_entity = adj.filter(ent).persist(StorageLevel.MEMORY_AND_DISK)
    to_table = adj.filter(~ent).persist(StorageLevel.MEMORY_AND_DISK)
    base, paths = f"{checkpoint_dir(spark).rstrip('/')}/lw-focus-{uuid.uuid4().hex}", []

    def append(df: DataFrame) -> tuple[DataFrame, int]:
        """Write a round's new nodes once; they and their number."""
        path = f"{base}/r{len(paths)}"
        df.write.parquet(path)
        paths.append(path)
        out = spark.read.schema("direction string, node string").parquet(path)
        return out, out.count()

    def step(frontier: DataFrame, by: DataFrame) -> tuple[DataFrame, int]:
        visited = spark.read.schema("direction string, node string").parquet(*paths)
        return append(frontier.join(by, ["direction", "node"]).select("direction", F.col("nbr").alias("node"))
                      .distinct().join(visited, ["direction", "node"], "left_anti"))

    frontier, _ = append(spark.createDataFrame([("up", node), ("down", node)], "direction string, node string"))
    rounds = 0
    while depth is None or rounds < depth:
        # zero-cost closure through entities (tables at the limit never expand)
        ents = frontier
        while True:
            ents, n = step(ents, to_entity)
            if n == 0:
                break
            frontier = frontier.unionByName(ents)
        rounds += 1
        frontier, n = step(frontier, to_table)
        if n == 0:
            break
    to_entity.unpersist()
    to_table.unpersist()
    return spark.read.schema("direction string, node string").parquet(*paths)


def focus(g: G.Graph, table: str, depth: int = 0) -> G.Graph:
    """D6 + D7: focus subgraph of a table — nodes within ``depth`` table hops
    up and down (0 = unlimited; entities transparent), plus every direct
    neighbour of each entity reached, and the edges induced on that set."""
    d = depth if depth > 0 else None
    reached = depth_reach(g.edges, table, d).select(F.col("node").alias("id")).distinct()
    ents = reached.filter(F.col("id").startswith("entity:"))
    nb = (g.edges.join(ents.select(F.col("id").alias("target")), "target").select(F.col("source").alias("id"))
          .unionByName(g.edges.join(ents.select(F.col("id").alias("source")), "source")
                       .select(F.col("target").alias("id"))))
    ids = reached.unionByName(nb).distinct()
    nodes = g.nodes.join(ids, "id", "left_semi")
    return G.Graph(nodes, induced_edges(g.edges, ids))


def _col_key(table: F.Column, col: F.Column) -> F.Column:
    return F.concat(table, F.lit("."), F.lower(col))


def trace_column(col_edges: DataFrame, table: str, column: str,
                 directions: tuple[str, ...] = ("up", "down")) -> DataFrame:
    """Column edges on the transitive trace of (table, column).
    Columns match case-insensitively; edges stay distinct as recorded
    (case-sensitive). Up: every edge whose target is an ancestor key (seed
    included); down: every edge whose source is a descendant key."""
    spark = col_edges.sparkSession
    keyed = col_edges.select("*", _col_key(F.col("source_table"), F.col("source_column")).alias("skey"),
                             _col_key(F.col("target_table"), F.col("target_column")).alias("tkey"))
    seed_key = f"{table}.{column.lower()}"
    seeds = spark.createDataFrame([(seed_key, seed_key)], "seed string, node string")
    key_edges = keyed.select(F.col("skey").alias("source"), F.col("tkey").alias("target"))
    r = graph_reach(key_edges, seeds, directions)
    up = r.filter(F.col("direction") == "up").select(F.col("node").alias("tkey"))
    down = r.filter(F.col("direction") == "down").select(F.col("node").alias("skey"))
    res = keyed.join(up, "tkey", "left_semi").unionByName(keyed.join(down, "skey", "left_semi"))
    return res.select("source_table", "source_column", "target_table", "target_column").distinct()


def column_impact(col_edges: DataFrame, table: str, column: str) -> DataFrame:
    """Downstream half of the column trace (what a column change hits)."""
    return trace_column(col_edges, table, column, ("down",))


def schemas_in_graph(nodes: DataFrame) -> DataFrame:
    """Distinct (catalog, schema) of the 3-part table nodes of a graph."""
    parts = F.split(F.col("id"), r"\.")
    return (nodes.filter((F.col("node_type") == "table") & (F.size(parts) == 3))
            .select(F.element_at(parts, 1).alias("catalog"), F.element_at(parts, 2).alias("schema"))
            .distinct())


def column_edges_for_graph(cl: DataFrame, nodes: DataFrame) -> DataFrame:
    """Column edges of every schema present in a graph, in one
    semi-join (no cap on the number of schemas)."""
    sch = schemas_in_graph(nodes)
    df = cl.filter(F.col("source_table_full_name").isNotNull() & F.col("target_table_full_name").isNotNull()
                   & (F.col("source_table_full_name") != F.col("target_table_full_name"))
                   & F.col("source_column_name").isNotNull() & F.col("target_column_name").isNotNull())
    by_t = df.join(sch.select(F.col("catalog").alias("target_table_catalog"),
                              F.col("schema").alias("target_table_schema")),
                   ["target_table_catalog", "target_table_schema"], "left_semi")
    by_s = df.join(sch.select(F.col("catalog").alias("source_table_catalog"),
                              F.col("schema").alias("source_table_schema")),
                   ["source_table_catalog", "source_table_schema"], "left_semi")
    return (by_t.unionByName(by_s)
            .select(F.col("source_table_full_name").alias("source_table"),
                    F.col("source_column_name").alias("source_column"),
                    F.col("target_table_full_name").alias("target_table"),
                    F.col("target_column_name").alias("target_column")).distinct())
