"""Dependency layering of graphs and lineage-map placement.

Layer = longest path from a source, cycles condensed to one node; members
of one component share a layer, and the result does not depend on edge order.
Many maps are layered at once: a node is a (map, id) pair with a number of its
own, and every round works on all maps.

- Peeling keeps in-degree counters by deltas: a round joins the nodes just
  removed with their out-edges, adds the hits to the counters of the nodes that
  were hit before and are not free yet, and writes both kinds of row once. Nodes
  that no round reaches sit on or behind a cycle.
- Their components: the smallest label that reaches a node and the smallest that
  it reaches are propagated in one loop; equal ones are a component, and edges
  between nodes with different pairs go. Where ``STEPS`` rounds don't end it, paths
  are long, and the graph is contracted first: nodes whose removal adds no edges
  (in-degree x out-degree at most their sum, such as those of a plain cycle or
  chain) are taken out, an independent set a round, and their neighbours are
  linked, so that rounds grow with the logarithm of a cycle's length. Contracted
  nodes then join the component that both a predecessor and a successor are in.
- The condensed graph is peeled, each component after its layered predecessors.

Every round is one write, whose row counts come with it; only these counts
reach the driver."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize
from . import graph as G


def _clean_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return (edges.filter(F.col("source") != F.col("target"))
            .join(ids.select(F.col("id").alias("source")), "source", "left_semi")
            .join(ids.select(F.col("id").alias("target")), "target", "left_semi")
            .select("source", "target").distinct())


def split_orphans(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(connected ids, orphan ids) — orphans have no incident edge
    (self-loops and edges leaving the node set ignored)."""
    e = _clean_edges(nodes, edges)
    ends = e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).distinct()
    ids = nodes.select("id").distinct()
    return ids.join(ends, "id", "left_semi"), ids.join(ends, "id", "left_anti")


#: Rounds of label propagation after which a graph is contracted, if it can be.
STEPS = 16


class _Log:
    """Rows appended round by round to folders of one schema, read together."""

    def __init__(self, spark: SparkSession, schema: str, tag: str):
        self.spark, self.schema = spark, schema
        self.folder, self.rounds = f"{checkpoint_dir(spark).rstrip('/')}/lw-{tag}-{uuid.uuid4().hex}", []

    def append(self, df: DataFrame, **counts) -> tuple[DataFrame, dict]:
        """Write a round; the rows read back, and the aggregates in ``counts`` over them."""
        seen, path = Observation(), f"{self.folder}/{len(self.rounds)}"
        if counts:
            df = df.observe(seen, *[c.alias(k) for k, c in counts.items()])
        df.write.parquet(path)
        self.rounds.append(path)
        return self.spark.read.schema(self.schema).parquet(path), {k: v or 0 for k, v in seen.get.items()} if counts else {}

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.rounds)


def _peel(nodes: DataFrame, edges: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """Layers (n, layer) of the nodes of ``nodes`` (n, base) that are on or behind no cycle of ``edges`` (s, t), and how many they
    are. Node n comes no earlier than its base."""
    spark = nodes.sparkSession
    degrees = edges.groupBy("t").agg(F.count("*").alias("deg"))
    out = materialize(edges.join(degrees, "t").join(nodes.select(F.col("n").alias("t"), "base"), "t"), f"{tag}-out")
    log = _Log(spark, "n long, deg long, hit long, base int, layer int, free boolean", f"{tag}-round")
    none = F.lit(0).cast("long")
    step, counts = log.append(nodes.join(edges.select(F.col("t").alias("n")), "n", "left_anti").select(
        "n", none.alias("deg"), none.alias("hit"), "base", F.col("base").alias("layer"), F.lit(True).alias("free")), n=F.count(F.lit(1)))
    total = counts["n"]
    while counts["n"]:
        hits = out.join(step.where("free").select(F.col("n").alias("s"), (F.col("layer") + 1).alias("layer")), "s").select(
            F.col("t").alias("n"), "deg", F.lit(1).cast("long").alias("hit"), "base", "layer")
        merged = hits.unionByName(step.where("NOT free").drop("free")).groupBy("n").agg(
            F.max("deg").alias("deg"), F.sum("hit").alias("hit"), F.max("base").alias("base"), F.max("layer").alias("layer"))
        step, counts = log.append(merged.select("n", "deg", "hit", "base", F.greatest("layer", "base").alias("layer"),
                                                (F.col("hit") == F.col("deg")).alias("free")), n=F.count_if("free"))
        total += counts["n"]
    return log.all().where("free").select("n", "layer"), total


def _contract(edges: DataFrame) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Take out nodes that cost no edges, while an eighth of the nodes are such (one round at least). Returns the edges left and, for
    each round, the removed nodes and their (n, nb, side) neighbours."""
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while True:
        ends = edges.select(F.col("s").alias("n"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
            edges.select(F.col("t").alias("n"), F.lit(1).alias("i"), F.lit(0).alias("o")))
        degrees = ends.groupBy("n").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        seen = Observation()
        # the lesser draw of two neighbours goes first; the node's number decides between equal draws
        marked = degrees.select("n", F.struct(F.xxhash64("n", F.lit(len(rounds))), "n").alias("draw"), (F.expr("i * o <= i + o")).alias("cheap"))
        marked = marked.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("cheap").alias("cheap"))
        cheap = materialize(marked.where("cheap").drop("cheap"), "scc-cheap")
        counts = seen.get
        if not counts["cheap"] or rounds and counts["cheap"] * 8 < counts["n"]:
            return edges, rounds
        both = edges.join(cheap.select(F.col("n").alias("s"), F.col("draw").alias("ds")), "s").join(
            cheap.select(F.col("n").alias("t"), F.col("draw").alias("dt")), "t")
        losers = both.select(F.when(F.col("ds") < F.col("dt"), F.col("t")).otherwise(F.col("s")).alias("n"))
        gone = materialize(cheap.select("n").join(losers, "n", "left_anti"), "scc-gone")
        ins = edges.join(gone.select(F.col("n").alias("t")), "t").select(F.col("t").alias("n"), F.col("s").alias("nb"), F.lit(0).alias("side"))
        outs = edges.join(gone.select(F.col("n").alias("s")), "s").select(F.col("s").alias("n"), F.col("t").alias("nb"), F.lit(1).alias("side"))
        cut = materialize(ins.unionByName(outs), "scc-cut")
        rounds.append((gone, cut))
        links = cut.where("side = 0").select("n", F.col("nb").alias("s")).join(cut.where("side = 1").select("n", F.col("nb").alias("t")), "n")
        kept = edges.join(gone.select(F.col("n").alias("s")), "s", "left_anti").join(gone.select(F.col("n").alias("t")), "t", "left_anti")
        edges = materialize(kept.select("s", "t").unionByName(links.where("s <> t").select("s", "t")).distinct(), "scc-edges")


def _labels(edges: DataFrame, steps: int | None) -> DataFrame | None:
    """(n, f, b) of every end of ``edges``: the smallest labels that reach it and that it reaches; None if it takes more than ``steps`` rounds."""
    ways = materialize(edges.select(F.col("s").alias("a"), F.col("t").alias("b"), F.lit(0).alias("side")).unionByName(
        edges.select(F.col("t").alias("a"), F.col("s").alias("b"), F.lit(1).alias("side"))), "scc-ways")
    log = _Log(edges.sparkSession, "n long, side int, label long", "scc-label")
    step, counts = log.append(ways.groupBy(F.col("b").alias("n"), "side").agg(F.min("a").alias("x")).select(
        "n", "side", F.least("n", "x").alias("label")), n=F.count(F.lit(1)))
    # an end without edges on one side keeps its own label there
    log.append(ways.select(F.col("a").alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), F.col("a").alias("label")).distinct())
    while counts["n"]:
        if steps is not None and len(log.rounds) > steps:
            return None
        sent = ways.join(step.withColumnRenamed("n", "a"), ["a", "side"]).select(F.col("b").alias("n"), "side", "label", F.lit(None).cast("long").alias("old"))
        merged = sent.unionByName(log.all().withColumn("old", F.col("label"))).groupBy("n", "side").agg(
            F.min("label").alias("label"), F.min("old").alias("old"))
        step, counts = log.append(merged.where("label < old").select("n", "side", "label"), n=F.count(F.lit(1)))
    return log.all().groupBy("n").agg(F.min(F.when(F.col("side") == 0, F.col("label"))).alias("f"),
                                      F.min(F.when(F.col("side") == 1, F.col("label"))).alias("b"))


def _components(edges: DataFrame) -> DataFrame:
    """(n, comp): the strongly connected component of every end of ``edges`` (s, t)."""
    found = _Log(edges.sparkSession, "n long, comp long", "scc-comp")
    removed: list[tuple[DataFrame, DataFrame]] = []
    stuck = False
    while True:
        labels = _labels(edges, None if stuck else STEPS)
        if labels is None:
            before = edges.select(F.col("s").alias("n")).unionByName(edges.select(F.col("t").alias("n"))).distinct()
            edges, rounds = _contract(edges)
            stuck = not rounds
            # ends that lost their last edge by contraction are components of their own
            after = edges.select(F.col("s").alias("n")).unionByName(edges.select(F.col("t").alias("n")))
            bare = before.join(after, "n", "left_anti")
            for gone, _ in rounds:
                bare = bare.join(gone, "n", "left_anti")
            found.append(bare.select("n", F.col("n").alias("comp")))
            removed += rounds
            continue
        stuck = False
        labels = materialize(labels, "scc-pairs")
        pair = F.struct("f", "b")
        rest = labels.where("f <> b").select("n", pair.alias("pair"))
        same = edges.join(rest.select(F.col("n").alias("s"), F.col("pair").alias("x")), "s").join(
            rest.select(F.col("n").alias("t"), F.col("pair").alias("y")), "t").where("x = y").select("s", "t")
        seen = Observation()
        edges = materialize(same.observe(seen, F.count(F.lit(1)).alias("n")), "scc-same")
        ends = edges.select(F.col("s").alias("n")).unionByName(edges.select(F.col("t").alias("n")))
        alone = rest.select("n").join(ends, "n", "left_anti") if seen.get["n"] else rest.select("n")
        found.append(labels.where("f = b").select("n", F.col("f").alias("comp")).unionByName(alone.select("n", F.col("n").alias("comp"))))
        if not seen.get["n"]:
            break
    for gone, cut in reversed(removed):
        near = cut.join(found.all().withColumnRenamed("n", "nb"), "nb").groupBy("n", "comp").agg(F.count_distinct("side").alias("sides")).where(
            "sides = 2").groupBy("n").agg(F.min("comp").alias("comp"))
        found.append(gone.join(near, "n", "left").select("n", F.coalesce("comp", "n").alias("comp")))
    return found.all()


def condensed(nodes: DataFrame, edges: DataFrame, count: int) -> DataFrame:
    """(n, comp, layer) of all ``count`` nodes of ``nodes`` (n) over ``edges`` (s, t); a component is named by one of its nodes."""
    layers, free = _peel(nodes.select("n", F.lit(0).alias("base")), edges, "peel")
    single = layers.select("n", F.col("n").alias("comp"), "layer")
    if free == count:
        return single
    # what follows an unlayered node is unlayered; each has an unlayered predecessor, so these edges have all of them as ends
    inner = materialize(edges.join(layers.select(F.col("n").alias("s")), "s", "left_anti").select("s", "t"), "layer-inner")
    comp = _components(inner)
    between = materialize(inner.join(comp.select(F.col("n").alias("s"), F.col("comp").alias("cs")), "s").join(
        comp.select(F.col("n").alias("t"), F.col("comp").alias("ct")), "t").where("cs <> ct").select(
        F.col("cs").alias("s"), F.col("ct").alias("t")).distinct(), "layer-between")
    base = edges.join(layers.select(F.col("n").alias("s"), "layer"), "s").join(
        comp.select(F.col("n").alias("t"), "comp"), "t").groupBy("comp").agg((F.max("layer") + 1).alias("base"))
    comps = materialize(comp.select("comp").distinct().join(base, "comp", "left").select(
        F.col("comp").alias("n"), F.coalesce("base", F.lit(0)).alias("base")), "layer-comps")
    placed, _ = _peel(comps, between, "condensed")
    return single.unionByName(comp.join(placed.select(F.col("n").alias("comp"), "layer"), "comp").select("n", "comp", "layer"))


def numbered(nodes: DataFrame, edges: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Distinct nodes (key, id, n) and edges (s, t) between them by number, without self-loops; the number of nodes."""
    seen = Observation()
    ids = nodes.select(*key, "id").distinct().observe(seen, F.count(F.lit(1)).alias("n"))
    ids = materialize(ids.withColumn("n", F.monotonically_increasing_id()), "layer-ids")
    pairs = edges.where("source <> target").select(*key, "source", "target").distinct()
    ends = pairs.join(ids.select(*key, F.col("id").alias("source"), F.col("n").alias("s")), [*key, "source"]).join(
        ids.select(*key, F.col("id").alias("target"), F.col("n").alias("t")), [*key, "target"])
    return ids, materialize(ends.select("s", "t"), "layer-edges"), seen.get["n"]


def strongly_connected(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): the component of every id of ``ids`` over ``edges`` among them, named by its smallest id."""
    nodes, pairs, _ = numbered(ids, edges, [])
    comp = materialize(nodes.join(_components(pairs), "n", "left").select("id", F.coalesce("comp", "n").alias("c")), "scc-ids")
    return comp.join(comp.groupBy("c").agg(F.min("id").alias("comp")), "c").select("id", "comp")


def layer_maps(members: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """D11 and D12 for many maps in the same rounds: (key, id, layer, orphan) of every member (key, id) over the maps' edges
    (key, source, target). An orphan has no edge in its map and no layer."""
    ids, pairs, count = numbered(members, edges, key)
    ends = pairs.select(F.explode(F.array("s", "t")).alias("n")).distinct().withColumn("linked", F.lit(True))
    placed = ids.join(condensed(ids, pairs, count), "n").join(ends, "n", "left")
    return placed.select(*key, "id", F.when(F.col("linked"), F.col("layer")).cast("int").alias("layer"), F.col("linked").isNull().alias("orphan"))


def layer_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, layer) for connected nodes, (id, NULL) for orphans, plus
    an ``orphan`` flag. Longest path from sources; cycles condensed."""
    return layer_maps(nodes, edges, [])


def schema_of(node_id: F.Column) -> F.Column:
    parts = F.split(node_id, r"\.")
    return F.when(F.size(parts) == 3, F.element_at(parts, 2)).otherwise(F.lit(""))


def schema_maps(g: G.Graph, k: int | None = None) -> DataFrame:
    """Per-schema map membership (schema, id): the schema's table
    nodes, their neighbours (undirected), and every neighbour of those
    neighbours that are entities. Schemas whose subgraph has no edge are
    skipped; with ``k``, the ``k`` schemas with most tables are kept (ties by name).
    Membership is keyed by bare schema name, as the report does."""
    member, _, ids = _schema_maps(g, k)
    return member.join(ids.select("n", "id"), "n").select("schema", "id", "rank")


def placed_schema_maps(g: G.Graph, k: int | None = None) -> DataFrame:
    """P6 over all schemas: (schema, rank, id, layer, slot, grid_row, grid_col) of every member of every schema's map, all maps
    layered and placed in the same rounds, with nodes by number until they are placed."""
    member, edges, ids = _schema_maps(g, k)
    ranks = member.select("schema", "rank").distinct()
    member = member.select("schema", F.col("n").alias("id"))
    layers = materialize(layer_maps(member, edges.toDF("schema", "source", "target"), ["schema"]), "map-layers")
    placed = _placed(layers, ["schema"], ["id"]).withColumnRenamed("id", "n")
    return placed.join(ids.select("n", "id"), "n").join(ranks, "schema").drop("n")


def _label_key() -> F.Column:
    return F.lower(F.coalesce(F.col("name"), F.col("id")))


def _schema_maps(g: G.Graph, k: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (schema, n, rank) and edges (schema, s, t) of the schemas' maps, and the nodes (id, n, entity) by number. Numbers
    are in the order in which maps place nodes. Each step is written once, since the next ones read it several times."""
    named = g.nodes if "name" in g.nodes.columns else g.nodes.withColumn("name", F.lit(None).cast("string"))
    nodes = materialize(named.select("id", "node_type", "name"), "map-nodes")
    ids = ordinal(nodes.groupBy("id").agg(F.min(_label_key()).alias("_k")), ["_k", "id"], "n").select(
        "id", "n", F.col("id").startswith("entity:").alias("entity"))
    e = materialize(g.edges.join(ids.select(F.col("id").alias("source"), F.col("n").alias("s"), F.col("entity").alias("es")), "source")
                    .join(ids.select(F.col("id").alias("target"), F.col("n").alias("t"), F.col("entity").alias("et")), "target")
                    .select("s", "t", "es", "et"), "map-edges")
    und = e.select(F.col("s").alias("a"), F.col("t").alias("n"), F.col("et").alias("entity")) \
        .unionByName(e.select(F.col("t").alias("a"), F.col("s").alias("n"), F.col("es").alias("entity"))).distinct()
    tables = materialize(nodes.filter(F.col("node_type") == "table").join(ids.select("id", "n"), "id")
                         .select("n", schema_of(F.col("id")).alias("schema")), "map-tables")
    nb = tables.withColumnRenamed("n", "a").join(und, "a").select("schema", "n", "entity").distinct()
    ent_nb = nb.filter("entity").select("schema", F.col("n").alias("a")).join(und, "a").select("schema", "n")
    member = materialize(tables.select("schema", "n").unionByName(nb.select("schema", "n")).unionByName(ent_nb).distinct(), "map-members")
    sub_edges = materialize(e.join(member.select("schema", F.col("n").alias("s")), "s")
                            .join(member.select("schema", F.col("n").alias("t")), ["schema", "t"]).select("schema", "s", "t"), "map-links")
    has_edges = sub_edges.select("schema").distinct()
    sizes = tables.groupBy("schema").agg(F.count("*").alias("n_tables")).join(has_edges, "schema", "left_semi")
    if k is not None:
        sizes = sizes.orderBy(F.desc("n_tables"), F.asc("schema")).limit(k)
    ranked = ordinal(sizes.withColumn("_n", -F.col("n_tables")), ["_n", "schema"], "rank")
    ranked = ranked.select("schema", (F.col("rank") + 1).cast("int").alias("rank"))
    return member.join(ranked, "schema"), sub_edges, ids


def ordinal(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Global 0-based position of each row under ``order``: rows are dealt into sorted ranges, a row's number within its range
    is added to the rows of the ranges before. One count for each range reaches the driver."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ordinal").withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    before, starts = 0, []
    for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        starts.append((r["_range"], before))
        before += r["n"]
    offsets = spark.createDataFrame(starts, "_range long, _before long")
    return ranged.join(F.broadcast(offsets), "_range").select(*df.columns, (F.col("_at") + F.col("_before")).alias(name))


def place_maps(nodes: DataFrame, layers: DataFrame, key: list[str]) -> DataFrame:
    """D14 for many maps: placement of each node (key, id) on its map. Connected nodes get (layer, slot) with slots ordered by
    lower(name or id) within a layer; orphans get a grid (row, col) with max(max_layer + 1, 4) per row."""
    names = nodes.select("id", _label_key().alias("_k")).dropDuplicates(["id"])
    return _placed(layers.join(names, "id"), key, ["_k", "id"])


def _placed(layers: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Placement with the nodes of a layer, and the orphans, under ``order``."""
    group = F.coalesce("layer", F.lit(-1))
    ranked = materialize(ordinal(layers.withColumn("_group", group), [*key, "_group", *order]), "placed")
    starts = ranked.groupBy(*key, "_group").agg(F.min("idx").alias("_s"))
    wide = ranked.groupBy(*key).agg(F.greatest(F.coalesce(F.max("layer") + 1, F.lit(0)), F.lit(4)).alias("_wide"))
    at = ranked.join(starts, [*key, "_group"]).withColumn("_at", F.col("idx") - F.col("_s"))
    at = at.join(wide, key) if key else at.withColumn("_wide", F.lit(wide.first()["_wide"]))
    orphan = F.col("orphan")
    return at.select(*key, "id", "layer", F.when(~orphan, F.col("_at")).cast("int").alias("slot"),
                     F.when(orphan, F.floor(F.col("_at") / F.col("_wide"))).cast("int").alias("grid_row"),
                     F.when(orphan, F.col("_at") % F.col("_wide")).cast("int").alias("grid_col"))


def map_slots(nodes: DataFrame, layers: DataFrame) -> DataFrame:
    """Placement of each node of one lineage map, see ``place_maps``."""
    return place_maps(nodes, layers, [])
