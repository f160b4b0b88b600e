"""BFS kernel and traces: cycles, self-loops, hop limit, multi-seed."""
from pyspark.sql import functions as F

from lineaweave.operators import traverse as TV

from lineage_data import lineage_rows


def _chain(spark, n):
    return lineage_rows(spark, [(f"c.s.t{i}", f"c.s.t{i + 1}", None, None) for i in range(n)])


def test_cycle_terminates_with_min_hops(spark):
    ev = lineage_rows(spark, [("c.s.a", "c.s.b", None, None), ("c.s.b", "c.s.c", None, None),
                              ("c.s.c", "c.s.a", None, None), ("c.s.a", "c.s.a", None, None)])
    got = {r.node: r.hop for r in TV.trace(ev, "c.s.a", "down", None).collect()}
    assert got == {"c.s.a": 0, "c.s.b": 1, "c.s.c": 2}


def test_hop_limit_and_truncation(spark):
    ev = _chain(spark, 17)  # t0 -> ... -> t17
    reached = TV.trace_many(ev, ["c.s.t0"], 16)
    assert reached.filter("direction = 'down'").agg(F.max("hop")).first()[0] == 16
    _, meta = TV.trace_rows(ev, reached, 16)
    assert meta.first().truncated is True
    ev16 = _chain(spark, 16)  # exactly 16 deep: the last node has no further events
    _, meta16 = TV.trace_rows(ev16, TV.trace_many(ev16, ["c.s.t0"], 16), 16)
    assert meta16.first().truncated is False


def test_multi_seed_matches_single(spark):
    ev = lineage_rows(spark, [("c.s.a", "c.s.b", None, None), ("c.s.b", "c.s.c", None, None),
                              ("c.s.x", "c.s.b", None, None)])
    many = {(r.seed, r.node, r.direction, r.hop) for r in TV.trace_many(ev, ["c.s.b", "c.s.c"], 16).collect()}
    for seed in ("c.s.b", "c.s.c"):
        one = {(seed, r.node, r.direction, r.hop) for r in TV.trace_many(ev, [seed], 16).collect()}
        assert one == {t for t in many if t[0] == seed}
    assert ("c.s.c", "c.s.a", "up", 2) in many


def test_paths_are_endpoints_not_frontier(spark):
    ev = lineage_rows(spark, [(None, "c.s.a", None, None, "s3://b/x"), ("c.s.a", "c.s.b", None, None)])
    up = {r.node for r in TV.trace(ev, "c.s.b", "up").collect()}
    assert up == {"c.s.b", "c.s.a"}
    g = TV.trace_graph(ev, "c.s.b")
    assert {tuple(r) for r in g.edges.collect()} == {("path:s3://b", "c.s.a"), ("c.s.a", "c.s.b")}
    status = {r.id: r.lineage_status for r in g.nodes.collect()}
    assert status == {"path:s3://b": "root", "c.s.a": "connected", "c.s.b": "leaf"}


def test_column_trace_case_insensitive(spark):
    ce = spark.createDataFrame([("c.s.a", "X", "c.s.b", "y"), ("c.s.b", "Y", "c.s.c", "z"),
                                ("c.s.q", "k", "c.s.r", "k")],
                               "source_table string, source_column string, target_table string, target_column string")
    down = {tuple(r) for r in TV.trace_column(ce, "c.s.a", "x").collect()}
    assert down == {("c.s.a", "X", "c.s.b", "y"), ("c.s.b", "Y", "c.s.c", "z")}
    assert TV.column_impact(ce, "c.s.c", "z").count() == 0


def test_focus_entities_transparent(spark):
    from lineaweave.operators import graph as G
    e = "entity:JOB:1"
    edges = spark.createDataFrame([("a", e), ("x", e), (e, "b"), ("b", "c"), ("c", "d"), ("q", "r")],
                                  "source string, target string")
    nodes = spark.createDataFrame([(n, "entity" if n.startswith("entity:") else "table")
                                   for n in ["a", "x", "b", "c", "d", "q", "r", e]], "id string, node_type string")
    g = G.Graph(nodes, edges)
    one = {r.id for r in TV.focus(g, "b", 1).nodes.collect()}
    assert one == {"a", "x", "b", "c", e}
    assert {r.id for r in TV.focus(g, "b", 0).nodes.collect()} == {"a", "x", "b", "c", "d", e}
    assert {r.id for r in TV.focus(g, "c", 1).nodes.collect()} == {"b", "c", "d"}
