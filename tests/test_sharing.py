"""Sharing overlay on a graph: nodes and badges."""
from lineaweave.operators import sharing as SH


def _inputs(spark):
    nodes = spark.createDataFrame([("lake.raw.a", "table"), ("lake.raw.b", "table"), ("far.in.c", "table"), ("far.in.d", "table"),
                                   ("entity:JOB:1", "entity")], "id string, node_type string")
    so = spark.createDataFrame(
        [("lake.raw.a", "s1", "x.a"), ("lake.raw.a", "s2", None), ("lake.raw.b", "s1", "w.b"), ("lake.raw.b", "quiet", ""),
         ("far.in.c", "quiet", None), ("lake.raw.elsewhere", "s3", "y.z")], "full_name string, share_name string, shared_as string")
    priv = spark.createDataFrame(
        [("s1", "r1", "SELECT"), ("s1", "r2", "SELECT"), ("s2", "r2", "SELECT"), ("s2", "r2", "SELECT"), ("s2", "r9", "USAGE"),
         ("s3", "r3", "SELECT")], "share_name string, recipient_name string, privilege_type string")
    fc = spark.createDataFrame([("far", "acme", "aws", "eu-1", "in1,in2"), ("other", "late", "gcp", None, "z")],
                               "catalog_name string, provider_name string, cloud string, region string, share_names string")
    return nodes, so, fc, priv


def test_overlay_nodes_are_those_in_view(spark):
    got = {r.id: (r.sharing_kind, r.label, r.sub) for r in SH.overlay_nodes(*_inputs(spark)).collect()}
    assert got == {"sharing:share:s1": ("share", "s1", "as w.b"), "sharing:share:s2": ("share", "s2", None),
                   "sharing:share:quiet": ("share", "quiet", None), "sharing:recipient:r1": ("recipient", "r1", None),
                   "sharing:recipient:r2": ("recipient", "r2", None), "sharing:provider:acme": ("provider", "acme", "aws eu-1")}


def test_every_overlay_edge_ends_in_a_node(spark):
    nodes, so, fc, priv = _inputs(spark)
    ids = {r.id for r in nodes.collect()} | {r.id for r in SH.overlay_nodes(nodes, so, fc, priv).collect()}
    edges = [tuple(r) for r in SH.overlay_out(nodes, so, priv).unionByName(SH.overlay_in(nodes, fc)).collect()]
    assert edges and all(e in ids for pair in edges for e in pair)


def test_badges_count_shares_and_recipients(spark):
    got = {r.id: (r.n_shares, r.n_recipients, r.shown, r.in_provider, r.in_shares) for r in SH.overlay_badges(*_inputs(spark)).collect()}
    assert got == {"lake.raw.a": (2, 2, 2, None, None), "lake.raw.b": (2, 2, 2, None, None),
                   "far.in.c": (1, 0, 1, "acme", "in1,in2"), "far.in.d": (None, None, None, "acme", "in1,in2")}
