"""Hub keys: results equal the plain forms, and no task takes a hub whole."""
import random

import pytest
from lineage_data import lineage_rows
from pyspark.sql import functions as F

from lineaweave.operators import graph as G
from lineaweave.operators import reports as RP
from lineaweave.operators import skew as SK
from lineaweave.operators import traverse as TV


@pytest.fixture
def unhinted(spark):
    """No broadcast by size, and small partitions stay apart as large ones would."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _sides(spark):
    """One key with 400 left and 300 right rows, one with a single left row, light ones, nulls."""
    left = ([("hub", f"l{i}") for i in range(400)] + [("one", "x")] + [(f"k{i % 20}", f"l{i}") for i in range(60)]
            + [(None, "n"), ("left only", "x"), ("hub", None)])
    right = ([("hub", f"r{i}") for i in range(300)] + [("one", f"r{i}") for i in range(90)]
             + [(f"k{i % 20}", f"r{i}") for i in range(40)] + [(None, "n"), ("right only", "x")])
    return spark.createDataFrame(left, "k string, a string"), spark.createDataFrame(right, "k string, b string")


@pytest.mark.parametrize("limit", [None, 0])  # 0: a list of hubs too long to broadcast
def test_fanout_join_equals_the_plain_join(unhinted, limit):
    left, right = _sides(unhinted)
    got = SK.fanout_join(left, right, ["k"], heavy=50, limit=limit)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right, "k").collect()), key=str)


def test_fanout_join_deals_a_hub_over_cells(unhinted, monkeypatch):
    left, right = _sides(unhinted)
    plan = SK.fanout_join(left, right, ["k"], heavy=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "_lp" in plan and "_rp" in plan
    hubs = SK.heavy_keys(left, ["k"], 50)
    assert [tuple(r) for r in hubs.rows.collect()] == [("hub", 9)]
    cells = SK.cut(left.dropna(), hubs, ["a"]).where("k = 'hub'").groupBy("part").count()
    assert cells.count() == 9 and cells.agg(F.max("count")).first()[0] < 2 * 400 / 9
    light = SK.fanout_join(left, right, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_lp" not in light  # nothing to cut below the limit


def test_views_with_hubs_equal_the_plain_views(unhinted, monkeypatch):
    entity, table = "entity:JOB:1", "c.s.hub"
    edges = ([(f"c.s.a{i}", entity) for i in range(120)] + [(entity, f"c.s.b{i}") for i in range(80)]
             + [(f"entity:JOB:w{i}", table) for i in range(70)] + [(table, f"entity:JOB:r{i}") for i in range(90)]
             + [("c.s.a1", "c.s.z"), (table, "c.s.z"), (entity, "c.s.a1")])
    edges = unhinted.createDataFrame(edges, "source string, target string")
    plain = [sorted(map(tuple, f(edges).collect())) for f in (G.collapse_to_tables, G.pipeline_deps)]
    assert len(plain[0]) > 120 * 80 - 1 and len(plain[1]) >= 70 * 90
    monkeypatch.setattr(SK, "HEAVY", 25)
    assert [sorted(map(tuple, f(edges).collect())) for f in (G.collapse_to_tables, G.pipeline_deps)] == plain


def _collapsed(edges):
    table = lambda x: not x.startswith("entity:")
    direct = {(a, b) for a, b in edges if table(a) and table(b)}
    via = {(a, c) for a, e in edges if table(a) and not table(e) for x, c in edges if x == e and table(c)}
    return {(a, b) for a, b in direct | via if a != b}


@pytest.mark.parametrize("hashes", [True, False])  # False: every set of entities of a size has the same prints
def test_collapse_is_exact_by_classes(unhinted, monkeypatch, hashes):
    rng = random.Random(5)
    tables, entities = [f"c.s.t{i}" for i in range(30)], [f"entity:JOB:{i}" for i in range(7)]
    edges = {(rng.choice(tables), rng.choice(entities)) for _ in range(60)} | {(rng.choice(entities), rng.choice(tables)) for _ in range(60)}
    edges |= {(rng.choice(tables), rng.choice(tables)) for _ in range(60)} | {(entities[0], entities[1]), (tables[0], tables[0])}
    monkeypatch.setattr(G, "CELL", 3)
    if not hashes:
        monkeypatch.setattr(G.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    got = [tuple(r) for r in G.collapse_to_tables(unhinted.createDataFrame(sorted(edges) * 2, "source string, target string")).collect()]
    assert len(got) == len(set(got)) and set(got) == _collapsed(edges)


def test_collapse_neither_shuffles_nor_compares_the_pairs(unhinted):
    """Three entities over the same 300 sources and 200 targets: one pair of classes stands for the 60,000 pairs, which come
    from a join whose rows meet no later exchange or grouping."""
    edges = [(f"c.s.a{i}", f"entity:JOB:{k}") for i in range(300) for k in range(3)] + [(f"entity:JOB:{k}", f"c.s.b{i}") for i in range(200) for k in range(3)]
    out = G.collapse_to_tables(unhinted.createDataFrame(edges, "source string, target string"))
    assert out.count() == 300 * 200
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.startswith(("Aggregate", "Deduplicate"))
    assert {r[1] for r in G.table_classes(unhinted.createDataFrame([(e, t) for t, e in edges[:900]], "e string, table string")).collect()} == {"c.s.a0"}


@pytest.mark.parametrize("view", [G.collapse_to_tables, RP.export_lineage_rows])
def test_collapsed_pairs_are_dealt_by_their_number(unhinted, monkeypatch, view):
    """One entity over 300 sources and 200 targets is one pair of classes, a row; its 60,000 pairs still come from many tasks,
    and a task opens the list of sources a name at a time."""
    monkeypatch.setattr(G, "PAIRS", 3_000, raising=False)
    monkeypatch.setattr(G, "CELL", 20)
    edges = [(f"c.s.a{i}", "entity:JOB:1") for i in range(300)] + [("entity:JOB:1", f"c.s.b{i}") for i in range(200)]
    out = view(unhinted.createDataFrame(edges + [("c.s.a1", "c.s.z"), ("c.s.a2", "c.s.b2")], "source string, target string"))
    rows = [n for _, n in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 300 * 200 + 1 and len(rows) > 10 and max(rows) < sum(rows) / 4
    opened = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate explode(transform(_sources" in line]
    assert opened and not any("*(" in line for line in opened)


def test_uncovered_pairs_with_a_hub_table(unhinted, monkeypatch):
    monkeypatch.setattr(SK, "HEAVY", 10)
    pairs = unhinted.createDataFrame([("hub", f"t{i}") for i in range(60)] + [("x", "y")], "source string, target string")
    sources = unhinted.createDataFrame([(f"e{i}", "hub") for i in range(40)], "ekey string, table string")
    targets = unhinted.createDataFrame([(f"e{i}", f"t{i}") for i in range(0, 40, 2)], "ekey string, table string")
    got = {tuple(r) for r in G.uncovered_pairs(pairs, sources, targets).collect()}
    covered = {f"t{i}" for i in range(0, 40, 2)}
    assert got == {("hub", f"t{i}") for i in range(60) if f"t{i}" not in covered} | {("x", "y")}


def test_walk_through_hubs_equals_the_plain_walk(unhinted):
    rows = ([(f"c.s.a{i}", "c.s.hub", None, None) for i in range(90)] + [("c.s.hub", f"c.s.b{i}", None, None) for i in range(110)]
            + [("c.s.b1", "c.s.a1", None, None), ("c.s.b2", "c.s.z", None, None), ("c.s.hub", "c.s.hub", None, None)])
    ev = lineage_rows(unhinted, rows)
    seeds = ["c.s.a1", "c.s.z", "c.s.hub", "c.s.b7"]
    plain = sorted(map(tuple, TV.trace_many(ev, seeds).collect()))
    assert sorted(map(tuple, TV.trace_many(ev, seeds, heavy=20).collect())) == plain
    assert len(plain) > 4 * 100


def test_hub_of_the_adjacency_is_read_by_many_tasks(unhinted):
    adj = unhinted.createDataFrame([("hub", f"n{i}") for i in range(400)] + [(f"m{i}", "x") for i in range(100)], "node string, nbr string")
    split, hubs = TV.split_hubs(adj, heavy=25)
    held = split.withColumn("p", F.spark_partition_id()).where("node = 'hub'").groupBy("p").count()
    assert hubs.n == 1 and held.count() > 4 and held.agg(F.max("count")).first()[0] < 200
    step = unhinted.createDataFrame([("s", "hub")], "seed string, node string")
    reached = TV.reach(split, step, hubs=hubs)
    assert reached.count() == 401 and reached.where("hop = 1").count() == 400
