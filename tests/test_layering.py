"""Dependency layering (D11, D12, D14) against a brute-force condensation."""
import random

from pyspark.sql import functions as F

from lineaweave.operators import layering as LY


def _frames(spark, ids, edges):
    return (spark.createDataFrame([(i, i) for i in ids], "id string, name string"),
            spark.createDataFrame(edges, "source string, target string"))


def _expected(ids, edges):
    """id -> (layer, orphan): longest path over the strongly connected components."""
    out = {i: {t for s, t in edges if s == i and t != i and t in ids} for i in ids}
    reach = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for t in out[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        reach[i] = seen
    home = {i: min(j for j in reach[i] if i in reach[j]) for i in ids}
    before = {h: {home[s] for s in ids for t in out[s] if home[t] == h and home[s] != h} for h in home.values()}

    def layer(h):
        return max((layer(p) + 1 for p in before[h]), default=0)
    touched = {i for s in ids if out[s] for i in (s, *out[s])}
    return {i: (layer(home[i]), False) if i in touched else (None, True) for i in ids}


def _parts():
    """Disjoint graphs layered in one run: random DAGs, and cycles in several places."""
    r = random.Random(11)
    ids, edges = [], []
    for k in range(4):
        names = [f"dag{k}-{j:02}" for j in range(12)]
        ids += names
        edges += [(names[a], names[b]) for a in range(12) for b in range(a + 1, 12) if r.random() < 0.18]
    shapes = {
        "tail": "st tu uv vt vw wx",       # a cycle behind a chain, and a chain behind the cycle
        "eight": "ab bc ca cd de ec ef",   # two cycles that share a node
        "pair": "pq qp rp rs sr",          # one cycle feeds another
        "loop": "kk kl lm km",             # a self-loop counts for nothing
    }
    for name, text in shapes.items():
        own = [(f"{name}-{e[0]}", f"{name}-{e[1]}") for e in text.split()]
        edges += own
        ids += sorted({i for e in own for i in e})
    edges += [("dag0-00", "not a node"), ("alone-2", "alone-2"), ("pair-p", "pair-q")]
    return [*ids, "alone-1", "alone-2"], edges


def test_layers_equal_brute_force(spark):
    ids, edges = _parts()
    got = {r.id: (r.layer, r.orphan) for r in LY.layer_nodes(*_frames(spark, ids, edges)).collect()}
    assert got == _expected(ids, edges)
    assert len({got[f"eight-{c}"] for c in "abcde"}) == 1 and got["eight-f"][0] == 1


def test_rounds_grow_with_the_log_of_a_cycles_length(spark, monkeypatch):
    monkeypatch.setattr(LY, "STEPS", 4)
    contract, rounds = LY._contract, []
    monkeypatch.setattr(LY, "_contract", lambda e: (out := contract(e), rounds.append(len(out[1])))[0])
    taken = []
    for n in (16, 128):
        names = [f"c{k:04}" for k in range(n)]
        both = [(names[k], names[(k + 1) % n]) for k in range(n)] + [("in", names[0]), (names[3], "out"), ("out", "past")]
        got = {r.id: (r.layer, r.orphan) for r in LY.layer_nodes(*_frames(spark, [*names, "in", "out", "past"], both)).collect()}
        assert got == {**dict.fromkeys(names, (1, False)), "in": (0, False), "out": (2, False), "past": (3, False)}
        taken.append(sum(rounds))
        rounds.clear()
    assert taken[1] <= taken[0] + 3 * 4  # eight times as long: a few rounds more


def test_contracted_graphs_have_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(LY, "STEPS", 2)
    ids, edges = _parts()
    nodes, pairs = _frames(spark, ids, edges)
    want = _expected(ids, edges)
    got = {r.id: (r.layer, r.orphan) for r in LY.layer_nodes(nodes, pairs).collect()}
    assert got == want


def test_maps_are_layered_and_placed_as_each_alone(spark):
    r = random.Random(5)
    rows, edges = [], []
    for m in "abc":
        ids = [f"{m}{k}" for k in range(8)] + ["shared"]
        rows += [(m, i) for i in ids]
        edges += [(m, *r.sample(ids, 2)) for _ in range(7)]
    members, links = spark.createDataFrame(rows, "schema string, id string"), spark.createDataFrame(edges, "schema string, source string, target string")
    layers = LY.layer_maps(members, links, ["schema"])
    names = members.select("id", F.col("id").alias("name")).distinct()
    placed = {(x["schema"], x["id"]): tuple(x)[2:] for x in LY.place_maps(names, layers, ["schema"]).collect()}
    got = {(x["schema"], x["id"]): (x["layer"], x["orphan"]) for x in layers.collect()}
    for m in "abc":
        ids = [i for k, i in rows if k == m]
        own = _expected(ids, [(s, t) for k, s, t in edges if k == m])
        assert {i: got[m, i] for i in ids} == own
        wide = max([4, *(v[0] + 1 for v in own.values() if not v[1])])
        for i, (layer, orphan) in own.items():
            at = sorted(j for j, v in own.items() if v == (layer, orphan)).index(i)
            assert placed[m, i] == ((None, None, at // wide, at % wide) if orphan else (layer, at, None, None))
    plan = LY.place_maps(names, layers, ["schema"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "SinglePartition" not in plan


def test_slots_follow_names_within_a_layer(spark):
    nodes, edges = _frames(spark, ["Zinc", "amber", "sink", "spare2", "spare1"], [("amber", "sink"), ("Zinc", "sink")])
    slots = {r.id: tuple(r)[1:] for r in LY.map_slots(nodes, LY.layer_nodes(nodes, edges)).collect()}
    assert slots == {"amber": (0, 0, None, None), "Zinc": (0, 1, None, None), "sink": (1, 0, None, None),
                     "spare1": (None, None, 0, 0), "spare2": (None, None, 0, 1)}


def test_schema_maps_return_every_schema_with_its_rank(spark):
    from lineaweave.operators import graph as G
    import __spark_entry__ as E
    ids = [f"analytics.s{k:02}.t{j}" for k in range(30) for j in range(2 + k % 3)]
    edges = [(f"analytics.s{k:02}.t0", f"analytics.s{k:02}.t1") for k in range(30) if k != 7]
    nodes = spark.createDataFrame([(i, "table") for i in ids], "id string, node_type string")
    graph = G.Graph(nodes, spark.createDataFrame(edges, "source string, target string"))
    maps = LY.schema_maps(graph)
    order = sorted((k for k in range(30) if k != 7), key=lambda k: (-(2 + k % 3), k))
    want = {(f"s{k:02}", f"analytics.s{k:02}.t{j}", n + 1) for n, k in enumerate(order) for j in range(2 + k % 3)}
    assert {(r["schema"], r["id"], r["rank"]) for r in maps.collect()} == want
    assert {(r["schema"], r["id"], r["rank"]) for r in LY.schema_maps(graph, 12).collect()} == {w for w in want if w[2] <= 12}
    assert "Window" not in maps._jdf.queryExecution().toString()
    assert "schema_maps_all" in E.queries() and "LIMIT" not in E.oracle_sql()["schema_maps_all"]


def test_schema_maps_join_by_number_in_display_order(spark):
    from lineaweave.operators import graph as G
    names = {"c.s.t0": "Zinc", "c.s.t1": "amber", "c.s.t2": "lone", "c.s.t3": "Lone2", "entity:JOB:1": None}
    nodes = spark.createDataFrame([(i, "entity" if i.startswith("entity") else "table", n) for i, n in names.items()], "id string, node_type string, name string")
    edges = spark.createDataFrame([("c.s.t0", "entity:JOB:1"), ("c.s.t1", "entity:JOB:1")], "source string, target string")
    links = LY._schema_maps(G.Graph(nodes, edges), None)[1]
    assert links.dtypes == [("schema", "string"), ("s", "bigint"), ("t", "bigint")]
    got = {r["id"]: (r["layer"], r["slot"], r["grid_row"], r["grid_col"]) for r in LY.placed_schema_maps(G.Graph(nodes, edges)).collect()}
    assert got == {"c.s.t1": (0, 0, None, None), "c.s.t0": (0, 1, None, None), "entity:JOB:1": (1, 0, None, None),
                   "c.s.t2": (None, None, 0, 0), "c.s.t3": (None, None, 0, 1)}
