"""Cones as sets of seeds: equal to the walk's rows on random graphs, with cycles, hubs and more seeds than a bitmap holds."""
import random

import pytest
from lineage_data import lineage_rows

from lineaweave.operators import closure as CL
from lineaweave.operators import traverse as TV


def _events(spark, pairs):
    return lineage_rows(spark, [(f"c.s.n{a}" if a is not None else None, f"c.s.n{b}" if b is not None else None, None, None) for a, b in pairs])


def _closure(pairs, seeds):
    out = set()
    for direction in ("up", "down"):
        near = {}
        for a, b in pairs:
            if a is not None and b is not None:
                x, y = (b, a) if direction == "up" else (a, b)
                near.setdefault(x, set()).add(y)
        for seed in seeds:
            seen, todo = {seed}, [seed]
            while todo:
                for y in near.get(todo.pop(), ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            out |= {(f"c.s.n{seed}", f"c.s.n{x}", direction) for x in seen}
    return out


@pytest.mark.parametrize("draw, heavy", [(1, None), (2, 3)])
def test_cones_equal_a_plain_search(spark, draw, heavy):
    rng = random.Random(draw)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(0, k) for k in range(20, 32)] + [(None, 3), (4, None), (5, 5)]
    seeds = [*range(0, 60, 2), 99]  # 99 is not in the log
    frame = spark.createDataFrame([(f"c.s.n{k}",) for k in [*seeds, 2]] + [(None,)], "seed string")
    cones = CL.seed_cones(_events(spark, pairs), frame, heavy=heavy)
    want = _closure(pairs, seeds)
    got = [tuple(r) for r in CL.seed_nodes(cones).collect()]
    assert len(got) == len(want) and set(got) == want
    counts = {(r["node"], r["direction"]): r["n_seeds"] for r in CL.seed_counts(cones).collect()}
    sizes = {(r["seed"], r["direction"]): r["n_nodes"] for r in CL.cone_sizes(cones).collect()}
    assert counts == {(n, d): sum((n, d) == (y, e) for _, y, e in want) for _, n, d in want}
    assert sizes == {(s, d): sum((s, d) == (x, e) for x, _, e in want) for s, _, d in want}


def test_cones_equal_the_walk(spark):
    rng = random.Random(3)
    ev = _events(spark, [(a, a + rng.randrange(1, 6)) for a in range(40)] + [(30, 25), (12, 8)])
    seeds = spark.createDataFrame([(f"c.s.n{k}",) for k in range(0, 45, 3)], "seed string")
    walk = {(r["seed"], r["node"], r["direction"]) for r in TV.trace_many(ev, seeds).collect()}
    assert {tuple(r) for r in CL.seed_nodes(CL.seed_cones(ev, seeds)).collect()} == walk


def test_more_seeds_than_a_bitmap(spark):
    """A chain behind 70,000 sources: rows follow edges and buckets, not pairs of seed and node."""
    n, chain = 70_000, 6
    def ends(a, b):
        return f"concat('c.s.', {a}) AS source_table_full_name", f"concat('c.s.', {b}) AS target_table_full_name"

    fan = spark.range(n).selectExpr(*ends("id", "'x0'"))
    line = spark.range(chain).selectExpr(*ends("'x', id", "'x', id + 1"))
    ev = fan.unionByName(line)
    seeds = spark.range(n).selectExpr("concat('c.s.', id) AS seed")
    cones = CL.seed_cones(ev, seeds, ("down",))
    counts = {r["node"]: r["n_seeds"] for r in CL.seed_counts(cones).where("node LIKE 'c.s.x%'").collect()}
    assert counts == {f"c.s.x{k}": n for k in range(chain + 1)}
    on_chain = cones.sets.join(cones.members.where("node LIKE 'c.s.x%'"), "comp")
    assert on_chain.count() == 3 * (chain + 1)


def test_no_seeds_and_no_events(spark):
    ev, none = _events(spark, [(1, 2)]), spark.createDataFrame([], "seed string")
    assert CL.seed_nodes(CL.seed_cones(ev, none)).count() == 0
    one = spark.createDataFrame([("c.s.n1",)], "seed string")
    assert {tuple(r) for r in CL.seed_nodes(CL.seed_cones(ev.limit(0), one)).collect()} == {("c.s.n1", "c.s.n1", "up"), ("c.s.n1", "c.s.n1", "down")}


def test_a_set_holds_only_words_with_seeds(spark):
    """A seed's own set is one word, whatever the number of seeds, and seeds of a level share words, wherever their names stand."""
    n = 2_000
    fan = spark.range(n).selectExpr("concat('c.s.a', id) AS source_table_full_name", "concat('c.s.', if(id % 2 = 0, 'a', 'b'), 'x', id % 60) AS target_table_full_name")
    seeds = fan.selectExpr("explode(array(source_table_full_name, target_table_full_name)) AS seed")
    cones = CL.seed_cones(fan, seeds)
    held = {(r["node"], r["direction"]): len(r["words"]) for r in cones.sets.join(cones.members, "comp").collect()}
    assert len(held) == 2 * (n + 60) and all(held[f"c.s.a{k}", "up"] <= 2 and held[f"c.s.a{k}", "down"] == 1 for k in range(n))
