"""Cones of very many seeds as sets of seeds.

``traverse.trace_many`` has a row for each seed and node it reaches, with the
hop. With millions of seeds, whose cones overlap, that is seeds x nodes rows in
every shuffle. Here

- the graph is condensed first: the members of a cycle are in the same cones;
- every component carries the set of seeds whose cone it is in, as the words of
  a bitmap: a row of a round has the number of a word and its ``WORD`` seeds, and
  words without a seed have none. So a row is small, and its size in memory is
  near that in a shuffle, by which Spark deals rows to tasks. The result has the
  words of ``BITS`` seeds each (``bucket``) in one row;
- sets are handed on in topological order, so each is final when it is sent and
  goes over each edge once: rows shuffled are edges x words at most. Up and
  down cones share the rounds (up counts levels from the other end).

A round writes what it hands on, with the level where it is due, and reads only
the edges of its own level and the folders that still hold rows due. Seeds are
numbered by the level of their component, then by name: those that the same nodes
lead to are mostly of a level, and names of a schema stand together, so they
mostly fall into the same words. Hops are not kept; where they matter, or
a hop limit is set, use ``trace_many``."""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize
from .layering import condensed, numbered, ordinal
from .skew import cut, heavy_keys, repeated

#: Seeds of a word, a long.
WORD = 64
#: Seeds of a row of the result.
BITS = 32_768


class Cones(NamedTuple):
    """``sets`` (direction, comp, bucket, words): the seeds in whose cone a component is, as (word, bits) structs,
    ``members`` (comp, node) and ``seeds`` (seed, number): bit number % WORD of word number // WORD."""

    sets: DataFrame
    members: DataFrame
    seeds: DataFrame


def seed_cones(ev: DataFrame, seeds: DataFrame, directions: tuple[str, ...] = ("up", "down"), heavy: int | None = None) -> Cones:
    """The cones of every seed of ``seeds`` (column ``seed``) over the lineage log, without a hop limit.

    A seed is in its own cone, also one that the log lacks. Null and repeated seeds count for nothing. Components of more
    than ``heavy`` edges are cut into parts, each joined on its own."""
    spark = ev.sparkSession
    s, t = F.col("source_table_full_name"), F.col("target_table_full_name")
    pairs = materialize(ev.filter(s.isNotNull() & t.isNotNull()).select(s.alias("source"), t.alias("target")).distinct(), "cone-pairs")
    names = seeds.select("seed").dropna().distinct()
    ends = [pairs.select(F.col("source").alias("id")), pairs.select(F.col("target").alias("id")), names.select(F.col("seed").alias("id"))]
    nodes, edges, count = numbered(reduce(DataFrame.unionByName, ends), pairs, [])
    placed = nodes.join(condensed(nodes, edges, count), "n").select("n", F.col("id").alias("node"), "comp", F.col("layer").cast("int").alias("layer"))
    placed = materialize(placed, "cone-components")
    top = placed.agg(F.max("layer")).first()[0] or 0
    own = names.join(placed, F.col("seed") == F.col("node")).select("seed", "comp", "layer")
    own = materialize(ordinal(own, ["layer", "seed"], "number"), "cone-seeds")

    comp = placed.select("n", "comp", "layer")
    links = edges.join(comp.toDF("s", "cs", "ls"), "s").join(comp.toDF("t", "ct", "lt"), "t").where("cs <> ct")
    links = materialize(links.select("cs", "ls", "ct", "lt").distinct(), "cone-links")
    ways = {"down": ("cs", "ls", "ct", "lt"), "up": ("ct", f"{top} - lt", "cs", f"{top} - ls")}
    out = reduce(DataFrame.unionByName, [
        links.select(F.lit(d).alias("direction"), *[F.expr(c).alias(a) for a, c in zip(("comp", "at", "nbr", "level"), ways[d], strict=True)])
        for d in directions])
    key = ["direction", "comp"]
    hubs = heavy_keys(out, key, heavy)
    step = key
    if hubs.n:
        out, step = cut(out, hubs, ["nbr"]), [*key, "part"]
    # files sorted by level: a round's filter skips the others by their statistics
    out = materialize(out.repartitionByRange("at", "comp").sortWithinPartitions("at"), "cone-out")

    word, bit = F.expr(f"number div {WORD}").alias("word"), F.expr(f"shiftleft(1L, cast(number % {WORD} AS int))")
    merged = F.bit_or("bits").alias("bits")
    first = reduce(DataFrame.unionByName, [
        own.select(F.lit(d).alias("direction"), "comp", F.expr("layer" if d == "down" else f"{top} - layer").alias("level"), word, bit.alias("bits")) for d in directions])
    first = first.groupBy("direction", "comp", "level", "word").agg(merged)
    base = f"{checkpoint_dir(spark).rstrip('/')}/lw-cones-{uuid.uuid4().hex}"
    sent: list[tuple[str, int]] = []  # a folder and the last level that its rows are due at

    def send(df: DataFrame) -> None:
        seen, path = Observation(), f"{base}/{len(sent)}"
        df.observe(seen, F.max("level").alias("last")).write.parquet(path)
        last = seen.get["last"]
        sent.append((path, -1 if last is None else last))

    send(first)
    schema = spark.read.parquet(sent[0][0]).schema
    for level in range(top):
        due = [path for path, last in sent if last >= level]
        if not due:
            break
        now = spark.read.schema(schema).parquet(*due).where(F.col("level") == level).groupBy(*key, "word").agg(merged)
        if hubs.n:
            now = repeated(now, hubs, ["word"])
        handed = now.join(out.where(F.col("at") == level).drop("at"), step).drop("comp").withColumnRenamed("nbr", "comp")
        send(handed.groupBy("direction", "comp", "level", "word").agg(merged))
    rows = spark.read.schema(schema).parquet(*[path for path, _ in sent]).withColumn("bucket", F.expr(f"word div {BITS // WORD}"))
    # one shuffle by bucket serves both groupings
    sets = rows.repartition(*key, "bucket").groupBy(*key, "bucket", "word").agg(merged).groupBy(*key, "bucket").agg(
        F.collect_list(F.struct("word", "bits")).alias("words"))
    return Cones(materialize(sets, "cone-sets"), placed.select("comp", "node"), own.select("seed", "number"))


def seed_counts(cones: Cones) -> DataFrame:
    """(node, direction, n_seeds): of how many seeds a node is an ancestor ('up') or descendant ('down')."""
    count = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"]))
    n = cones.sets.groupBy("direction", "comp").agg(F.sum(count).alias("n_seeds"))
    return n.join(cones.members, "comp").select("node", "direction", "n_seeds")


def _numbers(sets: DataFrame) -> DataFrame:
    """``sets`` with a row for each bit: its seed's ``number``."""
    words = sets.select("direction", "comp", F.inline("words"))
    at = F.explode(F.expr(f"filter(sequence(0, {WORD - 1}), p -> (shiftright(bits, p) & 1L) = 1L)"))
    return words.withColumn("_p", at).select("direction", "comp", (F.col("word") * WORD + F.col("_p")).alias("number"))


def cone_sizes(cones: Cones) -> DataFrame:
    """(seed, direction, n_nodes): the size of every seed's cones, itself included."""
    size = cones.members.groupBy("comp").agg(F.count("*").alias("n"))
    n = _numbers(cones.sets).join(size, "comp").groupBy("number", "direction").agg(F.sum("n").alias("n_nodes"))
    return n.join(cones.seeds, "number").select("seed", "direction", "n_nodes")


def seed_nodes(cones: Cones) -> DataFrame:
    """(seed, node, direction): every pair, as ``trace_many`` without a limit gives them, but for the hop."""
    pairs = _numbers(cones.sets).join(cones.members, "comp").join(cones.seeds, "number")
    return pairs.select("seed", "node", "direction")
