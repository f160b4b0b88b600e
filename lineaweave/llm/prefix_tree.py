"""Prefix tree of conversations, built by truncation from the deepest turn up.

A node is a sequence of turns that conversations start with. Every row of the
chained table is one turn of one conversation with the chained 128-bit hash of
all turns up to it, which names the node. Peeling starts at the greatest depth:
conversations that end there become nodes with their counts; their last turn is
stripped, survivors with the same rest are regrouped and merged with the
conversations that end at the new depth, and so on to the root. A node's counts
are complete when its level has been merged, so one pass finds the nodes and
sums up their subtrees.

Equal conversations are one row with a count before anything else. Prefixes
that more than ``WIDTH`` different conversations share are the crown; what hangs
below it falls into subtrees of bounded width, each peeled in one task that
holds two levels at a time. The crown is peeled by Spark, one grouped sum a
level, over one row for each subtree or node, so no prefix, however common, is
gathered in one place."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_batches, row_stream, salted_join, stored

#: Different conversations under a prefix that one task peels.
WIDTH = 256
#: Ids of a node's ending conversations are gathered in blocks of 2**12 possible ids.
ID_BITS = 12
#: Of ``rebuild``: conversations that share a start, and one more than the turns that they may share.
SHARERS, MOST_SHARED = 5, 9

_ROOT = bytes(16)
_EMPTY = hashlib.sha256(b"").hexdigest()
_CHAIN = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()),
                    ("bytes", pa.int64()), ("last", pa.bool_())])
_CHAIN_DDL = "conv_id long, depth int, key binary, parent binary, bytes long, last boolean"
_NODE = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("conv_id", pa.int64()),
                   ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                   ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("top", pa.bool_())])
_NODE_DDL = ("key binary, parent binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, "
             "n_leaves long, saved_tokens long, top boolean")
_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, what, bytes) of every turn: its place from 1 by turn (null first; ties by role, then by the text's
    MD5), the digests of role and text (null: empty) and the text's UTF-8 length. Rows without conv_id are of no
    conversation. Texts stay where they are read."""
    plain = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return plain.select("conv_id", F.row_number().over(order).alias("pos"),
                        F.concat(F.unhex(F.md5(F.col("role").cast("binary"))), F.unhex("digest")).alias("what"), "bytes")


def shared_turns(conv_id="conv_id", most: int = MOST_SHARED):
    """Turns at the start of a conversation that ``rebuild`` takes from another one."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % most).cast("int")


def rebuild(turns: DataFrame, sharers: int = SHARERS, most: int = MOST_SHARED) -> DataFrame:
    """Conversations c that share starts: the first h turns of conversation c - c % ``sharers`` (all if it has fewer, none
    if it is absent), then c's own after its first h; h is a checksum of c below ``most``. A conversation of which
    nothing is left keeps its row in ``conversation_rows`` only."""
    ids = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % sharers).alias("base"),
                                                    shared_turns(most=most).alias("h"))
    heads = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "what", "bytes")
    shared = ids.join(heads, "base").where("pos <= h").select("conv_id", "pos", "what", "bytes")
    own = turns.where(F.col("pos") > shared_turns(most=most)).select("conv_id", (F.col("pos") + most).alias("pos"), "what", "bytes")
    return shared.unionByName(own)


def chained(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Every conversation's path from the root: (conv_id, depth, key, parent, bytes, last), a root row for each of
    ``conversations`` included. Turns count in the order of ``pos``, whatever its gaps."""
    rows = turns.unionByName(conversations.select("conv_id", F.lit(-1).alias("pos"), F.lit(None).cast("binary").alias("what"),
                                                  F.lit(0).cast("long").alias("bytes")))

    def path(stream: Iterator[tuple]) -> Iterator[tuple]:
        held = None
        for conv, _, what, size in stream:
            if what is None:
                if held:
                    yield (*held, True)
                held = (conv, 0, _ROOT, None, 0)
            else:
                yield (*held, False)
                held = (conv, held[1] + 1, hashlib.md5(held[2] + what).digest(), held[2], size)
        if held:
            yield (*held, True)

    def run(batches):
        yield from row_batches(path(row_stream(batches)), _CHAIN)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, _CHAIN_DDL)


class _Node:
    __slots__ = ("key", "parent", "bytes", "conv", "n", "children", "leaves", "saved")

    def __init__(self, key, parent, size):
        self.key, self.parent, self.bytes = key, parent, size
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0

    def merge(self, conv, n, children=0, leaves=0, saved=0):
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved


def peel(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes of the subtrees in ``rows``: (root, depth, key, parent, bytes, conv_id, n), by root and falling depth; n is the
    number of conversations that end in the row, else null. A subtree's top has no parent_conv_id yet."""
    root = depth = None
    level: dict[bytes, _Node] = {}
    below: list[_Node] = []

    def close(at: int) -> Iterator[tuple]:
        for node in level.values():
            node.leaves += not node.children
            node.saved += (node.n - 1) * node.bytes
        for node in below:
            yield row(node, at + 1, level[node.parent].conv, False)

    def row(node: _Node, at: int, parent_conv: int | None, top: bool) -> tuple:
        return node.key, node.parent, at, node.conv, parent_conv, node.n, node.children, node.leaves, node.saved, top

    def stripped() -> dict[bytes, _Node]:
        above: dict[bytes, _Node] = {}
        for node in level.values():
            rest = above.setdefault(node.parent, _Node(node.parent, None, 0))
            rest.merge(node.conv, node.n, 1, node.leaves, node.saved)
        return above

    for r, d, key, parent, size, conv, n in rows:
        if (r, d) != (root, depth):
            if root is not None:
                yield from close(depth)
                if r == root:
                    below, level = list(level.values()), stripped()
                else:
                    for node in level.values():
                        yield row(node, depth, None, True)
                    below, level = [], {}
            root, depth = r, d
        node = level.get(key)
        if node is None:
            node = level[key] = _Node(key, parent, size)
        node.parent, node.bytes = parent, size
        if n is not None:
            node.merge(conv, n)
    if root is not None:
        yield from close(depth)
        for node in level.values():
            yield row(node, depth, None, True)


def prefix_nodes(paths: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each node of the tree of ``paths`` (see ``chained``): key, depth, conv_id, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens. No path: no row."""
    ends = stored(paths.where("last").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")), "ends")
    rows = stored(paths.join(ends.select("conv_id", "n"), "conv_id").withColumn("n", F.expr("if(last, n, null)")), "paths")
    crown = stored(rows.groupBy("key").agg(F.count("*").alias("wide"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
                                           F.first("bytes").alias("bytes")).where(F.col("wide") > width), "crown")
    marked = salted_join(rows, crown.select("key", F.lit(True).alias("shared")), ["key"], "conv_id", "left")
    loose = stored(marked, "marked")
    roots = loose.where("shared IS NULL").groupBy("conv_id").agg(F.min_by("key", "depth").alias("root"))
    sub = loose.where("shared IS NULL").join(roots, "conv_id").select("root", "depth", "key", "parent", "bytes", "conv_id", "n")

    def run(batches):
        yield from row_batches(peel(row_stream(batches)), _NODE)
    peeled = stored(sub.repartition("root").sortWithinPartitions("root", F.desc("depth")).mapInArrow(run, _NODE_DDL), "subtrees")

    tops = peeled.where("top AND parent IS NOT NULL").select(
        F.col("parent").alias("key"), (F.col("depth") - 1).alias("depth"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens")
    none = F.lit(0).cast("long")
    ended = loose.where("shared AND n IS NOT NULL").select("key", "depth", "conv_id", F.col("n").alias("n_convs"), none.alias("n_children"),
                                                           none.alias("n_leaves"), none.alias("saved_tokens"))
    given = stored(_merged(tops.unionByName(ended)), "given")
    levels, up = [], None
    deepest = crown.agg(F.max("depth")).first()[0]
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = given.where(F.col("depth") == depth)
        here = here if up is None else _merged(here.unionByName(up))
        level = stored(here.join(crown.where(F.col("depth") == depth).select("key", "parent", "bytes"), "key").select(
            "key", "parent", "depth", "conv_id", "n_convs", "n_children",
            F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), "level")
        levels.append(level)
        up = level.where("parent IS NOT NULL").select(
            F.col("parent").alias("key"), (F.col("depth") - 1).alias("depth"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"),
            "n_leaves", "saved_tokens")

    keep = ["key", "depth", "conv_id", "parent_conv_id", *_SUMS]
    out = peeled.where("NOT top OR parent IS NULL").select(keep)
    if levels:
        shared = levels[0]
        for level in levels[1:]:
            shared = shared.unionByName(level)
        parents = shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        open_rows = peeled.where("top AND parent IS NOT NULL").drop("parent_conv_id", "top").unionByName(shared)
        out = out.unionByName(salted_join(open_rows, parents, ["parent"], "key", "left").select(keep))
    return out


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in _SUMS])


def end_hashes(paths: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the decimal ids of the conversations that end at a node, rising, joined by commas.
    Ids are joined in blocks first; a node's task sees a row for each block and holds one."""
    blocks = paths.where("last").groupBy("key", F.shiftright("conv_id", ID_BITS).alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        at, sha = None, None
        for key, _, ids in rows:
            if key != at:
                if at is not None:
                    yield at, sha.hexdigest()
                at, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if at is not None:
            yield at, sha.hexdigest()

    def run(batches):
        yield from row_batches(digests(row_stream(batches)), schema)
    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(run, "key binary, ends_sha256 string")


def conversation_tree(conversations: DataFrame, sharers: int | None = None, most: int = MOST_SHARED, width: int = WIDTH) -> DataFrame:
    """The prefix tree of ``conversations`` (conv_id, turn, role, text), first rebuilt to share starts if ``sharers`` is
    given: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by turn, null first, ties by role and the text's MD5; a null role or text is empty; a repeated row is a turn of its own.
    Rows without conv_id are of no conversation; without conversations there is no node. Other columns are not read."""
    turns = stored(turns_of(conversations), "turns")
    ids = turns.select("conv_id").distinct()
    paths = stored(chained(turns if sharers is None else rebuild(turns, sharers, most), ids), "chains")
    nodes = prefix_nodes(paths, width).join(end_hashes(paths), "key", "left")
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                        "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
