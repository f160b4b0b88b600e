"""Exact Jaccard join of word shingles with signature trees.

Equal sets are one node of the link graph from the start. The rest is found
in three steps, none of which loses a link:

1. Blocks. Shingles have one order, frequent ones last. Linked sets share one
   of the first ``prefix_size`` shingles. So the sets that share such a
   shingle form a block; sets of different blocks are never compared.
2. Trees. Over the sets of a block stands a signature tree: a node holds the
   OR of its sets' bitmaps, the range of their sizes and the most shingles
   that share a bit. Two trees, or a tree and itself, are traversed together;
   a pair of nodes is left out if the common bits can't make the overlap that
   their sizes ask for, and a pair of sets if its own bitmaps can't. A block of
   up to ``LEAF`` sets is a single leaf; most are, and are gone through side
   by side in one pass over the sorted rows. Larger ones are cut into chunks,
   and pairs of chunks are traversed in parallel.
3. Verification. Sets that are candidates of each other, or share a large
   block, are brought together once in a home (in chunks, if it is large),
   where a tree over their whole sets gives the exact links; links within
   what is known to be connected are not looked for. Pairs of candidates from
   different homes or chunks are verified by a join of their sets.

The order comes from a count of all texts, of which a bounded list of the most
frequent shingles is kept. It decides how much work is done, never what is
linked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, ragged, slices, stored
from .components import components

#: Words of a shingle and least similarity in percent.
WORDS, PERCENT = 5, 80
#: Sets in the leaf of a tree, and children of an inner node.
LEAF, FAN = 32, 8
#: Sets and shingles that a chunk of a block has, about.
CHUNK, CHUNK_SHINGLES = 2048, 2_000_000
#: Shingles that so many texts have are frequent; of these the first so many by count rank last.
FREQUENT_LEAST, FREQUENT_MAX = 8, 200_000
#: Shingles that a task counts at a time; those that it meets once in a time are left out of the count.
_COUNT = 4_000_000
#: Ids of this many bytes at most are broadcast to pick texts; beyond it the texts are shuffled.
BROADCAST_BYTES = 32 << 20
#: Words whose hashes a task keeps at a time.
_KEEP = 300_000
_BITS = (256, 8192)


# ---------------------------------------------------------------- sets

def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits."""
    x = x ^ x >> np.uint64(30)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sets of hashed shingles, sorted, of texts."""

    def __init__(self, words: int):
        self.words, self.hashes = words, _Hashes()
        self.factors = _mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes: A to Z and ASCII white space alone are changed and split at
        own = (text or "").encode().lower().split()
        h = np.fromiter(map(self.hashes.__getitem__, own), np.uint64, len(own))
        if len(self.hashes) > _KEEP:
            self.hashes.clear()
        if not own:
            return h
        if len(own) < self.words:
            return _mixed(np.array([(h * self.factors[:len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))]))
        n = len(own) - self.words + 1
        total = np.zeros(n, np.uint64)
        for k, f in enumerate(self.factors):
            total += h[k:k + n] * f
        return np.unique(_mixed(total))


def prefix_size(n, percent: int):
    """Of the first so many of n ordered shingles a linked set has one."""
    return n - -(-percent * n // 100) + 1


def needed(a, b, percent: int):
    """Common shingles that sets of sizes a and b need to be linked."""
    return -(-percent * (a + b) // (100 + percent))


def bitmap_bits(n, percent: int):
    """Length of the bitmap of a prefix: a power of two, eight bits for each shingle if it can."""
    wanted = np.maximum(8 * np.asarray(prefix_size(n, percent)), 1)
    return np.clip(1 << np.ceil(np.log2(wanted)).astype(np.int64), *_BITS)


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of 64-bit words for each set, with the bits that its shingles' low bits name."""
    flags = np.zeros((len(sets), bits), bool)
    flags[np.repeat(np.arange(len(sets)), [len(s) for s in sets]),
          (np.concatenate([np.zeros(0, np.uint64), *sets]) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps made as short as ``words`` words, by OR of their halves."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] | rows[:, half:]
    return rows


def ones(rows: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rows).sum(axis=1, dtype=np.int64)


# ---------------------------------------------------------------- trees

class SignatureTree:
    """Bitmaps, sizes and bounds of sets, and of nodes over them, level by level.

    Set i has ``size[i]`` shingles, of which the bitmap shows all but
    ``rest[i]``; ``slack[i]`` of those share a bit with another one. Then two
    sets have at most (common bits) + (smaller slack) + (larger rest) shingles
    in common. A node has the OR of its bitmaps, the range of its sizes and
    the largest slack and rest, so the same holds for any sets below two
    nodes. ``group``: sets of equal group need no comparison."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, shown: np.ndarray, group: np.ndarray):
        # near sizes and, of these, alike bitmaps stand together
        self.order = np.lexsort((bits[:, 0], group, size))
        bits, size, shown, group = (x[self.order] for x in (bits, size, shown, group))
        self.levels = [{"bits": bits, "low": size, "high": size, "slack": shown - ones(bits), "rest": size - shown,
                        "g0": group, "g1": group}]
        fan = LEAF
        while len(self.levels[-1]["low"]) > FAN:
            below = self.levels[-1]
            at = np.arange(0, len(below["low"]), fan)
            up = {"bits": np.bitwise_or.reduceat(below["bits"], at, axis=0)}
            up |= {k: np.minimum.reduceat(below[k], at) for k in ("low", "g0")}
            up |= {k: np.maximum.reduceat(below[k], at) for k in ("high", "slack", "rest", "g1")}
            self.levels.append(up)
            fan = FAN

    def fan(self, level: int) -> int:
        """Children of a node of a level."""
        return LEAF if level == 1 else FAN


def _possible(a: dict, b: dict, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes may have a linked pair of sets below them."""
    ok = (100 * a["high"][i] >= percent * b["low"][j]) & (100 * b["high"][j] >= percent * a["low"][i])
    ok &= ~((a["g0"][i] == a["g1"][i]) & (b["g0"][j] == b["g1"][j]) & (a["g0"][i] == b["g0"][j]))
    left = np.flatnonzero(ok)
    step = max(1, (1 << 20) // a["bits"].shape[1])
    for k in range(0, len(left), step):
        own = left[k:k + step]
        x, y = i[own], j[own]
        most = ones(a["bits"][x] & b["bits"][y]) + np.minimum(a["slack"][x], b["slack"][y]) + np.maximum(a["rest"][x], b["rest"][y])
        ok[own] = most >= needed(a["low"][x], b["low"][y], percent)
    return ok


def dual_traversal(a: SignatureTree, b: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets (places in the given arrays) that may be linked, a few leaves at a time.

    With the same tree twice each pair comes once."""
    same, top = a is b, max(len(a.levels), len(b.levels)) - 1

    def nodes(tree: SignatureTree, level: int) -> dict:
        return tree.levels[min(level, len(tree.levels) - 1)]

    def children(tree: SignatureTree, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of nodes; of a tree that is not as high a node is its own child."""
        if level > len(tree.levels) - 1:
            return at, np.ones(len(at), np.int64)
        fan = tree.fan(level)
        first = at * fan
        return first, np.minimum(fan, len(tree.levels[level - 1]["low"]) - first)

    def expand(level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(i), 256):
            x, y = i[k:k + 256], j[k:k + 256]
            keep = _possible(nodes(a, level), nodes(b, level), x, y, percent)
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            if level == 0:
                yield a.order[x], b.order[y]
                continue
            (fx, nx), (fy, ny) = children(a, level, x), children(b, level, y)
            total = nx * ny
            owner = np.repeat(np.arange(len(x)), total)
            k_in = np.arange(len(owner)) - np.repeat(np.cumsum(total) - total, total)
            cx, cy = fx[owner] + k_in // ny[owner], fy[owner] + k_in % ny[owner]
            if same:
                inner = cx < cy if level == 1 else cx <= cy
                cx, cy = cx[inner], cy[inner]
            if level == 1:
                keep = _possible(nodes(a, 0), nodes(b, 0), cx, cy, percent)
                yield a.order[cx[keep]], b.order[cy[keep]]
            else:
                yield from expand(level - 1, cx, cy)

    n, m = len(nodes(a, top)["low"]), len(nodes(b, top)["low"])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(m), indexing="ij"))
    if same:
        keep = i < j if top == 0 else i <= j
        i, j = i[keep], j[keep]
    yield from expand(top, i, j)


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of sets, exact, as many as connect what links connect."""
    if len(sets) < 2:
        return []
    size = np.array([len(s) for s in sets])
    bits = int(np.clip(1 << int(np.ceil(np.log2(8 * size.max()))), 256, 16384))
    tree = SignatureTree(bitmaps(sets, bits), size, size, np.arange(len(sets)))
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x
    links = []
    for i, j in dual_traversal(tree, tree, percent):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                    root[max(p, q)] = min(p, q)
                    links.append((x, y))
    return links


def _by_length(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Words of each bitmap, and by that number the places of its rows and the rows."""
    values = column.to_pylist()
    words = np.array([len(v) // 8 for v in values], np.int64)
    out = {}
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        out[w] = (at, np.frombuffer(b"".join([values[k] for k in at.tolist()]), np.uint64).reshape(len(at), w))
    return words, out


# ---------------------------------------------------------------- steps as table functions

def _leaves(percent: int):
    """Rows (token, node, n, bits) sorted by token, blocks of up to LEAF rows: candidate pairs (a, b), and of
    how many blocks (c)."""
    def pairs(table: pa.Table) -> pa.RecordBatch:
        token, node, n = (table[c].to_numpy() for c in ("token", "node", "n"))
        words, rows = _by_length(table["bits"].combine_chunks())
        found = []
        for d in range(1, LEAF):
            i = np.flatnonzero(token[:-d] == token[d:]) if d < len(token) else np.zeros(0, np.int64)
            if not len(i):
                break
            j = i + d
            near = (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i]) & (node[i] != node[j])
            i, j = i[near], j[near]
            shorter = np.minimum(words[i], words[j])
            for w in np.unique(shorter).tolist():
                x, y = i[shorter == w], j[shorter == w]
                bits = [_pick(rows, words, k, w) for k in (x, y)]
                shown = [prefix_size(n[k], percent) for k in (x, y)]
                slack = np.minimum(*(s - ones(b) for s, b in zip(shown, bits, strict=True)))
                most = ones(bits[0] & bits[1]) + slack + np.maximum(n[x] - shown[0], n[y] - shown[1])
                ok = most >= needed(n[x], n[y], percent)
                found.append(np.stack([np.minimum(node[x], node[y])[ok], np.maximum(node[x], node[y])[ok]]))
        both, c = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(c)], names=["a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows:  # the last block may go on
                token = held["token"].to_numpy()
                last = int(np.flatnonzero(token != token[-1])[-1]) + 1 if (token != token[-1]).any() else 0
                if last:
                    yield pairs(held.slice(0, last))
                    held = held.slice(last)
        if held is not None and held.num_rows:
            yield pairs(held)
    return run


def _pick(rows: dict, words: np.ndarray, k: np.ndarray, w: int) -> np.ndarray:
    """Bitmaps of rows k, folded to w words."""
    out = np.empty((len(k), w), np.uint64)
    for own, (at, bits) in rows.items():
        mine = np.flatnonzero(words[k] == own)
        if len(mine):
            out[mine] = folded(bits[np.searchsorted(at, k[mine])], w)
    return out


def _chunk_pair(percent: int, pairs: bool):
    """Rows of two chunks (node, n, comp, chunk, bits) of a large block: candidate pairs (a, b) of
    different components, or only the sets in any such pair (node), which are never more than the rows."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, n, comp, chunk = (table[c].to_numpy() for c in ("node", "n", "comp", "chunk"))
        words, rows = _by_length(table["bits"].combine_chunks())
        sides = np.unique(chunk)
        trees: dict[tuple[int, int, int], tuple[np.ndarray, SignatureTree]] = {}
        if pairs:
            token = table["token"][0].as_py() if table.num_rows else None
            prefix = [np.asarray(x.values) for x in table["prefix"]]
            shared = [frozenset(x) for x in table["shared"].to_pylist()]
            rest = n - prefix_size(n, percent)

        def plausible(i: int, j: int) -> bool:
            """Whether this is the pair's first large block, and their prefixes have enough in common."""
            if min(shared[i] & shared[j]) != token:
                return False
            common = len(np.intersect1d(prefix[i], prefix[j], assume_unique=True))
            return common + max(rest[i], rest[j]) >= needed(n[i], n[j], percent)

        def tree(side: int, own: int, w: int) -> tuple[np.ndarray, SignatureTree] | None:
            if (side, own, w) not in trees:
                at = np.flatnonzero((chunk == side) & (words == own))
                trees[side, own, w] = (at, SignatureTree(_pick(rows, words, at, w), n[at], prefix_size(n[at], percent), comp[at])) if len(at) else None
            return trees[side, own, w]
        found = []
        lengths = np.unique(words).tolist()
        a, b = int(sides[0]), int(sides[-1])
        for p in lengths:
            for q in lengths:  # linked sets' bitmaps differ in length by a factor of two at most
                if not p / 2 <= q <= 2 * p or a == b and q < p:
                    continue
                one, two = tree(a, p, min(p, q)), tree(b, q, min(p, q))
                if one and two:
                    for i, j in dual_traversal(one[1], two[1], percent):
                        x, y = one[0][i], two[0][j]
                        keep = comp[x] != comp[y]
                        if pairs:
                            keep[keep] = [plausible(i, j) for i, j in zip(x[keep].tolist(), y[keep].tolist(), strict=True)]
                        found.append(np.stack([np.minimum(node[x], node[y])[keep], np.maximum(node[x], node[y])[keep]]))
                        if not pairs:
                            found = [np.unique(np.concatenate([f.ravel() for f in found]))]
        if not pairs:
            return pa.table({"node": np.concatenate([np.zeros(0, np.int64), *found])})
        both = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)
        return pa.table({"a": both[0], "b": both[1]})
    return run


def _home(percent: int):
    """The sets (node, shingles) of a chunk of a home: exact links (a, b)."""
    def run(table: pa.Table) -> pa.Table:
        by_node = dict(zip(table["node"].to_pylist(), (np.asarray(x.values).view(np.uint64) for x in table["shingles"]), strict=True))
        nodes, sets = list(by_node), list(by_node.values())
        links = spanning_links(sets, percent)
        return pa.table({"a": pa.array([nodes[i] for i, _ in links], pa.int64()), "b": pa.array([nodes[j] for _, j in links], pa.int64())})
    return run


# ---------------------------------------------------------------- the join

def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that are frequent in the texts, sorted. They order the shingles, whatever they are."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        t, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(t[c > 1].view(np.int64)), pa.array(c[c > 1])], names=["t", "c"])

    def run(batches):
        shingler, held = Shingler(words), []
        for batch in slices(batches):
            held += [shingler(t) for t in batch["text"].to_pylist()]
            if sum(map(len, held)) > _COUNT:
                yield counted(held)
                held = []
        yield counted(held)
    counts = docs.select("text").mapInArrow(run, "t long, c long").groupBy("t").agg(F.sum("c").alias("c"))
    top = counts.where(F.col("c") >= FREQUENT_LEAST).orderBy(F.desc("c"), "t").limit(FREQUENT_MAX).select("t").collect()
    return np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))


def _signatures(docs: DataFrame, words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Per row: id, n, sig (of the set; null if it is empty), the prefix's rare and frequent shingles, and its bitmap."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        shingler, last = Shingler(words), held.value
        for batch in slices(batches):
            n, sig, rare, common, bits = [], [], [], [], []
            for text in batch["text"].to_pylist():
                s = shingler(text)
                is_common = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(len(s), bool)
                size = int(prefix_size(len(s), percent)) if len(s) else 0
                r, c = s[~is_common], s[is_common]
                r, c = r[:size], c[:max(0, size - len(r))]
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                rare.append(r.view(np.int64))
                common.append(c.view(np.int64))
                bits.append(bitmaps([np.concatenate([r, c])], int(bitmap_bits(max(1, len(s)), percent)))[0].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(n, pa.int64()), pa.array(sig, pa.binary()), ragged(rare, pa.int64()),
                 ragged(common, pa.int64()), pa.array(bits, pa.binary())], names=["id", "n", "sig", "rare", "common", "bits"])
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n long, sig binary, rare array<long>, common array<long>, bits binary")


def _small(rows: DataFrame, bytes_each: int) -> DataFrame:
    """``rows``, to be broadcast if their number bounds them to ``BROADCAST_BYTES``; else the join shuffles."""
    return F.broadcast(rows) if bytes_each * rows.count() <= BROADCAST_BYTES else rows


def _sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """The sets (node, home, chunk, shingles) of members (node, doc, sig, home, chunk), from the texts again."""
    ids = _small(members.select(F.col("doc").alias("d")).distinct(), 16)
    texts = docs.join(ids, F.col("id").eqNullSafe(F.col("d")), "left_semi")

    def run(batches):
        shingler = Shingler(words)
        for batch in slices(batches):
            sets = [shingler(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 ragged([s.view(np.int64) for s in sets], pa.int64())], names=["sig", "shingles"])
    of_texts = texts.mapInArrow(run, "sig binary, shingles array<long>")
    return of_texts.join(_small(members.select("node", "sig", "home", "chunk"), 64), "sig").drop("sig")


def _shown(n: str, percent: int):
    """``prefix_size`` and ``needed`` as columns: the shingles beyond the prefix of a set of size n."""
    return F.ceil(F.lit(percent) * F.col(n) / 100) - 1


def _enough(common, percent: int):
    """Whether sets of sizes na and nb may be linked with so many common shingles in their prefixes."""
    least = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    return common + F.greatest(_shown("na", percent), _shown("nb", percent)) >= least


def _counted(pairs: DataFrame, nodes: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share enough blocks: c small ones, and at most all large ones of either."""
    shared = large.groupBy("node").agg(F.count("*").alias("shared"))
    counts = nodes.select("node", "n").join(shared, "node", "left").select("node", "n", F.coalesce("shared", F.lit(0)).alias("g"))
    for side in ("a", "b"):
        pairs = pairs.join(counts.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("g").alias(f"g{side}")), side)
    return pairs.where(_enough(F.col("c") + F.least("ga", "gb"), percent)).select("a", "b")


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes have enough shingles in common."""
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    prefixes = nodes.join(_small(wanted, 16), "node", "left_semi").select("node", "n", F.concat("rare", "common").alias("p"))
    for side in ("a", "b"):
        pairs = pairs.join(prefixes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("p").alias(f"p{side}")), side)
    return pairs.where(_enough(F.size(F.array_intersect("pa", "pb")), percent)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked."""
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    sets = sets.join(_small(wanted, 16), "node", "left_semi")
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = F.size("sa") + F.size("sb") - common
    return pairs.join(one, "a").join(two, "b").where(100 * common >= percent * both).select("a", "b").distinct()


def _chunked(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, node, n ...) with ``chunk`` and ``chunks`` of their key, by a hash of the node."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("c"), F.sum("n").alias("total"))
    chunks = F.ceil(F.greatest(F.col("c") / CHUNK, F.col("total") / CHUNK_SHINGLES)).cast("int")
    sized = rows.join(sizes.select(key, chunks.alias("chunks")), key)
    return sized.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int"))


def _crossed(rows: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """Every pair of chunks of large blocks (token, node, n, comp, bits; for pairs also the prefix and
    the large blocks that the set shares) through ``_chunk_pair``."""
    parts = _chunked(rows, "token").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return parts.select("token", "node", "n", "comp", "chunk", "bits", *(["prefix", "shared"] if pairs else []), F.least("chunk", "other").alias("p"),
                        F.greatest("chunk", "other").alias("q")).groupBy("token", "p", "q").applyInArrow(
        _chunk_pair(percent, pairs), "a long, b long" if pairs else "node long")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles`` and
    ``component_id``, the smallest id that is reachable by links.

    Words are what ASCII white space separates, with A to Z lower-cased; a
    document's set is that of its shingles of ``words`` words, or of all its
    words if they are fewer. Documents are linked if 100 * (common shingles)
    >= ``percent`` * (shingles of either). A null or empty text has no
    shingles and is its own component. Repeated rows are linked like any equal
    texts; null ids are smallest only among themselves. Other columns are not
    read."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    full = stored(_signatures(given, words, percent, _frequent(given, words)), "signatures")
    nodes = stored(full.where("sig IS NOT NULL").groupBy("sig").agg(
        F.min("id").alias("doc"), F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("common").alias("common"),
        F.first("bits").alias("bits")).withColumn("node", F.monotonically_increasing_id()), "sets")
    signed = stored(full.select("id", "n", "sig"), "rows")
    drop_stored(full)

    # blocks: (token, node) of the shingles that two sets or more have first. Rare ones are dealt once by token, for the
    # sums and the join; frequent ones, which few tasks would get, are summed before they are dealt.
    rare = nodes.select(F.explode("rare").alias("token"), "node").repartition("token")
    common = nodes.select(F.explode("common").alias("token"), "node")
    blocks = [rows.join(rows.groupBy("token").agg(F.count("*").alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi"))
                        .where("lo <> hi").select("token", "c"), "token") for rows in (rare, common)]
    blocks = stored(blocks[0].unionByName(blocks[1]), "blocks")
    marks = nodes.select("node", "n", "bits")

    leaves = blocks.where(F.col("c") <= LEAF).join(marks, "node").select("token", "node", "n", "bits")
    near = leaves.repartition("token").sortWithinPartitions("token").mapInArrow(
        _leaves(percent), "a long, b long, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))
    large = blocks.where(F.col("c") > LEAF)
    near = stored(_counted(near, nodes, large, percent), "near")
    # of large blocks only the sets that have a candidate at all go on
    alone = large.join(marks, "node").withColumn("comp", F.col("node"))
    active = stored(_crossed(alone, percent, False).distinct(), "active")
    large = stored(large.join(active, "node", "left_semi"), "large-blocks")
    drop_stored(blocks)
    anchors = stored(large.groupBy("node").agg(F.max(F.struct("c", "token")).getField("token").alias("token"),
                                               F.count("*").alias("shared")), "anchors")
    first = anchors.groupBy("token").agg(F.min("node").alias("b"))
    homes = components(near.unionAll(anchors.join(first, "token").select(F.col("node").alias("a"), "b")))
    # an anchor that no other set has leaves its set alone at home
    homes = homes.unionAll(anchors.join(homes, "node", "left_anti").select("node", F.col("node").alias("comp")))

    members = stored(_chunked(homes.withColumnRenamed("comp", "home").join(nodes.select("node", "n", "doc", "sig"), "node"), "home"), "homes")
    sets = stored(_sets(given, members, words), "shingle-sets")
    links = stored(sets.groupBy("home", "chunk").applyInArrow(_home(percent), "a long, b long"), "links")

    # homes of several chunks: one set of each chunk, the one with most of the frequent shingles, meets those of the others
    rest = members.where("chunks > 1").join(anchors.select("node", "shared"), "node").select("node", "home", "chunk", "shared")
    found = [links]
    before = None
    while (met := rest.count()) and (before is None or met < before):
        before = met
        pivots = rest.groupBy("home", "chunk").agg(F.max(F.struct("shared", "node")).getField("node").alias("node"))
        again = stored(_chunked(pivots.drop("chunk").join(nodes.select("node", "n"), "node"), "home"), "pivots")
        met_again = sets.drop("home", "chunk").join(_small(again.select("node", "home", "chunk"), 32), "node")
        found.append(stored(met_again.groupBy("home", "chunk").applyInArrow(_home(percent), "a long, b long"), "links"))
        rest = again.where("chunks > 1").join(rest.select("node", "shared"), "node").select("node", "home", "chunk", "shared")

    # what no chunk has had together: candidates across homes and chunks, if they are not connected yet
    linked = stored(components(_union(found)), "connected")
    state = stored(members.select("node", "home", "chunk").join(linked, "node", "left").select(
        "node", F.coalesce("comp", "node").alias("comp"), "home", "chunk"), "state")
    of_large = large.join(state.select("node", "comp"), "node")
    kinds = of_large.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    own = large.groupBy("node").agg(F.collect_list("token").alias("shared"))  # of the node's prefix
    whole = nodes.select("node", "n", "bits", F.concat("rare", "common").alias("prefix"))
    crossed = _crossed(of_large.join(kinds, "token").join(own, "node").join(whole, "node"), percent, True)
    pairs = near.unionAll(crossed).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(state.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("comp", "home", "chunk"))), side)
    open_pairs = stored(pairs.where("comp_a <> comp_b AND NOT (home_a = home_b AND chunk_a = chunk_b)").select("a", "b"), "open-pairs")
    open_pairs = stored(_plausible(open_pairs, nodes, percent), "plausible")
    found.append(stored(_verified(open_pairs, sets, percent), "links"))
    drop_stored(sets)

    classes = components(_union(found))
    least = classes.join(nodes.select("node", "doc"), "node").groupBy("comp").agg(F.min("doc").alias("least"))
    of_set = nodes.select("sig", "node", "doc").join(classes, "node", "left").join(least, "comp", "left").select(
        "sig", F.coalesce("least", "doc").alias("component"))
    return signed.select("id", "n", "sig").join(of_set, "sig", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is that of their
    component: one document of each. Repeated rows are one document. Rows
    without an id stay if any of them is in a component of such rows."""
    kept = jaccard_classes(docs, id_col, **kw).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(
        F.col(id_col).alias("_kept")).distinct()
    out = docs.join(kept, docs[id_col].eqNullSafe(kept["_kept"]), "left_semi")
    again = docs.groupBy(F.col(id_col).alias("_again")).agg(F.count("*").alias("n")).where("n > 1").select("_again")
    if not again.limit(1).count():
        return out
    many = out.join(again, docs[id_col].eqNullSafe(again["_again"]), "left_semi").dropDuplicates()
    return out.join(again, docs[id_col].eqNullSafe(again["_again"]), "left_anti").unionByName(many)
