"""Repair of conversation structure by dynamic programming over a grammar.

Every row of a conversation is one symbol: its role's initial and its fault. A
conversation is a string of symbols, and conversations with equal strings have
equal cheapest edits. The distinct strings are compressed by Re-Pair rules:
Spark counts adjacent pairs over all strings, the most frequent ones become
symbols of their own, and the strings are rewritten, round by round. For each rule the
edits' costs are a min-plus matrix over the states of the legal order
``(s?(ua)+)?`` (rows: state before, columns: state after); the matrix of a rule is
the product of its two symbols' matrices, so it is made once, bottom-up, for all
conversations. An entry also holds its audit, the edits' initials, as a rope that
shares the parts' ropes. What the rules leave of a string is a short vector-matrix
product.

Ties go to the audit that is first in ASCII order. Two audits of equal cost over
the same rows never are one the other's start (each row has one edit, and inserts
cost), so the first difference decides before and after concatenation alike."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_batches, row_stream, salted_join, stored

#: Rounds of pair counting, and rules that a round adds at most. They bound the grammar, not the strings.
ROUNDS, RULES_A_ROUND = 16, 64
#: A string of more conversations than this counts as frequent when edits are handed back.
FREQUENT = 1000
#: Costs of a new role, a deletion, an insertion and a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: What a row's place must follow: states are 0 start, 1 after s, 2 after u, 3 after a.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: Symbols: X must go; s, u, a and o (another initial) are sound, upper-case ones truncated.
SYMBOLS = "XsuaoSUAO"
_FIRST_RULE = 0xE000
_SPACE = r"\x20\x09-\x0D"
_PIECE = 64

Rope = tuple
Matrix = list


def rope(left: Rope | str, right: Rope | str) -> Rope | str:
    """Concatenation that shares its parts; short ones are plain strings."""
    if not left or not right:
        return left or right
    if isinstance(left, str) and isinstance(right, str) and len(left) + len(right) <= _PIECE:
        return left + right
    return left, right


def pieces(r: Rope | str) -> Iterator[str]:
    """The strings of a rope in order."""
    stack = [r]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += (top[1], top[0])


def before(a: Rope | str, b: Rope | str) -> bool:
    """Whether rope ``a`` comes before ``b`` in ASCII order."""
    if a is b:
        return False
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    for x, y in zip((c for p in pieces(a) for c in p), (c for p in pieces(b) for c in p), strict=False):
        if x != y:
            return x < y
    return False


def better(new: tuple | None, old: tuple | None) -> tuple | None:
    """The cheaper of two entries (cost, audit); of equal ones the first audit. None is no way."""
    if new is None or old is None:
        return old if new is None else new
    if new[0] != old[0]:
        return new if new[0] < old[0] else old
    return new if before(new[1], old[1]) else old


def symbol_matrix(symbol: str) -> Matrix:
    """Cheapest edits of one row, inserts before it included, from each state to each."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    role, extra = symbol.lower(), TRUNCATED * (symbol.isupper() and symbol != "X")
    for start in range(4):
        at = start
        for inserts in range(3):
            cost, audit = INSERT * inserts, "I" * inserts
            ways = [(at, DELETE, "D")]
            if symbol != "X":
                ways.append((_NEXT[at], REROLE + extra, "R"))
                to = {"s": _SYSTEM if at == _START else None, "u": _USER if at != _USER else None,
                      "a": _ASSISTANT if at == _USER else None}.get(role)
                if to is not None:
                    ways.append((to, extra, "K"))
            for to, price, letter in ways:
                out[start][to] = better((cost + price, audit + letter), out[start][to])
            at = _NEXT[at]
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product of two matrices (rows of ``a`` may be fewer than four)."""
    out = []
    for row in a:
        best = [None] * 4
        for mid, x in enumerate(row):
            if x is not None:
                for to, y in enumerate(b[mid]):
                    if y is not None and (best[to] is None or x[0] + y[0] <= best[to][0]):
                        best[to] = better((x[0] + y[0], rope(x[1], y[1])), best[to])
        out.append(best)
    return out


def rule_matrices(rules: list[str]) -> dict[str, Matrix]:
    """The matrix of every symbol and rule; rule k is a pair of earlier symbols."""
    out = {s: symbol_matrix(s) for s in SYMBOLS}
    for k, (a, b) in enumerate(rules):
        out[chr(_FIRST_RULE + k)] = product(out[a], out[b])
    return out


def cheapest(packed: str, matrices: dict[str, Matrix]) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a string of symbols and rules."""
    state: Matrix = [[(0, ""), None, None, None]]
    for symbol in packed:
        state = product(state, matrices[symbol])
    best = None
    for end, inserts in ((_START, 0), (_SYSTEM, 2), (_USER, 1), (_ASSISTANT, 0)):
        if state[0][end] is not None:
            cost, audit = state[0][end]
            best = better((cost + INSERT * inserts, rope(audit, "I" * inserts)), best)
    return best[0], "".join(pieces(best[1]))


def replay(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The repaired rows, ``role:text`` each."""
    at = _START
    for letter in audit:
        if letter == "I":
            at = _NEXT[at]
            yield f"{_ROLE[at]}:"
            continue
        role, text = next(rows)
        if letter == "R":
            at = _NEXT[at]
            yield f"{_ROLE[at]}:{text}"
        elif letter == "K":
            at = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}[role[:1]]
            yield f"{role}:{text}"


def grammar(strings: DataFrame, rounds: int = ROUNDS, a_round: int = RULES_A_ROUND) -> tuple[list[str], DataFrame]:
    """Re-Pair rules for ``strings`` (symbols, n) and the strings rewritten by them (symbols, packed). A round makes rules
    of the pairs that stand twice or more, most frequent first, ``a_round`` at most; it ends when there are none."""
    rules: list[str] = []
    state = strings.select("symbols", F.col("symbols").alias("packed"), "n")
    for _ in range(rounds):
        state = stored(state, "strings")
        top = state.mapInArrow(_count_pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        new = [r["pair"] for r in top.orderBy(F.desc("n"), "pair").limit(a_round).collect()]
        if not new:
            break
        pairs = [(pair, chr(_FIRST_RULE + len(rules) + k)) for k, pair in enumerate(new)]
        rules += new

        def rewrite(batches, pairs=pairs):
            for batch in batches:
                out = []
                for s in batch["packed"].to_pylist():
                    for pair, rule in pairs:
                        if len(s) < 2:
                            break
                        s = s.replace(pair, rule)
                    out.append(s)
                yield pa.RecordBatch.from_arrays([batch["symbols"], pa.array(out, pa.string()), batch["n"]], names=["symbols", "packed", "n"])
        state = state.mapInArrow(rewrite, "symbols string, packed string, n long")
    return rules, state


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for s, n in zip(batch["packed"].to_pylist(), batch["n"].to_pylist(), strict=True):
            for pair in zip(s, s[1:], strict=False):
                found[pair] += n
        yield pa.RecordBatch.from_arrays([pa.array(["".join(p) for p in found], pa.string()), pa.array(found.values(), pa.int64())],
                                         names=["pair", "n"])


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults, chosen by a checksum of conversation and turn: rows that are gone,
    emptied, without sentence ends, repeated or turned into a user's. A null counts as one space."""
    def or_space(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"),
                                (F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20).alias("hit"))
    return rows.where("hit <> 0").select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _plain(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(" "))
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
                       F.md5(text.cast("binary")).alias("digest"))


def _order() -> list[Column]:
    return [F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]


def structure(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Each conversation's faults and its string: conv_id, gaps, blank, duplicate, truncated, illegal, symbols. ``ids`` may
    name conversations without rows. Texts are judged where they are read; a digest of theirs travels."""
    last = F.right(F.expr(r"trim(TRAILING ' \t\n\u000b\f\r' FROM text)"), F.lit(1))
    light = _plain(rows).select(
        "conv_id", "turn", "role", "digest", F.lit(True).alias("there"), (~F.col("text").rlike(f"[^{_SPACE}]")).alias("is_blank"),
        (~last.isin(".", "!", "?")).alias("is_cut"))
    none = ids.select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in light.dtypes[1:4]], F.lit(False).alias("there"),
                      F.lit(False).alias("is_blank"), F.lit(False).alias("is_cut"))
    by = Window.partitionBy("conv_id", "there").orderBy(*_order())
    same = Window.partitionBy("conv_id", "there", "role", "digest").orderBy("pos")
    initial = F.left("role", F.lit(1))
    placed = light.unionByName(none).select("*", F.row_number().over(by).alias("pos"), F.lag("turn").over(by).alias("turn_before"),
                                            F.concat(F.lag(initial).over(by), initial).alias("step"), initial.alias("initial"))
    judged = placed.withColumn("is_copy", F.row_number().over(same) > 1)
    dup, cut = F.expr("NOT is_blank AND is_copy"), F.expr("NOT is_blank AND NOT is_copy AND is_cut")
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("is_blank") | F.col("is_copy"), "X").when(F.col("is_cut"), F.upper(kind)).otherwise(kind)

    def count(c):
        return F.count_if(F.col("there") & c)
    return judged.groupBy("conv_id").agg(
        F.coalesce(F.expr("max(turn) - min(turn) + 1") - count(F.expr("turn IS NOT NULL AND (turn_before IS NULL OR turn_before <> turn)")),
                   F.lit(0)).cast("long").alias("gaps"),
        count(F.col("is_blank")).alias("blank"), count(dup).alias("duplicate"), count(cut).alias("truncated"),
        count(F.expr("step IS NOT NULL AND step NOT IN ('su', 'ua', 'au')")).alias("illegal"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("there"), F.struct("pos", symbol.alias("symbol"))))),
                                 lambda x: x["symbol"]), "").alias("symbols"))


def with_edits(conversations: DataFrame) -> DataFrame:
    """``conversations`` (with ``symbols``) with the cheapest edits' cost and audit. Each distinct string is solved once."""
    strings = stored(conversations.groupBy("symbols").agg(F.count("*").alias("n")), "distinct")
    rules, packed = grammar(strings)
    matrices = rule_matrices(rules)

    def solve(batches):
        for batch in batches:
            solved = [cheapest(s, matrices) for s in batch["packed"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["symbols"], pa.array([c for c, _ in solved], pa.int64()),
                                              pa.array([a for _, a in solved], pa.string()), batch["n"]], names=["symbols", "cost", "audit", "n"])
    edits = stored(packed.mapInArrow(solve, "symbols string, cost long, audit string, n long"), "edits")
    often, rare = edits.where(F.col("n") > FREQUENT).drop("n"), edits.where(F.col("n") <= FREQUENT).drop("n")
    tried = stored(salted_join(conversations, often, ["symbols"], "conv_id", "left"), "edited")
    return tried.where("audit IS NOT NULL").unionByName(tried.where("audit IS NULL").drop("cost", "audit").join(rare, "symbols"))


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None, with_text: bool = False) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text) and of ``ids``: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256 and, ``with_text``, the repaired rows ``role:text``.

    Rows go by turn, null first, ties by role and the text's MD5. A null role or text is one space; rows with a null conv_id
    are one conversation; a repeated row is a duplicate. A conversation without rows has zeros, no edits and the empty
    hash; without conversations there is no row. An empty role has no initial and cannot stay. Other columns are not read."""
    every = rows.select("conv_id").unionByName((rows if ids is None else ids).select("conv_id")).distinct()
    edited = with_edits(stored(structure(rows, every), "structure"))
    counts = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long")]
    key = dict(rows.dtypes)["conv_id"]
    texts = _plain(rows)
    heads = edited.select("conv_id", F.lit(0).alias("body"), *[F.lit(None).cast(t).alias(c) for c, t in texts.dtypes[1:]],
                          *[c for c, _ in counts], "audit")
    body = texts.select("conv_id", F.lit(1).alias("body"), "turn", "role", "text", "digest", *[F.lit(None).cast(t).alias(c) for c, t in counts],
                        F.lit(None).cast("string").alias("audit"))
    names = ["body", "role", "text", "conv_id", *[c for c, _ in counts], "audit"]
    ordered = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "body", *_order()).select(names)
    ddl = f"conv_id {key}, " + ", ".join(f"{c} {t}" for c, t in counts) + ", audit string, repaired_sha256 string"
    ddl += ", repaired array<string>" if with_text else ""

    def repaired(stream: Iterator[tuple]) -> Iterator[tuple]:
        head = next(stream, None)
        while head is not None:
            sha, said, after = hashlib.sha256(), [], [None]

            def own(after=after):
                for row in stream:
                    if row[0] == 0:
                        after[0] = row
                        return
                    yield row[1], row[2]
            body = own()
            for k, line in enumerate(replay(head[-1], body)):
                sha.update(b"\n" * (k > 0) + line.encode())
                if with_text:
                    said.append(line)
            next(body, None)
            yield (*head[3:], sha.hexdigest(), said) if with_text else (*head[3:], sha.hexdigest())
            head = after[0]

    def run(batches):
        first = next(batches, None)
        if first is not None:
            schema = pa.schema([(f.name, f.type) for f in list(first.schema)[3:]] + [("repaired_sha256", pa.string())]
                               + ([("repaired", pa.list_(pa.string()))] if with_text else []))
            yield from row_batches(repaired(row_stream(_again(first, batches))), schema, 256)
    return ordered.mapInArrow(run, ddl)


def _again(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest
