"""Personal data by patterns first, then by bootstrapped context.

Four fixed patterns (email, ip, card, phone) give each document's base spans.
Their entities are seeds: the words around a seed are lexical patterns (two words
to the left; the word to the left and that to the right; the word to the left).
Everything that looks like an identifier (long numbers, handles, hex groups) is an
instance, known or not, and has the same patterns, so patterns and instances are
a graph. Spark scores it in rounds: a pattern's confidence for a kind is the smoothed
share of its distinct instances that are of this kind; an unknown instance's score
is the noisy-or of its accepted patterns; its score then counts for other patterns.
It ends when the accepted patterns stay as they are. Unknown instances with a high
score that stand in an accepted pattern become spans of its kind.

Distinct instances count, so copies of a text add nothing. A pattern needs several
distinct seeds and few strangers; where identifiers stand among arbitrary words,
none is accepted and the base spans are all."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, slices, stored

KINDS = ("email", "ip", "card", "phone")
#: A pattern is accepted from this confidence and number of distinct known instances on; the smoothing is strangers added to each.
MIN_CONFIDENCE, MIN_SEEDS, SMOOTHING = 0.8, 5, 1.0
#: An unknown instance becomes a span from this score on.
MIN_SCORE = 0.8
ROUNDS = 8
#: Digits of a number that is an instance.
LEAST_DIGITS, MOST_DIGITS = 7, 34
#: Code points to each side that words of a pattern are taken from; a longer word is cut there.
REACH = 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRACE = re.compile(r"[0-9@]|[(\[]at[)\]]|:[0-9A-Fa-f]{0,4}:")
_NUMBER = re.compile(r"[0-9]++(?:[ ().\-/]{1,2}[0-9]++)*+")
_AT = re.compile(r"@|[(\[]at[)\]]")
_HANDLE_LEFT, _HANDLE_RIGHT = re.compile(r"[^\s<>\"'(),;:\[\]@]*\Z"), re.compile(r"[^\s<>\"'(),;:\[\]@]*")
_HEX = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_ZERO = re.compile(r"[0-9]")

_FOUND = ("row long, doc_id {0}, n_email long, n_ip long, n_card long, n_phone long, base array<struct<start:int,kind:int,end:int>>, "
          "seen array<struct<start:int,end:int,kind:int,instance:string,patterns:array<string>>>")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, in order; linear in the text's length."""
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            # The local part's characters exclude "@", so it starts after the last match or the last "@".
            floor = max(done, text.rfind("@", done, m.start()) + 1)
            start = floor + _tail(text, floor, m.start())
            if start < m.start():
                out.append((start, 0, m.end()))
                done = m.end()
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_byte, four)):
                out.append((at, 1, end))
            at = end + 1
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _tail(text: str, floor: int, end: int) -> int:
    """Offset from ``floor`` of the run of local-part characters that ends at ``end``."""
    at = end
    while at > floor and text[at - 1] in _LOCAL_CHARS:
        at -= 1
    return at - floor


def instances(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind or -1) of the base spans and of all else that looks like an identifier, none overlapping."""
    taken = sorted((s, e) for s, _, e in base)
    yield from ((s, e, k) for s, k, e in base)
    free = []
    for m in _AT.finditer(text):
        left = _HANDLE_LEFT.search(text, max(0, m.start() - REACH), m.start()).start()
        right = _HANDLE_RIGHT.match(text, m.end(), m.end() + REACH).end()
        if left < m.start() and right > m.end():
            free.append((left, right))
    if ":" in text:
        free += [m.span() for m in _HEX.finditer(text)]
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() >= LEAST_DIGITS and LEAST_DIGITS <= sum(c.isdigit() for c in m.group()) <= MOST_DIGITS:
            free.append(m.span())
    end, k = 0, 0
    for s, e in sorted(free):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s >= end and (k == len(taken) or taken[k][0] >= e):
            yield s, e, -1
            end = e


def name_of(surface: str) -> str:
    """What names an instance: its digits, or its letters and digits in lower case if it has letters."""
    plain = "".join(c for c in surface.lower() if c.isalnum() or c == "@")
    return plain if any(c.isalpha() for c in plain) else plain.lstrip("+")


def patterns_of(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span: words in lower case with digits as 0; none without a word to the left."""
    left = _ZERO.sub("0", text[max(0, start - REACH):start].lower()).split()
    right = _ZERO.sub("0", text[end:end + REACH].lower()).split()
    if not left:
        return []
    out = [f"{left[-1]} _"]
    if len(left) > 1:
        out.append(f"{left[-2]} {left[-1]} _")
    if right:
        out.append(f"{left[-1]} _ {right[0]}")
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: a row number, its id, base counts, base spans and all instances with their patterns."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    seen = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.string()),
                               ("patterns", pa.list_(pa.string()))]))

    def run(batches):
        for piece in slices(batches):
            counts, base, found = [[] for _ in KINDS], [], []
            for text in piece["text"].to_pylist():
                own = base_spans(text) if text and _TRACE.search(text) else []
                for k, n in enumerate(counts):
                    n.append(sum(s[1] == k for s in own))
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
                found.append([{"start": s, "end": e, "kind": k, "instance": name_of(text[s:e]), "patterns": patterns_of(text, s, e)}
                              for s, e, k in instances(text, own)] if text and _TRACE.search(text) else [])
            yield pa.RecordBatch.from_arrays(
                [piece["row"], piece["doc_id"], *[pa.array(n, pa.int64()) for n in counts], pa.array(base, spans), pa.array(found, seen)],
                names=["row", "doc_id", *[f"n_{k}" for k in KINDS], "base", "seen"])
    return rows.mapInArrow(run, _FOUND.format(kind))


def learn(found: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS,
          smoothing: float = SMOOTHING, min_score: float = MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """Accepted patterns (pattern, kind, confidence, seeds) and the unknown instances that they make known (instance, kind,
    score), from the graph of the distinct (pattern, instance) pairs in ``found``."""
    seen = found.select(F.explode("seen").alias("o")).select("o.instance", "o.kind", "o.patterns")
    seeds = stored(seen.where("kind >= 0").groupBy("instance", "kind").agg(F.lit(1.0).alias("score")), "seeds")
    edges = seen.select("instance", F.explode("patterns").alias("pattern")).distinct()
    edges = stored(edges, "edges")
    sizes = stored(edges.groupBy("pattern").agg(F.count("*").alias("n")), "sizes")
    known, derived, accepted, before = seeds, None, None, None
    for _ in range(rounds):
        marks = salted_join(edges, known, ["instance"], "pattern").groupBy("pattern", "kind").agg(
            F.sum("score").alias("weight"), F.count_if(F.col("score") >= min_score).alias("seeds")).where(F.col("seeds") >= min_seeds)
        accepted = stored(marks.join(sizes, "pattern").select(
            "pattern", "kind", (F.col("weight") / (F.col("n") + smoothing)).alias("confidence"), "seeds").where(
            F.col("confidence") >= min_confidence), "patterns")
        state = accepted.agg(F.count("*"), F.coalesce(F.sum(F.round(F.col("confidence"), 6)), F.lit(0.0))).first()
        if before == tuple(state):
            break
        before = tuple(state)
        reached = salted_join(edges, accepted, ["pattern"], "instance").groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999)))))).alias("score"))
        best = reached.groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score"))
        derived = stored(best.join(seeds.select("instance"), "instance", "left_anti"), "derived")
        known = seeds.unionByName(derived)
    return accepted, derived.where(F.col("score") >= min_score)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of the base spans
    ``kind:start:end``, by start, then kind, comma-joined), spans (all, joined likewise) and n_added (by context).

    A null or empty text has no span; ties and repeated rows are rows of their own, a null id included; a very long text is
    searched whole, in time linear in its length. An empty table gives an empty one. Other columns are not read."""
    found = stored(scan(docs, id_col, text_col), "found")
    patterns, unknown = learn(found, **kw)
    loose = found.select("row", F.explode("seen").alias("o")).where("o.kind < 0").select(
        "row", "o.start", "o.end", "o.instance", F.explode("o.patterns").alias("pattern"))
    hits = salted_join(salted_join(loose, unknown.select("instance", "kind"), ["instance"], "row"),
                       patterns.select("pattern", "kind"), ["pattern", "kind"], "row")
    added = hits.select("row", F.struct(F.col("start"), F.col("kind").cast("int").alias("kind"), F.col("end")).alias("span")).distinct().groupBy(
        "row").agg(F.collect_list("span").alias("more"))
    every = found.drop("seen").join(added, "row", "left").withColumn("more", F.expr("coalesce(more, filter(base, x -> false))"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")
    return every.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_added"))
