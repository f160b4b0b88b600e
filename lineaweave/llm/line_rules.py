"""Quality rules with cross-document line frequency.

Each line is normalised (case, digits, spaces) and hashed. A line that stands
in too many of a host's distinct documents, by share or by number, is
boilerplate of that host; a document that loses too many of its words with such lines is
rejected, and so is one that fails the base rules (too few words, or most of
its words in repeated three-word windows). ``clean_documents`` cuts these lines
out of the documents that stay.

Copies are one document: a document's identity is a hash of all its line
hashes, which only texts of the same normalised lines share. So a text is not
taken for boilerplate because it was copied often, and documents that share
some of their lines, be they most, count one by one. Near copies do too.

The per-document part runs in Arrow batches. One row of each identity of a
host stands for its copies; the counts are grouped sums over the lines of
these, so that a line which half of all documents hold is summed before it is
shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import ragged, slices, stored

#: A line is boilerplate from this many distinct documents of its host on, if they are also above this share of them.
MIN_DOCS, MAX_SHARE = 10, 0.10
#: It is boilerplate, too, above this many distinct documents, however many the host has.
MAX_DOCS = 1000
#: Words that a document may lose with its boilerplate lines, as a share.
MAX_REMOVED = 0.5
#: Base rules: words at least; words in repeated windows at most, in percent.
MIN_WORDS, MAX_REPEAT = 50, 50

_SPACE, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
_DIGITS = re.compile(r"\d+")

FEATURES = ("row long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
            "n_repeat_words long, ident long, line_hash array<long>, line_words array<int>")


def line_hash(line: str) -> int:
    """Signed 64-bit hash of a line without regard to case, digits and spacing."""
    plain = " ".join(_DIGITS.sub("0", line.lower()).split())
    return xxhash.xxh3_64_intdigest(plain) - (1 << 63)


def identity(hashes: np.ndarray) -> int | None:
    """Signed 64-bit hash of a document's distinct line hashes, whatever their order; None without lines."""
    return xxhash.xxh3_64_intdigest(np.sort(hashes).tobytes()) - (1 << 63) if len(hashes) else None


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n + 2)
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, window, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[window] > 1
    hit = np.zeros(n + 2, bool)
    for k in range(3):
        hit[k:n + k] |= again
    return int(hit.sum())


def text_features(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, identity, line hashes, words by line)."""
    text = text or ""
    raw = text.encode()
    words: list[bytes] = []
    seen: set[str] = set()
    dup, by_hash = 0, {}
    for line in text.split("\n"):
        own = line.encode().split()
        if not own:
            continue
        words += own
        dup += line in seen
        seen.add(line)
        h = line_hash(line)
        by_hash[h] = by_hash.get(h, 0) + len(own)
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    hashes = np.array(list(by_hash), np.int64)
    return (len(words), len(text) - spaces, symbols, dup, repeated_words(words),
            identity(hashes), hashes, np.array(list(by_hash.values()), np.int64))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        cols = list(zip(*map(text_features, batch["text"].to_pylist()), strict=True))
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["row"], batch["host"], batch["text_hash"], *(pa.array(c, pa.int64()) for c in cols[:6]),
             ragged(cols[6], pa.int64()), ragged(cols[7], pa.int32())],
            names=["id", *(f.split()[0] for f in FEATURES.split(", "))])


def cut_lines(text: str, hashes: set[int]) -> str:
    """``text`` without the lines whose hash is one of ``hashes``; other lines, blank ones too, stay as they are."""
    return "\n".join(x for x in text.split("\n") if not x.encode().split() or line_hash(x) not in hashes)


@F.arrow_udf(StringType())
def _cut(texts: pa.Array, cuts: pa.Array) -> pa.Array:
    return pa.array([None if h is None else cut_lines(t, set(h))
                     for t, h in zip(texts.to_pylist(), cuts.to_pylist(), strict=True)], pa.string())


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col), F.lit(""))


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_docs: int, max_share: float,
            max_removed: float, max_docs: int) -> tuple[DataFrame, DataFrame]:
    """Per-document verdicts with a row number and the lines to cut, and the boilerplate lines (host, h)."""
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                        _host(host_col).alias("host"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    feats = stored(given.mapInArrow(_features, f"id {id_type}, {FEATURES}"), "lines")
    lines = feats.select("row", "host", F.explode(F.arrays_zip("line_hash", "line_words")).alias("x")).select(
        "row", "host", F.col("x.line_hash").alias("h"), F.col("x.line_words").alias("w"))
    firsts = stored(feats.where("ident IS NOT NULL").groupBy("host", "ident").agg(F.min("row").alias("row")).select(
        "host", "row"), "distinct")
    hosts = firsts.groupBy("host").agg(F.count("*").alias("of"))
    held = feats.join(firsts.select("row"), "row", "left_semi").select("host", F.explode("line_hash").alias("h")).groupBy(
        "host", "h").agg(F.count("*").alias("n"))
    common = stored(held.where((F.col("n") >= min_docs) | (F.col("n") > max_docs)).join(hosts, "host").where(
        (F.col("n") > max_docs) | (F.col("n") > max_share * F.col("of"))).select("host", "h"), "common-lines")
    lost = lines.join(common, ["host", "h"]).groupBy("row").agg(
        F.sum("w").alias("n_removed_words"), F.collect_list("h").alias("cut"))
    out = feats.drop("line_hash", "line_words", "ident").join(lost, "row", "left").withColumn(
        "n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_removed_words") <= max_removed * F.col("n_words")))
    return out, common


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                    min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE,
                    max_removed: float = MAX_REMOVED, max_docs: int = MAX_DOCS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the base counts, the words in
    boilerplate lines, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails. A null host is a host of its
    own. Repeated rows are judged one by one and, being copies, count as one
    document. Other columns of ``docs`` are not read."""
    out, _ = _judged(docs, id_col, text_col, host_col, min_docs, max_share, max_removed, max_docs)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "n_removed_words", "base_failed", "kept")


def common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                 min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """The boilerplate lines: host and ``line_hash`` of the line."""
    return _judged(docs, id_col, text_col, host_col, min_docs, max_share, MAX_REMOVED, max_docs)[1]


def reject_documents(docs: DataFrame, id_col: str = "doc_id", **rules) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id has no rejected row."""
    gone = judge_documents(docs, id_col, **rules).where(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                    chars_col: str | None = "n_chars", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE,
                    max_removed: float = MAX_REMOVED, max_docs: int = MAX_DOCS) -> DataFrame:
    """The rows of ``reject_documents``, with all their columns, without their boilerplate lines.

    ``chars_col`` is set to the length of each text that lost a line; other rows are as given. The lines to cut are
    found by id, host and the text's hash, so repeated ids may have different texts. The verdict is on the text as
    given: what is left of a document may have fewer words than the base rules ask for."""
    out, _ = _judged(docs, id_col, text_col, host_col, min_docs, max_share, max_removed, max_docs)
    judged = stored(out.select("id", "host", "text_hash", "kept", "cut"), "verdicts")
    gone = judged.where(~F.col("kept")).select(F.col("id").alias("_gone")).distinct()
    stay = judged.groupBy("id", "host", "text_hash").agg(F.first("cut").alias("_cut")).withColumnsRenamed(
        {"id": "_id", "host": "_host", "text_hash": "_hash"})
    stay = stay.join(gone, F.col("_id").eqNullSafe(F.col("_gone")), "left_anti")
    # the given columns in one struct, so that none has the name of one made here
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("_own"), _host(host_col).alias("_of"),
                         F.xxhash64(text_col).alias("_sum"))
    kept = packed.join(stay, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_host")) & (F.col("_sum") == F.col("_hash")))
    # Python sees the texts that lose a line only
    own = F.col("_row")[text_col]
    kept = kept.withColumn("_text", _cut(F.when(F.col("_cut").isNotNull(), own), F.col("_cut")))
    given = {text_col: F.coalesce(F.col("_text"), own)}
    if chars_col is not None:
        length = F.length("_text").cast(docs.schema[chars_col].dataType)
        given[chars_col] = F.when(F.col("_text").isNotNull(), length).otherwise(F.col("_row")[chars_col])
    return kept.select(*(given.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
