"""Benchmark decontamination as a set join of word windows, in DataFrame operations only.

A window is ``window`` consecutive words of an item, or a whole shorter item.
As a set of shingles (``SHINGLE`` consecutive words) a window occurs in a
document only if all its shingles do, so one of them, its rarest in the
documents, is the necessary prefix to join on:

1. all shingles of the documents meet all shingles of the items in one pass,
   which leaves a document's row and the places of shared shingles, with the
   words around them;
2. shingles are ordered by the rows they left, and each window keeps its
   rarest; a window with a shingle that no document has is out;
3. the rows of the prefix shingles give candidate windows: the place in the
   window tells where in the document it would begin, which must be in the
   document, as must its end;
4. the words at that place are compared with the window's.

The items' shingles are broadcast if their number bounds them to
``BROADCAST_BYTES``; beyond it row, place and token are shuffled, each token
over several tasks, and the words stay where they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 4
#: Size of the items' shingles up to which they are broadcast, at 24 bytes each.
BROADCAST_BYTES = 32 << 20
#: Characters that words don't have.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text; no case is changed yet. A null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def folded(text: Column) -> Column:
    """A to Z lower-cased, and no other letter."""
    return F.translate(text, _UPPER, _LOWER)


def with_shingles(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``hashes``: one for each place of ``words`` where ``size`` words begin (fewer at the end).

    Words that differ only in case are equal here; the comparison of the
    words themselves comes later. Each step has a projection of its own, so
    that what the next one uses twice is computed once."""
    rows = rows.withColumn("single", F.transform(F.col("words"), lambda w: F.xxhash64(F.lower(w)))).withColumn("hashes", F.col("single"))

    def joined(with_: str, step: int) -> DataFrame:
        size = F.greatest(F.size(with_) - step, F.lit(0))
        return rows.withColumn("hashes", F.zip_with(F.slice("hashes", F.lit(1), size), F.slice(with_, F.lit(step + 1), size),
                                                    lambda x, y: F.xxhash64(x, y)))
    have = 1
    while 2 * have <= size:
        rows, have = joined("hashes", have), 2 * have
    for k in range(have, size):
        rows = joined("single", k)
    return rows.drop("single")


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: ``win``, ``item``, ``len`` and ``body`` (its words, folded, with a space between)."""
    words = items.select(F.col(id_col).alias("item"), words_of(folded(F.col(text_col))).alias("words")).where("size(words) > 0")
    size = F.least(F.size("words"), F.lit(window))
    starts = words.withColumn("len", size).select("item", "len", "words", F.explode(
        F.sequence(F.lit(1), F.size("words") - size + 1)).alias("at"))
    bodies = starts.select("item", "len", F.concat_ws(" ", F.slice(F.col("words"), F.col("at"), F.col("len"))).alias("body"))
    return bodies.distinct().withColumn("win", F.monotonically_increasing_id())


def window_shingles(windows: DataFrame, size: int) -> DataFrame:
    """Shingles of the windows: ``win``, ``token``, ``offset`` (from 0). A shorter window is one shingle."""
    words = windows.withColumn("words", F.split("body", " "))
    return with_shingles(words, size).select("win", F.posexplode("hashes").alias("offset", "token"))


def _shared_places(docs: DataFrame, tokens: DataFrame, size: int, window: int, broadcast: bool) -> DataFrame:
    """Rows of the documents' shingles that an item has, with the words around
    each (``near``, from word ``from``), and for each document a row without.

    Where the items' shingles are broadcast, the words are at hand. Where the
    join shuffles, only (row, place, token) moves; the places come back to
    their document as one list, which the document's length bounds."""
    hashed = with_shingles(docs.select("row", "id", "words", F.size("words").cast("long").alias("n_words")), size)
    distinct = tokens.select(F.col("token").alias("t")).distinct()
    own = F.array(F.lit(None).cast("struct<place:int,token:bigint>"))  # a last null is the document's own row
    if broadcast:
        places = hashed.select("row", "id", "words", "n_words", F.posexplode(F.concat(
            "hashes", F.array(F.lit(None).cast("long")))).alias("place", "token"))
        joined = places.join(F.broadcast(distinct), F.col("token") == F.col("t"), "left")
        found = joined.where("t IS NOT NULL OR token IS NULL")
    else:
        moved = hashed.select("row", F.posexplode("hashes").alias("place", "token"))
        shared = salted_join(moved, distinct.withColumnRenamed("t", "token"), ["token"], "row").groupBy("row").agg(
            F.collect_list(F.struct("place", "token")).alias("shared"))
        back = docs.join(shared, "row", "left").withColumn("one", F.explode(F.when(F.col("shared").isNull(), own).otherwise(
            F.concat("shared", own))))
        found = back.select("row", "id", "words", F.size("words").cast("long").alias("n_words"), "one.place", "one.token")
    begin = F.greatest(F.col("place") - (window - 1), F.lit(0))
    return found.select("row", F.when(F.col("token").isNull(), F.col("id")).alias("id"), "n_words", "token", "place",
                        begin.alias("from"), F.when(F.col("token").isNotNull(), F.slice(
                            F.col("words"), begin + 1, F.lit(2 * window - 1))).alias("near"))


def find_windows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                 shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """The documents (row, id, n_words) and the occurrences of windows in them (row, item, start, len).

    Windows of fewer words than a shingle are joined by shingles of their own size."""
    windows = stored(benchmark_windows(items, item_id_col, item_text_col, window), "windows")
    lengths = sorted(r[0] for r in windows.select(F.least("len", F.lit(shingle))).distinct().collect())
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                      words_of(F.col(text_col)).alias("words"))
    sets = []
    for size in lengths or [shingle]:
        same = windows.where(F.least("len", F.lit(shingle)) == size)
        tokens = stored(window_shingles(same, size), "window-shingles")
        sets.append((size, same, tokens, 24 * tokens.count() <= broadcast_bytes))
    if len(sets) > 1 or not sets[0][3]:  # row numbers must be the same in each pass
        own = stored(own, "words")
    starts, rows = [], None
    for size, same, tokens, small in sets:
        near = stored(_shared_places(own, tokens, size, window, small), "places")
        rows = near.where("token IS NULL").select("row", "id", "n_words") if rows is None else rows
        near = near.where("token IS NOT NULL").drop("id")
        rarity = near.groupBy("token").agg(F.count("*").alias("df"))
        best = tokens.join(rarity, "token", "left").groupBy("win").agg(
            F.count("*").alias("n"), F.count("df").alias("known"),
            F.min(F.when(F.col("df").isNotNull(), F.struct("df", "token", "offset"))).alias("p"))
        prefix = best.where("n = known").select("win", "p.token", "p.offset").join(same, "win")
        place = (F.col("place") - F.col("offset")).alias("start")
        candidates = near.join(prefix, "token").select("row", "item", "len", "body", "near", "from", "n_words", place)
        inside = candidates.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
        there = F.concat_ws(" ", F.slice("near", F.col("start") - F.col("from") + 1, F.col("len")))
        starts.append(inside.where(folded(there) == F.col("body")).select("row", "item", "start", "len"))
    return rows, reduce(DataFrame.unionByName, starts)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_id_col: str = "item_id", **kw) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_words``, ``n_hit`` (words in
    an occurrence of a window), ``n_items``, ``items_sha256`` (of the item ids,
    sorted as strings, with commas between) and ``contaminated``.

    A null or empty text has no words and no hits, nor has any without items.
    Items without words have no windows; repeated items and rows count one by
    one, an item id once. Other columns are not read."""
    rows, found = find_windows(docs, items, id_col, item_id_col=item_id_col, **kw)
    found = stored(found, "windows-found")
    hits = found.select("row", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("word")).distinct(
        ).groupBy("row").agg(F.count("*").alias("n_hit"))
    # a list of item ids, which the benchmark bounds
    which = found.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    none = F.array().cast("array<string>")
    joined = rows.join(hits, "row", "left").join(which, "row", "left").withColumn("items", F.coalesce("items", none))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"),
                         F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                         (n_hit > 0).alias("contaminated"))


def reject_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id has no contaminated row."""
    gone = contamination(docs, items, id_col, **kw).where("contaminated").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
