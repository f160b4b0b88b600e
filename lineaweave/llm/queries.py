"""The subpackage's registered queries, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (contextual_pii, decontaminate, language, line_rules, prefix_tree, sentence_pieces, signature_join, structure_repair, token_files, trie_tokens,
               url_templates, warc, weak_quality)

#: The url filter's rules: (verdict, host and path prefix).
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
             ("block", "com/de/")]
#: Id behind each document in the token files.
END_ID = 2
#: Of the join's query: words of a shingle, and percent. (The operator's defaults are those of near copies.)
JOIN_WORDS, JOIN_PERCENT = 4, 85

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f
    return put


@query("op1_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak labels, posterior and score of every document."""
    return weak_quality.classify(table(spark, sf_dir, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest"""


@query("op2_warc", WARC_SQL)
def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    records = warc.archive_pages(table(spark, sf_dir, "pages"))
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                          "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query("op3_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return trie_tokens.count_tokens(table(spark, sf_dir, "documents"))


@query("op4_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's url."""
    return url_templates.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op5_token_files")
def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids from the files that were written of them."""
    return token_files.tokenize_to_files(table(spark, sf_dir, "documents"), END_ID)


DECONTAMINATION_SQL = r"""
WITH dw AS (SELECT doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w0 FROM documents),
d AS (SELECT doc_id, list_filter(w0, lambda x: x <> '') AS w FROM dw),
iw AS (SELECT item_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w0 FROM benchmark),
i AS (SELECT item_id, list_filter(w0, lambda x: x <> '') AS w FROM iw),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS body
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
spot AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
occ AS (SELECT a.doc_id, a.k, a.n, win.item_id FROM (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS body FROM spot) a
  JOIN win ON win.n = a.n AND win.body = a.body),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""


@query("op6_decontamination", DECONTAMINATION_SQL)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in windows of benchmark items."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@query("op7_language")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    out = language.predict(docs.select("doc_id", "text"), model, columns=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op8_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies."""
    return signature_join.jaccard_classes(table(spark, sf_dir, "documents"), words=JOIN_WORDS, percent=JOIN_PERCENT)


@query("op9_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return line_rules.judge_documents(table(spark, sf_dir, "documents"))


@query("op10_sentence_pieces")
def sentence_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and checksum of every document's ids, with both checks of them."""
    return sentence_pieces.encode_documents(table(spark, sf_dir, "documents"), with_ids=False)


#: CRC-32 of a string of ASCII characters, as DuckDB SQL.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
  4294967295)"""

CONVERSATION_TREE_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos,
    md5(coalesce(role, '')) || md5(coalesce(text, '')) AS what, strlen(coalesce(text, ''))::BIGINT AS size
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC32_SQL.format('conv_id::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, what, size FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, pos + 9, what, size FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
path AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(what, ',') OVER w AS key, size FROM r
    WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
ends AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(key, depth) AS key FROM path GROUP BY conv_id) GROUP BY key),
node AS (SELECT key, depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
    CASE WHEN depth > 0 THEN left(key, greatest(65 * depth - 66, 0)) END AS parent FROM path GROUP BY key, depth),
kids AS (SELECT parent, count(*) AS n FROM node GROUP BY parent),
sub AS (SELECT up.key, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((node.n_convs - 1) * node.size) AS saved
  FROM node JOIN path up ON up.conv_id = node.conv_id AND up.depth <= node.depth LEFT JOIN kids ON kids.parent = node.key GROUP BY up.key)
SELECT node.conv_id, node.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, node.n_convs::BIGINT AS n_convs,
  coalesce(kids.n, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM node LEFT JOIN node p ON p.key = node.parent AND p.depth = node.depth - 1 LEFT JOIN kids ON kids.parent = node.key
  JOIN sub ON sub.key = node.key LEFT JOIN ends ON ends.key = node.key"""


@query("op11_conversation_tree", CONVERSATION_TREE_SQL)
def conversation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix tree of the rebuilt conversations."""
    return prefix_tree.conversation_tree(table(spark, sf_dir, "conversations"), sharers=prefix_tree.SHARERS)


STRUCTURE_REPAIR_SQL = rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC32_SQL.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS hit FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw),
n AS (SELECT *, row_number() OVER w AS pos, left(role, 1) AS c, lag(left(role, 1)) OVER w || left(role, 1) AS step FROM damaged
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS dup,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM n),
ins(i, k, m) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2)),
act(m, c, op, price, j) AS (SELECT m, NULL::VARCHAR, 'D', 3, m FROM range(4) t(m) UNION ALL SELECT m, NULL::VARCHAR, 'R', 2, CASE m WHEN 2 THEN 3 ELSE 2 END FROM range(4) t(m)
  UNION ALL VALUES (0, 's', 'K', 0, 1), (0, 'u', 'K', 0, 2), (1, 'u', 'K', 0, 2), (3, 'u', 'K', 0, 2), (2, 'a', 'K', 0, 3)),
dp AS (SELECT conv_id, 0::BIGINT AS pos, 0 AS st, {{'cost': 0, 'audit': '', 'body': ''}} AS best FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT dp.conv_id, f.pos, act.j, min({{'cost': dp.best.cost + 2 * ins.k + act.price + CASE WHEN act.op <> 'D' AND f.cut THEN 1 ELSE 0 END,
      'audit': dp.best.audit || repeat('I', ins.k) || act.op,
      'body': dp.best.body || CASE ins.k WHEN 0 THEN '' WHEN 2 THEN 'user:' || chr(10) || 'assistant:' || chr(10)
          ELSE CASE ins.m WHEN 2 THEN 'user:' ELSE 'assistant:' END || chr(10) END
        || CASE act.op WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10)
          ELSE CASE act.j WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text || chr(10) END}})
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.pos = dp.pos + 1 JOIN ins ON ins.i = dp.st
    JOIN act ON act.m = ins.m AND (act.c IS NULL OR act.c = f.c) AND (act.op = 'D' OR NOT (f.blank OR f.dup))
  GROUP BY dp.conv_id, f.pos, act.j),
ended AS (SELECT conv_id, min({{'cost': best.cost + CASE st WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END,
    'audit': best.audit || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'body': best.body || CASE st WHEN 1 THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 2 THEN 'assistant:' || chr(10) ELSE '' END}}) AS best
  FROM dp JOIN (SELECT conv_id AS id, max(pos) AS most FROM f GROUP BY conv_id) ON id IS NOT DISTINCT FROM dp.conv_id AND dp.pos = most GROUP BY conv_id),
k AS (SELECT conv_id AS id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (NOT blank AND dup) AS duplicate, count(*) FILTER (NOT blank AND NOT dup AND cut) AS truncated,
    count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(left(best.body, greatest(length(best.body) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN k ON k.id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM a.conv_id"""


@query("op12_structure_repair", STRUCTURE_REPAIR_SQL)
def structure_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    conversations = table(spark, sf_dir, "conversations")
    return structure_repair.repair_conversations(structure_repair.damage(conversations), ids=conversations)


@query("op13_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return contextual_pii.personal_data(table(spark, sf_dir, "documents"))
