"""URL filter by a tree of path templates, in DataFrame operations only.

Rules (host and path prefixes) decide the urls that they fit; these urls are
also the labels from which the tree judges the others. Every host has a tree,
built a level at a time from the paths' segments:

- a segment that looks variable (number, hexadecimal, mixed with digits), or
  one of many rare siblings, becomes a wildcard of its kind;
- of the other siblings, those whose share of allowed labels does not differ
  from that of all of them by ``Z`` standard errors are merged into one
  wildcard, the others stay as they are;
- a node's purity is its share of allowed labels, smoothed by ``STRENGTH``
  labels of its parent's purity, from the whole corpus down.

A url is blocked if its template's purity is below ``MIN_PURITY``. Work is
done on distinct paths with counts; a level costs two grouped sums and three
joins, of the paths that go on there; the tree ends where no two paths go on together. Branches are
dealt over salts to their node, so one node's many branches fill no task; the other joins are on
host, template and segment, which the adaptive join splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored

#: Templates with a smoothed share of allowed labels below this are rejected.
MIN_PURITY = 0.4
#: Labels of the parent's purity that are added to a node's own.
STRENGTH = 4.0
#: Standard errors by which a branch's share must differ from its siblings' to stay apart.
Z = 2.0
#: Siblings from which a rare segment (at most ``RARE`` urls) is variable.
FAN, RARE = 12, 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path of a url; empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return (F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            F.coalesce(F.regexp_extract(url, pattern, 2), F.lit("")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does.

    ``rules``: (verdict, rule), a rule being a host and a path prefix such as
    ``example.org/es/``. It fits its host and all subdomains. Of equally long
    ones that with the longer host wins."""
    found, verdict = [], []
    for kind, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1].find("/") * -1, r)):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + prefix)
        found.append(F.when(fits, F.lit(rule)))
        verdict.append(F.when(fits, F.lit(kind)))
    none = F.lit(None).cast("string")
    return F.coalesce(*found, none), F.coalesce(*verdict, none)


def shape(segment: Column) -> Column:
    """The wildcard of a segment that looks variable, else null. A file ending stays."""
    stem, ending = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]\w{0,4})?$", 1), F.regexp_extract(
        segment, r"^(.*?)(\.[A-Za-z]\w{0,4})?$", 2)
    kind = (F.when(stem.rlike(r"^\d+$"), F.lit("{n}")).when(stem.rlike(r"^[0-9a-fA-F-]{8,}$"), F.lit("{h}"))
            .when(stem.rlike(r"\d.*\d.*\d"), F.lit("{x}")).when(F.length(stem) > 40, F.lit("{long}")))
    return F.concat(kind, ending)


def _purity(good: Column, bad: Column, before: Column) -> Column:
    return (good + STRENGTH * before) / (good + bad + STRENGTH)


def learn_templates(urls: DataFrame) -> DataFrame:
    """Templates of distinct paths.

    ``urls``: host, path, its ``segments``, n (urls), good and bad (labels). Returns host, path,
    ``template`` and its ``purity``."""
    total = urls.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max(F.size("segments")).alias("deep")).first()
    good, bad = total["good"] or 0, total["bad"] or 0
    prior = (good + STRENGTH / 2) / (good + bad + STRENGTH)
    hosts = urls.groupBy("host").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).select(
        "host", _purity(F.col("g"), F.col("b"), F.lit(prior)).alias("purity"))
    state = stored(urls.join(hosts, "host").withColumns({"template": F.lit(""), "paths": F.lit(0).cast("long")}), "url-level")
    ended = []
    for level in range(1, (total["deep"] or 0) + 1):
        # a path that is alone under its template meets no siblings: the rest of its levels is its own
        ended.append(_alone(state.where((F.size("segments") < level) | (F.col("paths") == 1)), level))
        state = state.where((F.size("segments") >= level) & (F.col("paths") != 1))
        if state.isEmpty():
            break
        here = state.withColumn("segment", F.element_at("segments", level))
        branches = here.groupBy("host", "template", "segment").agg(
            F.sum("n").alias("n"), F.sum("good").alias("g"), F.sum("bad").alias("b"), F.first("purity").alias("purity"), F.count("*").alias("paths"))
        branches = branches.withColumn("wild", shape(F.col("segment")))
        nodes = branches.where("wild IS NULL").groupBy("host", "template").agg(
            F.count("*").alias("fan"), F.sum("g").alias("all_g"), F.sum("b").alias("all_b"))
        joined = salted_join(branches, nodes, ["host", "template"], "segment", "left")
        labels = F.col("g") + F.col("b")
        share = F.col("all_g") / (F.col("all_g") + F.col("all_b"))
        error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-4)) / labels)
        similar = (F.col("fan") > 1) & ((labels == 0) | (F.abs(F.col("g") / labels - share) <= Z * error))
        name = F.coalesce("wild", F.when((F.col("fan") >= FAN) & (F.col("n") <= RARE), F.lit("{rare}")),
                          F.when(similar, F.lit("{*}")), F.col("segment"))
        named = joined.withColumn("next", F.concat("template", F.lit("/"), name))
        pure = named.groupBy("host", "next").agg(
            F.sum("g").alias("sg"), F.sum("b").alias("sb"), F.first("purity").alias("before"), F.sum("paths").alias("paths")).select(
            "host", "next", "paths", _purity(F.col("sg"), F.col("sb"), F.col("before")).alias("purity"))
        steps = named.drop("purity", "paths").join(pure, ["host", "next"]).select("host", "template", "segment", "next", "paths", F.col("purity").alias("p"))
        moved = state.drop("paths").withColumn("segment", F.get("segments", F.lit(level - 1))).join(
            steps, ["host", "template", "segment"], "left").select(
            "host", "path", "segments", "n", "good", "bad", F.coalesce("p", "purity").alias("purity"),
            F.coalesce("next", "template").alias("template"), "paths")
        state = stored(moved, "url-level")
    out = state.select("host", "path", "template", "purity")
    for paths in ended:
        out = out.unionByName(paths)
    return out


def _alone(paths: DataFrame, level: int) -> DataFrame:
    """Template and purity of paths without siblings from a level on."""
    rest = F.filter("segments", lambda x, k: k >= level - 1)
    names = F.transform(rest, lambda x: F.concat(F.lit("/"), F.coalesce(shape(x), x)))
    return paths.select("host", "path", F.concat("template", F.array_join(names, "")).alias("template"),
                        F.aggregate(rest, F.col("purity"), lambda p, x: _purity(F.col("good"), F.col("bad"), p)).alias("purity"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
               labels: DataFrame | None = None, min_purity: float = MIN_PURITY) -> DataFrame:
    """One row per row of ``pages``: ``id_col``, host, path, rule (null if none
    fits), verdict (``allow`` or ``block``: the rule's, else the template's),
    template and purity.

    ``labels`` (host, path, good and bad as counts) may add labels to those of
    the rules. Of a null url, or one without ``://``, host and path are empty.
    Without any label purity is a half and all is allowed that no rule blocks.
    Repeated rows are counted and judged one by one; other columns are not
    read."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, kind = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("kind", kind)
    count = [F.sum((F.col("kind") == k).cast("long")) for k in ("allow", "block")]
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("n"), *(
        F.coalesce(c, F.lit(0).cast("long")).alias(name) for c, name in zip(count, ("good", "bad"), strict=True)))
    if labels is not None:
        more = labels.groupBy("host", "path").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
        urls = urls.join(more, ["host", "path"], "left").select(
            "host", "path", "n", (F.col("good") + F.coalesce("g", F.lit(0))).alias("good"),
            (F.col("bad") + F.coalesce("b", F.lit(0))).alias("bad"))
    segments = F.array_remove(F.split(F.col("path"), "/"), "")
    templates = learn_templates(stored(urls.withColumn("segments", segments), "urls"))
    judged = rows.join(templates, ["host", "path"], "left")
    verdict = F.coalesce("kind", F.when(F.col("purity") < min_purity, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
