"""Decontamination, near copies and components against brute force; the url filter; the pipeline."""
import hashlib
import random
import re

import numpy as np
import pytest
from conftest_llm import prose

from lineaweave.llm import decontaminate, signature_join, url_templates
from lineaweave.llm.components import components


def brute_classes(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    ids = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(a)] = min(ids.get(find(a), i), i)
    return sorted(((i, len(s), ids.get(find(a))) for a, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near_rows(seed, groups, n):
    r = random.Random(seed)
    out, i = [], 0
    passage = prose(99, 60).split()
    for g in range(groups):
        base = prose(seed * 1000 + g, r.randrange(3, 200)).split()
        for _ in range(r.randrange(1, n)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 15)):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            if r.random() < 0.3:
                w += passage
            out.append((i, " ".join(w)))
            i += 1
    r.shuffle(out)
    return out


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (2, 60)])
def test_classes_equal_brute_force(docs_of, odd_rows, k, percent):
    rows = near_rows(k, 25, 12) + [(1000 + (i or 0) if i is not None else None, t) for i, t in odd_rows]
    got = signature_join.jaccard_classes(docs_of(rows), words=k, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_classes(rows, k, percent)


def test_classes_with_large_blocks_in_chunks(docs_of, monkeypatch):
    """One group of near copies far larger than a leaf and, here, than a chunk."""
    monkeypatch.setattr(signature_join, "CHUNK", 24)
    r = random.Random(3)
    base = prose(7, 120).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, t) for i, t in near_rows(5, 10, 5)]
    got = signature_join.jaccard_classes(docs_of(rows), words=4, percent=85)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_classes(rows, 4, 85)


def test_dual_traversal_loses_no_pair():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**63, 40 + s % 9).astype(np.uint64)) for s in range(30)]
    sets += [np.unique(np.concatenate([s[: -(k % 4) or None], s[:0]])) for s in sets for k in range(12)]
    size = np.array([len(s) for s in sets])
    tree = signature_join.SignatureTree(signature_join.bitmaps(sets, 512), size, size, np.arange(len(sets)))
    assert len(tree.levels) > 2
    found = {tuple(sorted(p)) for i, j in signature_join.dual_traversal(tree, tree, 80) for p in zip(i.tolist(), j.tolist(), strict=True)}
    for a in range(len(sets)):
        for b in range(a):
            c = len(np.intersect1d(sets[a], sets[b]))
            if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                assert (b, a) in found
    assert len(found) < len(sets) ** 2 / 8


def test_keep_one_each(docs_of):
    t = prose(4, 50)
    rows = [(3, t), (1, t), (2, t + " more"), (5, None), (6, ""), (7, "a b"), (7, "a b"), (8, "A B")]
    got = signature_join.keep_one_each(docs_of(rows))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 5, 6, 7]
    assert got.columns == docs_of(rows).columns


def test_empty_join(docs_of):
    assert signature_join.jaccard_classes(docs_of([(1, "x")]).where("doc_id < 0")).count() == 0
    assert [r["component_id"] for r in signature_join.jaccard_classes(docs_of([(1, None)])).collect()] == [1]


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 60)] + [(100, 100), (200, 201), (201, 200)] + [(300, 300 + k) for k in range(1, 40)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {k: 1 for k in range(1, 61)} | {200: 200, 201: 200} | {300 + k: 300 for k in range(40)}


def brute_hits(text, items, n):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        own = words(t)
        size = min(n, len(own))
        for k in range(len(own) - size + 1) if own else ():
            for a in range(len(w) - size + 1):
                if w[a:a + size] == own[k:k + size]:
                    hit |= set(range(a, a + size))
                    found.add(str(i))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("broadcast_bytes", [decontaminate.BROADCAST_BYTES, 0])  # 0: items too large to broadcast
def test_contamination_equals_brute_force(spark, docs_of, odd_rows, broadcast_bytes):
    item = prose(50, 25)
    w = item.split()
    items = [(1, item), (2, "Only three words"), (3, "zwei"), (4, None), (5, "..."), (10, item), (11, " ".join(w[3:15])),
             (12, "É " * 12), (13, "a a a a a a a a a a a a")]
    rows = odd_rows + [(20, "x " + item.upper() + " y"), (21, " ".join(w[:9])), (22, "-".join(w[5:15])), (23, "ONLY, three\nwords!"),
                       (24, "Zwei"), (25, "é " * 12), (26, "É. " * 14), (27, "a " * 40), (28, " ".join(w[2:14] + ["q"] + w[2:14]))]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.contamination(docs_of(rows), table, broadcast_bytes=broadcast_bytes).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == brute_hits(texts[r["doc_id"]], items, 10), r["doc_id"]
    none = decontaminate.contamination(docs_of(rows), table.where("item_id < 0"))
    assert none.where("contaminated").count() == 0 and none.count() == len(rows)
    assert decontaminate.contamination(docs_of(rows).where("doc_id < 0"), table).count() == 0
    kept = decontaminate.reject_contaminated(docs_of(rows), table)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["contaminated"]}


def test_shuffled_shingles_carry_no_words(spark, docs_of, monkeypatch):
    """Beyond the broadcast bound a shingle's row is (row, place, token), however long its document is."""
    kinds = []
    join = decontaminate.salted_join
    monkeypatch.setattr(decontaminate, "salted_join", lambda left, *a: kinds.append(dict(left.dtypes)) or join(left, *a))
    table = spark.createDataFrame([(1, prose(50, 25))], "item_id long, text string")
    decontaminate.contamination(docs_of([(1, prose(50, 25))]), table, broadcast_bytes=0)
    assert kinds == [{"row": "bigint", "place": "int", "token": "bigint"}]


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def test_url_rules(spark):
    cases = [("http://Example.ORG/es/1", "example.org", "/es/1", "example.org/es/", "block"),
             ("x://a.example.org/en/12?q", "a.example.org", "/en/12", "example.org/en/1", "block"),
             ("http://notexample.org/es/1#f", "notexample.org", "/es/1", "org/", "allow"),
             ("http://a.com/de/x", "a.com", "/de/x", "com/de/", "block"), ("http://a.org", "a.org", "", None, "allow"),
             ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"),
             ("a://b://c/d", "b:", "//c/d", None, "allow")]
    df = spark.createDataFrame([(k, c[0], "p", "h") for k, c in enumerate(cases)], "page_id long, url string, path string, host string")
    got = url_templates.judge_urls(df, RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in got] == [c[1:4] for c in cases]
    assert all(r["verdict"] == c[4] for r, c in zip(got, cases, strict=True) if c[3])
    assert url_templates.judge_urls(df.where("page_id < 0"), RULES).count() == 0


def plain_templates(urls):
    """Templates and purities by recursion over each host's paths. urls: {(host, segments): (n, good, bad)}"""
    U, out = url_templates, {}
    good, bad = sum(v[1] for v in urls.values()), sum(v[2] for v in urls.values())
    prior = (good + U.STRENGTH / 2) / (good + bad + U.STRENGTH)

    def wild(s):
        m = re.match(r"^(.*?)(\.[A-Za-z]\w{0,4})?$", s)
        stem, end = m.group(1), m.group(2) or ""
        kind = ("{n}" if re.match(r"^\d+$", stem) else "{h}" if re.match(r"^[0-9a-fA-F-]{8,}$", stem)
                else "{x}" if re.search(r"\d.*\d.*\d", stem) else "{long}" if len(stem) > 40 else None)
        return kind and kind + end

    def go(paths, depth, template, purity):
        for p in (p for p in paths if len(p[1]) == depth):
            out[p] = (template, round(purity, 9))
        by = {}
        for p in paths:
            if len(p[1]) > depth:
                by.setdefault(p[1][depth], []).append(p)
        tally = {s: [sum(urls[p][k] for p in ps) for k in range(3)] for s, ps in by.items()}
        plain = [s for s in by if wild(s) is None]
        all_g, all_b = (sum(tally[s][k] for s in plain) for k in (1, 2))
        named = {}
        for s, ps in by.items():
            n, g, b = tally[s]
            name = wild(s)
            if name is None and len(plain) >= U.FAN and n <= U.RARE:
                name = "{rare}"
            if name is None and len(plain) > 1:
                share = all_g / (all_g + all_b) if all_g + all_b else 0
                if g + b == 0 or abs(g / (g + b) - share) <= U.Z * (max(share * (1 - share), 1e-4) / (g + b)) ** 0.5:
                    name = "{*}"
            named.setdefault(name or s, []).extend(ps)
        for name, ps in named.items():
            g, b = (sum(urls[p][k] for p in ps) for k in (1, 2))
            go(ps, depth + 1, f"{template}/{name}", (g + U.STRENGTH * purity) / (g + b + U.STRENGTH))
    for host in {h for h, _ in urls}:
        own = [p for p in urls if p[0] == host]
        g, b = (sum(urls[p][k] for p in own) for k in (1, 2))
        go(own, 0, "", (g + U.STRENGTH * prior) / (g + b + U.STRENGTH))
    return out


def test_url_templates_by_brute_force_at_any_depth(spark):
    r = random.Random(8)
    deep = "a/b/c/d/e/f/g/h/i/j"
    urls = [f"https://{h}.org/{deep}/{part}/{k}" for h in ("x", "y") for part in ("good", "bad") for k in range(25)]
    urls += [f"https://{r.choice('xyz')}.org/{'/'.join(r.choice(['u', 'v', str(r.randrange(99)), 'w1x2y3', 'p.html']) for _ in range(r.randrange(5)))}"
             for _ in range(300)]
    urls += [f"https://z.org/rare/word{chr(97 + k)}" for k in range(20)] + [None, "", "no scheme", urls[0], urls[0], "https://z.org/" + "q/" * 400]
    rules = [("allow", "x.org/" + deep + "/good"), ("block", "x.org/" + deep + "/bad"), ("block", "y.org/u"), ("allow", "z.org/v")]
    df = spark.createDataFrame([(k, u, "x", "t") for k, u in enumerate(urls)] + [(0, urls[0], "x", "t")], "page_id long, url string, host string, template string")
    got = url_templates.judge_urls(df.where("page_id <> 355"), rules).collect()
    distinct = {}
    for x in got:
        key = (x["host"], tuple(s for s in x["path"].split("/") if s), x["path"])
        n, g, b = distinct.get(key, (0, 0, 0))
        labelled = x["rule"] is not None
        distinct[key] = (n + 1, g + (labelled and x["verdict"] == "allow"), b + (labelled and x["verdict"] == "block"))
    assert len({(h, s) for h, s, _ in distinct}) == len(distinct)
    want = plain_templates({(h, s): v for (h, s, _), v in distinct.items()})
    for x in got:
        template, purity = want[x["host"], tuple(s for s in x["path"].split("/") if s)]
        assert (x["template"], round(x["purity"], 9)) == (template, purity)
        assert x["verdict"] == (x["verdict"] if x["rule"] else "block" if x["purity"] < url_templates.MIN_PURITY else "allow")
    parts = {x["path"].split("/")[11]: x["template"] for x in got if x["host"] == "x.org" and x["path"].startswith("/" + deep)}
    assert parts["good"] != parts["bad"]


def test_url_templates_generalise_and_reject(spark):
    rules = [("block", "a.com/ads/1"), ("allow", "a.com/news/1"), ("allow", "b.com/x/")]
    urls = [f"http://a.com/{part}/{n}.html" for part in ("ads", "news") for n in range(100, 260)]
    urls += [f"http://a.com/news/{n}/deep/{n}" for n in range(300, 310)] + ["http://a.com/" + "/".join("pqrstuvwxyzab")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r["page_id"]]: r for r in url_templates.judge_urls(df, rules).collect()}
    assert got["http://a.com/ads/250.html"]["template"] == "/ads/{n}.html"
    assert got["http://a.com/ads/250.html"]["verdict"] == "block" and got["http://a.com/ads/250.html"]["rule"] is None
    assert got["http://a.com/news/250.html"]["verdict"] == "allow"
    assert got["http://a.com/news/305/deep/305"]["template"].endswith("/{n}/deep/{n}")
    assert got[urls[-1]]["template"].endswith("/" + "/".join("qrstuvwxyzab"))


def test_pipeline_equals_its_stages_by_brute_force(spark, docs_of, tmp_path):
    import corpus_pipeline
    import sentencepiece
    from lineaweave.llm import sentence_pieces
    item = prose(50_000, 30)
    clean = [(k, "\n".join(f"the {prose(31 * k + j, 14)} and of it." for j in range(8)), "en") for k in range(40)]
    rows = clean + [(100 + k, clean[k][1] + " end", "en") for k in range(5)] + [(200, None, "en"), (201, "too short", "en")]
    rows += [(300, clean[6][1].replace("the", "a") + " " + item + " " + prose(9, 90), "en")]
    docs = docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, *_ in clean}
    own = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path(None))
    assert all(got[i]["ids"] == own.encode(t) for i, t, _ in clean)
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "n-gram Jaccard join" and corpus_pipeline.ORACLE_SQL is None
