"""Operators that judge each document: line rules, language, quality, token counts, pieces."""
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import prose
from pyspark.sql import functions as F

from lineaweave.llm import language, line_rules, queries, sentence_pieces, token_files, trie_tokens, weak_quality
from lineaweave.llm.common import bounded_sample
from lineaweave.llm.language import words_of


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {p for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for p in range(k, k + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_line_rules_base_counts(docs_of, odd_rows):
    got = line_rules.judge_documents(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    texts = dict(odd_rows)
    for r in got:
        base = brute_base(texts[r["doc_id"]])
        assert tuple(r[1:6]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])


def test_line_rules_reject_boilerplate_not_copies(docs_of):
    shared = "\n".join(f"menu entry number {k} of this very same site " + "home about contact " * 3 for k in "abcdefgh")
    site = [(k, shared + f"\nown {prose(k, 5)}", "en", "hot") for k in range(40)]
    own = [(100 + k, "\n".join(prose(1000 * k + j, 12) for j in range(8)), "en", "hot") for k in range(60)]
    copies = [(200 + k, own[0][1], "en", "hot") for k in range(50)]
    got = rows(line_rules.judge_documents(docs_of(site + own + copies)))
    assert not any(got[i]["kept"] for i, *_ in site)
    assert all(got[i]["kept"] for i, *_ in own + copies)
    left = line_rules.reject_documents(docs_of(site + own + copies))
    assert {r["doc_id"] for r in left.collect()} == {i for i, *_ in own + copies}
    assert left.columns == docs_of(own).columns


def line_set(text):
    return frozenset(line_rules.line_hash(x) for x in (text or "").split("\n") if x.encode().split())


def boilerplate_by_host(given, min_docs, max_share):
    """Boilerplate lines from sets of distinct documents, by brute force."""
    docs, held = defaultdict(set), defaultdict(set)
    for _, text, _, host in given:
        docs[host].add(line_set(text))
        for h in line_set(text):
            held[host, h].add(line_set(text))
    return {k for k, v in held.items() if len(v) >= min_docs and len(v) > max_share * len(docs[k[0]])}


def boilerplate_documents():
    """Documents that pass the base rules: with menus that are little or most of the text, own ones, and copies."""
    menu = [f"{w} entry of this very same site {prose(w_k, 9)}" for w_k, w in enumerate("abcdefghijklmnopqrst")]
    some = [(k, "\n".join([*(prose(70 * k + j, 12) for j in range(6)), *menu[:2]]), "en", "hot") for k in range(30)]
    most = [(100 + k, "\n".join([*menu, prose(5000 + k, 12)]), "en", "hot") for k in range(30)]
    own = [(200 + k, "\n".join(prose(9000 * k + j, 12) for j in range(8)), "en", "hot") for k in range(60)]
    copies = [(300 + k, own[0][1], "en", "hot") for k in range(50)]
    return some + most + own + copies + [(400 + k, t, "en", "cold") for k, (_, t, *_) in enumerate(some[:5] + own[:5])]


def test_line_rules_count_every_distinct_document(docs_of):
    given = boilerplate_documents()
    want = boilerplate_by_host(given, line_rules.MIN_DOCS, line_rules.MAX_SHARE)
    assert len(want) == 20
    assert {tuple(r) for r in line_rules.common_lines(docs_of(given)).collect()} == want
    got = rows(line_rules.judge_documents(docs_of(given)))
    for i, text, _, host in given:
        lost = sum(len(x.split()) for x in text.split("\n") if (host, line_rules.line_hash(x)) in want)
        assert not got[i]["base_failed"] and got[i]["n_removed_words"] == lost
        assert got[i]["kept"] == (not 100 <= i < 130)


def test_line_rules_limit_by_number_on_large_hosts(docs_of):
    assert line_rules.MAX_DOCS == 1000
    line = f"footer of a large host {prose(3, 9)}"
    given = [(k, prose(20_000 + k, 60) + ("\n" + line) * (k <= 1000), "en", "large") for k in range(10_100)]
    given += [(20_000 + k, prose(60_000 + k, 60) + ("\n" + line) * (k < 9), "en", "small") for k in range(40)]
    docs, h = docs_of(given), line_rules.line_hash(line)
    assert {tuple(r) for r in line_rules.common_lines(docs).collect()} == {("large", h)}  # 1001 of 10,100, below the share
    assert line_rules.common_lines(docs, max_docs=1001).count() == 0
    assert line_rules.common_lines(docs, max_docs=8).count() == 2
    assert line_rules.clean_documents(docs).where(F.col("text").contains("footer")).count() == 9
    assert line_rules.judge_documents(docs).where("n_removed_words > 0").count() == 1001


def test_line_rules_cut_boilerplate_out_of_kept_documents(spark, docs_of, odd_rows):
    import corpus_pipeline
    given = boilerplate_documents() + [(500, "\n \n".join(prose(7 * j, 30) for j in range(4)), "en", "hot")]
    gone = boilerplate_by_host(given, line_rules.MIN_DOCS, line_rules.MAX_SHARE)
    want = {i: "\n".join(x for x in t.split("\n") if not x.strip() or (h, line_rules.line_hash(x)) not in gone)
            for i, t, _, h in given if not 100 <= i < 130}
    assert sum(want[i] != t for i, t, *_ in given if i in want) == 30
    docs = docs_of(given + [(0, given[70][1], "en", "hot"), *((i, t, "en", "odd") for i, t in odd_rows[:3])])
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.where("doc_id <> 0").unionByName(docs.where("doc_id = 0"))  # id 0 twice, with two texts
    for out in (line_rules.clean_documents(docs), corpus_pipeline.quality_rules(spark, docs, "")):
        got = out.collect()
        assert out.columns == docs.columns and out.schema["n_chars"] == docs.schema["n_chars"]
        want_rows = [*((i, t) for i, t in want.items() if i not in (1, 2, 3)), (0, given[70][1])]
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(want_rows)
        assert all(r["n_chars"] == len(r["text"]) and (r["kept"], r["id"], r["n"], r["row"]) == ("x", "y", 7, 3) for r in got)


@pytest.mark.parametrize("f", [line_rules.judge_documents, line_rules.clean_documents, trie_tokens.count_tokens, sentence_pieces.encode_documents,
                               weak_quality.classify])
def test_empty_tables(docs_of, f):
    assert f(docs_of([(1, "x")]).where("doc_id < 0")).count() == 0


def test_language(docs_of, odd_rows):
    en = [(k, "the cat and the dog of this house " + prose(k, 5), "en") for k in range(20)]
    de = [(100 + k, "der hund und die katze von dem haus " + prose(k, 5), "de") for k in range(20)]
    model = language.fit(docs_of(en + de))
    assert model.languages == ["de", "en"]
    got = rows(language.predict(docs_of([(1, "the dog"), (2, "die katzen"), (3, "hause"), (4, "123 !!"), (5, None), (6, "Ж")]), model))
    assert [got[k]["lang_pred"] for k in range(1, 6)] == ["en", "de", "de", "und", "und"]
    assert got[6]["lang_pred"] in model.languages  # a letter, but none that training knows
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = language.predict(docs_of([*odd_rows, (30, "½ ² ① ⅷ"), (31, "Ж" * 300_000)]).withColumn("score", F.lit("x")), model).collect()
    assert len(odd) == len(odd_rows) + 2 and all(0 <= r["score"] <= 1 and r["kept"] == "x" for r in odd)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in odd)
    assert words_of("हिन्दी e\u0301a ½x²") == ["हिन्दी", "e\u0301a", "x"]
    none = language.fit(docs_of(en).where("doc_id < 0"))
    assert rows(language.predict(docs_of([(1, "the dog")]), none))[1]["lang_pred"] == "und"


def test_language_backs_off_to_shorter_grams():
    model = language.model_of({"a": Counter({"abcde": 5}), "b": Counter({"vwxyz": 5})})
    for word in ("abcd", "abc", "xab", "a"):
        assert model.predict(pa.array([word]))[0] == ["a"]
    scores, known = model.word_scores(["abcde", "abc"])
    assert known.tolist() == [True, False]
    assert np.allclose(scores[0], [np.log(5.5) - np.log(5 + 0.5 * 3), np.log(0.5) - np.log(5 + 0.5 * 3)])


def plain_language(train, texts):
    """Languages and scores word by word, in plain Python; also the share of words that training knows."""
    docs = {(lang, t) for t, lang in train if lang is not None and words_of(t or "")}
    languages = sorted({lang for lang, _ in docs})
    counts = {n: {lang: Counter() for lang in languages} for n in (0, *language.NGRAMS)}
    for lang, t in docs:
        for w in words_of(t):
            counts[0][lang][w] += 1
            for n in language.NGRAMS:
                counts[n][lang].update(language.grams(w, n))
    known = {n: set().union(*own.values()) for n, own in counts.items()}

    def log(n, lang, g):
        return np.log(counts[n][lang][g] + 0.5) - np.log(sum(counts[n][lang].values()) + 0.5 * (len(known[n]) + 1))

    def score(lang, w):
        if w in known[0]:
            return log(0, lang, w)
        for n in language.NGRAMS:
            if own := [g for g in language.grams(w, n) if g in known[n]]:
                return np.mean([log(n, lang, g) for g in own])
        return 0.0
    out = []
    for t in texts:
        words = words_of(t or "")
        total = np.array([sum(score(lang, w) for w in words) for lang in languages])
        out.append(("und", 0.0, 0.0) if not words else (languages[int(np.argmax(total))], 1 / np.exp(total - total.max()).sum(),
                                                        sum(w in known[0] for w in words) / len(words)))
    return out


def test_language_query_by_brute_force(spark, docs_of, tmp_path):
    r = random.Random(4)
    stems = {"en": ["the", "of", "house", "tree"], "de": ["der", "und", "haus", "baum"], "fr": ["le", "et", "maison", "été"]}
    given = [(k, " ".join(r.choice(stems[lang]) + r.choice(["", "", "s", "en"]) for _ in range(r.randrange(1, 9))) + ".", lang)
             for k in range(90) for lang in [r.choice(list(stems))]]
    given += [(200, None, "en"), (201, "", "de"), (202, "das haus", None), (203, "12 ½", "xx"), (None, "le tree", "fr"), (3, given[3][1], given[3][2])]
    docs_of(given).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.language_id(spark, str(tmp_path)).collect()

    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    train = [(t, lang) for i, t, lang in given if i is not None and not out(i)]
    want = sorted(((i is None, i or 0), out(i), p, round(s, 6)) for (i, _, _), (p, s, _) in zip(given, plain_language(train, [t for _, t, _ in given]), strict=True))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["held_out"], r["lang_pred"], round(r["score"], 6)) for r in got) == want


def test_samples_are_bounded_by_distinct_texts(docs_of):
    rows = [(k, "copied") for k in range(300)] + [(1000 + k, f"text {k}", "de" if k % 10 else "fr") for k in range(400)]
    docs = docs_of(rows)
    assert bounded_sample(docs, "text", 100).count() == 100
    got = bounded_sample(docs, "text", 100, by="lang").groupBy("lang").agg(F.count("*"), F.countDistinct("text")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {"en": (1, 1), "de": (100, 100), "fr": (40, 40)}


def test_quality_classifier_learns_from_votes(docs_of, odd_rows):
    good = [(k, "\n".join(" ".join(prose(97 * k + j, 12).split()) + "." for j in range(8))) for k in range(150)]
    bad = [(1000 + k, " ".join(w.upper() + "!!###" for w in prose(k, 60).split())) for k in range(40)]
    got = rows(weak_quality.classify(docs_of(good + bad + odd_rows + [(2000, "x" * 300_000)]).withColumn("score", F.lit(1))))
    assert np.mean([got[i]["kept"] for i, _ in good[10:]]) > 0.95
    assert not any(got[i]["kept"] for i, _ in bad)


def test_label_model_finds_the_bad_labeller():
    r = np.random.default_rng(5)
    truth = r.random(4000) < 0.6
    n = len(weak_quality.LABELLERS)
    accuracy = np.array([0.9] * (n - 1) + [0.5])
    right = r.random((4000, n)) < accuracy
    votes = np.where(right == truth[:, None], weak_quality.GOOD, weak_quality.BAD)
    patterns = ["".join(map(str, v)) for v in votes]
    model = weak_quality.estimate(Counter(patterns))
    assert np.allclose(model.rates[:-1, 1, weak_quality.GOOD], 0.9, atol=0.03)
    assert abs(model.rates[-1, 1, weak_quality.GOOD] - 0.5) < 0.05
    assert np.mean((model.posterior(patterns) > 0.5) == truth) > 0.97


def test_trie_counts_equal_a_plain_segmentation(docs_of, odd_rows):
    scores, fallback = trie_tokens.unigram_scores()
    trie = trie_tokens.ForwardTrie(scores, fallback)

    def plain(s):
        best = [(0.0, 0)]
        for e in range(1, len(s) + 1):
            found = [(best[b][0] + scores[s[b:e]], e - b, best[b][1] + 1) for b in range(max(0, e - 40), e) if s[b:e] in scores]
            if s[e - 1] not in scores:
                size = len(s[e - 1].encode())
                found.append((best[e - 1][0] + size * trie.worst, 0, best[e - 1][1] + size))
            best.append(max(found)[::2])
        return best[-1][1]
    texts = dict(odd_rows) | {4: prose(1, 300)}
    got = trie_tokens.count_tokens(docs_of([(i, texts[i]) for i, _ in odd_rows]), max_nodes=50).collect()
    for r in got:
        own = trie_tokens.pre_tokens(texts[r["doc_id"]] or "")
        assert (r["n_pre_tokens"], r["n_tokens"]) == (len(own), sum(map(plain, own)))


def test_long_pre_tokens_count_as_in_the_trie():
    scores, fallback = trie_tokens.unigram_scores()
    trie = trie_tokens.ForwardTrie(scores, fallback)
    r = random.Random(6)
    for n in (201, 500, 3000):
        text = "".join(r.choice("abcdeééth\u2581 日😀") for _ in range(n))
        assert trie.alone(text) == trie.insert(text)
    nodes = len(trie.child)
    assert trie.count("x" * 400_000) > 0 and len(trie.child) == nodes


def test_line_rules_with_columns_of_their_own_names(docs_of):
    docs = docs_of([(k, "\n".join(prose(90 * k + j, 12) for j in range(8)) + "\nfooter of this site") for k in range(30)])
    own = {"_text": "t", "_cut": "c", "_host": "h", "_hash": "s", "_id": "i", "_gone": "g", "_row": "r"}
    for name, value in own.items():
        docs = docs.withColumn(name, F.lit(value))
    got = line_rules.clean_documents(docs).collect()
    assert len(got) == 30 and not any("footer" in r["text"] for r in got)
    assert all(r[name] == value for r in got for name, value in own.items())


def test_sentence_pieces_equal_the_library(docs_of, odd_rows):
    import sentencepiece
    own = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path(None))
    extra = [(18, "hello world "), (19, "a "), (20, "  two  spaces "), (21, "<s> </s> <0x0A> ▁"), (22, "a\n\nb")]
    given = dict(odd_rows + extra)
    tokens = sentence_pieces.encode_documents(docs_of(odd_rows + extra))
    for r in tokens.collect():
        ids = own.encode(given[r["doc_id"]] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["parity"]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r["round_trip"] == (r["doc_id"] != 21)  # a marker in the text is a space afterwards
    back = {r["doc_id"]: r["text"] for r in sentence_pieces.decode_documents(tokens).collect()}
    assert all(back[i] == (t or "") for i, t in odd_rows)
    with open(sentence_pieces.model_path(None), "rb") as f:
        whole = sentence_pieces.rebuild(f.read())
    assert whole.encode(given[20], add_special_tokens=False).ids == own.encode(given[20])


def test_byte_level_chunks_equal_whole_texts():
    e = token_files.BatchEncoder()
    texts = ["", " ", "a  b", "a\n b", "a \nb", "x <|endoftext|> y", "日本 語　 x", "a\x85 b", "it's don't", " \t a", "a b\n", prose(3, 500)]
    assert [i.tolist() for i in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
