"""Personal data: base spans against plain patterns, the pattern graph against a plain version, planted contexts."""

import hashlib
import random
import re
from collections import defaultdict

from conftest_llm import prose

from lineaweave.llm import contextual_pii as C

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = [int(c) for c in m.group() if c in "0123456789"]
            doubled = [x * 2 - 9 * (x > 4) if i % 2 else x for i, x in enumerate(reversed(d))]
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 14 <= len(d) <= 19 and sum(doubled) % 10 == 0
                    or k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    r = random.Random(1)
    for _ in range(30_000):
        alphabet = r.choice(["1.2 ", "a@.b-", "0123456789.", "+1 ().-2", "a1@.+-() 0", "09 -", "é1@.a٣"])
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
        assert C.base_spans(text) == plain_spans(text), text


def test_very_long_texts_take_linear_time():
    for text in ["1" * 1_000_000, "a" * 1_000_000 + "@", "1 " * 300_000, "a" * 500_000 + "@b.c", "+" + "1 " * 300_000]:
        assert C.base_spans(text) == ([(0, 0, len(text))] if text.endswith("c") else [])


def planted():
    """Seeds behind a label in many texts, strangers behind the same label, and identifiers among arbitrary words."""
    rows = [(k, f"{prose(k, 8)} Reach me by phone: +1 (5{k:02d}) 555-01{k:02d} {prose(100 + k, 5)}") for k in range(12)]
    rows += [(20 + k, f"{prose(200 + k, 8)} Reach me by phone: 0{k}71 555 66{k:02d} or so") for k in range(2)]
    rows += [(30 + k, f"{prose(300 + k, 6)} mail: user{k}@mail.example.com {prose(400 + k, 6)}") for k in range(12)]
    rows += [(45, "my mail: user99(at)mail.example.com"), (46, f"{prose(9, 9)} 4444333322221 {prose(10, 9)}")]
    rows += [(50, None), (51, ""), (52, "+1 (501) 555-0101"), (None, "mail: user1@mail.example.com"), (1, rows[1][1]), (54, " \n")]
    return rows


def plain_learn(found):
    """Accepted patterns and unknown instances, in plain Python."""
    edges, seeds = defaultdict(set), defaultdict(set)
    for occurrences in found:
        for o in occurrences:
            if o["kind"] >= 0:
                seeds[o["instance"]].add(o["kind"])
            for p in o["patterns"]:
                edges[p].add(o["instance"])
    known = {(i, k): 1.0 for i, ks in seeds.items() for k in ks}
    before = None
    for _ in range(C.ROUNDS):
        accepted = {}
        for p, own in edges.items():
            for k in range(4):
                scores = [known[i, k] for i in own if (i, k) in known]
                if sum(s >= C.MIN_SCORE for s in scores) >= C.MIN_SEEDS and sum(scores) / (len(own) + C.SMOOTHING) >= C.MIN_CONFIDENCE:
                    accepted[p, k] = sum(scores) / (len(own) + C.SMOOTHING)
        state = len(accepted), round(sum(accepted.values()), 6)
        if state == before:
            break
        before, miss = state, defaultdict(lambda: 1.0)
        for (p, k), c in accepted.items():
            for i in edges[p]:
                miss[i, k] *= 1 - c
        best = {}
        for (i, k), m in miss.items():
            if i not in seeds and (1 - m, -k) > best.get(i, (-1, 0)):
                best[i] = (1 - m, -k)
        known = {x: s for x, s in known.items() if x[0] in seeds} | {(i, -k): s for i, (s, k) in best.items()}
    return accepted, {(i, k): s for (i, k), s in known.items() if i not in seeds and s >= C.MIN_SCORE}


def test_patterns_find_unseen_identifiers(spark, docs_of):
    rows = planted()
    docs = docs_of(rows)
    found = C.scan(docs).persist()
    patterns, unknown = C.learn(found)
    want_patterns, want_unknown = plain_learn([r["seen"] for r in found.collect()])
    assert {(r["pattern"], r["kind"]): round(r["confidence"], 9) for r in patterns.collect()} == {k: round(v, 9) for k, v in want_patterns.items()}
    assert {(r["instance"], r["kind"]): round(r["score"], 5) for r in unknown.collect()} == {k: round(v, 5) for k, v in want_unknown.items()}
    assert ("by phone: _", 3) in want_patterns and ("mail: _", 0) in want_patterns

    out = sorted((r.asDict() for r in C.personal_data(docs).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    for k, text in rows:
        base = ",".join(f"{C.KINDS[kind]}:{s}:{e}" for s, kind, e in plain_spans(text or ""))
        assert by[k]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [by[k][f"n_{x}"] for x in C.KINDS] == [base.count(x) for x in C.KINDS]
        if k not in (20, 21, 45):
            assert by[k]["spans"] == base and by[k]["n_added"] == 0
    for k, surface, kind in ((20, "071 555 6600", "phone"), (21, "0171 555 6601", "phone"), (45, "user99(at)mail.example.com", "email")):
        text = dict(rows)[k]
        at = text.index("phone: ") + 7 if kind == "phone" else text.index(surface)
        assert by[k]["spans"] == f"{kind}:{at}:{at + len(text[at:].split(' or')[0])}" and by[k]["n_added"] == 1


def test_odd_rows_and_nothing(docs_of, odd_rows):
    rows = odd_rows + [(40, "x" * 400_000 + " a@b.c"), (41, "1" * 400_000)]
    out = C.personal_data(docs_of(rows)).collect()
    assert len(out) == len(rows)
    assert {r["spans"] for r in out if r["doc_id"] == 40} == {"email:400001:400006"}
    assert C.personal_data(docs_of([])).collect() == []
