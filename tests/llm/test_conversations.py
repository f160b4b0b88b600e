"""The prefix tree and the structure repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from lineaweave.llm import prefix_tree, structure_repair

COLUMNS = "conv_id long, turn long, role string, text string, key string, pos int, depth int, n long, symbols string, audit string, body int"


@pytest.fixture(scope="module")
def conversations_of(spark):
    """Conversations with columns whose names the operators use themselves."""
    def make(rows):
        return spark.createDataFrame([(*r, "k", 1, 2, 3, "s", "K", 0) for r in rows], COLUMNS).repartition(3)
    return make


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def random_rows(seed, convs, deep=0):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(r.randrange(9) + (deep if c % 17 == 0 else 0)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", r.choice(["Hi.", "yes", "é😀"]) if t < 3 else r.choice("ab") * 3))
    return rows


def odd_conversations():
    """Null, tied, repeated, blank and very long rows."""
    return [(50, None, "user", "first"), (50, 1, None, "x."), (50, 1, "user", None), (50, 1, "user", None), (51, 0, "user", ""),
            (51, 1, "assistant", " \n"), (52, None, None, None), (None, 0, "user", "nobody."), (None, None, None, None),
            (53, 0, "system", "s."), (53, 5, "user", "u" * 300_000 + "."), (53, 9, "tool", "x"), (54, 0, "user", "a."), (54, 0, "user", "b.")]


def tree(rows, shared):
    """The tree's nodes by sets of prefixes."""
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, role or "", md5(text or ""), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(ts)] for c, ts in by.items()}
    if shared:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
        own = {c: own.get(c - c % 5, [])[:h[c]] + ts[h[c]:] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in own.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        cost = (len(cs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += cost
    return sorted((min(cs), len(n), min(members[n[:-1]]) if n else -1, len(cs), kids[n], leaves[n], saved[n],
                   sha(",".join(map(str, sorted(ends[n]))))) for n, cs in members.items())


def found(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"],
                   r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


@pytest.mark.parametrize(("width", "sharers"), [(1, 5), (256, 5), (2, None)])
def test_tree_equals_sets_of_prefixes(conversations_of, width, sharers):
    rows = random_rows(width, 60) + odd_conversations()
    out = prefix_tree.conversation_tree(conversations_of(rows), sharers=sharers, width=width)
    assert found(out) == tree(rows, sharers is not None)


def test_tree_of_deep_and_equal_conversations(conversations_of):
    rows = random_rows(7, 30, deep=120) + [(100 + c, t, "user", f"same {t}") for c in range(40) for t in range(6)]
    rows += [(200 + c, t, "user", f"same {t}" if t < 5 else f"own {c}") for c in range(20) for t in range(7)]
    assert found(prefix_tree.conversation_tree(conversations_of(rows), width=4)) == tree(rows, False)


def test_tree_joins_ids_across_blocks(conversations_of):
    rows = [(c, 0, "user", "x") for c in (-5000, -1, 0, 4095, 4096, 9000)]
    assert found(prefix_tree.conversation_tree(conversations_of(rows), width=1)) == tree(rows, False)


def test_trees_and_repairs_of_nothing(conversations_of):
    empty = conversations_of([])
    assert prefix_tree.conversation_tree(empty).collect() == []
    assert structure_repair.repair_conversations(empty).collect() == []


LEGAL = re.compile(r"(s?(ua)+)?\Z")


def edits(rows):
    """Cheapest (cost, audit) and the repaired rows, by trying all edits of a few rows with inserts of bounded number."""
    best = None
    seen = set()
    kinds = []
    for role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        blank, dup = not body.strip(" \t\n\v\f\r"), (role, text) in seen
        seen.add((role, text))
        kinds.append((blank or dup, body[-1:] not in (".", "!", "?")))
    def go(k, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        line = "".join(r[:1] or "?" for r, _ in out)
        if k == len(rows):
            for extra in range(3):
                for roles in itertools.product(("user", "assistant"), repeat=extra):
                    if LEGAL.match(line + "".join(r[0] for r in roles)):
                        new = (cost + 2 * extra, audit + "I" * extra, [*out, *[(r, "") for r in roles]])
                        best = new if best is None or new[:2] < best[:2] else best
            return
        (role, text), (gone, cut) = rows[k], kinds[k]
        for extra in range(3):
            for roles in itertools.product(("user", "assistant"), repeat=extra):
                grown = [*out, *[(r, "") for r in roles]]
                if not re.match(r"s?(ua)*u?\Z", "".join(r[:1] or "?" for r, _ in grown)):
                    continue
                ways = [(3, "D", None)]
                if not gone:
                    ways += [(0, "K", role), (2, "R", "user"), (2, "R", "assistant")]
                for price, letter, new in ways:
                    go(k + 1, cost + 2 * extra + price + (cut and letter != "D"), audit + "I" * extra + letter, grown + ([(new, text)] if new is not None else []))
    go(0, 0, "", [])
    return best[0], best[1], "\n".join(f"{r}:{t}" for r, t in best[2])


def test_repairs_equal_trying_all_edits(conversations_of):
    r = random.Random(3)
    rows = [(c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", "system", "tool", "user", ""]), r.choice(["a.", "b!", "c", " ", "d. \n", ""]))
            for c in range(40) for t in range(r.randrange(1, 5)) if r.random() < 0.9]
    rows += odd_conversations()[:9]
    out = {x["conv_id"]: x for x in structure_repair.repair_conversations(conversations_of(rows), with_text=True).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        by[c].append((t is not None, t or 0, role, md5(text), text))
    assert set(out) == set(by)
    for c, own in by.items():
        own = sorted(own)
        cost, audit, body = edits([(x[2], x[4]) for x in own])
        x = out[c]
        assert (x["cost"], x["audit"], x["repaired_sha256"], "\n".join(x["repaired"])) == (cost, audit, sha(body), body), own
        turns = [k for there, k, *_ in own if there]
        assert x["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert x["illegal"] == sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))


def test_rules_do_not_change_the_edits():
    r = random.Random(9)
    matrices = structure_repair.rule_matrices([])
    for _ in range(300):
        s = "".join(r.choice(structure_repair.SYMBOLS) for _ in range(r.randrange(40)))
        packed, rules = s, []
        for _ in range(6):
            pairs = [a + b for a, b in zip(packed, packed[1:], strict=False)]
            if not pairs:
                break
            rules.append(r.choice(pairs))
            packed = packed.replace(rules[-1], chr(structure_repair._FIRST_RULE + len(rules) - 1))
        assert structure_repair.cheapest(packed, structure_repair.rule_matrices(rules)) == structure_repair.cheapest(s, matrices)


def test_long_conversations_and_lost_ones(conversations_of):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(600)] + [(2, 0, "user", "x" * 200_000 + ".")]
    ids = conversations_of([(c, 0, "user", "gone") for c in (1, 2, 3)])
    out = {x["conv_id"]: x for x in structure_repair.repair_conversations(conversations_of(rows), ids).collect()}
    assert (out[1]["cost"], out[1]["audit"]) == (0, "K" * 600)
    assert (out[2]["cost"], out[2]["audit"]) == (2, "KI")
    assert (out[3]["cost"], out[3]["audit"], out[3]["repaired_sha256"]) == (0, "", sha(""))


def test_damage_by_checksum(conversations_of):
    rows = [(c, t, "assistant", "A. B! C?") for c in range(30) for t in range(4)] + [(None, None, None, None), (7, None, None, None)]
    out = defaultdict(list)
    for x in structure_repair.damage(conversations_of(rows)).collect():
        out[x["conv_id"], x["turn"]].append((x["role"], x["text"]))
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = {0: [], 1: [(role, "")], 2: [(role, text.translate(str.maketrans("", "", ".!?")))], 3: [(role, text)] * 2, 4: [("user", text)]}
        assert out[c, t] == want.get(hit, [(role, text)])
