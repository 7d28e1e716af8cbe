import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gridloom.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, c long, key string"


def rebuilt(rows, graft=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    if not graft:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    base = {c: c - abs(c) % 100 * (1 if c >= 0 else -1) for c in own}  # towards zero
    return {c: own.get(base[c], [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(paths):
    members, children = defaultdict(list), defaultdict(set)
    for c in sorted(paths):
        p = paths[c]
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
            if d:
                children[tuple(p[: d - 1])].add(tuple(p[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children.get(node)
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1]) if node else 0)
    out = set()
    for node, who in members.items():
        ends = ",".join(str(c) for c in who if len(paths[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.add((who[0], len(node), parent, len(who), len(children.get(node, ())), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA)


def found(spark, rows, graft=True):
    numbered = P.turns(frame(spark, rows))
    return [tuple(r) for r in P.trie(spark, *(P.grafted if graft else P.plain)(numbered)).collect()]


def cases(rng, n, turns, texts):
    rows = []
    for c in rng.sample(range(-250, 600), n):
        rows += [(c, rng.choice([None, i, i, i]), rng.choice(["user", "bot", None]), rng.choice(texts)) for i in range(rng.randint(1, turns))]
    return rows


@pytest.mark.parametrize("seed,n,turns,graft", [(1, 150, 8, True), (2, 40, 30, False), (3, 200, 4, True)])
def test_equals_brute_force(spark, seed, n, turns, graft):
    rng = random.Random(seed)
    rows = cases(rng, n, turns, ["a", "b😀", "", None, "a longer text"])
    got = found(spark, rows, graft)
    assert len(got) == len(set(got)) and set(got) == brute(rebuilt(rows, graft))


def test_blocks_copies_and_ends(spark, monkeypatch):
    """Conversations beyond a block, copies of one, ends on the way down, branches at a block's end."""
    monkeypatch.setattr(P, "BLOCK", 4)
    monkeypatch.setattr(P, "CHUNK", 10)
    rows = []
    for c in range(40):
        rows += [(c, i, "user", f"t{i}") for i in range(30 if c % 3 else 8 + c % 5)]
        rows += [(c, 50, "user", f"end{c % 4}")] if c % 2 else []
    got = found(spark, rows, graft=False)
    assert len(got) == len(set(got)) and set(got) == brute(rebuilt(rows, graft=False))


def test_small_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
    # one conversation that the graft leaves without turns: the root alone, a leaf
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0)
    assert found(spark, [(c, 0, "user", "x")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_role_and_text_are_told_apart(spark):
    rows = [(1000, 0, "ab", "c"), (2000, 0, "a", "bc"), (3000, 0, None, "abc"), (4000, 0, "abc", None)]
    assert set(found(spark, rows, graft=False)) == brute(rebuilt(rows, graft=False))


def test_long_texts_and_repeated_rows(spark):
    rows = [(5, 0, "user", "x" * 300_000)] * 3 + [(7, 0, "user", "x" * 300_000)]
    assert set(found(spark, rows, graft=False)) == brute(rebuilt(rows, graft=False))
