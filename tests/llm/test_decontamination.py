import hashlib
import random
import re

import pytest

from gridloom.llm import decontamination as D

DOCS = "doc_id long, text string, lang string, items string, _spans int, pattern string"
ITEMS = "item_id long, text string, w string, item int"
WORDS = re.compile(D.WORD)


def norm(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width):
    out = {}
    for doc_id, text in docs:
        w, hit, ids = norm(text), set(), set()
        for item_id, other in items:
            v = norm(other)
            k = min(len(v), width)
            for a in range(len(v) - k + 1 if k else 0):
                for s in range(len(w) - k + 1):
                    if w[s : s + k] == v[a : a + k]:
                        hit |= set(range(s, s + k))
                        ids |= {str(item_id)} if item_id is not None else set()
        out[doc_id] = (len(w), sorted(hit), sorted(ids))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, None, "x", 3, "p") for i, t in docs], DOCS), spark.createDataFrame([(i, t, "w", 1) for i, t in items], ITEMS)


def got(spark, docs, items, **kw):
    d, b = frames(spark, docs, items)
    return {r.doc_id: r for r in D.scan(spark, d, b, ["doc_id"], **kw).collect()}


@pytest.mark.parametrize("part", [D.PART, 60])
def test_equals_brute_force(spark, part):
    rng = random.Random(part)
    vocabulary = ["a", "b", "Ab", "é", "ÉÀ", "x1", "naïve", "日本"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--", "  "]) for _ in range(n))
    items = [(i, text(rng.randint(0, 12))) for i in range(12)] + [(None, text(5)), (3, text(6)), (40, None), (41, "?!")]
    docs = [(i, text(rng.randint(0, 200))) for i in range(60)] + [(100, None), (101, ""), (102, "...")]
    want = brute(docs, items, 4)
    assert any(w[1] for w in want.values()) and any(not w[1] for w in want.values())
    for i, r in got(spark, docs, items, width=4, part=part).items():
        hit = [p for s in r._spans for p in range(s["first"], s["last"] + 1)]
        assert (r._n_words, hit, r._items) == want[i]


def test_offsets_are_those_of_the_original(spark):
    text = "İ  The QUICK—brown\tFox, jumped 😀 over"
    (r,) = got(spark, [(1, text)], [(7, "quick—brown fox")], width=3).values()
    assert [text[s["start"] : s["end"]] for s in r._spans] == ["QUICK—brown\tFox"]
    assert r._items == ["7"]


def test_long_text_many_hits_and_empty_tables(spark):
    words = "one two three four five six seven eight nine ten eleven"
    (r,) = got(spark, [(1, f"{words} " * 20_000)], [(1, words), (2, "eleven one two")]).values()
    assert len(r._spans) == 1 and r._spans[0]["last"] == 219_999 and r._items == ["1", "2"]
    d, b = frames(spark, [], [])
    assert D.scan(spark, d, b, ["doc_id"]).count() == 0
    (r,) = got(spark, [(1, words)], []).values()
    assert r._items == [] and r._spans == [] and r._n_words == 11


def test_decontaminate_keeps_rows_and_columns(spark):
    words = "one two three four five six seven eight nine ten"
    d, b = frames(spark, [(1, f"Zero, {words.upper()}!"), (2, "one two"), (2, "one two"), (3, None), (4, f"{words} " + "z " * 90)], [(1, words)])
    assert sorted(r.doc_id for r in D.decontaminate(spark, d, b).collect()) == [2, 2, 3]
    kept = D.decontaminate(spark, d, b, most=0.2)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2, 3, 4]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = D.op13_decontamination(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    tables = {}
    for item_id, text in items:
        v = norm(text)
        k = min(len(v), D.WINDOW)
        for a in range(len(v) - k + 1 if k else 0):
            tables.setdefault(tuple(v[a : a + k]), set()).add(str(item_id))
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    texts = dict(docs)
    for r in rows:
        w = norm(texts[r.doc_id])
        hit, ids = set(), set()
        for k in {len(t) for t in tables}:
            for s in range(len(w) - k + 1):
                if found := tables.get(tuple(w[s : s + k])):
                    hit |= set(range(s, s + k))
                    ids |= found
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
