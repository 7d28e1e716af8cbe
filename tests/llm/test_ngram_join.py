import random
import re

import numpy as np
import pytest

from gridloom.llm import ngram_join
from gridloom.llm.components import components
from gridloom.llm._common import Stage
from gridloom.llm.textkernel import Sent

SCHEMA = "doc_id long, text string, lang string, node string, n long, component_id int, token string"


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(data):
    sets = [shingles(t) for _, t in data]
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            r = root(i)
            least[r] = min(least.get(r, d), d)
    return sorted((str(d), len(sets[i]), str(least.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(data))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    fixed = [None, "", "  \n", "one", "ONE", "a b c d", "a B\tc  d", "a b c d e", "x " * 30, "x " * 50, "ÀB c d e f", "àb c d e f"]
    passage = [word() for _ in range(30)]
    out = list(fixed)
    for _ in range(12):
        base = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                k = rng.randrange(len(copy))
                copy[k : k + rng.randint(0, 1)] = [word()]
            if rng.random() < 0.2:
                copy = [w.upper() for w in copy]
            out.append(" ".join(copy))
    for _ in range(25):
        out.append(" ".join([word() for _ in range(rng.randint(0, 20))] + passage + [word() for _ in range(rng.randint(0, 20))]))
    base = [word() for _ in range(60)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(i * 3, out[k]) for i, k in enumerate(order)] + [(6, out[order[2]]), (6, out[order[2]]), (None, out[order[4]]), (None, "only null id")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    data = corpus(seed)
    docs = spark.createDataFrame([(d, t, None, "n", 1, 2, "t") for d, t in data], SCHEMA).repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.similarity_join(spark, docs).collect())
    assert got == brute(data)


def test_last_round_alone_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 0)
    data = corpus(3)
    docs = spark.createDataFrame([(d, t, None, "n", 1, 2, "t") for d, t in data], SCHEMA)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.similarity_join(spark, docs).collect())
    assert got == brute(data)


def test_empty_and_all_null(spark):
    assert ngram_join.similarity_join(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, None, None, "n", 1, 2, "t"), (2, "", None, "n", 1, 2, "t")], SCHEMA)
    assert sorted(map(tuple, ngram_join.similarity_join(spark, docs).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(9)
    ids = list(range(300))
    rng.shuffle(ids)
    links = [(ids[i], ids[i + 1]) for i in range(0, 120)] + [(ids[150], ids[i]) for i in range(151, 250)] + [(ids[260], ids[261]), (ids[261], ids[260]), (5, 5), (None, 1)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(Stage(spark, "t"), frame).collect()}
    assert all(got[ids[i]] == min(ids[:121]) for i in range(121))
    assert all(got[ids[i]] == min(ids[150:250]) for i in range(150, 250))
    assert got[ids[260]] == min(ids[260], ids[261])


def test_regular_words_do_not_collide(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word, None, "n", 1, 2, "t"), (2, other, None, "n", 1, 2, "t"), (3, word, None, "n", 1, 2, "t")], SCHEMA)
    assert sorted(map(tuple, ngram_join.similarity_join(spark, docs).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_ways_beyond_the_bounds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join, "BUCKET_KEYS", 50)
    monkeypatch.setattr("gridloom.llm._common.HEAVY", 3)
    data = corpus(4)
    docs = spark.createDataFrame([(d, t, None, "n", 1, 2, "t") for d, t in data], SCHEMA).repartition(2)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.similarity_join(spark, docs).collect())
    assert got == brute(data)
    kept = sorted(r.doc_id for r in ngram_join.keep_one(spark, docs).collect() if r.doc_id is not None)
    assert kept == sorted({int(d) for d, _, c in brute(data) if d == c and d != "None"})


def test_sent_keys_are_told_apart():
    rng = np.random.default_rng(1)
    sent, counts, asked = Sent(16), {}, {}
    for _ in range(200):
        keys = np.sort(rng.integers(0, 60, 25)).astype(np.uint64)
        for k, ask in zip(keys.tolist(), sent.split(keys).tolist(), strict=True):
            counts[k] = counts.get(k, 0) + 1
            asked[k] = asked.get(k, 0) + ask
            assert ask or counts[k] > 2 and asked[k] >= 2
    assert all(asked[k] >= min(2, n) for k, n in counts.items()) and sum(asked.values()) < 0.9 * sum(counts.values())
