import itertools
import random

import numpy as np

from gridloom.llm import toxicity as tox

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, held_out string"


def features(word):
    codes = [int(tox._CODES[ord(c)]) for c in word if ord(c) < len(tox._CODES) and tox._CODES[ord(c)]]
    out = {}
    for i, j, k in itertools.combinations(range(len(codes)), 3):
        if k - i < tox.REACH:
            key = codes[i], codes[j], codes[k]
            out[key] = out.get(key, 0) + tox.DECAY ** (k - i + 1)
    return out


def plain_kernel(a, b):
    f, g = features(a), features(b)
    dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
    norm = np.sqrt(dot(f, f) * dot(g, g))
    return dot(f, g) / norm if norm else 0.0


def test_kernel_matches_brute_force():
    words = ["idiot", "idi.ot", "1d10t", "banana", "ab", "vequté", "a" * 20, "mississippi", "x-y-z", "日本語です"]
    got = tox.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(got[i, j] - plain_kernel(a, b)) < 1e-9, (a, b)


def corpus(n, seed, spoil=False):
    rng = random.Random(seed)
    bad = ["grobnik", "zurvapo", "klimtoz", "wexaful"]
    out = []
    for i in range(n):
        words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(rng.randint(10, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            w = rng.choice(bad)
            if spoil:
                k = rng.randint(1, len(w) - 1)
                w = rng.choice([w[:k] + rng.choice("-*.x") + w[k:], " ".join(w)])
            words.insert(rng.randint(0, len(words)), w)
        out.append((i, " ".join(words) + ".", int(toxic)))
    return out


def test_folded_decision_is_the_sum_over_landmarks_and_generalises():
    train = corpus(400, 1)
    model = tox.fit([t for _, t, _ in train], [y for *_, y in train])
    words = ["grobnik", "gro-bnik", "zurvapo", "etaoin", "klimtozz", "onto"]
    exact = tox.Strings(words).dot(model["weights"]) / np.maximum(tox.Strings(words).norms(), 1e-12) + model["bias"]
    np.testing.assert_allclose(tox.decisions(words, model["weights"], model["bias"]), np.maximum(exact, tox.FLOOR), atol=1e-9)
    for spoil in (False, True):
        test = corpus(200, 7 + spoil, spoil)
        top = np.array([tox.decisions(sorted(tox.words_of(t)), model["weights"], model["bias"]).max() for _, t, _ in test])
        y = np.array([y for *_, y in test])
        auc = (top[y == 1][:, None] > top[y == 0]).mean()
        assert auc > (0.97 if spoil else 0.995)


def test_query_shape_and_odd_rows(spark):
    data = corpus(300, 3)
    docs = [(i, t, None, None, 1, "c", "c") for i, t, _ in data] + [(900, None, None, None, 0, "", ""), (901, "", None, None, 0, "", ""), (902, "w" * 9000, None, None, 0, "", ""), (None, "x", None, None, 0, "", ""), (5, data[5][1], None, None, 1, "c", "c")]
    frame = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = tox.score_documents(frame, tox.train(frame, labels)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    from zlib import crc32

    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, data[r.doc_id][2]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(r.score == 0 for r in tox.score_documents(frame, None).collect())
    assert tox.score_documents(spark.createDataFrame([], SCHEMA), None).count() == 0
    assert tox.train(spark.createDataFrame([], SCHEMA), labels) is None
