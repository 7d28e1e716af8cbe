import random
import re

import numpy as np
import pyarrow as pa

from gridloom.llm import quality
from gridloom.llm.textkernel import Words, text_slices

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, probability string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def texts():
    rng = random.Random(1)
    out = [None, "", " ", "\n", "a", "\n\na\n", "é ß #|$ x", "a b c d e a b c d e", "x\nx\nx", "a a a a a a a", " x\nx \nx", "same\n\nsame\n \n", " nbsp ", "w" * 40]
    for _ in range(150):
        out.append("".join(rng.choice(["a", "b", "é", "##", "日"]) + rng.choice([" ", "\n", "  ", "\t", ""]) for _ in range(rng.randint(0, 60))))
    return out


def test_base_counts_match_brute_force(spark):
    data = texts()
    docs = spark.createDataFrame([(i, t, None, None, 1, None, "p") for i, t in enumerate(data)], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in quality.judge_documents(docs, None).collect()}
    for i, t in enumerate(data):
        want = plain(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed)
    assert quality.judge_documents(spark.createDataFrame([], SCHEMA), None).count() == 0


def test_slices_of_nulls_and_offsets():
    data = texts()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(data))), pa.array(data)], names=["i", "t"]).slice(3, 100)
    seen = []
    for low, high, buffer, offsets in text_slices(batch, span=37):
        words = Words(buffer, offsets, True)
        seen += [int(c) for c in words.counts]
        assert len(words.starts) == len(words.ends) and high > low
    assert seen == [plain(t)[0] for t in data[3:103]]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(rng.randint(30, 120))]
        bad = rng.random() < 0.3
        if bad:
            words = [w + rng.choice(["###", "$$$"]) for w in words] if rng.random() < 0.5 else [w for x in words for w in (x, "|")]
        out.append((i, " ".join(words), int(not bad)))
    return out


def test_held_out_accuracy_and_threshold(spark):
    train, test = corpus(500, 1), corpus(300, 2)
    model = quality.fit([t for _, t, _ in train], [y for *_, y in train])
    docs = spark.createDataFrame([(i, t, None, None, 1, None, "p") for i, t, _ in test], SCHEMA)
    got = {r.doc_id: r for r in quality.judge_documents(docs, model).collect()}
    right = np.mean([got[i].kept == bool(y) for i, _, y in test])
    assert right > 0.97
    assert all(got[i].kept for i, _, y in test if y)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}


def test_labels_of_one_kind_keep_all(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", None, None, 1, None, "p")], SCHEMA)
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert model is None and quality.keep_good(docs, model).count() == 1


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_regular_words_do_not_collide(spark):
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    text = f"{word}\n{other}\n{word}x\n{word}\n" + " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, text, None, None, 1, None, "p"), (2, "z" * 3000 + "\n" + "z" * 2999 + "y\n" + "z" * 3000, None, None, 1, None, "p")], SCHEMA)
    got = {r.doc_id: r for r in quality.judge_documents(docs, None).collect()}
    assert (got[1].n_dup_lines, got[2].n_dup_lines) == (1, 1)


def test_character_grams_are_characters():
    texts = ["aébc日", "ébc日", "", "abc", "abcd"]
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    words = Words(np.frombuffer("".join(texts).encode(), np.uint8), offsets, False)
    grams, text = quality.character_grams(words)
    assert text.tolist() == [0, 0, 1, 4] and grams[1] == grams[2] and len({*grams.tolist()}) == 3


def test_the_fit_takes_the_memory_of_a_slice(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(5)
    words = np.array([f"{a}{b}" for a in ("so", "ta", "mi", "ul", "ker") for b in range(2_000)])
    texts = [" ".join(words[rng.integers(0, len(words) // (1 + k % 2), 600)]) for k in range(500)]
    labels = [k % 2 for k in range(500)]
    tracemalloc.start()
    found = quality.fit(texts, labels, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * sum(map(len, texts))
    # the slices make no difference
    monkeypatch.setattr(quality, "FIT_SPAN", 1 << 30)
    whole = quality.fit(texts, labels, 3)
    assert (found["weights"] == whole["weights"]).all() and all(found[k] == whole[k] for k in ("bias", "slope", "level"))
