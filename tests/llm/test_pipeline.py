import random
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from gridloom.llm import mixing, packing, quality
from tests.llm.test_ngram_join import brute
from tests.llm.test_pii import base
from tests.llm.test_quality import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 7)))
    rows, labels = [], []
    for i in range(160):
        words = [word() for _ in range(rng.randint(12, 90))]
        bad = i % 5 == 0
        if bad:
            words = [w + "###" for w in words]
        if i % 7 == 1:
            words.insert(5, f"user{i}@mail.example.org")
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 1))
        labels.append((i, int(not bad), 0))
    for k in range(160, 185):
        words = rows[k - 150][1].split()
        words[-1] = "changed"
        rows.append((k, " ".join(words), "en", "s1", 1))
    rows += [(185, None, None, None, None), (186, "", "en", "s1", 0), (187, "too short", "en", "s2", 1), (11, rows[11][1], "en", "s2", 1)]
    return rows, labels


def test_stages_take_effect(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    good, single, clean, mixed, pieces = seen
    text = {r[0]: r[1] for r in rows}
    failed = {d for d, t in text.items() if (n := plain(t))[0] < 10 or 100 * n[4] > 20 * n[0]}
    bad = {i for i, q, _ in labels if not q} | {k for k in range(160, 185) if (k - 150) % 5 == 0}
    assert {r.doc_id for r in good} == set(text) - failed - bad
    links = {int(d): int(c) for d, _, c in brute([(r.doc_id, r.text) for r in good])}
    assert Counter(r.doc_id for r in single) == Counter({d: 1 for d, c in links.items() if d == c})
    assert len(single) < len(good)
    for r in clean:
        assert ("[email]" in r.text) == any(k == "email" for *_, k in base(text[r.doc_id])) and "@" not in r.text
    again = spark.createDataFrame(clean, SCHEMA)
    want = {r.doc_id: r.copies for r in mixing.sample(spark, again).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed) == Counter(want)
    by_bin, length = defaultdict(int), Counter()
    for p in pieces:
        by_bin[p.sequence_id] += p.length
        length[p.doc_id] += p.length
    encode = packing.encoder(packing.tokenizer_path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in clean}
    assert all(length[d] == k * (len(encode.batch([texts[d]])[0]) + 1) for d, k in want.items())
    assert max(by_bin.values()) <= 4096 and len(by_bin) == -(-sum(length.values()) // 4096)


def test_run_equals_its_stages(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 50
    assert quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")) is not None
    assert np.isfinite(out.count())
