import hashlib
import random

from gridloom.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, lang string, spans string, low long, key int, doc string"


def test_suffix_array_matches_sorting():
    rng = random.Random(1)
    for size in (0, 1, 2, 3, 7, 30, 200):
        for letters in (1, 2, 3, 26):
            for _ in range(30):
                text = [rng.randrange(letters) for _ in range(size)]
                assert sd.suffix_array(text) == sorted(range(size), key=lambda i: text[i:])
    text = list(b"abracadabra" * 20)
    suffixes = sd.suffix_array(text)
    assert suffixes == sorted(range(len(text)), key=lambda i: text[i:])


def brute(data):
    first = {}
    order = lambda d: (d is None, d or 0)
    for d, t in data:
        b = (t or "").encode()
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            first[w] = min(first.get(w, (order(d), i)), (order(d), i))
    out = []
    for d, t in data:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if first[b[i : i + 100]] < (order(d), i):
                gone[i : i + 100] = b"\1" * 100
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((str(d), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices("abcde é\n", k=n))
    passages = [text(n) for n in (60, 99, 100, 101, 150, 400, 1500)]
    out = [None, "", "x", "y" * 99, "y" * 100, "y" * 350, "ab" * 200, "é" * 120, text(3000)]
    for _ in range(90):
        out.append("".join(rng.choice([text(rng.randint(0, 200)), rng.choice(passages)]) for _ in range(rng.randint(1, 5))))
    for _ in range(10):
        base = list(out[8])
        for _ in range(rng.randint(0, 12)):
            base[rng.randrange(len(base))] = "Z"
        out.append("".join(base))
    rng.shuffle(out)
    data = [(i, t) for i, t in enumerate(out)]
    return [*data, data[20], data[20], (30, data[40][1]), (None, data[50][1]), (None, data[50][1]), (None, text(300))]


def test_removal_matches_brute_force(spark):
    for seed in (1, 2):
        data = corpus(seed)
        docs = spark.createDataFrame([(d, t, None, "s", 1, 2, "d") for d, t in data], SCHEMA).repartition(4)
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(spark, docs).collect())
        assert got == brute(data)


def test_suffix_array_finds_the_same(spark):
    data = [(d, t) for d, t in corpus(3) if d is not None and t and len(t) < 1200][:40]
    spans = sd.repeats_by_suffix_array([(d, t.encode()) for d, t in data])
    want = brute(data)
    got = []
    for (d, t), removed in zip(data, spans, strict=True):
        b, at, kept = t.encode(), 0, b""
        for x, y in removed:
            kept, at = kept + b[at:x], y
        got.append((str(d), len(b), sum(y - x for x, y in removed), len(removed), hashlib.sha256(kept + b[at:]).hexdigest()))
    assert sorted(got) == want


def test_empty(spark):
    assert sd.remove_repeats(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, None, None, "s", 1, 2, "d")], SCHEMA)
    assert [tuple(r)[:4] for r in sd.remove_repeats(spark, docs).collect()] == [(1, 0, 0, 0)]


def removed(spark, data, parts=3):
    docs = spark.createDataFrame([(d, t, None, "s", 1, 2, "d") for d, t in data], SCHEMA).repartition(parts)
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(spark, docs).collect())


def test_hot_anchors_and_shuffled_ways(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT", 2)
    monkeypatch.setattr(sd, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(sd, "BUCKET_KEYS", 50)
    monkeypatch.setattr("gridloom.llm._common.HEAVY", 3)
    rng = random.Random(5)
    blank = ["".join(rng.choices("abc", k=40)) + " " * rng.randint(60, 300) + "".join(rng.choices("abc", k=40)) for _ in range(60)]
    data = corpus(4) + [(1000 + i, t) for i, t in enumerate(blank)]
    assert removed(spark, data) == brute(data)


def test_long_texts_are_taken_in_segments(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = text(700)
    data = [(i, text(rng.randint(900, 3000)) + passage + text(500) + passage[100:400]) for i in range(12)]
    whole = removed(spark, data)
    assert whole == brute(data)
    low, place = [], []
    for segment in (1 << 21, 256, 300):
        monkeypatch.setattr(sd, "SEGMENT", segment)
        b = data[0][1].encode()
        runs = sd.Runs(sd.np.frombuffer(b, sd.np.uint8), sd.np.array([0, len(b)]))
        of = sd.np.repeat(runs.anchor, runs.high - runs.low + 1)
        low.append(len(of))
        place.append(of.tolist())
    assert low == [len(b) - 99] * 3 and place[0] == place[1] == place[2]


def test_keys_are_spread(spark):
    rng = random.Random(7)
    b = "".join(rng.choices("abcdefgh ", k=200_000)).encode()
    runs = sd.Runs(sd.np.frombuffer(b, sd.np.uint8), sd.np.array([0, len(b)]))
    counts = sd.np.bincount((runs.key >> sd.np.uint64(60)).astype(int), minlength=16)
    assert counts.max() < 1.3 * counts.mean()
