from collections import defaultdict

from gridloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies long, rows int"


def waterfill(sizes, weights):
    """Reshares the excess round by round."""
    total, target, fixed = sum(sizes), [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest = total - sum(3 * sizes[i] for i in fixed)
        share = rest / sum(weights[i] for i in free) if free else 0
        over = [i for i in free if share * weights[i] > 3 * sizes[i]]
        if not over:
            for i in free:
                target[i] = share * weights[i]
            for i in fixed:
                target[i] = 3.0 * sizes[i]
            return target
        fixed |= set(over)


def rows():
    out = []
    for i in range(600):
        source = None if i % 50 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}"
        out.append((i, None if i % 41 == 0 else "w " * (1 + i * 37 % 200), None, source, None, 9, 9))
    return [*out, out[5], out[5]]


def test_targets_and_taken(spark):
    data = rows()
    got = mixing.sample(spark, spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    assert len(got) == len(data)
    sizes, taken, target, longest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r.size)
        assert r.taken <= 3 * r.size and r.size == len((data[r.doc_id][1] or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = waterfill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, w in zip(order, want, strict=True):
        assert abs(target[s] - w) < 1e-6 * (1 + w)
        assert abs(taken[s] - w) <= 2 * longest[s]
    again = mixing.sample(spark, spark.createDataFrame(data, SCHEMA).repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_salted_blocks_keep_the_sum(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 7)
    got = mixing.sample(spark, spark.createDataFrame(rows(), SCHEMA)).collect()
    copies, n, target, size = defaultdict(int), defaultdict(int), {}, {}
    for r in got:
        copies[r.source] += r.copies
        n[r.source] += 1
        target[r.source], size[r.source] = r.target, r.source_size
    assert all(abs(copies[s] - n[s] * target[s] / size[s]) < 1 + 1e-6 for s in n)


def test_mix_emits_copies(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    mixed = mixing.mix(spark, docs)
    assert mixed.columns == docs.columns
    got = mixed.groupBy("doc_id").count().collect()
    want = defaultdict(int)
    for r in mixing.sample(spark, docs).collect():
        want[r.doc_id] += r.copies
    assert {r.doc_id: r["count"] for r in got} == {d: c for d, c in want.items() if c}


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.sample(spark, docs).count() == 0 and mixing.mix(spark, docs).count() == 0


def test_order_does_not_depend_on_the_block(spark, monkeypatch):
    rows = [(i * 7919 % 1009, "w " * (1 + i % 3 if i % 4 else 2), None, f"s{i % 2}", 1) for i in range(1, 700)] + [(None, "w w", None, "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = lambda: sorted(map(str, mixing.sample(spark, docs).select("doc_id", "source", "size", "copies").collect()))
    want = taken()
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 20)
    assert taken() == want


def test_mix_is_repeatable_for_repeated_keys(spark):
    rows = [(i % 4, f"{chr(97 + i % 26)}{i} w", f"l{i}", "s0" if i % 2 else "s1", i) for i in range(160)] + [(9, "z " * 400, None, "s2", 1)]
    docs = lambda n: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
    one, two = (sorted(map(str, mixing.mix(spark, docs(n)).collect())) for n in (1, 7))
    assert one == two and len(one) != len(rows)
