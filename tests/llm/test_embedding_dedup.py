import tracemalloc

import numpy as np
import pyarrow as pa

from gridloom.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, node string, kept int"


def brute(rows):
    unit = []
    for _, v in rows:
        x = np.array(v, np.float64) if v and None not in v else np.zeros(1)
        unit.append(x / np.linalg.norm(x) if np.isfinite(x).all() and np.linalg.norm(x) > 0 else None)
    n = len(rows)
    links = [{j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9} for i in range(n)]
    seen, out = {}, []
    for i in range(n):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                for k in links[todo.pop()] - group:
                    group.add(k)
                    todo.append(k)
            least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
            seen |= dict.fromkeys(group, least)
        out.append((rows[i][0], len(links[i]), seen[i]))
    return out


def data(n=500, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(n)]
    for base, size, spread in ((0, 60, 0.2), (1, 30, 0.1), (2, 5, 0.25)):
        rows += [rows[base] + rng.normal(size=dim) * spread * np.linalg.norm(rows[base]) / np.sqrt(dim) for _ in range(size)]
    rows += [rows[7]] * 20
    rows = [[float(v) for v in np.float32(r)] for r in rows]
    odd = [None, [], [0.0] * dim, [1.0] * (dim - 1) + [None], [float("nan")] + [1.0] * (dim - 1), [float("inf")] * dim, [1.0, 2.0], [2.0, 4.0], [1e-30] * dim, rows[7]]
    order = rng.permutation(len(rows) + len(odd)).tolist()
    return [(i, (rows + odd)[k]) for i, k in enumerate(order)]


def test_links_and_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ed, "SHARD", 60)
    rows = data()
    frame = spark.createDataFrame([(i, v, 1, "n", 1) for i, v in rows], SCHEMA).repartition(3)
    out, recall = ed.near_duplicates(spark, frame)
    got = {r.vec_id: r for r in out.collect()}
    want = brute(rows)
    found = sum(got[v].n_links for v, *_ in want)
    total = sum(k for _, k, _ in want)
    assert recall >= 0.9 and all(got[v].n_links <= k for v, k, _ in want) and found >= 0.97 * total
    assert np.mean([got[v].component_id == c for v, _, c in want]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values()) and len(got) == len(rows)


def test_one_shard_is_exact_and_odd_tables(spark):
    rows = data(120)
    frame = spark.createDataFrame([(i, v, 1, "n", 1) for i, v in rows], SCHEMA)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in ed.near_duplicates(spark, frame)[0].collect())
    assert got == sorted(brute(rows))
    assert ed.near_duplicates(spark, spark.createDataFrame([], SCHEMA))[0].count() == 0
    rows = [(1, None), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (None, [3.0, 3.0])]
    frame = spark.createDataFrame([(i, v, 1, "n", 1) for i, v in rows], SCHEMA)
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in ed.near_duplicates(spark, frame)[0].collect())
    assert got == [("1", 0, 1), ("2", 2, 2), ("2", 2, 2), ("None", 2, 2)]


def test_pruning_matches_its_definition():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = ed.nearest(x, 12)
    dist = lambda a, b: np.sum((x[a] - x[b]) ** 2)
    for i, got in enumerate(ed.robust_prune(x, near, 4, 1.2)):
        left, kept = list(near[i]), []
        while left and len(kept) < 4:
            p = left.pop(0)
            kept.append(p)
            left = [q for q in left if 1.44 * dist(p, q) > dist(i, q)]
        assert got.tolist() == kept


def paired(n, pairs, group, dim=32, seed=5):
    """Unclustered vectors, of which some have a partner at cosine 0.92, and a group of unequal copies."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.normal(size=(n, dim)))
    side = rng.normal(size=(pairs, dim))
    side = unit(side - (side * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    near = 0.92 * x[:pairs] + np.sqrt(1 - 0.92**2) * side
    return np.vstack([x, near, unit(x[-1] + rng.normal(size=(group, dim)) * 0.004)])


def found_pairs(spark, x, n, pairs):
    frame = spark.createDataFrame([(i, v, 1, "n", 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int, node string, kept int")
    out, recall = ed.near_duplicates(spark, frame.repartition(3))
    got = {r.vec_id: r.n_links for r in out.collect()}
    return np.mean([got[i] > 0 for i in range(pairs)]), recall


def test_a_large_group_hides_no_lost_pairs(spark):
    x = paired(300, 40, 200)
    nodes = [i.to_bytes(16, "big") for i in range(len(x))]
    classes = spark.createDataFrame([(bytearray(v), bytearray(u.tobytes()), 1) for v, u in zip(nodes, x, strict=True)], "node binary, unit binary, size long")
    want, spare = ed.audited(classes, len(x), 0.9)
    assert {nodes.index(v): k for v, k in want.items()} == {i: int(k) for i, k in enumerate((x @ x.T >= 0.9).sum(1) - 1) if k} and not spare
    lost = {v: k for v, k in want.items() if k > 1}
    assert sum(lost.values()) > 0.95 * sum(want.values()) and ed.measured(want, lost, []) == 0
    assert ed.measured(want, want, []) == 1 and ed.measured({}, {}, [1.0, 0.0]) == 0.5


def test_no_linked_vector_is_no_evidence(spark, monkeypatch):
    for name, value in (("SHARD", 12), ("SAMPLE", 120), ("AUDIT", 10), ("DRAWN", (5, 10))):
        monkeypatch.setattr(ed, name, value, raising=False)
    found, recall = found_pairs(spark, paired(1500, 15, 0, 64), 1500, 15)
    assert found >= 0.95 and recall >= ed.RECALL


def test_the_search_crosses_shards(spark):
    """Two vectors without a common shard, linked over neighbours that each shares a shard with; cut to the shard they are lost."""
    angle = np.arange(4) * 0.3  # steps of cosine 0.955; two steps 0.825
    x = np.vstack([np.stack([np.cos(angle), np.sin(angle), np.zeros(4)], 1), [[0.0, 0.0, 1.0]]])
    shards = [[1], [1, 2], [2, 3], [3], [4]]
    lists = [[1], [0, 2], [1, 3], [2], []]
    name = lambda i: bytearray(i.to_bytes(16, "big"))
    dealt = spark.createDataFrame([(name(i), bytearray(u.tobytes()), 1, s) for i, (u, s) in enumerate(zip(x, shards, strict=True))], "node binary, unit binary, size long, shards array<long>")
    graph = spark.createDataFrame([(name(i), [name(j) for j in own], [name(j) for j in own]) for i, own in enumerate(lists)], "u_node binary, neighbours array<binary>, close array<binary>")
    rows = ed.with_fringe(dealt, graph)
    held = {}
    for r in rows.collect():
        held.setdefault(r.shard, set()).add(int.from_bytes(r.node, "big"))
    assert held == {1: {0, 1, 2}, 2: {0, 1, 2, 3}, 3: {1, 2, 3}, 4: {4}}
    for threshold in (0.9, 0.8):
        got = rows.groupBy("shard").applyInArrow(ed.search(threshold), "node binary, other binary, links long").collect()
        count = dict.fromkeys(range(5), 0)
        for r in got:
            count[int.from_bytes(r.node, "big")] += r.links
        assert list(count.values()) == ((x @ x.T >= threshold).sum(1) - 1).tolist()  # at 0.8 also of 0 and 2, which share no shard


def test_many_small_shards_lose_few_links(spark, monkeypatch):
    monkeypatch.setattr(ed, "SHARD", 25)
    rng = np.random.default_rng(8)
    x = np.vstack([c + rng.normal(size=(60, 24)) * 0.05 for c in rng.normal(size=(15, 24))])
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    frame = spark.createDataFrame([(i, v, 1, "n", 1) for i, v in rows], SCHEMA).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_duplicates(spark, frame)[0].collect()}
    want = brute([(i, np.float32(v).tolist()) for i, v in rows])
    assert all(got[v][0] <= k for v, k, _ in want) and sum(k for k, _ in got.values()) >= 0.98 * sum(k for _, k, _ in want)
    assert all(got[v][1] == c for v, _, c in want)


def group(rng, size, cosine, dim):
    """Unit vectors of about this cosine with each other."""
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    middle = unit(rng.normal(size=dim))
    side = rng.normal(size=(size, dim))
    side = unit(side - (side @ middle)[:, None] * middle)
    return np.sqrt(cosine) * middle + np.sqrt(1 - cosine) * side


def test_a_shard_of_near_copies_takes_bounded_memory():
    rng = np.random.default_rng(2)
    x = np.vstack([group(rng, size, 0.99, 64) for size in (1500, 500)])
    nodes = [i.to_bytes(16, "big") for i in range(len(x))]
    table = pa.table({"node": pa.array(nodes, pa.binary()), "unit": pa.array([u.tobytes() for u in x], pa.binary())})
    tracemalloc.start()
    try:
        lists = ed.build(ed.THRESHOLD - ed.SLACK)(table)
        built = tracemalloc.get_traced_memory()[1]
        own = pa.array([[1]] * len(x), pa.list_(pa.int64()))
        shard = table.append_column("shard", pa.array([1] * len(x))).append_column("size", pa.array([1] * len(x))).append_column("shards", own)
        shard = shard.append_column("fringe", pa.array([[]] * len(x), pa.list_(pa.int64()))).append_column("neighbours", lists["neighbours"])
        tracemalloc.reset_peak()
        got = ed.search(ed.THRESHOLD)(shard).to_pylist()
        searched = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {r["node"]: r["links"] for r in got if r["other"] is None} == {v: 1499 if i < 1500 else 499 for i, v in enumerate(nodes)}
    assert {(r["node"], r["other"]) for r in got if r["other"]} == {(v, nodes[0 if i < 1500 else 1500]) for i, v in enumerate(nodes) if i not in (0, 1500)}
    assert max(built, searched) < 200e6, (built, searched)


def test_a_large_group_does_not_widen_all_shards(spark, monkeypatch):
    """Groups beyond a shard, tight or as wide as the threshold lets them be, with their surroundings, match brute force at the first overlap."""
    for name, value in (("SHARD", 40), ("DENSE", 60), ("BLOCK", 32)):
        monkeypatch.setattr(ed, name, value, raising=False)
    widths, assign = [], ed.assign
    monkeypatch.setattr(ed, "assign", lambda middle, overlap: widths.append(overlap) or assign(middle, overlap))
    rng = np.random.default_rng(6)
    tight = group(rng, 300, 0.995, 24)
    x = [*tight, *group(rng, 120, 0.92, 24), *group(rng, 120, 0.9, 24), *rng.normal(size=(300, 24))]
    for step in (0.3, 0.4, 0.45, 0.5, 0.9):  # some around the edge of what the tight group links with
        side = rng.normal(size=(8, 24)) / np.sqrt(24)
        x += [*(np.cos(step) * tight.mean(0) + np.sin(step) * side)]
    x += [*np.repeat(x[:3], 4, axis=0), *np.repeat(x[-2:], 3, axis=0), *([2.0, 1.0, k] for k in range(3))]
    rows = [(i, np.float32(x[k]).tolist()) for i, k in enumerate(rng.permutation(len(x)))]
    frame = spark.createDataFrame([(i, v, 1, "n", 1) for i, v in rows], SCHEMA).repartition(3)
    out, recall = ed.near_duplicates(spark, frame)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in out.collect())
    assert got == sorted(brute(rows)) and recall >= ed.RECALL
    assert widths == [ed.OVERLAP]


def test_a_table_of_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(ed, "DENSE", 20)
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(group(np.random.default_rng(1), 90, 0.97, 12))]
    frame = spark.createDataFrame([(i, v, 1, "n", 1) for i, v in rows], SCHEMA)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in ed.near_duplicates(spark, frame)[0].collect()) == [(i, 89, 0) for i in range(90)]
