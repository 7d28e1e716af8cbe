"""Multiwavelets, adapted sets, directional operators and ordered systems over tables, against NumPy."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.dg.basis import two_scale
from gridloom.operators import adaptive as A
from gridloom.operators import connect as C
from gridloom.operators import multiwave as M
from gridloom.operators import tridiagonal as T


def psi(x, level, degree):
    """Index and values of a level's functions at x."""
    def leg(u):
        return np.polynomial.legendre.legvander(2 * np.array([u]) - 1, degree - 1)[0] * np.sqrt(2.0 * np.arange(degree) + 1)

    if level == 0:
        return 0, leg(x)
    _, _, g0, g1 = two_scale(degree)
    at = x * 2 ** (level - 1)
    t = at - np.floor(at)
    return int(np.floor(at)) + 2 ** (level - 1), 2 ** (level / 2) * (g1 @ leg(2 * t - 1) if t >= 0.5 else g0 @ leg(2 * t))


def coefs(points, degree, tuples, weights=None):
    out = {}
    for n, p in enumerate(points):
        for t in tuples:
            one = [psi(x, lev, degree) for x, lev in zip(p, t, strict=True)]
            v = one[0][1]
            for _, w in one[1:]:
                v = np.multiply.outer(v, w)
            key = tuple(i for i, _ in one)
            out[key] = out.get(key, 0) + v.ravel() * (1 if weights is None else weights[n])
    return out


def sample(n, d, seed):
    rng = np.random.default_rng(seed)
    return np.clip(rng.beta(2, 5, (n, d)), 0, 0.999)


def frame(spark, points, weights=None):
    d = len(points[0])
    rows = [(*map(float, p), 1.0 if weights is None else float(weights[n]), "extra") for n, p in enumerate(points)]
    return spark.createDataFrame(rows, ", ".join(f"x{k} double" for k in range(1, d + 1)) + ", wt double, v0 string")


def as_dict(state, d, degree):
    return {tuple(r[f"i{k}"] for k in range(1, d + 1)): np.array([r[f"v{n}"] for n in range(degree**d)]) for r in state.collect()}


def same(got, want, tol=1e-8):
    return all(np.allclose(got.get(k, 0), want.get(k, 0), atol=tol) for k in set(got) | set(want))


@pytest.mark.parametrize("degree,d,limit", [(1, 2, 4), (2, 2, 3), (3, 1, 4), (2, 3, 2)])
def test_projection_and_compression(spark, degree, d, limit):
    p = sample(150, d, degree * 10 + d)
    weights = np.arange(150) % 7
    tuples = [t for t in product(range(limit + 1), repeat=d) if sum(t) <= limit]
    want = coefs(p, degree, tuples, weights)
    names = [f"x{k}" for k in range(1, d + 1)]
    rows = frame(spark, p, weights)
    rows = rows.unionByName(rows.limit(1).withColumn("x1", F.lit(None).cast("double")))
    assert same(as_dict(M.project(rows, names, degree, tuples, "wt"), d, degree), want)
    small = M.compress(rows, names, degree, limit, "wt")
    assert small.count() <= degree**d * 150
    assert same(as_dict(M.project(small, names, degree, tuples, "w"), d, degree), want)


@pytest.mark.parametrize("degree,d,limit", [(1, 2, 4), (2, 2, 3), (3, 1, 4)])
def test_evaluation_at_rows(spark, degree, d, limit):
    p = sample(80, d, 3)
    tuples = [t for t in product(range(limit + 1), repeat=d) if sum(t) <= limit]
    names = [f"x{k}" for k in range(1, d + 1)]
    have = coefs(p, degree, tuples)
    state = M.project(frame(spark, p), names, degree, tuples)
    at = np.concatenate([p[:40], sample(40, d, 4)])
    rows = frame(spark, at).withColumn("n", F.monotonically_increasing_id()).drop("v0", "wt")
    rows = rows.unionByName(rows.limit(1).select(*[F.lit(None).cast("double").alias(x) for x in names], F.lit(-1).cast("long").alias("n")))
    got = M.evaluate(rows, names, state, degree, tuples).collect()
    assert len(got) == 81
    for r in got:
        x = [r[c] for c in names]
        if r.n < 0:
            assert r.value == 0
            continue
        want = 0.0
        for t in tuples:
            one = [psi(v, lev, degree) for v, lev in zip(x, t, strict=True)]
            v = one[0][1]
            for _, w in one[1:]:
                v = np.multiply.outer(v, w)
            want += float(np.dot(v.ravel(), have.get(tuple(i for i, _ in one), np.zeros(degree**d))))
        assert abs(want - r.value) < 1e-7 * (1 + abs(want))


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_cascade_and_back(spark, degree):
    rng = np.random.default_rng(degree)
    rows = [(g, float(x), float(w)) for g in ("a", "b", None) for x, w in zip(rng.random(60), rng.normal(size=60), strict=True)] + [("a", None, 1.0)]
    e = spark.createDataFrame(rows, "g string, x double, w double")
    cells = M.cell_coefficients(e, ["g"], "x", degree, 5, "w")
    found = M.analyse(cells, ["g"], degree, 5)
    want = {}
    for g, x, w in rows:
        if x is None:
            continue
        for lev in range(6):
            i, v = psi(x, lev, degree)
            key = (g, lev, i - (2 ** (lev - 1) if lev else 0))
            want[key] = want.get(key, 0) + w * v
    got = {(r.g, r.lev, r.cell): np.array([r[f"w{j}"] for j in range(degree)]) for r in found.collect()}
    assert same(got, want)
    have = {(r.g, r.cell): np.array([r[f"s{j}"] for j in range(degree)]) for r in cells.collect()}
    back = {(r.g, r.cell): np.array([r[f"s{j}"] for j in range(degree)]) for r in M.synthesise(found, ["g"], degree, 5).collect()}
    assert len(back) == 3 * 32 and same(back, have)


def children(i, limit):
    level = i.bit_length()
    return [] if level >= limit else [1] if i == 0 else [2 * i, 2 * i + 1]


@pytest.mark.parametrize("degree,largest", [(1, True), (2, False)])
def test_adapted_density(spark, degree, largest):
    p = np.concatenate([sample(300, 2, 5) * 0.2, sample(100, 2, 6)])
    limits, threshold = [4, 3], 0.06
    every = coefs(p, degree, list(product(range(5), range(4))))
    zero = np.zeros(degree**2)
    norm = (lambda v: np.abs(v).max()) if largest else np.linalg.norm
    total = lambda s: max(map(norm, s.values())) if largest else np.sqrt(sum(norm(v) ** 2 for v in s.values()))
    state = {(i, j): every.get((i, j), zero) for i in range(16) for j in range(8) if i.bit_length() + j.bit_length() <= 1}
    rounds = 0
    while True:
        bound = threshold * total(state)
        new = set()
        for (i, j), v in state.items():
            if norm(v) >= bound:
                new |= {(k, j) for k in children(i, 4)} | {(i, k) for k in children(j, 3)}
        new -= set(state)
        if not new:
            break
        rounds += 1
        state |= {k: every.get(k, zero) for k in new}
    bound = 0.1 * threshold * total(state)
    want = {k: v for k, v in state.items() if norm(v) > bound}
    got = as_dict(A.adapted_density(frame(spark, p).drop("v0"), ["x1", "x2"], degree, limits, 1, threshold, largest=largest), 2, degree)
    assert rounds >= 3 and set(got) == set(want) and same(got, want)


def test_adapted_density_of_nothing(spark):
    rows = frame(spark, sample(3, 2, 1)).where("x1 > 2")
    assert A.adapted_density(rows, ["x1", "x2"], 1, [3, 3], 1, 0.1).count() == 0


def test_adapted_step_is_made_again(spark):
    """A step that doubles what the root sends to its child: the set grows until the children are small."""
    state = spark.createDataFrame([(0, 8.0)], "i1 long, v0 double")
    calls = []

    def step(s, members):
        calls.append(members.count())
        up = s.select(F.explode(F.when(F.col("i1") == 0, F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).otherwise(F.array(F.col("i1"), 2 * F.col("i1")))).alias("t"), "i1", "v0")
        made = up.groupBy("t").agg(F.sum(F.when(F.col("t") == F.col("i1"), F.col("v0")).otherwise(F.col("v0") * 0.5)).alias("v0")).withColumnRenamed("t", "i1")
        return made.join(members.withColumnRenamed("i1", "m1"), F.col("i1") == F.col("m1"), "left_semi")

    got = {r.i1: r.v0 for r in A.adapted_advance(state, step, 1, [3], 0.4).collect()}
    assert calls == [1, 2, 4] and got == {0: 8.0, 1: 4.0, 2: 0.0, 3: 0.0}


@pytest.mark.parametrize("d,limit", [(2, 3), (3, 3), (4, 2)])
def test_directional_passes_stay_in_the_set(spark, monkeypatch, d, limit):
    rng = random.Random(d)
    n = 2**limit
    members = [k for k in product(range(n), repeat=d) if sum(i.bit_length() for i in k) <= limit]
    ops = [np.array([[rng.uniform(-1, 1) if rng.random() < 0.7 else 0.0 for _ in range(n)] for _ in range(n)]) for _ in range(d)]
    x = {k: rng.uniform(-1, 1) for k in members if rng.random() < 0.8}
    want = {r: sum(np.prod([ops[j][r[j], c[j]] for j in range(d)]) * v for c, v in x.items()) for r in members}
    keys = ", ".join(f"i{k} long" for k in range(1, d + 1))
    state = spark.createDataFrame([(*k, v) for k, v in x.items()], f"{keys}, v double")
    own = spark.createDataFrame([(*k,) for k in members], keys)
    tables = [spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]], "row long, col long, v double") for m in ops]
    sizes, real = [], C._direction

    def counted(*args):
        out = real(*args)
        if d < 4:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(C, "_direction", counted)
    got = {tuple(r[f"i{k}"] for k in range(1, d + 1)): r.v for r in C.directional_apply(state, tables, d, own).collect()}
    assert all(abs(got.get(k, 0) - v) < 1e-9 for k, v in want.items()) and set(got) <= set(members)
    assert all(s <= len(members) for s in sizes)


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_tridiagonal_parts(spark, parts):
    rng = np.random.default_rng(parts)
    n = 2000
    a, c, y = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    b = np.abs(a) + np.abs(c) + rng.random(n) + 0.1
    k = np.sort(rng.choice(10**6, n, False)) - 500_000
    rows = spark.createDataFrame([(int(q), float(w), float(x), float(z), float(v), "s") for q, w, x, z, v in zip(k, a, b, c, y, strict=True)], "k long, a double, b double, c double, y double, x string").repartition(5)
    got = {r.k: r.x for r in T.solve(rows, parts).collect()}
    want = np.linalg.solve(np.diag(b) + np.diag(a[1:], -1) + np.diag(c[:-1], 1), y)
    assert len(got) == n and np.allclose([got[int(q)] for q in k], want, atol=1e-9)


def test_tridiagonal_of_many_rows(spark):
    """A million rows: the residual of the smoothed series, and the same from one part's elimination."""
    n, s = 1_000_000, 5.0
    rows = spark.range(n).select(F.col("id").alias("k"), F.sin(F.col("id") / 50.0).alias("y"))
    got = T.smoothed(rows, s, 16).orderBy("k").toPandas()
    x, y = got["x"].to_numpy(), np.sin(np.arange(n) / 50.0)
    step = np.diff(x, prepend=x[0], append=x[-1])
    assert np.abs(x + s * (step[:-1] - step[1:]) - y).max() < 1e-12
    side = [0.0, *[-s] * (n - 1)]
    whole, _, _ = T.eliminate(side, [1 + s, *[1 + 2 * s] * (n - 2), 1 + s], side[::-1], y.tolist())
    assert np.abs(x - np.array(whole)).max() < 1e-12


def test_tridiagonal_small(spark):
    rows = spark.createDataFrame([(7, 3.0, 2.0, 5.0, 8.0)], "k long, a double, b double, c double, y double")
    assert [(r.k, r.x) for r in T.solve(rows).collect()] == [(7, 4.0)]
    assert T.solve(rows.where("k > 9")).count() == 0
    found = {r.k: (r.x, r.e) for r in T.poisson(rows.where("k > 9").select("k", "y"), 4, 0.0, 1.0, 1.0, 3.0).collect()}
    assert all(abs(found[k][0] - (1 + k / 2)) < 1e-12 and abs(found[k][1] + 2) < 1e-12 for k in (1, 2, 3))
