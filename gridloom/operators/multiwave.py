"""Multiwavelets over the rows of tables: projection, evaluation, and the cascade of one dimension.

Points lie in [0, 1) in each dimension (1 counts as the last cell; what is outside or
null is left out). Functions of a dimension are numbered by (index, digit): index 0 has the
``degree`` Legendre functions of the whole dimension, index 2**(l-1) + c the wavelets of
level l and cell c. An element is a tuple of indices i1..id; its coefficients stand in
columns v0..v(K-1), K = degree**d, with the last dimension's digit fastest. The basis is
orthonormal, so a coefficient is a sum over rows and doesn't depend on what else is in
the set of elements.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.dg.basis import gauss, two_scale
from gridloom.sources.scratch import Scratch


def scaled(x: Column, low: float, high: float) -> Column:
    """A value of [low, high] in [0, 1); null outside."""
    at = (x.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low))
    return F.when((at >= 0) & (at < 1), at).when(at == 1, F.lit(1 - 2.0**-53))


def phi(u: Column, degree: int) -> list[Column]:
    """The orthonormal Legendre functions of [0, 1]."""
    r = 2 * u - 1
    p = [F.lit(1.0), r]
    for m in range(1, degree - 1):
        p.append(((2 * m + 1) * r * p[m] - m * p[m - 1]) / (m + 1))
    return [F.lit(float(np.sqrt(2 * m + 1))) * v for m, v in enumerate(p[:degree])]


def _combine(weights, values: list[Column]) -> Column:
    terms = [F.lit(float(w)) * v for w, v in zip(weights, values, strict=True) if w != 0]
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def basis(x: Column, level: int, degree: int) -> tuple[Column, list[Column]]:
    """Index and values of the functions of a level that don't vanish at x."""
    if level == 0:
        return F.lit(0).cast("long"), phi(x, degree)
    _, _, g0, g1 = two_scale(degree)
    at = x * float(1 << (level - 1))
    t = at - F.floor(at)
    right = t >= 0.5
    parts = phi(2 * t - F.when(right, 1.0).otherwise(0.0), degree)
    scale = 2.0 ** (level / 2)
    values = [F.when(right, _combine(scale * g1[j], parts)).otherwise(_combine(scale * g0[j], parts)) for j in range(degree)]
    return F.floor(at).cast("long") + (1 << (level - 1)), values


def digits(degree: int, d: int) -> list[tuple[int, ...]]:
    return list(product(range(degree), repeat=d))


def _times(factors: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, factors)


def keyed(points: DataFrame, dims: list[str], degree: int, tuples: list[tuple[int, ...]], keep: list[str]) -> DataFrame:
    """keep, i1..id, and e0..e(K-1): for each point and each level tuple the one element that it meets, with the values of its functions.

    A level tuple is metadata: there are as many as levels allow, whatever the rows.
    """
    limits = [max(t[k] for t in tuples) for k in range(len(dims))]
    rows = points.where(reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in dims]))
    tables = []
    for k, x in enumerate(dims):
        found = [basis(F.col(x), level, degree) for level in range(limits[k] + 1)]
        tables.append(F.array(*[F.struct(i.alias("i"), F.array(*v).alias("p")) for i, v in found]).alias(f"_b{k}"))
    every = F.explode(F.array(*[F.array(*[F.lit(level + 1) for level in t]) for t in tuples])).alias("_t")
    rows = rows.select(*keep, *tables).select(*keep, *[f"_b{k}" for k in range(len(dims))], every)
    one = [F.element_at(f"_b{k}", F.col("_t")[k]) for k in range(len(dims))]
    values = [_times([one[k]["p"][p] for k, p in enumerate(ps)]).alias(f"e{n}") for n, ps in enumerate(digits(degree, len(dims)))]
    return rows.select(*keep, *[one[k]["i"].alias(f"i{k + 1}") for k in range(len(dims))], *values)


def on_keys(d: int, prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"i{k}") == F.col(f"{prefix}{k}") for k in range(1, d + 1)])


def prefixed(members: DataFrame, d: int, prefix: str) -> DataFrame:
    return members.select(*[F.col(f"i{k}").alias(f"{prefix}{k}") for k in range(1, d + 1)])


def project(points: DataFrame, dims: list[str], degree: int, tuples: list[tuple[int, ...]], weight: str | None = None, members: DataFrame | None = None) -> DataFrame:
    """i1..id, v0..: sums over all points of (weight times) each function, for the elements that points meet, or those of ``members`` among them.

    Sums are combined in each task before they are shuffled, so the element of all
    points is no hot key.
    """
    d = len(dims)
    rows = keyed(points, dims, degree, tuples, [weight] if weight else [])
    if members is not None:
        rows = rows.join(prefixed(members, d, "m"), on_keys(d, "m"), "left_semi")
    times = F.col(weight) if weight else F.lit(1.0)
    return rows.groupBy(*[f"i{k}" for k in range(1, d + 1)]).agg(*[F.sum(times * F.col(f"e{n}")).alias(f"v{n}") for n in range(degree**d)])


def _nodes(degree: int) -> tuple[np.ndarray, np.ndarray]:
    return gauss(degree, 0.0, 1.0)


def _legendre(u: np.ndarray, degree: int) -> np.ndarray:
    """Row per node: the orthonormal Legendre functions of [0, 1]."""
    return np.polynomial.legendre.legvander(2 * np.asarray(u) - 1, degree - 1) * np.sqrt(2.0 * np.arange(degree) + 1)


def _cells(points: DataFrame, dims: list[str], levels: int) -> DataFrame:
    """With f1..fd, the finest cell of each point, and u1..ud, its place there."""
    at = [F.col(x) * float(1 << levels) for x in dims]
    cell = {f"f{k}": F.floor(a).cast("long") for k, a in enumerate(at, 1)}
    return points.withColumns(cell | {f"u{k}": a - F.floor(a) for k, a in enumerate(at, 1)})


def compress(points: DataFrame, dims: list[str], degree: int, levels: int, weight: str | None = None) -> DataFrame:
    """dims, w: weighted points with the sums of all functions up to ``levels``, at most degree**d for each finest cell that is met.

    A table is read once and replaced by its moments on the finest cells, laid on the
    cells' Gauss nodes; functions up to that level are polynomials on these cells,
    for which the nodes are exact.
    """
    d = len(dims)
    rows = _cells(points.where(reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in dims])), dims, levels)
    own = [phi(F.col(f"u{k}"), degree) for k in range(1, d + 1)]
    times = F.col(weight) if weight else F.lit(1.0)
    every = digits(degree, d)
    moments = [F.sum(times * _times([own[k][p] for k, p in enumerate(ps)])).alias(f"m{n}") for n, ps in enumerate(every)]
    cells = rows.groupBy(*[f"f{k}" for k in range(1, d + 1)]).agg(*moments)
    u, w = _nodes(degree)
    table = w[:, None] * _legendre(u, degree)  # node, function
    places = []
    for qs in every:
        total = reduce(lambda a, b: a + b, [F.lit(float(np.prod([table[q, p] for q, p in zip(qs, ps, strict=True)]))) * F.col(f"m{n}") for n, ps in enumerate(every)])
        places.append(F.struct(*[((F.col(f"f{k}") + float(u[q])) / float(1 << levels)).alias(dims[k - 1]) for k, q in enumerate(qs, 1)], total.alias("w")))
    return cells.select(F.explode(F.array(*places)).alias("q")).select("q.*")


def evaluate(points: DataFrame, dims: list[str], state: DataFrame, degree: int, tuples: list[tuple[int, ...]], name: str = "value") -> DataFrame:
    """``points`` with the value of the function whose coefficients are ``state`` (elements of the level tuples).

    The distinct finest cells that points lie in are looked up, one key per level tuple
    and node; a cell's nodal values are one row, which the points find by one join. So
    the lookups grow with the cells that are met and not with the points. Points
    outside get 0.
    """
    d, levels = len(dims), max(map(max, tuples))
    every = digits(degree, d)
    u, _ = _nodes(degree)
    cell = [f"f{k}" for k in range(1, d + 1)]
    placed = _cells(points, dims, levels)
    places = [F.struct(F.lit(n).alias("q"), *[((F.col(f"f{k}") + float(u[q])) / float(1 << levels)).alias(f"x{k}") for k, q in enumerate(qs, 1)]) for n, qs in enumerate(every)]
    inside = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cell])
    nodes = placed.where(inside).select(*cell).distinct().select(*cell, F.explode(F.array(*places)).alias("n")).select(*cell, "n.*")
    met = keyed(nodes, [f"x{k}" for k in range(1, d + 1)], degree, tuples, [*cell, "q"])
    coefs = state.select(*[F.col(f"i{k}").alias(f"s{k}") for k in range(1, d + 1)], *[f"v{n}" for n in range(len(every))])
    met = met.join(coefs, on_keys(d, "s"))
    here = reduce(lambda a, b: a + b, [F.col(f"v{n}") * F.col(f"e{n}") for n in range(len(every))])
    found = met.groupBy(*[F.col(c).alias(f"c_{c}") for c in cell]).agg(*[F.sum(F.when(F.col("q") == n, here).otherwise(0.0)).alias(f"n{n}") for n in range(len(every))])
    both = placed.join(found, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"c_{c}") for c in cell]), "left")
    # Lagrange polynomials of the nodes, by their Legendre coefficients
    inverse = np.linalg.inv(_legendre(u, degree))
    lagrange = [[_combine(inverse[:, q], phi(F.col(f"u{k}"), degree)) for q in range(degree)] for k in range(1, d + 1)]
    value = reduce(lambda a, b: a + b, [F.col(f"n{n}") * _times([lagrange[k][q] for k, q in enumerate(qs)]) for n, qs in enumerate(every)])
    return both.select(*points.columns, F.coalesce(value, F.lit(0.0)).alias(name))


def cell_coefficients(points: DataFrame, by: list[str], x: str, degree: int, levels: int, weight: str | None = None) -> DataFrame:
    """by, cell, s0..: sums over the points of each cell of the finest level, on its orthonormal Legendre functions."""
    rows = _cells(points.where(F.col(x).isNotNull()), [x], levels)
    times = (F.col(weight) if weight else F.lit(1.0)) * 2.0 ** (levels / 2)
    return rows.groupBy(*by, F.col("f1").alias("cell")).agg(*[F.sum(times * p).alias(f"s{m}") for m, p in enumerate(phi(F.col("u1"), degree))])


def analyse(cells: DataFrame, by: list[str], degree: int, levels: int) -> DataFrame:
    """by, lev, cell, w0..: wavelet coefficients of the cell coefficients (by, cell, s0..), level by level.

    Each level is one sum over pairs of cells and half as large as the one before;
    it is written, so that no level is computed twice.
    """
    scratch = Scratch(cells.sparkSession, "cascade")
    h0, h1, g0, g1 = two_scale(degree)
    s = [F.col(f"s{m}") for m in range(degree)]
    out = None
    for lev in range(levels, 0, -1):
        left = F.col("cell") % 2 == 0
        sums = [F.sum(F.when(left, _combine(a[j], s)).otherwise(_combine(b[j], s))).alias(f"{name}{j}") for name, a, b in (("t", h0, h1), ("w", g0, g1)) for j in range(degree)]
        table = scratch.write(cells.groupBy(*by, F.shiftright("cell", 1).alias("up")).agg(*sums))
        part = table.select(*by, F.lit(lev).alias("lev"), F.col("up").alias("cell"), *[f"w{j}" for j in range(degree)])
        out = part if out is None else out.unionByName(part)
        cells = table.select(*by, F.col("up").alias("cell"), *[F.col(f"t{j}").alias(f"s{j}") for j in range(degree)])
    root = cells.select(*by, F.lit(0).alias("lev"), "cell", *[F.col(f"s{j}").alias(f"w{j}") for j in range(degree)])
    return root if out is None else out.unionByName(root)


def synthesise(coefs: DataFrame, by: list[str], degree: int, levels: int) -> DataFrame:
    """by, cell, s0..: back from (by, lev, cell, w0..); a coefficient that isn't there is 0. One join a level, from the top down."""
    h0, h1, g0, g1 = two_scale(degree)
    state = coefs.where("lev = 0").select(*by, "cell", *[F.col(f"w{j}").alias(f"s{j}") for j in range(degree)])
    for lev in range(1, levels + 1):
        fine = coefs.where(F.col("lev") == lev).select(*[F.col(b).alias(f"d_{b}") for b in by], F.col("cell").alias("d_cell"), *[f"w{j}" for j in range(degree)])
        on = reduce(lambda a, b: a & b, [F.col("cell") == F.col("d_cell"), *[F.col(b).eqNullSafe(F.col(f"d_{b}")) for b in by]])
        both = state.join(fine, on, "full").select(*[F.coalesce(b, f"d_{b}").alias(b) for b in by], F.coalesce("cell", "d_cell").alias("cell"), *[F.coalesce(f"{n}{j}", F.lit(0.0)).alias(f"{n}{j}") for n in "sw" for j in range(degree)])
        s, w = ([F.col(f"{n}{j}") for j in range(degree)] for n in "sw")
        kids = [F.struct((2 * F.col("cell") + k).alias("cell"), *[(_combine(h[:, m], s) + _combine(g[:, m], w)).alias(f"s{m}") for m in range(degree)]) for k, h, g in ((0, h0, g0), (1, h1, g1))]
        state = both.select(*by, F.explode(F.array(*kids)).alias("k")).select(*by, "k.*")
    return state
