"""Queries of adaptivity, multiwavelets, directional operators and ordered systems over the given tables, with their DuckDB SQL.

Coefficients are divided by the number of rows and rounded, since sums of doubles
depend on their order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.dg import distributed as D
from gridloom.dg.basis import two_scale
from gridloom.dg.spec import Dim, Partial, Problem, Term, one
from gridloom.functions import tables as Tables
from gridloom.operators import adaptive as A
from gridloom.operators import connect as C
from gridloom.operators import coupled as Fields
from gridloom.operators import dense as Dense
from gridloom.operators import kinetic as K
from gridloom.operators import krylov
from gridloom.operators import multiwave as M
from gridloom.operators import tridiagonal as T
from gridloom.plans.grid_queries import query
from gridloom.plans.table_queries import read
from gridloom.sources import datasource as Source
from gridloom.sources.scratch import Scratch
from gridloom.streaming import evolution as E

#: Columns of lineitem with their ranges.
RANGES = {"l_quantity": (0.0, 51.0), "l_discount": (0.0, 0.11), "l_tax": (0.0, 0.09), "l_extendedprice": (0.0, 110_000.0)}
ROUND = 9


def points(spark, sf, *columns):
    """Rows of lineitem as points x1, x2, ... of the unit cube."""
    return read(spark, sf, "lineitem").select(*[M.scaled(F.col(c), *RANGES[c]).alias(f"x{k}") for k, c in enumerate(columns, 1)])


def _points_sql(*columns: str) -> str:
    """CTEs pt (x1, ...) and n."""
    each = ", ".join(f"(l_{c[2:]}::DOUBLE - {lo!r}::DOUBLE) / {hi - lo!r}::DOUBLE AS x{k}" for k, (c, (lo, hi)) in enumerate(((c, RANGES[c]) for c in columns), 1))
    inside = " AND ".join(f"x{k} >= 0 AND x{k} < 1" for k in range(1, len(columns) + 1))
    return f"pt AS (SELECT row_number() OVER () AS rn, * FROM (SELECT {each} FROM lineitem) WHERE {inside}), n AS (SELECT count(*)::DOUBLE AS n FROM pt)"


def _phi_sql(u: str, degree: int) -> list[str]:
    r = f"(2 * ({u}) - 1)"
    p = ["1.0::DOUBLE", r, f"((3 * {r} * {r} - 1) / 2)"][:degree]
    return [f"({(2 * m + 1) ** 0.5!r}::DOUBLE * {v})" for m, v in enumerate(p)]


def index_sql(x: str, lev: str) -> str:
    return f"CASE WHEN {lev} = 0 THEN 0 ELSE CAST(floor({x} * power(2, {lev} - 1)) AS BIGINT) + (1::BIGINT << greatest({lev} - 1, 0)) END"


def psi_sql(x: str, lev: str, degree: int, j: int) -> str:
    """The function of a level and digit at x."""
    _, _, g0, g1 = two_scale(degree)
    at = f"({x} * power(2, {lev} - 1))"
    t = f"({at} - floor({at}))"
    part = lambda g, shift: " + ".join(f"{float(w)!r}::DOUBLE * {p}" for w, p in zip(g[j], _phi_sql(f"2 * {t} - {shift}", degree), strict=True))
    return f"CASE WHEN {lev} = 0 THEN {_phi_sql(x, degree)[j]} ELSE power(2, {lev} / 2.0) * CASE WHEN {t} >= 0.5 THEN {part(g1, 1)} ELSE {part(g0, 0)} END END"


def normalised(state, count, names):
    """Coefficients over the number of points, which is the first one of the root."""
    return state.join(F.broadcast(count)).select(*[F.col(c) for c in state.columns if c not in names], *[(F.round(F.col(c) / F.col("n"), ROUND) + 0.0).alias(c) for c in names])


def counted(rows):
    return rows.where("x1 IS NOT NULL AND x2 IS NOT NULL").agg(F.count(F.lit(1)).cast("double").alias("n"))


def sparse(d: int, limit: int) -> list[tuple[int, ...]]:
    return [t for t in M.digits(limit + 1, d) if sum(t) <= limit]


def _project_sql(degree: int, limit: int) -> str:
    values = ", ".join(f"round(sum(({psi_sql('x1', 'l1', degree, a)}) * ({psi_sql('x2', 'l2', degree, b)})) / any_value(n), {ROUND}) + 0.0 AS v{k}" for k, (a, b) in enumerate(M.digits(degree, 2)))
    return f"WITH {_points_sql('l_quantity', 'l_extendedprice')} SELECT i1, i2, {values.replace('any_value(n)', 'any_value(n)')} FROM (SELECT x1, x2, l1, l2, n, {index_sql('x1', 'l1')} AS i1, {index_sql('x2', 'l2')} AS i2 FROM pt, n, generate_series(0, {limit}) a(l1), generate_series(0, {limit}) b(l2) WHERE l1 + l2 <= {limit}) GROUP BY i1, i2"


@query("j07_density_projection", _project_sql(1, 5))
def density_projection(spark, sf):
    """Rows of lineitem projected onto the sparse grid of level 5 in quantity and price."""
    p = points(spark, sf, "l_quantity", "l_extendedprice")
    return normalised(M.project(p, ["x1", "x2"], 1, sparse(2, 5)), counted(p), ["v0"])


@query("j07_density_projection_linear", _project_sql(2, 4))
def density_projection_linear(spark, sf):
    """J6, J7 with two functions a cell and dimension."""
    p = points(spark, sf, "l_quantity", "l_extendedprice")
    return normalised(M.project(p, ["x1", "x2"], 2, sparse(2, 4)), counted(p), [f"v{k}" for k in range(4)])


@query("j06_cell_projection", f"WITH {_points_sql('l_extendedprice')} SELECT CAST(floor(x1 * 32) AS BIGINT) AS cell, " + ", ".join(f"round(sum({2.0**2.5!r}::DOUBLE * {p}) / any_value(n), 8) + 0.0 AS s{m}" for m, p in enumerate(_phi_sql("(x1 * 32 - floor(x1 * 32))", 3))) + " FROM pt, n GROUP BY 1")
def cell_projection(spark, sf):
    """The prices of lineitem on three Legendre functions of each of 32 cells."""
    p = points(spark, sf, "l_extendedprice")
    n = p.where("x1 IS NOT NULL").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return M.cell_coefficients(p, [], "x1", 3, 5).join(F.broadcast(n)).select("cell", *[(F.round(F.col(f"s{m}") / F.col("n"), 8) + 0.0).alias(f"s{m}") for m in range(3)])


@query("j06_compressed_projection", _project_sql(2, 4))
def compressed_projection(spark, sf):
    """I11, J6, J7 from the moments of the finest cells, laid on Gauss nodes, in place of the rows: the same coefficients from one pass over the table."""
    p = points(spark, sf, "l_quantity", "l_extendedprice")
    state = M.project(M.compress(p, ["x1", "x2"], 2, 4), ["x1", "x2"], 2, sparse(2, 4), "w")
    return normalised(state, counted(p), [f"v{k}" for k in range(4)])


#: Adapted density: levels of a dimension, level of the first set, threshold.
LEVELS, START, THRESHOLD = 4, 2, 0.0573


def _adapted_sql(rounds: int) -> str:
    """All elements up to the limits with their coefficients; the set grows by rounds until nothing can be new."""
    head = f"""WITH {_points_sql('l_quantity', 'l_extendedprice')},
met AS (SELECT {index_sql('x1', 'l1')} AS i1, {index_sql('x2', 'l2')} AS i2, sum(({psi_sql('x1', 'l1', 1, 0)}) * ({psi_sql('x2', 'l2', 1, 0)})) AS v FROM pt, generate_series(0, {LEVELS}) a(l1), generate_series(0, {LEVELS}) b(l2) GROUP BY ALL),
u AS (SELECT i1, i2, coalesce(v, 0.0) AS v, CASE WHEN i1 = 0 THEN 0 ELSE length(bin(i1)) END AS l1, CASE WHEN i2 = 0 THEN 0 ELSE length(bin(i2)) END AS l2 FROM generate_series(0, {2**LEVELS - 1}) a(i1) CROSS JOIN generate_series(0, {2**LEVELS - 1}) b(i2) LEFT JOIN met USING (i1, i2)),
e0 AS MATERIALIZED (SELECT * FROM u WHERE l1 + l2 <= {START})"""
    for k in range(rounds):
        big = f"(SELECT * FROM e{k} WHERE abs(v) >= {THRESHOLD!r}::DOUBLE * (SELECT max(abs(v)) FROM e{k}))"
        kids = f"(SELECT unnest(CASE WHEN i1 = 0 THEN [1] ELSE [2 * i1, 2 * i1 + 1] END) AS i1, i2 FROM {big} UNION SELECT i1, unnest(CASE WHEN i2 = 0 THEN [1] ELSE [2 * i2, 2 * i2 + 1] END) FROM {big})"
        head += f",\ne{k + 1} AS MATERIALIZED (SELECT * FROM e{k} UNION SELECT u.* FROM u JOIN {kids} USING (i1, i2))"
    return f"{head}\nSELECT i1, i2, round(v / n, {ROUND}) + 0.0 AS v0 FROM e{rounds}, n WHERE abs(v) > {A.COARSEN * THRESHOLD!r}::DOUBLE * (SELECT max(abs(v)) FROM e{rounds})"


@query("k11_adapted_density", _adapted_sql(2 * LEVELS))
def adapted_density(spark, sf):
    """The density of lineitem on a set of elements that is refined until nothing is new, then coarsened."""
    p = points(spark, sf, "l_quantity", "l_extendedprice")
    return normalised(A.adapted_density(p, ["x1", "x2"], 1, [LEVELS, LEVELS], START, THRESHOLD), counted(p), ["v0"])


#: Entries of the operator of a step: (row, col) by the indices of one dimension.
STEP_ROUNDS = 4


def _step_rows(spark, n: int):
    """1 on the diagonal, and a tenth of 1 / (1 + |row - col|) towards the parent and the children."""
    cells = spark.range(n).select(F.col("id").alias("row"))
    near = F.array(F.col("row"), F.shiftright("row", 1), 2 * F.col("row"), 2 * F.col("row") + 1)
    rows = cells.select("row", F.explode(F.array_distinct(near)).alias("col")).where(F.col("col") < n)
    return rows.withColumn("v", F.when(F.col("row") == F.col("col"), 1.0).otherwise(F.lit(0.1) / (1 + F.abs(F.col("row") - F.col("col")))))


def _step_sql(rounds: int) -> str:
    """The same step over explicit pairs of elements, redone on the wider set in each round."""
    a = lambda r, c: f"CASE WHEN {r} = {c} THEN 1.0 WHEN {r} >> 1 = {c} OR {c} >> 1 = {r} THEN 0.1 / (1 + abs({r} - {c})) ELSE 0.0 END"
    limit = 2**LEVELS
    level = lambda x: f"CASE WHEN {x} = 0 THEN 0 ELSE length(bin({x})) END"
    head = f"""WITH {_points_sql('l_quantity', 'l_extendedprice')},
met AS (SELECT {index_sql('x1', 'l1')} AS i1, {index_sql('x2', 'l2')} AS i2, sum(({psi_sql('x1', 'l1', 1, 0)}) * ({psi_sql('x2', 'l2', 1, 0)})) AS v FROM pt, generate_series(0, 2) a(l1), generate_series(0, 2) b(l2) WHERE l1 + l2 <= 2 GROUP BY ALL),
f AS (SELECT i1, i2, coalesce(v, 0.0) AS v FROM generate_series(0, 3) a(i1) CROSS JOIN generate_series(0, 3) b(i2) LEFT JOIN met USING (i1, i2) WHERE {level('i1')} + {level('i2')} <= 2),
s0 AS MATERIALIZED (SELECT * FROM f WHERE abs(v) > {A.COARSEN * THRESHOLD!r}::DOUBLE * (SELECT max(abs(v)) FROM f))"""
    for k in range(rounds):
        head += f",\ny{k} AS MATERIALIZED (SELECT r.i1, r.i2, sum(({a('r.i1', 'c.i1')}) * ({a('r.i2', 'c.i2')}) * c.v) AS v FROM s{k} r, s{k} c GROUP BY ALL)"
        if k < rounds - 1:
            big = f"(SELECT * FROM y{k} WHERE abs(v) >= {THRESHOLD!r}::DOUBLE * (SELECT max(abs(v)) FROM y{k}))"
            kids = f"(SELECT unnest(CASE WHEN i1 = 0 THEN [1] ELSE [2 * i1, 2 * i1 + 1] END) AS i1, i2 FROM {big} UNION SELECT i1, unnest(CASE WHEN i2 = 0 THEN [1] ELSE [2 * i2, 2 * i2 + 1] END) FROM {big})"
            head += f",\ns{k + 1} AS MATERIALIZED (SELECT * FROM s{k} UNION ALL SELECT i1, i2, 0.0 FROM {kids} WHERE i1 < {limit} AND i2 < {limit} AND (i1, i2) NOT IN (SELECT (i1, i2) FROM s{k}))"
    return f"{head}\nSELECT i1, i2, round(v / n, {ROUND}) + 0.0 AS v0 FROM y{rounds - 1}, n"


@query("k05_adapted_step", _step_sql(2 * LEVELS + 1))
def adapted_step(spark, sf):
    """K5: a step of an adapted density by a Kronecker operator, made again on a wider set until the set is stable."""
    p = points(spark, sf, "l_quantity", "l_extendedprice")
    first = A.with_zeros(A.sparse_elements(spark, 2, [LEVELS, LEVELS], 2), M.project(p, ["x1", "x2"], 1, sparse(2, 2)), 2)
    op = _step_rows(spark, 2**LEVELS)

    def step(state, members):
        own = [F.col(c).alias(f"m{k}") for k, c in enumerate(("i1", "i2"), 1)]
        x = state.withColumnRenamed("v0", "v")
        for k in (1, 2):
            factor = op.select(F.col("row").alias("o_row"), F.col("col").alias("o_col"), F.col("v").alias("o_v"))
            x = x.join(factor, F.col(f"i{k}") == F.col("o_col")).groupBy(F.col("o_row").alias(f"i{k}"), F.col(f"i{3 - k}")).agg(F.sum(F.col("v") * F.col("o_v")).alias("v"))
        return x.join(members.select(*own), (F.col("i1") == F.col("m1")) & (F.col("i2") == F.col("m2")), "left_semi").select("i1", "i2", F.col("v").alias("v0"))

    return normalised(A.adapted_advance(first, step, 2, [LEVELS, LEVELS], THRESHOLD), counted(p), ["v0"])


#: Four columns of lineitem, levels of the sparse grid.
FOUR, LIMIT4 = ("l_quantity", "l_discount", "l_tax", "l_extendedprice"), 3


def _directional_sql() -> str:
    lev = ", ".join(f"generate_series(0, {LIMIT4}) g{k}(l{k})" for k in range(1, 5))
    index = ", ".join(f"{index_sql(f'x{k}', f'l{k}')} AS i{k}" for k in range(1, 5))
    value = " * ".join(f"({psi_sql(f'x{k}', f'l{k}', 1, 0)})" for k in range(1, 5))
    level = " + ".join(f"CASE WHEN i{k} = 0 THEN 0 ELSE length(bin(i{k})) END" for k in range(1, 5))
    every = ", ".join(f"generate_series(0, {2**LIMIT4 - 1}) h{k}(i{k})" for k in range(1, 5))
    entry = " * ".join(f"(({k} + r.i{k} + 2 * x.i{k})::DOUBLE / (1 + abs(r.i{k} - x.i{k})))" for k in range(1, 5))
    return f"""WITH {_points_sql(*FOUR)}, x AS MATERIALIZED (SELECT {index}, sum({value}) AS v FROM pt, {lev} WHERE l1 + l2 + l3 + l4 <= {LIMIT4} GROUP BY ALL),
e AS (SELECT i1, i2, i3, i4 FROM {every} WHERE {level} <= {LIMIT4})
SELECT r.i1, r.i2, r.i3, r.i4, round(sum({entry} * x.v) / any_value(n), 6) + 0.0 AS v FROM e r, x, n GROUP BY ALL"""


def dense(spark, k: int, n: int):
    """The operator of dimension k: every entry of an n by n matrix."""
    rows = spark.range(n).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("col"))
    return rows.withColumn("v", (k + F.col("row") + 2 * F.col("col")).cast("double") / (1 + F.abs(F.col("row") - F.col("col"))))


@query("c24_directional_apply", _directional_sql())
def directional(spark, sf):
    """A Kronecker operator on the density of lineitem in four dimensions, in unidirectional passes over the sparse grid."""
    p = points(spark, sf, *FOUR)
    state = M.project(p, [f"x{k}" for k in range(1, 5)], 1, sparse(4, LIMIT4)).withColumnRenamed("v0", "v")
    members = A.sparse_elements(spark, 4, [LIMIT4] * 4, LIMIT4)
    found = C.directional_apply(state, [dense(spark, k, 2**LIMIT4) for k in range(1, 5)], 4, members)
    return found.join(F.broadcast(counted(p))).select("i1", "i2", "i3", "i4", (F.round(F.col("v") / F.col("n"), 6) + 0.0).alias("v"))


#: Cascade: levels of the time of the events, and the start and length of the time that they cover.
CASCADE = 6
TIME = ("TIMESTAMP '2024-01-01 00:00:00'", 86400.0 * 32)


def timed(spark, sf):
    """event_type, x (place in the covered time), w (value) of the events."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.expr(TIME[0]))) / 1e6
    return read(spark, sf, "events").select("event_type", M.scaled(at, 0.0, TIME[1]).alias("x"), F.col("value").alias("w"))


TIMED = f"ev AS (SELECT event_type, x, w FROM (SELECT event_type, (epoch_us(ts) - epoch_us({TIME[0]})) / 1e6 / {TIME[1]!r}::DOUBLE AS x, value AS w FROM events) WHERE x >= 0 AND x < 1), n AS (SELECT event_type, sum(w) AS n FROM ev GROUP BY event_type)"


def _cascade_sql(degree: int) -> str:
    values = ", ".join(f"round(sum(w * ({psi_sql('x', 'lev', degree, j)})) / any_value(n), 6) + 0.0 AS w{j}" for j in range(degree))
    cell = "CASE WHEN lev = 0 THEN 0 ELSE CAST(floor(x * power(2, lev - 1)) AS BIGINT) END"
    return f"WITH {TIMED} SELECT event_type, lev::INTEGER AS lev, cell, {values} FROM (SELECT ev.*, n, lev, {cell} AS cell FROM ev JOIN n USING (event_type), generate_series(0, {CASCADE}) g(lev)) GROUP BY event_type, lev, cell"


def _cascade(spark, sf, degree):
    e = timed(spark, sf)
    total = e.where("x IS NOT NULL").groupBy(F.col("event_type").alias("t")).agg(F.sum("w").alias("n"))
    coefs = M.analyse(M.cell_coefficients(e, ["event_type"], "x", degree, CASCADE, "w"), ["event_type"], degree, CASCADE)
    both = coefs.join(F.broadcast(total), F.col("event_type").eqNullSafe(F.col("t")))  # one row per type of event
    return both.select("event_type", "lev", "cell", *[(F.round(F.col(f"w{j}") / F.col("n"), 6) + 0.0).alias(f"w{j}") for j in range(degree)])


@query("j05_cascade", _cascade_sql(2))
def cascade(spark, sf):
    """The wavelet coefficients of the events' values over time, degree 2, by the two-scale filter level by level."""
    return _cascade(spark, sf, 2)


@query("j05_cascade_quadratic", _cascade_sql(3))
def cascade_quadratic(spark, sf):
    """J1 to J5 with three functions a cell."""
    return _cascade(spark, sf, 3)


def _inverse_sql(degree: int) -> str:
    u = f"(x * {2**CASCADE} - floor(x * {2**CASCADE}))"
    values = ", ".join(f"round(sum(w * {2.0 ** (CASCADE / 2)!r}::DOUBLE * {p}) / any_value(n), 6) + 0.0 AS s{m}" for m, p in enumerate(_phi_sql(u, degree)))
    every = f"(SELECT event_type, c FROM n, generate_series(0, {2**CASCADE - 1}) g(c))"
    return f"WITH {TIMED}, s AS (SELECT event_type, CAST(floor(x * {2**CASCADE}) AS BIGINT) AS cell, {values} FROM ev JOIN n USING (event_type) GROUP BY ALL) SELECT a.event_type, a.c AS cell, {', '.join(f'coalesce(s{m}, 0.0) AS s{m}' for m in range(degree))} FROM {every} a LEFT JOIN s ON s.event_type = a.event_type AND s.cell = a.c"


@query("j05_cascade_inverse", _inverse_sql(2))
def cascade_inverse(spark, sf):
    """Forth and back gives the cells' own coefficients."""
    e = timed(spark, sf)
    total = e.where("x IS NOT NULL").groupBy(F.col("event_type").alias("t")).agg(F.sum("w").alias("n"))
    coefs = M.analyse(M.cell_coefficients(e, ["event_type"], "x", 2, CASCADE, "w"), ["event_type"], 2, CASCADE)
    cells = M.synthesise(coefs, ["event_type"], 2, CASCADE).join(F.broadcast(total), F.col("event_type").eqNullSafe(F.col("t")))
    return cells.select("event_type", "cell", *[(F.round(F.col(f"s{m}") / F.col("n"), 6) + 0.0).alias(f"s{m}") for m in range(2)])


@query("j10_density_at_rows", f"""WITH {_points_sql('l_quantity', 'l_extendedprice')},
lev AS (SELECT l1, l2 FROM generate_series(0, 4) a(l1), generate_series(0, 4) b(l2) WHERE l1 + l2 <= 4),
met AS (SELECT rn, {index_sql('x1', 'l1')} AS i1, {index_sql('x2', 'l2')} AS i2, ({psi_sql('x1', 'l1', 1, 0)}) * ({psi_sql('x2', 'l2', 1, 0)}) AS p FROM pt, lev),
coef AS (SELECT i1, i2, sum(p) / any_value(n) AS v FROM met, n GROUP BY ALL), val AS (SELECT rn, round(sum(p * v), 6) + 0.0 AS density FROM met JOIN coef USING (i1, i2) GROUP BY rn)
SELECT density, count(*) AS n_rows FROM val GROUP BY density""")
def density_at_rows(spark, sf):
    """The sparse-grid density of lineitem evaluated at each of its rows, counted by value."""
    p = points(spark, sf, "l_quantity", "l_extendedprice").where("x1 IS NOT NULL AND x2 IS NOT NULL")
    state = M.project(p, ["x1", "x2"], 1, sparse(2, 4))
    found = M.evaluate(p, ["x1", "x2"], state, 1, sparse(2, 4)).join(F.broadcast(counted(p)))
    return found.groupBy((F.round(F.col("value") / F.col("n"), 6) + 0.0).alias("density")).agg(F.count(F.lit(1)).alias("n_rows"))


#: Strength of the smoothing of a daily series.
STRENGTH = 5.0


@query("k20_smoothed_series", f"""WITH RECURSIVE s AS (SELECT day, y, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM (SELECT epoch(date_trunc('day', l_shipdate))::BIGINT // 86400 AS day, sum(l_quantity) AS y FROM lineitem GROUP BY 1)),
t AS (SELECT day, k, n, y, CASE WHEN k = 1 THEN 0.0 ELSE -{STRENGTH} END AS a, CASE WHEN k = n THEN 0.0 ELSE -{STRENGTH} END AS c FROM s),
f AS (SELECT 1::BIGINT AS k, c / (1 - c) AS u, y / (1 - c) AS p FROM t WHERE k = 1 UNION ALL SELECT t.k, t.c / (1 - t.a - t.c - t.a * f.u), (t.y - t.a * f.p) / (1 - t.a - t.c - t.a * f.u) FROM f JOIN t ON t.k = f.k + 1),
b AS (SELECT k, p AS x FROM f WHERE k = (SELECT max(n) FROM t) UNION ALL SELECT f.k, f.p - f.u * b.x FROM b JOIN f ON f.k = b.k - 1)
SELECT t.day, round(b.x, 6) + 0.0 AS x FROM b JOIN t USING (k)""")
def smoothed_series(spark, sf):
    """Daily quantities of lineitem, smoothed by a tridiagonal system that is solved in parts."""
    day = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86_400_000_000).cast("long")
    series = read(spark, sf, "lineitem").groupBy(day.alias("k")).agg(F.sum("l_quantity").alias("y"))
    return T.smoothed(series, STRENGTH, 8).select(F.col("k").alias("day"), (F.round("x", 6) + 0.0).alias("x"))


NODES = 1000


@query("k23_poisson_histogram", f"""WITH g AS (SELECT k, coalesce(y, 0.0) / {NODES}::DOUBLE AS g FROM generate_series(1, {NODES - 1}) s(k) LEFT JOIN (SELECT CAST(floor(l_extendedprice / 110000.0 * {NODES}) AS BIGINT) AS k, count(*)::DOUBLE AS y FROM lineitem GROUP BY 1) h USING (k)),
c AS (SELECT k, sum(g) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM g), d AS (SELECT k, sum(c) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS d FROM c),
one AS (SELECT max(d) / {NODES} AS d1 FROM d), x AS (SELECT k, (k * d1 - coalesce(lag(d) OVER (ORDER BY k), 0.0)) / {NODES}::DOUBLE AS x FROM d, one)
SELECT k, round(x / t, 9) + 0.0 AS x, round((coalesce(lag(x) OVER (ORDER BY k), 0.0) - x) * {NODES} / t, 6) + 0.0 AS e FROM x, (SELECT count(*)::DOUBLE AS t FROM lineitem)""")
def poisson_histogram(spark, sf):
    """The potential of the histogram of prices between two grounded ends, and its field."""
    li = read(spark, sf, "lineitem")
    counts = li.groupBy(F.floor(F.col("l_extendedprice") / 110000.0 * NODES).cast("long").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    total = li.agg(F.count(F.lit(1)).cast("double").alias("t"))
    found = T.poisson(counts, NODES, 0.0, 1.0, parts=8).join(F.broadcast(total))
    return found.select("k", (F.round(F.col("x") / F.col("t"), 9) + 0.0).alias("x"), (F.round(F.col("e") / F.col("t"), 6) + 0.0).alias("e"))


#: Steps of the events' evolution: seconds, what is left of the state after a step, functions of the value.
STEP, DECAY, FUNCTIONS, LATE = 86_400, 0.5, 3, 86_400


def _events(e):
    return e.select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), M.scaled(F.col("value"), 0.0, 1000.0).alias("x"))


def _steps_sql(closed: str) -> str:
    sums = ", ".join(f"sum({p}) AS s{m}" for m, p in enumerate(_phi_sql("x", FUNCTIONS)))
    values = ", ".join(f"round(sum(b.s{m} * power({DECAY}, a.step - b.step)), 6) + 0.0 AS v{m}" for m in range(FUNCTIONS))
    return f"""WITH e AS (SELECT event_type AS key, epoch_us(ts) // {STEP * 1_000_000} AS step, value / 1000.0 AS x FROM events WHERE value >= 0 AND value < 1000), s AS (SELECT key, step, {sums} FROM e GROUP BY ALL),
v AS (SELECT a.key, a.step, count(*) AS version, {values} FROM s a JOIN s b ON a.key = b.key AND b.step <= a.step GROUP BY ALL) SELECT * FROM v{closed}"""


def _flat(steps):
    return steps.select("key", "step", "version", *[(F.round(F.col("v")[m], 6) + 0.0).alias(f"v{m}") for m in range(FUNCTIONS)])


@query("l01_evolved_steps", _steps_sql(""))
def evolved_steps(spark, sf):
    """L1: the coefficients of each type of event after each day, with what the days before have left."""
    return _flat(E.evolved(_events(read(spark, sf, "events")), STEP, DECAY, FUNCTIONS))


@query("l01_streamed_steps", _steps_sql(f" WHERE (step + 1) * {STEP} <= (SELECT max(epoch_us(ts)) FROM events) / 1000000.0 - {LATE}"))
def streamed_steps(spark, sf):
    """L1, L2: the same days from a stateful stream over the table; days that the watermark hasn't passed are still open."""
    path, name = f"{sf}/events.parquet", "spark.sql.streaming.stateStore.providerClass"
    base, before = Scratch(spark, "steps").base, spark.conf.get(name)
    Scratch.open[base] = spark
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may stand for a file or a folder
    spark.conf.set(name, E.STORE)
    try:
        steps = E.evolved_stream(_events(stream), STEP, DECAY, FUNCTIONS, f"{LATE} seconds")
        steps.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    finally:
        spark.conf.set(name, before)
    return _flat(spark.read.schema(E.OUT).parquet(f"{base}/out"))


#: Suppliers whose values are sent to all tasks; the values of more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def supplier_graph(spark, sf):
    """(row, col, v): how often two suppliers stand on neighbouring lines of an order, in both directions; and the suppliers (k, d, b)."""
    line = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    pairs = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("row"), F.lead("l_suppkey").over(line).alias("col")).where("col IS NOT NULL AND row <> col")
    both = pairs.unionByName(pairs.select(F.col("col").alias("row"), F.col("row").alias("col")))
    edges = both.groupBy("row", "col").agg(F.count(F.lit(1)).cast("double").alias("v"))
    degree = edges.groupBy(F.col("row").alias("g")).agg(F.sum("v").alias("g_v"))
    nodes = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").cast("double").alias("b"))
    return edges, nodes.join(degree, F.col("k") == F.col("g"), "left").select("k", (1 + 1.5 * F.coalesce("g_v", F.lit(0.0))).alias("d"), "b")


@query("k13_graph_gmres", """WITH RECURSIVE p AS (SELECT l_suppkey AS r, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS c FROM lineitem),
w AS MATERIALIZED (SELECT r, c, count(*)::DOUBLE AS w FROM (SELECT r, c FROM p WHERE c IS NOT NULL AND r <> c UNION ALL SELECT c, r FROM p WHERE c IS NOT NULL AND r <> c) GROUP BY ALL),
node AS MATERIALIZED (SELECT s_suppkey AS k, s_acctbal::DOUBLE AS b, 1 + 1.5 * coalesce(g, 0.0) AS d FROM supplier LEFT JOIN (SELECT r, sum(w) AS g FROM w GROUP BY r) ON r = s_suppkey),
j AS (SELECT 0 AS n, k, 0.0::DOUBLE AS x FROM node UNION ALL SELECT a.n + 1, a.k, (any_value(a.b) + coalesce(sum(w.w * o.x), 0.0)) / any_value(a.d) FROM (SELECT j.n, node.* FROM j JOIN node USING (k) WHERE j.n < 90) a LEFT JOIN w ON w.r = a.k LEFT JOIN j o ON o.k = w.c GROUP BY a.n, a.k)
SELECT k, round(x, 6) + 0.0 AS x FROM j WHERE n = 90""")
def graph_gmres(spark, sf):
    """Balances spread over the graph of suppliers, by GMRES with a restart after ten steps and a diagonal preconditioner."""
    edges, nodes = supplier_graph(spark, sf)
    scratch = Scratch(spark, "graph")
    nodes = scratch.write(nodes)
    # a row's entries lie together, so that its sum is made before the shuffle
    matrix = edges.select("row", "col", (-F.col("v")).alias("v")).unionByName(nodes.select(F.col("k").alias("row"), F.col("k").alias("col"), F.col("d").alias("v")))
    matrix = scratch.write(matrix.repartition("row"))
    sent = F.broadcast if nodes.count() <= BROADCAST_ROWS else lambda df: df

    def apply(x):
        own = sent(x.select(F.col("k").alias("x_k"), F.col("v").alias("x_v")))
        return matrix.join(own, F.col("col") == F.col("x_k")).groupBy(F.col("row").alias("k")).agg(F.sum(F.col("v") * F.col("x_v")).alias("v"))

    diagonal = krylov.jacobi(["k"], sent(nodes.select("k", F.col("d").alias("v"))))
    found = krylov.gmres(["k"], apply, nodes.select("k", F.col("b").alias("v")), restart=10, tolerance=1e-12, precondition=diagonal)
    every = nodes.join(found.x.select(F.col("k").alias("x_k"), "v"), F.col("k") == F.col("x_k"), "left")
    return every.select("k", (F.round(F.coalesce("v", F.lit(0.0)), 6) + 0.0).alias("x"))


#: Each vector of the embeddings as a matrix of three, with 3 on the diagonal, and two right-hand sides.
M3 = "m AS (SELECT vec_id, " + ", ".join(f"embedding[{k + 1}]::DOUBLE + {3.0 if k % 4 == 0 else 0.0} AS m{k // 3}{k % 3}" for k in range(9)) + ", " + ", ".join(f"embedding[{10 + k}]::DOUBLE AS y{k}, embedding[{13 + k}]::DOUBLE AS z{k}" for k in range(3)) + " FROM embeddings)"


def _minor(r: int, c: int) -> str:
    """The signed minor of (r, c) as SQL."""
    (a, b), (d, e) = [i for i in range(3) if i != r], [j for j in range(3) if j != c]
    return f"{'-' if (r + c) % 2 else ''}(m{a}{d} * m{b}{e} - m{a}{e} * m{b}{d})"


DET = "(" + " + ".join(f"m0{c} * ({_minor(0, c)})" for c in range(3)) + ")"


def _solved(y: str, k: int) -> str:
    """Entry k of the solution for the right-hand side y, by minors."""
    return "(" + " + ".join(f"({_minor(r, k)}) * {y}{r}" for r in range(3)) + f") / {DET}"


def systems(spark, sf):
    """vec_id, a, y, z of the embeddings."""
    e = F.col("embedding").cast("array<double>")
    a = F.transform(F.slice(e, 1, 9), lambda v, k: v + F.when(k % 4 == 0, 3.0).otherwise(0.0))
    return read(spark, sf, "embeddings").select("vec_id", a.alias("a"), F.slice(e, 10, 3).alias("y"), F.slice(e, 13, 3).alias("z"))


def _spread(column: str, names: list[str]):
    return [(F.round(F.col(column)[k], 6) + 0.0).alias(n) for k, n in enumerate(names)]


@query("e34_determinants", f"WITH {M3} SELECT vec_id, round({DET}, 6) + 0.0 AS det FROM m")
def determinants(spark, sf):
    """Of each vector's matrix."""
    return Dense.factored(systems(spark, sf), 3, "a", [], ["vec_id"]).select("vec_id", (F.round("det", 6) + 0.0).alias("det"))


@query("i17_inverses", f"WITH {M3} SELECT vec_id, " + ", ".join(f"round(({_minor(k % 3, k // 3)}) / {DET}, 6) + 0.0 AS v{k}" for k in range(9)) + " FROM m")
def inverses(spark, sf):
    """Of each vector's matrix, row by row."""
    return Dense.factored(systems(spark, sf), 3, "a", [], ["vec_id"]).select("vec_id", *_spread("inverse", [f"v{k}" for k in range(9)]))


@query("k18_dense_solutions", f"WITH {M3} SELECT vec_id, " + ", ".join(f"round({_solved('y', k)}, 6) + 0.0 AS x{k}" for k in range(3)) + " FROM m")
def dense_solutions(spark, sf):
    """A system for each vector."""
    return Dense.factored(systems(spark, sf), 3, "a", ["y"], ["vec_id"]).select("vec_id", *_spread("x0", ["x0", "x1", "x2"]))


@query("k19_two_right_sides", f"WITH {M3} SELECT vec_id, " + ", ".join(f"round({_solved(y, k)}, 6) + 0.0 AS {n}{k}" for y, n in (("y", "p"), ("z", "q")) for k in range(3)) + " FROM m")
def two_right_sides(spark, sf):
    """Two right-hand sides of each vector's system."""
    found = Dense.factored(systems(spark, sf), 3, "a", ["y", "z"], ["vec_id"])
    return found.select("vec_id", *_spread("x0", ["p0", "p1", "p2"]), *_spread("x1", ["q0", "q1", "q2"]))


@query("k21_back_substitution", f"WITH {M3}, c AS (SELECT vec_id, m00, m01, m02, m11, m12, y0, y1, y2 / m22 AS x2 FROM m), b AS (SELECT *, (y1 - m12 * x2) / m11 AS x1 FROM c) SELECT vec_id, round((y0 - m01 * x1 - m02 * x2) / m00, 6) + 0.0 AS x0, round(x1, 6) + 0.0 AS x1, round(x2, 6) + 0.0 AS x2 FROM b")
def back_substitution(spark, sf):
    """The upper triangle of each vector's matrix, packed, solved in the row."""
    a = F.col("a")
    packed = F.array(*[F.get(a, F.lit(3 * i + j)) for j in range(3) for i in range(j + 1)])
    found = systems(spark, sf).select("vec_id", Dense.back_substituted(packed, F.col("y"), 3).alias("x"))
    return found.select("vec_id", *_spread("x", ["x0", "x1", "x2"]))


#: Steps of the density of the prices: level, size of a step.
FINE, DT = 4, 0.01
CELLS = 2**FINE
HISTOGRAM = f"{_points_sql('l_extendedprice')}, u AS MATERIALIZED (SELECT i, coalesce(c, 0.0) AS u FROM generate_series(0, {CELLS - 1}) s(i) LEFT JOIN (SELECT CAST(floor(x1 * {CELLS}) AS BIGINT) AS i, count(*)::DOUBLE AS c FROM pt GROUP BY 1) h USING (i))"
TO_HAAR = f"SELECT {index_sql('x', 'lev')} AS i1, round(sum(u * ({psi_sql('x', 'lev', 1, 0)})) / any_value(n), 8) + 0.0 AS v FROM (SELECT (i + 0.5::DOUBLE) / {CELLS} AS x, u FROM {{t}}), n, generate_series(0, {FINE}) g(lev) GROUP BY 1"


def density_problem(*terms):
    """A problem on the unit interval whose initial state comes from a table."""
    return Problem("density", (Dim(0.0, 1.0, FINE, 1),), tuple(Term((t,)) for t in terms), ((one,),))


def _prices(spark, sf):
    p = points(spark, sf, "l_extendedprice")
    return p, M.project(p, ["x1"], 1, [(k,) for k in range(FINE + 1)]).withColumnRenamed("v0", "v")


def _per_row(p, state):
    n = p.where("x1 IS NOT NULL").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return state.join(F.broadcast(n)).select("i1", (F.round(F.col("v") / F.col("n"), 8) + 0.0).alias("v"))


def _slope(t: str, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT a.i, (b.u - a.u) * {CELLS} AS u FROM {t} a JOIN {t} b ON b.i = (a.i + {CELLS - 1}) % {CELLS})"


def _rk3(start: str, p: str) -> str:
    add = lambda name, *parts: f"{name} AS MATERIALIZED (SELECT i, sum(u) AS u FROM (" + " UNION ALL ".join(f"SELECT i, {w!r}::DOUBLE * u AS u FROM {t}" for w, t in parts) + ") GROUP BY i)"
    return ", ".join([
        _slope(start, f"{p}1"), add(f"{p}a", (1.0, start), (0.5 * DT, f"{p}1")), _slope(f"{p}a", f"{p}2"), add(f"{p}b", (1.0, start), (-DT, f"{p}1"), (2 * DT, f"{p}2")), _slope(f"{p}b", f"{p}3"),
        add(f"{p}u", (1.0, start), (DT / 6, f"{p}1"), (2 * DT / 3, f"{p}2"), (DT / 6, f"{p}3"))])


@query("k01_density_transport", f"WITH {HISTOGRAM}, {_rk3('u', 'p')}, {_rk3('pu', 'q')} {TO_HAAR.format(t='qu')}")
def density_transport(spark, sf):
    """The density of prices carried along a periodic axis, two explicit steps with the state in DataFrames throughout."""
    p, state = _prices(spark, sf)
    jobs = D.Steps(spark, density_problem((Partial("div", lambda x, t=0.0: -np.ones_like(x), "downwind"),)))
    for k in range(2):
        state = jobs.explicit(state, k * DT, DT)
    return _per_row(p, state)


A_DT = 0.001 * CELLS * CELLS


@query("k03_density_diffusion", f"""WITH RECURSIVE {HISTOGRAM}, t AS (SELECT i + 1 AS k, u AS y, CASE WHEN i = 0 THEN 0.0 ELSE -{A_DT!r}::DOUBLE END AS a, CASE WHEN i = {CELLS - 1} THEN 0.0 ELSE -{A_DT!r}::DOUBLE END AS c FROM u),
f AS (SELECT 1::BIGINT AS k, c / (1 - c) AS g, y / (1 - c) AS p FROM t WHERE k = 1 UNION ALL SELECT t.k, t.c / (1 - t.a - t.c - t.a * f.g), (t.y - t.a * f.p) / (1 - t.a - t.c - t.a * f.g) FROM f JOIN t ON t.k = f.k + 1),
b AS (SELECT k, p AS x FROM f WHERE k = {CELLS} UNION ALL SELECT f.k, f.p - f.g * b.x FROM b JOIN f ON f.k = b.k - 1), w AS (SELECT k - 1 AS i, x AS u FROM b) {TO_HAAR.format(t='w')}""")
def density_diffusion(spark, sf):
    """A backward Euler step of the diffusion of the density of prices, by GMRES on vectors in long form."""
    p, state = _prices(spark, sf)
    chain = (Partial("div", None, "downwind", "dirichlet", "dirichlet"), Partial("grad", None, "upwind", "neumann", "neumann"))
    return _per_row(p, D.Steps(spark, density_problem(chain)).implicit(state, 0.0, 0.001, tolerance=1e-12))


#: Prices as space, quantities as velocities: 8 places, 12 speeds up to 6; a step of 0.01 with collisions of rate 2.
KINETIC, KDT, RATE = K.Grid(8, 1.0, 12, 6.0), 0.01, 2.0


def _kinetic_sql() -> str:
    nx, nv, hx, hv, most = KINETIC.places, KINETIC.speeds, KINETIC.hx, KINETIC.hv, KINETIC.most
    v = f"((j + 0.5::DOUBLE) * {hv!r}::DOUBLE - {most!r}::DOUBLE)"

    def mom(s, t):
        return f"{t} AS MATERIALIZED (SELECT x, sum(f) * {hv!r}::DOUBLE AS n, coalesce(sum({v} * f) / nullif(sum(f), 0), 0) AS u, coalesce(sum({v} * {v} * f) / nullif(sum(f), 0), 0) - power(coalesce(sum({v} * f) / nullif(sum(f), 0), 0), 2) AS th FROM {s} GROUP BY x)"

    def field(m, t):
        return (f"{t}g AS (SELECT x, (n - (SELECT avg(n) FROM {m})) * {hx * hx!r}::DOUBLE AS g FROM {m} WHERE x > 0), {t}c AS (SELECT x, sum(g) OVER (ORDER BY x) AS c FROM {t}g), {t}d AS (SELECT x, sum(c) OVER (ORDER BY x) AS d FROM {t}c), "
                f"{t}p AS (SELECT x, x * (SELECT d FROM {t}d WHERE x = {nx - 1}) / {nx} - coalesce(lag(d) OVER (ORDER BY x), 0) AS p FROM {t}d UNION ALL SELECT 0, 0), "
                f"{t} AS MATERIALIZED (SELECT a.x, (b.p - c.p) / {2 * hx!r}::DOUBLE AS e FROM {t}p a JOIN {t}p b ON b.x = (a.x + {nx - 1}) % {nx} JOIN {t}p c ON c.x = (a.x + 1) % {nx})")

    def carry(s, e, t):
        base = f"(SELECT {s}.x, j, f, {v} AS v, e, CASE WHEN e >= 0 THEN j + 1 ELSE j - 1 END AS w FROM {s} JOIN {e} USING (x))"
        return (f"{t} AS MATERIALIZED (SELECT x, j, sum(f) AS f FROM (SELECT x, j, f - abs(v) / {hx!r}::DOUBLE * f * {KDT} - CASE WHEN w BETWEEN 0 AND {nv - 1} THEN abs(e) / {hv!r}::DOUBLE * f * {KDT} ELSE 0 END AS f FROM {base} "
                f"UNION ALL SELECT CASE WHEN v >= 0 THEN (x + 1) % {nx} ELSE (x + {nx - 1}) % {nx} END, j, abs(v) / {hx!r}::DOUBLE * f * {KDT} FROM {base} UNION ALL SELECT x, w, abs(e) / {hv!r}::DOUBLE * f * {KDT} FROM {base} WHERE w BETWEEN 0 AND {nv - 1}) GROUP BY ALL)")

    def collide(s, m, tau, t):
        low, high = f"((j * {hv!r}::DOUBLE - {most!r}::DOUBLE - u) / 2)", f"(((j + 1) * {hv!r}::DOUBLE - {most!r}::DOUBLE - u) / 2)"
        q = f"(th / {hv!r}::DOUBLE)"
        return (f"{t}r AS MATERIALIZED (SELECT x, j, f AS y, CASE WHEN j = 0 THEN 0 ELSE -{tau!r}::DOUBLE * ({q} - {low}) / {hv!r}::DOUBLE END AS a, CASE WHEN j = {nv - 1} THEN 0 ELSE -{tau!r}::DOUBLE * ({q} + {high}) / {hv!r}::DOUBLE END AS c, "
                f"1 - {tau!r}::DOUBLE * (CASE WHEN j = {nv - 1} THEN 0 ELSE {high} - {q} END - CASE WHEN j = 0 THEN 0 ELSE {low} + {q} END) / {hv!r}::DOUBLE AS b FROM {s} JOIN {m} USING (x)), "
                f"{t}f AS (SELECT x, j, c / b AS g, y / b AS p FROM {t}r WHERE j = 0 UNION ALL SELECT r.x, r.j, r.c / (r.b - r.a * f.g), (r.y - r.a * f.p) / (r.b - r.a * f.g) FROM {t}f f JOIN {t}r r ON r.x = f.x AND r.j = f.j + 1), "
                f"{t} AS (SELECT x, j, p AS f FROM {t}f WHERE j = {nv - 1} UNION ALL SELECT f.x, f.j, f.p - f.g * b.f FROM {t} b JOIN {t}f f ON f.x = b.x AND f.j = b.j - 1)")

    start = f"{_points_sql('l_extendedprice', 'l_quantity')}, s0 AS MATERIALIZED (SELECT x, j, coalesce(c, 0) / (SELECT n FROM n) / {hx * hv!r}::DOUBLE AS f FROM generate_series(0, {nx - 1}) a(x) CROSS JOIN generate_series(0, {nv - 1}) b(j) LEFT JOIN (SELECT CAST(floor(x1 * {nx}) AS BIGINT) AS x, CAST(floor(x2 * {nv}) AS BIGINT) AS j, count(*)::DOUBLE AS c FROM pt GROUP BY ALL) h USING (x, j))"
    parts = [start, mom("s0", "m0"), field("m0", "e0"), carry("s0", "e0", "s1"), mom("s1", "m1"), collide("s1", "m1", RATE * KDT, "s2"), mom("s2", "m2"), field("m2", "e2"), carry("s2", "e2", "s3"),
             "s4 AS MATERIALIZED (SELECT x, j, sum(f) / 2 AS f FROM (SELECT x, j, f FROM s0 UNION ALL SELECT x, j, f FROM s3) GROUP BY ALL)", mom("s4", "m4"), collide("s4", "m4", RATE * KDT / 2, "s5")]
    return f"WITH RECURSIVE {', '.join(parts)} SELECT x, j, round(f, 9) + 0.0 AS f FROM s5"


def kinetic_density(spark, sf):
    p = points(spark, sf, "l_extendedprice", "l_quantity").where("x1 IS NOT NULL AND x2 IS NOT NULL")
    cells = p.groupBy(F.floor(F.col("x1") * KINETIC.places).alias("x"), F.floor(F.col("x2") * KINETIC.speeds).alias("j")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    n = p.agg(F.count(F.lit(1)).cast("double").alias("n"))
    own = cells.join(F.broadcast(n)).select("x", "j", (F.col("c") / F.col("n") / (KINETIC.hx * KINETIC.hv)).alias("f"))
    return K.filled(spark, own, KINETIC)


@query("k04_kinetic_step", _kinetic_sql())
def kinetic_step(spark, sf):
    """An implicit-explicit step of the density of prices and quantities, with moments, field and collisions of each place."""
    state = Scratch(spark, "density").write(kinetic_density(spark, sf))
    return K.step(state, KINETIC, KDT, RATE).select("x", "j", (F.round("f", 9) + 0.0).alias("f"))


@query("a01_snapshots", """SELECT event_type AS run, (epoch_us(ts) // 86400000000)::INTEGER AS step, (epoch_us(ts) // 3600000000 % 24)::BIGINT AS pos, count(*)::DOUBLE AS calls, round(sum(value), 4) AS total
FROM events WHERE event_type IN ('click', 'view') AND epoch_us(ts) // 86400000000 >= (SELECT min(epoch_us(ts)) FROM events) // 86400000000 + 5 GROUP BY ALL""")
def snapshots(spark, sf):
    """A1 to A5: each day of each type of event written as a snapshot through the data source, and some days of two types read back."""
    e, micros = read(spark, sf, "events"), F.unix_micros(F.col("ts").cast("timestamp"))
    day, hour = F.floor(micros / 86_400_000_000).cast("int"), (F.floor(micros / 3_600_000_000) % 24).cast("long")
    sums = e.groupBy(F.col("event_type").alias("run"), day.alias("step"), hour.alias("pos")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("value").alias("v"))
    rows = sums.where("run IS NOT NULL AND step IS NOT NULL").select("run", "step", "pos", F.array(F.lit(0)).alias("lev"), F.array(F.col("pos").cast("int")).alias("cell"), F.array("n", "v").alias("seg"))
    first = e.agg(F.min(day)).first()[0] or 0
    path = Scratch(spark, "snapshots").base
    Scratch.open[path] = spark
    Source.register(spark)
    rows.repartition("run", "step").write.format("gridloom").mode("append").option("path", path).save()
    back = spark.read.format("gridloom").option("path", path).load().where(F.col("run").isin("click", "view") & (F.col("step") >= first + 5))
    return back.select("run", "step", "pos", F.col("seg")[0].alias("calls"), F.round(F.col("seg")[1], 4).alias("total"))


@query("m08_wave_sums", f"WITH o AS (SELECT o_orderpriority AS key, o_totalprice::DOUBLE / 600000.0::DOUBLE AS x FROM orders), p AS (SELECT key, x, {index_sql('x', 'lev')} AS i, lev FROM o, generate_series(0, 4) g(lev) WHERE x >= 0 AND x < 1), n AS (SELECT key, count(*) AS n FROM o GROUP BY key) SELECT key, i, digit, round(v / n, 8) + 0.0 AS v FROM (" + " UNION ALL ".join(f"SELECT key, i, {j} AS digit, sum({psi_sql('x', 'lev', 2, j)}) AS v FROM p GROUP BY key, i" for j in range(2)) + ") JOIN n USING (key)")
def wave_sums(spark, sf):
    """M1 to M4, M8: a table function called from SQL: the wavelet sums of the orders' totals by priority."""
    Tables.register(spark)
    read(spark, sf, "orders").select(F.col("o_orderpriority").alias("key"), (F.col("o_totalprice") / 600000.0).alias("x")).createOrReplaceTempView("gridloom_orders")
    return spark.sql("""WITH s AS (SELECT key, i, digit, sum(v) AS v FROM multiwave_sums(TABLE(gridloom_orders), 2, 4) GROUP BY key, i, digit), n AS (SELECT key AS n_key, count(*) AS n FROM gridloom_orders GROUP BY key)
SELECT key, i, digit, round(v / n, 8) + 0.0D AS v FROM s JOIN n ON key = n_key""")


@query("m02_problem_values", "SELECT c_custkey AS key, 0.0::DOUBLE AS initial, round(cos(pi() * x) * sin(2 * pi() * y) * sin(2 * 0.25::DOUBLE), 9) + 0.0 AS exact FROM (SELECT c_custkey, c_acctbal::DOUBLE / 10000.0::DOUBLE AS x, c_nationkey::DOUBLE / 12.5::DOUBLE - 1 AS y FROM customer)")
def problem_values(spark, sf):
    """A problem's functions at the customers' balances and nations, called from SQL."""
    Tables.register(spark)
    read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") / 10000.0).alias("x1"), (F.col("c_nationkey") / 12.5 - 1).alias("x2")).createOrReplaceTempView("gridloom_points")
    return spark.sql("SELECT key, round(initial, 9) + 0.0D AS initial, round(exact, 9) + 0.0D AS exact FROM problem_values(TABLE(gridloom_points), 'continuity_2', 0.25D)")


#: Two fields over as many cells: their speeds, how fast they exchange, and a step.
PAIR, SPEED, EXCHANGE, PAIR_DT = 16, {"orders": 1.0, "lines": 0.5}, 3.0, 0.01


def _pair_sql() -> str:
    def hist(table, column, most):
        return f"(SELECT i, coalesce(c, 0) / (SELECT count(*) FROM {table})::DOUBLE AS u FROM generate_series(0, {PAIR - 1}) s(i) LEFT JOIN (SELECT CAST(floor({column} / {most}::DOUBLE * {PAIR}) AS BIGINT) AS i, count(*)::DOUBLE AS c FROM {table} GROUP BY 1) h USING (i))"

    def rate(t, name):
        return f"{name} AS MATERIALIZED (SELECT a.f, a.i, (b.u - a.u) * {PAIR} * CASE WHEN a.f = 'orders' THEN {SPEED['orders']} ELSE {SPEED['lines']} END + {EXCHANGE} * (c.u - a.u) AS u FROM {t} a JOIN {t} b ON b.f = a.f AND b.i = (a.i + {PAIR - 1}) % {PAIR} JOIN {t} c ON c.f <> a.f AND c.i = a.i)"

    def add(name, *parts):
        return f"{name} AS MATERIALIZED (SELECT f, i, sum(u) AS u FROM (" + " UNION ALL ".join(f"SELECT f, i, {w!r}::DOUBLE * u AS u FROM {t}" for w, t in parts) + ") GROUP BY f, i)"

    out = f"WITH s0 AS MATERIALIZED (SELECT 'orders' AS f, i, u FROM {hist('orders', 'o_totalprice', 600000)} UNION ALL SELECT 'lines', i, u FROM {hist('lineitem', 'l_extendedprice', 110000)})"
    for k in range(2):
        s, p = f"s{k}", f"r{k}"
        out += ", " + ", ".join([rate(s, f"{p}1"), add(f"{p}a", (1.0, s), (0.5 * PAIR_DT, f"{p}1")), rate(f"{p}a", f"{p}2"), add(f"{p}b", (1.0, s), (-PAIR_DT, f"{p}1"), (2 * PAIR_DT, f"{p}2")), rate(f"{p}b", f"{p}3"),
                                 add(f"s{k + 1}", (1.0, s), (PAIR_DT / 6, f"{p}1"), (2 * PAIR_DT / 3, f"{p}2"), (PAIR_DT / 6, f"{p}3"))])
    return out + " SELECT f AS field, i AS k, round(u, 9) + 0.0 AS v FROM s2"


@query("m14_coupled_fields", _pair_sql())
def coupled_fields(spark, sf):
    """The density of the orders' totals and that of the lines' prices, each carried along and exchanging, stepped together."""
    def cells(table, column, most):
        t = read(spark, sf, table)
        own = t.groupBy(F.floor(F.col(column) / float(most) * PAIR).cast("long").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("c"))
        return own.join(F.broadcast(t.agg(F.count(F.lit(1)).cast("double").alias("n")))).where(F.col("k").between(0, PAIR - 1)).select("k", (F.col("c") / F.col("n")).alias("v"))

    cell = spark.range(PAIR).select(F.col("id").alias("row"))
    near = F.array(F.struct(F.col("row").alias("col"), F.lit(-1.0 * PAIR).alias("v")), F.struct(F.pmod(F.col("row") - 1, F.lit(PAIR)).alias("col"), F.lit(1.0 * PAIR).alias("v")))
    carry = cell.select("row", F.explode(near).alias("e")).select("row", "e.col", "e.v")
    eye = cell.select("row", F.col("row").alias("col"), F.lit(EXCHANGE).alias("v"))
    blocks = [Fields.block(f, f, carry, SPEED[f]) for f in SPEED] + [Fields.block(f, f, eye, -1.0) for f in SPEED] + [Fields.block("orders", "lines", eye), Fields.block("lines", "orders", eye)]
    terms = blocks[0]
    for b in blocks[1:]:
        terms = terms.unionByName(b)
    state = Fields.state_of({"orders": cells("orders", "o_totalprice", 600_000), "lines": cells("lineitem", "l_extendedprice", 110_000)})
    return Fields.advanced(state, terms, PAIR_DT, 2).select("field", "k", (F.round("v", 9) + 0.0).alias("v"))
