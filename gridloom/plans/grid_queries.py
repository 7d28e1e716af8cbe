"""Queries of index mathematics, generators and connectivity, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import connect as C
from gridloom.operators import generators as G
from gridloom.operators import multiwave as M

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


IDX = "CASE WHEN {l} = 0 THEN 0 ELSE (1::BIGINT << ({l} - 1)) + {c} END"
LEVEL = "CASE WHEN {i} = 0 THEN 0 ELSE length(bin({i})) END"
I3 = [IDX.format(l=f"l{i}", c=f"c{i}") for i in (1, 2, 3)]
#: Columns of lineitem that place its rows in a cube, with the ends of their ranges from 0 on.
PLACES = (("l_quantity", 51.0), ("l_discount", 0.11), ("l_extendedprice", 110000.0))
PT = "pt AS (SELECT * FROM (SELECT " + ", ".join(f"{c}::DOUBLE / {hi!r}::DOUBLE AS x{k}" for k, (c, hi) in enumerate(PLACES, 1)) + ") WHERE " + " AND ".join(f"x{k} >= 0 AND x{k} < 1" for k in (1, 2, 3)) + ")"
PT = PT.replace(") WHERE", " FROM lineitem) WHERE")
CELL = "CASE WHEN {l} = 0 THEN 0 ELSE CAST(floor({x} * power(2, {l} - 1)) AS BIGINT) END"
LEV3 = "lev AS (SELECT l1::INTEGER AS l1, l2::INTEGER AS l2, l3::INTEGER AS l3 FROM generate_series(0, 3) a(l1), generate_series(0, 2) b(l2), generate_series(0, 3) c(l3) WHERE l1 + l2 + l3 <= 3)"
CELLS3 = "SELECT DISTINCT l1, l2, l3, " + ", ".join(f"({CELL.format(l=f'l{k}', x=f'x{k}')})::INTEGER AS c{k}" for k in (1, 2, 3)) + " FROM pt, lev"
TABLE3 = f"""WITH {PT}, {LEV3}, cells AS ({CELLS3}), tab AS (
SELECT row_number() OVER (ORDER BY l1 + l2 + l3 DESC, l3, l2, l1, c3, c2, c1) - 1 AS pos,
  ({I3[0]}) + ({I3[1]}) * 128 + ({I3[2]}) * 16384 AS id, l1, l2, l3, c1::INTEGER AS c1, c2::INTEGER AS c2, c3::INTEGER AS c3 FROM cells)"""


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def largest(df, column):
    """The largest absolute value of an integer column, 0 without one."""
    return df.agg(F.max(F.abs(column))).first()[0] or 0


def places(spark, sf):
    """Rows of lineitem as points x1, x2, x3 of the unit cube."""
    return read(spark, sf, "lineitem").select(*[M.scaled(F.col(c), 0.0, hi).alias(f"x{k}") for k, (c, hi) in enumerate(PLACES, 1)])


def occupied(spark, sf, dims, tuples):
    """Distinct (l, c) of each dimension of the elements that rows lie in, over the level tuples."""
    met = M.keyed(places(spark, sf).where("x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL"), dims, 1, tuples, [])
    k = range(1, len(dims) + 1)
    met = met.select(*[f"i{j}" for j in k]).distinct()
    return met.select(*[S.level_of(F.col(f"i{j}")).alias(f"l{j}") for j in k], *[S.cell_of(F.col(f"i{j}")).cast("int").alias(f"c{j}") for j in k])


TUPLES3 = [(a, b, c) for a in range(4) for b in range(3) for c in range(4) if a + b + c <= 3]


def table3(spark, sf):
    return G.numbered_elements(occupied(spark, sf, ["x1", "x2", "x3"], TUPLES3), 3, 7)


#: Levels that columns of lineitem are worth: the binary digits of their numbers of distinct values, up to 5.
LIMITS = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
LIM = "lim AS (SELECT " + ", ".join(f"least(5, length(bin(count(DISTINCT {c}) - 1)))::BIGINT AS n{k}" for k, c in enumerate(LIMITS, 1)) + " FROM lineitem)"


def limits(spark, sf):
    """Four numbers of the table."""
    found = read(spark, sf, "lineitem").agg(*[F.countDistinct(c) for c in LIMITS]).first()
    return [min(5, len(bin(max(n - 1, 0))) - 2) for n in found]


def _series(*names):
    return ", ".join(f"generate_series(0, (SELECT n{k} FROM lim)) g{k}({n})" for k, n in names)


def _int(d):
    return ", ".join(f"l{k}::INTEGER AS l{k}" for k in range(1, d + 1))


BANDS = "SELECT DISTINCT l_linenumber - 1 AS a, CAST(floor(l_quantity / 13) AS INTEGER) AS b, CAST(floor(l_discount::DOUBLE * 40) AS INTEGER) AS c FROM lineitem"


@query("c01_lower_sets", f"WITH occ AS ({BANDS}) SELECT DISTINCT x::INTEGER AS l1, y::INTEGER AS l2, z::INTEGER AS l3 FROM occ, generate_series(0, 7) g(x), generate_series(0, 7) h(y), generate_series(0, 7) i(z) WHERE x <= a AND y <= b AND z <= c")
def lower_sets(spark, sf):
    """The least lower-complete set that holds the bands of the rows of lineitem."""
    bands = read(spark, sf, "lineitem").select((F.col("l_linenumber") - 1).alias("l1"), F.floor(F.col("l_quantity") / 13).cast("int").alias("l2"), F.floor(F.col("l_discount") * 40).cast("int").alias("l3"))
    return G.lower_closure(bands, ["l1", "l2", "l3"])


@query("c02_sets_by_level_sum", f"WITH {PT}, {LEV3}, cells AS ({CELLS3}) SELECT (l1 + l2 + l3)::BIGINT AS level_sum, count(*) AS n FROM cells GROUP BY ALL")
def by_sum(spark, sf):
    """Elements that rows lie in, by level sum."""
    return occupied(spark, sf, ["x1", "x2", "x3"], TUPLES3).groupBy(G.level_sum(3).cast("long").alias("level_sum")).agg(F.count(F.lit(1)).alias("n"))


@query("c03_highest_first", f"WITH {LIM} SELECT {_int(2)}, (l1 + l2)::INTEGER AS level_sum, (row_number() OVER (ORDER BY l1 + l2 DESC, l2, l1) - 1)::INTEGER AS pos FROM {_series((1, 'l1'), (2, 'l2'))} WHERE l1 + l2 <= (SELECT greatest(n1, n2) FROM lim)")
def ordered(spark, sf):
    """C3, G2."""
    n = limits(spark, sf)[:2]
    return G.highest_first(G.sparse_levels(spark, n, max(n)), 2)


@query("c04_sparse_levels", f"WITH {LIM} SELECT {_int(4)} FROM {_series((1, 'l1'), (2, 'l2'), (3, 'l3'), (4, 'l4'))} WHERE l1 + l2 + l3 + l4 <= (SELECT least(n1, n2, n3, n4) FROM lim)")
def sparse(spark, sf):
    """C4: levels that all columns are worth."""
    n = limits(spark, sf)
    return G.sparse_levels(spark, n, min(n))


@query("c05_sparse_levels_multi", f"WITH {LIM} SELECT {_int(3)} FROM {_series((1, 'l1'), (2, 'l2'), (4, 'l3'))} WHERE l1 + l2 + l3 <= (SELECT greatest(n1, n2, n4) FROM lim)")
def sparse_multi(spark, sf):
    """Each column with its own limit."""
    n = limits(spark, sf)
    n = [n[0], n[1], n[3]]
    return G.sparse_levels(spark, n, max(n))


@query("c06_mixed_levels", f"WITH {LIM} SELECT {_int(3)} FROM {_series((1, 'l1'), (2, 'l2'), (3, 'l3'))} WHERE l2 + l3 <= (SELECT greatest(n2, n3) FROM lim)")
def mixed(spark, sf):
    n = limits(spark, sf)[:3]
    return G.mixed_levels(spark, n, 1, (n[0], max(n[1:])))


@query("c07_full_grid", f"WITH {LIM} SELECT {_int(2)} FROM {_series((1, 'l1'), (2, 'l2'))}")
def full(spark, sf):
    return G.ranges(spark, limits(spark, sf)[:2])


@query("c08_full_grid_multi", f"WITH {LIM} SELECT {_int(3)}, l1 + (SELECT n1 + 1 FROM lim) * (l2 + (SELECT n2 + 1 FROM lim) * l3) AS pos FROM {_series((1, 'l1'), (2, 'l2'), (4, 'l3'))}")
def full_multi(spark, sf):
    n = limits(spark, sf)
    at = F.col("l1") + (n[0] + 1) * (F.col("l2") + (n[1] + 1) * F.col("l3"))
    return G.ranges(spark, [n[0], n[1], n[3]]).withColumn("pos", at.cast("long"))


LISTS_SQL = "WITH " + ", ".join(f"{n} AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::INTEGER AS p FROM (SELECT DISTINCT CAST(round({c}) AS INTEGER) AS v FROM lineitem))" for n, c in (("a", "l_linenumber"), ("b", "l_discount::DOUBLE * 100"), ("c", "l_tax::DOUBLE * 100")))


def lists(spark, sf):
    """The distinct line numbers, discounts and taxes: domains of a few values each, whatever the table."""
    found = read(spark, sf, "lineitem").agg(*[F.sort_array(F.collect_set(F.round(c).cast("int"))) for c in (F.col("l_linenumber"), F.col("l_discount") * 100, F.col("l_tax") * 100)]).first()
    return [list(x) for x in found]


@query("c09_count_constrained", LISTS_SQL + " SELECT count(*) AS n FROM a, b, c WHERE a.v + b.v + c.v <= 12 AND greatest(a.v, b.v, c.v) <= 7")
def count_constrained(spark, sf):
    return G.constrained_lists(spark, lists(spark, sf), 12, 7).agg(F.count(F.lit(1)).alias("n"))


@query("c10_constrained_lists", LISTS_SQL + " SELECT a.p AS p1, b.p AS p2, c.p AS p3, a.v + b.v + c.v AS total, greatest(a.v, b.v, c.v) AS largest FROM a, b, c WHERE a.v + b.v + c.v <= 12 AND greatest(a.v, b.v, c.v) <= 7")
def constrained(spark, sf):
    return G.constrained_lists(spark, lists(spark, sf), 12, 7)


@query("c11_cells_of_levels", f"WITH {PT}, {LEV3}, cells AS ({CELLS3}) SELECT l1, l2, l3, c1::INTEGER AS c1, c2::INTEGER AS c2, c3::INTEGER AS c3 FROM cells")
def cells(spark, sf):
    """C11: the cells of all level tuples that rows lie in."""
    every = G.cells_of(G.sparse_levels(spark, [3, 2, 3], 3), 3)
    met = occupied(spark, sf, ["x1", "x2", "x3"], TUPLES3).select(*[F.col(c).alias(f"o_{c}") for c in ("l1", "l2", "l3", "c1", "c2", "c3")])
    return every.join(met, [F.col(c) == F.col(f"o_{c}") for c in ("l1", "l2", "l3", "c1", "c2", "c3")], "left_semi")


@query("c12_element_table", TABLE3 + " SELECT * FROM tab")
def table(spark, sf):
    return table3(spark, sf)


@query("c13_dof_expansion", TABLE3 + f" SELECT pos, dof::INTEGER AS dof, ({I3[0]}) * 2 + dof // 4 AS i1, ({I3[1]}) * 2 + dof // 2 % 2 AS i2, ({I3[2]}) * 2 + dof % 2 AS i3, pos * 8 + dof AS at FROM tab, generate_series(0, 7) d(dof)")
def dofs(spark, sf):
    return G.dof_expansion(table3(spark, sf), 2, 3).select("pos", "dof", "i1", "i2", "i3", "at")


@query("c14_padded_dofs", TABLE3 + " SELECT pos * 8 + dof AS at, l3 > 1 AS padding FROM tab, generate_series(0, 7) d(dof)")
def padded(spark, sf):
    t = table3(spark, sf)
    active, extra = t.where("l3 <= 1"), t.where("l3 > 1")
    both = G.dof_expansion(active, 2, 3).withColumn("padding", F.lit(False)).unionByName(G.dof_expansion(extra, 2, 3).withColumn("padding", F.lit(True)))
    return both.select("at", "padding")


def ends(spark, sf, table, column):
    """The least and the largest value of a column."""
    return read(spark, sf, table).agg(F.min(column), F.max(column)).first()


@query("c15_linspace", "WITH e AS (SELECT min(l_extendedprice)::DOUBLE AS lo, max(l_extendedprice)::DOUBLE AS hi FROM lineitem) SELECT i, round(lo + i * ((hi - lo) / 99), 6) AS v FROM e, generate_series(0, 99) s(i)")
def linspace(spark, sf):
    """Between the ends of the prices."""
    return G.linspace(spark, *map(float, ends(spark, sf, "lineitem", "l_extendedprice"))).withColumn("v", F.round("v", 6))


@query("c16_eye", "SELECT r AS row, c AS col, CASE WHEN r = c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM generate_series(0, (SELECT count(*) FROM region) - 1) a(r), generate_series(0, (SELECT count(*) FROM nation) - 1) b(c)")
def eye(spark, sf):
    """Regions by nations."""
    return G.eye(spark, read(spark, sf, "region").count(), read(spark, sf, "nation").count())


@query("c17_meshgrid", "WITH e AS (SELECT min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem) SELECT r AS row, c AS col, c + lo AS v FROM e, generate_series(0, (SELECT hi - lo FROM e)) a(r), generate_series(0, (SELECT hi - lo FROM e)) b(c)")
def mesh(spark, sf):
    """C17: over the line numbers."""
    lo, hi = ends(spark, sf, "lineitem", "l_linenumber")
    return G.meshgrid(spark, lo, hi - lo + 1)


@query("c18_strided_iota", "SELECT (row_number() OVER (ORDER BY v) - 1)::INTEGER AS i, v::INTEGER AS v FROM generate_series((SELECT min(o_custkey) FROM orders), (SELECT max(o_custkey) FROM orders), 7) s(v)")
def iota(spark, sf):
    """Each seventh number between the ends of the customers' keys."""
    lo, hi = ends(spark, sf, "orders", "o_custkey")
    return G.iota(spark, lo, hi, 7)


NODES_SQL = "WITH e AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {t}) SELECT cell, q::INTEGER AS q, round((0.5 * (CASE q WHEN 0 THEN -1 ELSE 1 END * {root} + 1) + cell) * ((hi - lo) / {n}) + lo, 6) AS x FROM e, generate_series(0, {n} - 1) a(cell), generate_series(0, {m}) b(q)"


@query("c19_realspace_nodes", NODES_SQL.format(c="l_extendedprice", t="lineitem", root="(1 / sqrt(3.0))", n=16, m=1))
def nodes(spark, sf):
    """Quadrature nodes of cells between the ends of the prices."""
    root = 3.0**-0.5
    return G.realspace_nodes(spark, [-root, root], 4, *map(float, ends(spark, sf, "lineitem", "l_extendedprice"))).select("cell", "q", F.round("x", 6).alias("x"))


@query("c20_plot_nodes", NODES_SQL.format(c="o_totalprice", t="orders", root="sqrt(0.6) * (q <> 1)::INTEGER", n=8, m=2))
def plot_nodes(spark, sf):
    """C20: nodes of plots of the orders' totals."""
    root = 0.6**0.5
    return G.realspace_nodes(spark, [-root, 0.0, root], 3, *map(float, ends(spark, sf, "orders", "o_totalprice"))).select("cell", "q", F.round("x", 6).alias("x"))


@query("c21_element_centres", TABLE3 + " SELECT pos, round((c1 + 0.5) / (1 << greatest(l1 - 1, 0)) * 51, 9) AS x1, round((c2 + 0.5) / (1 << greatest(l2 - 1, 0)) * 0.11, 9) AS x2, round((c3 + 0.5) / (1 << greatest(l3 - 1, 0)) * 110000, 9) AS x3 FROM tab")
def centres(spark, sf):
    """The middles of the elements that rows lie in, in the columns' own units."""
    out = G.element_centres(table3(spark, sf), 3, [(0.0, 51.0), (0.0, 0.11), (0.0, 110000.0)])
    return out.select("pos", *[F.round(f"x{i}", 9).alias(f"x{i}") for i in (1, 2, 3)])


# connectivity: the closed intervals of both cells on the finest grid of 2**(M-1) cells meet, or touch both ends
EDGES = """edges AS (
SELECT a.i AS row, b.i AS col, a.l AS la, b.l AS lb, a.c AS ca, b.c AS cb FROM cells a, cells b
WHERE a.l <= 1 OR b.l <= 1 OR (a.lo <= b.hi AND b.lo <= a.hi) OR (a.lo = 0 AND b.hi = {end}) OR (b.lo = 0 AND a.hi = {end}))"""
CELLS1 = """cells AS (SELECT i, l, c, c * (1::BIGINT << ({m} - l)) AS lo, (c + 1) * (1::BIGINT << ({m} - l)) AS hi FROM (
SELECT i, l, CASE WHEN i < 2 THEN 0 ELSE i - (1::BIGINT << (l - 1)) END AS c FROM (SELECT i, CASE WHEN i = 0 THEN 0 ELSE length(bin(i)) END AS l FROM generate_series(0, (1::BIGINT << {m}) - 1) s(i))))"""


def edges_sql(m: int) -> str:
    """Connected pairs of cells of the price that rows lie in."""
    index = f"CASE WHEN l = 0 THEN 0 ELSE CAST(floor(x3 * power(2, l - 1)) AS BIGINT) + (1::BIGINT << greatest(l - 1, 0)) END"
    return all_edges_sql(m).replace("WITH cells AS", f"WITH {PT}, met AS (SELECT DISTINCT {index} AS i FROM pt, generate_series(0, {m}) g(l)), cells AS").replace(f"generate_series(0, (1::BIGINT << {m}) - 1) s(i))))", "met)))")


def met_edges(spark, sf, m):
    """C.edges_1d between the cells of the price that rows lie in."""
    met = occupied(spark, sf, ["x3"], [(lev,) for lev in range(m + 1)]).select(S.index_1d(F.col("l1"), F.col("c1")).alias("i"))
    edges = C.edges_1d(spark, m)
    for side in ("row", "col"):
        edges = edges.join(met.select(F.col("i").alias(f"met_{side}")), F.col(side) == F.col(f"met_{side}"), "left_semi")
    return edges


def all_edges_sql(m: int) -> str:
    cells = CELLS1.format(m=m).replace(f"<< ({m} - l)", f"<< ({m} - greatest(l, 1))")
    return f"WITH {cells}, {EDGES.format(end=1 << (m - 1))}"


@query("c22_connectivity_1d", edges_sql(6) + " SELECT row, col, CASE WHEN row = col THEN 'diag' WHEN least(la, lb) < 2 AND least(row, col) < 2 THEN 'volume' WHEN (CASE WHEN la <= lb THEN cb // (1::BIGINT << (lb - la)) = ca ELSE ca // (1::BIGINT << (la - lb)) = cb END) THEN 'volume' ELSE 'edge' END AS kind FROM edges")
def connectivity(spark, sf):
    """Among the cells of the price that rows lie in."""
    return met_edges(spark, sf, 6)


@query("d02_connected_cells", f"""WITH p AS (SELECT l_extendedprice::DOUBLE / 110000.0::DOUBLE AS x, lead(l_extendedprice::DOUBLE / 110000.0::DOUBLE) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS y FROM lineitem),
q AS (SELECT DISTINCT CAST(floor(x * 16) AS BIGINT) + 16 AS row, CAST(floor(y * 4) AS BIGINT) + 4 AS col FROM p WHERE x >= 0 AND x < 1 AND y >= 0 AND y < 1)
SELECT row, col, ((col - 4) * 4 <= row - 15 AND (col - 3) * 4 >= row - 16) OR (row = 16 AND col = 7) OR (row = 31 AND col = 4) AS connected FROM q""")
def connected_cells(spark, sf):
    """The predicate on the fine cell of a line's price and the coarse cell of the next line's."""
    line = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice")
    x = M.scaled(F.col("l_extendedprice"), 0.0, 110000.0)
    pairs = read(spark, sf, "lineitem").select(x.alias("x"), F.lead(x).over(line).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    cells = pairs.select(F.floor(F.col("x") * 16).cast("long").alias("a"), F.floor(F.col("y") * 4).cast("long").alias("b")).distinct()
    row, col = S.index_1d(F.lit(5), F.col("a")), S.index_1d(F.lit(3), F.col("b"))
    return cells.select(row.alias("row"), col.alias("col"), C.is_connected(F.lit(5), F.col("a"), F.lit(3), F.col("b")).alias("connected"))


@query("c23_dof_connectivity", edges_sql(4) + " SELECT row * 3 + p AS row, col * 3 + q AS col FROM edges, generate_series(0, 2) a(p), generate_series(0, 2) b(q)")
def dof_connectivity(spark, sf):
    three = F.sequence(F.lit(0), F.lit(2))
    return met_edges(spark, sf, 4).withColumn("p", F.explode(three)).withColumn("q", F.explode(three)).select((F.col("row") * 3 + F.col("p")).alias("row"), (F.col("col") * 3 + F.col("q")).alias("col"))


@query("d04_connected_counts", edges_sql(7) + ", n AS (SELECT row, count(*) AS n FROM edges GROUP BY row) SELECT row, n, (sum(n) OVER (ORDER BY row) - n)::BIGINT AS first FROM n")
def connected_counts(spark, sf):
    """Connected cells per row and the exclusive prefix sum of the counts."""
    from gridloom.operators.ordered import exclusive_sum

    return exclusive_sum(met_edges(spark, sf, 7).groupBy("row").agg(F.count(F.lit(1)).alias("n")), "row", "n", "first")


D2 = f"""lev AS (SELECT l1, l2 FROM generate_series(0, 4) a(l1), generate_series(0, 4) b(l2) WHERE l1 + l2 <= 4), el2 AS (
SELECT DISTINCT l1, l2, {CELL.format(l='l1', x='x1')} AS c1, {CELL.format(l='l2', x='x3')} AS c2 FROM pt, lev), el AS (
SELECT row_number() OVER (ORDER BY l1 + l2 DESC, l2, l1, c2, c1) - 1 AS pos, CASE WHEN l1 = 0 THEN 0 ELSE (1::BIGINT << (l1 - 1)) + c1 END AS i1, CASE WHEN l2 = 0 THEN 0 ELSE (1::BIGINT << (l2 - 1)) + c2 END AS i2 FROM el2)"""


def table2(spark, sf):
    return G.numbered_elements(occupied(spark, sf, ["x1", "x3"], [(a, b) for a in range(5) for b in range(5) if a + b <= 4]), 2, 6)


@query("d01_connected_elements", all_edges_sql(4).replace("WITH ", f"WITH {PT}, ", 1) + f", {D2} SELECT a.pos AS row, b.pos AS col FROM el a, el b, edges e, edges f WHERE e.row = a.i1 AND e.col = b.i1 AND f.row = a.i2 AND f.col = b.i2")
def connected(spark, sf):
    """Among the elements that rows lie in."""
    return C.connected_elements(table2(spark, sf), C.edges_1d(spark, 4), 2)


VOLUME = "(CASE WHEN la <= lb THEN cb // (1::BIGINT << (lb - la)) = ca ELSE ca // (1::BIGINT << (la - lb)) = cb END OR least(row, col) < 2)"


@query("d03_edge_connected", all_edges_sql(4).replace("WITH ", f"WITH {PT}, ", 1) + f", kinds AS (SELECT row, col, {VOLUME} AS volume, la = lb AS level FROM edges), {D2} SELECT a.pos AS row, b.pos AS col FROM el a, el b, kinds e, kinds f WHERE e.row = a.i1 AND e.col = b.i1 AND f.row = a.i2 AND f.col = b.i2 AND ((NOT e.volume AND e.level AND f.volume) OR (NOT f.volume AND f.level AND e.volume))")
def edge_connected(spark, sf):
    """Pairs that are edge neighbours of one level in one dimension and nested in the other."""
    edges = C.edges_1d(spark, 4)
    same = edges.where("kind = 'edge'").where(S.level_of(F.col("row")) == S.level_of(F.col("col"))).select("row", "col")
    nested = edges.where("kind <> 'edge'").select("row", "col")
    index = {f"i{i}": S.index_1d(F.col(f"l{i}"), F.col(f"c{i}")) for i in (1, 2)}
    el = table2(spark, sf).withColumns(index).select("pos", "i1", "i2")
    other = el.select(F.col("pos").alias("col"), F.col("i1").alias("j1"), F.col("i2").alias("j2"))
    out = None
    for one, two in ((same, nested), (nested, same)):
        e1, e2 = one.toDF("a1", "b1"), two.toDF("a2", "b2")
        part = el.join(e1, F.col("i1") == F.col("a1")).join(e2, F.col("i2") == F.col("a2")).join(other, (F.col("b1") == F.col("j1")) & (F.col("b2") == F.col("j2"))).select(F.col("pos").alias("row"), "col")
        out = part if out is None else out.unionByName(part)
    return out


KIDS = " UNION ALL ".join(f"SELECT pos, id, {', '.join(f'l{k} + {int(k == i)} AS l{k}' for k in (1, 2, 3))}, {', '.join(f'(CASE WHEN l{k} = 0 THEN 0 ELSE 2 * c{k} + z END)::INTEGER AS c{k}' if k == i else f'c{k}' for k in (1, 2, 3))}, {i} AS dim FROM tab, generate_series(0, 1) s(z) WHERE l{i} < {m} AND (l{i} > 0 OR z = 0)" for i, m in ((1, 4), (2, 3), (3, 4)))


@query("c25_children", TABLE3 + f" SELECT pos, id, l1, l2, l3, c1, c2, c3, dim FROM ({KIDS})")
def kids(spark, sf):
    return G.children(table3(spark, sf), 3, [4, 3, 4])


FINEST = "el AS (SELECT DISTINCT CAST(floor(x1 * 16) AS BIGINT) + 16 AS i1, CAST(floor(x3 * 16) AS BIGINT) + 16 AS i2 FROM pt)"


def finest(spark, sf):
    """Distinct indices (i1, i2) of level 5 of the rows' quantities and prices."""
    return places(spark, sf).where("x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL").select((F.floor(F.col("x1") * 16) + 16).cast("long").alias("i1"), (F.floor(F.col("x3") * 16) + 16).cast("long").alias("i2")).distinct()


@query("d20_ancestor_completion", f"""WITH RECURSIVE {PT}, {FINEST}, up AS (
SELECT i1, i2 FROM el UNION SELECT * FROM (SELECT i1 >> 1 AS i1, i2 FROM up UNION ALL SELECT i1, i2 >> 1 FROM up)) SELECT i1, i2 FROM up EXCEPT SELECT i1, i2 FROM el""")
def completion(spark, sf):
    """What the finest cells of the rows lack."""
    return C.ancestor_completion(spark, finest(spark, sf), 2, 6)


@query("d21_ancestors", all_edges_sql(5).replace("WITH ", f"WITH {PT}, {FINEST}, ", 1) + f", up AS (SELECT row, col FROM edges WHERE col < row AND {VOLUME}) SELECT i1, i2, 1 AS dim, col AS ancestor FROM el, up WHERE row = i1 UNION ALL SELECT i1, i2, 2, col FROM el, up WHERE row = i2")
def ancestors(spark, sf):
    """The ancestors of the finest cells of the rows, by dimension."""
    start = finest(spark, sf)
    up = C.edges_1d(spark, 5).where("col < row AND kind <> 'edge'").select("row", F.col("col").alias("ancestor"))
    one = start.join(up, F.col("i1") == F.col("row")).select("i1", "i2", F.lit(1).alias("dim"), "ancestor")
    return one.unionByName(start.join(up, F.col("i2") == F.col("row")).select("i1", "i2", F.lit(2).alias("dim"), "ancestor"))


@query("i01_index_math", f"SELECT i, ({LEVEL.format(i='i')})::INTEGER AS l, (CASE WHEN i < 2 THEN 0 ELSE i - (1::BIGINT << (length(bin(i)) - 1)) END)::BIGINT AS c, i AS back, 1::BIGINT << (i % 62)::INTEGER AS power, i * i * i AS cube FROM (SELECT DISTINCT o_orderkey * 37 + (1::BIGINT << (o_custkey % 40)::INTEGER) % 100003 AS i FROM orders)")
def index_math(spark, sf):
    """Powers, level and cell of an index and back. Cubes are decimals where one doesn't fit a bigint (SQL's overflow)."""
    out = read(spark, sf, "orders").select((F.col("o_orderkey") * 37 + S.pow2(F.col("o_custkey") % 40) % 100003).alias("i"))
    kind = S.integer_type(largest(out, "i") ** 3)
    out = out.distinct().withColumns({"l": S.level_of(F.col("i")), "c": S.cell_of(F.col("i"))})
    return out.withColumns({"back": S.index_1d(F.col("l"), F.col("c")), "power": S.pow2(F.col("i") % 62), "cube": S.int_pow(F.col("i"), 3, kind)})


@query("i06_element_ids", TABLE3 + f" SELECT id, ({I3[0]})::BIGINT AS i1, ({I3[1]})::BIGINT AS i2, ({I3[2]})::BIGINT AS i3 FROM tab")
def element_ids(spark, sf):
    """Ids and their indices."""
    return table3(spark, sf).select("id", *[S.index_of_id(F.col("id"), 7, d).alias(f"i{d + 1}") for d in range(3)])


@query("i09_polyval", "SELECT i, round(2 * x * x * x - x * x + 0.5, 9) AS y, round(sqrt(3.0) * x, 9) AS p1, round(sqrt(5.0) * (1.5 * x * x - 0.5), 9) AS p2, CASE WHEN abs(x) < 0.05 THEN 0.0 ELSE round(x, 9) END AS clipped FROM (SELECT c_custkey AS i, c_acctbal::DOUBLE / 10000.0::DOUBLE AS x FROM customer) WHERE abs(x) <= 1")
def polynomials(spark, sf):
    """Polynomial, Legendre values and clipping of the customers' balances."""
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("i"), (F.col("c_acctbal") / 10000.0).alias("v")).where("abs(v) <= 1")
    p = S.legendre(F.col("v"), 3)
    return rows.select("i", F.round(S.polyval([2, -1, 0, 0.5], F.col("v")), 9).alias("y"), F.round(p[1], 9).alias("p1"), F.round(p[2], 9).alias("p2"), F.round(S.clip_eps(F.col("v"), 0.05), 9).alias("clipped"))


@query("b24_zero_outside", "SELECT i, round(CASE WHEN abs(x) <= 1 THEN sqrt(5.0) * (1.5 * x * x - 0.5) ELSE 0.0 END, 9) AS p2 FROM (SELECT c_custkey AS i, c_acctbal::DOUBLE / 4000.0::DOUBLE AS x FROM customer)")
def outside(spark, sf):
    """Balances beyond 4000 are outside."""
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.round(S.legendre(F.col("c_acctbal") / 4000.0, 3)[2], 9).alias("p2"))


@query("i12_closed_forms", "SELECT n, n * 8 / 1048576.0::DOUBLE AS mb, least(greatest(floor(512.0 / (n * 8 / 1048576.0::DOUBLE))::BIGINT, least(10, n)), least(200, n)) AS restart, n + (n + 3) * (n + 4) // 2 AS packed, (power(n % 5 + 1, 4) * 2 * 3 * 2 * n)::BIGINT AS flops, n % 3 > 0 AND (n % 3 = 1 OR (n + 1) % greatest(n % 3, 1) = 0) AS writes, (3 * (1::BIGINT << (n % 9)::INTEGER)) * (2 * (1::BIGINT << (n % 4)::INTEGER)) AS dense FROM (SELECT DISTINCT 1 + c_custkey * c_custkey * 17 AS n FROM customer)")
def closed_forms(spark, sf):
    """Sizes, restarts, packed places, work, write steps. Places are decimals where one doesn't fit a bigint (SQL's overflow)."""
    n = F.col("n")
    out = read(spark, sf, "customer").select((1 + F.col("c_custkey") * F.col("c_custkey") * 17).alias("n"))
    most = largest(out, "n")
    kind = S.integer_type(most + (most + 3) * (most + 4) // 2)
    return out.distinct().select(
        "n", S.megabytes(n).alias("mb"), S.default_restart(n).alias("restart"), S.packed_upper(n, n + 3, kind).alias("packed"), S.flops(F.lit(3), n % 5 + 1, F.lit(2), n).alias("flops"),
        S.writes_at(n, n % 3).alias("writes"), (3 * S.pow2(n % 9) * 2 * S.pow2(n % 4)).alias("dense"))


@query("i18_ints_from_string", "SELECT p_partkey, list_sum(list_transform(string_split(p_size || ' ' || (p_partkey % 7) || '  3', ' '), lambda x: coalesce(TRY_CAST(x AS BIGINT), 0)))::BIGINT AS total, 3 AS n FROM part")
def from_string(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    ints = S.ints_from_string(F.concat_ws(" ", "p_size", (F.col("p_partkey") % 7).cast("string"), F.lit(" 3")))
    return part.select("p_partkey", F.aggregate(ints, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(ints).alias("n"))
