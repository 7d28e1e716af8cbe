"""Queries of algebra, adaptivity, order and moments over the driver's tables, with their DuckDB SQL.

Sums of doubles depend on their order, so results are rounded where both sides
report them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import adapt as A
from gridloom.operators import algebra as L
from gridloom.operators import ordered as O
from gridloom.plans.grid_queries import query
from gridloom.plans.grid_queries import IDX, LEVEL


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark, sf):
    """embeddings in long form: (vec, i, v)."""
    e = read(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("vec"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))


def mean_vector(spark, sf):
    return vectors(spark, sf).groupBy("i").agg(F.avg("v").alias("v"))


VEC = "vec AS (SELECT vec_id AS vec, unnest(range(len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), mean AS (SELECT i, avg(v) AS v FROM vec GROUP BY i)"
MAT = "mat AS (SELECT l_suppkey % 50 AS row, (l_linenumber - 1)::BIGINT AS col, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS v FROM lineitem GROUP BY ALL)"


def matrix(spark, sf):
    """Quantities of lineitem as a matrix of suppliers' groups by line numbers."""
    li = read(spark, sf, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 50).alias("row"), (F.col("l_linenumber") - 1).cast("long").alias("col")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("v"))


@query("e01_vector_norms", f"WITH {VEC} SELECT vec, round(sqrt(sum(v * v)), 6) AS l2, round(max(abs(v)), 6) AS linf FROM vec GROUP BY vec")
def norms(spark, sf):
    """E1, E2, E4."""
    return vectors(spark, sf).groupBy("vec").agg(F.round(L.nrm2(F.col("v")), 6).alias("l2"), F.round(L.nrminf(F.col("v")), 6).alias("linf"))


@query("e03_frobenius", f"WITH {MAT} SELECT round(sqrt(sum(v * v)), 4) AS v FROM mat")
def frobenius(spark, sf):
    return matrix(spark, sf).agg(F.round(L.nrm2(F.col("v")), 4).alias("v"))


@query("e05_dot", f"WITH {VEC} SELECT vec, round(sum(vec.v * mean.v), 6) AS v FROM vec JOIN mean USING (i) GROUP BY vec")
def dots(spark, sf):
    return L.dot(vectors(spark, sf), mean_vector(spark, sf), ["vec"]).withColumn("v", F.round("v", 6))


@query("e06_gemv", f"WITH {VEC}, y AS (SELECT vec AS i, sum(v) AS v FROM vec GROUP BY vec) SELECT vec AS i, round(2.0 * sum(vec.v * mean.v) + 0.5 * any_value(y.v), 6) AS v FROM vec JOIN mean USING (i) JOIN y ON y.i = vec GROUP BY vec")
def gemv(spark, sf):
    v = vectors(spark, sf)
    y = v.groupBy(F.col("vec").alias("i")).agg(F.sum("v").alias("v"))
    return L.gemv(v.select(F.col("vec").alias("row"), F.col("i").alias("col"), "v"), mean_vector(spark, sf), y, 2.0, 0.5).withColumn("v", F.round("v", 6))


@query("e07_gemm", f"WITH {MAT} SELECT a.col AS row, b.col AS col, round(sum(a.v * b.v), 2) AS v FROM mat a JOIN mat b USING (row) GROUP BY ALL")
def gemm(spark, sf):
    m = matrix(spark, sf)
    return L.gemm(L.transpose(m), m).withColumn("v", F.round("v", 2))


@query("e08_sparse_gemv", f"WITH {MAT} SELECT row AS i, round(sum(v * (col + 1)), 4) AS v FROM mat GROUP BY row")
def sparse_gemv(spark, sf):
    x = spark.range(7).select(F.col("id").alias("i"), (F.col("id") + 1.0).alias("v"))
    return L.gemv(matrix(spark, sf), x).withColumn("v", F.round("v", 4))


@query("e09_axpy", f"WITH {MAT}, x AS (SELECT row AS i, sum(v) AS v FROM mat GROUP BY row), y AS (SELECT s_suppkey AS i, s_acctbal AS v FROM supplier) SELECT i, round(sum(v), 4) AS v, round(sum(v) * 3, 4) AS scaled FROM (SELECT i, 0.25 * v AS v FROM x UNION ALL SELECT i, v FROM y) GROUP BY i")
def axpy(spark, sf):
    """E9, E10, I15."""
    x = matrix(spark, sf).groupBy(F.col("row").alias("i")).agg(F.sum("v").alias("v"))
    y = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    out = L.axpy(x, y, 0.25)
    return out.select("i", F.round("v", 4).alias("v"), F.round(F.col("v") * 3, 4).alias("scaled"))


@query("e11_rmse", f"WITH {VEC} SELECT vec, round(sqrt(avg((vec.v - mean.v) * (vec.v - mean.v))), 6) AS rmse, round(sqrt(avg((vec.v - mean.v) * (vec.v - mean.v))) / max(abs(mean.v)) * 100, 4) AS relative, round(sqrt(sum((vec.v - mean.v) * (vec.v - mean.v))), 6) AS distance FROM vec JOIN mean USING (i) GROUP BY vec")
def rmse(spark, sf):
    """E11, E25."""
    m = mean_vector(spark, sf).select(F.col("i").alias("m_i"), F.col("v").alias("m"))
    d = F.col("v") - F.col("m")
    e = L.rmse(F.col("v"), F.col("m"))
    return vectors(spark, sf).join(m, F.col("i") == F.col("m_i")).groupBy("vec").agg(F.round(e, 6).alias("rmse"), F.round(e / F.max(F.abs("m")) * 100, 4).alias("relative"), F.round(F.sqrt(F.sum(d * d)), 6).alias("distance"))


@query("e14_global_max", "SELECT max(abs(o_totalprice)) AS top, bool_or(o_orderstatus = 'P') AS any_open, count(*) AS n FROM orders")
def global_max(spark, sf):
    """E14, E33, G3."""
    return read(spark, sf, "orders").agg(L.nrminf(F.col("o_totalprice")).alias("top"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_open"), F.count(F.lit(1)).alias("n"))


@query("e16_max_level", f"SELECT c_nationkey AS dim, max({LEVEL.format(i='c_custkey')})::INTEGER AS level FROM customer GROUP BY c_nationkey")
def max_level(spark, sf):
    return read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("dim")).agg(F.max(S.level_of(F.col("c_custkey"))).alias("level"))


MOMENTS = "m AS (SELECT l_returnflag AS x, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS m0, sum(l_quantity * l_discount) AS m1, sum(l_quantity * l_tax) AS m2, sum(l_quantity * l_discount * l_discount) AS m3, sum(l_quantity * l_tax * l_tax) AS m4 FROM lineitem GROUP BY l_returnflag)"


@query("e20_moments", f"WITH {MOMENTS} SELECT x, round(m0, 2) AS m0, round(m1, 2) AS m1, round(m2, 2) AS m2, round(m3, 2) AS m3, round(m4, 2) AS m4 FROM m")
def moments(spark, sf):
    """Weighted velocity integrals per place."""
    return moment_table(spark, sf).select("x", *[F.round(f"m{k}", 2).alias(f"m{k}") for k in range(5)])


def moment_table(spark, sf):
    w, u, v = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("x")).agg(
        F.sum(w.cast("long")).cast("double").alias("m0"), F.sum(w * u).alias("m1"), F.sum(w * v).alias("m2"), F.sum(w * u * u).alias("m3"), F.sum(w * v * v).alias("m4"))


@query("e23_closure", f"WITH {MOMENTS} SELECT x, round(m0, 2) AS n, round(m1 / m0, 8) AS u1, round(m2 / m0, 8) AS u2, round((m3 + m4) / (2 * m0) - 0.5 * (m1 / m0 * (m1 / m0) + m2 / m0 * (m2 / m0)), 8) AS theta FROM m")
def closure(spark, sf):
    """Density, mean velocities and temperature of two velocity dimensions."""
    n = F.nullif("m0", F.lit(0.0))
    u1, u2 = F.col("m1") / n, F.col("m2") / n
    theta = (F.col("m3") + F.col("m4")) / (2 * n) - 0.5 * (u1 * u1 + u2 * u2)
    return moment_table(spark, sf).select("x", F.round("m0", 2).alias("n"), F.round(u1, 8).alias("u1"), F.round(u2, 8).alias("u2"), F.round(theta, 8).alias("theta"))


@query("e24_quadrature", """WITH s AS (SELECT epoch(date_trunc('day', l_shipdate))::BIGINT // 86400 AS day, sum(l_quantity) AS y FROM lineitem GROUP BY 1), n AS (SELECT day, y, lead(day) OVER (ORDER BY day) AS next, lead(y) OVER (ORDER BY day) AS z FROM s)
SELECT day // 100 AS part, round(sum((next - day) * (y + z) / 2), 4) AS integral, round(sum((next - day) * (y + z) / 2) / sum(next - day), 6) AS average FROM n WHERE next IS NOT NULL GROUP BY 1""")
def quadrature(spark, sf):
    """Integrals and averages of the daily quantities over hundreds of days, by the trapezoids between neighbouring days."""
    day = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86_400_000_000).cast("long")
    series = O.number(read(spark, sf, "lineitem").groupBy(day.alias("day")).agg(F.sum("l_quantity").alias("y")), ["day"], "pos")
    after = series.select((F.col("pos") - 1).alias("n_pos"), F.col("day").alias("next"), F.col("y").alias("z"))
    parts = series.join(after, F.col("pos") == F.col("n_pos")).select(F.floor(F.col("day") / 100).alias("part"), (F.col("next") - F.col("day")).alias("h"), (F.col("y") + F.col("z")).alias("w"))
    area = F.sum(F.col("h") * F.col("w") / 2)
    return parts.groupBy("part").agg(F.round(area, 4).alias("integral"), F.round(area / F.sum("h"), 6).alias("average"))


@query("e26_timings", "SELECT event_type AS id, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS med, count(*) AS calls, round(avg(value) * 1e-3, 6) AS gflops FROM events GROUP BY event_type")
def timings(spark, sf):
    """Statistics of timed events."""
    v = F.col("value")
    return read(spark, sf, "events").groupBy(F.col("event_type").alias("id")).agg(
        F.round(F.avg(v), 6).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.percentile(v, 0.5), 6).alias("med"), F.count(F.lit(1)).alias("calls"), F.round(F.avg(v) * 1e-3, 6).alias("gflops"))


@query("e27_report", "SELECT event_type || ' calls: ' || count(*) AS line FROM events GROUP BY event_type")
def report(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.format_string("%s calls: %d", "event_type", "n").alias("line"))


@query("e31_diagonal", f"WITH {MAT} SELECT row AS i, sum(v) AS v FROM mat WHERE row = col GROUP BY row")
def diagonal(spark, sf):
    """The diagonal that a Jacobi preconditioner divides by."""
    return matrix(spark, sf).where("row = col").groupBy(F.col("row").alias("i")).agg(F.sum("v").alias("v"))


@query("e35_row_offsets", f"WITH {MAT}, n AS (SELECT row, count(*) AS n FROM mat GROUP BY row) SELECT row, n, (sum(n) OVER (ORDER BY row) - n)::BIGINT AS first FROM n")
def row_offsets(spark, sf):
    """E35, F1, F2."""
    return O.exclusive_sum(matrix(spark, sf).groupBy("row").agg(F.count(F.lit(1)).alias("n")), "row", "n", "first")


@query("f01_prefix_sums", "SELECT o_orderkey, (sum(o_custkey) OVER (ORDER BY o_orderkey) - o_custkey)::BIGINT AS before FROM orders")
def prefix(spark, sf):
    return O.exclusive_sum(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", "before").select("o_orderkey", "before")


@query("f03_first_occurrence", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def first(spark, sf):
    return O.first_occurrences(read(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("f04_dimension_sort", "SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber))::INTEGER AS at, coalesce(l_linenumber <> lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + 1, true) AS starts FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def dimension_sort(spark, sf):
    """within equal other indices the order of one, and where its runs begin."""
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber")
    d = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return d.select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("at"), F.coalesce(F.col("l_linenumber") != F.lag("l_linenumber").over(w) + 1, F.lit(True)).alias("starts"))


ISLANDS = "kept AS (SELECT o_custkey AS key, o_orderkey AS pos FROM orders WHERE o_orderstatus <> 'F'), n AS (SELECT key, pos, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS n FROM kept)"


@query("f06_islands", f"WITH {ISLANDS} SELECT key, min(pos) AS first, max(pos) AS last, min(n)::INTEGER AS new_first FROM n GROUP BY key, pos - n")
def islands(spark, sf):
    """What is kept, as runs with their new places."""
    kept = read(spark, sf, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos"))
    return O.islands(kept, "key", "pos")


@query("f07_neighbours", "WITH c AS (SELECT CAST(l_quantity AS BIGINT) AS cell, count(*) AS n FROM lineitem GROUP BY ALL) SELECT cell, n, coalesce(lag(n) OVER (ORDER BY cell), last_value(n) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS left_n, coalesce(lead(n) OVER (ORDER BY cell), first_value(n) OVER (ORDER BY cell)) AS right_n FROM c")
def neighbours(spark, sf):
    """Values of the neighbour cells, periodic: a join on the shifted rank of at most as many rows as there are cells."""
    from pyspark.sql import Window as W

    c = read(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy("cell")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return c.select("cell", "n", F.coalesce(F.lag("n").over(w), F.last("n").over(whole)).alias("left_n"), F.coalesce(F.lead("n").over(w), F.first("n").over(whole)).alias("right_n"))


@query("g01_index_set", "SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem")
def index_set(spark, sf):
    return read(spark, sf, "lineitem").select("l_suppkey", "l_linenumber").distinct()


@query("g05_round_robin", "SELECT o_custkey, o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3)::INTEGER AS sender FROM orders")
def round_robin(spark, sf):
    from pyspark.sql import Window as W

    return read(spark, sf, "orders").select("o_custkey", "o_orderkey", ((F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) % 3).alias("sender"))


RANGES = "a AS (SELECT o_custkey AS lo, o_custkey + o_orderkey % 40 AS hi, o_orderkey AS id FROM orders), b AS (SELECT c_custkey - 5 AS lo, c_custkey + 5 AS hi, c_custkey AS id FROM customer)"


@query("d22_range_overlap", f"WITH {RANGES} SELECT a.id AS a_id, b.id AS b_id, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM a JOIN b ON a.lo <= b.hi AND b.lo <= a.hi")
def overlap(spark, sf):
    """Overlapping ranges, clipped, as an equi-join on blocks."""
    a = read(spark, sf, "orders").select(F.col("o_custkey").alias("lo"), (F.col("o_custkey") + F.col("o_orderkey") % 40).alias("hi"), F.col("o_orderkey").alias("id"))
    b = read(spark, sf, "customer").select((F.col("c_custkey") - 5).alias("lo"), (F.col("c_custkey") + 5).alias("hi"), F.col("c_custkey").alias("id"))
    return O.overlaps(a, b, 32).select("a_id", "b_id", "lo", "hi")


@query("h04_overlap_check", f"WITH {RANGES}, n AS (SELECT id, lo, max(hi) OVER (ORDER BY lo, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b) SELECT id FROM n WHERE before >= lo")
def overlap_check(spark, sf):
    """Ranges that begin before an earlier one has ended; a range join finds them without one global window."""
    b = read(spark, sf, "customer").select((F.col("c_custkey") - 5).alias("lo"), (F.col("c_custkey") + 5).alias("hi"), F.col("c_custkey").alias("id"))
    both = O.overlaps(b, b, 32).where("b_lo < a_lo OR (b_lo = a_lo AND b_id < a_id)")
    return both.select(F.col("a_id").alias("id")).distinct()


@query("d19_nearest_sample", """WITH s AS (SELECT user_id, epoch(ts)::DOUBLE AS at, max(value) AS value FROM events GROUP BY ALL), p AS (SELECT user_id, o * 86400.0::DOUBLE * 7 + (SELECT min(epoch(ts)::BIGINT // 86400 * 86400) FROM events) AS x FROM (SELECT DISTINCT user_id FROM events), generate_series(0, 9) g(o)),
r AS (SELECT p.user_id, p.x, s.value, row_number() OVER (PARTITION BY p.user_id, p.x ORDER BY abs(p.x - s.at), s.at DESC) AS n FROM p JOIN s USING (user_id)) SELECT user_id, x, value AS v FROM r WHERE n = 1""")
def nearest(spark, sf):
    """Nearest sample of a user's events at given times."""
    e = read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").cast("double").alias("at"), "value")
    s = e.groupBy("user_id", "at").agg(F.max("value").alias("value"))
    start = e.agg(F.min(F.floor(F.col("at") / 86400) * 86400).alias("start"))
    points = e.select("user_id").distinct().join(F.broadcast(start)).select("user_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("o"), "start")
    points = points.select("user_id", (F.col("o") * F.lit(86400.0 * 7) + F.col("start")).cast("double").alias("x"))
    return O.nearest_sample(points, s, "user_id", "at", "value")


SEG = "seg AS (SELECT o_custkey AS key, (o_orderkey % 4)::INTEGER AS dof, sum(o_totalprice) AS v FROM orders GROUP BY ALL), norms AS (SELECT key, max(abs(v)) AS norm, sqrt(sum(v * v)) AS norm2 FROM seg GROUP BY key), total AS (SELECT max(norm) AS t, sqrt(sum(norm2 * norm2)) AS t2 FROM norms)"


def segments(spark, sf):
    """Customers' order totals as segments of four coefficients."""
    return read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 4).cast("int").alias("dof")).agg(F.sum("o_totalprice").alias("v"))


@query("b02_to_refine", f"WITH {SEG} SELECT key, round(norm, 2) AS norm FROM norms, total WHERE norm >= t * 0.4 AND t > 0")
def to_refine(spark, sf):
    """B1, B2."""
    return A.to_refine(segments(spark, sf), 0.4).select("key", F.round("norm", 2).alias("norm"))


@query("b03_to_drop", f"WITH {SEG} SELECT key, round(norm2, 2) AS norm FROM norms, total WHERE norm2 <= t2 * 0.05")
def to_drop(spark, sf):
    return A.to_drop(segments(spark, sf), 0.5, False).select("key", F.round("norm", 2).alias("norm"))


@query("k06_coarsen", f"WITH {SEG}, kept AS (SELECT seg.* FROM seg JOIN norms USING (key), total WHERE norm > t * 0.08), numbered AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos FROM (SELECT DISTINCT key FROM kept)) SELECT key, dof, round(v, 2) AS v, pos::INTEGER AS pos FROM kept JOIN numbered USING (key)")
def coarsened(spark, sf):
    """Segments dropped by norm, what is left renumbered."""
    return A.renumbered(A.coarsen(segments(spark, sf), 0.8)).select("key", "dof", F.round("v", 2).alias("v"), "pos")


@query("k07_refine", f"WITH {SEG}, kids AS (SELECT DISTINCT unnest([2 * key, 2 * key + 1]) AS key FROM norms, total WHERE norm >= t * 0.4 AND t > 0) SELECT key, dof, round(v, 2) AS v FROM seg UNION ALL SELECT key, dof::INTEGER, 0.0 FROM kids, generate_series(0, 3) d(dof) WHERE key NOT IN (SELECT key FROM seg)")
def refined(spark, sf):
    """Children of large segments, new ones with zeros."""
    kids = F.array(2 * F.col("key"), 2 * F.col("key") + 1)
    return A.refine(segments(spark, sf), 0.4, kids, 4).select("key", "dof", F.round("v", 2).alias("v"))


@query("b04_find", f"WITH {VEC} SELECT vec, i FROM vec WHERE v > 0.3")
def find(spark, sf):
    """B4, B5."""
    return vectors(spark, sf).where("v > 0.3").select("vec", "i")


@query("b10_unique_names", "SELECT p_brand AS name, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 1")
def unique_names(spark, sf):
    return read(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("b11_covered_fields", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING max(l_linenumber) <= 4")
def covered(spark, sf):
    """Orders whose set of line numbers is a subset of 1 to 4."""
    sets = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("lines"))
    return sets.where(F.size(F.array_except("lines", F.array(*[F.lit(i) for i in range(1, 5)]))) == 0).select("l_orderkey")


@query("b13_membership", "SELECT c_custkey, coalesce(n, 0) AS n, n IS NULL AS missing FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def membership(spark, sf):
    """Found or missing."""
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    joined = read(spark, sf, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


@query("b06_term_filters", "SELECT n_name AS name, n_regionkey = 1 AS used FROM nation WHERE n_nationkey % 3 <> 0")
def term_filters(spark, sf):
    """Terms chosen by a mask and a flag."""
    return read(spark, sf, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("name"), (F.col("n_regionkey") == 1).alias("used"))


@query("b15_submatrix", f"WITH {MAT} SELECT row - 5 AS row, col - 2 AS col, v FROM mat WHERE row BETWEEN 5 AND 24 AND col BETWEEN 2 AND 5")
def submatrix(spark, sf):
    """B15, B18."""
    return L.submatrix(matrix(spark, sf), 5, 2, 20, 4)


@query("b16_set_submatrix", f"WITH {MAT} SELECT row, col, CASE WHEN row BETWEEN 5 AND 8 AND col BETWEEN 2 AND 5 THEN CASE WHEN row - 5 = col - 2 THEN 1.0 ELSE 0.0 END ELSE v END AS v FROM mat")
def set_submatrix(spark, sf):
    """B16, B17."""
    from gridloom.operators.generators import eye

    return L.set_submatrix(matrix(spark, sf), 5, 2, eye(spark, 4))


@query("b19_concat", f"WITH {MAT} SELECT row, col, v FROM mat UNION ALL SELECT row, col + 7, v * 2 FROM mat")
def concat(spark, sf):
    """B19, B20, I16."""
    m = matrix(spark, sf)
    return L.horizontal(m, 7, m.withColumn("v", F.col("v") * 2))


@query("b21_reshape", f"WITH {MAT} SELECT (col * 50 + row) % 25 AS row, (col * 50 + row) // 25 AS col, v FROM mat")
def reshape(spark, sf):
    return L.reshape(matrix(spark, sf), 50, 25)


@query("b22_transpose", f"WITH {MAT} SELECT col AS row, row AS col, v FROM mat")
def transpose(spark, sf):
    return L.transpose(matrix(spark, sf))


KRON = "b AS (SELECT r AS row, c AS col, (r * 2 + c + 1)::DOUBLE AS v FROM generate_series(0, 1) x(r), generate_series(0, 1) y(c))"


@query("d27_kron", f"WITH {MAT}, {KRON} SELECT mat.row * 2 + b.row AS row, mat.col * 2 + b.col AS col, mat.v * b.v AS v FROM mat, b")
def kron(spark, sf):
    """Kronecker products of matrices and (with one column) vectors."""
    return L.kron(matrix(spark, sf), small(spark), 2, 2)


def small(spark):
    two = F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))
    return spark.range(2).select(F.col("id").alias("row"), F.explode(two).alias("col")).withColumn("v", (F.col("row") * 2 + F.col("col") + 1).cast("double"))


STATE = "st AS (SELECT (c_custkey % 8)::BIGINT AS i1, (c_nationkey % 8)::BIGINT AS i2, sum(CAST(trunc(c_acctbal) AS BIGINT))::DOUBLE AS v FROM customer GROUP BY ALL), a1 AS (SELECT r AS row, c AS col, (r + 2 * c + 1)::DOUBLE AS v FROM generate_series(0, 7) x(r), generate_series(0, 7) y(c) WHERE abs(r - c) <= 1), a2 AS (SELECT r AS row, c AS col, (3 * r - c)::DOUBLE AS v FROM generate_series(0, 7) x(r), generate_series(0, 7) y(c) WHERE r <= c)"


@query("d09_kronecker_apply", f"WITH {STATE} SELECT a1.row AS i1, a2.row AS i2, round(sum(a1.v * a2.v * st.v), 2) AS v FROM st JOIN a1 ON a1.col = i1 JOIN a2 ON a2.col = i2 GROUP BY ALL")
def kronecker(spark, sf):
    """Kronecker-structured operator applied dimension by dimension."""
    from gridloom.operators.connect import kron_apply

    c = read(spark, sf, "customer")
    st = c.groupBy((F.col("c_custkey") % 8).alias("i1"), (F.col("c_nationkey") % 8).cast("long").alias("i2")).agg(F.sum(F.col("c_acctbal").cast("long")).cast("double").alias("v"))
    a = square(spark).where("abs(row - col) <= 1").withColumn("v", (F.col("row") + 2 * F.col("col") + 1).cast("double"))
    b = square(spark).where("row <= col").withColumn("v", (3 * F.col("row") - F.col("col")).cast("double"))
    return kron_apply(st, [a, b], 2).select("i1", "i2", F.round("v", 2).alias("v"))


def square(spark, n: int = 8):
    return spark.range(n).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("col"))


@query("d13_upper_lower", f"WITH {MAT} SELECT row, col, v, CASE WHEN col >= row THEN 'upper' ELSE 'lower' END AS part FROM mat")
def upper_lower(spark, sf):
    """D11, D13."""
    return matrix(spark, sf).withColumn("part", F.when(F.col("col") >= F.col("row"), "upper").otherwise("lower"))


@query("d14_system_matrix", """WITH a AS (SELECT l_suppkey % 8 AS row, l_partkey % 8 AS col, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS v FROM lineitem GROUP BY ALL), b AS (SELECT (l_linenumber % 8)::BIGINT AS row, l_orderkey % 8 AS col, count(*)::DOUBLE AS v FROM lineitem GROUP BY ALL)
SELECT a.row * 8 + b.row AS row, a.col * 8 + b.col AS col, a.v * b.v + CASE WHEN a.row = a.col AND b.row = b.col THEN 1.0 ELSE 0.0 END AS v FROM a, b""")
def system_matrix(spark, sf):
    """The product of two matrices of lineitem, and the identity."""
    li = read(spark, sf, "lineitem")
    a = li.groupBy((F.col("l_suppkey") % 8).alias("row"), (F.col("l_partkey") % 8).alias("col")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("v"))
    b = li.groupBy((F.col("l_linenumber") % 8).cast("long").alias("row"), (F.col("l_orderkey") % 8).alias("col")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    one = F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.0)
    return L.kron(a, b, 8, 8).withColumn("v", F.col("v") + one)


@query("d15_combine_dimensions", f"WITH {STATE} SELECT i1, i2, ((i1 + 1) * 0.5 * (i2 * i2))::DOUBLE AS v FROM st")
def combine(spark, sf):
    """Product of one-dimensional vectors at the elements' indices."""
    c = read(spark, sf, "customer").select((F.col("c_custkey") % 8).alias("i1"), (F.col("c_nationkey") % 8).cast("long").alias("i2")).distinct()
    one = spark.range(8).select(F.col("id").alias("k1"), ((F.col("id") + 1) * 0.5).alias("v1"))
    two = spark.range(8).select(F.col("id").alias("k2"), (F.col("id") * F.col("id")).cast("double").alias("v2"))
    return c.join(F.broadcast(one), F.col("i1") == F.col("k1")).join(F.broadcast(two), F.col("i2") == F.col("k2")).select("i1", "i2", (F.col("v1") * F.col("v2")).alias("v"))


@query("a07_rebuild_elements", "SELECT l_orderkey AS pos, list(l_linenumber ORDER BY l_linenumber)[1]::INTEGER AS lev1, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def rebuild(spark, sf):
    """Elements from a flat list: chunks of consecutive numbers back to rows."""
    flat = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("chunk"))
    return flat.select(F.col("l_orderkey").alias("pos"), F.element_at("chunk", 1).alias("lev1"), F.size("chunk").cast("long").alias("n"))


@query("h03_union_all", "SELECT o_custkey AS id, count(*) AS n FROM (SELECT o_custkey FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY ALL")
def union_all(spark, sf):
    """H3: changes of all parts together."""
    both = read(spark, sf, "orders").select(F.col("o_custkey").alias("id")).unionByName(read(spark, sf, "customer").select(F.col("c_custkey").alias("id")))
    return both.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


HAAR = f"""bins AS (SELECT least(31, CAST(floor((l_quantity - 1) / 50 * 32) AS BIGINT)) AS cell, count(*) AS n FROM lineitem GROUP BY 1), cells AS (SELECT c AS cell, coalesce(n, 0)::DOUBLE AS n FROM generate_series(0, 31) s(c) LEFT JOIN bins ON cell = c),
coef AS (SELECT 0 AS lev, 0 AS cell, sum(n) * power(2, -2.5) AS coef FROM cells UNION ALL SELECT l, k, sum(w) * power(2, -(6 - l) / 2.0) FROM (SELECT l, cell // (1::BIGINT << (6 - l)) AS k, n * CASE WHEN cell // (1::BIGINT << (5 - l)) % 2 = 1 THEN 1 ELSE -1 END AS w FROM cells, generate_series(1, 5) g(l)) GROUP BY l, k)"""


@query("haar_density", f"WITH {HAAR}, total AS (SELECT sqrt(sum(coef * coef)) AS t FROM coef) SELECT lev::INTEGER AS lev, cell::BIGINT AS cell, round(coef, 6) AS coef FROM coef, total WHERE abs(coef) > 0.1 * 0.05 * t")
def haar_density(spark, sf):
    """Flagship: histogram of quantities, its Haar coefficients, and those that coarsening keeps."""
    coef = haar(spark, sf)
    total = coef.agg(L.nrm2(F.col("coef")).alias("total"))
    return coef.join(F.broadcast(total)).where(F.abs("coef") > A.COARSEN * 0.05 * F.col("total")).select("lev", "cell", F.round("coef", 6).alias("coef"))


def haar(spark, sf):
    """Coefficients (lev, cell, coef): each bin meets one basis function per level, so the transform is an explode and a sum."""
    cell = F.least(F.lit(31), F.floor((F.col("l_quantity") - 1) / 50 * 32)).cast("long")
    bins = read(spark, sf, "lineitem").groupBy(cell.alias("fine")).agg(F.count(F.lit(1)).alias("n"))
    basis = bins.withColumn("lev", F.explode(F.sequence(F.lit(0), F.lit(5))))
    up = F.when(F.col("lev") == 0, F.lit(0).cast("long")).otherwise(F.floor(F.col("fine") / S.pow2(6 - F.greatest(F.col("lev"), F.lit(1)))))
    half = F.floor(F.col("fine") / S.pow2(F.lit(5) - F.col("lev"))) % 2
    sign = F.when((F.col("lev") == 0) | (half == 1), 1.0).otherwise(-1.0)
    scale = F.when(F.col("lev") == 0, F.lit(2.0**-2.5)).otherwise(F.pow(F.lit(2.0), -(6 - F.col("lev")) / 2))
    found = basis.groupBy("lev", up.alias("cell")).agg((F.sum(F.col("n") * sign) * F.first(scale)).alias("coef"))
    every = spark.range(32).select(S.level_of(F.col("id")).alias("b_lev"), S.cell_of(F.col("id")).alias("b_cell"))
    return every.join(found, (F.col("lev") == F.col("b_lev")) & (F.col("cell") == F.col("b_cell")), "left").select(F.col("b_lev").alias("lev"), F.col("b_cell").alias("cell"), F.coalesce("coef", F.lit(0.0)).alias("coef"))


@query("j04_haar_inverse", f"WITH {HAAR} SELECT cells.cell, round(sum(coef * CASE WHEN lev = 0 THEN power(2, -2.5) ELSE power(2, -(6 - lev) / 2.0) * CASE WHEN cells.cell // (1::BIGINT << greatest(5 - lev, 0)) % 2 = 1 THEN 1 ELSE -1 END END), 4) AS n FROM cells, coef WHERE lev = 0 OR cells.cell // (1::BIGINT << (6 - greatest(lev, 1))) = coef.cell GROUP BY cells.cell")
def haar_inverse(spark, sf):
    """Back to the values of the cells."""
    coef = haar(spark, sf)
    width = S.pow2(6 - F.greatest(F.col("lev"), F.lit(1)))
    fine = F.when(F.col("lev") == 0, F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).otherwise(F.sequence(F.col("cell") * width, (F.col("cell") + 1) * width - 1))
    grown = coef.withColumn("fine", F.explode(fine))
    half = F.floor(F.col("fine") / S.pow2(F.lit(5) - F.col("lev"))) % 2
    part = F.when(F.col("lev") == 0, F.col("coef") * 2.0**-2.5).otherwise(F.col("coef") * F.pow(F.lit(2.0), -(6 - F.col("lev")) / 2) * F.when(half == 1, 1.0).otherwise(-1.0))
    return grown.groupBy(F.col("fine").alias("cell")).agg(F.round(F.sum(part), 4).alias("n"))


@query("l05_windowed_timers", "SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS start, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed(spark, sf):
    """Timed events per hour; gridloom.streaming has the same over a stream."""
    from gridloom.streaming.timers import per_window

    return per_window(read(spark, sf, "events"))


SQUARES = """m AS (SELECT vec_id AS batch, (i - 1) // 8 AS row, (i - 1) % 8 AS col, embedding[i]::DOUBLE AS v FROM embeddings, generate_series(1, 64) g(i))"""


def squares(spark, sf):
    """Each vector of 64 as an 8 by 8 matrix: (batch, row, col, v)."""
    return vectors(spark, sf).select(F.col("vec").alias("batch"), F.floor(F.col("i") / 8).alias("row"), (F.col("i") % 8).cast("long").alias("col"), "v")


@query("j12_batched_gemm", f"WITH {SQUARES} SELECT a.batch, a.row::BIGINT AS row, b.col::BIGINT AS col, round(sum(a.v * b.v), 9) + 0.0 AS v FROM m a JOIN m b ON a.batch = b.batch AND a.col = b.row GROUP BY ALL")
def batched_products(spark, sf):
    """Every vector's matrix times itself."""
    m = squares(spark, sf)
    return L.batched_gemm(m, m).withColumn("v", F.round("v", 9) + 0.0)


@query("j11_batched_chain", f"WITH {SQUARES}, one AS (SELECT batch, row, sum(v) AS v FROM m GROUP BY ALL), two AS (SELECT m.batch, m.row, sum(m.v * one.v) AS v FROM m JOIN one ON m.batch = one.batch AND m.col = one.row GROUP BY ALL) SELECT batch, row::BIGINT AS i, round(v, 9) + 0.0 AS v FROM two")
def batched_chains(spark, sf):
    """Every vector's matrix applied twice to a vector of ones."""
    m = squares(spark, sf)
    ones = m.where("row = 0").select("batch", F.col("col").alias("i"), F.lit(1.0).alias("v"))
    return L.batched_chain([m, m], ones).withColumn("v", F.round("v", 9) + 0.0)
