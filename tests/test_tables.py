import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import tables
from gridloom.operators import coupled, dense


def test_table_functions_check_their_arguments(spark):
    tables.register(spark)
    spark.range(4).select(F.lit("k").alias("key"), (F.col("id") / 4.0).alias("x")).createOrReplaceTempView("few_points")
    call = lambda text: spark.sql(f"SELECT key, i, digit, sum(v) AS v FROM multiwave_sums(TABLE(few_points), {text}) GROUP BY ALL").collect()
    root = {r.digit: r.v for r in call("2, 1") if r.i == 0}
    assert abs(root[0] - 4) < 1e-12 and abs(root[1] - np.sqrt(3) * sum(2 * x / 4 - 1 for x in range(4))) < 1e-12
    with pytest.raises(Exception, match="degree must be"):
        call("9, 1")
    with pytest.raises(Exception, match="no problem is called nothing"):
        spark.sql("SELECT * FROM problem_values(TABLE(SELECT 1L AS k, 0.5D AS x1), 'nothing', 0D)").collect()


def test_dense_rows(spark):
    rng = np.random.default_rng(0)
    a, y = rng.normal(size=(50, 4, 4)), rng.normal(size=(50, 4))
    rows = [(k, m.ravel().tolist(), v.tolist()) for k, (m, v) in enumerate(zip(a, y, strict=True))]
    rows += [(50, [0.0] * 16, [1.0] * 4), (51, None, [1.0] * 4), (52, [1.0] * 3, [1.0] * 4), (53, a[0].ravel().tolist(), None)]
    df = spark.createDataFrame(rows, "id long, m array<double>, y array<double>")
    got = {r.id: r for r in dense.factored(df, 4, "m", ["y"], ["id"]).collect()}
    for k in range(50):
        assert np.isclose(got[k].det, np.linalg.det(a[k])) and np.allclose(np.reshape(got[k].inverse, (4, 4)), np.linalg.inv(a[k])) and np.allclose(got[k].x0, np.linalg.solve(a[k], y[k]))
    assert all(got[k].det == 0 and got[k].inverse is None and got[k].x0 is None for k in (50, 51, 52)) and got[53].x0 is None and got[53].inverse is not None
    upper = np.triu(a[0]) + 3 * np.eye(4)
    packed = [float(upper[i, j]) for j in range(4) for i in range(j + 1)]
    one = spark.createDataFrame([(packed, y[0].tolist())], "u array<double>, y array<double>").select(dense.back_substituted(F.col("u"), F.col("y"), 4).alias("x")).first()
    assert np.allclose(one.x, np.linalg.solve(upper, y[0]))


def test_coupled_fields_of_different_size(spark):
    rng = np.random.default_rng(2)
    sizes = {"a": 3, "b": 5}
    blocks = {(t, s): rng.normal(size=(sizes[t], sizes[s])) for t in sizes for s in sizes}
    u = {f: rng.normal(size=n) for f, n in sizes.items()}
    rows = [spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "row long, col long, v double") for m in blocks.values()]
    terms = [coupled.block(t, s, r) for (t, s), r in zip(blocks, rows, strict=True)]
    every = terms[0].unionByName(terms[1]).unionByName(terms[2]).unionByName(terms[3])
    state = coupled.state_of({f: spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k int, v double") for f, x in u.items()})
    got = {(r.field, r.k): r.v for r in coupled.advanced(state, every, 0.1, 2).collect()}
    whole, x, dt = np.block([[blocks["a", "a"], blocks["a", "b"]], [blocks["b", "a"], blocks["b", "b"]]]), np.concatenate([u["a"], u["b"]]), 0.1
    for _ in range(2):
        k1 = whole @ x
        k2 = whole @ (x + dt / 2 * k1)
        k3 = whole @ (x - dt * k1 + 2 * dt * k2)
        x = x + dt * (k1 / 6 + 2 * k2 / 3 + k3 / 6)
    assert np.allclose([got["a", k] for k in range(3)] + [got["b", k] for k in range(5)], x)
