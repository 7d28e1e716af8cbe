import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import krylov
from gridloom.sources.scratch import Scratch


def system(spark, n, seed, diagonal):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random((n, n)) < 0.15, rng.normal(size=(n, n)), 0.0)
    np.fill_diagonal(a, diagonal * (1 + 5 * rng.random(n)) + np.abs(a).sum(1))
    rows = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "row long, col long, w double").cache()

    def apply(x):
        return rows.join(x.select(F.col("k").alias("x_k"), F.col("v").alias("x_v")), F.col("col") == F.col("x_k")).groupBy(F.col("row").alias("k")).agg(F.sum(F.col("w") * F.col("x_v")).alias("v"))

    return a, apply, rows.where("row = col").select(F.col("row").alias("k"), F.col("w").alias("v"))


@pytest.mark.parametrize("preconditioned", [False, True])
def test_restarted(spark, preconditioned):
    a, apply, diagonal = system(spark, 40, 3, 0.2)
    b = np.random.default_rng(4).normal(size=40)
    vector = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "k long, v double")
    found = krylov.gmres(["k"], apply, vector, restart=4, tolerance=1e-9, precondition=krylov.jacobi(["k"], diagonal) if preconditioned else None)
    x = np.zeros(40)
    for r in found.x.collect():
        x[r.k] = r.v
    assert found.steps > 4 and found.residual <= 1e-9 and np.allclose(x, np.linalg.solve(a, b), atol=1e-7)
    # the bases of all cycles are gone: a solution is all that is left
    left = [f for base in Scratch.open for f in glob.glob(f"{base.removeprefix('file://')}/*") if "/krylov-" in f]
    assert sum("/krylov-" in f for f in left) <= 2 * (1 + preconditioned)


def test_no_right_hand_side_and_no_convergence(spark):
    _, apply, _ = system(spark, 10, 1, 0.1)
    zero = spark.createDataFrame([(1, 0.0)], "k long, v double")
    assert krylov.gmres(["k"], apply, zero).x.count() == 0
    one = spark.createDataFrame([(1, 1.0)], "k long, v double")
    with pytest.raises(RuntimeError, match="residual"):
        krylov.gmres(["k"], apply, one, restart=2, most=2, tolerance=1e-14)


def test_a_step_writes_one_table(spark, monkeypatch):
    a, apply, _ = system(spark, 8, 2, 0.2)
    written, write = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df: written.append(1) or write(self, df))
    # keys without a right-hand side come in by the operator
    found = krylov.gmres(["k"], apply, spark.createDataFrame([(0, 1.0)], "k long, v double"), tolerance=1e-9)
    x = np.zeros(8)
    for r in found.x.collect():
        x[r.k] = r.v
    assert np.allclose(x, np.linalg.solve(a, np.eye(8)[0]), atol=1e-7)
    assert len(written) <= found.steps + 5  # besides: the right-hand side, the first x, two residuals and the solution
