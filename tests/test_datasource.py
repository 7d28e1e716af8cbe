import os

import pytest
from pyspark.sql import functions as F

from gridloom.operators import kinetic as K
from gridloom.sources import datasource as D


def frame(spark, rows):
    return spark.createDataFrame([(r, s, p, [p % 3], [p], [float(p), v]) for r, s, p, v in rows], D.SCHEMA)


def files(path):
    return [f for _, _, names in os.walk(path) for f in names if not f.endswith(".crc")]


def test_write_read_and_pushed_filters(spark, tmp_path):
    D.register(spark)
    path = f"{tmp_path}/s"
    rows = [(r, s, p, 0.5 * p) for r in ("a", "b/c=1") for s in range(4) for p in range(5)]
    frame(spark, rows).repartition(3).write.format("gridloom").mode("append").option("path", path).save()
    read = spark.read.format("gridloom").option("path", path).load()
    assert sorted((r.run, r.step, r.pos, r.seg[1]) for r in read.collect()) == sorted(rows)
    one = read.where((F.col("run") == "b/c=1") & (F.col("step") >= 2) & (F.col("pos") > 1))
    assert one.count() == 6
    assert one.rdd.getNumPartitions() < read.rdd.getNumPartitions() / 3
    plan = one._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(step,2)" in plan or "pos" in plan
    assert read.where("run = 'nobody'").count() == 0


def test_overwrite_replaces_and_append_refuses(spark, tmp_path):
    D.register(spark)
    path = f"{tmp_path}/s"
    save = lambda rows, mode: frame(spark, rows).write.format("gridloom").mode(mode).option("path", path).save()
    save([("a", 0, 0, 1.0), ("a", 1, 0, 2.0)], "append")
    save([("a", 1, 0, 3.0), ("a", 1, 1, 4.0)], "overwrite")
    read = spark.read.format("gridloom").option("path", path).load()
    assert sorted((r.step, r.pos, r.seg[1]) for r in read.collect()) == [(0, 0, 1.0), (1, 0, 3.0), (1, 1, 4.0)]
    with pytest.raises(Exception, match="already there"):
        save([("a", 0, 0, 9.0)], "append")
    assert read.count() == 3


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    D.register(spark)
    path = f"{tmp_path}/s"
    bad = frame(spark, [("a", 0, p, 0.0) for p in range(400)]).repartition(4).withColumn("step", F.when(F.col("pos") == 399, F.raise_error(F.lit("lost"))).otherwise(F.col("step")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("gridloom").mode("append").option("path", path).save()
    assert not files(path) and spark.read.format("gridloom").option("path", path).load().count() == 0


def test_kinetic_step_keeps_mass(spark):
    import numpy as np

    g = K.Grid(8, 2.0, 24, 6.0)
    v = (np.arange(24) + 0.5) * g.hv - 6
    rows = [(x, j, float((1 + 0.3 * np.cos(np.pi * (x + 0.5) / 4)) * np.exp(-((v[j] - 0.2) ** 2) / 2))) for x in range(8) for j in range(24)]
    state = spark.createDataFrame(rows, "x long, j long, f double")
    before = K.totals(state, g)
    after = K.totals(K.step(state, g, 0.01, 1.0, 4), g)
    assert abs(after[0] / before[0] - 1) < 1e-13  # mass
    assert abs(after[1] / before[1] - 1) < 1e-6  # momentum: up to the tails at the ends of the velocities
    assert abs(after[2] / before[2] - 1) < 5e-3  # energy: upwind fluxes are of first order
    # collisions alone: towards a normal distribution of the same moments
    m = K.moments(state, g)
    far = K.collided(state, m, g, 50.0, 4)
    n, u = (np.array([r[c] for r in K.moments(far, g).orderBy("x").collect()]) for c in ("n", "u"))
    want = np.array([r.n for r in m.orderBy("x").collect()])
    assert np.allclose(n, want, rtol=1e-10) and np.allclose(u, 0.2, atol=1e-4)
    # a place where nothing is stays empty
    none = K.step(state.withColumn("f", F.when(F.col("x") < 4, F.col("f")).otherwise(0.0)), g, 0.001, 1.0, 4)
    assert none.where("f IS NULL OR isnan(f)").count() == 0
