"""The stateful time loop: against its batch form, over restarts, replays and new checkpoint folders."""

import glob
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.streaming import evolution as E

SF = "/root/testdata/sf0.001"
LENGTH, DECAY, DEGREE = 86_400, 0.5, 3


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, E.STORE)
    yield
    spark.conf.set(name, before)


def keyed(events):
    return events.select(F.col("event_type").alias("key"), "ts", (F.col("value") / 1000).alias("x"))


def rows(df):
    return {(r.key, r.step): (r.version, np.array(r.v)) for r in df.collect()}


def same(a, b):
    return set(a) == set(b) and all(a[k][0] == b[k][0] and np.allclose(a[k][1], b[k][1], atol=1e-9) for k in a)


def brute(events):
    out, state = {}, {}
    for r in sorted(events, key=lambda r: r.ts):
        if r.key is None:
            continue
        step = int(r.ts.timestamp()) // LENGTH
        u = 2 * r.x - 1
        p = np.polynomial.legendre.legvander(np.array([u]), DEGREE - 1)[0] * np.sqrt(2 * np.arange(DEGREE) + 1)
        last, version, v = state.get(r.key, (step, 0, np.zeros(DEGREE)))
        v = v * DECAY ** (step - last) + p
        state[r.key] = (step, version + (version == 0 or step != last), v)
        out[r.key, step] = (state[r.key][1], v)
    return out


def run(spark, source, checkpoint, out):
    stream = spark.readStream.schema("event_type string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(source)
    steps = E.evolved_stream(keyed(stream), LENGTH, DECAY, DEGREE, "1 day")
    steps.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return rows(spark.read.schema(E.OUT).parquet(out)) if glob.glob(f"{out}/*.parquet") else {}


def test_batch_form_equals_brute_force(spark):
    events = keyed(spark.read.parquet(f"{SF}/events.parquet"))
    events = events.unionByName(events.limit(1).withColumn("key", F.lit(None).cast("string")))
    assert same(rows(E.evolved(events, LENGTH, DECAY, DEGREE)), brute(events.collect()))


def test_restart_replay_and_new_folder_give_the_same_steps(spark, tmp_path, store):
    source, events = f"{tmp_path}/in", spark.read.parquet(f"{SF}/events.parquet").select("event_type", "ts", "value")
    os.makedirs(source)
    parts = [events.where(F.dayofmonth("ts") <= 10), events.where(F.dayofmonth("ts").between(11, 20)), events.where(F.dayofmonth("ts") > 20)]
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/part{k}")

    def deliver(k):
        (path,) = glob.glob(f"{tmp_path}/part{k}/*.parquet")
        shutil.copy(path, f"{source}/{k}.parquet")

    deliver(0)
    first = run(spark, source, f"{tmp_path}/c1", f"{tmp_path}/o1")
    deliver(1)
    deliver(2)
    second = run(spark, source, f"{tmp_path}/c1", f"{tmp_path}/o1")  # started again
    assert first and set(first) < set(second)
    # the commit of the last batch is lost: it is made again, with the same results
    commits = sorted((f for f in os.listdir(f"{tmp_path}/c1/commits") if f.isdigit()), key=int)
    for name in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(f"{tmp_path}/c1/commits/{name}"):
            os.remove(f"{tmp_path}/c1/commits/{name}")
    assert same(run(spark, source, f"{tmp_path}/c1", f"{tmp_path}/o1"), second)
    assert same(run(spark, source, f"{tmp_path}/c2", f"{tmp_path}/o2"), second)  # a new checkpoint folder: all steps again
    whole = rows(E.evolved(keyed(events), LENGTH, DECAY, DEGREE))
    end = events.agg(F.max(F.unix_timestamp("ts"))).first()[0] - 86_400
    assert same(second, {k: v for k, v in whole.items() if (k[1] + 1) * LENGTH <= end})
