"""A time loop as a stateful stream: each key's coefficients are advanced step by step in the state store.

A step covers ``length`` seconds of event time. When the watermark has passed its end,
the state decays by the steps in between, takes up what the step's events project
onto the Legendre functions of their value, and is given out as (key, step, version, v).
Versions count a key's steps. The state and its open steps are in the store, under the
stream's own checkpoint: a batch that is replayed starts from the state before it, a query that
is started again goes on, and one with a new checkpoint folder makes all steps again from the
start. No batch number decides anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridloom.operators.multiwave import phi

OUT = "key string, step long, version long, v array<double>"
#: The state store that keeps timers and maps of a key apart.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Evolution(StatefulProcessor):
    def __init__(self, length: int, decay: float, degree: int):
        self.length, self.decay, self.degree = length, decay, degree

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "step long, version long, v array<double>")
        self.open = handle.getMapState("open", "step long", "v array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.state.get()[0] if self.state.exists() else None
        sums: dict[int, np.ndarray] = {}
        for batch in rows:
            table = np.stack(batch["p"].to_numpy())
            for step in batch["step"].unique():
                if done is None or step > done:  # what comes behind the watermark is late and has no step any more
                    sums[int(step)] = sums.get(int(step), 0.0) + table[(batch["step"] == step).to_numpy()].sum(0)
        for step, found in sums.items():
            if self.open.containsKey((step,)):
                found = found + np.array(self.open.getValue((step,))[0])
            else:
                self.handle.registerTimer((step + 1) * self.length * 1000)
            self.open.updateValue((step,), (found.tolist(),))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        step = expiredTimerInfo.getExpiryTimeInMs() // 1000 // self.length - 1
        added = np.array(self.open.getValue((step,))[0])
        last, version, v = self.state.get() if self.state.exists() else (step, 0, [0.0] * self.degree)
        new = self.decay ** (step - last) * np.array(v) + added
        self.state.update((step, version + 1, new.tolist()))
        self.open.removeKey((step,))
        yield pd.DataFrame({"key": [key[0]], "step": [step], "version": [version + 1], "v": [new.tolist()]})

    def close(self) -> None:
        pass


def _rows(events: DataFrame, length: int, degree: int) -> DataFrame:
    """key, ts, step and p (functions of x, a place in [0, 1)) of the events (key, ts, x)."""
    step = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (length * 1_000_000)).cast("long")
    return events.where("key IS NOT NULL AND ts IS NOT NULL AND x IS NOT NULL").select("key", "ts", step.alias("step"), F.array(*phi(F.col("x"), degree)).alias("p"))


def evolved_stream(events: DataFrame, length: int, decay: float, degree: int, delay: str) -> DataFrame:
    """The steps of a stream (key, ts, x), each when the watermark has passed it."""
    rows = _rows(events, length, degree).withWatermark("ts", delay)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Evolution(length, decay, degree), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def evolved(events: DataFrame, length: int, decay: float, degree: int) -> DataFrame:
    """All steps of a table (key, ts, x): the stream's results once all steps are closed.

    A step's state is a sum over the steps before it, each weighted by its decay. Steps
    whose weight is below a double's precision are outside the frame, so a frame is
    bounded whatever the length of a key's history.
    """
    if not 0 < decay < 1:
        raise ValueError("decay must lie between 0 and 1")
    p = _rows(events, length, degree)
    sums = p.groupBy("key", "step").agg(*[F.sum(F.col("p")[m]).alias(f"s{m}") for m in range(degree)])
    far = max(1, int(np.ceil(np.log(1e-20) / np.log(decay))))
    order = W.partitionBy("key").orderBy("step")
    seen = F.collect_list(F.struct("step", *[f"s{m}" for m in range(degree)])).over(order.rangeBetween(-far, 0))
    rows = sums.select("key", "step", F.row_number().over(order).cast("long").alias("version"), seen.alias("seen"))
    return rows.select("key", "step", "version", F.array(*[_weighted(m, decay) for m in range(degree)]).alias("v"))


def _weighted(m: int, decay: float):
    return F.aggregate("seen", F.lit(0.0), lambda a, x: a + x[f"s{m}"] * F.pow(F.lit(float(decay)), F.col("step") - x["step"]))
