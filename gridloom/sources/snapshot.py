"""Snapshots of runs: header, elements and coefficients as Parquet, partitioned by run and step."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.dg import kinetic
from gridloom.dg.operators import Elements, leveled
from gridloom.dg.problems import problem
from gridloom.dg.stepping import State


def write(spark: SparkSession, path: str, run: str, step: int, time: float, dt: float, state: State, extra: dict | None = None) -> None:
    p, size = state.problem, state.problem.degree ** len(state.problem.dims)
    head = [(run, step, p.name, p.degree, dt, time, len(p.dims), len(state.x), json.dumps([d.level for d in p.dims]), json.dumps(extra or {}))]
    schema = "run string, step int, pde string, degree int, dt double, time double, ndims int, dof long, levels string, extra string"
    rows = pd.DataFrame({"run": run, "step": step, "pos": np.arange(len(state.elements)), "lev": state.elements.levels.tolist(), "cell": state.elements.cells.tolist(), "seg": state.x.reshape(-1, size).tolist()})
    frame = spark.createDataFrame(rows, "run string, step int, pos long, lev array<int>, cell array<int>, seg array<double>")
    # a step that is written again replaces what an attempt before it left; the header comes last and makes it valid
    for part, name in ((frame, "elements"), (spark.createDataFrame(head, schema), "header")):
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "step").parquet(f"{path}/{name}")


def header(spark: SparkSession, path: str, run: str, step: int | None = None) -> dict:
    """The header of a step, by default of the last; pde, degree and levels of a restart come from here."""
    rows = spark.read.parquet(f"{path}/header").where(F.col("run") == run)
    rows = rows.where(F.col("step") == step) if step is not None else rows.orderBy(F.desc("step"))
    return rows.limit(1).collect()[0].asDict()


def state_frame(spark: SparkSession, path: str, run: str, step: int) -> DataFrame:
    return spark.read.parquet(f"{path}/elements").where((F.col("run") == run) & (F.col("step") == step))


def read(spark: SparkSession, path: str, run: str, step: int | None = None) -> tuple[State, dict]:
    """State and header from which a run goes on."""
    head = header(spark, path, run, step)
    rows = state_frame(spark, path, run, head["step"]).orderBy("pos").toPandas()
    elements = Elements(np.array(rows["lev"].tolist()), np.array(rows["cell"].tolist()))
    build = kinetic.described if head["pde"] in kinetic.BUILDERS else problem
    p = leveled(build(head["pde"], json.loads(head["levels"]), head["degree"]), elements)
    return State(p, elements, np.concatenate([np.asarray(s, float) for s in rows["seg"]])), head
