"""Time loop over a stream: each micro-batch of step numbers advances the state and appends a snapshot."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from gridloom.dg import stepping
from gridloom.sources import snapshot


def advance(spark: SparkSession, path: str, run: str, steps: DataFrame, name: str, cfl: float = 0.01, levels=None, degree=None):
    """Streaming query: the number of rows of a micro-batch is the number of steps taken.

    The state between batches is the last snapshot, so a query that is started
    again goes on where the last one ended. A snapshot names its micro-batch and the
    query that it is one of, and a batch that the same query replays after a failure
    is not taken twice. A query with another checkpoint folder has another id and
    numbers its batches anew, and all of them count.
    """
    from gridloom.dg.problems import problem

    def batch(rows: DataFrame, number: int) -> None:
        count = rows.count()
        if not count:
            return
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        try:
            state, head = snapshot.read(spark, path, run)
            first = head["step"] + 1
            before = json.loads(head["extra"])
            if before.get("query") == query and before.get("batch", -1) >= number:
                return
        except Exception as e:  # noqa: BLE001  nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and not isinstance(e, IndexError):
                raise
            state, first = stepping.initial(problem(name, levels, degree)), 0
        dt = state.problem.step(cfl)
        for i, t, after in stepping.run(state.problem, first + count, cfl=cfl, start=state, first=first):
            state, last, time = after, i, t
        snapshot.write(spark, path, run, last, time, dt, state, {"batch": number, "query": query})

    return steps.writeStream.foreachBatch(batch)
