"""Tridiagonal systems over ordered rows, solved in parts.

Row k of a system is a x[k-1] + b x[k] + c x[k+1] = y, in the order of a unique column.
The rows are dealt into ranges. Each part is eliminated by itself for three right-hand
sides: its own, and one for each unknown that it shares with its neighbours. A part's
first and last row of these make one small row; the system of these rows has two unknowns
a part and is the only thing that one place sees. With its solution each row's unknown is
a formula of the row and its part. Systems must be such that elimination without
exchanges is stable, as diagonally dominant ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.scratch import Scratch


def eliminate(a: list[float], b: list[float], c: list[float], y: list[float]) -> tuple[list[float], list[float], list[float]]:
    """x = p - q * (unknown before the first) - r * (unknown behind the last): the three solutions p, q, r."""
    n = len(b)
    upper, p, q = [0.0] * n, [0.0] * n, [0.0] * n
    before_u = before_p = before_q = 0.0
    for i in range(n):
        low = a[i] if i else 0.0
        pivot = b[i] - low * before_u
        before_u = upper[i] = c[i] / pivot
        before_p = p[i] = (y[i] - low * before_p) / pivot
        before_q = q[i] = ((a[0] if i == 0 else 0.0) - low * before_q) / pivot
    r = [0.0] * n
    r[-1] = upper[-1]
    for i in range(n - 2, -1, -1):
        p[i] -= upper[i] * p[i + 1]
        q[i] -= upper[i] * q[i + 1]
        r[i] = -upper[i] * r[i + 1]
    return p, q, r


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    a, b, c, y = (table[n].to_pylist() for n in ("a", "b", "c", "y"))
    found = eliminate(a, b, c, y)
    out = table.select(["k", "part"])
    for name, values in zip("pqr", found, strict=True):
        out = out.append_column(name, pa.array(values, pa.float64()))
    yield from out.combine_chunks().to_batches()


def _edges(rows: list) -> dict[int, tuple[float, float]]:
    """Per part the unknowns before its first and behind its last row, from the (p, q, r) of the parts' edges.

    Block elimination over (first, last) of each part: z + L z_before + U z_behind = w.
    """
    n = len(rows)
    w = [np.array([r["first"]["p"], r["last"]["p"]]) for r in rows]
    low = [np.array([[0.0, r["first"]["q"]], [0.0, r["last"]["q"]]]) for r in rows]
    up = [np.array([[r["first"]["r"], 0.0], [r["last"]["r"], 0.0]]) for r in rows]
    for i in range(n):
        pivot = np.eye(2) - (low[i] @ up[i - 1] if i else 0.0)
        right = w[i] - (low[i] @ w[i - 1] if i else 0.0)
        w[i], up[i] = np.linalg.solve(pivot, right), np.linalg.solve(pivot, up[i])
    for i in range(n - 2, -1, -1):
        w[i] = w[i] - up[i] @ w[i + 1]
    return {r["part"]: (float(w[i - 1][1]) if i else 0.0, float(w[i + 1][0]) if i < n - 1 else 0.0) for i, r in enumerate(rows)}


def solve(rows: DataFrame, parts: int = 64) -> DataFrame:
    """(k, x) of the rows (k, a, b, c, y) in the order of k; a of the first and c of the last row don't count.

    Systems that have nothing to do with each other can stand one behind the other,
    with a = 0 and c = 0 where they meet.
    """
    scratch = Scratch(rows.sparkSession, "tridiagonal")
    value = [F.col(c).cast("double").alias(c) for c in "abcy"]
    dealt = rows.select("k", *value).repartitionByRange(parts, "k").sortWithinPartitions("k").withColumn("part", F.spark_partition_id())
    kind = rows.schema["k"].dataType.simpleString()
    local = scratch.write(dealt.mapInArrow(_parts, f"k {kind}, part int, p double, q double, r double"))
    edge = F.struct("p", "q", "r")
    edges = local.groupBy("part").agg(F.min_by(edge, "k").alias("first"), F.max_by(edge, "k").alias("last"))
    beside = _edges([r.asDict(recursive=True) for r in edges.orderBy("part").collect()])
    known = rows.sparkSession.createDataFrame([(p, lo, hi) for p, (lo, hi) in beside.items()], "e_part int, before double, behind double")
    both = local.join(F.broadcast(known), F.col("part") == F.col("e_part"))
    return both.select("k", (F.col("p") - F.col("q") * F.col("before") - F.col("r") * F.col("behind")).alias("x"))


def smoothed(series: DataFrame, strength: float, parts: int = 64) -> DataFrame:
    """(k, x) of a series (k, y): the x with the least sum of (x - y)**2 and ``strength`` times squared steps between neighbours in order."""
    ends = series.agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    both = series.join(F.broadcast(ends))  # one row
    first, last = F.col("k") == F.col("lo"), F.col("k") == F.col("hi")
    s = F.lit(float(strength))
    side = lambda gone: F.when(gone, 0.0).otherwise(-s)
    return solve(both.select("k", side(first).alias("a"), (1 + F.when(first, 0.0).otherwise(s) + F.when(last, 0.0).otherwise(s)).alias("b"), side(last).alias("c"), "y"), parts)


def poisson(source: DataFrame, cells: int, low: float, high: float, left: float = 0.0, right: float = 0.0, parts: int = 64) -> DataFrame:
    """(k, x, e) at the inner nodes k = 1..cells-1 of -x'' = source with x = left and right at the ends; e = -x' in the cell before the node.

    ``source`` (k, y) has values at nodes; one that isn't there is 0.
    """
    h = (high - low) / cells
    nodes = source.sparkSession.range(1, cells).select(F.col("id").alias("k"))
    own = nodes.join(source.select(F.col("k").alias("s_k"), "y"), F.col("k") == F.col("s_k"), "left")
    first, last = F.col("k") == 1, F.col("k") == cells - 1
    edge = F.when(first, left / h).otherwise(0.0) + F.when(last, right / h).otherwise(0.0)
    found = solve(own.select("k", F.when(first, 0.0).otherwise(-1 / h).alias("a"), F.lit(2 / h).alias("b"), F.when(last, 0.0).otherwise(-1 / h).alias("c"), (F.coalesce("y", F.lit(0.0)) * h + edge).alias("y")), parts)
    before = found.select((F.col("k") + 1).alias("b_k"), F.col("x").alias("b_x"))
    both = found.join(before, F.col("k") == F.col("b_k"), "left")
    return both.select("k", "x", ((F.coalesce("b_x", F.lit(float(left))) - F.col("x")) / h).alias("e"))
