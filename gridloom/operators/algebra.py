"""Vectors (i, v) and matrices (row, col, v) in long form, optionally by groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nrm2(v: Column) -> Column:
    return F.sqrt(F.sum(v * v))


def nrminf(v: Column) -> Column:
    return F.max(F.abs(v))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(F.avg((a - b) * (a - b)))


def dot(x: DataFrame, y: DataFrame, by: list[str]) -> DataFrame:
    """Inner products of x's groups with y (i, v)."""
    other = y.select(F.col("i").alias("y_i"), F.col("v").alias("y_v"))
    return x.join(other, F.col("i") == F.col("y_i")).groupBy(*by).agg(F.sum(F.col("v") * F.col("y_v")).alias("v"))


def gemv(a: DataFrame, x: DataFrame, y: DataFrame | None = None, alpha: float = 1.0, beta: float = 0.0) -> DataFrame:
    """(i, v) = alpha A x + beta y; rows without entries have 0 (if y has them)."""
    factor = x.select(F.col("i").alias("x_i"), F.col("v").alias("x_v"))
    out = a.join(factor, F.col("col") == F.col("x_i")).groupBy(F.col("row").alias("i")).agg((F.sum(F.col("v") * F.col("x_v")) * alpha).alias("v"))
    return out if y is None else axpy(out, y.withColumn("v", F.col("v") * beta))


def gemm(a: DataFrame, b: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(row, col, v) = alpha A B."""
    right = b.select(F.col("row").alias("b_row"), F.col("col").alias("b_col"), F.col("v").alias("b_v"))
    joined = a.join(right, F.col("col") == F.col("b_row"))
    return joined.groupBy("row", F.col("b_col").alias("col")).agg((F.sum(F.col("v") * F.col("b_v")) * alpha).alias("v"))


def axpy(x: DataFrame, y: DataFrame, alpha: float = 1.0) -> DataFrame:
    """alpha x + y by a sum over both, which is combined before the shuffle."""
    return x.select("i", (F.col("v") * alpha).alias("v")).unionByName(y.select("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")


def reshape(a: DataFrame, rows: int, new_rows: int) -> DataFrame:
    """The same column-major sequence with another number of rows."""
    k = F.col("col") * rows + F.col("row")
    return a.select((k % new_rows).alias("row"), F.floor(k / new_rows).alias("col"), "v")


def submatrix(a: DataFrame, row: int, col: int, rows: int, cols: int) -> DataFrame:
    inside = a.where(F.col("row").between(row, row + rows - 1) & F.col("col").between(col, col + cols - 1))
    return inside.select((F.col("row") - row).alias("row"), (F.col("col") - col).alias("col"), "v")


def set_submatrix(a: DataFrame, row: int, col: int, block: DataFrame) -> DataFrame:
    new = block.select((F.col("row") + row).alias("n_row"), (F.col("col") + col).alias("n_col"), F.col("v").alias("n_v"))
    joined = a.join(new, (F.col("row") == F.col("n_row")) & (F.col("col") == F.col("n_col")), "left")
    return joined.select("row", "col", F.coalesce("n_v", "v").alias("v"))


def horizontal(a: DataFrame, cols: int, b: DataFrame) -> DataFrame:
    return a.select("row", "col", "v").unionByName(b.select("row", (F.col("col") + cols).alias("col"), "v"))


def kron(a: DataFrame, b: DataFrame, b_rows: int, b_cols: int) -> DataFrame:
    """Kronecker product: every entry of A with every one of the small B, which is exploded from one row."""
    small = b.agg(F.collect_list(F.struct("row", "col", "v")).alias("block"))
    both = a.join(F.broadcast(small)).withColumn("e", F.explode("block"))
    return both.select((F.col("row") * b_rows + F.col("e.row")).alias("row"), (F.col("col") * b_cols + F.col("e.col")).alias("col"), (F.col("v") * F.col("e.v")).alias("v"))


def batched_gemm(a: DataFrame, b: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(batch, row, col, v) = alpha A B of each batch: one equi-join on batch and inner index for all the small products."""
    right = b.select(F.col("batch").alias("b_batch"), F.col("row").alias("b_row"), F.col("col").alias("b_col"), F.col("v").alias("b_v"))
    joined = a.join(right, (F.col("batch") == F.col("b_batch")) & (F.col("col") == F.col("b_row")))
    return joined.groupBy("batch", "row", F.col("b_col").alias("col")).agg((F.sum(F.col("v") * F.col("b_v")) * alpha).alias("v"))


def batched_chain(matrices: list[DataFrame], x: DataFrame) -> DataFrame:
    """(batch, i, v): matrices (batch, row, col, v) applied to the vectors (batch, i, v) of their batch, the last one first."""
    for m in reversed(matrices):
        vector = x.select(F.col("batch").alias("x_batch"), F.col("i").alias("x_i"), F.col("v").alias("x_v"))
        joined = m.join(vector, (F.col("batch") == F.col("x_batch")) & (F.col("col") == F.col("x_i")))
        x = joined.groupBy("batch", F.col("row").alias("i")).agg(F.sum(F.col("v") * F.col("x_v")).alias("v"))
    return x
