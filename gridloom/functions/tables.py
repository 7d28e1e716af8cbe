"""Table functions for SQL, in Arrow batches.

``multiwave_sums(TABLE(q), degree, levels)``: q has a key and a place x in [0, 1); gives
(key, i, digit, v), the sums of the wavelet functions over the rows that one task has seen. A task
sums before anything is shuffled; GROUP BY key, i, digit with sum(v) completes it, so that no
key's rows need one place.

``problem_values(TABLE(q), problem, time)``: q has a key and a point x1, x2, ...; gives (key, initial, exact), the
initial and the exact solution of a problem of the catalogue there, where it has one.

Arrow table functions have a fixed result type: keys are strings in the first and long in the second. Constants out of
range and unknown problems are errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from gridloom.dg.basis import two_scale
from gridloom.dg.problems import BUILDERS, problem


def wave_values(x: np.ndarray, level: int, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the functions of a level at each x, and their values, a row per x."""
    def phi(u):
        return np.polynomial.legendre.legvander(2 * u - 1, degree - 1) * np.sqrt(2.0 * np.arange(degree) + 1)

    if level == 0:
        return np.zeros(len(x), np.int64), phi(x)
    _, _, g0, g1 = two_scale(degree)
    at = x * 2.0 ** (level - 1)
    cell = np.floor(at)
    t = at - cell
    right = t >= 0.5
    parts = phi(2 * t - right)
    return cell.astype(np.int64) + (1 << (level - 1)), 2.0 ** (level / 2) * np.where(right[:, None], parts @ g1.T, parts @ g0.T)


@arrow_udtf(returnType="key string, i long, digit int, v double")
class MultiwaveSums:
    def __init__(self):
        self.degree, self.sums = 1, {}

    def eval(self, batch: pa.RecordBatch, degree: pa.Array, levels: pa.Array) -> Iterator[pa.Table]:
        if not batch.num_rows:
            return
        self.degree, most = int(degree[0].as_py()), int(levels[0].as_py())
        if not 1 <= self.degree <= 6 or not 0 <= most <= 20:
            raise ValueError("degree must be 1 to 6 and levels 0 to 20")
        x = batch.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False)
        good = np.flatnonzero((x >= 0) & (x < 1))
        names = batch.column(0).cast(pa.string()).take(pa.array(good)).dictionary_encode()
        codes, keys = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False), [*names.dictionary.to_pylist(), None]
        for level in range(most + 1):
            index, values = wave_values(x[good], level, self.degree)
            pairs, at = np.unique(np.stack([codes, index]), axis=1, return_inverse=True)
            sums = np.zeros((pairs.shape[1], self.degree))
            np.add.at(sums, at.ravel(), values)
            for (c, i), v in zip(pairs.T.tolist(), sums, strict=True):
                self.sums[keys[c], i] = self.sums.get((keys[c], i), 0.0) + v
        yield from ()

    def terminate(self) -> Iterator[pa.Table]:
        if not self.sums:
            return
        keys = [k for k, _ in self.sums for _ in range(self.degree)]
        index = [i for _, i in self.sums for _ in range(self.degree)]
        digits = list(range(self.degree)) * len(self.sums)
        yield pa.table({"key": pa.array(keys, pa.string()), "i": pa.array(index, pa.int64()), "digit": pa.array(digits, pa.int32()), "v": pa.array(np.concatenate(list(self.sums.values())))})


@arrow_udtf(returnType="key long, initial double, exact double")
class ProblemValues:
    def eval(self, batch: pa.RecordBatch, name: pa.Array, time: pa.Array) -> Iterator[pa.Table]:
        if not batch.num_rows:
            return
        called, at = name[0].as_py(), float(time[0].as_py())
        if called not in BUILDERS:
            raise ValueError(f"no problem is called {called}")
        p = problem(called)
        d = len(p.dims)
        x = [batch.column(1 + k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(d)]
        product = lambda fs, t: np.prod([np.asarray(f(v, t), float) * np.ones(len(v)) for f, v in zip(fs, x, strict=True)], axis=0)
        initial = sum(product(fs, 0.0) for fs in p.initial) * (p.exact_time(0.0) if p.exact_time is not None else 1.0)
        exact = product(p.exact, at) * p.exact_time(at) if p.exact is not None and p.exact_time is not None else np.full(len(initial), np.nan)
        yield pa.table({"key": batch.column(0).cast(pa.int64()), "initial": pa.array(initial, from_pandas=True), "exact": pa.array(exact, from_pandas=True)})


def register(spark: SparkSession) -> None:
    spark.udtf.register("multiwave_sums", MultiwaveSums)
    spark.udtf.register("problem_values", ProblemValues)
