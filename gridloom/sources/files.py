"""Text and binary readers and writers for scalars, vectors and matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, v) of files with '#' header lines and rows of numbers.

    Each file is one row of text, so its lines keep their order; many files are
    read in parallel. Headers that name another kind than a matrix are refused
    by ``kind_of``.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\n").alias("lines"))
    kept = F.filter("lines", lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    rows = lines.select("file", F.posexplode(kept).alias("row", "line"))
    return rows.select("file", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v")).withColumn("v", F.col("v").cast("double"))


def kind_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, rows, columns) as the headers state them; null where they do not."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    part = lambda key: F.nullif(F.regexp_extract("value", rf"# {key}: *(\S+)", 1), F.lit(""))
    return text.select("file", part("type").alias("kind"), part("rows").cast("int").alias("rows"), part("columns").cast("int").alias("columns"))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, v) of vectors that stand in one row or one column."""
    return read_matrix(spark, path).select("file", F.greatest("row", "col").alias("i"), "v")


def read_scalar(spark: SparkSession, path: str) -> DataFrame:
    """(file, v); a file of another kind is an error."""
    kinds = kind_of(spark, path)
    checked = kinds.select("file", F.when(F.col("kind") == "scalar", True).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(" holds no scalar")))).alias("good"))
    return read_matrix(spark, path).join(checked, "file").where("good").select("file", "v")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, v) of raw little-endian doubles."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["path"], part["content"], strict=True):
                v = np.frombuffer(content, "<f8")
                for low in range(0, len(v), 65536):
                    yield pd.DataFrame({"file": file, "i": np.arange(low, min(low + 65536, len(v))), "v": v[low : low + 65536]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, i long, v double")


def number(v):
    """Up to 12 significant digits; zeros go from the end of the mantissa only."""
    long = F.format_string("%.12g", v)
    short = F.regexp_replace(F.regexp_replace(long, r"(\.[0-9]*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when(long.contains("."), short).otherwise(long)


def dump_rows(matrix: DataFrame, path: str) -> None:
    """One text line per matrix row, numbers apart by blanks with 12 digits."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "v"))), lambda x: number(x["v"])), " ")
    matrix.groupBy("row").agg(line.alias("value")).orderBy("row").select("value").write.text(path)


def dump_vector(vector: DataFrame, path: str) -> None:
    """One line with all numbers of a vector (i, v)."""
    dump_rows(vector.select(F.lit(0).alias("row"), F.col("i").alias("col"), "v"), path)
