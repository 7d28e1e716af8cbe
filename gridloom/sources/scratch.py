"""Tables of a run in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it isn't set, a local folder for a local session, and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Intermediate tables of an iterative operator: writing one cuts its lineage, and a lost executor costs a read.

    What a lazy result reads stays until the program ends; ``drop`` deletes the rest.
    """

    open: dict[str, SparkSession] = {}

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.count = spark, 0
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        Scratch.open[self.base] = self.spark
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if (found := self.paths.pop(id(table), None)) is not None:
                _delete(self.spark, found[1])


@atexit.register
def _at_exit() -> None:
    for base, spark in list(Scratch.open.items()):
        try:
            _delete(spark, base)
        except Exception:  # the session may be gone before its tables
            pass
    Scratch.open.clear()
