"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: blank and the ASCII control white space.
SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where none is set, a local one for a local session; elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of a batch that goes to or comes from a Python worker; the engine's own bound is 64 MB for each of several buffers.
ARROW_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Sees to it that batches for Python workers hold ``ARROW_BYTES`` at most, whatever the length of texts (one row at least)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= ARROW_BYTES:
        spark.conf.set(name, f"{ARROW_BYTES}b")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Whether a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stage:
    """Intermediate tables written to the shared folder, which cuts their lineage.

    A lost executor then costs a read of the written files and never the work
    before them. ``drop`` deletes a table that nothing reads any more, ``keep``
    all others. What a lazy result still reads goes when the program ends.
    """

    #: Folders that hold tables, with their sessions.
    open: dict[str, SparkSession] = {}

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, once: bool = False) -> DataFrame:
        """The table of ``df``; with ``once`` the shuffle files of its making go when it is written, as nothing else is made from them."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        Stage.open[self.base] = self.spark
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true" if once else before)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        if (found := self.paths.pop(id(df), None)) is not None:
            _delete(self.spark, found[1])

    def keep(self, *tables: DataFrame | None) -> None:
        for df, _ in list(self.paths.values()):
            if not any(df is t for t in tables):
                self.drop(df)

    @staticmethod
    def close_all() -> None:
        """Deletes every table that is left; results that read one can't be computed again after this."""
        for base, spark in list(Stage.open.items()):
            del Stage.open[base]
            if spark.sparkContext._jsc is not None:
                _delete(spark, base)


@atexit.register
def _at_exit() -> None:
    try:
        Stage.close_all()
    except Exception:  # the session may be gone before its tables
        Stage.open.clear()


#: Keys that are joined by broadcast at most.
HEAVY = 10_000


def skewed_join(left: DataFrame, right: DataFrame, on: tuple[str, str], rows: str, total: int) -> DataFrame:
    """``left`` joined to ``right``, which has one row for each key and in ``rows`` how many of left's rows have it.

    A key with more than a ``HEAVY``-th of all ``total`` rows goes to every task:
    there are ``HEAVY`` of them at most. So no key's rows meet in one task. Both
    sides are read twice and should be written tables.
    """
    named, key = [c for c in right.columns if c not in (on[1], rows)], F.col(on[0])
    large = F.col(rows) * HEAVY > total
    heavy, light = (right.where(w).select(F.col(on[1]).alias("j_key"), *named) for w in (large, ~large))
    told = left.join(F.broadcast(heavy), key == F.col("j_key")).drop("j_key")
    few = left.join(F.broadcast(heavy.select("j_key")), key == F.col("j_key"), "left_anti")
    return told.unionByName(few.join(light, key == F.col("j_key")).drop("j_key"))


def lower_ascii(text):
    return F.translate(text, UPPER, LOWER)


def columns_of(df: DataFrame, *names: str) -> list:
    """The named columns by position, so that a clash of names elsewhere does no harm."""
    return [df[n] for n in names]
