"""Snapshots as a data source: ``spark.read.format("gridloom")`` and ``df.write.format("gridloom")``.

Rows are (run, step, pos, lev, cell, seg): the elements of a run's state after a step. Each task writes
Parquet files of its own, which nothing reads until the write commits. A commit is one
file, a manifest that names the new files and the (run, step) that they replace, so
that a reader sees a write as a whole or not at all; an aborted one deletes its files.
A scan plans one partition for each file of the latest manifest of each (run, step);
filters on run and step are pushed into that planning, so other files are never opened.

Options: ``path``. Mode overwrite replaces the (run, step) that the rows have and leaves
others alone; mode append is an error where a (run, step) is already there.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "run string, step int, pos long, lev array<int>, cell array<int>, seg array<double>"
_ARROW = pa.schema([("run", pa.string()), ("step", pa.int32()), ("pos", pa.int64()), ("lev", pa.list_(pa.int32())), ("cell", pa.list_(pa.int32())), ("seg", pa.list_(pa.float64()))])
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _folder(run: str, step: int) -> str:
    return f"run={quote(run, safe='')}/step={step}"


def committed(path: str) -> dict[tuple[str, int], list[str]]:
    """The files of each (run, step), by the latest manifest that names it."""
    store, base = _store(path)
    found: dict[tuple[str, int], list[str]] = {}
    names = [f.path for f in store.get_file_info(fs.FileSelector(f"{base}/_commits", allow_not_found=True)) if f.path.endswith(".json")]
    for name in sorted(names):
        with store.open_input_stream(name) as f:
            for key, files in json.loads(f.read()).items():
                run, step = key.split("/")
                found[unquote(run.removeprefix("run=")), int(step.removeprefix("step="))] = files
    return found


@dataclass
class Piece(InputPartition):
    file: str


class SnapshotReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.kept = path, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("run",), ("step",)) and f.value is not None:
                self.kept.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Piece]:
        good = lambda run, step: all(_TESTS[kind]({"run": run, "step": step}[name], value) for name, kind, value in self.kept)
        return [Piece(f) for (run, step), files in sorted(committed(self.path).items()) if good(run, step) for f in files] or [Piece("")]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, base = _store(self.path)
        with store.open_input_file(f"{base}/{partition.file}") as f:
            for batch in pq.ParquetFile(f).iter_batches():
                yield batch.cast(_ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: dict


class SnapshotWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = _store(self.path)
        files, open_, attempt = defaultdict(list), {}, uuid.uuid4().hex
        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch]).cast(_ARROW)
                keys = sorted(set(zip(table["run"].to_pylist(), table["step"].to_pylist(), strict=True)), key=str)
                for run, step in keys:
                    if run is None or step is None:
                        raise ValueError("a snapshot needs a run and a step")
                    if (run, step) not in open_:
                        name = f"{_folder(run, step)}/{self.job}-{attempt}.parquet"
                        store.create_dir(f"{base}/{_folder(run, step)}", recursive=True)
                        open_[run, step] = pq.ParquetWriter(f"{base}/{name}", _ARROW, filesystem=store)
                        files[_folder(run, step)].append(name)
                    open_[run, step].write_table(table.filter((pa.compute.field("run") == run) & (pa.compute.field("step") == step)))
        except BaseException:
            for w in open_.values():
                w.close()
            for names in files.values():
                for name in names:
                    store.delete_file(f"{base}/{name}")
            raise
        for w in open_.values():
            w.close()
        return Written(dict(files))

    def commit(self, messages: list[Written | None]) -> None:
        every = defaultdict(list)
        for m in messages:
            for key, names in (m.files if m else {}).items():
                every[key] += names
        store, base = _store(self.path)
        if not self.overwrite and (again := {_folder(*k) for k in committed(self.path)} & set(every)):
            self.abort(messages)
            raise ValueError(f"already there: {sorted(again)[0]}")
        if every:
            store.create_dir(f"{base}/_commits", recursive=True)
            with store.open_output_stream(f"{base}/_commits/{self.job}.tmp") as f:
                f.write(json.dumps(every).encode())
            store.move(f"{base}/_commits/{self.job}.tmp", f"{base}/_commits/{time.time_ns():020d}-{self.job}.json")

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        for m in messages:
            for names in (m.files if m else {}).values():
                for name in names:
                    store.delete_file(f"{base}/{name}")


class Snapshots(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> SnapshotWriter:
        return SnapshotWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Snapshots)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
