"""A stage with effects outside Spark that keeps what it has paid for.

Each task commits its results as it goes: a Parquet file of some rows, written under a name that readers skip and then moved into place. A run
that breaks off, a task that fails and an executor that is lost so cost only what wasn't committed, at most `commit_rows` results or those
of `commit_seconds`. What has been committed is a table; a later run asks for the rest (`remaining`), and so does a task that runs again: it first reads
which keys its earlier attempt has committed. A step runs inside a plan node of its own, which the optimizer can't copy.
"""

from __future__ import annotations

import dataclasses
import time
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import open_fs

#: From rows (as dicts) to results (as dicts, without the key), one a row, in order.
Step = Callable[[list[dict]], list[dict]]


@dataclasses.dataclass(frozen=True)
class Bounds:
    """Rows that a step is given at once; results, and seconds, after which a task commits."""

    rows: int = 16
    commit_rows: int = 1000
    commit_seconds: float = 30.0


def _place(folder: str, attempt: int) -> str:
    return f"{folder}/results/attempt={attempt}"


def results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All committed results: the schema's columns and attempt."""
    system, path = open_fs(f"{folder}/results")
    system.create_dir(path, recursive=True)
    return spark.read.schema(f"{schema}, attempt int").parquet(f"{folder}/results")


def latest(found: DataFrame, key: str) -> DataFrame:
    """The result of each key's last attempt; of several in one attempt (a task that ran twice at once) the largest."""
    names = [c for c in found.columns if c not in (key, "attempt")]
    return found.groupBy(key).agg(F.max(F.struct("attempt", *names)).alias("_r")).select(key, "_r.*")


def remaining(rows: DataFrame, found: DataFrame, key: str, attempt: int | None = None) -> DataFrame:
    """Rows whose key has no result yet; with an attempt, no result of that attempt or a later one."""
    had = found if attempt is None else found.where(F.col("attempt") >= attempt)
    return rows.join(had.select(key).distinct(), key, "left_anti")


def stop(folder: str) -> None:
    """Asks the run in this folder to end; its tasks commit what they have and take no further rows."""
    system, path = open_fs(f"{folder}/stop")
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path):
        pass


def stopped(folder: str) -> bool:
    system, path = open_fs(f"{folder}/stop")
    return system.get_file_info(path).is_file


def go_on(folder: str) -> None:
    """Takes the wish to stop back."""
    system, path = open_fs(f"{folder}/stop")
    if system.get_file_info(path).is_file:
        system.delete_file(path)


class _Committer:
    """Results of one task on their way to files."""

    def __init__(self, folder: str, attempt: int, schema: pa.Schema, key: str, bounds: Bounds) -> None:
        from pyarrow import fs

        self.system, self.path = open_fs(_place(folder, attempt))
        self.system.create_dir(self.path, recursive=True)
        self.schema, self.bounds, self.held, self.since = schema, bounds, [], time.monotonic()
        self.name = f"part-{TaskContext.get().partitionId():06d}-"
        mine = [f.path for f in self.system.get_file_info(fs.FileSelector(self.path)) if f.base_name.startswith(self.name)]
        self.known = {k for f in mine for k in pq.read_table(self.system.open_input_file(f), columns=[key]).column(key).to_pylist()}

    def add(self, rows: list[dict]) -> None:
        self.held += rows
        if len(self.held) >= self.bounds.commit_rows or time.monotonic() - self.since >= self.bounds.commit_seconds:
            self.commit()

    def commit(self) -> None:
        if self.held:
            name = f"{self.name}{uuid.uuid4().hex}.parquet"
            own, final = f"{self.path}/_{name}", f"{self.path}/{name}"
            with self.system.open_output_stream(own) as out:
                pq.write_table(pa.Table.from_pylist(self.held, self.schema), out)
            self.system.move(own, final)
        self.held, self.since = [], time.monotonic()


def _run(batches: Iterator[pa.RecordBatch], folder: str, attempt: int, key: str, step: Step, schema: pa.Schema, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    task, done = _Committer(folder, attempt, schema, key, bounds), 0

    def portions() -> Iterator[list[dict]]:
        for batch in batches:
            for start in range(0, batch.num_rows, bounds.rows):
                if stopped(folder):
                    return
                if rows := [r for r in batch.slice(start, bounds.rows).to_pylist() if r[key] not in task.known]:
                    yield rows

    try:
        for rows in portions():
            task.add([{key: r[key], **found} for r, found in zip(rows, step(rows), strict=True)])
            done += len(rows)
    finally:
        task.commit()
    yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})


def run(rows: DataFrame, folder: str, key: str, step: Step, schema: str, attempt: int = 0, in_flight: int | None = None, bounds: Bounds = Bounds()) -> int:
    """Runs a step over rows of distinct keys and commits its results; how many this run has made.

    Rows are dealt by key to `in_flight` tasks, so no more than so many steps run at a time in the whole cluster.
    """
    spark = rows.sparkSession
    fields = pa.schema([(f.name, pa.string() if f.dataType.typeName() == "string" else pa.int64()) for f in spark.createDataFrame([], schema).schema])
    dealt = rows.repartition(in_flight or int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    done = dealt.mapInArrow(partial(_run, folder=folder, attempt=attempt, key=key, step=step, schema=fields, bounds=bounds), "n long")
    return done.agg(F.sum("n")).first()[0] or 0
