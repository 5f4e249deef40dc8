"""What the operators share: tables, the shared folder, files in it."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame) -> DataFrame:
    """Only doc_id (long) and text (null: empty), whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only in local mode without one (tests), one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    if "://" not in root:  # a path without a scheme is one of the cluster's default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        root = root.replace("file:/", "file:///", 1) if not root.startswith("file://") and root.startswith("file:/") else root
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Arrow's names of the types that `few` knows.
_ARROW = {"long": "int64", "int": "int32", "double": "float64", "boolean": "bool", "string": "string"}


def few(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of plain values, sent as an Arrow table: a list of tuples would start Python workers of its own on every executor, which stay beside the operators'."""
    import pyarrow as pa

    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    table = pa.table({n: pa.array(c, _ARROW[k]) for n, k, c in zip(names, kinds, columns, strict=True)})
    return spark.createDataFrame(table) if rows else spark.range(0).select(*[F.lit(None).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)])


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of the shared folder that go when the work that needs them is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folders = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for folder in list(self.folders.values()):
            delete(self.spark, folder)
        self.folders.clear()

    def folder(self, name: str) -> str:
        return self.folders.setdefault(path := shared_folder(self.spark, name), path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """As the function of that name; the table is deleted with the others."""
        path = self.folder(name)
        df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.folders[id(made)] = self.folders.pop(path)
        self._frames = [*getattr(self, "_frames", []), made]
        return made

    def dropped(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in frames:
            if folder := self.folders.pop(id(df), None):
                delete(self.spark, folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_fs(uri: str):
    """A pyarrow file system and the path in it; works for every store that pyarrow knows, from executors and the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_file(uri: str, data: bytes) -> None:
    """Writes under a name of its own and then moves, so that a task tried again leaves one whole file."""
    system, path = open_fs(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, path)


def read_file(uri: str) -> bytes:
    system, path = open_fs(uri)
    with system.open_input_file(path) as f:
        return f.read()


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; for numbers a sort is faster than numpy's own way."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values and how often each occurs."""
    ordered = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def pick(hashed: Column, parts: int) -> Column:
    """A number from 0 to parts - 1 by a hash."""
    return F.pmod(hashed, F.lit(parts)).cast("int")


#: Most bytes of a side that is broadcast, and what a row of a few numbers takes there; larger sides are joined by a shuffle.
BROADCAST_BYTES, BROADCAST_ROW = 32 << 20, 64


def bounded(side: DataFrame) -> DataFrame:
    """A side of a few numbers a row, marked for broadcast only if its counted rows are within the bound."""
    return F.broadcast(side) if side.count() * BROADCAST_ROW <= BROADCAST_BYTES else side


def restricted(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """left_semi or left_anti join on doc_id, by broadcast only if the ids are few."""
    return rows.join(bounded(ids.select("doc_id")), "doc_id", how)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the rows don't have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"{name}{'_' * k}" for k in range(len(taken) + 1)) if n.lower() not in taken)


#: Rows of an Arrow batch between Spark and a Python worker, unless the session sets another number; texts can be long.
BATCH_ROWS = 1000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _tidied(batches, step):
    """Runs a step and then gives freed memory back, since a worker stays for later tasks."""
    import pyarrow as pa

    yield from step(batches)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


@contextlib.contextmanager
def batch_rows(spark: SparkSession, most: int):
    """For jobs that run in this context: fewer rows a batch, for rows that hold whole arrays. A batch lies outside of the JVM's heap, and what was once taken there stays."""
    before = spark.conf.get(_ROWS_KEY, "10000")
    spark.conf.set(_ROWS_KEY, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_KEY, before)


def in_batches(rows: DataFrame, step, schema: str) -> DataFrame:
    """mapInArrow with bounded batches. The session's own number, if it has set one, stays."""
    conf = rows.sparkSession.conf
    if conf.get(_ROWS_KEY, "10000") == "10000":
        conf.set(_ROWS_KEY, str(BATCH_ROWS))
    return rows.mapInArrow(partial(_tidied, step=step), schema)
