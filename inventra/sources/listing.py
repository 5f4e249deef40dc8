"""Files of a folder tree with their metadata, as rows; directories are dealt to tasks, level by level."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from . import shared

_ENTRIES = "path string, directory boolean, size long, modified string, created string, owner string, error string"


def _local(system) -> bool:
    from pyarrow import fs

    return isinstance(system, fs.LocalFileSystem)


def _more(path: str) -> tuple[str | None, str | None]:
    """Creation (or the last change of the entry) and owner, where the file system is the machine's own."""
    import os
    import pwd

    found = os.lstat(path)
    try:
        owner = pwd.getpwuid(found.st_uid).pw_name
    except KeyError:
        owner = str(found.st_uid)
    return datetime.datetime.fromtimestamp(found.st_ctime, datetime.UTC).strftime("%Y-%m-%d %H:%M:%S"), owner


def _entries(batches: Iterator[pa.RecordBatch], prefix: str) -> Iterator[pa.RecordBatch]:
    """The entries of each directory; one that can't be read is an entry with an error. Links aren't followed."""
    import os

    from pyarrow import fs

    schema = pa.schema([("path", pa.string()), ("directory", pa.bool_()), ("size", pa.int64()), ("modified", pa.string()), ("created", pa.string()), ("owner", pa.string()), ("error", pa.string())])
    for batch in batches:
        for directory in batch.column("path").to_pylist():
            system, where = shared.open_fs(prefix + directory)
            rows = []
            try:
                for info in system.get_file_info(fs.FileSelector(where)):
                    if _local(system) and os.path.islink(info.path):
                        continue
                    folder = info.type == fs.FileType.Directory
                    when = info.mtime.astimezone(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S") if info.mtime else None
                    rows.append((info.path, folder, None if folder else info.size, when, *(_more(info.path) if _local(system) else (None, None)), None))
            except OSError as e:
                rows.append((directory, False, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def walk(spark: SparkSession, root: str, parts: int | None = None) -> DataFrame:
    """path, size, modified, created, owner, error of every file below a folder that the executors see."""
    prefix = f"{root.split('://')[0]}://" if "://" in root else ""
    level = spark.createDataFrame([(root[len(prefix) :].rstrip("/") or "/",)], "path string")
    found, tasks = [], parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:  # as often as the tree is deep
        entries = shared.written(level.repartition(tasks, "path").mapInArrow(partial(_entries, prefix=prefix), _ENTRIES), "listing")
        found.append(entries.where("not directory").drop("directory"))
        level = entries.where("directory").select("path")
        if level.isEmpty():
            break
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def files(spark: SparkSession, root: str, parts: int | None = None) -> DataFrame:
    """The tree's files as rows of the inventory: what a walk knows of a file, nothing else; unreadable entries are left to `walk`."""
    rows = walk(spark, root, parts).where("error is null")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.when(F.substring(name, 2, 1 << 20).contains("."), F.element_at(F.split(name, r"\."), -1)).otherwise("")
    return rows.select(
        name.alias("name"), "path", extension(suffix).alias("extension"), F.col("size").alias("file_size"), "owner", F.col("created").alias("creation_time"), F.col("modified").alias("last_modified"),
        F.when(name.startswith("."), "Hidden").otherwise("Normal").alias("file_attributes"), F.lit("pending").alias("status"),
    )
