"""Tables that grow and change in place: hash-partitioned folders of which a change rewrites only the partitions that it touches.

A table lies in partitions by the hash of its key (BUCKETS; more for large tables, so that a change rewrites little). New rows are appended if their key isn't there; updates and replacements read and rewrite the touched
partitions alone (dynamic partition overwrite), from a copy in the shared folder, so that nothing is overwritten while it is read. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

BUCKETS = 16
#: Most bytes of keys that are sent to all tasks; more are met by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bits of an id: number of the append, partition of the write, row in it.
_APPENDS, _PARTS, _ROWS = 15, 20, 28


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def exists(path: str) -> bool:
    """Whether the table has been written to."""
    from pyarrow import fs

    system, where = shared.open_fs(path)
    found = system.get_file_info(fs.FileSelector(where, allow_not_found=True))
    return any(f.base_name.startswith("bucket=") for f in found)


def _appends(path: str) -> tuple[int, Callable[[], None]]:
    """The number of the next append, and what notes that it has been made."""
    from pyarrow import fs

    system, where = shared.open_fs(f"{path}/_appends")
    number = max((int(f.base_name.split("-")[0]) + 1 for f in system.get_file_info(fs.FileSelector(where, allow_not_found=True))), default=0)

    def note() -> None:
        system.create_dir(where, recursive=True)
        with system.open_output_stream(f"{where}/{number}-{uuid.uuid4().hex}"):
            pass

    return number, note


def ids(number: int) -> Column:
    """Ids that no other row of the table has: the append's number, the write's partition, and the row in it. Too many of any is an error."""
    if number >= 1 << _APPENDS:
        raise ValueError("too many appends: compact the table")
    at = F.monotonically_increasing_id()
    part, row = F.shiftright(at, 33), at.bitwiseAND((1 << 33) - 1)
    fits = (part < 1 << _PARTS) & (row < 1 << _ROWS)
    return F.when(fits, F.lit(number << (_PARTS + _ROWS)) + F.shiftleft(part, _ROWS) + row).otherwise(F.raise_error(F.lit("too many rows in a partition")).cast("long"))


def among(held: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The keys that a table's rows hold; the table isn't shuffled if the keys are few."""
    size = keys.agg(F.sum(F.octet_length(F.col(key).cast("string")) + 16)).first()[0] or 0
    return held.select(key).join(F.broadcast(keys.select(key)) if size <= BROADCAST_BYTES else keys.select(key), key, "left_semi").distinct()


def touched(rows: DataFrame) -> list[int]:
    """The partitions that rows lie in: at most as many as there are."""
    return [r[0] for r in rows.select("bucket").distinct().collect()]


def append_new(rows: DataFrame, path: str, key: str, number_column: str = "id", buckets: int = BUCKETS, observe: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Appends rows of distinct keys that the table doesn't hold yet, with ids. Only the partitions that could hold them are read, and of these only the key."""
    spark = rows.sparkSession
    rows = rows.withColumn("bucket", bucket(F.col(key), buckets))
    if exists(path):
        rows = shared.written(rows, "arriving")
        held = spark.read.parquet(path).where(F.col("bucket").isin(touched(rows)))
        rows = rows.join(among(held, rows, key), key, "left_anti")
    number, note = _appends(path)
    # Rebalancing by partition lets adaptive execution join small ones and split large ones.
    dealt = observe(rows).hint("rebalance", "bucket").withColumn(number_column, ids(number))
    dealt.write.mode("append").partitionBy("bucket").parquet(path)
    note()


def rewrite(spark: SparkSession, path: str, partitions: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
    """Puts change(rows of the partitions) in the place of these partitions; the others' files stay as they are. A partition whose rows all go is left empty."""
    if not partitions:
        return
    old = spark.read.parquet(path)
    changed = shared.written(change(old.where(F.col("bucket").isin(partitions))), "changed")
    _checked(changed, partitions)
    changed.select(*old.columns).hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for gone in set(partitions) - set(touched(changed)):
        system, where = shared.open_fs(f"{path}/bucket={gone}")
        system.delete_dir(where)


def _checked(changed: DataFrame, partitions: list[int]) -> None:
    if not changed.where(~F.col("bucket").isin(partitions)).isEmpty():
        raise ValueError("a change must keep its rows in their partitions")


def create(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """A table of the rows as they are."""
    rows.withColumn("bucket", bucket(F.col(key), buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def update(spark: SparkSession, path: str, updates: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], key: str = "id") -> int:
    """Applies updates by a key that needn't be the table's own; how many partitions were rewritten. To find them, only the key is read."""
    updates = shared.written(updates, "updates")
    held = spark.read.parquet(path).select(key, "bucket")
    size = updates.count() * 16
    met = held.join(F.broadcast(updates.select(key)) if size <= BROADCAST_BYTES else updates.select(key), key, "left_semi")
    partitions = touched(met)
    rewrite(spark, path, partitions, lambda rows: change(rows, updates))
    return len(partitions)


def replace(spark: SparkSession, path: str, rows: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> int:
    """Merges rows into the table by its own key (merge: held and new rows to what is held then); how many partitions were rewritten."""
    new = shared.written(rows.withColumn("bucket", bucket(F.col(key), buckets)), "arriving")
    partitions = touched(new)
    rewrite(spark, path, partitions, lambda held: merge(held, new).withColumn("bucket", bucket(F.col(key), buckets)))
    return len(partitions)
