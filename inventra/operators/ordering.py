"""Ranks and running figures over rows in order, without a task that has them all.

Rows are dealt to tasks by range of the sort key, so a task has one stretch of the order; it adds up its own rows, and what went
before comes as one row a task (so of a set size, whatever the rows are). A key that holds most rows is many such stretches.
The dealt rows are written to the shared folder and read again: the ranges stay as they are if a task runs again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import shared

_PART_BITS = 33


def _tasks(rows: DataFrame, parts: int | None) -> int:
    return parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stretches(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """The rows dealt and sorted by the order, with _part (the stretch) and _row (place in it, from 0)."""
    dealt = rows.repartitionByRange(_tasks(rows, parts), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return dealt.select(*rows.columns, F.shiftright("_at", _PART_BITS).cast("int").alias("_part"), F.col("_at").bitwiseAND((1 << _PART_BITS) - 1).alias("_row"))


def offsets(placed: DataFrame) -> DataFrame:
    """_part, _before (rows of the stretches before) and _n: a row a stretch."""
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a stretch
    return counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"), "_n")


def ranked(rows: DataFrame, order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds each row's place (from 1) in the order over all rows. Ties take any order: end the order with a key."""
    placed = shared.written(stretches(rows, order, parts), "stretches")
    return placed.join(F.broadcast(offsets(placed)), "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).select(*rows.columns, name)


_KIND, _HEAD, _TAIL = "_kind", 1, 2
_SCAN = (("_run", pa.int64(), T.LongType()), ("_sum", pa.int64(), T.LongType()), ("_most", pa.float64(), T.DoubleType()), ("_moving", pa.int64(), T.LongType()), ("_first", pa.bool_(), T.BooleanType()), (_KIND, pa.int8(), T.ByteType()), ("_last", pa.list_(pa.int64()), T.ArrayType(T.LongType())), ("_stretch", pa.int32(), T.IntegerType()))


def _changes(batch: pa.RecordBatch, keys: list[str], before: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row's keys differ from those of the row before; a null equals a null."""
    changed = np.zeros(batch.num_rows, bool)
    for k in keys:
        column = batch.column(k)
        if before is not None:
            column = pa.concat_arrays([before.column(k), column])
        one, two = column[:-1], column[1:]
        differs = pc.fill_null(pc.not_equal(one, two), False).to_numpy(zero_copy_only=False) | (one.is_null().to_numpy(zero_copy_only=False) != two.is_null().to_numpy(zero_copy_only=False))
        changed[1 if before is None else 0 :] |= differs
    if before is None and len(changed):
        changed[0] = True
    return changed


def _scan(batches: Iterator[pa.RecordBatch], keys: list[str], whole: str, real: str, frame: int) -> Iterator[pa.RecordBatch]:
    """Running figures of each key within the stretch, and a head and a tail row that carry its first and last keys and totals."""
    from pyspark import TaskContext

    stretch, before, first_run, runs_seen = TaskContext.get().partitionId(), None, True, 0
    run, total, most, last = 0, 0, -np.inf, np.zeros(0, np.int64)

    def extra(row: pa.RecordBatch, kind: int, values: list) -> pa.RecordBatch:
        made = [pa.array([v], t) for v, (_, t, _) in zip(values, _SCAN, strict=True)]
        return pa.RecordBatch.from_arrays([*row.columns, *made], [*row.schema.names, *[n for n, _, _ in _SCAN]])

    for batch in batches:
        if not batch.num_rows:
            continue
        if before is None:
            yield extra(batch.slice(0, 1), _HEAD, [0, 0, 0.0, 0, True, _HEAD, [], stretch])
        values = batch.column(whole).fill_null(0).to_numpy()
        reals = batch.column(real).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(_changes(batch, keys, before))
        edges = [0, *starts[starts > 0].tolist(), batch.num_rows]
        fresh = len(starts) > 0 and starts[0] == 0
        out = [np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows), np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, bool)]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            if i or fresh:
                runs_seen += 1
                run, total, most, last = 0, 0, -np.inf, last[:0]
            some = values[a:b]
            sums = total + some.cumsum()
            around = np.concatenate([last, some])
            window = np.concatenate([[0], around.cumsum()])
            end = np.arange(len(last) + 1, len(around) + 1)
            out[0][a:b], out[1][a:b], out[2][a:b] = run + np.arange(b - a), sums, np.maximum(most, np.maximum.accumulate(reals[a:b]))
            out[3][a:b], out[4][a:b] = window[end] - window[np.maximum(end - frame, 0)], runs_seen == 1
            run, total, most, last = run + b - a, int(sums[-1]), out[2][b - 1], around[len(around) - min(frame - 1, len(around)) :]
        before, first_run = batch.slice(batch.num_rows - 1, 1), runs_seen == 1
        n = batch.num_rows
        added = [pa.array(x) for x in out] + [pa.array(np.zeros(n, np.int8)), pa.nulls(n, pa.list_(pa.int64())), pa.array(np.full(n, stretch, np.int32))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *[x for x, _, _ in _SCAN]])
    if before is not None:
        yield extra(before, _TAIL, [run, total, float(most), 0, first_run, _TAIL, last.tolist(), stretch])


def running(rows: DataFrame, keys: list[str], order: list[str], whole: str, real: str, frame: int = 10, parts: int | None = None) -> DataFrame:
    """Adds, for each row in the order within its keys: run_number (from 1), run_sum and frame_sum of a whole column (null: 0), frame_rows, run_most of a number.

    The frame is the row and those before it, `frame` at most. Like a window over the keys, but a key's rows may lie in many tasks. Ties take any order: end the order with a key.
    """
    spark, names = rows.sparkSession, rows.columns
    sorting = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    dealt = rows.repartitionByRange(_tasks(rows, parts), *sorting).sortWithinPartitions(*sorting)
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema.fields], *[T.StructField(n, t) for n, _, t in _SCAN]])
    made = shared.written(dealt.mapInArrow(partial(_scan, keys=keys, whole=whole, real=real, frame=frame), schema), "running")
    # Two rows a stretch: its first keys; its last keys and their totals.
    ends = made.where(F.col(_KIND) > 0).select("_stretch", _KIND, *keys, "_run", "_sum", "_most", "_first", "_last").orderBy("_stretch", _KIND).collect()
    carried, state, state_keys = [], None, None
    for head, tail in zip(ends[::2], ends[1::2], strict=True):
        first, final = ([r[k] for k in keys] for r in (head, tail))
        came = state if state is not None and first == state_keys else (0, 0, float("-inf"), [])
        carried.append((head["_stretch"], *came))
        own = (tail["_run"], tail["_sum"], tail["_most"], list(tail["_last"]))
        state = (came[0] + own[0], came[1] + own[1], max(came[2], own[2]), (came[3] + own[3])[-(frame - 1) :] if frame > 1 else []) if tail["_first"] else own
        state_keys = final
    before = spark.createDataFrame(carried, "_stretch int, _c_run long, _c_sum long, _c_most double, _c_last array<long>")
    joined = made.where(F.col(_KIND) == 0).join(F.broadcast(before), "_stretch")
    carry = lambda c, none: F.when(F.col("_first"), F.col(c)).otherwise(none)
    number = F.col("_run") + carry("_c_run", F.lit(0)) + 1
    lacking = F.when(F.col("_first"), F.least(F.greatest(F.lit(frame - 1) - F.col("_run"), F.lit(0)), F.size("_c_last"))).otherwise(0)
    tail = F.aggregate(F.slice("_c_last", F.size("_c_last") - lacking.cast("int") + 1, F.greatest(lacking.cast("int"), F.lit(0))), F.lit(0).cast("long"), lambda x, v: x + v)
    return joined.select(
        *names, number.alias("run_number"), (F.col("_sum") + carry("_c_sum", F.lit(0))).alias("run_sum"), (F.col("_moving") + F.when(lacking > 0, tail).otherwise(0)).alias("frame_sum"),
        F.least(number, F.lit(frame)).alias("frame_rows"), F.nullif(F.greatest("_most", carry("_c_most", F.lit(float("-inf")))), F.lit(float("-inf"))).alias("run_most"),
    )
