"""Connected components of an edge table, by rounds of large and small stars in DataFrames.

Each task first replaces its own edges by a forest of stars, at most LOCAL_EDGES of them in memory, so that many
links between the same documents shrink before any shuffle. The least neighbour of every node is written before it is joined
to the edges, so both sides of that join are plain exchanges and adaptive execution can split a node with very many edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LOCAL_EDGES = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges' components as (node, least node), without the least nodes themselves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while not np.array_equal(further := label[label], label):
            label = further
    inner = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[inner], nodes[label[inner]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = lambda u, v: pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
    us, vs, n = [], [], 0
    for batch in batches:
        us.append(batch.column("u").to_numpy())
        vs.append(batch.column("v").to_numpy())
        n += len(batch)
        if n >= LOCAL_EDGES:
            u, v = stars(np.concatenate(us), np.concatenate(vs))
            us, vs, n = [u], [v], len(u)
            if n > LOCAL_EDGES // 2:
                yield made(u, v)
                us, vs, n = [], [], 0
    if n:
        yield made(*stars(np.concatenate(us), np.concatenate(vs)))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> DataFrame:
    """For each node u of (u, v): the least of its neighbours and itself. Counted in part before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, scratch: common.Scratch) -> DataFrame:
    """node, component (the least node that can be reached) of every node of the edges (u, v); a table of the scratch."""
    local = common.in_batches(edges.where("u <> v").select("u", "v"), _contract, "u long, v long")
    edges, seen = scratch.written(_distinct(local), "edges"), None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        both = _both(edges)
        least = scratch.written(_least(both), "least")
        large = scratch.written(_distinct(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "edges")
        down = scratch.written(_least(large), "least")
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        after = scratch.written(_distinct(small), "edges")
        scratch.dropped(edges, least, large, down)
        edges = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = scratch.written(nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    scratch.dropped(edges)
    return found
