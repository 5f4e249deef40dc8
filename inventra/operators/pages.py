"""Deep pages: a table in the order of its pages, with an index, so that a page reads one or two files.

`build` writes the rows dealt by range of the order, a folder a stretch, and an index of a row a stretch: rows before it, its rows, its first row's
sort key. A page, a place or a cursor is then found in the index (as many rows as there are stretches), and only the stretches that it
names are read; within a file, the place in the stretch is a sorted column, so row groups are skipped as well.
"""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import shared
from . import ordering


@dataclasses.dataclass(frozen=True)
class Pages:
    """Rows in order below a folder; the index by stretch: (stretch, rows before, rows)."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    index: tuple[tuple[int, int, int], ...]

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows")

    def __len__(self) -> int:
        return sum(n for _, _, n in self.index)

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """Rows offset to offset + limit in order, with row_number (from 1)."""
        met = [(part, before) for part, before, n in self.index if before < offset + limit and before + n > offset]
        wanted = F.lit(False)
        for part, before in met:
            wanted |= (F.col("_part") == part) & F.col("_row").between(offset - before, offset + limit - 1 - before)
        before = F.lit(0).cast("long")
        for part, rows in met:
            before = F.when(F.col("_part") == part, F.lit(rows)).otherwise(before)
        found = self.rows.where(wanted).withColumn("row_number", (before + F.col("_row") + 1).cast("long"))
        return found.drop("_part", "_row")

    def place(self, row: Column) -> DataFrame:
        """The row_number of the rows that meet a condition, by the stretches whose statistics allow it."""
        dealt = self.spark.createDataFrame(list(self.index), "_part int, _before long, _n long")
        return self.rows.where(row).join(F.broadcast(dealt), "_part").withColumn("row_number", F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before", "_n")


def build(rows: DataFrame, order: list[Column], folder: str, parts: int | None = None) -> Pages:
    """Writes rows and index. End the order with a key, since ties take any order."""
    spark = rows.sparkSession
    placed = ordering.stretches(rows, order, parts)
    placed.write.partitionBy("_part").parquet(f"{folder}/rows")
    system, path = shared.open_fs(f"{folder}/schema.json")
    with system.open_output_stream(path) as out:
        out.write(placed.schema.json().encode())
    ordering.offsets(spark.read.schema(placed.schema).parquet(f"{folder}/rows").select("_part")).coalesce(1).write.parquet(f"{folder}/index")
    return opened(spark, folder)


def opened(spark: SparkSession, folder: str) -> Pages:
    """Pages that have been built before."""
    system, path = shared.open_fs(f"{folder}/schema.json")
    with system.open_input_stream(path) as f:
        schema = T.StructType.fromJson(json.loads(f.read()))
    index = spark.read.schema("_part int, _before long, _n long").parquet(f"{folder}/index").orderBy("_part").collect()  # a row a stretch
    return Pages(spark, folder, schema, tuple((r[0], r[1], r[2]) for r in index))
