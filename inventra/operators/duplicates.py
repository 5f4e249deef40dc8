"""Duplicate families: a family is more than one file of one (hash, size).

Families are aggregated on the pair, partially before the shuffle. Row-level results come from joining the
family table back, not from windows over a family, so one family of any size is split by skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DUPLICATE_LEVELS, MB
from ..functions import dates
from ..functions.text import literal_rows, share
from .rules import has_hash, ignore_reason

KEY = ["fast_hash", "file_size"]


def eligible(files: DataFrame) -> DataFrame:
    return files.where((ignore_reason() == "ok") & has_hash())


def families(files: DataFrame) -> DataFrame:
    """fast_hash, file_size, n of each family."""
    return eligible(files).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def statistics(files: DataFrame) -> DataFrame:
    """One row: families, files, sources, copies, wasted bytes and MB, largest, mean."""
    n, wasted = F.col("n"), (F.col("n") - 1) * F.col("file_size")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return families(files).agg(
        F.count(F.lit(1)).alias("families"), zero(F.sum(n)).alias("files"), F.count(F.lit(1)).alias("sources"), zero(F.sum(n - 1)).alias("copies"), zero(F.sum(wasted)).alias("wasted_bytes"),
        F.round(zero(F.sum(wasted)) / float(MB), 2).alias("wasted_mb"), zero(F.max(n)).alias("largest"), F.round(F.coalesce(F.avg(n), F.lit(0.0)), 2).alias("mean_size"),
    )


def histogram(files: DataFrame) -> DataFrame:
    """copies, families: how many families have so many files."""
    return families(files).groupBy(F.col("n").alias("copies")).agg(F.count(F.lit(1)).alias("families"))


def members(files: DataFrame) -> DataFrame:
    """Files of families, with n."""
    return eligible(files).join(families(files), KEY)


def sources(files: DataFrame) -> DataFrame:
    """fast_hash, file_size, n, source_id: the earliest created member (unreadable dates last, ties by id)."""
    order = F.struct(F.coalesce(dates.parse_creation_time(F.col("creation_time")).cast("timestamp_ntz"), F.expr("timestamp_ntz '9999-12-31'")).alias("t"), F.col("id").alias("i"))
    return eligible(files).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1").select(*KEY, "n", F.col("first.i").alias("source_id"))


def tagged(files: DataFrame) -> DataFrame:
    """All files, with SOURCE or COPY_<source id> for those of families, over the whole set rather than within a page."""
    found = files.withColumn("_ok", (ignore_reason() == "ok") & has_hash()).join(sources(files), KEY, "left")
    tag = F.when(F.col("_ok") & F.col("source_id").isNotNull(), F.when(F.col("id") == F.col("source_id"), "SOURCE").otherwise(F.concat(F.lit("COPY_"), F.col("source_id").cast("string"))))
    return found.withColumn("duplicate_tag", tag).drop("_ok")


def group_sizes(files: DataFrame) -> DataFrame:
    """Files with a non-blank hash, with the number of files of the same hash and size."""
    known = files.where(F.coalesce("fast_hash", F.lit("")) != "")
    return known.join(known.groupBy(*KEY).agg(F.count(F.lit(1)).alias("group_size")), KEY)


def level(n: Column) -> Column:
    return F.when(n >= 7, "7x+").otherwise(F.concat(n.cast("string"), F.lit("x")))


def level_metrics(files: DataFrame) -> DataFrame:
    """level, files, percentage, size_gb, families; levels without files are there with zeros."""
    known = files.where(F.coalesce("fast_hash", F.lit("")) != "")
    per = known.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).select(level(F.col("n")).alias("level"), "n", (F.col("n") * F.col("file_size")).alias("bytes"))
    found = per.groupBy("level").agg(F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("families"))
    every = literal_rows(files.sparkSession, "level", DUPLICATE_LEVELS)
    total = known.agg(F.count(F.lit(1)).alias("total"))
    rows = every.join(found, "level", "left").join(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("level", zero(F.col("files")).alias("files"), share(zero(F.col("files")), F.col("total")).alias("percentage"), F.round(zero(F.col("bytes")) / float(1 << 30), 4).alias("size_gb"), zero(F.col("families")).alias("families"))


def by_name(files: DataFrame) -> DataFrame:
    """name, n of names that several files have."""
    return files.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def copies(files: DataFrame) -> DataFrame:
    """The members of families but their sources: fast_hash, file_size, source_id, id, path, created; in the order of creation within a family (unreadable dates last)."""
    rows = eligible(files).join(sources(files), KEY).where("id <> source_id")
    made = rows.select(*KEY, "source_id", "id", "path", dates.parse_creation_time(F.col("creation_time")).alias("created"))
    return made.orderBy("source_id", F.col("created").asc_nulls_last(), "id")


def name_histogram(files: DataFrame) -> DataFrame:
    """copies, name: the names that so many files have, in order; a row a name, since so many names can share a number."""
    return by_name(files).select(F.col("n").alias("copies"), "name").orderBy("copies", "name")


def contiguous(rows: DataFrame) -> DataFrame:
    """Tagged rows so that families stand together: families in the order of their first row (id descending), the source first, then by creation text; others last. Adds family_first."""
    first = rows.where(F.col("duplicate_tag").isNotNull()).groupBy(*KEY).agg(F.max("id").alias("_first"))
    ranked = rows.join(first, KEY, "left").withColumn("family_first", F.when(F.col("duplicate_tag").isNotNull(), F.col("_first"))).drop("_first")
    order = [F.col("family_first").desc_nulls_last(), F.when(F.col("duplicate_tag") == "SOURCE", 0).otherwise(1), F.when(F.col("family_first").isNotNull(), F.coalesce("creation_time", F.lit(""))), F.col("id").desc()]
    return ranked.orderBy(*order)
