"""The answer cache, keyed by content and prompt, with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MB
from . import ordering
from .rules import ignore_reason


def key(fast_hash: Column, file_size: Column, prompt_hash: Column) -> Column:
    return F.concat_ws("_", fast_hash, file_size.cast("string"), prompt_hash)


def legacy_key(fast_hash: Column, prompt_hash: Column) -> Column:
    return F.concat_ws("_", fast_hash, prompt_hash)


def alive(cache: DataFrame, as_of: str) -> DataFrame:
    return cache.where(F.col("ttl_expiry") > F.to_timestamp(F.lit(as_of)))


def probe(files: DataFrame, cache: DataFrame, as_of: str) -> DataFrame:
    """Files with the answer that the cache holds: by key, else by the older key without the size. Files left out of detection never hit."""
    live = alive(cache, as_of).select("cache_key", "response_content")
    first = live.select(F.col("cache_key").alias("_k1"), F.col("response_content").alias("_r1"))
    second = live.select(F.col("cache_key").alias("_k2"), F.col("response_content").alias("_r2"))
    fits = ignore_reason() == "ok"
    rows = files.withColumn("_key", F.when(fits, key(F.col("fast_hash"), F.col("file_size"), F.col("prompt_hash")))).withColumn("_old", F.when(fits, legacy_key(F.col("fast_hash"), F.col("prompt_hash"))))
    rows = rows.join(first, F.col("_key") == F.col("_k1"), "left").join(second, (F.col("_old") == F.col("_k2")) & F.col("_k1").isNull(), "left")
    return rows.withColumn("answer", F.coalesce("_r1", "_r2")).withColumn("hit", F.when(F.col("_k1").isNotNull(), "key").when(F.col("_k2").isNotNull(), "legacy").otherwise("miss")).drop("_key", "_old", "_k1", "_k2", "_r1", "_r2")


def after_probe(files: DataFrame, cache: DataFrame, as_of: str) -> DataFrame:
    """The cache after files have asked: each answer's hits grow by the files that it answered, and expired rows that were asked for are gone."""
    fits = ignore_reason() == "ok"
    asked = files.where(fits).select(key(F.col("fast_hash"), F.col("file_size"), F.col("prompt_hash")).alias("_key"), legacy_key(F.col("fast_hash"), F.col("prompt_hash")).alias("_old"))
    known = cache.select("cache_key", (F.col("ttl_expiry") > F.to_timestamp(F.lit(as_of))).alias("_alive"))
    first = asked.groupBy("_key", "_old").agg(F.count(F.lit(1)).alias("_n")).join(known.withColumnRenamed("cache_key", "_key"), "_key", "left")
    # The older key is asked only where the newer one isn't there at all or has expired.
    rest = first.where(~F.coalesce("_alive", F.lit(False))).select(F.col("_old").alias("cache_key"), "_n")
    counts = first.where("_alive is not null").select(F.col("_key").alias("cache_key"), "_n").unionByName(rest).groupBy("cache_key").agg(F.sum("_n").alias("_n"))
    rows = cache.join(counts, "cache_key", "left").where(F.col("_n").isNull() | (F.col("ttl_expiry") > F.to_timestamp(F.lit(as_of))))
    return rows.withColumn("hits_count", (F.col("hits_count") + F.coalesce("_n", F.lit(0))).cast("int")).drop("_n")


def put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The newest row of each key; a replaced row's hits begin at 1 again."""
    both = cache.unionByName(new.withColumn("hits_count", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c != "cache_key"]
    return both.groupBy("cache_key").agg(F.max_by(F.struct(*names), "created_at").alias("r")).select("cache_key", *[F.col(f"r.{n}").alias(n) for n in names])


def evict(cache: DataFrame, excess_bytes: int, parts: int | None = None) -> DataFrame:
    """What stays when the least used, then oldest rows go until their documents' sizes cover the excess. The sum runs over stretches of the order, so rows of one number of hits are many tasks."""
    narrow = cache.select("cache_key", "hits_count", "created_at", F.coalesce("file_size", F.lit(0)).cast("long").alias("file_size"))
    summed = ordering.running(narrow, [], ["hits_count", "created_at", "cache_key"], "file_size", "hits_count", 1, parts)
    stays = summed.where(F.col("run_sum") - F.col("file_size") >= excess_bytes).select(*[F.col(c).alias(f"_{c}") for c in ("cache_key", "hits_count", "created_at")])
    same = (F.col("cache_key") == F.col("_cache_key")) & F.col("hits_count").eqNullSafe(F.col("_hits_count")) & F.col("created_at").eqNullSafe(F.col("_created_at"))
    return cache.join(stays, same, "left_semi")


def statistics(cache: DataFrame) -> DataFrame:
    hits, n = F.sum("hits_count"), F.count(F.lit(1))
    return cache.agg(n.alias("entries"), F.round(F.when(hits > 0, (hits - n) * 100.0 / hits).otherwise(0.0), 2).alias("hit_rate"), F.min("created_at").alias("oldest"), F.round(F.coalesce(F.sum("file_size"), F.lit(0)) / float(MB), 4).alias("size_mb"), (n > 10_000).alias("cleanup_needed"))
