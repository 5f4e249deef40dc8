"""Reliability of a classifier from repeated calls, and throttling figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering


#: Parts of a second in which durations are added up.
TICKS = 10_000


def call_metrics(calls: DataFrame) -> DataFrame:
    """One row from (worker, ok, duration): successes, errors, mean duration, calls a minute."""
    return calls.agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("errors"), F.round(F.avg(F.when(F.col("ok"), F.col("duration"))), 4).alias("mean_duration"), F.round(F.when(F.avg(F.when(F.col("ok"), F.col("duration"))) > 0, 60 / F.avg(F.when(F.col("ok"), F.col("duration")))).otherwise(0.0), 4).alias("per_minute"))


def worker_metrics(calls: DataFrame) -> DataFrame:
    return calls.groupBy("worker").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if("ok").alias("successes"), F.round(F.avg("duration"), 4).alias("mean_duration"))


def consistency(verdicts: DataFrame, column: str) -> DataFrame:
    """Share of the most frequent verdict, its complement, and how many distinct ones there are."""
    per = verdicts.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total, distinct = F.sum("n"), F.count(F.lit(1))
    spread = F.when(total > 1, F.least(distinct * 100.0 / F.least(total, F.lit(5)), F.lit(100.0))).otherwise(0.0)
    return per.agg(F.round(100.0 * F.max("n") / total, 4).alias("consistency"), F.round(100.0 - 100.0 * F.max("n") / total, 4).alias("variance"), distinct.alias("distinct_values"), F.round(spread, 4).alias("spread"))


def mean_and_deviation(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.round(F.coalesce(F.avg(column), F.lit(0.0)), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(column), F.lit(0.0)), 4).alias("deviation"))


def score(security: Column, rgpd: Column, mean: Column, deviation: Column) -> Column:
    return 0.4 * security + 0.4 * rgpd + 0.2 * mean * (1 - F.least(deviation / 100, F.lit(0.5)))


#: The most workers that are advised; shares of a worker's rate below and above which there should be one less or more; points a call a minute.
MOST_WORKERS, IDLE, BUSY, POINTS = 8, 0.7, 0.9, 10


def scalability(calls: DataFrame, workers: int) -> DataFrame:
    """One row: the calls a minute that the fastest worker could make, the part of it that is reached, how many workers there should be, and a score from 0 to 100."""
    rate = call_metrics(calls).select("per_minute")
    wide = worker_metrics(calls).agg(F.min("mean_duration").alias("fastest")).join(F.broadcast(rate))
    most = F.when(F.col("fastest") > 0, 60 / F.col("fastest")).otherwise(0.0)
    wide = wide.withColumn("most_per_minute", most)
    reached = F.when(F.col("most_per_minute") > 0, F.col("per_minute") / F.col("most_per_minute")).otherwise(0.0)
    each = reached / workers
    idle = F.lit(min(MOST_WORKERS, max(2, workers)))
    advice = F.when(F.col("per_minute") > 0, F.when(each < IDLE, max(1, workers - 1)).when(each > BUSY, min(MOST_WORKERS, workers + 1)).otherwise(idle)).otherwise(idle)
    score = F.least(F.lit(100.0), F.col("per_minute") / workers * POINTS)
    return wide.select(F.round("most_per_minute", 4).alias("most_per_minute"), F.round(reached, 4).alias("efficiency"), advice.alias("advised_workers"), F.round(score, 4).alias("score"))


def _running(calls: DataFrame, rows: int = 10, parts: int | None = None) -> DataFrame:
    """The calls with each worker's running figures; durations are added up as whole ten-thousandths, so that the order of adding doesn't matter. A busy worker's log is many stretches."""
    given = calls.withColumn("_ticks", F.round(F.col("duration") * TICKS).cast("long"))
    return ordering.running(given, ["worker"], ["ts", "call_id"], "_ticks", "duration", rows, parts).drop("_ticks")


def moving_average(calls: DataFrame, rows: int = 10, parts: int | None = None) -> DataFrame:
    """Mean of each worker's last calls."""
    return _running(calls, rows, parts).withColumn("moving", F.col("frame_sum") / F.col("frame_rows") / TICKS).select(*calls.columns, "moving")


def running_mean(calls: DataFrame, parts: int | None = None) -> DataFrame:
    return _running(calls, parts=parts).withColumn("running", F.col("run_sum") / F.col("run_number") / TICKS).select(*calls.columns, "running")


def running_max(calls: DataFrame, parts: int | None = None) -> DataFrame:
    return _running(calls, parts=parts).select(*calls.columns, F.col("run_most").alias("most"))
