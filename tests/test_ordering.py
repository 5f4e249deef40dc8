"""Ranks and running figures over stretches, against windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from inventra.operators import ordering


@pytest.fixture(scope="module")
def calls(spark):
    """9 rows of 10 are one worker's; null workers and values among the others."""
    rows = [(i, None if i % 50 == 0 else (7 if i % 10 else i % 30), float(i * 7919 % 1009) if i % 13 else None, i * 31 % 977) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, worker int, duration double, ts int").withColumn("n", F.round("duration").cast("long")).repartition(5)


@pytest.mark.parametrize(("parts", "frame"), [(1, 10), (7, 10), (64, 10), (700, 10), (64, 1), (64, 90)])
def test_running(calls, parts, frame):
    got = ordering.running(calls, ["worker"], ["ts", "id"], "n", "duration", frame, parts)
    own = Window.partitionBy("worker").orderBy("ts", "id")
    whole, last = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(1 - frame, 0)
    n = F.coalesce("n", F.lit(0))
    want = calls.select("*", F.row_number().over(own).cast("long").alias("run_number"), F.sum(n).over(whole).alias("run_sum"), F.sum(n).over(last).alias("frame_sum"), F.count(F.lit(1)).over(last).alias("frame_rows"), F.max("duration").over(whole).alias("run_most"))
    key = lambda r: r["id"]
    assert sorted(got.collect(), key=key) == sorted(want.select(*got.columns).collect(), key=key)


@pytest.mark.parametrize("parts", [1, 9, 300])
def test_ranked(calls, parts):
    got = {r["id"]: r["rank"] for r in ordering.ranked(calls, [F.desc("ts"), F.asc("id")], parts=parts).collect()}
    want = [r["id"] for r in sorted(calls.collect(), key=lambda r: (-r["ts"], r["id"]))]
    assert got == {i: k for k, i in enumerate(want, 1)}


def test_empty(calls):
    assert ordering.running(calls.limit(0), ["worker"], ["ts", "id"], "n", "duration").count() == 0
    assert ordering.ranked(calls.limit(0), [F.col("ts")]).count() == 0


@pytest.mark.parametrize("parts", [1, 40])
def test_hot_keys_in_many_tasks(spark, calls, parts):
    """One worker's log, one owner's files and the answers with one hit are dealt to all tasks, and the results stay those of a window."""
    from inventra.operators import answers, ordering, paging, reliability

    log = calls.select(F.col("id").alias("call_id"), F.lit(1).alias("worker"), F.coalesce("duration", F.lit(0.0)).alias("duration"), "ts")
    own = Window.partitionBy("worker").orderBy("ts", "call_id")
    for made, column, want in (
        (reliability.moving_average(log, parts=parts), "moving", F.avg("duration").over(own.rowsBetween(-9, 0))), (reliability.running_mean(log, parts), "running", F.avg("duration").over(own.rowsBetween(Window.unboundedPreceding, 0))),
        (reliability.running_max(log, parts), "most", F.max("duration").over(own.rowsBetween(Window.unboundedPreceding, 0))),
    ):
        got = {r["call_id"]: round(r[column], 9) for r in made.collect()}
        assert got == {r["call_id"]: round(r["x"], 9) for r in log.select("call_id", want.alias("x")).collect()}
    files = calls.select("id", F.lit("o").alias("owner"))
    assert {r["id"]: r["position"] for r in paging.positions(files, ["owner"], parts).collect()} == {i: 2999 - i for i in range(3000)}
    cache = calls.select(F.format_string("k%05d", "id").alias("cache_key"), F.lit("c").alias("response_content"), F.to_timestamp(F.col("ts").cast("long")).alias("created_at"), F.lit(1).alias("hits_count"), F.lit(10).cast("long").alias("file_size"))
    stays = answers.evict(cache, 20_000, parts)
    first = sorted(cache.collect(), key=lambda r: (r["created_at"], r["cache_key"]))[2000:]
    assert sorted(r["cache_key"] for r in stays.collect()) == sorted(r["cache_key"] for r in first) and stays.columns == cache.columns
    if parts > 1:
        sizes = [r["count"] for r in ordering.stretches(files, [F.col("owner"), F.col("id")], parts).groupBy("_part").count().collect()]
        assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
