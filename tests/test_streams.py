"""The log source across appends, restarts, renames and cuts; answers as state against the batch cache; paced runs."""

import datetime
import os

from pyspark.sql import functions as F

from inventra.operators import answers, batch, durable
from inventra.sources import logs
from inventra.streaming import answer_state, paced

from .test_batch import AS_OF, _inventory, _no_cache


def _read_on(spark, folder, out, size=logs.RANGE):
    given = logs.stream(spark, f"file://{folder}", size).select("file", "at", "line")
    given.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", f"{out}-check").trigger(availableNow=True).start().awaitTermination()
    return sorted(r["line"] for r in spark.read.schema(logs.SCHEMA).parquet(str(out)).collect())


def test_log_source(spark, tmp_path):
    """Three appends and restarts give each line once, an unfinished one when it is finished; ranges of a few bytes too."""
    folder, out = tmp_path / "logs", tmp_path / "out"
    folder.mkdir()
    (folder / "a.log").write_text("one\ntwo\nthr")
    (folder / "b.log").write_text("")
    assert _read_on(spark, folder, out, 3) == ["one", "two"]
    with open(folder / "a.log", "a") as f:
        f.write("ee\r\n" + "long " * 50 + "\n\n")
    (folder / "b.log").write_text("bee")
    assert _read_on(spark, folder, out, 3) == ["", "long " * 50, "one", "three", "two"]
    # Rotation: the old file goes on under its new name, the new one begins at 0.
    os.rename(folder / "a.log", folder / "a.log.1")
    with open(folder / "a.log.1", "a") as f:
        f.write("last\n")
    (folder / "a.log").write_text("new\n")
    (folder / "b.log").write_text("bees\n")
    before = _read_on(spark, folder, out)
    assert before == sorted(["", "long " * 50, "one", "three", "two", "last", "new", "bees"])
    # Cut to nothing and written again, shorter and then longer than what was read.
    (folder / "a.log").write_text("x\n")
    assert _read_on(spark, folder, out) == sorted([*before, "x"])
    (folder / "a.log").write_text("quite another beginning\nand more\n")
    assert _read_on(spark, folder, out, 5) == sorted([*before, "x", "quite another beginning", "and more"])


def test_answers_as_the_batch_cache(spark, tmp_path):
    """At pinned times the state answers as the batch cache does; an answer put at any moment lives its full time; state goes on across restarts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = datetime.datetime(2024, 1, 1)
    puts = [(k, f"k{k % 3}", start + datetime.timedelta(hours=h)) for k, h in enumerate((0, 5, 23.99, 30, 31, 47.9))]
    asks = [(100 + 10 * i + k, f"k{k}", start + datetime.timedelta(hours=h)) for i, h in enumerate((1, 23, 24, 29, 29.5, 35, 47.98, 48, 53.9, 54.1, 55)) for k in range(4)]
    schema = "event_id long, cache_key string, kind string, answer string, at timestamp"
    events = [(i, k, "put", f"answer {i}", at) for i, k, at in puts] + [(i, k, "ask", None, at) for i, k, at in asks]
    split = start + datetime.timedelta(hours=29.2)
    for number, some in enumerate(([e for e in events if e[4] < split], [e for e in events if e[4] >= split])):
        spark.createDataFrame(some, schema).coalesce(2).write.parquet(f"{tmp_path}/in/{number}")
        given = answer_state.answered(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), 24)
        given.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = {r["event_id"]: (r["hit"], r["answer"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == len(asks)
    for i, key, at in asks:
        held = [p for p in puts if p[1] == key and p[2] <= at]
        rows = spark.createDataFrame([(k, f"answer {n}", m, 1, m + datetime.timedelta(hours=24)) for n, k, m in held], "cache_key string, response_content string, created_at timestamp, hits_count int, ttl_expiry timestamp")
        live = answers.alive(answers.put(rows.limit(0), rows.drop("hits_count")), str(at)).collect()
        assert got[i] == ((True, live[0]["response_content"]) if live else (False, None)), (i, key, at)


def test_paced_run(spark, tmp_path):
    """Batches in order of scores; stopped within a batch and gone on with, no content is asked twice, and the tables are those of a plain run."""
    files, folder = _inventory(spark, 60), f"file://{tmp_path}/run"
    notes = tmp_path / "notes"
    notes.mkdir()

    def asking(texts):
        import uuid

        for t in texts:
            (notes / uuid.uuid4().hex).write_text(t)
        if len(list(notes.iterdir())) == 13:
            durable.stop(folder)
        return batch.offline(texts)

    sending = batch.Sending(in_flight=1, bounds=durable.Bounds(rows=1))
    first, steps = paced.run(files, _no_cache(spark), AS_OF, folder, 10, classifier=asking, sending=sending)
    assert len(list(notes.iterdir())) == 13 and 0 < first.files.where("status = 'completed'").count() < 60
    assert [s.number for s in steps] == list(range(len(steps))) and all(s.total == 32 for s in steps)
    second, more = paced.run(files, _no_cache(spark), AS_OF, folder, 10, classifier=asking, sending=sending)
    assert len(list(notes.iterdir())) == 32 and second.files.where("status = 'completed'").count() == 60
    assert durable.results(spark, folder, batch.ANSWERS).groupBy("content_key").count().where("count > 1").isEmpty()
    plain = batch.run_pending(files, _no_cache(spark), AS_OF, f"file://{tmp_path}/plain")
    shown = lambda b: sorted((r["fichier_id"], r["security_cached"]) for r in b.responses.select("fichier_id", "security_cached").collect())
    assert shown(second) == shown(plain)
    assert paced.progress(0, 10, 40, 30.0) == paced.Step(0, 10, 40, 25.0, 20.0, 1.5)
    none, _ = paced.run(files.where(F.lit(False)), _no_cache(spark), AS_OF, f"file://{tmp_path}/none", 10)
    assert none.files.count() == 0
