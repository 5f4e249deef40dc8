"""A run at a bounded rate: the pending contents as micro-batches of a fixed size, one each interval, in order of their scores.

The contents to be asked lie as pages in the run's folder; a stream that counts batches takes one page after the other, and its checkpoint knows how far it came. A run can be
stopped within a batch: tasks end at their next portion, the batch isn't taken as done, and going on takes it again, without asking for what has an answer. While it runs,
a listener keeps the figures of its progress.
"""

from __future__ import annotations

import dataclasses
import time

from pyspark.errors.exceptions.base import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..config import Rules
from ..operators import batch, durable, pages
from ..sources import shared


@dataclasses.dataclass(frozen=True)
class Step:
    """Progress after a batch: contents asked so far and in all, in percent, a minute, and minutes that are left."""

    number: int
    done: int
    total: int
    percentage: float
    per_minute: float
    minutes_left: float | None


def progress(number: int, done: int, total: int, seconds: float) -> Step:
    rate = 60 * done / seconds if seconds > 0 else 0.0
    return Step(number, done, total, round(100 * done / total, 2) if total else 100.0, round(rate, 2), round((total - done) / rate, 2) if rate > 0 else None)


class Listener(StreamingQueryListener):
    """Keeps the last batches' progress, as the stream reports them."""

    def __init__(self, total: int, per_batch: int, most: int = 1000) -> None:
        self.total, self.per_batch, self.most, self.steps, self.began = total, per_batch, most, [], time.monotonic()

    def onQueryStarted(self, event) -> None:
        self.began = time.monotonic()

    def onQueryProgress(self, event) -> None:
        number = event.progress.batchId
        self.steps.append(progress(number, min(self.total, (number + 1) * self.per_batch), self.total, time.monotonic() - self.began))
        del self.steps[: -self.most]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class _Stopped(Exception):
    """The run was asked to stop."""


def _queue(files: DataFrame, cache: DataFrame, as_of: str, folder: str, filters: Rules) -> pages.Pages:
    """The run's contents in order, built once."""
    place = f"{folder}/queue"
    system, where = shared.open_fs(f"{place}/index/_SUCCESS")
    if system.get_file_info(where).is_file:
        return pages.opened(files.sparkSession, place)
    once = batch.contents(batch.sorted_out(files.where("status = 'pending'"), cache, as_of, filters)[2])
    return pages.build(once, [F.col("priority_score").desc(), F.col("content_key")], place)


def run(files: DataFrame, cache: DataFrame, as_of: str, folder: str, per_batch: int, every: float = 0.0, classifier: batch.Classifier = batch.offline, filters: Rules = Rules(), sending: batch.Sending = batch.Sending(), wait: float = 0.2) -> tuple[batch.Batch, list[Step]]:
    """Asks for the pending files' contents, at most per_batch each `every` seconds, until all are done or `durable.stop(folder)` is called; the tables then, and the progress. Called again, it goes on."""
    spark = files.sparkSession
    durable.go_on(folder)
    queue = _queue(files, cache, as_of, folder, filters)
    batches = -(-len(queue) // per_batch)
    listener = Listener(len(queue), per_batch)

    def take(rows: DataFrame, _: int) -> None:
        for (number,) in rows.select("value").collect():  # a row a batch
            if number < batches:
                batch.ask(queue.page(per_batch, number * per_batch).drop("row_number"), folder, classifier, sending=sending)
        if durable.stopped(folder):
            raise _Stopped

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    if batches:
        spark.streams.addListener(listener)
        try:
            query = ticks.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/stream").trigger(processingTime=f"{int(1000 * every)} milliseconds").start()
            try:
                while query.isActive and (query.lastProgress is None or query.lastProgress["batchId"] + 1 < batches):
                    time.sleep(wait)
            finally:
                query.stop()
            if (error := query.exception()) is not None and not durable.stopped(folder):
                raise error
        except StreamingQueryException:
            if not durable.stopped(folder):
                raise
        finally:
            spark.streams.removeListener(listener)
    place = f"{folder}/outcomes/paced"
    batch.outcomes(files.where("status = 'pending'"), cache, as_of, None, filters, folder).write.mode("overwrite").parquet(place)
    return batch.applied(files, cache, as_of, spark.read.parquet(place)), listener.steps
