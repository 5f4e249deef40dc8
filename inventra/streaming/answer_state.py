"""The answer cache as keyed state: for each key its answer, its hits, and a timer that ends it.

Events are answers that are put and questions that are asked, each with its moment. A question is answered by the last answer put before it, if that hasn't
expired: an expiry belongs to the key and begins anew with each answer, wherever it falls. Within a batch a key's events are taken in
order of their moments (at one moment, answers first). Timers free the state of keys that nothing asks for any more, when the watermark has passed their expiry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "event_id long, cache_key string, at timestamp, hit boolean, answer string, hits int"
_STATE = "answer string, created long, expiry long, hits int"


def _micros(moments: pd.Series) -> list[int]:
    return moments.astype("datetime64[us]").astype("int64").tolist()


class Answers(StatefulProcessor):
    """One key's answer."""

    def __init__(self, hours: int) -> None:
        self.life = hours * 3600 * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("answer", _STATE)

    def _keep(self, answer: str, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((answer, at, at + self.life, 1))
        self.handle.registerTimer((at + self.life) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows), ignore_index=True)
        events["order"] = events["kind"] != "put"
        events = events.sort_values(["at", "order", "event_id"])
        held = tuple(self.state.get()) if self.state.exists() else None
        out, put = [], None
        for event_id, kind, answer, at, moment in zip(events["event_id"], events["kind"], events["answer"], events["at"], _micros(events["at"]), strict=True):
            if kind == "put":
                if held is None or moment >= held[1]:
                    held = put = (answer, moment, moment + self.life, 1)
                continue
            hit = held is not None and held[1] <= moment < held[2]
            if hit:
                held = (*held[:3], held[3] + 1)
            out.append((event_id, key[0], at, hit, held[0] if hit else None, held[3] if hit else None))
        if put:
            self._keep(put[0], put[1])
        if held:
            self.state.update(held)
        if out:
            found = pd.DataFrame(out, columns=["event_id", "cache_key", "at", "hit", "answer", "hits"])
            found["hits"] = found["hits"].astype("Int32")
            yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and tuple(self.state.get())[2] < timerValues.getCurrentWatermarkInMs() * 1000:
            self.state.clear()
        yield pd.DataFrame(columns=["event_id", "cache_key", "at", "hit", "answer", "hits"])

    def close(self) -> None:
        pass


def answered(events: DataFrame, hours: int = 168, late: str = "1 hour") -> DataFrame:
    """event_id, cache_key, at, hit, answer and hits (since the answer was put) of each question in a stream of events (event_id, cache_key, kind "put" or "ask", answer, at).

    Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
    """
    given = events.select("event_id", "cache_key", "kind", "answer", "at").withWatermark("at", late).where(F.col("cache_key").isNotNull())
    return given.groupBy("cache_key").transformWithStateInPandas(Answers(hours), OUT, "Append", "EventTime")
