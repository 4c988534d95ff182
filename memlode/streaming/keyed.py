"""Lists kept for each key of a stream: the last runs of a feature, and a bounded queue for each client."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RUNS = "feature string, id long, us long, place int"
MOVED = "client string, id long, outcome string, dropped long, enqueued long, size int"


class LastRuns(StatefulProcessor):
    """The ``keep`` newest runs (by time, then id) of each feature, as a list in the state.

    A micro-batch gives the whole list of each feature it touches.  With ``idle`` (microseconds) a timer
    drops the list of a feature whose newest run lies so far behind the watermark.
    """

    def __init__(self, keep: int, idle: int | None):
        self.keep, self.idle = keep, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "us long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = [tuple(r) for r in self.runs.get()] if self.runs.exists() else []
        for part in rows:
            best = heapq.nlargest(self.keep, [*best, *zip(part["us"].tolist(), part["id"].tolist())])
        self.runs.put(best)
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer((best[0][0] + self.idle) // 1000)
        yield pd.DataFrame({"feature": key[0], "id": [i for _, i in best], "us": [u for u, _ in best], "place": list(range(1, len(best) + 1))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.runs.clear()
        return iter(())

    def close(self) -> None:
        pass


def last_runs(events: DataFrame, keep: int = 10, idle: int | None = None, late: str = "24 hours") -> DataFrame:
    """Stream of RUNS for events (feature, id, ts): the list of a feature anew whenever it changes."""
    rows = (events.withWatermark("ts", late) if idle is not None else events).select("feature", "id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("feature").transformWithStateInPandas(LastRuns(keep, idle), RUNS, "update", "none" if idle is None else "eventTime")


def newest_lists(written: DataFrame) -> DataFrame:
    """(feature, id, ts, place) of what an idempotent sink holds of last_runs(): each feature's list of its last batch."""
    last = written.groupBy("feature").agg(F.max("batch").alias("batch"))
    return written.join(last, ["feature", "batch"]).select("feature", "id", F.timestamp_micros("us").alias("ts"), "place")


def moved(rows: list[tuple[int, int]], queue: deque, dropped: int, enqueued: int, capacity: int) -> tuple[list[tuple], int, int]:
    """What happens to one client's rows (id, read) in order: a row with read > 0 takes up to that many of the oldest
    ids out, others enter; a full queue first loses its oldest.  Gives (id, outcome, dropped, enqueued, size) for each id that leaves."""
    out = []
    for i, read in rows:
        if read > 0:
            for _ in range(min(read, len(queue))):
                out.append((queue.popleft(), "delivered", dropped, enqueued, len(queue)))
            continue
        enqueued += 1
        if len(queue) == capacity:
            dropped += 1
            out.append((queue.popleft(), "dropped", dropped, enqueued, len(queue) + 1))
        queue.append(i)
    return out, dropped, enqueued


class ClientQueues(StatefulProcessor):
    """moved() with each client's queue and counters as state: a slow client loses its own oldest events only."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getListState("queue", "id long")
        self.stats = handle.getValueState("stats", "dropped long, enqueued long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        queue = deque(r[0] for r in self.queue.get()) if self.queue.exists() else deque()
        dropped, enqueued = self.stats.get() if self.stats.exists() else (0, 0)
        own = pd.concat(list(rows)).sort_values(["us", "id"], kind="stable")
        out, dropped, enqueued = moved(list(zip(own["id"].tolist(), own["read"].tolist())), queue, dropped, enqueued, self.capacity)
        self.stats.update((dropped, enqueued))
        self.queue.put([(i,) for i in queue]) if queue else self.queue.clear()
        if out:
            yield pd.DataFrame(out, columns=["id", "outcome", "dropped", "enqueued", "size"]).assign(client=key[0])[["client", "id", "outcome", "dropped", "enqueued", "size"]]

    def close(self) -> None:
        pass


def client_queues(events: DataFrame, capacity: int = 1000) -> DataFrame:
    """Stream of MOVED rows for events (client, id, ts, read); rows stand by time and id within a micro-batch."""
    if capacity < 1:
        raise ValueError("a queue holds one event at least")
    rows = events.select(F.col("client").cast("string").alias("client"), F.col("id").cast("long").alias("id"), F.unix_micros("ts").alias("us"), F.coalesce(F.col("read"), F.lit(0)).cast("int").alias("read"))
    return rows.groupBy("client").transformWithStateInPandas(ClientQueues(capacity), MOVED, "append", "none")
