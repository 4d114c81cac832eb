"""Streaming twins: event-time counts, and operators that carry state from batch to batch for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """(start, event_type, n, total) of event-time windows, for a batch or a stream; rows later than `late` are dropped there."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = LATE) -> DataFrame:
    """(user_id, start, n) of sessions that end after `gap` without an event."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def recurrent_scan(rows: DataFrame, a: float, b: float, c: float, d: float) -> DataFrame:
    """(key, t, y) of s = a s + b u, y = c s + d u for a stream of (key, t, u): one number of state for each key. Rows of a key
    must come in the order of t from batch to batch; inside a batch they are sorted."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (s,) = state.get if state.exists else (0.0,)
        pdf = pd.concat(list(parts)).sort_values("t")
        out = []
        for u in pdf["u"]:
            s = a * s + b * u
            out.append(c * s + d * u)
        state.update((s,))
        yield pd.DataFrame({"key": [key[0]] * len(pdf), "t": pdf["t"].to_numpy(), "y": out})

    return rows.groupBy("key").applyInPandasWithState(step, "key long, t long, y double", "s double", "append", GroupStateTimeout.NoTimeout)


def down_pool(rows: DataFrame, pool: int) -> DataFrame:
    """(key, t, values): every `pool` values of a key in one row, as soon as they are complete; what is left waits as state."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = state.get if state.exists else (0, [])
        pdf = pd.concat(list(parts)).sort_values("t")
        held = [*held, *pdf["u"].tolist()]
        full = len(held) // pool
        out = [held[i * pool : (i + 1) * pool] for i in range(full)]
        state.update((done + full, held[full * pool :]))
        yield pd.DataFrame({"key": [key[0]] * full, "t": list(range(done, done + full)), "values": out})

    return rows.groupBy("key").applyInPandasWithState(step, "key long, t long, values array<double>", "done long, held array<double>", "append", GroupStateTimeout.NoTimeout)


def up_pool(rows: DataFrame) -> DataFrame:
    """(key, t, u) values out of (key, t, values) rows: the inverse of `down_pool`, without state."""
    each = rows.select("key", F.col("t").alias("_t"), F.size("values").alias("_n"), F.posexplode("values").alias("_i", "u"))
    return each.select("key", (F.col("_t") * F.col("_n") + F.col("_i")).alias("t"), "u")


def running_best(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, best, n): the least value so far and how many there were, for a batch or a stream in complete or update mode."""
    return rows.groupBy(key).agg(F.min(value).alias("best"), F.count(value).alias("n"))


class Progress(StreamingQueryListener):
    """Keeps (batch, rows, rows a second) of each batch of the queries of a session, and hands each to a function if given one."""

    def __init__(self, tell: Callable[[tuple[int, int, float]], None] | None = None) -> None:
        self.seen: list[tuple[int, int, float]] = []
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.seen.append((p.batchId, p.numInputRows, p.processedRowsPerSecond))
        if self.tell:
            self.tell(self.seen[-1])
