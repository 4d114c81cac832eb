"""Streams whose rows come in any order: state with timers holds them until the watermark has passed.

A key's rows wait in its state until no earlier one can come any more; a timer at the earliest that waits brings them out in the
order of time, and what a step carries from row to row (a recurrence's state, the last values of a window) follows that order.
Shuffled micro-batches therefore give what one sorted table gives. Rows that come after the watermark has passed their time are
dropped, as everywhere in Spark. A key from which nothing came for `idle` gives its state back.

The state store must be RocksDB's (`use_rocksdb`), which keeps lists and timers outside of memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State with lists and timers for the session's streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _InOrder(StatefulProcessor):
    """Brings a key's rows (ts in ms, t, u) out in the order of ts and t. `step` of a subclass takes arrays in order and the carried numbers,
    and gives a frame and what is carried on."""

    def __init__(self, idle_ms: int) -> None:
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, t long, u double")
        self.carried = handle.getValueState("carried", "x array<double>, last long")

    def step(self, t: np.ndarray, u: np.ndarray, carried: list[float]) -> tuple[pd.DataFrame, list[float]]:
        raise NotImplementedError

    def _advance(self, key: tuple, more: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = sorted(rows + more)
        ready = [r for r in rows if r[0] <= now]
        rest = rows[len(ready) :]
        carried, last = self.carried.get() if self.carried.exists() else ([], 0)
        if rows:
            last = max(last, rows[-1][0])
        if ready:
            out, carried = self.step(np.array([r[1] for r in ready]), np.array([r[2] for r in ready]), list(carried))
            out.insert(0, "key", key[0])
            if len(out):
                yield out
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        elif self.waiting.exists():
            self.waiting.clear()
        if rest or now < last + self.idle:
            self.carried.update(([float(x) for x in carried], int(last)))
            if not rest:
                self.handle.registerTimer(int(last + self.idle))
        elif self.carried.exists():
            self.carried.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(0, timerValues.getCurrentWatermarkInMs())
        more = [(int(ts.value // 1_000_000), int(t), float(u)) for pdf in rows for ts, t, u in zip(pd.to_datetime(pdf["ts"]), pdf["t"], pdf["u"], strict=True)]
        yield from self._advance(key, [r for r in more if r[0] > now or now == 0], now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class _Scan(_InOrder):
    def __init__(self, a: float, b: float, c: float, d: float, idle_ms: int) -> None:
        super().__init__(idle_ms)
        self.model = a, b, c, d

    def step(self, t: np.ndarray, u: np.ndarray, carried: list[float]) -> tuple[pd.DataFrame, list[float]]:
        a, b, c, d = self.model
        s, y = (carried or [0.0])[0], np.empty(len(u))
        for i, x in enumerate(u):
            s = a * s + b * x
            y[i] = c * s + d * x
        return pd.DataFrame({"t": t, "y": y}), [s]


class _Windows(_InOrder):
    """Carries how many rows there were, and the last size - 1 of them."""

    def __init__(self, size: int, slide: int, idle_ms: int) -> None:
        super().__init__(idle_ms)
        self.size, self.slide = size, slide

    def step(self, t: np.ndarray, u: np.ndarray, carried: list[float]) -> tuple[pd.DataFrame, list[float]]:
        seen, held = int((carried or [0.0])[0]), carried[1:]
        values = np.concatenate([held, u])
        first, n = seen - len(held), seen + len(u)  # numbers of the first row held and of the next to come
        begin = -(-max(first, 0) // self.slide) * self.slide
        starts = [s for s in range(begin, n - self.size + 1, self.slide) if s + self.size > seen]
        rows = [values[s - first : s - first + self.size].tolist() for s in starts]
        keep = min(len(values), self.size - 1)
        return pd.DataFrame({"start": np.array(starts, np.int64), "values": rows}), [float(n), *values[len(values) - keep :].tolist()]


def _with_state(rows: DataFrame, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    own = rows.select("key", F.col("ts").cast("timestamp").alias("ts"), F.col("t").cast("long").alias("t"), F.col("u").cast("double").alias("u")).withWatermark("ts", late)
    return own.groupBy("key").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def _ms(rows: DataFrame, idle: str) -> int:
    """A duration such as `1 day` in milliseconds."""
    return int(pd.Timedelta(idle).total_seconds() * 1000)


def ordered_scan(rows: DataFrame, a: float, b: float, c: float, d: float, late: str = "1 hour", idle: str = "30 days") -> DataFrame:
    """(key, t, y) of s = a s + b u, y = c s + d u over a stream (key: long, ts, t, u), in the order of ts and t within each key, whatever
    the order they come in (not later than `late`)."""
    return _with_state(rows, _Scan(a, b, c, d, _ms(rows, idle)), "key long, t long, y double", late)


def count_windows(rows: DataFrame, size: int, slide: int, late: str = "1 hour", idle: str = "30 days") -> DataFrame:
    """(key, start, values): windows of `size` rows of each key, one every `slide` rows in the order of ts and t, as soon as the
    watermark has passed the last of them. `start` is the number (from 0) of the window's first row."""
    return _with_state(rows, _Windows(size, slide, _ms(rows, idle)), "key long, start long, values array<double>", late)
