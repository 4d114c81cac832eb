"""Linear recurrences, filters and resampling over series of any length, in many tasks.

A series is rows (key columns, t, u) with whole numbers t. It is cut into chunks of CHUNK positions, each one row with arrays. A
recurrence s = A s + B u is associative in the pairs (A^length, state from zero), so:

1. every chunk gives its length and its last state from a zero start, side by side with all others;
2. a prefix pass over these few rows gives each chunk the state it starts from; where there are more than FANOUT chunks, they are
   grouped, the groups are composed, and the pass is made over the groups, level by level;
3. every chunk gives its outputs from its start.

Inside a chunk, blocks of BLOCK steps are matrix products (the response within a block, what it adds to the state, what the state
adds to it), so only one step a block is sequential.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.tables import materialize

#: Positions of a chunk, chunks of a group, steps of a block.
CHUNK, FANOUT, BLOCK = 1 << 16, 1 << 12, 64


@dataclass(frozen=True)
class StateSpace:
    """s = A s + B u and y = Re(C s) + D u. `a` is a matrix, or a vector if it is diagonal; it may be complex."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float = 0.0

    @staticmethod
    def diagonal(poles, b, c, d: float = 0.0) -> StateSpace:
        return StateSpace(*[np.atleast_1d(np.asarray(x, complex)) for x in (poles, b, c)], d)

    @staticmethod
    def dense(a, b, c, d: float = 0.0) -> StateSpace:
        return StateSpace(*[np.asarray(x, complex) for x in (a, b, c)], d)

    @staticmethod
    def of_sections(sections: np.ndarray) -> StateSpace:
        """Second-order sections one after the other: two numbers of state for each."""
        n = 2 * len(sections)
        a, b = np.zeros((n, n)), np.zeros(n)
        # The input of a section, in terms of the states before it and of u.
        row, direct = np.zeros(n), 1.0
        for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
            y_row, y_direct = b0 * row, b0 * direct
            y_row[2 * k] += 1.0
            a[2 * k], b[2 * k] = b1 * row - a1 * y_row, b1 * direct - a1 * y_direct
            a[2 * k, 2 * k + 1] += 1.0
            a[2 * k + 1], b[2 * k + 1] = b2 * row - a2 * y_row, b2 * direct - a2 * y_direct
            row, direct = y_row, y_direct
        # The output sees the states before the step, and C stands behind it: y = C s + D u with s after the step needs an extra state.
        big = np.zeros((n + 1, n + 1))
        big[:n, :n], big[n, :n] = a, row
        return StateSpace.dense(big, [*b, direct], [0.0] * n + [1.0])

    @property
    def size(self) -> int:
        return len(self.b)

    def apply(self, power: np.ndarray, state: np.ndarray) -> np.ndarray:
        """A power of A on states (rows)."""
        return state * power if power.ndim == 1 else state @ power.T

    def power(self, n: int) -> np.ndarray:
        return self.a**n if self.a.ndim == 1 else np.linalg.matrix_power(self.a, n)

    @cached_property
    def block(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(responses within a block, what its inputs add to the state, what the state adds to its outputs, A^BLOCK)."""
        add, out, now = [self.b], [], self.c
        for _ in range(BLOCK):
            add.append(self.apply(self.a, add[-1]))
            now = now * self.a if self.a.ndim == 1 else now @ self.a
            out.append(now)
        response = np.array([(self.c * x).sum().real for x in add[:BLOCK]])
        response[0] += self.d
        lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
        return np.where(lag >= 0, response[np.abs(lag)], 0.0), np.array(add[BLOCK - 1 :: -1]), np.array(out), self.power(BLOCK)

    def run(self, u: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs for the inputs from a state, and the state behind them."""
        within, add, out, power = self.block
        full = len(u) // BLOCK
        blocks = u[: full * BLOCK].reshape(full, BLOCK)
        added, starts = blocks @ add, np.empty((full, self.size), complex)
        for k in range(full):
            starts[k] = state
            state = self.apply(power, state) + added[k]
        y = np.empty(len(u))
        y[: full * BLOCK] = (blocks @ within.T + (starts @ out.T).real).ravel()
        rest = u[full * BLOCK :]
        if n := len(rest):
            y[full * BLOCK :] = within[:n, :n] @ rest + (out[:n] @ state).real
            state = self.apply(self.raised(n), state) + rest @ add[BLOCK - n :]
        return y, state

    def raised(self, n: int) -> np.ndarray:
        """`power`, kept for lengths that come again."""
        if n not in self._raised:
            if len(self._raised) > 4 * BLOCK:
                self._raised.clear()
            self._raised[n] = self.power(n)
        return self._raised[n]

    @cached_property
    def _raised(self) -> dict[int, np.ndarray]:
        return {}


def chunks(rows: DataFrame, keys: list[str], t: str, u: str, chunk: int = CHUNK) -> DataFrame:
    """(keys, chunk, ts, us): the rows of each range of `chunk` positions in order, one row each."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(t).cast("long").alias("t"), F.col(u).cast("double").alias("u"))))
    own = rows.groupBy(*keys, F.floor(F.col(t) / chunk).alias("chunk")).agg(packed.alias("_p"))
    return own.select(*keys, "chunk", F.transform("_p", lambda x: x["t"]).alias("ts"), F.transform("_p", lambda x: x["u"]).alias("us"))


def _parts(x: np.ndarray) -> list[float]:
    return [*x.real.tolist(), *x.imag.tolist()]


def _whole(x) -> np.ndarray:
    x = np.asarray(x, float)
    return x[: len(x) // 2] + 1j * x[len(x) // 2 :]


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield np.asarray(x.values)


def _order(reverse: bool) -> int:
    return -1 if reverse else 1


def _ends(model: StateSpace, keys: int, reverse: bool):
    """For mapInArrow over chunks: (keys, chunk, n, state) behind each from a zero start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [_parts(model.run(u[:: _order(reverse)], np.zeros(model.size, complex))[1]) for u in _lists(batch.column("us"))]
            n = pa.array([len(u) for u in _lists(batch.column("us"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: keys + 1], n, pa.array(ends, pa.list_(pa.float64()))], [*batch.schema.names[: keys + 1], "n", "state"])

    return run


def _walk(model: StateSpace, keys: list[str], sums: bool):
    """For mapInArrow over (keys, group, chunk, n, state, begin) with the rows of a group together and in order: (keys, group, n,
    state) of each group from a zero start, or (keys, chunk, start) of each row."""
    names = [*keys, "group", "n", "state"] if sums else [*keys, "chunk", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, now, state, total = None, [], None, None, 0

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            own = [schema.field(k).type for k in keys]
            types = [*own, pa.int64(), pa.int64(), pa.list_(pa.float64())] if sums else [*own, pa.int64(), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            schema = batch.schema
            for r in batch.to_pylist():
                own = (*(r[k] for k in keys), r["group"])
                if own != now:
                    if sums and now is not None:
                        out.append((*now, total, _parts(state)))
                    now, total = own, 0
                    state = np.zeros(model.size, complex) if r["begin"] is None else _whole(r["begin"])
                if not sums:
                    out.append((*own[:-1], r["chunk"], _parts(state)))
                state = model.apply(model.raised(r["n"]), state) + _whole(r["state"])
                total += r["n"]
            if out:
                yield packed(out)
                out = []
        if sums and now is not None:
            yield packed([(*now, total, _parts(state))])

    return run


def _prefix(model: StateSpace, ends: DataFrame, keys: list[str], first: DataFrame | None, reverse: bool, fanout: int) -> DataFrame:
    """(keys, chunk, start): the state each chunk starts from; `first` (keys, first) has the states of whole series' starts."""
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in ends.schema.fields if f.name in keys)
    lowest = ends.agg(F.min("chunk")).first()[0] or 0  # numbers may be negative
    own = ends.withColumn("group", F.floor((F.col("chunk") - lowest) / fanout))
    order = F.col("chunk").desc() if reverse else F.col("chunk")
    in_order = lambda df: df.select(*keys, "group", "chunk", "n", "state", "begin").repartition(*keys, "group").sortWithinPartitions(*keys, "group", order)
    none = F.lit(None).cast("array<double>").alias("begin")
    if own.agg(F.max("group")).first()[0]:
        sums = in_order(own.withColumn("begin", none)).mapInArrow(_walk(model, keys, True), f"{head}chunk long, n long, state array<double>")
        starts = _prefix(model, materialize(sums, "scan-groups"), keys, first, reverse, fanout)
        own = own.join(starts.select(*keys, F.col("chunk").alias("group"), F.col("start").alias("begin")), [*keys, "group"])
    elif first is not None:
        own = own.join(first.select(*keys, F.col("first").alias("begin")), keys, "left")
    else:
        own = own.withColumn("begin", none)
    return in_order(own).mapInArrow(_walk(model, keys, False), f"{head}chunk long, start array<double>")


def _outputs(model: StateSpace, keys: int, reverse: bool):
    """For mapInArrow over (keys, ts, us, start): (keys, t, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, part = np.array([len(u) for u in _lists(batch.column("us"))]), []
            # Chunks of a batch go out together, up to about as many steps as a chunk has.
            for i, (u, start) in enumerate(zip(_lists(batch.column("us")), _lists(batch.column("start")), strict=True)):
                part.append(model.run(u[:: _order(reverse)], _whole(start))[0][:: _order(reverse)])
                if i + 1 == len(size) or size[i + 1 - len(part) : i + 2].sum() > CHUNK:
                    at = np.arange(i + 1 - len(part), i + 1)
                    again = pa.array(np.repeat(at, size[at]))
                    ts = batch.column("ts").slice(int(at[0]), len(at)).flatten()
                    yield pa.RecordBatch.from_arrays([*[c.take(again) for c in batch.columns[:keys]], ts, pa.array(np.concatenate(part))], [*batch.schema.names[:keys], "t", "y"])
                    part = []

    return run


def linear_scan(rows: DataFrame, keys: list[str], t: str, u: str, model: StateSpace, reverse: bool = False, first: DataFrame | None = None, chunk: int = CHUNK, fanout: int = FANOUT) -> DataFrame:
    """(keys, t, y): the outputs of a state space model along each series, in the order of t or against it.

    Each row is a step, whether or not numbers are missing between them; t is unique in a series. `first` (keys, first: real, then
    imaginary parts) has states to start from; without it they are zero. An empty table gives none.
    """
    own = materialize(chunks(rows, keys, t, u, chunk), "scan-chunks")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    ends = materialize(own.mapInArrow(_ends(model, len(keys), reverse), f"{head}, chunk long, n long, state array<double>"), "scan-ends")
    starts = _prefix(model, ends, keys, first, reverse, fanout)
    both = own.join(starts, [*keys, "chunk"]).select(*keys, "ts", "us", "start")
    return both.mapInArrow(_outputs(model, len(keys), reverse), f"{head}, t long, y double")


def filter_series(rows: DataFrame, keys: list[str], t: str, u: str, sections: np.ndarray, both_ways: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(keys, t, y): a filter along each series of any length, forwards, or forwards and backwards so that nothing is delayed.

    Both ways, the ends are continued by their point reflections (up to 3 * (2 * sections + 1) samples, and one less than there
    are), and the filter starts settled on the first sample of these, as it does for a series in one array (of more than one sample).
    t runs without gaps.
    """
    from seqloom.operators.signal import settled

    model = StateSpace.of_sections(sections)
    own = rows.select(*keys, F.col(t).cast("long").alias("t"), F.col(u).cast("double").alias("u"))
    if not both_ways:
        return linear_scan(own, keys, "t", "u", model, chunk=chunk)
    most = 3 * (2 * len(sections) + 1)
    ends = own.groupBy(*keys).agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"), F.min_by("u", "t").alias("_first"), F.max_by("u", "t").alias("_last"))
    ends = ends.withColumn("_n", F.least(F.lit(most).cast("long"), F.col("_hi") - F.col("_lo")))
    near = own.join(ends, keys)
    head = near.where(F.col("t").between(F.col("_lo") + 1, F.col("_lo") + F.col("_n"))).select(*keys, (2 * F.col("_lo") - F.col("t")).alias("t"), (2 * F.col("_first") - F.col("u")).alias("u"))
    tail = near.where(F.col("t").between(F.col("_hi") - F.col("_n"), F.col("_hi") - 1)).select(*keys, (2 * F.col("_hi") - F.col("t")).alias("t"), (2 * F.col("_last") - F.col("u")).alias("u"))
    long = own.unionByName(head).unionByName(tail)
    # A settled section passes its gain on to the next one.
    gains = np.cumprod([1.0, *((b0 + b1 + b2) / (1 + a1 + a2) for b0, b1, b2, _, a1, a2 in sections)])
    rest = [float(x * g) for pair, g in zip(settled(sections), gains, strict=False) for x in pair] + [0.0]

    def start(values: DataFrame, pick) -> DataFrame:
        """The settled state, times the first sample of each series."""
        one = values.groupBy(*keys).agg(pick("u", "t").alias("_u"))
        return one.select(*keys, F.array(*[F.col("_u") * x for x in rest], *[F.lit(0.0)] * len(rest)).alias("first"))

    once = materialize(linear_scan(long, keys, "t", "u", model, first=start(long, F.min_by), chunk=chunk).withColumnRenamed("y", "u"), "filter-forwards")
    back = linear_scan(once, keys, "t", "u", model, reverse=True, first=start(once, F.max_by), chunk=chunk)
    inside = back.join(ends.select(*keys, "_lo", "_hi"), keys)
    return inside.where(F.col("t").between(F.col("_lo"), F.col("_hi"))).select(*keys, "t", "y")


def resample_series(rows: DataFrame, keys: list[str], t: str, u: str, rate: float, to: float, zeros: int = 16, chunk: int = CHUNK) -> DataFrame:
    """(keys, t, y): series of any length at another rate, as `signal.resampled` gives for arrays: floor(n * to / rate) samples,
    each a sum of those around its place under a windowed sinc.

    Samples next to a chunk's borders also go to the neighbour, so each chunk has what its places need. t runs from 0 without gaps.
    """
    scale = min(1.0, to / rate)
    half = zeros / scale
    own = rows.select(*keys, F.col(t).cast("long").alias("t"), F.col(u).cast("double").alias("u"))
    lengths = own.groupBy(*keys).agg(F.count("*").alias("_n"))
    reach = int(np.ceil(half)) + 1
    homes = F.sequence(F.floor((F.col("t") - reach) / chunk), F.floor((F.col("t") + reach) / chunk))
    spread = own.withColumn("chunk", F.explode(homes)).where(F.col("chunk") >= 0)
    packed = F.array_sort(F.collect_list(F.struct("t", "u")))
    own = spread.groupBy(*keys, "chunk").agg(packed.alias("_p")).join(lengths, keys)
    own = own.select(*keys, "chunk", "_n", F.col("_p")[0]["t"].alias("first"), F.transform("_p", lambda x: x["u"]).alias("us"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(_lists(batch.column("us"))):
                c, n, first = (batch.column(k)[i].as_py() for k in ("chunk", "_n", "first"))
                lo, hi = int(np.ceil(c * chunk * to / rate - 1e-9)), int(np.ceil((c + 1) * chunk * to / rate - 1e-9))
                j = np.arange(lo, min(hi, int(np.floor(n * to / rate))))
                y = np.empty(len(j))
                for a in range(0, len(j), 4096):
                    at = j[a : a + 4096] * rate / to
                    near = np.floor(at).astype(np.int64)[:, None] + np.arange(-reach, reach + 1)
                    far = at[:, None] - near
                    weight = scale * np.sinc(far * scale) * (0.5 + 0.5 * np.cos(far * (np.pi / half)))
                    inside = (near >= 0) & (near < n) & (np.abs(far) <= half)
                    y[a : a + 4096] = np.where(inside, weight * x[np.clip(near - first, 0, len(x) - 1)], 0.0).sum(axis=1)
                again = pa.array(np.full(len(j), i))
                yield pa.RecordBatch.from_arrays([*[col.take(again) for col in batch.columns[: len(keys)]], pa.array(j), pa.array(y)], [*keys, "t", "y"])

    return own.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", t long, y double")
