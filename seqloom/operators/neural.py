"""Row-wise tensor functions in numpy behind Arrow: state space kernels, a trace denoiser, generation.

Weights are arrays of a fixed size and are broadcast. Each sequence is independent, so all of this is one map without a shuffle;
the steps of a sampler are a loop inside the map.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.columns import clip, denormalize, nearest, quantize


def hippo_legs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The state matrix and input vector that memorise a history in scaled Legendre polynomials."""
    root = np.sqrt(2 * np.arange(n) + 1.0)
    a = -np.tril(np.outer(root, root), -1) - np.diag(np.arange(n) + 1.0)
    return a, root.copy()


def bilinear(a: np.ndarray, b: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Discrete form of x' = a x + b u by the trapezoidal rule."""
    left = np.eye(len(a)) - dt / 2 * a
    return np.linalg.solve(left, np.eye(len(a)) + dt / 2 * a), np.linalg.solve(left, dt * b)


def krylov_kernel(a: np.ndarray, b: np.ndarray, c: np.ndarray, length: int) -> np.ndarray:
    """c b, c a b, c a a b, ...: powers are doubled, so it takes log2(length) products of matrices."""
    block, power = b[:, None], a
    while block.shape[1] < length:
        block = np.concatenate([block, power @ block], axis=1)
        power = power @ power
    return c @ block[:, :length]


def fft_conv(u: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Causal convolution along the last axis, by transforms of twice the length."""
    n = u.shape[-1]
    return np.fft.irfft(np.fft.rfft(u, 2 * n) * np.fft.rfft(kernel, 2 * n), 2 * n)[..., :n]


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def layer_norm(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5)


@dataclass
class TraceDenoiser:
    """Predicts the noise in a batch of sequences: a step embedding, residual blocks of a linear state space scan and a wider
    hidden layer, and a projection."""

    steps: int
    d_model: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    layers: int = 2

    @staticmethod
    def initial(d_model: int = 16, layers: int = 2, steps: int = 200, seed: int = 0) -> TraceDenoiser:
        """Random weights; a trained set of the same shapes takes their place."""
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
        w = {"in": draw(1, d_model), "out": draw(d_model, 1), "time1": draw(d_model, d_model), "time2": draw(d_model, d_model)}
        for i in range(layers):
            w |= {f"a{i}": np.exp(-np.exp(rng.normal(-2, 0.5, d_model))), f"b{i}": draw(d_model, d_model), f"c{i}": draw(d_model, d_model), f"d{i}": rng.normal(0, 1, d_model), f"f{i}": draw(d_model, 4 * d_model), f"g{i}": draw(4 * d_model, d_model)}
        return TraceDenoiser(steps, d_model, w, layers)

    def saved(self) -> bytes:
        """The model as an .npz archive."""
        out = io.BytesIO()
        np.savez_compressed(out, steps=self.steps, d_model=self.d_model, layers=self.layers, **{f"w_{k}": v for k, v in self.weights.items()})
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> TraceDenoiser:
        """A model from an .npz archive; a missing weight or a wrong shape is an error that names it."""
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            out = TraceDenoiser(int(z["steps"]), int(z["d_model"]), {k[2:]: z[k] for k in z.files if k.startswith("w_")}, int(z["layers"]))
        for name, own in TraceDenoiser.initial(out.d_model, out.layers, out.steps).weights.items():
            if name not in out.weights or out.weights[name].shape != own.shape:
                raise ValueError(f"no weight {name} of shape {own.shape}")
        return out

    def embed(self, k: np.ndarray) -> np.ndarray:
        half = self.d_model // 2
        arg = k[:, None] * np.exp(-np.log(10000.0) * np.arange(half) / max(half - 1, 1))
        out = np.concatenate([np.sin(arg), np.cos(arg)], axis=1)
        return np.pad(out, ((0, 0), (0, self.d_model - out.shape[1])))

    def __call__(self, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Noise for x (batch, length) at steps k (batch)."""
        w = self.weights
        h = x[:, :, None] @ w["in"] + (gelu(self.embed(k) @ w["time1"]) @ w["time2"])[:, None, :]
        for i in range(self.layers):
            u, s, outs = h @ w[f"b{i}"], np.zeros((len(x), self.d_model)), []
            for t in range(x.shape[1]):
                s = w[f"a{i}"] * s + u[:, t]
                outs.append(s)
            y = np.stack(outs, axis=1) @ w[f"c{i}"] + w[f"d{i}"] * h
            h = layer_norm(h + y)
            h = layer_norm(h + gelu(h @ w[f"f{i}"]) @ w[f"g{i}"])
        return (h @ w["out"])[:, :, 0]


def linear_schedule(steps: int, first: float = 1e-4, last: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """beta, alpha and the running product of alpha."""
    beta = np.linspace(first, last, steps)
    return beta, 1 - beta, np.cumprod(1 - beta)


def sample(net: TraceDenoiser, n: int, length: int, rng: list[np.random.Generator]) -> np.ndarray:
    """n sequences from noise: at each step the start is predicted, the direction of the step before added, and noise of the
    size of beta. Each sequence has a generator of its own, so it does not depend on its neighbours."""
    beta, _, bar = linear_schedule(net.steps)
    x = np.stack([g.standard_normal(length) for g in rng]) if n else np.zeros((0, length))
    for k in range(net.steps - 1, -1, -1):
        eps = net(x, np.full(n, k))
        before = bar[k - 1] if k else 1.0
        x = np.sqrt(before) * (x - np.sqrt(1 - bar[k]) * eps) / np.sqrt(bar[k]) + np.sqrt(1 - before) * eps
        if k:
            x += np.sqrt(beta[k]) * np.stack([g.standard_normal(length) for g in rng])
    return x


def impute(net: TraceDenoiser, values: np.ndarray, keep: np.ndarray, rng: list[np.random.Generator]) -> np.ndarray:
    """Values with the cells that are not kept sampled; kept ones condition every step and come back unchanged."""
    beta, alpha, bar = linear_schedule(net.steps)
    x = np.stack([g.standard_normal(values.shape[1]) for g in rng])
    for k in range(net.steps - 1, -1, -1):
        x = np.where(keep == 1, values, x)
        eps = net(x, np.full(len(x), k))
        x = (x - (1 - alpha[k]) / np.sqrt(1 - bar[k]) * eps) / np.sqrt(alpha[k])
        if k:
            post = beta[k] * (1 - bar[k - 1]) / (1 - bar[k])
            x += np.sqrt(post) * np.stack([g.standard_normal(values.shape[1]) for g in rng])
    return np.where(keep == 1, values, x)


def denoise(rows: DataFrame, net: TraceDenoiser) -> DataFrame:
    """(user_id, st, x, k) rows with `eps`, the noise predicted for x at step k; batches of equal length go together."""
    shipped = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.asarray(v.values, np.float64) for v in batch.column(2)]
            k = np.asarray(batch.column(3))
            out: list = [None] * len(x)
            for n in {len(v) for v in x}:
                at = [i for i, v in enumerate(x) if len(v) == n]
                for i, e in zip(at, shipped.value(np.stack([x[i] for i in at]), k[at]), strict=True):
                    out[i] = e
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], ["user_id", "st", "eps"])

    return rows.select("user_id", "st", "x", "k").mapInArrow(run, "user_id long, st long, eps array<double>")


def generate(spark: SparkSession, n: int, length: int, net: TraceDenoiser, ids: DataFrame, seed: int = 0) -> DataFrame:
    """(sample, seq): n generated sequences, brought to the scale of the ids, rounded, clipped and set to the nearest id.

    `ids` is one row with the sorted array of ids in use.
    """
    shipped = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            x = sample(shipped.value, len(own), length, [np.random.default_rng([seed, i]) for i in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["sample", "x"])

    raw = spark.range(n).withColumnRenamed("id", "sample").mapInArrow(run, "sample long, x array<double>").crossJoin(F.broadcast(ids))  # one row of ids
    lo, hi = F.array_min("ids").cast("double"), F.array_max("ids").cast("double")
    unit = lambda v: (F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0)) + 1) / 2
    fix = lambda v: nearest(clip(quantize(denormalize(unit(v), lo, hi)), lo.cast("int"), hi.cast("int")), F.col("ids"))
    return raw.select("sample", F.transform("x", fix).alias("seq"))
