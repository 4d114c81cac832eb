"""Building blocks of the imputers in numpy, and an imputer over DataFrames.

Forward passes only: weights are arrays of fixed sizes that are given (or random), and are broadcast. A sample is one row, so
the work is a map without a shuffle, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom.operators.neural import gelu, layer_norm, linear_schedule


def nplr_legs(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues w, low-rank part p, input b and basis v of the scaled Legendre memory: its matrix is v (diag(w) - p p*) v*."""
    root = np.sqrt(2 * np.arange(n) + 1.0)
    a = -np.tril(np.outer(root, root), -1) - np.diag(np.arange(n) + 1.0)
    p = np.sqrt(np.arange(n) + 0.5)
    normal = a + np.outer(p, p)
    w_im, v = np.linalg.eigh((normal - normal.T) / 2 * -1j)
    w = np.mean(np.diagonal(normal)) + 1j * w_im
    return w, v.conj().T @ p.astype(complex), v.conj().T @ root.astype(complex), v


def cauchy(v: np.ndarray, z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum over poles of v / (z - w), at all nodes z; v may have leading axes."""
    return np.einsum("...n,ln->...l", v, 1.0 / (z[:, None] - w[None, :]))


def nplr_kernel(w: np.ndarray, p: np.ndarray, b: np.ndarray, c: np.ndarray, dt: float, length: int) -> np.ndarray:
    """The convolution kernel of a diagonal plus low-rank system (bilinear, step dt): its generating function at the roots of
    unity by sums over poles and a rank-one correction, then an inverse transform. `c` is what remains of the output vector
    after the truncation at `length` (see `truncated`)."""
    omega = np.exp(-2j * np.pi * np.arange(length) / length)
    omega[np.abs(1 + omega) < 1e-12] += 1e-9
    z = 2 / dt * (1 - omega) / (1 + omega)
    q = p.conj()
    k00, k01 = cauchy(c * b, z, w), cauchy(c * p, z, w)
    k10, k11 = cauchy(q * b, z, w), cauchy(q * p, z, w)
    return np.fft.ifft(2 / (1 + omega) * (k00 - k01 * k10 / (1 + k11))).real


def truncated(c: np.ndarray, step: np.ndarray, length: int) -> np.ndarray:
    """c (1 - step**length): a kernel of finite length from the one without an end."""
    return c @ (np.eye(len(step)) - np.linalg.matrix_power(step, length))


def dilated_conv(x: np.ndarray, kernel: np.ndarray, dilation: int) -> np.ndarray:
    """Same-length convolution of (batch, length, in) with (taps, in, out), taps `dilation` apart and centred."""
    taps = len(kernel)
    pad = dilation * (taps // 2)
    wide = np.pad(x, ((0, 0), (pad, pad), (0, 0)))
    return sum(wide[:, i * dilation : i * dilation + x.shape[1]] @ kernel[i] for i in range(taps))


def gated_residual(x: np.ndarray, step: np.ndarray, cond: np.ndarray, w: dict[str, np.ndarray], dilation: int) -> tuple[np.ndarray, np.ndarray]:
    """A residual layer: step embedding added, dilated convolution and conditioning, tanh gated by a sigmoid; (next, skip)."""
    h = dilated_conv(x + (step @ w["step"])[:, None, :], w["conv"], dilation) + cond @ w["cond"]
    a, b = np.split(h, 2, axis=-1)
    g = np.tanh(a) / (1 + np.exp(-b))
    return (x + g @ w["res"]) / np.sqrt(2), g @ w["skip"]


def down_pool(x: np.ndarray, pool: int) -> np.ndarray:
    """(batch, length, channels) with `pool` neighbours side by side."""
    n, length, ch = x.shape
    return x.reshape(n, length // pool, pool * ch)


def up_pool(x: np.ndarray, pool: int) -> np.ndarray:
    """The inverse, shifted by one so that no output sees its own future."""
    shifted = np.pad(x, ((0, 0), (1, 0), (0, 0)))[:, :-1]
    n, length, ch = x.shape
    return shifted.reshape(n, length * pool, ch // pool)


def attention(x: np.ndarray, w: dict[str, np.ndarray], heads: int) -> np.ndarray:
    """A transformer layer over the second axis: attention and a wider hidden layer, each with a residual and a norm."""
    n, length, dim = x.shape
    split = lambda y: y.reshape(n, length, heads, dim // heads).transpose(0, 2, 1, 3)
    q, k, v = (split(x @ w[name]) for name in ("q", "k", "v"))
    s = q @ k.transpose(0, 1, 3, 2) / np.sqrt(dim // heads)
    s = np.exp(s - s.max(axis=-1, keepdims=True))
    y = (s / s.sum(axis=-1, keepdims=True) @ v).transpose(0, 2, 1, 3).reshape(n, length, dim)
    h = layer_norm(x + y @ w["o"])
    return layer_norm(h + gelu(h @ w["f"]) @ w["g"])


def parameter_count(net: object) -> int:
    """Numbers in all arrays that a network holds, however nested."""
    if isinstance(net, np.ndarray):
        return net.size
    inside = net.values() if isinstance(net, dict) else net if isinstance(net, list | tuple) else vars(net).values() if hasattr(net, "__dict__") else ()
    return sum(parameter_count(x) for x in inside)


def random_weights(shapes: dict[str, tuple[int, ...]], seed: int = 0) -> dict[str, np.ndarray]:
    """Weights of given shapes, scaled by their inputs."""
    rng = np.random.default_rng(seed)
    return {k: rng.normal(0, np.prod(s[:-1]) ** -0.5, s) for k, s in shapes.items()}


class GatedImputer:
    """Noise prediction for (batch, length, channels) by a stack of gated dilated layers, conditioned on known values and the
    mask (1 known)."""

    def __init__(self, channels: int, hidden: int = 16, layers: int = 4, steps: int = 50, cycle: int = 4, seed: int = 0) -> None:
        self.steps, self.layers, self.cycle, self.hidden = steps, layers, cycle, hidden
        self.outer = random_weights({"in": (channels, hidden), "out1": (hidden, hidden), "out2": (hidden, channels)}, seed)
        shapes = {"step": (hidden, hidden), "conv": (3, hidden, 2 * hidden), "cond": (2 * channels, 2 * hidden), "res": (hidden, hidden), "skip": (hidden, hidden)}
        self.inner = [random_weights(shapes, seed + 1 + i) for i in range(layers)]

    def __call__(self, x: np.ndarray, known: np.ndarray, mask: np.ndarray, k: np.ndarray) -> np.ndarray:
        half = self.hidden // 2
        arg = k[:, None] * np.exp(-np.log(10000.0) * np.arange(half) / max(half - 1, 1))
        step = np.concatenate([np.sin(arg), np.cos(arg)], axis=1)
        cond = np.concatenate([known * mask, mask], axis=-1)
        h, total = np.maximum(x @ self.outer["in"], 0), 0.0
        for i, w in enumerate(self.inner):
            h, skip = gated_residual(h, step, cond, w, 2 ** (i % self.cycle))
            total = total + skip
        return np.maximum(total / np.sqrt(self.layers) @ self.outer["out1"], 0) @ self.outer["out2"]

    def impute(self, values: np.ndarray, mask: np.ndarray, rngs: list[np.random.Generator]) -> np.ndarray:
        """Samples for cells that are not known; known cells come back unchanged."""
        beta, alpha, bar = linear_schedule(self.steps)
        noise = lambda: np.stack([g.standard_normal(values.shape[1:]) for g in rngs])
        x = noise()
        for k in range(self.steps - 1, -1, -1):
            x = np.where(mask == 1, values, x)
            eps = self(x, values, mask, np.full(len(x), k))
            x = (x - (1 - alpha[k]) / np.sqrt(1 - bar[k]) * eps) / np.sqrt(alpha[k])
            if k:
                x += np.sqrt(beta[k] * (1 - bar[k - 1]) / (1 - bar[k])) * noise()
        return np.where(mask == 1, values, x)


def impute(rows: DataFrame, key: str, values: str, mask: str, channels: int, net: GatedImputer | Callable, samples: int = 1, seed: int = 0) -> DataFrame:
    """(key, sample, x): `samples` imputations of each row's flat array (length times channels) with its flat mask (1 known).

    A row's noise depends on the seed, its key and the sample only.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            by: dict[int, list[int]] = {}
            flat = [np.asarray(v.values, np.float64) for v in batch.column(1)]
            keep = [np.asarray(v.values, np.float64) for v in batch.column(2)]
            for i, v in enumerate(flat):
                by.setdefault(len(v), []).append(i)
            for own in by.values():
                x = np.stack([flat[i] for i in own]).reshape(len(own), -1, channels)
                m = np.stack([keep[i] for i in own]).reshape(len(own), -1, channels)
                for s in range(samples):
                    out = shipped.value.impute(x, m, [np.random.default_rng([seed, ids[i], s]) for i in own])
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in own], pa.int64()), pa.array([s] * len(own), pa.int32()), pa.array(list(out.reshape(len(own), -1)), pa.list_(pa.float64()))], [key, "sample", "x"])

    return rows.select(key, values, mask).mapInArrow(run, f"{key} long, sample int, x array<double>")
