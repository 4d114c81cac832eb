"""Sequence kernels as array expressions: sums over poles, rescaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cauchy_parts(vr: Column, vi: Column, wr: Column, wi: Column, zr: Column, zi: Column) -> tuple[Column, Column]:
    """Real and imaginary part of v / (z - w)."""
    dr, di = zr - wr, zi - wi
    norm = dr * dr + di * di
    return (vr * dr + vi * di) / norm, (vi * dr - vr * di) / norm


def rescale_linear(x: Column, n: int, to: int) -> Column:
    """An array of n values at `to` evenly spaced places from its first to its last, linearly interpolated."""
    step = (n - 1) / (to - 1)

    def at(i: Column) -> Column:
        place = i * F.lit(n - 1) / F.lit(float(to - 1))
        lo = F.floor(place)
        w = place - lo
        return F.get(x, lo.cast("int")) * (1 - w) + F.get(x, F.least(lo + 1, F.lit(n - 1)).cast("int")) * w

    return F.transform(F.sequence(F.lit(0), F.lit(to - 1)), at) if step else F.array_repeat(x[0], to)


def rescale_mask(mask: Column, rate: int, to: int) -> Column:
    """A mask at another rate: the value at the nearest old position (half to even, kept inside the array)."""
    n = F.floor(F.size(mask) * to / float(rate)).cast("int")
    picked = lambda i: F.get(mask, F.least(F.rint(i * rate / float(to)).cast("int"), F.size(mask) - 1))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), picked)).otherwise(F.slice(mask, 1, 0))
