"""Fixed-point kernels and border maps, computed while the plan is built."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Border, check

ONE = 1 << 15


def f32(x: float) -> float:
    """Rounds to single precision."""
    return struct.unpack("f", struct.pack("f", x))[0]


def q15(kernel: list[float]) -> list[int]:
    """Weights in 1/32768, halves away from zero; a sum that is neither 0 nor 1 is made 1 at the centre."""
    out = [int(f32(k) * ONE + (0.5 if k >= 0 else -0.5)) for k in kernel]
    if sum(out) not in (0, ONE):
        out[len(out) // 2] += ONE - sum(out)
    return out


def gaussian_size(k: int, sigma: float) -> tuple[int, float]:
    """Defaults: size from sigma, sigma from size."""
    if k <= 0:
        check(sigma > 0, "either size or sigma must be given")
        k = int(6 * sigma + 1) | 1
    if sigma <= 0:
        sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    k = k if k % 2 else k + 1
    check(k <= 65, "kernel size is at most 65")
    return k, sigma


def gaussian(k: int, sigma: float) -> list[int]:
    """Q15 weights that sum to one; the rounding error goes to the centre."""
    half = k // 2
    raw = [math.exp(-0.5 * (i - half) ** 2 / (sigma * sigma)) for i in range(k)]
    total = sum(raw)
    out = [int(r / total * ONE + 0.5) for r in raw]
    out[half] += ONE - sum(out)
    return out


def box_inverse(k: int) -> int:
    """1 / k in 1/2**20."""
    return ((1 << 20) + k // 2) // k


def cubic(t: Column) -> Column:
    """The Catmull-Rom kernel (a = -0.5)."""
    a = F.abs(t)
    return F.when(a < 1, 1.5 * a * a * a - 2.5 * a * a + 1.0).when(a < 2, -0.5 * a * a * a + 2.5 * a * a - 4.0 * a + 2.0).otherwise(F.lit(0.0))


def mapped(i: Column, n: Column, border: Border) -> Column:
    """The index that stands for i on an axis of length n; null for zeros outside."""
    low, high = F.lit(0), n - 1
    if border is Border.REPLICATE:
        return F.greatest(low, F.least(high, i))
    if border is Border.REFLECT:  # the edge sample repeats
        return F.greatest(low, F.least(high, F.when(i < 0, -i - 1).when(i >= n, 2 * n - i - 1).otherwise(i)))
    if border is Border.WRAP:
        return F.pmod(i, n)
    return F.when((i >= 0) & (i < n), i)


def mapped_index(i: int, n: int, border: Border) -> int | None:
    """The same on the driver."""
    if border is Border.REPLICATE:
        return max(0, min(n - 1, i))
    if border is Border.REFLECT:
        return max(0, min(n - 1, -i - 1 if i < 0 else 2 * n - i - 1 if i >= n else i))
    if border is Border.WRAP:
        return i % n
    return i if 0 <= i < n else None
