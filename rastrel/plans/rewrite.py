"""Rewrites that Catalyst can't make: fused remaps, tables and morphology, and regions pushed below stencils."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import check
from ..operators import pointwise, stencil


@dataclass(frozen=True)
class Remap:
    """A signed permutation of the axes; composing keeps it one projection.

    Target x is ``w' - 1 - s`` or ``s`` for s the source axis ``swap`` picks.
    """

    swap: bool = False
    mirror_x: bool = False
    mirror_y: bool = False

    def flip_h(self) -> Remap:
        return Remap(self.swap, not self.mirror_x, self.mirror_y)

    def flip_v(self) -> Remap:
        return Remap(self.swap, self.mirror_x, not self.mirror_y)

    def transpose(self) -> Remap:
        return Remap(not self.swap, self.mirror_y, self.mirror_x)

    def rotate_cw(self) -> Remap:
        return self.transpose().flip_h()

    def rotate_ccw(self) -> Remap:
        return self.transpose().flip_v()

    def rotate_180(self) -> Remap:
        return self.flip_h().flip_v()

    def apply(self, px: DataFrame) -> DataFrame:
        x, y, w, h = ("y", "x", "h", "w") if self.swap else ("x", "y", "w", "h")
        new = {"w": F.col(w), "h": F.col(h), "x": F.col(w) - 1 - F.col(x) if self.mirror_x else F.col(x), "y": F.col(h) - 1 - F.col(y) if self.mirror_y else F.col(y)}
        return px.select(*[new[c].cast("int").alias(c) if c in new else c for c in px.columns])


@dataclass(frozen=True)
class Tables:
    """A chain of unary operators on u8 samples as one table of 256 values."""

    values: tuple[int, ...] = tuple(range(256))

    def then(self, f: Callable[[int], int]) -> Tables:
        return Tables(tuple(max(0, min(255, int(f(v)))) for v in self.values))

    def scale(self, factor: float) -> Tables:
        s = max(0, min(65535, int(factor * 256 + 0.5)))
        return self.then(lambda v: v * s >> 8)

    def threshold(self, t: int, high: int = 255) -> Tables:
        return self.then(lambda v: high if v > t else 0)

    def invert(self) -> Tables:
        return self.then(lambda v: 255 - v)

    def apply(self, px: DataFrame) -> DataFrame:
        return pointwise.apply_lut(px, list(self.values))


def erode_all(px: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """Erosions one after the other are one by the sum of their reaches."""
    check(bool(sizes), "sizes must be given")
    return stencil.erode(px, 1 + 2 * sum(kw // 2 for kw, _ in sizes), 1 + 2 * sum(kh // 2 for _, kh in sizes))


def region(px: DataFrame, x: int, y: int, width: int, height: int, reach: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` (a stencil that reaches ``reach`` samples) on a region alone.

    The region and its halo are cut below the stencil; coordinates and sizes
    stay those of the whole image, so true edges still repeat, and the halo's
    own edges are cut off afterwards.
    """
    near = lambda c, at, size, r: F.col(c).between(at - r, at + size - 1 + r)
    some = px.where(near("x", x, width, reach) & near("y", y, height, reach))
    return work(some).where(near("x", x, width, 0) & near("y", y, height, 0))
