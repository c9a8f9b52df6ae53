"""Schemas, enumerations, errors and argument checks.

An image is either a row of ``images`` (metadata and packed samples) or rows of
``pixels``: image_id, w, h, y, x, c, v. ``w`` and ``h`` travel with every
sample, so images of any sizes share a frame and borders need no extra join.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGES = "image_id long, width int, height int, channels int, depth string, data binary"
PIXELS = "image_id long, w int, h int, y int, x int, c int, v int"
KEY = ["image_id", "y", "x", "c"]


class Depth(Enum):
    U8, U16, F32 = "u8", "u16", "f32"

    @property
    def size(self) -> int:
        return {"u8": 1, "u16": 2, "f32": 4}[self.value]


class Interp(Enum):
    NEAREST, BILINEAR, BICUBIC = "nearest", "bilinear", "bicubic"


class Border(Enum):
    ZERO, REPLICATE, REFLECT, WRAP = "zero", "replicate", "reflect", "wrap"


class Threshold(Enum):
    BINARY, BINARY_INV, TRUNC, TOZERO, OTSU = "binary", "binary_inv", "trunc", "tozero", "otsu"


class Rotation(Enum):
    CW, CCW, HALF = "cw", "ccw", "half"


class RasterError(ValueError):
    """Base of all argument errors."""


class InvalidArgument(RasterError):
    pass


class SizeMismatch(RasterError):
    pass


class Unsupported(RasterError):
    pass


class FormatError(RasterError):
    pass


class Overflow(RasterError):
    pass


_TEXT = {InvalidArgument: "invalid argument", SizeMismatch: "images differ in size, channels or depth", Unsupported: "unsupported operation", FormatError: "malformed image file", Overflow: "buffer too small"}


def describe(error: type[RasterError] | RasterError) -> str:
    """The text of an error's kind."""
    kind = error if isinstance(error, type) else type(error)
    return _TEXT.get(kind, "error")


def check(condition: bool, message: str, kind: type[RasterError] = InvalidArgument) -> None:
    if not condition:
        raise kind(message)


def odd(k: int) -> int:
    """Even kernel sizes count as the next odd one."""
    check(k >= 1, "kernel size must be at least 1")
    return k if k % 2 else k + 1


def gray(px: DataFrame) -> DataFrame:
    """For operators on one channel: fails on data that have others."""
    return px.withColumn("c", F.when(F.col("c") == 0, F.col("c")).otherwise(F.raise_error(F.lit("one channel is expected")).cast("int")))


def bare(px: DataFrame) -> DataFrame:
    """The canonical relational form: image_id, y, x, c, v."""
    return px.select(*KEY, "v")


def sized(px: DataFrame) -> DataFrame:
    """Adds w and h to frames that come without them (one aggregate, one join)."""
    if {"w", "h"} <= set(px.columns):
        return px
    size = px.groupBy("image_id").agg((F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"))
    return px.join(size, "image_id").select("image_id", "w", "h", "y", "x", "c", "v")


#: Bytes of input for each partition that whole images are dealt to.
DEALT = 2 << 20


def _parts(px: DataFrame) -> int | None:
    """Partitions in proportion to the tables a frame is read from; None where Spark doesn't know their size."""
    if px.isStreaming:
        return None
    leaves = px._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    unknown = px.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes()
    return None if max(sizes, default=unknown) >= unknown else max(1, -(-sum(sizes) // DEALT))


def layout(px: DataFrame) -> DataFrame:
    """Deals whole images once; row and column windows of all later stencils then need no further exchange. The number of
    partitions grows with the input, as the sorts of many windows stand in one task: Spark's own would put 64 MB of
    shuffled samples, which are some millions, in each."""
    n = _parts(px)
    return px.repartition(n, "image_id") if n else px.repartition("image_id")
