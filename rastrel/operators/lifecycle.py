"""Making, copying, cutting and reading images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Depth, check


def create(spark: SparkSession, width: int, height: int, channels: int = 1, images: int = 1, value: int = 0) -> DataFrame:
    """Images of one value; made by executors from a range."""
    check(width > 0 and height > 0, "width and height must be positive")
    check(1 <= channels <= 4, "channels must be 1 to 4")
    n = spark.range(images * width * height * channels).select(F.col("id").alias("i"))
    part = lambda a, b: F.expr(f"cast(i div {a} % {b} as int)")
    return n.select(F.expr(f"cast(i div {width * height * channels} as long)").alias("image_id"), F.lit(width).alias("w"), F.lit(height).alias("h"), part(width * channels, height).alias("y"), part(channels, width).alias("x"), part(1, channels).alias("c"), F.lit(value).alias("v"))


def view(px: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """A region, cut at the image's edges. One that begins beyond the right or lower edge is the last column or row strip; one that ends before the image is an error."""
    check(width > 0 and height > 0 and x + width > 0 and y + height > 0, "the region lies outside the image")
    first = lambda at, n: F.least(F.lit(max(0, at)), F.col(n) - 1)
    last = lambda at, size, n, start: F.greatest(F.least(F.lit(at + size), F.col(n)), start + 1)
    x0, y0 = first(x, "w"), first(y, "h")
    x1, y1 = last(x, width, "w", x0), last(y, height, "h", y0)
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    new = {"w": x1 - x0, "h": y1 - y0, "x": F.col("x") - x0, "y": F.col("y") - y0}
    return px.where(inside).select(*[new[c].cast("int").alias(c) if c in new else c for c in px.columns])


crop = view


def clone(px: DataFrame) -> DataFrame:
    """Frames don't change, so a clone is the frame."""
    return px


def copy(px: DataFrame, into: DataFrame) -> DataFrame:
    """``into``'s images with ``px``'s samples; images that differ in size or channels are an error."""
    from .pointwise import both

    return both(into, px, F.col("__u"))


def fill(px: DataFrame, value: int) -> DataFrame:
    check(0 <= value <= 255, "value must be 0 to 255")
    return px.withColumn("v", F.lit(value))


def zero(px: DataFrame) -> DataFrame:
    return px.withColumn("v", F.lit(0).cast(px.schema["v"].dataType))


def get(px: DataFrame, x: int, y: int, c: int = 0) -> DataFrame:
    """image_id and v of one sample of each image."""
    return px.where((F.col("x") == x) & (F.col("y") == y) & (F.col("c") == c)).select("image_id", "v")


def put(px: DataFrame, x: int, y: int, c: int, value: float) -> DataFrame:
    here = (F.col("x") == x) & (F.col("y") == y) & (F.col("c") == c)
    return px.withColumn("v", F.when(here, F.lit(value).cast(px.schema["v"].dataType)).otherwise(F.col("v")))


def overlay(px: DataFrame, samples: DataFrame) -> DataFrame:
    """Replaces the samples that ``samples`` (image_id, y, x, c, v) has."""
    new = samples.select("image_id", "y", "x", "c", F.col("v").alias("__n"))
    return px.join(new, ["image_id", "y", "x", "c"], "left").select(*[F.coalesce("__n", "v").alias("v") if c == "v" else c for c in px.columns])


def offset(channels: int, depth: str = "u8"):
    """The place of a sample's first byte in its image's buffer, whose rows follow each other without gaps."""
    return ((F.col("y") * F.col("w") + F.col("x")) * channels + F.col("c")) * Depth(depth).size


def buffer_size(width: int, height: int, channels: int, depth: str = "u8") -> int:
    return width * height * channels * Depth(depth).size
