"""Sample-wise arithmetic, thresholds and channel conversions: projections, and one equi-join for two images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEY, Threshold, Unsupported, check
from . import aggregate

def both(a: DataFrame, b: DataFrame, value: Column) -> DataFrame:
    """a's samples with b's as __u. Images must have the same samples, or the query fails; see :func:`compatible`."""
    differ = F.raise_error(F.lit("images differ in size, channels or depth")).cast("int")
    both = a.join(b.select(*KEY, F.col("v").alias("__u")), KEY, "full")
    checked = F.when(F.col("v").isNull() | F.col("__u").isNull(), differ).otherwise(value.cast("int"))
    return both.select(*[checked.alias("v") if c == "v" else c for c in a.columns])


def compatible(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id and whether both have it with equal width, height and channels."""
    shape = lambda f: f.groupBy("image_id").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.max("c").alias("c"))
    return shape(a).alias("a").join(shape(b).alias("b"), "image_id", "full").select("image_id", F.expr("a.x <=> b.x and a.y <=> b.y and a.c <=> b.c").alias("compatible"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Saturating sum."""
    return both(a, b, F.least(F.col("v") + F.col("__u"), F.lit(255)))


def sub(a: DataFrame, b: DataFrame) -> DataFrame:
    """Saturating difference."""
    return both(a, b, F.greatest(F.col("v") - F.col("__u"), F.lit(0)))


def scale(px: DataFrame, factor: float) -> DataFrame:
    """Multiplies in 1/256; negative factors count as 0."""
    s = max(0, min(65535, int(factor * 256 + 0.5)))
    return px.withColumn("v", F.least(F.lit(255), F.shiftright(F.col("v") * s, 8)))


def blend(a: DataFrame, b: DataFrame, alpha: float) -> DataFrame:
    """alpha * a + (1 - alpha) * b in 1/256, truncated."""
    k = max(0, min(256, int(alpha * 256 + 0.5)))
    return both(a, b, F.shiftright(F.col("v") * k + F.col("__u") * (256 - k), 8))


def threshold(px: DataFrame, t: float = 0, max_value: float = 255, kind: Threshold = Threshold.BINARY) -> DataFrame:
    """Strictly above t; OTSU finds t for each image and then is BINARY."""
    high = max(0, min(255, int(max_value)))
    if kind is Threshold.OTSU:
        found = aggregate.otsu(px).withColumnRenamed("threshold", "__t")
        return px.join(found, "image_id").withColumn("v", F.when(F.col("v") > F.col("__t"), F.lit(high)).otherwise(F.lit(0))).select(*px.columns)
    low = max(0, min(255, int(t)))
    over = F.col("v") > low
    value = {
        Threshold.BINARY: F.when(over, F.lit(high)).otherwise(F.lit(0)),
        Threshold.BINARY_INV: F.when(over, F.lit(0)).otherwise(F.lit(high)),
        Threshold.TRUNC: F.least(F.col("v"), F.lit(low)),
        Threshold.TOZERO: F.when(over, F.col("v")).otherwise(F.lit(0)),
    }[kind]
    return px.withColumn("v", value)


def rgb_to_gray(px: DataFrame) -> DataFrame:
    """(77 R + 150 G + 29 B) >> 8."""
    weight = F.when(F.col("c") == 0, F.lit(77)).when(F.col("c") == 1, F.lit(150)).when(F.col("c") == 2, F.lit(29)).otherwise(F.lit(0))
    keys = [c for c in px.columns if c not in ("c", "v")]
    return px.groupBy(*keys).agg(F.sum(F.col("v") * weight).alias("s")).select(*keys, F.lit(0).alias("c"), F.shiftright("s", 8).cast("int").alias("v")).select(*px.columns)


def gray_to_rgb(px: DataFrame) -> DataFrame:
    return px.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))


def rgb_to_rgba(px: DataFrame) -> DataFrame:
    """Adds an opaque fourth channel: channel 0 is seen twice instead of the table."""
    both = F.when(F.col("c") == 0, F.array(F.struct(F.col("c").alias("c"), F.col("v").alias("v")), F.struct(F.lit(3).alias("c"), F.lit(255).alias("v")))).otherwise(F.array(F.struct(F.col("c").alias("c"), F.col("v").alias("v"))))
    rows = px.withColumn("__s", F.explode(both))
    return rows.select(*[F.col(f"__s.{c}").alias(c) if c in ("c", "v") else c for c in px.columns])


def rgba_to_rgb(px: DataFrame) -> DataFrame:
    return px.where("c < 3")


_CONVERSIONS = {(3, 1): rgb_to_gray, (1, 3): gray_to_rgb, (3, 4): rgb_to_rgba, (4, 3): rgba_to_rgb}


def convert_channels(px: DataFrame, source: int, target: int) -> DataFrame:
    check((source, target) in _CONVERSIONS, f"no conversion from {source} to {target} channels", Unsupported)
    return _CONVERSIONS[source, target](px)


def convert_depth(px: DataFrame, source: str, target: str) -> DataFrame:
    """Integers to [0, 1] and back (rounded), or between integer depths by way of it."""
    top = {"u8": 255, "u16": 65535}
    check(source in (*top, "f32") and target in (*top, "f32"), f"no conversion from {source} to {target}", Unsupported)
    unit = F.col("v").cast("double") if source == "f32" else F.col("v") / F.lit(float(top[source]))
    if target == "f32":
        return px.withColumn("v", unit)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), unit))
    return px.withColumn("v", F.floor(clamped * top[target] + 0.5).cast("int"))


def apply_lut(px: DataFrame, lut: list[int]) -> DataFrame:
    """One table for all samples, as a literal array."""
    check(len(lut) == 256, "a table has 256 entries")
    return px.withColumn("v", F.element_at(F.array(*map(F.lit, lut)), F.col("v") + 1))
