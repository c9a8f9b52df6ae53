"""Histograms, thresholds from them, summed areas and statistics: group-bys and running windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(px: DataFrame) -> DataFrame:
    """image_id, c, bin 0..255, n: counts by value first, then bins without samples from one map a plane."""
    counts = px.groupBy("image_id", "c", "v").agg(F.count("*").alias("n"))
    maps = counts.groupBy("image_id", "c").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("m"))
    bins = maps.select("image_id", "c", "m", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("bin"))
    return bins.select("image_id", "c", "bin", F.coalesce(F.element_at("m", F.col("bin")), F.lit(0).cast("long")).alias("n"))


def histogram_cdf(px: DataFrame) -> DataFrame:
    order = W.partitionBy("image_id", "c").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    return histogram(px).withColumn("cdf", F.sum("n").over(order))


def otsu(px: DataFrame) -> DataFrame:
    """image_id, threshold: the first bin with the greatest variance between the classes; 0 for constant images."""
    bins = px.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    image = W.partitionBy("image_id")
    order = image.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    moment = F.col("v").cast("long") * F.col("n")
    # only bins with samples matter: the variance of an empty one is that of the one before
    bins = bins.select("image_id", "v", F.sum("n").over(order).alias("wb"), F.sum("n").over(image).alias("total"), F.sum(moment).over(order).alias("sb"), F.sum(moment).over(image).alias("s"))
    wf = F.col("total") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / wf
    scored = bins.select("image_id", "v", F.when(wf > 0, F.col("wb").cast("double") * wf.cast("double") * gap * gap).otherwise(F.lit(0.0)).alias("var"))
    best = scored.groupBy("image_id").agg(F.max(F.struct("var", (-F.col("v")).alias("m"))).alias("b"))
    return best.select("image_id", F.when(F.col("b.var") > 0, -F.col("b.m")).otherwise(F.lit(0)).cast("int").alias("threshold"))


def otsu_binarize(px: DataFrame) -> DataFrame:
    """image_id, threshold, n_fg: samples above it."""
    found = otsu(px)
    return px.join(found, "image_id").groupBy("image_id", "threshold").agg(F.count(F.when(F.col("v") > F.col("threshold"), 1)).alias("n_fg"))


def equalize_lut(px: DataFrame) -> DataFrame:
    """image_id, c, v, lut for the values that occur."""
    counts = px.groupBy("image_id", "c", "v").agg(F.count("*").alias("n"))
    plane = W.partitionBy("image_id", "c")
    cdf = F.sum("n").over(plane.orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    out = counts.select("image_id", "c", "v", cdf.alias("cdf"), F.sum("n").over(plane).alias("total"))
    least = F.min("cdf").over(plane)
    out = out.withColumn("least", least)
    value = F.floor((F.col("cdf") - F.col("least")) / (F.col("total") - F.col("least")) * 255.0 + 0.5)
    return out.select("image_id", "c", "v", F.when(F.col("total") > F.col("least"), value).otherwise(F.lit(0)).cast("int").alias("lut"))


def equalize(px: DataFrame) -> DataFrame:
    """Histogram equalisation; constant images become 0."""
    return px.join(equalize_lut(px), ["image_id", "c", "v"]).select(*[F.col("lut").alias("v") if c == "v" else c for c in px.columns])


def integral(px: DataFrame) -> DataFrame:
    """image_id, c, y, x, s: inclusive sums from the origin, as two running sums."""
    along = W.partitionBy("image_id", "c", "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("image_id", "c", "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    rows = px.withColumn("s", F.sum(F.col("v").cast("long")).over(along))
    return rows.withColumn("s", F.sum("s").over(down)).select("image_id", "c", "y", "x", "s")


def integral_sum(px: DataFrame, rects: list[tuple[int, int, int, int]]) -> DataFrame:
    """image_id, rect, s: sums over inclusive corners (x0, y0, x1, y1), clamped to the image first.

    Corners are clamped, so a rectangle is a sum of conditions over one pass; no summed-area table is shuffled.
    """
    sums = []
    for k, (x0, y0, x1, y1) in enumerate(rects):
        clamp = lambda at, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, F.lit(at)))
        ax, ay, bx, by = clamp(x0, "w"), clamp(y0, "h"), clamp(x1, "w"), clamp(y1, "h")
        inside = (F.col("x") >= ax) & (F.col("x") <= bx) & (F.col("y") >= ay) & (F.col("y") <= by)
        sums.append(F.sum(F.when(inside, F.col("v").cast("long")).otherwise(F.lit(0).cast("long"))).alias(f"s{k}"))
    wide = px.groupBy("image_id").agg(*sums)
    entries = F.array(*[F.struct(F.lit(k).alias("rect"), F.col(f"s{k}").alias("s")) for k in range(len(rects))])
    return wide.select("image_id", F.explode(entries).alias("e")).select("image_id", "e.rect", "e.s")


def image_stats(px: DataFrame) -> DataFrame:
    """image_id, c, n, total, least, most, mean."""
    return px.groupBy("image_id", "c").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), (F.sum("v") / F.count("*")).alias("mean"))


def normalize_max(px: DataFrame) -> DataFrame:
    """v / max * 255, rounded, for each image plane; planes of zeros stay."""
    top = F.max("v").over(W.partitionBy("image_id", "c"))
    value = F.floor(F.col("v") / F.col("__top") * 255.0 + 0.5)
    return px.withColumn("__top", top).withColumn("v", F.when(F.col("__top") > 0, value).otherwise(F.lit(0)).cast("int")).drop("__top")
