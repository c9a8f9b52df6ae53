"""Coordinate maps. Flips and turns are projections; resizing emits each source sample's targets, so it needs no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kernels import cubic
from ..model import Border, Interp, Rotation, check
from .stencil import blur_gaussian


def _moved(px: DataFrame, **new: Column) -> DataFrame:
    return px.select(*[new[c].cast("int").alias(c) if c in new else c for c in px.columns])


def flip_h(px: DataFrame) -> DataFrame:
    return _moved(px, x=F.col("w") - 1 - F.col("x"))


def flip_v(px: DataFrame) -> DataFrame:
    return _moved(px, y=F.col("h") - 1 - F.col("y"))


def rotate(px: DataFrame, turn: Rotation) -> DataFrame:
    x, y, w, h = (F.col(c) for c in "xywh")
    if turn is Rotation.CW:
        return _moved(px, x=h - 1 - y, y=x, w=h, h=w)
    if turn is Rotation.CCW:
        return _moved(px, x=y, y=w - 1 - x, w=h, h=w)
    return _moved(px, x=w - 1 - x, y=h - 1 - y)


def transpose(px: DataFrame) -> DataFrame:
    return _moved(px, x=F.col("y"), y=F.col("x"), w=F.col("h"), h=F.col("w"))


def _nearest(px: DataFrame, axis: str, n: str, size: int) -> DataFrame:
    """Target d takes source d * n div size; here source i emits its targets."""
    first = F.expr(f"cast(({axis} * cast({size} as long) + {n} - 1) div {n} as int)")
    last = F.expr(f"cast((({axis} + 1) * cast({size} as long) + {n} - 1) div {n} as int)") - 1
    targets = F.when(last >= first, F.sequence(first, last)).otherwise(F.expr("cast(array() as array<int>)"))
    out = px.withColumn("__d", F.explode(targets))
    return _moved(out.select(*px.columns, "__d"), **{axis: F.col("__d"), n: F.lit(size)})


def _linear(px: DataFrame, axis: str, n: str, size: int) -> DataFrame:
    """16.16 fixed point, corners aligned; a source sample and the next one make the targets between them."""
    other = "y" if axis == "x" else "x"
    order = W.partitionBy("image_id", "c", other).orderBy(axis)
    out = px.withColumn("__next", F.coalesce(F.lead("v", 1).over(order), F.col("v")))
    out = out.withColumn("__r", F.expr(f"(({n} - 1) * cast(65536 as long)) div {max(1, size - 1)}"))
    place = F.col(axis).cast("long") * 65536
    first = F.when(F.col("__r") > 0, F.expr(f"({axis} * cast(65536 as long) + __r - 1) div nullif(__r, 0)")).otherwise(F.lit(0).cast("long"))
    last = F.when(F.col("__r") > 0, F.least(F.lit(size - 1).cast("long"), F.expr(f"(({axis} + 1) * cast(65536 as long) + __r - 1) div nullif(__r, 0)") - 1)).otherwise(F.when(F.col(axis) == 0, F.lit(size - 1)).otherwise(F.lit(-1)).cast("long"))
    out = out.withColumns({"__f": first, "__l": last})
    targets = F.when(F.col("__l") >= F.col("__f"), F.sequence(F.col("__f"), F.col("__l"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    out = out.withColumn("__d", F.explode(targets))
    frac = F.col("__d") * F.col("__r") - place
    value = F.col("v") + F.shiftright((F.col("__next") - F.col("v")) * frac, 16)
    return out.select(*[value.cast("int").alias("v") if c == "v" else F.col("__d").cast("int").alias(axis) if c == axis else F.lit(size).alias(n) if c == n else c for c in px.columns])


def _cubic(px: DataFrame, axis: str, n: str, size: int) -> DataFrame:
    """Half-pixel centres; the four taps around a source sample make the targets whose integer place it is. Sums are not divided: their weight is multiplied into ``__total``."""
    other = "y" if axis == "x" else "x"
    order = W.partitionBy("image_id", "c", other).orderBy(axis)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edge = F.last("v").over(whole)
    out = px.withColumns({"__p0": F.coalesce(F.lag("v", 1).over(order), F.first("v").over(whole)), "__p2": F.coalesce(F.lead("v", 1).over(order), edge), "__p3": F.coalesce(F.lead("v", 2).over(order), edge)})
    scale = F.col(n).cast("double") / F.lit(float(size))
    place = lambda d: (d + 0.5) * scale - 0.5
    first = F.greatest(F.lit(0), F.floor(F.col(axis) / scale).cast("int") - 2)
    last = F.least(F.lit(size - 1), F.ceil((F.col(axis) + 2) / scale).cast("int") + 1)
    out = out.withColumn("__d", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.expr("cast(array() as array<int>)"))))
    out = out.withColumn("__f", place(F.col("__d"))).where(F.col("__f").cast("int") == F.col(axis))
    taps = [F.col("__p0"), F.col("v"), F.col("__p2"), F.col("__p3")]
    weights = [cubic(F.col("__f") - (F.col(axis) + k)) for k in (-1, 0, 1, 2)]
    value = sum((w * t for w, t in zip(weights[1:], taps[1:], strict=True)), weights[0] * taps[0])
    total = weights[0] + weights[1] + weights[2] + weights[3]
    new = {"v": value, "__total": F.col("__total") * total, axis: F.col("__d"), n: F.lit(size)}
    return out.select(*[new[c].alias(c) if c in new else c for c in px.columns])


def resize(px: DataFrame, width: int, height: int, interp: Interp = Interp.BILINEAR, depth: str = "u8") -> DataFrame:
    """Other depths than u8 are always taken from the nearest sample."""
    check(width > 0 and height > 0, "width and height must be positive")
    if depth != "u8" or interp is Interp.NEAREST:
        return _nearest(_nearest(px, "x", "w", width), "y", "h", height)
    if interp is Interp.BILINEAR:
        return _linear(_linear(px, "x", "w", width), "y", "h", height)
    sums = px.withColumns({"v": F.col("v").cast("double"), "__total": F.lit(1.0)})
    out = _cubic(_cubic(sums, "x", "w", width), "y", "h", height)
    # one division, as a quotient of each pass would be rounded by itself and miss halves
    value = F.greatest(F.lit(0), F.least(F.lit(255), (F.col("v") / F.col("__total") + 0.5).cast("int")))
    return out.select(*[value.alias("v") if c == "v" else c for c in px.columns])


def _sampled(points: DataFrame, px: DataFrame, keys: list[str]) -> DataFrame:
    """points with sx0, sx1, sy0, sy1: the four samples p00, p10, p01, p11 for each point and channel."""
    taps = F.array(*[F.struct(F.lit(k).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")) for k, (x, y) in enumerate((("sx0", "sy0"), ("sx1", "sy0"), ("sx0", "sy1"), ("sx1", "sy1")))])
    each = points.withColumn("__t", F.explode(taps)).select("image_id", *keys, F.col("__t.k").alias("k"), F.col("__t.x").alias("x"), F.col("__t.y").alias("y"))
    hit = each.join(px.select("image_id", "y", "x", "c", "v"), ["image_id", "y", "x"])
    return hit.groupBy("image_id", *keys, "c").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(name) for k, name in enumerate(("p00", "p10", "p01", "p11"))])


def affine(px: DataFrame, matrix: list[float], width: int | None = None, height: int | None = None, interp: Interp = Interp.BILINEAR, border: Border = Border.REPLICATE) -> DataFrame:
    """Target (x, y) takes source (m0 x + m1 y + m2, m3 x + m4 y + m5). Nearest truncates s + 0.5; anything else is bilinear and clamped."""
    check(len(matrix) == 6, "a matrix has six entries")
    m = [float(v) for v in matrix]
    images = px.select("image_id", "w", "h").where((F.col("x") == 0) & (F.col("y") == 0) & (F.col("c") == 0))
    dw, dh = F.lit(width) if width else F.col("w"), F.lit(height) if height else F.col("h")
    grid = images.select("image_id", "w", "h", dw.alias("dw"), dh.alias("dh"), F.explode(F.sequence(F.lit(0), dh - 1)).alias("dy")).select("*", F.explode(F.sequence(F.lit(0), F.col("dw") - 1)).alias("dx"))
    grid = grid.withColumns({"sx": m[0] * F.col("dx") + m[1] * F.col("dy") + m[2], "sy": m[3] * F.col("dx") + m[4] * F.col("dy") + m[5]})
    clamp = lambda i, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, i)).cast("int")
    shape = ["image_id", F.col("dw").alias("w"), F.col("dh").alias("h"), F.col("dy").alias("y"), F.col("dx").alias("x"), "c"]
    if interp is Interp.NEAREST:
        ix, iy = (F.col("sx") + 0.5).cast("int"), (F.col("sy") + 0.5).cast("int")
        out = grid.withColumns({"__o": (ix < 0) | (ix >= F.col("w")) | (iy < 0) | (iy >= F.col("h")), "__x": clamp(ix, "w"), "__y": clamp(iy, "h")})
        source = px.select("image_id", F.col("y").alias("__y"), F.col("x").alias("__x"), "c", "v")
        value = F.when(F.col("__o"), F.lit(0)).otherwise(F.col("v")) if border is Border.ZERO else F.col("v")
        return out.join(source, ["image_id", "__y", "__x"]).select(*shape, value.alias("v")).select(*px.columns)
    ix, iy = F.col("sx").cast("int"), F.col("sy").cast("int")
    grid = grid.withColumns({"fx": F.col("sx") - ix, "fy": F.col("sy") - iy, "sx0": clamp(ix, "w"), "sx1": clamp(ix + 1, "w"), "sy0": clamp(iy, "h"), "sy1": clamp(iy + 1, "h")})
    keys = ["dw", "dh", "dy", "dx", "fx", "fy"]
    got = _sampled(grid, px, keys)
    fx, fy = F.col("fx"), F.col("fy")
    v = (F.col("p00") * (1.0 - fx) + F.col("p10") * fx) * (1.0 - fy) + (F.col("p01") * (1.0 - fx) + F.col("p11") * fx) * fy
    return got.select(*shape, F.greatest(F.lit(0), F.least(F.lit(255), (v + 0.5).cast("int"))).alias("v")).select(*px.columns)


def sample_bilinear(px: DataFrame, points: DataFrame) -> DataFrame:
    """image_id, px, py, c, v (double) at points (image_id, px, py); places are clamped."""
    size = px.select("image_id", "w", "h").where((F.col("x") == 0) & (F.col("y") == 0) & (F.col("c") == 0))
    clamp = lambda i, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, i)).cast("int")
    ix, iy = F.col("px").cast("int"), F.col("py").cast("int")
    near = points.join(size, "image_id").withColumns({"sx0": clamp(ix, "w"), "sx1": clamp(ix + 1, "w"), "sy0": clamp(iy, "h"), "sy1": clamp(iy + 1, "h")})
    got = _sampled(near, px, ["px", "py"])
    fx, fy = F.col("px") - ix, F.col("py") - iy
    top = F.col("p00") + (F.col("p10") - F.col("p00")) * fx
    bottom = F.col("p01") + (F.col("p11") - F.col("p01")) * fx
    return got.select("image_id", "px", "py", "c", (top + (bottom - top) * fy).alias("v"))


def _levels(px: DataFrame, levels: int, width: int, height: int) -> list[tuple[DataFrame, int, int]]:
    out = [(px, width, height)]
    while len(out) < levels and min(out[-1][1:]) >= 2:
        last, w, h = out[-1]
        w, h = max(1, w // 2), max(1, h // 2)
        out.append((resize(blur_gaussian(last, 5, 1.0), w, h), w, h))
    last = out[-1]
    return out + [last] * (levels - len(out))


def _stacked(frames: list[DataFrame]) -> DataFrame:
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn("level", F.lit(k))
        out = f if out is None else out.unionByName(f)
    return out


def pyramid_gaussian(px: DataFrame, levels: int, width: int, height: int) -> DataFrame:
    """All levels with a ``level`` column; level 0 is the image, each further one blurred (5, 1.0) and halved. Images share a size."""
    check(1 <= levels <= 16, "levels must be 1 to 16")
    return _stacked([f for f, _, _ in _levels(px, levels, width, height)])


def pyramid_laplacian(px: DataFrame, levels: int, width: int, height: int) -> DataFrame:
    """Each level less the next one enlarged, plus 128; the last is the remainder."""
    check(2 <= levels <= 16, "levels must be 2 to 16")
    parts = _levels(px, levels, width, height)
    out = []
    for (f, w, h), (g, _, _) in zip(parts, parts[1:], strict=False):
        up = resize(g, w, h).select("image_id", "y", "x", "c", F.col("v").alias("__u"))
        value = F.greatest(F.lit(0), F.least(F.lit(255), F.col("v") - F.col("__u") + 128))
        out.append(f.join(up, ["image_id", "y", "x", "c"]).select(*[value.alias("v") if c == "v" else c for c in f.columns]))
    return _stacked([*out, parts[-1][0]])
