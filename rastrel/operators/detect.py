"""Corners, connected components and their boxes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stencil import _line_sum, gradients, planes


def _boxed(px: DataFrame, columns: list[str], r: int) -> DataFrame:
    """Sums over squares with repeated edges, one column after the other."""
    out = px
    for name in columns:
        out = out.withColumn("v", F.col(name))
        for axis, line in (("x", "y"), ("y", "x")):
            order = W.partitionBy("image_id", "c", line).orderBy(axis).rowsBetween(W.unboundedPreceding, 0)
            out = out.withColumn("__run", F.sum("v").over(order))
            out = out.withColumn("v", _line_sum(out, r, axis)).drop("__run")
        out = out.withColumn(name, F.col("v")).drop("v")
    return out


def harris_response(px: DataFrame, k: float = 0.04) -> DataFrame:
    """image_id, w, h, c, y, x, r: determinant less k times the squared trace of 5 x 5 means of gradient products. Sums are integers until the division."""
    g = gradients(px)
    parts = g.withColumns({"xx": F.col("gx") * F.col("gx"), "yy": F.col("gy") * F.col("gy"), "xy": F.col("gx") * F.col("gy")}).drop("gx", "gy")
    s = _boxed(parts, ["xx", "yy", "xy"], 2)
    xx, yy, xy = (F.col(n) / 25.0 for n in ("xx", "yy", "xy"))
    return s.select("image_id", "w", "h", "c", "y", "x", (xx * yy - xy * xy - F.lit(float(k)) * (xx + yy) * (xx + yy)).alias("r"))


def harris(px: DataFrame, k: float = 0.04, threshold: float = 1e6, nms_radius: int = 3, max_keypoints: int = 10_000) -> DataFrame:
    """image_id, rank, x, y, response, scale. The limit takes the first in raster order, as its contract has it; ranks are by response, then y, x."""
    k, threshold = (k if k > 0 else 0.04), (threshold if threshold > 0 else 1e6)
    r, limit = (nms_radius if nms_radius > 0 else 3), (max_keypoints if max_keypoints > 0 else 10_000)
    found = harris_response(px, k)
    for axis, line in (("x", "y"), ("y", "x")):
        source = "r" if axis == "x" else "top"
        found = found.withColumn("top", F.max(source).over(W.partitionBy("image_id", line).orderBy(axis).rowsBetween(-r, r)))
    edge = r + 1
    inner = (F.col("x") >= edge) & (F.col("x") < F.col("w") - edge) & (F.col("y") >= edge) & (F.col("y") < F.col("h") - edge)
    found = found.where(inner & (F.col("r") >= threshold) & (F.col("r") >= F.col("top")))
    found = found.withColumn("n", F.row_number().over(W.partitionBy("image_id").orderBy("y", "x"))).where(F.col("n") <= limit)
    rank = F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("r"), "y", "x"))
    return found.select("image_id", rank.alias("rank"), "x", "y", F.col("r").alias("response"), F.lit(1.0).alias("scale"))


def label_plane(on: np.ndarray, neighbours: int = 4) -> np.ndarray:
    """Labels 1.. in raster order of each component's first pixel; 0 is background. Runs of rows are united."""
    h, w = on.shape
    edges = np.diff(np.pad(on.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1]
    root = np.arange(len(rows))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    reach = 1 if neighbours == 8 else 0
    start = np.searchsorted(rows, np.arange(h + 1))
    for y in range(1, h):
        i, j = int(start[y - 1]), int(start[y])
        top, end = int(start[y]), int(start[y + 1])
        while i < top and j < end:
            if first[i] < last[j] + reach and first[j] < last[i] + reach:
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
            if last[i] < last[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(rows))], np.int64)
    names = np.zeros(len(rows), np.int64)
    order = np.unique(roots)  # runs are in raster order, so roots are too
    names[order] = np.arange(1, len(order) + 1)
    out = np.zeros(h * w + 1, np.int64)
    if len(rows):
        np.add.at(out, rows * w + first, names[roots])
        # a run may end where the next begins, in the next row
        np.add.at(out, rows * w + last, -names[roots])
    return np.cumsum(out)[: h * w].reshape(h, w)


def connected_components(px: DataFrame) -> DataFrame:
    """image_id, y, x, label: 4-connected components of samples that are not 0."""
    return planes(px, lambda plane: label_plane(plane != 0, 4)).select("image_id", "y", "x", F.col("v").alias("label"))


def component_boxes(labels: DataFrame) -> DataFrame:
    """image_id, label, x, y, w, h, area of every component."""
    size = lambda c: (F.max(c) - F.min(c) + 1).cast("int")
    return labels.where("label > 0").groupBy("image_id", "label").agg(F.min("x").alias("x"), F.min("y").alias("y"), size("x").alias("w"), size("y").alias("h"), F.count("*").alias("area"))
