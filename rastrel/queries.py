"""One query for each operator, over rasters derived from the tables, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from . import oracle as O  # noqa: E741, N812
from .model import Border, FormatError, Interp, InvalidArgument, Overflow, Rotation, SizeMismatch, Threshold, Unsupported, bare, describe, layout
from .operators import aggregate as A
from .operators import detect as D
from .operators import draw as R
from .operators import geometry as G
from .operators import lifecycle as L
from .operators import packed as K
from .operators import pointwise as P
from .operators import stencil as S
from .plans import rewrite
from .sources import adapters as src
from .sources import codecs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WHITE, GREY, RED = (1.0, 1.0, 1.0, 1.0), (0.5, 0.5, 0.5, 0.5), (1.0, 0.0, 0.0, 1.0)
SHARPEN = [[0.0, -1.0, 0.0], [-1.0, 5.0, -1.0], [0.0, -1.0, 0.0]]
SMOOTH = [[1 / 16, 2 / 16, 1 / 16], [2 / 16, 4 / 16, 2 / 16], [1 / 16, 2 / 16, 1 / 16]]
WIDE = [[(i + 1) / 55 if j == 2 else 0.02 * (j - 2) for i in range(5)] for j in range(5)]
TURN = [0.9, -0.3, 4.0, 0.3, 0.9, -3.0]
RECTS = [(0, 0, 31, 31), (3, 4, 10, 20), (-5, -5, 2, 2), (30, 30, 99, 99), (7, 7, 7, 7)]


def add(name: str, source, work, sql: str | None) -> None:
    """Registers a query: source gives pixels, work the result; pixel frames come out bare."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = work(source(spark, sf_dir))
        return bare(out) if {"w", "h", "v"} <= set(out.columns) and "level" not in out.columns else out

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def inverted(px: DataFrame) -> DataFrame:
    return px.withColumn("v", 255 - F.col("v"))


gray, rgb, events, embed, docs = src.px_gray, src.px_rgb, src.px_events, src.px_embed, src.px_docs


def whole(source):
    """The source with images dealt whole, for plans with several stencils."""
    return lambda spark, sf_dir: layout(source(spark, sf_dir))


# sources
for _name, _source, _sql in (("px_gray", gray, O.GRAY), ("px_rgb", rgb, O.RGB), ("px_events", events, O.EVENTS), ("px_embed", embed, O.EMBED), ("px_docs", docs, O.DOCS)):
    add(_name, _source, lambda px: px, _sql)

# lifecycle
add("fill", gray, lambda px: L.fill(px, 77), O.point(O.GRAY, "77"))
add("zero", gray, L.zero, O.point(O.GRAY, "0"))
add("crop", gray, lambda px: L.crop(px, 5, 6, 40, 9), O.q(O.GRAY, "SELECT image_id, y - 6 AS y, x - 5 AS x, c, v FROM px WHERE x >= 5 AND y BETWEEN 6 AND 14"))
add("get_u8", gray, lambda px: L.get(px, 3, 4), O.q(O.GRAY, "SELECT image_id, v FROM px WHERE x = 3 AND y = 4 AND c = 0"))
add("set_u8", gray, lambda px: L.put(px, 3, 4, 0, 9), O.point(O.GRAY, "CASE WHEN x = 3 AND y = 4 THEN 9 ELSE v END"))
add("overlay", gray, lambda px: L.overlay(px, inverted(px.where("x = y"))), O.point(O.GRAY, "CASE WHEN x = y THEN 255 - v ELSE v END"))
add("compatible", gray, lambda px: P.compatible(px, px.where("image_id % 2 = 0 or y < 9")), O.q(O.GRAY, "SELECT DISTINCT image_id, image_id % 2 = 0 AS compatible FROM px"))
add("clone", gray, L.clone, O.q(O.GRAY, "SELECT * FROM px"))
add("copy", gray, lambda px: L.copy(inverted(px), px), O.point(O.GRAY, "255 - v"))
add("offsets", rgb, lambda px: px.select("image_id", "y", "x", "c", L.offset(3, "u16").alias("first"), F.lit(L.buffer_size(32, 32, 3, "u16")).alias("size")), O.q(O.RGB, "SELECT image_id, y, x, c, ((y * 32 + x) * 3 + c) * 2 AS first, 32 * 32 * 3 * 2 AS size FROM px"))
add("get_f32", gray, lambda px: L.get(P.convert_depth(px, "u8", "f32"), 3, 4), O.q(O.GRAY, "SELECT image_id, v / 255.0::DOUBLE AS v FROM px WHERE x = 3 AND y = 4"))
add("set_u16", gray, lambda px: L.put(P.convert_depth(px, "u8", "u16"), 3, 4, 0, 60000), O.point(O.GRAY, "CASE WHEN x = 3 AND y = 4 THEN 60000 ELSE v * 257 END"))
QUERIES["version"] = lambda spark, sf_dir: spark.range(1).select(F.lit(__version__).alias("version"))
ORACLES["version"] = "SELECT '0.1.0' AS version"
QUERIES["errors"] = lambda spark, sf_dir: spark.createDataFrame([(k.__name__, describe(k)) for k in (InvalidArgument, SizeMismatch, Unsupported, FormatError, Overflow)], "kind string, said string")
ORACLES["errors"] = "SELECT * FROM (VALUES ('InvalidArgument', 'invalid argument'), ('SizeMismatch', 'images differ in size, channels or depth'), ('Unsupported', 'unsupported operation'), ('FormatError', 'malformed image file'), ('Overflow', 'buffer too small')) t(kind, said)"


def _conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pairs of channel numbers have a conversion; the others raise."""
    px, rows = L.create(spark, 1, 1), []
    for source in range(1, 5):
        for target in range(1, 5):
            try:
                P.convert_channels(px, source, target)
                rows.append((source, target, True))
            except Unsupported:
                rows.append((source, target, False))
    return spark.createDataFrame(rows, "source int, target int, supported boolean")


QUERIES["channel_pairs"] = _conversions
ORACLES["channel_pairs"] = "SELECT CAST(s AS INT) AS source, CAST(t AS INT) AS target, (s, t) IN ((3, 1), (1, 3), (3, 4), (4, 3)) AS supported FROM range(1, 5) a(s), range(1, 5) b(t)"
QUERIES["create"] = lambda spark, sf_dir: bare(L.create(spark, 7, 5, 3, 4)).select(F.col("image_id").cast("int").alias("image_id"), "y", "x", "c", "v")
ORACLES["create"] = "SELECT CAST(i AS INT) AS image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(c AS INT) AS c, 0 AS v FROM range(4) a(i), range(5) b(y), range(7) d(x), range(3) e(c)"

# pointwise
add("px_add", gray, lambda px: P.add(px, px.withColumn("v", (F.col("v") * 3) % 256)), O.point(O.GRAY, "least(255, v + (v * 3) % 256)"))
add("px_sub", gray, lambda px: P.sub(px, inverted(px)), O.point(O.GRAY, "greatest(0, v - (255 - v))"))
add("px_scale", gray, lambda px: P.scale(px, 1.7), O.point(O.GRAY, "least(255, (v * 435) >> 8)"))
add("px_blend", gray, lambda px: P.blend(px, inverted(px), 0.3), O.point(O.GRAY, "(v * 77 + (255 - v) * 179) >> 8"))
for _kind, _value in (("binary", "CASE WHEN v > 100 THEN 200 ELSE 0 END"), ("binary_inv", "CASE WHEN v > 100 THEN 0 ELSE 200 END"), ("trunc", "least(v, 100)"), ("tozero", "CASE WHEN v > 100 THEN v ELSE 0 END")):
    add(f"thr_{_kind}", gray, lambda px, k=Threshold(_kind): P.threshold(px, 100, 200, k), O.point(O.GRAY, _value))
add("thr_otsu", gray, lambda px: P.threshold(px, kind=Threshold.OTSU), O.otsu(O.GRAY) + f" SELECT {O.P}, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM px JOIN ot USING (image_id)")
add("otsu_value", embed, A.otsu, O.otsu(O.EMBED) + " SELECT image_id, threshold FROM ot")
add("otsu_binarize", gray, A.otsu_binarize, O.otsu(O.GRAY) + " SELECT image_id, threshold, count(*) FILTER (WHERE v > threshold) AS n_fg FROM px JOIN ot USING (image_id) GROUP BY ALL")
add("rgb_to_gray", rgb, lambda px: P.convert_channels(px, 3, 1), O.q(O.RGB, "SELECT image_id, y, x, 0 AS c, CAST(CAST(sum(v * CASE c WHEN 0 THEN 77 WHEN 1 THEN 150 ELSE 29 END) AS BIGINT) >> 8 AS INT) AS v FROM px GROUP BY image_id, y, x"))
add("gray_to_rgb", gray, lambda px: P.convert_channels(px, 1, 3), O.q(O.GRAY, "SELECT image_id, y, x, k.c AS c, v FROM px, (VALUES (0), (1), (2)) k(c)"))
add("rgb_to_rgba", rgb, lambda px: P.convert_channels(px, 3, 4), O.q(O.RGB, "SELECT * FROM px UNION ALL SELECT image_id, y, x, 3, 255 FROM px WHERE c = 0"))
add("rgba_to_rgb", lambda s, d: P.rgb_to_rgba(rgb(s, d)), lambda px: P.convert_channels(px, 4, 3), O.q(O.RGB, "SELECT * FROM px"))
add("convert_depth", gray, lambda px: P.convert_depth(px, "u8", "f32"), O.q(O.GRAY, f"SELECT {O.P}, v / 255.0::DOUBLE AS v FROM px"))
add("convert_depth_u16", gray, lambda px: P.convert_depth(px, "u8", "u16"), O.point(O.GRAY, "v * 257"))
add("lut_chain", gray, lambda px: rewrite.Tables().scale(1.5).invert().threshold(90).apply(px), O.point(O.GRAY, "CASE WHEN 255 - least(255, (v * 384) >> 8) > 90 THEN 255 ELSE 0 END"))

# aggregates
_BINS = "(SELECT DISTINCT image_id, c FROM px) i, range(256) b(bin)"
_HIST = f"hs AS (SELECT i.image_id, i.c, CAST(b.bin AS INT) AS bin, (SELECT count(*) FROM px p WHERE p.image_id = i.image_id AND p.c = i.c AND p.v = b.bin) AS n FROM {_BINS})"
add("histogram", rgb, A.histogram, O.q(O.RGB, "SELECT * FROM hs", ", " + _HIST))
add("hist_cdf", gray, A.histogram_cdf, O.q(O.GRAY, "SELECT *, CAST(sum(n) OVER (PARTITION BY image_id, c ORDER BY bin) AS BIGINT) AS cdf FROM hs", ", " + _HIST))
_CDF = "cd AS (SELECT image_id, c, v, CAST(sum(count(*)) OVER (PARTITION BY image_id, c ORDER BY v) AS BIGINT) AS cdf, CAST(sum(count(*)) OVER (PARTITION BY image_id, c) AS BIGINT) AS t FROM px GROUP BY image_id, c, v), lw AS (SELECT *, min(cdf) OVER (PARTITION BY image_id, c) AS l FROM cd)"
add("equalize", gray, A.equalize, O.q(O.GRAY, f"SELECT {O.P}, CAST(CASE WHEN t > l THEN floor((cdf - l) / (t - l) * 255.0::DOUBLE + 0.5) ELSE 0 END AS INT) AS v FROM px JOIN lw USING (image_id, c, v)", ", " + _CDF))
add("integral", events, A.integral, O.q(O.EVENTS, "SELECT p.image_id, p.c, p.y, p.x, CAST(sum(n.v) AS BIGINT) AS s FROM px p JOIN px n ON n.image_id = p.image_id AND n.c = p.c AND n.y <= p.y AND n.x <= p.x GROUP BY ALL"))
_RECT = ", ".join(f"({k}, {max(0, min(31, a))}, {max(0, min(31, b))}, {max(0, min(31, c))}, {max(0, min(31, d))})" for k, (a, b, c, d) in enumerate(RECTS))
add("integral_sum", gray, lambda px: A.integral_sum(px, RECTS), O.q(O.GRAY, f"SELECT p.image_id, r.k AS rect, CAST(sum(p.v) AS BIGINT) AS s FROM px p, (VALUES {_RECT}) r(k, a, b, c, d) WHERE p.x BETWEEN r.a AND r.c AND p.y BETWEEN r.b AND r.d GROUP BY ALL"))
add("image_stats", rgb, A.image_stats, O.q(O.RGB, "SELECT image_id, c, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS most, CAST(sum(v) AS DOUBLE) / count(*) AS mean FROM px GROUP BY ALL"))
add("normalize_max", events, A.normalize_max, O.q(O.EVENTS, f"SELECT {O.P}, CAST(CASE WHEN m > 0 THEN floor(v / m * 255.0::DOUBLE + 0.5) ELSE 0 END AS INT) AS v FROM (SELECT *, max(v) OVER (PARTITION BY image_id, c) AS m FROM px)"))

# stencils
add("box", whole(gray), lambda px: S.blur_box(px, 5), O.box(O.GRAY, 5))
add("box_wide", whole(gray), lambda px: S.blur_box(px, 63), O.box(O.GRAY, 63))
add("box_sat", whole(gray), lambda px: S.blur_box_sat(px, 5), O.q(O.GRAY, O.window("px", 2, 2, "CAST(sum(n.v) AS BIGINT) // 25")))
add("gaussian", whole(gray), lambda px: S.blur_gaussian(px, 9, 2.0), O.gaussian(O.GRAY, 9, 2.0))
add("gaussian_rgb", whole(rgb), lambda px: S.blur_gaussian(px, 5, 1.0), O.gaussian(O.RGB, 5, 1.0))
add("median3", whole(gray), lambda px: S.blur_median(px, 3), O.median(O.GRAY, 3))
add("median5", whole(gray), lambda px: S.blur_median(px, 5), O.median(O.GRAY, 5))
add("median9", gray, lambda px: S.blur_median(px, 9), O.median(O.GRAY, 9))
add("convolve_sharpen", whole(gray), lambda px: S.convolve2d(px, SHARPEN), O.convolve(O.GRAY, SHARPEN))
for _border in Border:
    add(f"convolve_{_border.value}", whole(gray), lambda px, b=_border: S.convolve2d(px, WIDE, b), O.convolve(O.GRAY, WIDE, _border.value))
add("convolve_sep", whole(gray), lambda px: S.convolve_sep(px, [0.25, 0.5, 0.25], [0.1, 0.8, 0.1]), O.q(O.GRAY, O.gather("h", O.kernel([[w] for w in O.q15([0.1, 0.8, 0.1])]), O.ROUND), f", h AS MATERIALIZED ({O.gather('px', O.kernel([O.q15([0.25, 0.5, 0.25])]), O.ROUND)})"))
add("sobel_x", whole(gray), S.sobel_x, O.q(O.GRAY, O.gather("px", O.SX, "CAST(acc AS DOUBLE)")))
add("sobel_y", whole(gray), S.sobel_y, O.q(O.GRAY, O.gather("px", O.SY, "CAST(acc AS DOUBLE)")))
add("sobel_mag", whole(gray), S.sobel_magnitude, O.q(O.GRAY, f"SELECT {O.P}, CAST(abs(gx) + abs(gy) AS INT) AS v FROM gr", O.gradients("px")))
add("erode", whole(gray), lambda px: S.erode(px, 5, 3), O.q(O.GRAY, O.window("px", 1, 2, "min(n.v)")))
add("dilate", whole(gray), lambda px: S.dilate(px, 4, 3), O.q(O.GRAY, O.window("px", 1, 2, "max(n.v)")))
add("erode_wide", whole(gray), lambda px: S.erode(px, 21, 19), O.q(O.GRAY, O.window("px", 9, 10, "min(n.v)")))
add("erode_merged", whole(gray), lambda px: rewrite.erode_all(px, [(3, 3), (5, 3)]), O.q(O.GRAY, O.window("a", 1, 2, "min(n.v)"), f", a AS MATERIALIZED ({O.window('px', 1, 1, 'min(n.v)')})"))
add("open", whole(gray), lambda px: S.morph_open(px, 3, 3), O.q(O.GRAY, O.window("a", 1, 1, "max(n.v)"), f", a AS MATERIALIZED ({O.window('px', 1, 1, 'min(n.v)')})"))
add("close", whole(gray), lambda px: S.morph_close(px, 3, 3), O.q(O.GRAY, O.window("a", 1, 1, "min(n.v)"), f", a AS MATERIALIZED ({O.window('px', 1, 1, 'max(n.v)')})"))
add("bilateral", whole(events), lambda px: S.blur_bilateral(px, 5, 2.0, 30.0), O.bilateral(O.EVENTS, 5, 2.0, 30.0, 16))
add("clahe", gray, lambda px: S.clahe(px, 8, 8, 2.0), O.clahe(O.GRAY, 32, 8, 2.0))
add("canny_nms", whole(gray), S.canny_suppressed, f"{O.suppressed(O.GRAY)} SELECT {O.P}, v FROM nm")
add("canny", whole(gray), lambda px: S.canny(px, 30, 80), O.canny(O.GRAY, 30, 80))
add("region_blur", gray, lambda px: rewrite.region(px, 8, 8, 16, 16, 4, lambda p: S.blur_gaussian(p, 9, 2.0)), O.gaussian(O.GRAY, 9, 2.0) + " WHERE x BETWEEN 8 AND 23 AND y BETWEEN 8 AND 23")

# geometry
add("flip_h", rgb, G.flip_h, O.q(O.RGB, "SELECT image_id, y, 31 - x AS x, c, v FROM px"))
add("flip_v", rgb, G.flip_v, O.q(O.RGB, "SELECT image_id, 31 - y AS y, x, c, v FROM px"))
add("rotate_cw", rgb, lambda px: G.rotate(px, Rotation.CW), O.q(O.RGB, "SELECT image_id, x AS y, 31 - y AS x, c, v FROM px"))
add("rotate_ccw", rgb, lambda px: G.rotate(px, Rotation.CCW), O.q(O.RGB, "SELECT image_id, 31 - x AS y, y AS x, c, v FROM px"))
add("rotate_180", rgb, lambda px: G.rotate(px, Rotation.HALF), O.q(O.RGB, "SELECT image_id, 31 - y AS y, 31 - x AS x, c, v FROM px"))
add("transpose", rgb, G.transpose, O.q(O.RGB, "SELECT image_id, x AS y, y AS x, c, v FROM px"))
add("remap_fused", rgb, lambda px: rewrite.Remap().flip_h().rotate_cw().transpose().apply(px), O.q(O.RGB, "SELECT image_id, 31 - y AS y, 31 - x AS x, c, v FROM px"))
add("resize_nearest", rgb, lambda px: G.resize(px, 45, 20, Interp.NEAREST), O.q(O.RGB, "SELECT image_id, CAST(dy AS INT) AS y, CAST(dx AS INT) AS x, c, v FROM range(20) a(dy), range(45) b(dx) JOIN px ON px.y = dy * 32 // 20 AND px.x = dx * 32 // 45"))
add("resize_bilinear", whole(rgb), lambda px: G.resize(px, 45, 20), O.q(O.RGB, O.bilinear("px", 32, 32, 45, 20)))
add("resize_bicubic", whole(gray), lambda px: G.resize(px, 64, 64, Interp.BICUBIC), O.bicubic(O.GRAY, 32, 64))
add("affine_nearest", gray, lambda px: G.affine(px, TURN, interp=Interp.NEAREST, border=Border.ZERO), O.affine(O.GRAY, TURN, True, True))
add("affine_nearest_edge", gray, lambda px: G.affine(px, TURN, interp=Interp.NEAREST), O.affine(O.GRAY, TURN, True))
add("affine_bilinear", gray, lambda px: G.affine(px, TURN), O.affine(O.GRAY, TURN, False))
add("pyr_gauss", whole(gray), lambda px: G.pyramid_gaussian(px, 3, 32, 32).select("image_id", "y", "x", "c", "v", "level"), O.pyramid(O.GRAY, 3, False))
add("pyr_laplace", whole(gray), lambda px: G.pyramid_laplacian(px, 3, 32, 32).select("image_id", "y", "x", "c", "v", "level"), O.pyramid(O.GRAY, 3, True))


def _points(px: DataFrame) -> DataFrame:
    ids = px.where("x = 0 and y = 0").select("image_id")
    return G.sample_bilinear(px, ids.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("image_id", (F.col("i") * 3.75 + 0.25).alias("px"), (F.col("i") * 4.5 - 0.5).alias("py")))


add("sample_bilinear", gray, _points, O.q(O.GRAY, f"""SELECT g.image_id, g.px, g.py, a.c, (a.v + (b.v - a.v) * fx) + ((d.v + (e.v - d.v) * fx) - (a.v + (b.v - a.v) * fx)) * fy AS v
FROM (SELECT *, px - trunc(px) AS fx, py - trunc(py) AS fy, CAST(trunc(px) AS INT) AS ix, CAST(trunc(py) AS INT) AS iy FROM (SELECT DISTINCT image_id, i * 3.75::DOUBLE + 0.25::DOUBLE AS px, i * 4.5::DOUBLE - 0.5::DOUBLE AS py FROM px, range(10) t(i))) g
JOIN px a ON a.image_id = g.image_id AND a.y = {O._place('iy', 32, 'replicate')} AND a.x = {O._place('ix', 32, 'replicate')} JOIN px b ON b.image_id = g.image_id AND b.y = {O._place('iy', 32, 'replicate')} AND b.x = {O._place('ix + 1', 32, 'replicate')}
JOIN px d ON d.image_id = g.image_id AND d.y = {O._place('iy + 1', 32, 'replicate')} AND d.x = {O._place('ix', 32, 'replicate')} JOIN px e ON e.image_id = g.image_id AND e.y = {O._place('iy + 1', 32, 'replicate')} AND e.x = {O._place('ix + 1', 32, 'replicate')}"""))

# detection
add("harris", whole(gray), lambda px: D.harris(px), O.harris(O.GRAY, 32, 0.04, 1e6, 3, 10_000))
add("harris_topk", whole(gray), lambda px: D.harris(px, 0.05, 1e5, 2, 5), O.harris(O.GRAY, 32, 0.05, 1e5, 2, 5))
add("cc", gray, lambda px: D.connected_components(P.threshold(px, 100)), O.components(O.GRAY, 100) + " SELECT image_id, y, x, label FROM cc")
add("cc_bboxes", gray, lambda px: D.component_boxes(D.connected_components(P.threshold(px, 100))), O.components(O.GRAY, 100) + " SELECT image_id, label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM cc WHERE label > 0 GROUP BY image_id, label")

# drawing
add("draw_line", gray, lambda px: R.draw_line(px, (-3, 5), (40, 20), WHITE), O.drawn(O.GRAY, O.line_sql((-3, 5), (40, 20)), 255, 255))
add("draw_line_thick", gray, lambda px: R.draw_line(px, (28, 2), (4, 25), GREY, 2), O.drawn(O.GRAY, O.line_sql((28, 2), (4, 25), 1), 128, 128))
add("draw_rect", gray, lambda px: R.draw_rect(px, (4, 6, 12, 9), GREY), O.drawn(O.GRAY, " UNION ALL ".join(O.line_sql(a, b) for a, b in (((4, 6), (15, 6)), ((15, 6), (15, 14)), ((15, 14), (4, 14)), ((4, 14), (4, 6)))), 128, 128))
add("draw_rect_filled", rgb, lambda px: R.draw_rect(px, (10, 10, 40, 5), RED, filled=True, channels=3), O.point(O.RGB, "CASE WHEN x >= 10 AND y BETWEEN 10 AND 14 THEN CASE c WHEN 0 THEN 254 ELSE 0 END ELSE v END"))
add("draw_circle", gray, lambda px: R.draw_circle(px, (16, 15), 9, GREY), O.drawn(O.GRAY, O.circle_sql((16, 15), 9), 128, 128))
add("draw_circle_filled", gray, lambda px: R.draw_circle(px, (16, 15), 9, WHITE, filled=True), O.drawn(O.GRAY, f"SELECT c.x AS x, c.y AS y FROM (SELECT i.x AS x, o.y FROM (SELECT y, max(x) AS r FROM ({O.circle_sql((0, 0), 9)}) GROUP BY y) o, range(-9, 10) i(x) WHERE abs(i.x) <= o.r) a, LATERAL (SELECT a.x + 16 AS x, a.y + 15 AS y) c", 255, 255))
add("draw_polyline", gray, lambda px: R.draw_polyline(px, [(2, 2), (29, 8), (14, 28)], WHITE, closed=True), O.drawn(O.GRAY, " UNION ALL ".join(O.line_sql(a, b) for a, b in (((2, 2), (29, 8)), ((29, 8), (14, 28)), ((14, 28), (2, 2)))), 255, 255))
add("draw_text", gray, lambda px: R.draw_text(px, "42?", 3, 11, WHITE), O.drawn(O.GRAY, O.text_sql("42?", 3, 11), 255, 255))
add("blit", gray, lambda px: R.draw_image(px, L.crop(inverted(px), 0, 0, 10, 8), 26, -2), O.q(O.GRAY, f"SELECT p.image_id, p.y, p.x, p.c, CAST(CASE WHEN n.v IS NULL THEN p.v ELSE (((256 * (255 - n.v)) >> 8) * 255) >> 8 END AS INT) AS v FROM px p LEFT JOIN px n ON n.image_id = p.image_id AND n.x = p.x - 26 AND n.y = p.y + 2 AND n.x < 10 AND n.y < 8"))


# codecs
def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.pack(rgb(spark, sf_dir))


def _digested(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("image_id").cast("int").alias("image_id"), F.length("content").cast("long").alias("size"), F.md5("content").alias("digest"))


QUERIES["encode_ppm"] = lambda spark, sf_dir: _digested(codecs.to_ppm(_files(spark, sf_dir)))
ORACLES["encode_ppm"] = O.q(O.RGB, "SELECT image_id, CAST(octet_length(b) AS BIGINT) AS size, md5(b) AS digest FROM (SELECT image_id, encode('P6' || chr(10) || '32 32' || chr(10) || '255' || chr(10)) || from_hex(string_agg(lpad(to_hex(v), 2, '0'), '' ORDER BY y, x, c)) AS b FROM px GROUP BY image_id)")


def _png_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = codecs.unpack(codecs.decode_contents(codecs.to_png(_files(spark, sf_dir))))
    return bare(back).withColumn("image_id", F.col("image_id").cast("int"))


def _files_roundtrip(ending: str, encode):
    """Files written to a folder that all executors share and read again, whatever their format."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{codecs.scratch(spark)}/{ending}-{uuid.uuid4().hex}"
        codecs.write_files(encode(_files(spark, sf_dir)).select("image_id", "content"), folder, ending)
        back = codecs.read_images(spark, folder)
        named = back.withColumn("image_id", F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long"))
        return bare(codecs.unpack(named)).withColumn("image_id", F.col("image_id").cast("int"))

    return run


for _ending, _encode in (("ppm", codecs.to_ppm), ("png", codecs.to_png)):
    QUERIES[f"{_ending}_files"] = _files_roundtrip(_ending, _encode)
    ORACLES[f"{_ending}_files"] = O.RGB


def _f32_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = codecs.unpack(codecs.pack(P.convert_depth(gray(spark, sf_dir), "u8", "f32"), "f32"), floats=True)
    return bare(back).withColumn("image_id", F.col("image_id").cast("int"))


QUERIES["pack_unpack_f32"] = _f32_roundtrip
ORACLES["pack_unpack_f32"] = O.q(O.GRAY, f"SELECT {O.P}, CAST(CAST(v / 255.0::DOUBLE AS FLOAT) AS DOUBLE) AS v FROM px")


def _packed_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = codecs.pack(gray(spark, sf_dir))
    odd, whole_16 = F.col("image_id") % 2 == 1, codecs.pack(gray(spark, sf_dir), "u16")
    return K.compatible(a, whole_16.where(odd).unionByName(a.where(~odd))).withColumn("image_id", F.col("image_id").cast("int"))


QUERIES["packed_compatible"] = _packed_compatible
ORACLES["packed_compatible"] = O.q(O.GRAY, "SELECT DISTINCT image_id, image_id % 2 = 0 AS compatible FROM px")
QUERIES["png_roundtrip"] = _png_roundtrip
ORACLES["png_roundtrip"] = O.RGB
QUERIES["pack_unpack"] = lambda spark, sf_dir: bare(codecs.unpack(_files(spark, sf_dir))).withColumn("image_id", F.col("image_id").cast("int"))
ORACLES["pack_unpack"] = O.RGB


def add_packed(name: str, source, work, sql: str) -> None:
    """The packed form of an operator, unpacked again for the comparison."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = bare(codecs.unpack(work(codecs.pack(source(spark, sf_dir)))))
        return out.withColumn("image_id", F.col("image_id").cast("int"))

    QUERIES[f"packed_{name}"] = run
    ORACLES[f"packed_{name}"] = sql


add_packed("add", gray, lambda im: K.add(im, K.scale(im, 1.7)), O.point(O.GRAY, "least(255, v + least(255, (v * 435) >> 8))"))
add_packed("add_paired", gray, lambda im: K.add(K.paired(im, K.scale(im, 1.7))), ORACLES["packed_add"])
add_packed("sub", gray, lambda im: K.sub(im, K.scale(im, 0.5)), O.point(O.GRAY, "greatest(0, v - ((v * 128) >> 8))"))
add_packed("blend", gray, lambda im: K.blend(im, K.threshold(im, 100), 0.3), O.point(O.GRAY, "(v * 77 + (CASE WHEN v > 100 THEN 255 ELSE 0 END) * 179) >> 8"))
add_packed("otsu", gray, lambda im: K.threshold(im, kind=Threshold.OTSU), ORACLES["thr_otsu"])
for _name, _work, _of in (
    ("equalize", K.equalize, "equalize"), ("box", lambda im: K.blur_box(im, 5), "box"), ("box_wide", lambda im: K.blur_box(im, 63), "box_wide"), ("gaussian", lambda im: K.blur_gaussian(im, 9, 2.0), "gaussian"),
    ("median3", lambda im: K.blur_median(im, 3), "median3"), ("median9", lambda im: K.blur_median(im, 9), "median9"), ("erode", lambda im: K.erode(im, 5, 3), "erode"), ("erode_wide", lambda im: K.erode(im, 21, 19), "erode_wide"),
    ("open", K.morph_open, "open"), ("close", K.morph_close, "close"), ("canny", lambda im: K.canny(im, 30, 80), "canny"), ("convolve_wrap", lambda im: K.convolve2d(im, WIDE, Border.WRAP), "convolve_wrap"),
    ("convolve_zero", lambda im: K.convolve2d(im, WIDE, Border.ZERO), "convolve_zero"), ("thr_tozero", lambda im: K.threshold(im, 100, 200, Threshold.TOZERO), "thr_tozero"), ("crop", lambda im: K.crop(im, 5, 6, 40, 9), "crop"),
):
    add_packed(_name, gray, _work, ORACLES[_of])
for _name, _work, _of in (
    ("rgb_to_gray", lambda im: K.convert_channels(im, 3, 1), "rgb_to_gray"), ("rgb_to_rgba", lambda im: K.convert_channels(im, 3, 4), "rgb_to_rgba"), ("flip_h", K.flip_h, "flip_h"), ("flip_v", K.flip_v, "flip_v"),
    ("gaussian_rgb", lambda im: K.blur_gaussian(im, 5, 1.0), "gaussian_rgb"), ("resize_nearest", lambda im: K.resize(im, 45, 20, Interp.NEAREST), "resize_nearest"), ("resize_bilinear", lambda im: K.resize(im, 45, 20), "resize_bilinear"),
):
    add_packed(_name, rgb, _work, ORACLES[_of])
for _turn, _of in ((Rotation.CW, "rotate_cw"), (Rotation.CCW, "rotate_ccw"), (Rotation.HALF, "rotate_180")):
    add_packed(_of, rgb, lambda im, t=_turn: K.rotate(im, t), ORACLES[_of])
add_packed("transpose", rgb, K.transpose, ORACLES["transpose"])
add_packed("cc", gray, lambda im: K.connected_components(K.threshold(im, 100)), O.components(O.GRAY, 100) + " SELECT image_id, y, x, 0 AS c, label AS v FROM cc")
QUERIES["packed_histogram"] = lambda spark, sf_dir: K.histogram(_files(spark, sf_dir)).withColumn("image_id", F.col("image_id").cast("int"))
ORACLES["packed_histogram"] = ORACLES["histogram"]


def demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour to grey, blur, edges."""
    return bare(S.canny(S.blur_gaussian(P.rgb_to_gray(layout(rgb(spark, sf_dir))), 9, 2.0), 5, 15))


QUERIES["demo_pipeline"] = demo
ORACLES["demo_pipeline"] = O.canny(O.gaussian(ORACLES["rgb_to_gray"], 9, 2.0), 5, 15)
