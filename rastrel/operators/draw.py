"""Rasterisation: shapes give hits (y, x, n), and hits are blended over the images they fall on.

A pixel that a shape hits n times is blended n times. ``(c * a + p * (255 - a)) >> 8``
makes opaque white 254, as the contract has it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import check

#: Glyphs of the public-domain 8 x 8 font, rows from the top, lowest bit left. Others come by the ``font`` argument.
FONT = {
    "0": (0x3E, 0x63, 0x73, 0x7B, 0x6F, 0x67, 0x3E, 0x00),
    "1": (0x0C, 0x0E, 0x0C, 0x0C, 0x0C, 0x0C, 0x3F, 0x00),
    "2": (0x1E, 0x33, 0x30, 0x1C, 0x06, 0x33, 0x3F, 0x00),
    "3": (0x1E, 0x33, 0x30, 0x1C, 0x30, 0x33, 0x1E, 0x00),
    "4": (0x38, 0x3C, 0x36, 0x33, 0x7F, 0x30, 0x78, 0x00),
    "5": (0x3F, 0x03, 0x1F, 0x30, 0x30, 0x33, 0x1E, 0x00),
    "6": (0x1C, 0x06, 0x03, 0x1F, 0x33, 0x33, 0x1E, 0x00),
    "7": (0x3F, 0x33, 0x30, 0x18, 0x0C, 0x0C, 0x0C, 0x00),
    "8": (0x1E, 0x33, 0x33, 0x1E, 0x33, 0x33, 0x1E, 0x00),
    "9": (0x1E, 0x33, 0x33, 0x3E, 0x30, 0x18, 0x0E, 0x00),
    "?": (0x1E, 0x33, 0x30, 0x18, 0x0C, 0x00, 0x0C, 0x00),
    " ": (0, 0, 0, 0, 0, 0, 0, 0),
}

Point = tuple[int, int]
Color = tuple[float, float, float, float]


def line_points(p: Point, q: Point) -> Iterator[Point]:
    """Integer points of a segment, both ends included, by the two-axis error form of Bresenham's algorithm."""
    (x, y), (ex, ey) = p, q
    run, rise = abs(ex - x), abs(ey - y)
    right, down = (1 if x < ex else -1), (1 if y < ey else -1)
    gap = run - rise
    yield x, y
    while (x, y) != (ex, ey):
        twice = 2 * gap
        if twice > -rise:
            gap, x = gap - rise, x + right
        if twice < run:
            gap, y = gap + run, y + down
        yield x, y


def _brushed(points: Iterator[Point], thickness: int) -> Iterator[Point]:
    """A square brush; even sizes count as the next odd one."""
    half = max(1, thickness) // 2
    for x, y in points:
        for dy in range(-half, half + 1):
            for dx in range(-half, half + 1):
                yield x + dx, y + dy


def _octant(radius: int) -> Iterator[Point]:
    """Midpoint circle: one eighth."""
    x, y, d = 0, radius, 1 - radius
    while x <= y:
        yield x, y
        if d < 0:
            d += 2 * x + 3
        else:
            d += 2 * (x - y) + 5
            y -= 1
        x += 1


def _counted(points: Iterator[Point]) -> dict[Point, int]:
    out: dict[Point, int] = {}
    for p in points:
        out[p] = out.get(p, 0) + 1
    return out


def polyline_hits(points: list[Point], thickness: int = 1, closed: bool = False) -> dict[Point, int]:
    check(len(points) >= 2, "a polyline has at least two points")
    ends = [*points, points[0]] if closed else points
    return _counted(p for a, b in zip(ends, ends[1:], strict=False) for p in _brushed(line_points(a, b), thickness))


def circle_hits(center: Point, radius: int, thickness: int = 1, filled: bool = False) -> dict[Point, int]:
    cx, cy = center

    def points() -> Iterator[Point]:
        for x, y in _octant(radius) if radius > 0 else ():
            for a, b in ((x, y), (y, x)):
                if filled:
                    for i in range(-a, a + 1):
                        yield cx + i, cy + b
                        yield cx + i, cy - b
                else:
                    yield from _brushed(iter(((cx + a, cy + b), (cx - a, cy + b), (cx + a, cy - b), (cx - a, cy - b))), thickness)

    return _counted(points())


def text_hits(text: str, x: int, y: int, scale: int = 1, font: dict[str, tuple[int, ...]] | None = None) -> dict[Point, int]:
    glyphs, scale = {**FONT, **(font or {})}, max(1, scale)

    def points() -> Iterator[Point]:
        cx, cy = x, y
        for ch in text.encode("utf-8").decode("latin-1"):
            if ch == "\n":
                cx, cy = x, cy + 8 * scale
                continue
            if not 32 <= ord(ch) <= 127:
                ch = "?"
            check(ch in glyphs, f"the font has no glyph for {ch!r}")
            for row, bits in enumerate(glyphs[ch]):
                for col in range(8):
                    if bits >> col & 1:
                        for sy in range(scale):
                            for sx in range(scale):
                                yield cx + col * scale + sx, cy + row * scale + sy
            cx += 8 * scale

    return _counted(points())


def _bytes(color: Color) -> list[int]:
    return [int(v * 255 + 0.5) & 255 for v in color]


def _blended(color: Color, channels: int, times: Column) -> Column:
    """The sample after ``times`` blends, from c and v."""
    r, g, b, a = _bytes(color)
    if channels == 2:
        return F.col("v")
    if channels == 1:
        tone = F.lit((77 * r + 150 * g + 29 * b) >> 8 & 255)
    else:
        tone = F.when(F.col("c") == 0, F.lit(r)).when(F.col("c") == 1, F.lit(g)).otherwise(F.lit(b))
    once = lambda p: F.shiftright(tone * a + p * (255 - a), 8)
    # an opaque blend doesn't depend on what it covers
    out = once(F.col("v")) if a == 255 else F.aggregate(F.sequence(F.lit(1), times), F.col("v"), lambda p, _: once(p))
    return F.when(F.col("c") == 3, F.lit(255)).otherwise(out) if channels == 4 else out


def draw_hits(px: DataFrame, hits: dict[Point, int], color: Color, channels: int = 1) -> DataFrame:
    """Blends a shape over every image; hits outside are cut. The shape's own pixels are a small table."""
    if not hits:
        return px
    rows = px.sparkSession.createDataFrame([(y, x, n) for (x, y), n in hits.items()], "y int, x int, __n int")
    done = px.join(rows, ["y", "x"], "left")
    return done.select(*[F.when(F.col("__n").isNull(), F.col("v")).otherwise(_blended(color, channels, F.col("__n"))).alias("v") if c == "v" else c for c in px.columns])


def draw_line(px: DataFrame, p: Point, q: Point, color: Color, thickness: int = 1, channels: int = 1) -> DataFrame:
    return draw_hits(px, polyline_hits([p, q], thickness), color, channels)


def draw_polyline(px: DataFrame, points: list[Point], color: Color, thickness: int = 1, closed: bool = False, channels: int = 1) -> DataFrame:
    return draw_hits(px, polyline_hits(points, thickness, closed), color, channels)


def draw_rect(px: DataFrame, rect: tuple[int, int, int, int], color: Color, thickness: int = 1, filled: bool = False, channels: int = 1) -> DataFrame:
    """rect: x, y, width, height. A filled one is a condition on the coordinates."""
    x, y, w, h = rect
    if filled:
        inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
        return px.withColumn("v", F.when(inside, _blended(color, channels, F.lit(1))).otherwise(F.col("v")))
    a, b, c, d = (x, y), (x + w - 1, y), (x + w - 1, y + h - 1), (x, y + h - 1)
    return draw_hits(px, polyline_hits([a, b, c, d], thickness, closed=True), color, channels)


def draw_circle(px: DataFrame, center: Point, radius: int, color: Color, thickness: int = 1, filled: bool = False, channels: int = 1) -> DataFrame:
    return draw_hits(px, circle_hits(center, radius, thickness, filled), color, channels)


def draw_text(px: DataFrame, text: str, x: int, y: int, color: Color, scale: int = 1, channels: int = 1, font: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    return draw_hits(px, text_hits(text, x, y, scale, font), color, channels)


def draw_image(px: DataFrame, patch: DataFrame, x: int, y: int, channels: int = 1, patch_channels: int = 1) -> DataFrame:
    """Pastes the patch with the same image_id; its fourth channel is alpha, else it is opaque; a grey patch counts for all colours."""
    side = lambda c: F.max(F.when(F.col("c") == c, F.col("v")))
    red = side(0)
    tones = patch.groupBy("image_id", (F.col("y") + y).alias("y"), (F.col("x") + x).alias("x")).agg(
        red.alias("__r"), (side(1) if patch_channels >= 3 else red).alias("__g"), (side(2) if patch_channels >= 3 else red).alias("__b"), (side(3) if patch_channels == 4 else F.lit(255)).alias("__a")
    )
    if channels == 1:
        tone = F.shiftright(77 * F.col("__r") + 150 * F.col("__g") + 29 * F.col("__b"), 8)
    else:
        tone = F.when(F.col("c") == 0, F.col("__r")).when(F.col("c") == 1, F.col("__g")).otherwise(F.col("__b"))
    mixed = F.shiftright(tone * F.col("__a") + F.col("v") * (255 - F.col("__a")), 8)
    if channels == 4:
        mixed = F.when(F.col("c") == 3, F.lit(255)).otherwise(mixed)
    value = F.when(F.col("__r").isNull() | F.lit(channels == 2), F.col("v")).otherwise(mixed)
    return px.join(tones, ["image_id", "y", "x"], "left").select(*[value.cast("int").alias("v") if c == "v" else c for c in px.columns])
