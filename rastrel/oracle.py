"""DuckDB SQL for the queries: gathers over neighbour offsets, written apart from the window plans they check."""

from __future__ import annotations

import math

import numpy as np

from .operators import draw

GRAY = """SELECT CAST(o_orderkey // 1024 AS INT) AS image_id, CAST((o_orderkey // 32) % 32 AS INT) AS y, CAST(o_orderkey % 32 AS INT) AS x, 0 AS c,
    CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS INT) AS v FROM orders
UNION ALL SELECT CAST(i // 1024 AS INT), CAST((i // 32) % 32 AS INT), CAST(i % 32 AS INT), 0, 0 FROM (SELECT unnest(range(max(o_orderkey) + 1, (max(o_orderkey) // 1024 + 1) * 1024)) AS i FROM orders)"""
RGB = """SELECT CAST(o_orderkey // 1024 AS INT) AS image_id, CAST((o_orderkey // 32) % 32 AS INT) AS y, CAST(o_orderkey % 32 AS INT) AS x, k.c AS c,
    CAST(CASE k.c WHEN 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 256 WHEN 1 THEN o_custkey % 256 ELSE (o_orderkey * 7 + o_custkey * 13) % 256 END AS INT) AS v
    FROM orders, (SELECT unnest([0, 1, 2]) AS c) k
UNION ALL SELECT CAST(i // 1024 AS INT), CAST((i // 32) % 32 AS INT), CAST(i % 32 AS INT), k.c, 0 FROM (SELECT unnest(range(max(o_orderkey) + 1, (max(o_orderkey) // 1024 + 1) * 1024)) AS i FROM orders), (SELECT unnest([0, 1, 2]) AS c) k"""
EVENTS = """SELECT CAST(event_id // 256 AS INT) AS image_id, CAST((event_id // 16) % 16 AS INT) AS y, CAST(event_id % 16 AS INT) AS x, 0 AS c,
    CAST(CAST(floor(value) AS BIGINT) % 256 AS INT) AS v FROM events
UNION ALL SELECT CAST(i // 256 AS INT), CAST((i // 16) % 16 AS INT), CAST(i % 16 AS INT), 0, 0 FROM (SELECT unnest(range(max(event_id) + 1, (max(event_id) // 256 + 1) * 256)) AS i FROM events)"""
EMBED = """SELECT CAST(vec_id AS INT) AS image_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, 0 AS c, CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.5) * 255))) AS INT) AS v
    FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"""
DOCS = """SELECT doc_id * 16777216 + n // 256 AS image_id, CAST(n % 256 // 16 AS INT) AS y, CAST(n % 16 AS INT) AS x, 0 AS c, CAST(CASE WHEN n < len(s) THEN ord(s[n + 1]) % 256 ELSE 0 END AS INT) AS v
    FROM (SELECT doc_id, s, unnest(range((len(s) + 255) // 256 * 256)) AS n FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS s FROM documents))"""
#: The weights of the queries' Gaussians in 1/32768, by size and sigma: exp(-d * d / (2 * sigma * sigma)), made to sum to 32768 at the centre.
GAUSSIAN = {
    (5, 1.0): [1785, 8002, 13194, 8002, 1785],
    (5, 1.4): [3611, 7763, 10020, 7763, 3611],
    (9, 2.0): [905, 2172, 4058, 5904, 6690, 5904, 4058, 2172, 905],
}
P = "image_id, y, x, c"
SIDE = 32


def q(source: str, select: str, more: str = "") -> str:
    """A query over px, the source's pixels."""
    return f"WITH RECURSIVE px AS MATERIALIZED ({source}){more}\n{select}"


def point(source: str, value: str) -> str:
    return q(source, f"SELECT {P}, CAST({value} AS INT) AS v FROM px")


def _place(i: str, n: int, border: str) -> str:
    if border == "replicate":
        return f"greatest(0, least({n - 1}, {i}))"
    if border == "reflect":
        return f"greatest(0, least({n - 1}, CASE WHEN {i} < 0 THEN -({i}) - 1 WHEN {i} >= {n} THEN {2 * n - 1} - ({i}) ELSE {i} END))"
    if border == "wrap":
        return f"((({i}) % {n}) + {n}) % {n}"
    return i


def gather(table: str, weights: dict[tuple[int, int], int], value: str, border: str = "replicate", w: int = SIDE, h: int = SIDE) -> str:
    """value: of acc (the weighted sum), for each pixel of the table."""
    rows = ", ".join(f"({dy}, {dx}, {k})" for (dy, dx), k in weights.items())
    return f"""SELECT {P}, {value} AS v FROM (SELECT p.image_id, p.y, p.x, p.c, CAST(sum(k.w * coalesce(n.v, 0)) AS BIGINT) AS acc FROM {table} p, (VALUES {rows}) k(dy, dx, w)
    LEFT JOIN {table} n ON n.image_id = p.image_id AND n.c = p.c AND n.y = {_place('p.y + k.dy', h, border)} AND n.x = {_place('p.x + k.dx', w, border)} GROUP BY ALL)"""


ROUND = "CAST(greatest(0, least(255, (acc + 16384) >> 15)) AS INT)"


def kernel(rows: list[list[int]]) -> dict[tuple[int, int], int]:
    ry, rx = len(rows) // 2, len(rows[0]) // 2
    return {(j - ry, i - rx): w for j, r in enumerate(rows) for i, w in enumerate(r) if w}


def q15(weights: list[float]) -> list[int]:
    """Single-precision weights in 1/32768, halves away from zero; what a sum near one lacks goes to the centre."""
    out = [math.floor(abs(float(np.float32(w))) * 32768 + 0.5) * (1 if w >= 0 else -1) for w in weights]
    if sum(out):
        out[len(out) // 2] += 32768 - sum(out)
    return out


def convolve(source: str, rows: list[list[float]], border: str = "replicate") -> str:
    flat = q15([w for r in rows for w in r])
    n = len(rows[0])
    return q(source, gather("px", kernel([flat[i : i + n] for i in range(0, len(flat), n)]), ROUND, border))


def passes(table: str, weights: list[int], value: str, name: str, w: int = SIDE, h: int = SIDE) -> str:
    """CTEs: a row pass, then a column pass, which is ``name``."""
    r = len(weights) // 2
    line = {(0, i - r): k for i, k in enumerate(weights)}
    return f""", {name}_x AS MATERIALIZED ({gather(table, line, value, w=w, h=h)}), {name} AS MATERIALIZED ({gather(name + '_x', {(b, a): k for (a, b), k in line.items()}, value, w=w, h=h)})"""


def gaussian(source: str, k: int, sigma: float) -> str:
    return q(source, f"SELECT {P}, v FROM g", passes("px", GAUSSIAN[k, sigma], ROUND, "g"))


def box(source: str, k: int) -> str:
    return q(source, f"SELECT {P}, v FROM g", passes("px", [1] * k, f"CAST((acc * {round(2**20 / k)} + 524288) >> 20 AS INT)", "g"))


def window(table: str, ry: int, rx: int, agg: str, border: str = "inside", w: int = SIDE, h: int = SIDE) -> str:
    """An aggregate of n.v over a rectangle of offsets."""
    y, x = ("p.y + a.i", "p.x + b.i") if border == "inside" else (_place("p.y + a.i", h, border), _place("p.x + b.i", w, border))
    return f"""SELECT p.image_id, p.y, p.x, p.c, CAST({agg} AS INT) AS v FROM {table} p, range({-ry}, {ry + 1}) a(i), range({-rx}, {rx + 1}) b(i)
    JOIN {table} n ON n.image_id = p.image_id AND n.c = p.c AND n.y = {y} AND n.x = {x} GROUP BY p.image_id, p.y, p.x, p.c"""


def median(source: str, k: int) -> str:
    return q(source, window("px", k // 2, k // 2, f"list_sort(list(n.v))[{k * k // 2 + 1}]", "replicate"))


def bilateral(source: str, k: int, ss: float, sc: float, side: int) -> str:
    r = k // 2
    near = ", ".join(f"({dy}, {dx}, {math.exp(-(dx * dx + dy * dy) / (2 * ss**2))!r}::DOUBLE)" for dy in range(-r, r + 1) for dx in range(-r, r + 1))
    alike = ", ".join(f"({d}, {math.exp(-(d * d) / (2 * sc**2))!r}::DOUBLE)" for d in range(256))
    return q(
        source,
        f"""SELECT p.image_id, p.y, p.x, p.c, CAST(greatest(0, least(255, floor(sum(k.w * a.w * n.v) / sum(k.w * a.w) + 0.5))) AS INT) AS v FROM px p, (VALUES {near}) k(dy, dx, w)
    JOIN px n ON n.image_id = p.image_id AND n.c = p.c AND n.y = {_place('p.y + k.dy', side, 'replicate')} AND n.x = {_place('p.x + k.dx', side, 'replicate')}
    JOIN (VALUES {alike}) a(d, w) ON a.d = abs(n.v - p.v) GROUP BY p.image_id, p.y, p.x, p.c""",
    )


SX = kernel([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
SY = kernel([[-1, -2, -1], [0, 0, 0], [1, 2, 1]])


def gradients(table: str) -> str:
    """A CTE ``gr`` with gx, gy."""
    return f""", gx AS MATERIALIZED ({gather(table, SX, 'acc')}), gy AS MATERIALIZED ({gather(table, SY, 'acc')}),
gr AS MATERIALIZED (SELECT a.image_id, a.y, a.x, a.c, a.v AS gx, b.v AS gy FROM gx a JOIN gy b USING ({P}))"""


def suppressed(source: str) -> str:
    """CTEs up to ``nm``, the suppressed magnitudes."""
    step = "CASE WHEN 5 * abs(gy) < 2 * abs(gx) THEN 0 WHEN 5 * abs(gx) < 2 * abs(gy) THEN 90 WHEN gx * gy > 0 THEN 45 ELSE 135 END"
    return f"""WITH RECURSIVE px AS MATERIALIZED ({source}){passes('px', GAUSSIAN[5, 1.4], ROUND, 'g')}{gradients('g')},
mg AS MATERIALIZED (SELECT {P}, abs(gx) + abs(gy) AS m, {step} AS d FROM gr),
nb AS (SELECT *, CASE d WHEN 0 THEN 0 ELSE -1 END AS ay, CASE d WHEN 0 THEN -1 WHEN 45 THEN 1 WHEN 90 THEN 0 ELSE -1 END AS ax FROM mg),
nm AS MATERIALIZED (SELECT n.image_id, n.y, n.x, n.c, CAST(CASE WHEN a.m IS NOT NULL AND b.m IS NOT NULL AND n.y BETWEEN 1 AND {SIDE - 2} AND n.x BETWEEN 1 AND {SIDE - 2} AND n.m >= a.m AND n.m >= b.m THEN n.m ELSE 0 END AS INT) AS v
    FROM nb n LEFT JOIN mg a ON a.image_id = n.image_id AND a.y = n.y + n.ay AND a.x = n.x + n.ax LEFT JOIN mg b ON b.image_id = n.image_id AND b.y = n.y - n.ay AND b.x = n.x - n.ax)"""


def canny(source: str, low: float, high: float) -> str:
    lo, hi = int(low * 4), int(high * 4)
    return f"""{suppressed(source)},
rc AS (SELECT image_id, y, x FROM nm WHERE v >= {hi} AND y BETWEEN 1 AND {SIDE - 2} AND x BETWEEN 1 AND {SIDE - 2} UNION SELECT n.image_id, n.y, n.x FROM rc r JOIN nm n ON n.image_id = r.image_id AND abs(n.y - r.y) <= 1 AND abs(n.x - r.x) <= 1 AND n.v >= {lo})
SELECT n.image_id, n.y, n.x, n.c, CASE WHEN r.image_id IS NOT NULL OR n.v >= {hi} THEN 255 ELSE 0 END AS v FROM nm n LEFT JOIN rc r USING (image_id, y, x)"""


def components(source: str, cut: int) -> str:
    """CTEs up to ``cc`` (image_id, y, x, label): labels flow as smallest raster places."""
    return f"""WITH RECURSIVE px AS MATERIALIZED ({source}), fg AS MATERIALIZED (SELECT image_id, y, x, y * {SIDE} + x AS i FROM px WHERE v > {cut}),
rc AS (SELECT image_id, y, x, i FROM fg UNION SELECT n.image_id, n.y, n.x, r.i FROM rc r JOIN fg n ON n.image_id = r.image_id AND abs(n.y - r.y) + abs(n.x - r.x) = 1 AND r.i < n.i),
ml AS (SELECT image_id, y, x, min(i) AS i FROM rc GROUP BY ALL),
-- a place may reach a smaller one only by larger ones: united until the smallest agrees
un AS (SELECT a.image_id, a.i AS a, b.i AS b FROM ml a JOIN ml b ON b.image_id = a.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND a.i <> b.i GROUP BY ALL),
rr AS (SELECT DISTINCT image_id, i AS a, i AS r FROM ml UNION SELECT u.image_id, u.a, r.r FROM un u JOIN rr r ON r.image_id = u.image_id AND r.a = u.b),
rt AS (SELECT image_id, a, min(r) AS r FROM rr GROUP BY ALL),
lb AS (SELECT m.image_id, m.y, m.x, dense_rank() OVER (PARTITION BY m.image_id ORDER BY t.r) AS label FROM ml m JOIN rt t ON t.image_id = m.image_id AND t.a = m.i),
cc AS (SELECT p.image_id, p.y, p.x, CAST(coalesce(l.label, 0) AS INT) AS label FROM px p LEFT JOIN lb l USING (image_id, y, x))"""


def harris(source: str, side: int, k: float, threshold: float, r: int, limit: int) -> str:
    square = {(a, b): 1 for a in range(-2, 3) for b in range(-2, 3)}
    part = lambda name, e: f", {name}0 AS (SELECT {P}, {e} AS v FROM gr), {name} AS MATERIALIZED ({gather(name + '0', square, 'acc', w=side, h=side)})"
    gr = f""", gx AS MATERIALIZED ({gather('px', SX, 'acc', w=side, h=side)}), gy AS MATERIALIZED ({gather('px', SY, 'acc', w=side, h=side)}),
gr AS MATERIALIZED (SELECT a.image_id, a.y, a.x, a.c, a.v AS gx, b.v AS gy FROM gx a JOIN gy b USING ({P}))"""
    e = r + 1
    return f"""WITH px AS MATERIALIZED ({source}){gr}{part('xx', 'gx * gx')}{part('yy', 'gy * gy')}{part('xy', 'gx * gy')},
rs AS MATERIALIZED (SELECT image_id, y, x, (a.v / 25.0::DOUBLE) * (b.v / 25.0::DOUBLE) - (d.v / 25.0::DOUBLE) * (d.v / 25.0::DOUBLE) - {k!r}::DOUBLE * (a.v / 25.0::DOUBLE + b.v / 25.0::DOUBLE) * (a.v / 25.0::DOUBLE + b.v / 25.0::DOUBLE) AS r
    FROM xx a JOIN yy b USING ({P}) JOIN xy d USING ({P})),
pk AS (SELECT p.image_id, p.y, p.x, p.r, row_number() OVER (PARTITION BY p.image_id ORDER BY p.y, p.x) AS n FROM rs p
    WHERE p.y BETWEEN {e} AND {side - 1 - e} AND p.x BETWEEN {e} AND {side - 1 - e} AND p.r >= {threshold!r}::DOUBLE
    AND NOT EXISTS (SELECT 1 FROM rs o WHERE o.image_id = p.image_id AND o.y BETWEEN p.y - {r} AND p.y + {r} AND o.x BETWEEN p.x - {r} AND p.x + {r} AND o.r > p.r))
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY r DESC, y, x) AS INT) AS rank, x, y, r AS response, 1.0::DOUBLE AS scale FROM pk WHERE n <= {limit}"""


def otsu(source: str) -> str:
    """CTEs up to ``ot`` (image_id, threshold), over all 256 bins."""
    return f"""WITH px AS MATERIALIZED ({source}), bn AS (SELECT i.image_id, b.v, (SELECT count(*) FROM px p WHERE p.image_id = i.image_id AND p.v = b.v) AS n FROM (SELECT DISTINCT image_id FROM px) i, range(256) b(v)),
cm AS (SELECT image_id, v, CAST(sum(n) OVER o AS BIGINT) AS wb, CAST(sum(n) OVER (PARTITION BY image_id) AS BIGINT) AS t, CAST(sum(v * n) OVER o AS BIGINT) AS sb, CAST(sum(v * n) OVER (PARTITION BY image_id) AS BIGINT) AS s FROM bn WINDOW o AS (PARTITION BY image_id ORDER BY v)),
vr AS (SELECT image_id, v, CASE WHEN wb = 0 OR wb = t THEN 0.0::DOUBLE ELSE CAST(wb AS DOUBLE) * CAST(t - wb AS DOUBLE) * (sb / wb - (s - sb) / (t - wb)) * (sb / wb - (s - sb) / (t - wb)) END AS r FROM cm),
ot AS (SELECT image_id, CAST(CASE WHEN r > 0 THEN v ELSE 0 END AS INT) AS threshold FROM vr QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY r DESC, v) = 1)"""


def clahe(source: str, side: int, tile: int, clip: float) -> str:
    n = side // tile
    place = lambda a: f"(({a} + 0.5::DOUBLE) / {tile} - 0.5::DOUBLE)"
    return f"""WITH px AS MATERIALIZED ({source}), tl AS (SELECT image_id, c, y // {tile} AS ty, x // {tile} AS tx, v FROM px),
bn AS (SELECT t.image_id, t.c, t.ty, t.tx, b.v, (SELECT count(*) FROM tl p WHERE p.image_id = t.image_id AND p.c = t.c AND p.ty = t.ty AND p.tx = t.tx AND p.v = b.v) AS n FROM (SELECT DISTINCT image_id, c, ty, tx FROM tl) t, range(256) b(v)),
cl AS (SELECT *, greatest(1, CAST(floor({clip}::DOUBLE * {tile * tile} / 256.0) AS INT)) AS cap FROM bn), ex AS (SELECT *, CAST(sum(greatest(0, n - cap)) OVER (PARTITION BY image_id, c, ty, tx) AS BIGINT) AS e FROM cl),
nn AS (SELECT *, least(n, cap) + e // 256 + CASE WHEN v < e % 256 THEN 1 ELSE 0 END AS m FROM ex), cd AS (SELECT *, CAST(sum(m) OVER (PARTITION BY image_id, c, ty, tx ORDER BY v) AS BIGINT) AS cdf FROM nn),
lo AS (SELECT *, min(CASE WHEN m > 0 THEN cdf END) OVER (PARTITION BY image_id, c, ty, tx) AS least_ FROM cd),
lu AS MATERIALIZED (SELECT image_id, c, ty, tx, v, CASE WHEN {tile * tile} > least_ AND cdf >= least_ THEN greatest(0, least(255, floor((cdf - least_) / CAST({tile * tile} - least_ AS DOUBLE) * 255.0 + 0.5))) ELSE 0 END AS lut FROM lo),
pl AS (SELECT *, {place('y')} AS fy, {place('x')} AS fx FROM px), ps AS (SELECT *, CAST(trunc(fy) AS INT) AS iy, CAST(trunc(fx) AS INT) AS ix FROM pl),
tp AS (SELECT s.*, greatest(0, least({n - 1}, iy + a.i)) AS ty, greatest(0, least({n - 1}, ix + b.i)) AS tx, (CASE a.i WHEN 0 THEN 1 - (fy - iy) ELSE fy - iy END) * (CASE b.i WHEN 0 THEN 1 - (fx - ix) ELSE fx - ix END) AS w FROM ps s, range(2) a(i), range(2) b(i))
SELECT t.image_id, t.y, t.x, t.c, CAST(greatest(0, least(255, trunc(sum(t.w * l.lut) + 0.5))) AS INT) AS v FROM tp t JOIN lu l ON l.image_id = t.image_id AND l.c = t.c AND l.ty = t.ty AND l.tx = t.tx AND l.v = t.v GROUP BY t.image_id, t.y, t.x, t.c"""


def bilinear(table: str, sw: int, sh: int, dw: int, dh: int) -> str:
    rx, ry = ((sw - 1) << 16) // max(1, dw - 1), ((sh - 1) << 16) // max(1, dh - 1)
    row = lambda a, b: f"({a}.v + ((({b}.v - {a}.v) * (g.fx & 65535)) >> 16))"
    at = lambda t, y, x: f"JOIN {table} {t} ON {t}.image_id = g.image_id AND {t}.y = {y} AND {t}.x = {x}"
    top, low = row("a", "b"), row("d", "e")
    return f"""SELECT g.image_id, CAST(g.dy AS INT) AS y, CAST(g.dx AS INT) AS x, a.c AS c, CAST({top} + ((({low} - {top}) * (g.fy & 65535)) >> 16) AS INT) AS v
    FROM (SELECT i.image_id, dy, dx, dy * {ry} AS fy, dx * {rx} AS fx FROM (SELECT DISTINCT image_id FROM {table}) i, range({dh}) a(dy), range({dw}) b(dx)) g
    {at('a', '(g.fy >> 16)', '(g.fx >> 16)')} {at('b', '(g.fy >> 16)', f'least({sw - 1}, (g.fx >> 16) + 1)')} AND b.c = a.c
    {at('d', f'least({sh - 1}, (g.fy >> 16) + 1)', '(g.fx >> 16)')} AND d.c = a.c {at('e', f'least({sh - 1}, (g.fy >> 16) + 1)', f'least({sw - 1}, (g.fx >> 16) + 1)')} AND e.c = a.c"""


def bicubic(source: str, s: int, d: int) -> str:
    weight = lambda t: f"CASE WHEN abs({t}) < 1 THEN 1.5 * abs({t}) ** 3 - 2.5 * abs({t}) ** 2 + 1 WHEN abs({t}) < 2 THEN -0.5 * abs({t}) ** 3 + 2.5 * abs({t}) ** 2 - 4 * abs({t}) + 2 ELSE 0 END"
    f = lambda a: f"(({a} + 0.5::DOUBLE) * {s / d!r}::DOUBLE - 0.5::DOUBLE)"
    return q(
        source,
        f"""SELECT image_id, CAST(dy AS INT) AS y, CAST(dx AS INT) AS x, c, CAST(greatest(0, least(255, trunc(sum(w * v) / sum(w) + 0.5))) AS INT) AS v FROM (
    SELECT p.image_id, t.dy, t.dx, p.c, p.v, ({weight('(t.fy - (t.iy + t.m))')}) * ({weight('(t.fx - (t.ix + t.n))')}) AS w FROM (
        SELECT dy, dx, m, n, {f('dy')} AS fy, {f('dx')} AS fx, CAST(trunc({f('dy')}) AS INT) AS iy, CAST(trunc({f('dx')}) AS INT) AS ix FROM range({d}) a(dy), range({d}) b(dx), range(-1, 3) e(m), range(-1, 3) g(n)) t
    JOIN px p ON p.y = {_place('t.iy + t.m', s, 'replicate')} AND p.x = {_place('t.ix + t.n', s, 'replicate')}) GROUP BY ALL""",
    )


def affine(source: str, m: list[float], nearest: bool, zero: bool = False) -> str:
    s = lambda a, b, c: f"({a!r}::DOUBLE * dx + {b!r}::DOUBLE * dy + {c!r}::DOUBLE)"
    grid = f"SELECT i.image_id, dy, dx, {s(*m[:3])} AS sx, {s(*m[3:])} AS sy FROM (SELECT DISTINCT image_id FROM px) i, range({SIDE}) a(dy), range({SIDE}) b(dx)"
    clamp = lambda i: _place(i, SIDE, "replicate")
    if nearest:
        value = f"CASE WHEN g.ix BETWEEN 0 AND {SIDE - 1} AND g.iy BETWEEN 0 AND {SIDE - 1} THEN p.v ELSE 0 END" if zero else "p.v"
        return q(source, f"""SELECT g.image_id, CAST(g.dy AS INT) AS y, CAST(g.dx AS INT) AS x, p.c, CAST({value} AS INT) AS v
    FROM (SELECT *, CAST(trunc(sx + 0.5) AS INT) AS ix, CAST(trunc(sy + 0.5) AS INT) AS iy FROM ({grid})) g JOIN px p ON p.image_id = g.image_id AND p.y = {clamp('g.iy')} AND p.x = {clamp('g.ix')}""")
    at = lambda t, y, x: f"JOIN px {t} ON {t}.image_id = g.image_id AND {t}.y = {clamp('g.iy + ' + y)} AND {t}.x = {clamp('g.ix + ' + x)}"
    v = "(a.v * (1.0 - (sx - ix)) + b.v * (sx - ix)) * (1.0 - (sy - iy)) + (d.v * (1.0 - (sx - ix)) + e.v * (sx - ix)) * (sy - iy)"
    return q(source, f"""SELECT g.image_id, CAST(g.dy AS INT) AS y, CAST(g.dx AS INT) AS x, a.c, CAST(greatest(0, least(255, trunc({v} + 0.5))) AS INT) AS v
    FROM (SELECT *, CAST(trunc(sx) AS INT) AS ix, CAST(trunc(sy) AS INT) AS iy FROM ({grid})) g {at('a', '0', '0')} {at('b', '0', '1')} {at('d', '1', '0')} {at('e', '1', '1')}""")


def pyramid(source: str, levels: int, laplacian: bool) -> str:
    more, n, tables = "", SIDE, ["px"]
    for k in range(1, levels):
        more += passes(tables[-1], GAUSSIAN[5, 1.0], ROUND, f"b{k}", n, n)
        more += f", l{k} AS MATERIALIZED ({bilinear(f'b{k}', n, n, n // 2, n // 2)})"
        tables.append(f"l{k}")
        n //= 2
    out, n = [], SIDE
    for k, t in enumerate(tables):
        if laplacian and k + 1 < levels:
            more += f", u{k} AS MATERIALIZED ({bilinear(tables[k + 1], n // 2, n // 2, n, n)})"
            out.append(f"SELECT p.image_id, p.y, p.x, p.c, CAST(greatest(0, least(255, p.v - u.v + 128)) AS INT) AS v, {k} AS level FROM {t} p JOIN u{k} u USING ({P})")
        else:
            out.append(f"SELECT {P}, v, {k} AS level FROM {t}")
        n //= 2
    return q(source, " UNION ALL ".join(out), more)


def drawn(source: str, hits: str, tone: int, alpha: int) -> str:
    """hits: SQL for x, y, n."""
    value = f"({tone} * {alpha}) >> 8" if alpha == 255 else f"list_reduce(list_prepend(p.v, range(h.n)), lambda a, b: ({tone} * {alpha} + a * {255 - alpha}) >> 8)"
    return q(source, f"SELECT p.image_id, p.y, p.x, p.c, CAST(CASE WHEN h.n IS NULL THEN p.v ELSE {value} END AS INT) AS v FROM px p LEFT JOIN (SELECT x, y, count(*) AS n FROM ({hits}) GROUP BY ALL) h ON h.x = p.x AND h.y = p.y")


def line_sql(p: tuple[int, int], e: tuple[int, int], half: int = 0) -> str:
    dx, dy = abs(e[0] - p[0]), abs(e[1] - p[1])
    sx, sy = (1 if p[0] < e[0] else -1), (1 if p[1] < e[1] else -1)
    return f"""SELECT l.x + a.i AS x, l.y + b.i AS y FROM (WITH RECURSIVE l(x, y, g) AS (SELECT {p[0]}, {p[1]}, {dx - dy} UNION ALL
    SELECT x + CASE WHEN 2 * g > {-dy} THEN {sx} ELSE 0 END, y + CASE WHEN 2 * g < {dx} THEN {sy} ELSE 0 END, g - CASE WHEN 2 * g > {-dy} THEN {dy} ELSE 0 END + CASE WHEN 2 * g < {dx} THEN {dx} ELSE 0 END FROM l WHERE NOT (x = {e[0]} AND y = {e[1]})) SELECT * FROM l) l, range({-half}, {half + 1}) a(i), range({-half}, {half + 1}) b(i)"""


def circle_sql(c: tuple[int, int], r: int) -> str:
    eight = " UNION ALL ".join(f"SELECT {c[0]} + {sx} * {a} AS x, {c[1]} + {sy} * {b} AS y FROM o" for a, b in (("x", "y"), ("y", "x")) for sx in (1, -1) for sy in (1, -1))
    return f"""WITH RECURSIVE o(x, y, d) AS (SELECT 0, {r}, {1 - r} UNION ALL SELECT x + 1, CASE WHEN d < 0 THEN y ELSE y - 1 END, CASE WHEN d < 0 THEN d + 2 * x + 3 ELSE d + 2 * (x - y) + 5 END FROM o WHERE x + 1 <= CASE WHEN d < 0 THEN y ELSE y - 1 END) {eight}"""


def text_sql(text: str, x: int, y: int) -> str:
    rows = ", ".join(f"({k}, {r}, {bits})" for k, ch in enumerate(text) for r, bits in enumerate(draw.FONT[ch]))
    return f"SELECT {x} + 8 * k + b.i AS x, {y} + r AS y FROM (VALUES {rows}) t(k, r, bits), range(8) b(i) WHERE (bits >> CAST(b.i AS INT)) & 1 = 1"
