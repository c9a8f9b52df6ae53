"""The operators on packed images: one row stays one image, so nothing is shuffled or exploded.

Each operator is a numpy kernel over whole images inside ``mapInArrow``; only
operators on two images join, by ``image_id``. Results equal those of the
relational forms sample by sample (the same queries check both); which form to
take is a matter of size: samples as rows go on into SQL, images as rows go
through as fast as memory is read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..model import IMAGES, Border, Interp, Rotation, SizeMismatch, Threshold, Unsupported, check, odd
from ..sources.codecs import _bound, step
from .detect import label_plane
from .stencil import _grown

Kernel = Callable[[np.ndarray], np.ndarray]
_MODE = {Border.ZERO: "constant", Border.REPLICATE: "edge", Border.REFLECT: "symmetric", Border.WRAP: "wrap"}
_TYPES = {"u8": np.dtype("u1"), "u16": np.dtype("<u2"), "f32": np.dtype("<f4")}
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary())
_NAMES = ("image_id", "width", "height", "channels", "depth", "data")


def _arrays(batch: pa.RecordBatch, suffix: str = ""):
    """Each row's samples (height, width, channels), without a copy."""
    shape = zip(*(batch.column(n + suffix).to_pylist() for n in ("height", "width", "channels", "depth")), strict=True)
    for blob, (h, w, c, depth) in zip(batch.column("data" + suffix), shape, strict=True):
        yield np.frombuffer(blob.as_buffer(), _TYPES[depth]).reshape(h, w, c)


def _rows(ids: pa.Array, images: list[np.ndarray]) -> pa.RecordBatch:
    names = {v: k for k, v in _TYPES.items()}
    cols = (ids, [a.shape[1] for a in images], [a.shape[0] for a in images], [a.shape[2] for a in images], [names[a.dtype] for a in images], [np.ascontiguousarray(a).data.cast("B") for a in images])
    return pa.RecordBatch.from_arrays([pa.array(v, t) if k else v for k, (v, t) in enumerate(zip(cols, _KINDS, strict=True))], names=_NAMES)


def apply(images: DataFrame, kernel: Kernel) -> DataFrame:
    """Images through a function of (height, width, channels) arrays."""

    def work(batches):
        for b in batches:
            if b.num_rows:
                yield _rows(b.column("image_id"), [kernel(a) for a in _arrays(b)])

    return step(images, IMAGES, work, IMAGES)


def apply_two(a: DataFrame, b: DataFrame | None, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Images with equal ids and shapes; an image that only one side has is an error. Without b, a is :func:`paired` and nothing is shuffled."""

    def work(batches):
        for t in batches:
            out = []
            check(not t.column("data").null_count and not t.column("data_b").null_count, "images differ", SizeMismatch)
            for x, y in zip(_arrays(t), _arrays(t, "_b"), strict=True):
                check(x.shape == y.shape and x.dtype == y.dtype, "images differ", SizeMismatch)
                out.append(kernel(x, y))
            if out:
                yield _rows(t.column("image_id"), out)

    both = a if b is None else paired(a, b)
    return _bound(both.mapInArrow, work, IMAGES)


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both images of an id in one row (``data`` and ``data_b`` and so on). Written once, it lets operators on two images run without a shuffle."""
    other = b.select(*[F.col(n).alias(n + "_b") if n != "image_id" else F.col(n).cast("long").alias(n) for n in _NAMES])
    return a.select(F.col("image_id").cast("long").alias("image_id"), *_NAMES[1:]).join(other, "image_id", "full")


def compatible(a: DataFrame, b: DataFrame) -> DataFrame:
    """image_id and whether both have it with equal width, height, channels and depth; the samples are not read."""
    facts = _NAMES[1:5]
    of = lambda f, s: f.select(F.col("image_id").cast("long").alias("image_id"), F.struct(*facts).alias(s))
    return of(a, "x").join(of(b, "y"), "image_id", "full").select("image_id", F.col("x").eqNullSafe(F.col("y")).alias("compatible"))


def _u8(a: np.ndarray) -> np.ndarray:
    return np.clip(a, 0, 255).astype(np.uint8)


# two images


def _bytes_only(a: np.ndarray) -> None:
    check(a.dtype == np.uint8, "samples of 8 bits are expected", Unsupported)


def add(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    def kernel(x, y):
        _bytes_only(x)
        out = x + y
        return np.maximum(out, np.negative(out < x, dtype=np.uint8, casting="unsafe"), out=out)  # 255 where it wrapped

    return apply_two(a, b, kernel)


def sub(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    def kernel(x, y):
        _bytes_only(x)
        return x - np.minimum(x, y)

    return apply_two(a, b, kernel)


def blend(a: DataFrame, b: DataFrame | None, alpha: float) -> DataFrame:
    k = max(0, min(256, int(alpha * 256 + 0.5)))

    def kernel(x, y):
        _bytes_only(x)
        return (x.astype(np.uint32) * k + y.astype(np.uint32) * (256 - k) >> 8).astype(np.uint8)

    return apply_two(a, b, kernel)


# tables


def lut(images: DataFrame, table: list[int]) -> DataFrame:
    t = np.array(table, np.uint8)

    def kernel(a):
        _bytes_only(a)
        return t[a]

    return apply(images, kernel)


def scale(images: DataFrame, factor: float) -> DataFrame:
    s = max(0, min(65535, int(factor * 256 + 0.5)))
    return lut(images, [min(255, v * s >> 8) for v in range(256)])


def _otsu(a: np.ndarray) -> int:
    n = np.bincount(a.ravel(), minlength=256)
    wb, sb = np.cumsum(n), np.cumsum(n * np.arange(256))
    wf = wb[-1] - wb
    good = (wb > 0) & (wf > 0)
    gap = np.where(good, sb / np.maximum(wb, 1) - (sb[-1] - sb) / np.maximum(wf, 1), 0.0)
    score = wb.astype(float) * wf.astype(float) * gap * gap
    return int(np.argmax(score)) if score.max() > 0 else 0


def threshold(images: DataFrame, t: float = 0, max_value: float = 255, kind: Threshold = Threshold.BINARY) -> DataFrame:
    high, low = (max(0, min(255, int(v))) for v in (max_value, t))
    if kind is Threshold.OTSU:
        return apply(images, lambda a: np.where(a > _otsu(a), np.uint8(high), np.uint8(0)))
    value = {Threshold.BINARY: lambda v: high if v > low else 0, Threshold.BINARY_INV: lambda v: 0 if v > low else high, Threshold.TRUNC: lambda v: min(v, low), Threshold.TOZERO: lambda v: v if v > low else 0}[kind]
    return lut(images, [value(v) for v in range(256)])


def equalize(images: DataFrame) -> DataFrame:
    def kernel(a):
        out = np.empty_like(a)
        for c in range(a.shape[2]):
            cdf = np.cumsum(np.bincount(a[..., c].ravel(), minlength=256))
            least = cdf[cdf > 0][0]
            table = np.floor((cdf - least) / (cdf[-1] - least) * 255.0 + 0.5) if cdf[-1] > least else np.zeros(256)
            out[..., c] = np.clip(table, 0, 255).astype(np.uint8)[a[..., c]]
        return out

    return apply(images, kernel)


def convert_channels(images: DataFrame, source: int, target: int) -> DataFrame:
    kernels: dict[tuple[int, int], Kernel] = {
        (3, 1): lambda a: ((a[..., 0].astype(np.uint16) * 77 + a[..., 1].astype(np.uint16) * 150 + a[..., 2].astype(np.uint16) * 29) >> 8).astype(np.uint8)[..., None],
        (1, 3): lambda a: np.repeat(a, 3, axis=2),
        (3, 4): lambda a: np.concatenate([a, np.full((*a.shape[:2], 1), 255, np.uint8)], axis=2),
        (4, 3): lambda a: a[..., :3],
    }
    check((source, target) in kernels, f"no conversion from {source} to {target} channels", Unsupported)
    return apply(images, kernels[source, target])


# neighbourhoods


def _slide(a: np.ndarray, axis: int, r: int, border: Border, dtype) -> tuple[np.ndarray, Callable[[int], np.ndarray]]:
    pad = [(0, 0)] * a.ndim
    pad[axis] = (r, r)
    p = np.pad(a, pad, mode=_MODE[border]).astype(dtype, copy=False)
    n = a.shape[axis]
    return p, lambda k: p[k : k + n] if axis == 0 else p[:, k : k + n]


def _line(a: np.ndarray, weights: list[int], axis: int, border: Border) -> np.ndarray:
    """A Q15 pass, rounded to samples; equal weights around the centre share a multiplication."""
    r = len(weights) // 2
    _, at = _slide(a, axis, r, border, np.int32)
    total = at(r) * np.int32(weights[r])
    for k in range(r):
        if weights[k] == weights[-1 - k]:
            total += (at(k) + at(2 * r - k)) * np.int32(weights[k])
        else:
            total += at(k) * np.int32(weights[k])
            total += at(2 * r - k) * np.int32(weights[-1 - k])
    total += 1 << 14
    total >>= 15
    return _u8(total)


def blur_gaussian(images: DataFrame, k: int = 0, sigma: float = 0.0, border: Border = Border.REPLICATE) -> DataFrame:
    weights = K.gaussian(*K.gaussian_size(k, sigma))
    return apply(images, lambda a: _line(_line(a, weights, 1, border), weights, 0, border))


def convolve2d(images: DataFrame, kernel: list[list[float]], border: Border = Border.REPLICATE) -> DataFrame:
    kh, kw = len(kernel), len(kernel[0])
    check(kh % 2 == 1 and kw % 2 == 1, "kernels have odd sizes")
    flat = K.q15([w for row in kernel for w in row])

    def run(a):
        p = np.pad(a, ((kh // 2, kh // 2), (kw // 2, kw // 2), (0, 0)), mode=_MODE[border]).astype(np.int64)
        total = np.full(a.shape, 1 << 14, np.int64)
        for j in range(kh):
            for i in range(kw):
                if flat[j * kw + i]:
                    total += p[j : j + a.shape[0], i : i + a.shape[1]] * flat[j * kw + i]
        return _u8(total >> 15)

    return apply(images, run)


def blur_box(images: DataFrame, k: int) -> DataFrame:
    k = odd(k)
    inverse, r = K.box_inverse(k), k // 2

    narrow = np.uint16 if 255 * k < 1 << 16 else np.uint32

    def down(a: np.ndarray) -> np.ndarray:
        """Means over columns of a (rows, samples) plane: a running sum takes a row in and leaves one out; some rows are divided together, in the cache."""
        n = len(a)
        row = lambda y: a[min(max(y, 0), n - 1)]
        out = np.empty_like(a)
        sums = np.zeros(a.shape[1], narrow)
        for y in range(-r, r + 1):
            sums += row(y)
        some = np.empty((64, a.shape[1]), narrow)
        for first in range(0, n, len(some)):
            m = min(len(some), n - first)
            for y in range(m):
                some[y] = sums
                sums += row(first + y + r + 1)
                sums -= row(first + y - r)
            mean = np.multiply(some[:m], np.uint32(inverse), dtype=np.uint32)
            mean += np.uint32(1 << 19)
            np.right_shift(mean, np.uint32(20), out=out[first : first + m], casting="unsafe")
        return out

    def turned(a: np.ndarray) -> np.ndarray:
        """Rows and columns exchanged, a pixel at a time."""
        return np.ascontiguousarray(a).view(np.dtype(("V", a.shape[2])))[..., 0].T.copy().view(np.uint8).reshape(a.shape[1], a.shape[0], a.shape[2])

    def kernel(a):
        _bytes_only(a)
        h, w, c = a.shape
        across = turned(down(turned(a).reshape(w, h * c)).reshape(w, h, c))
        return down(across.reshape(h, w * c)).reshape(h, w, c)

    return apply(images, kernel)


def _reach(a: np.ndarray, r: int, axis: int, pick, fill: int) -> np.ndarray:
    """Minimum or maximum over 2r + 1 samples in log(r) steps."""
    if not r:
        return a
    pad = [(0, 0)] * 3
    pad[axis] = (r, r)
    p = np.pad(a, pad, constant_values=fill)
    cut = (lambda x, i, j: x[i : x.shape[0] - j]) if axis == 0 else (lambda x, i, j: x[:, i : x.shape[1] - j])
    size, done = 2 * r + 1, 1
    while done < size:
        step = min(done, size - done)
        p = pick(cut(p, 0, step), cut(p, step, 0))
        done += step
    return p


def _morph(kw: int, kh: int, low: bool) -> Kernel:
    pick, fill = (np.minimum, 255) if low else (np.maximum, 0)
    return lambda a: _reach(_reach(a, kw // 2, 1, pick, fill), kh // 2, 0, pick, fill)


def erode(images: DataFrame, kw: int = 3, kh: int = 3) -> DataFrame:
    return apply(images, _morph(kw, kh, True))


def dilate(images: DataFrame, kw: int = 3, kh: int = 3) -> DataFrame:
    return apply(images, _morph(kw, kh, False))


def morph_open(images: DataFrame, kw: int = 3, kh: int = 3) -> DataFrame:
    return apply(images, lambda a: _morph(kw, kh, False)(_morph(kw, kh, True)(a)))


def morph_close(images: DataFrame, kw: int = 3, kh: int = 3) -> DataFrame:
    return apply(images, lambda a: _morph(kw, kh, True)(_morph(kw, kh, False)(a)))


def blur_median(images: DataFrame, k: int) -> DataFrame:
    k = odd(k)
    r, middle = k // 2, k * k // 2

    def run(a):
        p = np.pad(a, ((r, r), (r, r), (0, 0)), mode="edge")
        out = np.empty_like(a)
        for y in range(a.shape[0]):  # a row at a time bounds memory
            rows = np.lib.stride_tricks.sliding_window_view(p[y : y + k], k, axis=1)
            flat = rows.transpose(1, 2, 0, 3).reshape(a.shape[1], a.shape[2], k * k)
            out[y] = np.partition(flat, middle, axis=2)[..., middle]
        return out

    return apply(images, run)


def _gradients(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(a[..., 0], 1, mode="edge").astype(np.int32)
    d, s = p[:, 2:] - p[:, :-2], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return d[:-2] + 2 * d[1:-1] + d[2:], s[2:] - s[:-2]


def sobel(images: DataFrame, axis: str) -> DataFrame:
    """Derivatives along x or y as f32 images."""
    return apply(images, lambda a: _gradients(a)["xy".index(axis)].astype(np.float32)[..., None])


def canny(images: DataFrame, low: float, high: float) -> DataFrame:
    check(high > low, "the high threshold must be above the low one")
    weights, lo, hi = K.gaussian(5, 1.4), int(low * 4), int(high * 4)

    def run(a):
        gx, gy = _gradients(_line(_line(a, weights, 1, Border.REPLICATE), weights, 0, Border.REPLICATE))
        ax, ay = np.abs(gx), np.abs(gy)
        m = ax + ay
        kept = np.zeros_like(m)
        if min(m.shape) > 2:
            at = lambda dy, dx: m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx]
            flat, steep, same = 5 * ay < 2 * ax, 5 * ax < 2 * ay, gx.astype(np.int64) * gy > 0
            way = np.where(flat, 0, np.where(steep, 2, np.where(same, 1, 3)))[1:-1, 1:-1]
            one = np.choose(way, [at(0, -1), at(-1, 1), at(-1, 0), at(-1, -1)])
            two = np.choose(way, [at(0, 1), at(1, -1), at(1, 0), at(1, 1)])
            inner = at(0, 0)
            kept[1:-1, 1:-1] = np.where((inner >= one) & (inner >= two), inner, 0)
        return _grown(kept, lo, hi).astype(np.uint8)[..., None]

    return apply(images, run)


# geometry


def flip_h(images: DataFrame) -> DataFrame:
    return apply(images, lambda a: a[:, ::-1])


def flip_v(images: DataFrame) -> DataFrame:
    return apply(images, lambda a: a[::-1])


def rotate(images: DataFrame, turn: Rotation) -> DataFrame:
    times = {Rotation.CW: -1, Rotation.CCW: 1, Rotation.HALF: 2}[turn]
    return apply(images, lambda a: np.rot90(a, times))


def transpose(images: DataFrame) -> DataFrame:
    return apply(images, lambda a: a.transpose(1, 0, 2))


def crop(images: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    check(width > 0 and height > 0 and x + width > 0 and y + height > 0, "the region lies outside the image")

    def run(a):
        x0, y0 = min(max(0, x), a.shape[1] - 1), min(max(0, y), a.shape[0] - 1)
        return a[y0 : max(y + height, y0 + 1), x0 : max(x + width, x0 + 1)]

    return apply(images, run)


def resize(images: DataFrame, width: int, height: int, interp: Interp = Interp.BILINEAR) -> DataFrame:
    """Nearest and bilinear; bicubic is a relational operator."""
    check(interp is not Interp.BICUBIC, "take the relational form for bicubic", Unsupported)

    def nearest(a):
        return a[(np.arange(height) * a.shape[0] // height)[:, None], np.arange(width) * a.shape[1] // width]

    def linear(a):
        out = a.astype(np.int64)
        for axis, size in ((1, width), (0, height)):
            n = out.shape[axis]
            place = np.arange(size) * (((n - 1) << 16) // max(1, size - 1))
            first = place >> 16
            p, q = np.take(out, first, axis), np.take(out, np.minimum(first + 1, n - 1), axis)
            frac = (place & 65535).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
            out = p + ((q - p) * frac >> 16)
        return _u8(out)

    return apply(images, nearest if interp is Interp.NEAREST else lambda a: linear(a) if a.dtype == np.uint8 else nearest(a))


def connected_components(images: DataFrame) -> DataFrame:
    """Label images of u16; more than 65,535 labels are an error (the relational form has no such limit)."""

    def run(a):
        labels = label_plane(a[..., 0] != 0, 4)
        check(int(labels.max()) < 65536, "too many components for a label image", Unsupported)
        return labels.astype(np.uint16)[..., None]

    return apply(images, run)


def histogram(images: DataFrame) -> DataFrame:
    """image_id, c, bin, n, with zeros."""

    def work(batches):
        for b in batches:
            for i, a in zip(b.column("image_id").to_pylist(), _arrays(b), strict=True):
                for c in range(a.shape[2]):
                    n = np.bincount(a[..., c].ravel(), minlength=256)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(256, i, np.int64)), pa.array(np.full(256, c, np.int32)), pa.array(np.arange(256, dtype=np.int32)), pa.array(n.astype(np.int64))], names=["image_id", "c", "bin", "n"])

    return step(images, IMAGES, work, "image_id long, c int, bin int, n long")
