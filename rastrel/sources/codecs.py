"""Image files and packed images: PPM/PGM and PNG codecs, and the way between ``images`` and ``pixels``."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import IMAGES, PIXELS, FormatError, Overflow, Unsupported, check

_TYPES = {"u8": np.dtype("u1"), "u16": np.dtype("<u2"), "f32": np.dtype("<f4")}
FILES = "image_id long, content binary"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of PNG colour types.
_COLOURS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def step(frame: DataFrame, takes: str, work, gives: str) -> DataFrame:
    """``mapInArrow`` over the columns that ``takes`` names. On the frame of another step (or of :func:`pack`) both run in one
    Python worker: in Spark's plan each step has a worker of its own in each task, and images go back to the JVM between them."""
    gave, run, before = getattr(frame, "_step", (None, None, None))
    if gave == takes:
        return _bound(run, lambda batches: work(before(batches)), gives)
    columns = [c.split() for c in takes.split(", ")]
    base = frame.select(*[F.col(c).cast(t).alias(c) if c == "image_id" else F.col(c) for c, t in columns])
    return _bound(base.mapInArrow, work, gives)


def _bound(run, work, gives: str) -> DataFrame:
    out = run(work, gives)
    out._step = (gives, run, work)
    return out


def decode_ppm(blob: bytes) -> np.ndarray:
    """P5 or P6 with a maximum of 255; comments and white space may stand between header fields."""
    fields, at = [], 2
    kind = blob[:2]
    check(kind in (b"P5", b"P6"), "neither P5 nor P6", FormatError)
    field = re.compile(rb"(?:[ \t\r\n\v\f]+|#[^\n]*\n?)*([0-9]+)")
    while len(fields) < 3:
        m = field.match(blob, at)
        check(m is not None, "header ends early", FormatError)
        fields.append(int(m[1]))
        at = m.end()
    w, h, top = fields
    check(top == 255, "the maximum must be 255", FormatError)
    check(w > 0 and h > 0, "empty image", FormatError)
    at, channels = at + 1, 1 if kind == b"P5" else 3
    check(len(blob) - at >= w * h * channels, "pixel data ends early", FormatError)
    return np.frombuffer(blob, np.uint8, w * h * channels, at).reshape(h, w, channels)


def encode_ppm(image: np.ndarray, capacity: int | None = None) -> bytes:
    h, w, channels = image.shape
    check(channels in (1, 3) and image.dtype == np.uint8, "PPM holds 1 or 3 channels of u8", Unsupported)
    out = b"%s\n%d %d\n255\n" % (b"P5" if channels == 1 else b"P6", w, h) + image.tobytes()
    check(capacity is None or len(out) <= capacity, "buffer too small", Overflow)
    return out


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(image: np.ndarray, level: int = 0) -> bytes:
    """u8 images of 1, 3 or 4 channels; rows without a filter."""
    h, w, channels = image.shape
    check(channels in (1, 3, 4) and image.dtype == np.uint8, "PNG output holds 1, 3 or 4 channels of u8", Unsupported)
    colour = {1: 0, 3: 2, 4: 6}[channels]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * channels)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undoes row filters: none, left, above, mean, Paeth."""
    out = np.zeros(raw.shape, np.uint8)
    above = np.zeros(raw.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        row = raw[y]
        check(kind <= 4, "unknown row filter", FormatError)
        if kind == 0:
            now = row.copy()
        elif kind == 1:
            now = np.cumsum(np.pad(row, (0, -len(row) % step)).reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(row)]
        elif kind == 2:
            now = row + above
        else:
            now, values = np.zeros(len(row), np.uint8), row.tolist()
            left, up = [0] * (len(row) + step), above.tolist()
            for i, v in enumerate(values):
                a, b = left[i], up[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[i - step] if i >= step else 0
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                left[i + step] = v + guess & 255
            now[:] = left[step:]
        out[y] = above = now
    return out


def decode_png(blob: bytes) -> np.ndarray:
    """8- and 16-bit images without interlace. 16-bit samples keep the high byte, grey with alpha drops it, palettes are looked up."""
    check(blob[:8] == _SIGNATURE, "no PNG signature", FormatError)
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(blob):
        size, kind = struct.unpack(">I4s", blob[at : at + 8])
        body = blob[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    check(head is not None and bool(data), "header or data missing", FormatError)
    w, h, depth, colour, _, _, interlace = head
    check(depth in (8, 16) and colour in _COLOURS and not interlace, "bit depth, colour type or interlace not supported", Unsupported)
    channels, size = _COLOURS[colour], depth // 8
    stride = w * channels * size
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise FormatError(str(e)) from e
    check(len(raw) >= h * (stride + 1), "pixel data ends early", FormatError)
    raw = raw[: h * (stride + 1)].reshape(h, stride + 1)
    out = _unfilter(raw[:, 1:], raw[:, 0], channels * size).reshape(h, w, channels, size)[..., 0]
    if colour == 3:
        check(palette is not None and int(out.max()) < len(palette), "palette missing or too short", FormatError)
        return palette[out[..., 0]]
    return out[..., :1] if colour == 4 else out


def decode(blob: bytes, channels: int = 0) -> np.ndarray:
    """By signature; ``channels`` 1, 3 or 4 converts, 0 keeps."""
    image = decode_png(blob) if blob[:4] == _SIGNATURE[:4] else decode_ppm(blob)
    if channels in (0, image.shape[2]):
        return image
    check(channels in (1, 3, 4), "channels must be 0, 1, 3 or 4")
    colour = image[..., :3] if image.shape[2] >= 3 else np.repeat(image[..., :1], 3, axis=2)
    if channels == 1:
        return (colour.astype(np.int32) @ np.array([77, 150, 29]) >> 8).astype(np.uint8)[..., None]
    alpha = image[..., 3:] if image.shape[2] == 4 else np.full((*image.shape[:2], 1), 255, np.uint8)
    return colour if channels == 3 else np.concatenate([colour, alpha], axis=2)


def write_jpeg(*_: object, **__: object) -> None:
    """There is no JPEG encoder among the libraries this package may use."""
    raise Unsupported("JPEG output is not available")


def _row(image_id: int, image: np.ndarray) -> tuple:
    h, w, c = image.shape
    return image_id, w, h, c, "u8", image.tobytes()


def path_part(path: str) -> str:
    """A file's path without scheme and host, so that all readers name an image alike."""
    rest = path.partition("://")[2].partition("/")[2] if "://" in path else path.removeprefix("file:")
    return "/" + rest.lstrip("/")


def path_id(path: str) -> int:
    """The 64-bit id of a file's image, for readers without Spark's functions; equal to the column in :func:`decode_files`."""
    import xxhash

    n = xxhash.xxh64_intdigest(path_part(path).encode(), seed=42)
    return n - (1 << 64) if n >> 63 else n


def decode_files(files: DataFrame, channels: int = 0) -> DataFrame:
    """``images`` and path from a binaryFile frame (path, content), batch or stream. image_id is a hash of the path without scheme and host."""
    schema = IMAGES + ", path string"

    def work(batches):
        for b in batches:
            rows = [(*_row(i, decode(blob, channels)), p) for i, p, blob in zip(b.column("image_id").to_pylist(), b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["image_id", "width", "height", "channels", "depth", "data", "path"])

    plain = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    name = F.concat(F.lit("/"), F.ltrim(plain, F.lit("/")))
    return files.select(F.xxhash64(name).alias("image_id"), "path", "content").mapInArrow(work, schema)


def decode_contents(files: DataFrame, channels: int = 0) -> DataFrame:
    """``images`` from (image_id, content) rows."""

    def work(batches):
        for b in batches:
            for i, blob in zip(b.column("image_id").to_pylist(), b.column("content"), strict=True):
                row = _row(i, decode(blob.as_py(), channels))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["image_id", "width", "height", "channels", "depth", "data"])

    return step(files, FILES, work, IMAGES)


def read_images(spark: SparkSession, path: str, channels: int = 0) -> DataFrame:
    return decode_files(spark.read.format("binaryFile").load(path), channels)


def unpack(images: DataFrame, floats: bool = False) -> DataFrame:
    """``pixels`` from ``images``. floats: of f32 samples, which are then doubles; else of integer ones."""

    def work(batches):
        for b in batches:
            for i, w, h, c, depth, data in zip(*(b.column(k).to_pylist() for k in ("image_id", "width", "height", "channels", "depth", "data")), strict=True):
                check((depth == "f32") == floats, "float samples have no integer pixels, and integers no float ones", Unsupported)
                v = np.frombuffer(data, _TYPES[depth]).astype(np.float64 if floats else np.int32)
                check(len(v) == w * h * c, "data doesn't fit the image's size", FormatError)
                n = np.arange(len(v), dtype=np.int32)
                full = lambda x: pa.array(np.full(len(v), x, np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int64)), full(w), full(h), pa.array(n // (w * c)), pa.array(n // c % w), pa.array(n % c), pa.array(v)], names=["image_id", "w", "h", "y", "x", "c", "v"])

    return step(images, IMAGES, work, PIXELS.replace("v int", "v double") if floats else PIXELS)


def pack(px: DataFrame, depth: str = "u8") -> DataFrame:
    """``images`` from ``pixels``; samples are placed by their coordinates."""

    def work(tables):
        for table in tables:
            y, x, c = (table.column(k).to_numpy() for k in "yxc")
            shape = (int(table.column("h")[0].as_py()), int(table.column("w")[0].as_py()), int(c.max()) + 1)
            check(len(y) == shape[0] * shape[1] * shape[2], "samples are missing", FormatError)
            out = np.zeros(shape, _TYPES[depth])
            out[y, x, c] = table.column("v").to_numpy()
            row = [[table.column("image_id")[0].as_py()], [shape[1]], [shape[0]], [shape[2]], [depth], [out.tobytes()]]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["image_id", "width", "height", "channels", "depth", "data"])

    groups = px.select(F.col("image_id").cast("long").alias("image_id"), "w", "h", "y", "x", "c", "v").groupBy("image_id")
    return _bound(lambda work, gives: groups.applyInArrow(lambda table: pa.Table.from_batches(work(iter([table]))), gives), work, IMAGES)


def ppm_header(images: DataFrame) -> Column:
    kind = F.when(F.col("channels") == 1, F.lit("P5")).when(F.col("channels") == 3, F.lit("P6")).otherwise(F.raise_error(F.lit("PPM holds 1 or 3 channels")))
    return F.concat(kind, F.lit("\n"), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit("\n255\n")).cast("binary")


def to_ppm(images: DataFrame) -> DataFrame:
    """Adds ``content``, the file; a column expression."""
    return images.withColumn("content", F.concat(ppm_header(images), F.col("data")))


def to_png(images: DataFrame, level: int = 6) -> DataFrame:
    """image_id and ``content``, the file."""

    def work(batches):
        for b in batches:
            out = [encode_png(np.frombuffer(d, np.uint8).reshape(h, w, c), level) for w, h, c, d in zip(*(b.column(k).to_pylist() for k in ("width", "height", "channels", "data")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("image_id"), pa.array(out, pa.binary())], names=["image_id", "content"])

    return step(images, IMAGES, work, FILES)


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: the cluster's, or, in local mode, one of our own."""
    import tempfile

    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        check(spark.sparkContext.master.split("[")[0] == "local", "spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="rastrel-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def write_files(files: DataFrame, folder: str, ending: str) -> int:
    """Writes (image_id, content) rows as files, each under another name first; returns their number."""

    def work(batches):
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        n = 0
        for b in batches:
            for i, blob in zip(b.column("image_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                draft = f"{root}/.{i}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as f:
                    f.write(blob)
                store.move(draft, f"{root}/{i}.{ending}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("image_id", "content").mapInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
