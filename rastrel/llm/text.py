"""Columnar text helpers shared by the Arrow-batched operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel looks at together; bounds a worker's memory.
SLICE_BYTES = 4 << 20
try:
    _TRIM = ctypes.CDLL(None).malloc_trim  # glibc
except (OSError, AttributeError):
    _TRIM = None


def release() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task should hold no more than its tables."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def text_slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each slice holds ``limit`` bytes of ``column`` or one row."""
    for batch in _released(batches):
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _released(batches):
    yield from batches
    release()


def no_nulls(column: pa.Array) -> pa.Array:
    """Null texts count as empty ones."""
    return pc.fill_null(column, "") if column.null_count else column


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and its n + 1 offsets."""
    column = no_nulls(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words_of(column: pa.Array, lower: bool = False) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Maximal runs without ASCII white space, dictionary-encoded, and n + 1 offsets by row.

    lower: A-Z only.
    """
    column = no_nulls(column)
    if lower:
        column = pc.ascii_lower(column)
    lists = pc.ascii_split_whitespace(column)
    words = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(words), 0)
    if pc.any(empty).as_py():  # what stands before or after outer white space
        keep = pc.invert(empty)
        owner = np.repeat(np.arange(len(counts)), counts)[keep.to_numpy(zero_copy_only=False)]
        counts = np.bincount(owner, minlength=len(counts)).astype(np.int64)
        words = words.filter(keep)
    return words.dictionary_encode(), np.concatenate([[0], np.cumsum(counts)])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many runs, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (SplitMix64's steps)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, 1 << 17)
        for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, factor, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def prefixes(raw: np.ndarray, letters: np.ndarray = _LETTERS) -> np.ndarray:
    """Sums from which :func:`prints` takes the fingerprint of any stretch. letters: a random number for each byte."""
    up, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(letters[raw] * up[: len(raw)], out=out[1:])
    return out


def prints(sums: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the ``size`` bytes from each place."""
    _, down = powers(len(sums))
    return (sums[at + size] - sums[at]) * down[at]


def spans(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Fingerprints of stretches of different lengths."""
    _, down = powers(len(sums))
    return (sums[last] - sums[first]) * down[first]


def free_name(frame, name: str) -> str:
    """The name, or one like it that no column of the frame has."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark) -> str:
    """The folder that driver and executors share. Only in local mode, where they are one process, is one made if none is set."""
    import tempfile

    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="rastrel-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def tasks(spark, per: int = 1) -> int:
    """Partitions for work that grows with the input; the cluster sizes spark.sql.shuffle.partitions by it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * per)


_OTHER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


def two_prints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit fingerprints of each string."""
    raw, at = bytes_of(column)
    size = mix64(np.diff(at).astype(np.uint64))
    return tuple(mix64(spans(prefixes(raw, letters), at[:-1], at[1:]) ^ size) for letters in (_LETTERS, _OTHER))
