"""Token-id output: one compressed wavelet-matrix file per shard.

A shard holds whole documents in ascending ``doc_id`` order. Its ids are kept
as bit-planes from the highest bit down; below each plane the ids are dealt
stably by that plane's bit. With a count of ones kept every ``BLOCK`` bits, a
file answers, without its ids being unpacked, which id stands at a place
(``access``), how often an id stands before a place (``rank``, ``count``) and
where its k-th one stands (``select``, ``occurrences``).

Layout, little-endian (fixed format): ``RWM1``, then u64 counts of tokens,
documents and planes, u64 tokens before the shard in its range partition, then
sections, each as u64 length and a zstd frame: document ids (i64), document
offsets (u64, one more than documents), zeros of each plane (u64), and one
section of packed bits for each plane, highest bit first.

Defined cases: a null or empty text is a document without tokens (with the end
id appended it has one); a null ``doc_id`` is kept as null and comes first;
equal ids follow each other; an empty table writes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder
from .text import shared_dir, tasks, text_slices

MAGIC = b"RWM1"
#: Tokens at which a shard is closed; a longer document has a shard of its own.
SHARD_TOKENS = 1 << 21
#: Bits between two stored counts of ones.
BLOCK = 512
#: Stands for a null id in a file.
NO_ID = -(1 << 63)


def planes_of(ids: np.ndarray, planes: int) -> tuple[list[bytes], list[int]]:
    """Packed bits of each plane and the zeros in it."""
    seq = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    kind, bits, zeros = seq.dtype.type, [], []
    for b in range(planes - 1, -1, -1):
        one = (seq & kind(1 << b)) != 0
        bits.append(np.packbits(one).tobytes())
        low = np.compress(~one, seq)  # several times as quick as a boolean index
        zeros.append(len(low))
        seq = np.concatenate([low, np.compress(one, seq)])
    return bits, zeros


class WaveletMatrix:
    """Queries on the planes of one shard."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        """planes: the packed bits of each, highest bit first."""
        self.n, self.depth, self.zeros, self.packed = n, len(planes), zeros, planes
        self.ones: list[np.ndarray] | None = None

    def _directory(self) -> list[np.ndarray]:
        if self.ones is None:
            step = BLOCK // 8
            self.ones = []
            for p in self.packed:
                whole = np.zeros(-(-max(len(p), 1) // step) * step, np.uint8)
                whole[: len(p)] = p
                self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(whole).reshape(-1, step).sum(1, dtype=np.int64))]))
        return self.ones

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        block, bits = i // BLOCK, self.packed[level]
        first, last = block * (BLOCK // 8), i // 8
        got = int(self._directory()[level][block]) + int(np.bitwise_count(bits[first:last]).sum())
        return got + ((int(bits[last]) >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def _bit(self, level: int, i: int) -> int:
        return int(self.packed[level][i >> 3]) >> (7 - (i & 7)) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.depth):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, symbol: int, a: int, b: int) -> tuple[int, int]:
        """Where the symbol's places among [a, b) stand below the last plane."""
        if symbol < 0 or symbol >> self.depth:
            return 0, 0
        for level in range(self.depth):
            x, y = self._rank1(level, a), self._rank1(level, b)
            one = symbol >> (self.depth - 1 - level) & 1
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if one else (a - x, b - y)
        return a, b

    def count(self, symbol: int, a: int = 0, b: int | None = None) -> int:
        x, y = self._range(symbol, min(self.n, max(0, a)), min(self.n, self.n if b is None else max(0, b)))
        return max(0, y - x)

    def rank(self, symbol: int, i: int) -> int:
        """How often the symbol stands before place i."""
        return self.count(symbol, 0, i)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th bit of this value, k from 0."""
        ones = self._directory()[level]
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        first = block * (BLOCK // 8)
        some = np.unpackbits(self.packed[level][first : first + BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(some == bit)[k - int(before[block])])

    def select(self, symbol: int, k: int) -> int:
        """The place of the symbol's k-th occurrence, k from 0."""
        x, y = self._range(symbol, 0, self.n)
        if not 0 <= k < y - x:
            raise IndexError(k)
        i = x + k
        for level in range(self.depth - 1, -1, -1):
            one = symbol >> (self.depth - 1 - level) & 1
            i = self._select_bit(level, one, i - self.zeros[level] if one else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def tokens(self) -> np.ndarray:
        """All ids in order: from the last plane up, what was dealt is gathered again."""
        kind = np.uint16 if self.depth <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for level in range(self.depth - 1, -1, -1):
            one = np.unpackbits(self.packed[level], count=self.n).view(bool)
            out = np.empty(self.n, kind)
            out[np.flatnonzero(~one)] = seq[: self.zeros[level]]
            out[np.flatnonzero(one)] = seq[self.zeros[level] :] | kind(1 << (self.depth - 1 - level))
            seq = out
        return seq


def pack(ids: np.ndarray, doc_ids: np.ndarray, at: np.ndarray, before: int) -> bytes:
    """One shard's file."""
    planes = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    bits, zeros = planes_of(ids, planes)
    out = [MAGIC, struct.pack("<4Q", len(ids), len(doc_ids), planes, before)]
    for raw in (doc_ids.astype("<i8").tobytes(), at.astype("<u8").tobytes(), np.array(zeros, "<u8").tobytes(), *bits):
        packed = pa.compress(raw, codec="zstd", asbytes=True)
        out += [struct.pack("<2Q", len(packed), len(raw)), packed]
    return b"".join(out)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, int, WaveletMatrix]:
    """Document ids, their offsets, the tokens before the shard, and its matrix."""
    if blob[:4] != MAGIC:
        raise ValueError("not a token shard")
    n, docs, planes, before = struct.unpack_from("<4Q", blob, 4)
    place, parts = 36, []
    for _ in range(3 + planes):
        size, raw = struct.unpack_from("<2Q", blob, place)
        parts.append(pa.decompress(memoryview(blob)[place + 16 : place + 16 + size], raw, codec="zstd", asbytes=True))
        place += 16 + size
    zeros = np.frombuffer(parts[2], "<u8").astype(int).tolist()
    return np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "<u8").astype(np.int64), before, WaveletMatrix(n, [np.frombuffer(p, np.uint8) for p in parts[3:]], zeros)


def _put(folder: str, name: str, blob: bytes) -> None:
    """Writes a file under another name and renames it, so that a task that runs again leaves the same files."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    draft = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as f:
        f.write(blob)
    store.move(draft, f"{root}/{name}")


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int | None = 2, shard_tokens: int | None = None) -> DataFrame:
    """Encodes ``text`` and writes shards in ascending ``doc_id`` order; returns part, shards, n_tokens of each range partition.

    The ranges come from a sample of the ids alone; within a partition rows
    are sorted (Spark's sort spills), encoded and written as they come.
    """
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    store.create_dir(root, recursive=True)
    shard_tokens = shard_tokens or SHARD_TOKENS

    def work(batches):
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), encoder(path)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = done = shards = 0

        def close():
            nonlocal held, size, done, shards
            ids = np.concatenate([x[0] for x in held])
            counts = np.concatenate([x[2] for x in held])
            _put(folder, f"part-{part:09d}-{shards:09d}.rwm", pack(ids, np.concatenate([x[1] for x in held]), np.concatenate([[0], np.cumsum(counts)]), done))
            done, shards, held, size = done + len(ids), shards + 1, [], 0

        for b in text_slices(batches, limit=2 << 20):
            ids, at = coder.encode(b.column("text"))
            if end_id is not None:
                ids = np.insert(ids, at[1:], np.uint32(end_id))
                at = at + np.arange(len(at))
            keys = b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            ids, first = ids.astype(np.uint32), 0
            while first < len(keys):  # whole documents, so that shards don't depend on how rows come in batches
                room = at[first] + shard_tokens - size
                stop = int(np.searchsorted(at, room, side="right")) - 1
                if stop <= first and size:
                    close()
                    continue
                stop = max(stop, first + 1)
                held.append((ids[at[first] : at[stop]], keys[first:stop], np.diff(at[first : stop + 1])))
                size += int(at[stop] - at[first])
                first = stop
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shards], pa.int64()), pa.array([done], pa.int64())], names=["part", "shards", "n_tokens"])

    n = tasks(docs.sparkSession)
    # rows that tie have one order, so that a task that runs again writes the same files
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.md5("text"))
    return ordered.mapInArrow(work, "part int, shards long, n_tokens long")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards' files: path and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.rwm").load(folder).select("path", "content")


def digest(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files.

    Only one row a range partition reaches the driver, for the tokens before it.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    totals = sorted(map(tuple, write_shards(docs, path, folder).collect()))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not any(x[1] for x in totals):
        return spark.createDataFrame([], schema)
    starts, many, before = {}, {}, 0
    for part, shards, n in totals:
        starts[part], many[part] = before, shards
        before += n

    def work(batches):
        for b in batches:
            for name, blob in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                part, shard = map(int, name.rpartition("part-")[2].removesuffix(".rwm").split("-"))
                if shard >= many.get(part, 0):  # not of the attempt that succeeded
                    continue
                keys, at, done, matrix = unpack(blob.as_buffer().to_pybytes())
                base = starts[part] + done
                whole = memoryview(matrix.tokens().astype("<u4")).cast("B")
                crcs = [zlib.crc32(whole[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=keys == NO_ID), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_shards(spark, folder).mapInArrow(work, schema)
