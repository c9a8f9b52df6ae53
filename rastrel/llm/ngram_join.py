"""Exact self-join of documents by the Jaccard similarity of their word shingles.

Documents link when ``intersection / union`` of their distinct ``size``-word
shingles is at least ``percent`` / 100. Every step before the last keeps all
pairs that can link:

1. all documents give the size of their set, a hashed bitmap of it, and counts
   of shingles in a table of fixed size, by which rare shingles come first in
   one order for all. What is still often among the first shingles of a sample
   of the texts goes behind the others of its cell's level,
2. a text's first shingles (so many that linked texts share one) meet by
   shingle. Up to ``PAIRS`` texts there give the pairs whose sizes and places
   allow a link; more are chained by size, since a pair of them need only end
   in the same block. Where one slice has more, one text speaks for all there,
   with bounds that hold for each, and its pairs count as chains,
3. pairs whose bitmaps bound the overlap from above below what a link needs are
   out, of long texts by bitmaps as wide as their sets ask for; the others and
   the chains are joined to blocks,
4. within a block, texts are compared in tiles of neighbouring size bands: the
   bitmaps' bit counts first, then the sorted arrays exactly. Texts that are
   already connected are not compared, so a group of near copies costs about
   one comparison a text. A block too large for a task is dealt to parts.

Equal texts are one text until the end. 64-bit hashes stand for shingles. Texts
are shuffled only where a bitmap of ids says that they may be in a block or, in
``keep_first``, in a component of several rows; all others are read in place.

Defined cases: null and empty texts have no shingles, link with nothing and are
components of their own; fewer words than ``size`` are one shingle; a null
``doc_id`` is carried and never names a component; repeated rows are copies;
other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, saved
from .text import bytes_of, free_name, mix64, no_nulls, prefixes, ragged, spans, tasks, text_slices, words_of

SIZE, PERCENT = 5, 75
#: Cells of the table of counts, and rows it is cut into for adding up.
CELLS, SEGMENTS = 1 << 23, 64
#: Tables of counts that a task adds up about.
ADDED = 32
#: Bytes of text that a worker hashes together; its arrays are some ten times as large.
SLICE = 2 << 20
#: Texts that share a shingle up to which their pairs are given singly.
PAIRS = 64
#: A text in so many is looked at for shingles that are often first, and so many of them are kept at most. Both touch the order only.
SHARE, LISTED = 8, 1 << 20
#: Bits of the largest bitmap that goes with each pair, and within a block.
BITS, BLOCK_BITS = 4096, 1 << 15
#: Bytes of wide bitmaps on each side of a tile.
TILE = 8 << 20
#: Words of 64 bits of the bitmap of ids at most. It is broadcast, and only spares shuffles.
SIEVE = 1 << 19
#: Shingles that a block holds before it is dealt to parts.
PART = 2_000_000
_FACTORS = mix64(np.arange(1, 65, dtype=np.uint64))


def shingles(column: pa.Array, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct shingle hashes of each row, and its words' number."""
    coded, at = words_of(column, lower=True)
    raw, ends = bytes_of(coded.dictionary)
    word = mix64(spans(prefixes(raw), ends[:-1], ends[1:]) ^ np.diff(ends).astype(np.uint64))
    flow = word[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    counts = np.diff(at)
    whole = np.zeros(max(0, len(flow) - size + 1), np.uint64)
    for k in range(size):
        whole += flow[k : k + len(whole)] * _FACTORS[k]
    whole = mix64(whole)
    out = []
    for start, n in zip(at[:-1].tolist(), counts.tolist(), strict=True):
        if n >= size:
            some = np.sort(whole[start : start + n - size + 1])
            out.append(some[np.concatenate([[True], some[1:] != some[:-1]])])
        elif n:
            out.append(mix64((flow[start : start + n] * _FACTORS[:n]).sum(keepdims=True, dtype=np.uint64) ^ _FACTORS[32 + n]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out, counts


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of n."""
    return min(BITS, max(64, 1 << (2 * n - 1).bit_length()))


def wide_of(n: int) -> int:
    """Bits of the bitmap of a set of n that BITS are too few for, or 0."""
    width = 1 << (2 * n - 1).bit_length() if n else 0
    return width if width > BITS else 0


def bitmap(some: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, bool)
    bits[(some >> np.uint64(20)) % np.uint64(width)] = True
    return np.packbits(bits)


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """The bitmap with fewer bits of the same set."""
    while bits.shape[-1] * bits.itemsize * 8 > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def needed(a, b, percent: int):
    """The least overlap with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def _bands(n: np.ndarray, percent: int) -> np.ndarray:
    return np.floor(np.log(n) / math.log(100 / percent) + 1e-9).astype(np.int64)


_TEXT = np.dtype([("id", "<i8"), ("n", "<u4"), ("records", "<u4")])
#: A text that speaks for others with its shingle: their least and greatest size, and the most shingles any has from it on.
_LEAD = np.dtype([("token", "<u8"), ("id", "<i8"), ("low", "<u4"), ("high", "<u4"), ("room", "<u4")])


def _blob(tokens: np.ndarray, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray, leads: np.ndarray, edges: np.ndarray) -> bytes:
    """Records of a bucket, by text: its id and size once, of each shingle 6 bytes and its place; then leads and edges."""
    new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    heads = np.zeros(len(new), _TEXT)
    heads["id"], heads["n"], heads["records"] = ids[new], sizes[new], np.diff(np.concatenate([new, [len(ids)]]))
    short = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return np.array([len(new), len(ids), len(leads), len(edges)], "<u4").tobytes() + heads.tobytes() + short + np.minimum(places, 65535).astype("<u2").tobytes() + leads.tobytes() + edges.astype("<i8").tobytes()


def _unblob(blob: bytes) -> tuple[np.ndarray, ...]:
    """Of each record the shingle, id, least and greatest size, room and whether it speaks for others; and edges."""
    texts, n, many, m = np.frombuffer(blob, "<u4", 4).tolist()
    heads = np.frombuffer(blob, _TEXT, texts, 16)
    at = 16 + texts * _TEXT.itemsize
    tokens = np.zeros((n, 8), np.uint8)
    tokens[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(-1, 6)
    places = np.frombuffer(blob, "<u2", n, at + 6 * n).astype(np.int64)
    leads = np.frombuffer(blob, _LEAD, many, at + 8 * n)
    edges = np.frombuffer(blob, "<i8", 2 * m, at + 8 * n + leads.nbytes).reshape(-1, 2)
    sizes = np.repeat(heads["n"], heads["records"]).astype(np.int64)
    own = (tokens.view("<u8").ravel(), np.repeat(heads["id"], heads["records"]), sizes, sizes, sizes - places, np.zeros(n, bool))
    more = (leads["token"], leads["id"], *(leads[k].astype(np.int64) for k in ("low", "high", "room")), np.ones(many, bool))
    return *(np.concatenate(x) for x in zip(own, more, strict=True)), edges


def _chained(tokens: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """Edges along each shingle's texts by least size, as far as the greatest so far allows links."""
    order = np.lexsort((low, tokens))
    t, i = tokens[order], ids[order]
    same = t[1:] == t[:-1]
    group = np.concatenate([[0], np.cumsum(~same)]) << 32 if len(t) else np.zeros(0, np.int64)
    most = np.maximum.accumulate(group + high[order]) - group
    near = same & (100 * most[:-1] >= percent * low[order][1:])
    return np.stack([i[:-1][near], i[1:][near]], axis=1)


def _forest(edges: np.ndarray) -> np.ndarray:
    """As few edges with the same components."""
    if not len(edges):
        return edges.reshape(0, 2)
    nodes, flat = np.unique(edges, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (root[a] == root[b]).all():
            break
    kids = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[kids], nodes[root[kids]]], axis=1)


def _measure(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document (key, n, bits; wide: of long texts), and rows of each task's table of counts (segment, counts)."""
    names = ["doc_id", "text_key", "id", "n", "bits", "wide", "segment", "counts"]

    def work(batches):
        counts = np.zeros(CELLS, np.uint32)
        for b in text_slices(batches, limit=SLICE):
            sets, _ = shingles(b.column("text"), size)
            n = np.array([len(x) for x in sets], np.int64)
            if n.sum():
                np.add.at(counts, (np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), np.uint32(1))
            bits = [bitmap(x, width_of(len(x))).tobytes() if len(x) else b"" for x in sets]
            wide = [bitmap(x, wide_of(len(x))).tobytes() if wide_of(len(x)) else None for x in sets]
            none = pa.nulls(b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), b.column("id"), pa.array(n), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), none, pa.nulls(b.num_rows, pa.binary())], names=names)
        if counts.any():
            parts = [pa.compress(x.astype(np.uint64).tobytes(), codec="zstd", asbytes=True) for x in counts.reshape(SEGMENTS, -1)]
            none = [pa.nulls(SEGMENTS, t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SEGMENTS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return docs.mapInArrow(work, "doc_id long, text_key binary, id long, n long, bits binary, wide binary, segment int, counts binary")


def _levels(measured: DataFrame) -> np.ndarray:
    """How common the shingles of each cell are, in powers of two of the mean; its size is fixed."""

    mean = (measured.agg(F.sum("n")).first()[0] or 0) / CELLS

    def total(table) -> np.ndarray:
        return sum(np.frombuffer(pa.decompress(x.as_buffer(), 8 * CELLS // SEGMENTS, codec="zstd", asbytes=True), np.uint64) for x in table.column("counts"))

    def add(table):
        return pa.table({"segment": table.column("segment")[:1], "counts": pa.array([pa.compress(total(table).tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    def level(table):
        out = np.maximum(0, np.floor(np.log2((total(table) + 1) / (mean + 1)))).astype(np.uint8)
        return pa.table({"segment": table.column("segment")[:1], "levels": pa.array([out.tobytes()], pa.binary())})

    counts, n = measured.where("segment is not null").select("segment", "counts"), measured.where("segment = 0").count()
    while n > 2 * ADDED:  # a tree of sums: no task adds up more than a few tables
        n = -(-n // ADDED)
        counts = counts.withColumn("slot", F.pmod(F.xxhash64("counts"), F.lit(n))).groupBy("segment", "slot").applyInArrow(add, "segment int, counts binary")
    rows = counts.groupBy("segment").applyInArrow(level, "segment int, levels binary").collect()
    whole = np.zeros(CELLS, np.uint8)
    for r in rows:
        whole.reshape(SEGMENTS, -1)[r.segment] = np.frombuffer(r.levels, np.uint8)
    return whole


def _ranks(some: np.ndarray, levels: np.ndarray, listed: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The place of shingles in the one order: by the level of their cells, then by how often they were first, then by hash."""
    level = levels[(some & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(2)
    if listed is not None and len(listed[0]):
        at = np.minimum(np.searchsorted(listed[0], some >> np.uint64(16)), len(listed[0]) - 1)
        level += np.where(listed[0][at] == some >> np.uint64(16), listed[1][at], 0).astype(np.uint64)
    return (level << np.uint64(56)) | (some >> np.uint64(8))


def _first(n: int, percent: int) -> int:
    """So many first shingles of a set of n that linked sets share one."""
    return n - -(-percent * n // 100) + 1


def _often(texts: DataFrame, levels, size: int, percent: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (their upper 48 bits, sorted) that come first in many texts, by a sample of these, and grades 1 to 3 of how often.

    The cells of the table fill up as data grow: what then stands first in over
    PAIRS texts is no longer told from what is rare.
    """
    least = max(1, PAIRS // (2 * SHARE))

    def first(batches):
        for b in text_slices(batches, limit=SLICE):
            sets, _ = shingles(b.column("text"), size)
            found = [np.zeros(0, np.uint64)]
            for some, i in zip(sets, b.column("id").to_pylist(), strict=True):
                if len(some):
                    own = some[np.argsort(_ranks(some, levels.value))[: _first(len(some), percent)]]
                    found.append((own & ~np.uint64(0xFFFF)) | np.uint64(i // SHARE & 0xFFFF))  # equal texts count once
            found = np.concatenate(found)
            bucket = (found >> np.uint64(48)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(k, found[order[ends[k] : ends[k + 1]]].tobytes()) for k in range(buckets) if ends[k] < ends[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary())], names=["bucket", "blob"])

    def count(table):
        seen = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("blob")]))
        token, times = np.unique(seen >> np.uint64(16), return_counts=True)
        most = np.argsort(-times, kind="stable")[: max(1, LISTED // buckets)]
        most = most[times[most] > least]
        grade = np.minimum(3, 1 + np.log2(times[most] / (least + 1)).astype(np.int64)).astype(np.uint8)
        return pa.table({"tokens": pa.array([token[most].tobytes()], pa.binary()), "grades": pa.array([grade.tobytes()], pa.binary())})

    sample = texts.where(F.col("id") % SHARE == 0).select("id", "text")
    rows = sample.mapInArrow(first, "bucket int, blob binary").groupBy("bucket").applyInArrow(count, "tokens binary, grades binary").collect()
    tokens, grades = (np.frombuffer(b"".join(bytes(r[k]) for r in rows), t) for k, t in (("tokens", np.uint64), ("grades", np.uint8)))
    order = np.argsort(tokens)
    return tokens[order], grades[order]


def _candidates(texts: DataFrame, levels, size: int, percent: int, buckets: int, listed=None) -> DataFrame:
    """kind, a, b: 0 pairs, 1 chains. Copies of a text in different tasks meet by their shingles and count once."""

    def first(batches):
        seen: set[bytes] = set()
        for b in text_slices(batches, limit=SLICE):
            keys, ids = b.column("text_key").to_pylist(), b.column("id").to_pylist()
            fresh = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
            sets, _ = shingles(b.column("text").take(pa.array(fresh, pa.int64())), size)
            parts = []
            for k, some in zip(fresh, sets, strict=True):
                n = len(some)
                if n:
                    rank = np.sort(_ranks(some, levels.value, listed and listed.value))
                    parts.append((rank[: _first(n, percent)], ids[k], n))
            if not parts:
                continue
            many = np.array([len(x[0]) for x in parts])
            tokens = np.concatenate([x[0] for x in parts])
            owner = np.repeat(np.array([x[1] for x in parts], np.int64), many)
            sizes = np.repeat(np.array([x[2] for x in parts], np.int64), many)
            places = np.arange(len(tokens)) - np.repeat(np.cumsum(many) - many, many)
            mixed = mix64(tokens)
            # what one batch has often is chained here, and one text of each band speaks for all, with bounds that hold for each
            bands = _bands(sizes, percent).astype(np.uint64)
            _, group, often = np.unique(mix64(mixed ^ bands), return_inverse=True, return_counts=True)
            common = np.flatnonzero(often[group] > PAIRS)
            edges, leads = np.zeros((0, 2), np.int64), np.zeros(0, _LEAD)
            if len(common):
                _, lead, back = np.unique(group[common], return_index=True, return_inverse=True)
                edges = _forest(np.stack([owner[common], owner[common][lead][back]], axis=1))
                leads = np.zeros(len(lead), _LEAD)
                leads["token"], leads["id"], leads["low"] = mixed[common][lead], owner[common][lead], sizes[common][lead]
                np.minimum.at(leads["low"], back, sizes[common].astype(np.uint32))
                np.maximum.at(leads["high"], back, sizes[common].astype(np.uint32))
                np.maximum.at(leads["room"], back, (sizes - places)[common].astype(np.uint32))
                keep = np.ones(len(tokens), bool)
                keep[common] = False
                mixed, owner, sizes, places = mixed[keep], owner[keep], sizes[keep], places[keep]
            bucket, home = ((x >> np.uint64(48)).astype(np.int64) % buckets for x in (mixed, leads["token"]))
            leads["token"] &= np.uint64((1 << 48) - 1)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                some = order[ends[k] : ends[k + 1]]
                own, led = edges[k::buckets], leads[home == k]
                if len(some) or len(own) or len(led):
                    rows.append((k, _blob(mixed[some], owner[some], sizes[some], places[some], led, own)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary())], names=["bucket", "blob"])

    def meet(table):
        parts = [_unblob(x) for x in table.column("blob").to_pylist()]
        tokens, ids, low, high, room, many = (np.concatenate([p[k] for p in parts]) for k in range(6))
        chains = [p[6] for p in parts]
        order = np.lexsort((many, ids, tokens))
        copy = (tokens[order[1:]] == tokens[order[:-1]]) & (ids[order[1:]] == ids[order[:-1]]) & ~many[order[1:]]
        order = np.concatenate([order[:1], order[1:][~copy]])
        tokens, ids, low, high, room, many = (x[order] for x in (tokens, ids, low, high, room, many))
        new = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        count = np.bincount(group, minlength=1)
        few = count[group] <= PAIRS
        chains.append(_chained(tokens[~few], ids[~few], low[~few], high[~few], percent))
        some = few & (count[group] > 1)
        group, ids, low, room, many = group[some], ids[some], low[some], room[some], many[some]
        pairs = [np.zeros((0, 2), np.int64)]
        for d in range(1, PAIRS):
            same = group[d:] == group[:-d]
            if not same.any():
                break
            x = np.flatnonzero(same)
            y = x + d
            good = (np.minimum(room[x], room[y]) >= needed(low[x], low[y], percent)) & (ids[x] != ids[y])
            x, y = x[good], y[good]
            both, led = np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], axis=1), many[x] | many[y]
            pairs.append(both[~led])
            chains.append(both[led])  # a lead's own bitmap says nothing of the others
        pair = np.unique(np.concatenate(pairs), axis=0)
        chain = _forest(np.concatenate(chains))
        kind = np.repeat([0, 1], [len(pair), len(chain)]).astype(np.int32)
        both = np.concatenate([pair, chain])
        return pa.table({"kind": pa.array(kind), "a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    return texts.mapInArrow(first, "bucket int, blob binary").groupBy("bucket").applyInArrow(meet, "kind int, a long, b long").distinct()


def _bounded(candidates: DataFrame, measured: DataFrame, percent: int) -> DataFrame:
    """Edges a, b: chains, and pairs whose bitmaps don't exclude a link."""
    sets = measured.where("n > 0").select("id", "text_key", "n", "bits").dropDuplicates(["text_key"]).drop("text_key")
    x, y = (sets.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    pairs = candidates.where("kind = 0").select("a", "b").join(x, "a").join(y, "b")

    def bound(batches):
        for t in batches:
            out = []
            for n, m, p, q in zip(*(t.column(k).to_pylist() for k in ("n_a", "n_b", "bits_a", "bits_b")), strict=True):
                p, q = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
                width = 8 * min(len(p), len(q))
                p, q = (int.from_bytes(fold(z, width).tobytes(), "big") for z in (p, q))
                both = p & q
                out.append(min(n - (p ^ both).bit_count(), m - (q ^ both).bit_count()) >= needed(n, m, percent))
            long = pa.array([wide_of(min(x)) > 0 for x in zip(t.column("n_a").to_pylist(), t.column("n_b").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), long], names=["a", "b", "long"]).filter(pa.array(out, pa.bool_()))

    passed = saved(pairs.mapInArrow(bound, "a long, b long, long boolean"), "bounded")
    edges = passed.where("not long").select("a", "b").unionByName(candidates.where("kind = 1").select("a", "b"))
    long = passed.where("long").select("a", "b")
    return edges if long.isEmpty() else edges.unionByName(_bounded_wide(long, measured, percent))


def _bounded_wide(pairs: DataFrame, measured: DataFrame, percent: int) -> DataFrame:
    """The pairs of long texts that their wide bitmaps don't exclude.

    A bitmap goes to each tile of texts by texts that has a pair of it, not to each pair.
    """
    sets = measured.where("wide is not null").select("id", "text_key", "n", "wide")
    sides = max(4, -(-sets.agg(F.sum(F.length("wide"))).first()[0] // TILE))
    x, y = (F.pmod(F.xxhash64(k), F.lit(sides)).cast("int") for k in "ab")
    tiles = pairs.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"), "a", "b")
    asked = tiles.select(F.col("x").alias("u"), F.col("y").alias("v"), F.explode(F.array("a", "b")).alias("id")).distinct()
    held = asked.join(sets.dropDuplicates(["text_key"]).drop("text_key"), "id")

    def work(pairs, held):
        have = {i: (n, np.frombuffer(w.as_buffer(), np.uint64)) for i, n, w in zip(held.column("id").to_pylist(), held.column("n").to_pylist(), held.column("wide"), strict=True)}
        out = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            (n, p), (m, q) = have[a], have[b]
            width = 64 * min(len(p), len(q))
            both = fold(p, width), fold(q, width)
            only, rest = (int(np.bitwise_count(u & ~v).sum(dtype=np.int64)) for u, v in (both, both[::-1]))
            out.append(min(n - only, m - rest) >= needed(n, m, percent))
        return pairs.select(["a", "b"]).filter(pa.array(out, pa.bool_()))

    return tiles.groupBy("x", "y").cogroup(held.groupBy("u", "v")).applyInArrow(work, "a long, b long")


def linked(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """The component of each set: one of its members. known: components so far; side: only sets of different sides are compared."""
    n = np.array([len(x) for x in sets])
    order = np.argsort(n, kind="stable")
    sets, n = [sets[k] for k in order], n[order]
    width = min(BLOCK_BITS, 4 * width_of(int(n.max())))
    bits = np.stack([bitmap(x, width) for x in sets]).view(np.uint64)
    ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
    # the arrays hold places in the block's sorted shingles, so that an intersection is a look at marked places
    places, ends = np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(n)
    marked = np.zeros(int(places.max()) + 1, np.uint8)
    bands = _bands(n, percent)
    root = np.arange(len(sets))
    if known is not None:
        _, first, back = np.unique(known[order], return_index=True, return_inverse=True)
        root = first[back]
    by = np.argsort(root, kind="stable")
    members = {int(x[0]): [x] for x in np.split(by, np.flatnonzero(np.diff(root[by])) + 1) if len(x)}
    size_of = {r: len(x[0]) for r, x in members.items()}

    def unite(x: int, y: int) -> None:
        """The smaller component takes the larger one's name, so that a text is renamed a logarithm of times."""
        if size_of[x] < size_of[y]:
            x, y = y, x
        for some in members[y]:
            root[some] = x
        members[x] += members.pop(y)
        size_of[x] += size_of.pop(y)

    for k in range(len(sets)):
        low = int(np.searchsorted(bands, bands[k] - 1))  # the tiles of its band and the one below
        low = max(low, int(np.searchsorted(100 * n, percent * n[k])))
        rest = low + np.flatnonzero(root[low:k] != root[k] if side is None else (root[low:k] != root[k]) & (side[order[low:k]] != side[order[k]]))
        if not len(rest):
            continue
        both = np.bitwise_count(bits[rest] & bits[k]).sum(1, dtype=np.int64)
        room = np.minimum(n[k] - (ones[k] - both), n[rest] - (ones[rest] - both)) - needed(n[rest], n[k], percent)
        rest = rest[room >= 0][np.argsort(-room[room >= 0], kind="stable")]
        own = places[ends[k] - n[k] : ends[k]]
        marked[own] = 1
        size = 1
        while len(rest):
            some, rest = rest[:size], rest[size:]
            at = ragged(ends[some] - n[some], n[some])
            common = np.add.reduceat(marked[places[at]].astype(np.int64), np.cumsum(n[some]) - n[some])
            for r in some[(100 + percent) * common >= percent * (n[some] + n[k])].tolist():
                if root[r] != root[k]:
                    unite(int(root[r]), int(root[k]))
            rest = rest[root[rest] != root[k]]  # what is now connected needs no look
            size = min(4 * size, 256)
        marked[own] = 0
    out = np.zeros(len(sets), np.int64)
    out[order] = order[root]
    return out


def _cell(i: Column, words: int) -> tuple[Column, Column]:
    """The word and the bit of an id."""
    cell = F.pmod(i, F.lit(64 * words))
    return F.shiftright(cell, 6), F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)).cast("int"))


def _sieve(ids: DataFrame) -> tuple[DataFrame, int]:
    """word, bits: a bitmap of the ids (id long, a text's), and its number of words."""
    words = 1 << (max(1, min(SIEVE, ids.count())) - 1).bit_length()
    word, bit = _cell(F.col("id"), words)
    return saved(ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "sieve"), words


def _sifted(frame: DataFrame, i: str, sieve: tuple[DataFrame, int], out: str) -> DataFrame:
    """The frame and whether its id may be one of the sieve's: true for all of these and for few others."""
    rows, words = sieve
    names = [free_name(frame, "__word"), free_name(frame, "__bits")]
    word, bit = _cell(F.col(i), words)
    both = frame.join(F.broadcast(rows.toDF(*names)), word == F.col(names[0]), "left")
    return both.withColumn(out, F.coalesce(F.col(names[1]), F.lit(0)).bitwiseAND(bit) != 0).drop(*names)


def _placed(blocks: DataFrame, measured: DataFrame) -> DataFrame:
    """id, block, part, parts: blocks with more shingles than a task should hold are dealt to parts."""
    sizes = measured.where("n > 0").select(F.col("id").alias("node"), "text_key", "n").dropDuplicates(["text_key"])
    parts = blocks.join(sizes, "node").groupBy("component").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
    dealt = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.lit(0)).cast("int")
    return blocks.join(parts, "component").select(F.col("node").alias("id"), F.col("component").alias("block"), dealt.alias("part"), "parts")


def _verified(texts: DataFrame, blocks: DataFrame, measured: DataFrame, size: int, percent: int, buckets: int) -> DataFrame:
    """text_key, root: the same for texts of one component.

    A large block is verified part by part. Each part also holds the block's
    first text, so what links with it in any part is one component. Only the
    texts that don't are then compared with the other parts' texts, a pair of
    parts a task.
    """
    placed = saved(_placed(blocks, measured), "placed")
    each = F.when(F.col("id") == F.col("block"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))

    def once(batches):
        seen: set[bytes] = set()
        for b in text_slices(batches):
            yield b.take(pa.array([k for k, key in enumerate(b.column("text_key").to_pylist()) if key not in seen and not seen.add(key)], pa.int64()))

    # only the texts of blocks, once for all that follows
    some = _sifted(texts, "id", _sieve(placed.select("id")), "maybe").where("maybe").select("id", "text_key", "text")
    some = some.mapInArrow(once, "id long, text_key binary, text string").repartition(tasks(texts.sparkSession), "id")
    held = saved(some.join(placed.hint("shuffle_hash"), "id").withColumn("part", F.explode(each)), "held")
    schema = "text_key binary, root binary, block long, part int, parts int, leads boolean"

    def work(table):
        order: dict[tuple[int, int], dict[bytes, int]] = defaultdict(dict)
        names = ("block", "part", "text_key")
        for k, (block, part, key) in enumerate(zip(*(table.column(c).to_pylist() for c in names), strict=True)):
            order[block, part].setdefault(key, k)
        ids, parts = table.column("id").to_pylist(), table.column("parts").to_pylist()
        text = no_nulls(table.column("text").combine_chunks())
        sizes = pc.binary_length(text).to_numpy(zero_copy_only=False)
        out: list[tuple] = []
        chosen: list[tuple[tuple[int, int], list[bytes]]] = []
        held = 0

        def settle():
            rows = [order[b][key] for b, keys in chosen for key in keys]
            sets, _ = shingles(text.take(pa.array(rows, pa.int64())), size)
            at = 0
            for (block, part), keys in chosen:
                root = linked(sets[at : at + len(keys)], percent)
                at += len(keys)
                first = min((key for key in keys if ids[order[block, part][key]] == block), default=None)
                lead = root[keys.index(first)] if first is not None else -1
                many = parts[order[block, part][keys[0]]]
                out.extend((key, first if r == lead else keys[r], block, part, many, bool(r == lead)) for key, r in zip(keys, root.tolist(), strict=True))

        for place, keys in order.items():
            if len(keys) > 1 or parts[order[place][next(iter(keys))]] > 1:
                chosen.append((place, list(keys)))
                held += int(sum(sizes[k] for k in keys.values()))
                if held > SLICE:
                    settle()
                    chosen, held = [], 0
        if chosen:
            settle()
        cols = list(zip(*out, strict=True)) or [()] * 6
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("text_key", "root", "block", "part", "parts", "leads"), cols, (pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)})

    bucket = F.pmod(F.xxhash64("block", "part"), F.lit(buckets)).cast("int")
    first = saved(held.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(work, schema), "verified")
    # written, so that the joins with it are of plain tables, which Spark can split where a key is hot
    roots = saved(first.select("text_key", "root").dropDuplicates(["text_key"]), "text-roots")
    if first.where("parts > 1 and not leads").isEmpty():
        return roots
    return _crossed(held.where("parts > 1").select("id", "text_key", "text").dropDuplicates(["text_key"]), first.where("parts > 1"), roots, size, percent)


def _key_id(key: str):
    return F.conv(F.substring(F.hex(key), 1, 15), 16, 10).cast("long")


def _crossed(texts: DataFrame, first: DataFrame, roots: DataFrame, size: int, percent: int) -> DataFrame:
    """Joins components of different parts of large blocks: each part's texts without the leader against every other part."""
    members = first.withColumn("id", _key_id("text_key"))
    rest = members.where("not leads")
    whole = F.sequence(F.lit(0), F.col("parts") - 1)
    asks = rest.withColumn("other", F.explode(whole)).where("other <> part").select("id", "text_key", "root", "block", F.col("part").alias("mine"), "other", F.lit(1).alias("side"))
    homes = rest.select("block", F.col("part").alias("mine")).distinct()
    told = members.join(homes, "block").where("mine <> part").select("id", "text_key", "root", "block", "mine", F.col("part").alias("other"), F.lit(0).alias("side"))
    # the leader stands in every part; it is told once for each
    pairs = asks.unionByName(told).dropDuplicates(["block", "mine", "other", "side", "text_key"]).withColumnRenamed("text_key", "key")
    rows = texts.join(pairs, "id").where("key = text_key")

    def work(table):
        text = no_nulls(table.column("text").combine_chunks())
        sets, _ = shingles(text, size)
        names = table.column("root").to_pylist()
        known = np.unique(np.array(names, "S16"), return_inverse=True)[1] if names else np.zeros(0, np.int64)
        root = linked(sets, percent, known, table.column("side").to_numpy()) if len(names) else known
        edges = {(names[k], names[r]) for k, r in enumerate(root.tolist()) if names[k] != names[r]}
        return pa.table({"p": pa.array([a for a, _ in edges], pa.binary()), "q": pa.array([b for _, b in edges], pa.binary())})

    found = saved(rows.groupBy("block", "mine", "other").applyInArrow(work, "p binary, q binary"), "crossed")
    joined = components(found.select(F.hex("p").alias("a"), F.hex("q").alias("b")))
    named = saved(joined.select(F.unhex("node").alias("root"), F.concat(F.lit("component "), F.col("component")).cast("binary").alias("whole")), "named")
    return saved(roots.join(named, "root", "left").select("text_key", F.coalesce("whole", "root").alias("root")), "text-roots")


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document, its text's MD5 (text_key) and whether it leads its component (is_first)."""
    return _joined(docs, size, percent, column).drop("company")


def _joined(docs: DataFrame, size: int, percent: int, column: str) -> DataFrame:
    """The columns of join, and whether there are other rows in the component or with the same text (company)."""
    spark = docs.sparkSession
    buckets = tasks(spark, 2)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"))
    digest = F.md5("text")
    keyed = plain.select("doc_id", F.unhex(digest).alias("text_key"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("id"), "text")
    measured = saved(_measure(keyed, size), "shingles")
    levels = spark.sparkContext.broadcast(_levels(measured))
    listed = spark.sparkContext.broadcast(_often(keyed, levels, size, percent, buckets))

    texts = keyed.select("id", "text_key", "text")
    candidates = saved(_candidates(texts, levels, size, percent, buckets, listed), "candidates")
    blocks = components(_bounded(candidates, measured, percent))
    roots = _verified(texts, blocks, measured, size, percent, buckets)
    rows = measured.where("n is not null").select("doc_id", "text_key", "n")
    named = rows.join(roots.hint("shuffle_hash"), "text_key", "left").select("doc_id", "text_key", "n", F.coalesce("root", "text_key").alias("root"))
    named = saved(named, "roots")
    # the smallest doc_id leads; without one, the smallest key
    lead = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("key"))
    # only what has company needs its least; written, so that a hot component's rows are a skewed join of plain tables, which Spark splits
    least = saved(named.groupBy("root").agg(F.min(lead).alias("least"), F.count("*").alias("rows")).where((F.col("rows") > 1)).select("root", "least"), "least")
    alone = (F.col("n") == 0) | F.col("least").isNull()
    return named.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), "text_key", (alone | lead.eqNullSafe(F.col("least"))).alias("is_first"), F.col("least").isNotNull().alias("company")
    )


def keep_first(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, column: str = "text") -> DataFrame:
    """One document of each component, all its columns: that with the smallest doc_id. Rows with equal doc_id and text are one."""
    name, i, maybe = (free_name(docs, c) for c in ("__join_key", "__join_id", "__join_maybe"))
    key = lambda digest: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), digest)
    company = saved(_joined(docs, size, percent, column).where("company").select(key(F.lower(F.hex("text_key"))).alias(name), _key_id("text_key").alias("id"), "is_first"), "company")
    digest = F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")))
    keyed = docs.withColumns({name: key(digest), i: F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")})
    sifted = _sifted(keyed, i, _sieve(company.select("id")), maybe)
    # what has no company stays where it is
    left = sifted.where(F.col(maybe)).join(company.where("not is_first").select(name), name, "left_anti").dropDuplicates([name])
    return sifted.where(~F.col(maybe)).select(*docs.columns).union(left.select(*docs.columns))


def oracle(size: int = SIZE, percent: int = PERCENT) -> str:
    """The same in SQL: texts with a common shingle are compared, and links are followed."""
    return f"""WITH RECURSIVE words AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i : i + {size - 1}], ' '))) END AS s FROM words),
each AS MATERIALIZED (SELECT rid, len(s) AS n, unnest(s) AS x FROM sets),
link AS MATERIALIZED (SELECT a.rid AS p, b.rid AS q FROM each a JOIN each b ON a.x = b.x AND a.rid <> b.rid GROUP BY a.rid, b.rid, a.n, b.n HAVING {100 + percent} * count(*) >= {percent} * (a.n + b.n)),
reach AS (SELECT p AS rid, q AS other FROM link UNION SELECT reach.rid, link.q FROM reach JOIN link ON reach.other = link.p),
least AS (SELECT reach.rid AS rid, min(o.doc_id) AS d FROM reach JOIN sets o ON o.rid = reach.other GROUP BY reach.rid)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN l.rid IS NULL THEN s.doc_id ELSE least(s.doc_id, l.d) END AS component_id FROM sets s LEFT JOIN least l USING (rid)"""
