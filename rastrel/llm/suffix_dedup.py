"""Removal of byte strings that occur more than once, by a depth-limited radix sort of suffixes.

A window is ``width`` units: bytes, or, to find passages of over 50 words
whatever their length, words (64-bit hashes of runs without ASCII white space).
What is removed is judged by bytes alone; words are counted. Two windows are equal only if the same bytes in
them have the smallest hash, at the same place; that place is their anchor. So
the corpus is read three times, and only what can be equal moves:

1. every text gives its anchors (about one in 100 bytes); those whose hash
   occurs once in the corpus are out,
2. the others' surroundings meet by hash. There the suffixes that begin in them
   are ordered by most-significant-digit passes of ``DIGIT`` bytes (or a word),
   as deep as the width and no deeper; a suffix that stands alone after a pass is out, and
   those that are together after the last are exactly the repeated windows,
3. every text removes the bytes that its repeated windows cover.

What is repeated within a slice of a task is told its texts at once and meets
the rest of the corpus as one, without its texts; so an anchor that very many
texts share brings a context or two a slice. Exact copies are counted and go
through 1 and 2 as one text. Texts are dealt once by their MD5 and that shuffle
serves all three passes.

Defined cases: a null text is empty; texts shorter than the width lose
nothing; matches never cross texts; overlapping windows of one text count;
repeated rows are copies; a null ``doc_id`` is carried; columns other than
doc_id and text are not read by :func:`dedup`, and stay as they are in
:func:`clean`.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import bytes_of, mix64, powers, prefixes, spans, tasks, text_slices, words_of

#: Bytes that are removed where they occur elsewhere too, and words that are counted.
WIDTH, WORDS = 400, 51
#: Bytes of a pass of the radix sort: what one integer holds.
DIGIT = 8
#: Bytes of text in which equal surroundings move once.
SLICE = 8 << 20
#: Window starts that are looked at together, and context bytes that are ordered together.
BLOCK, CHUNK = 1 << 16, 2 << 20

def units_of(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The units of all rows as one array, bytes or words' hashes, and n + 1 offsets."""
    if not words:
        return bytes_of(column)
    coded, at = words_of(column)
    raw, ends = bytes_of(coded.dictionary)
    hashes = mix64(spans(prefixes(raw), ends[:-1], ends[1:]) ^ np.diff(ends).astype(np.uint64))
    return hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64), at


def _sums(units: np.ndarray) -> np.ndarray:
    """Sums from which the fingerprint of any stretch of units follows."""
    if units.dtype == np.uint8:
        return prefixes(units)
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * powers(len(units) + 1)[0][: len(units)], out=out[1:])
    return out


def anchors(raw: np.ndarray, at: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Runs of window starts that have the same anchor: row, first, last, place (all within the row) and hash."""
    kmer = max(1, width // 2)
    reach, parts = width - kmer + 1, []
    bits = np.uint64((BLOCK + width).bit_length())
    for b in range(0, max(0, len(raw) - width + 1), BLOCK):
        some = raw[b : b + BLOCK + width - 1]
        sums, n = _sums(some), len(some) - kmer + 1
        _, down = powers(len(sums))
        hashes = mix64((sums[kmer:] - sums[:-kmer]) * down[:n])
        least = (hashes >> bits << bits) | np.arange(n, dtype=np.uint64)
        done = 1
        while 2 * done <= reach:
            least, done = np.minimum(least[:-done], least[done:]), 2 * done
        if done < reach:
            least = np.minimum(least[: -(reach - done)], least[reach - done :])
        place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        starts = np.arange(b, b + len(place))
        row = np.searchsorted(at, starts, side="right") - 1
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(place)]]) - 1
        owner = row[first]
        last = np.minimum(b + last, at[owner + 1] - width)
        good = last >= b + first
        parts.append(np.stack([owner[good], b + first[good], last[good], b + place[first][good], hashes[place[first]][good].view(np.int64)]))
    if not parts:
        return {k: np.zeros(0, np.int64) for k in ("row", "first", "last", "place", "hash")}
    row, first, last, place, hashes = np.concatenate(parts, axis=1)
    if len(row):  # what a block's end has cut is one run
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
        ends = np.concatenate([np.flatnonzero(new)[1:], [len(row)]]) - 1
        row, first, last, place, hashes = row[new], first[new], last[ends], place[new], hashes[new]
    base = at[row]
    return {"row": row, "first": first - base, "last": last - base, "place": place - base, "hash": hashes.view(np.uint64)}


_SEEN = np.dtype([("hash", "<u8"), ("text", "V16"), ("place", "<u4")])
_HEAD = np.dtype([("hash", "<u8"), ("place", "<u4"), ("size", "<u4"), ("refs", "<u4")])
_REF = np.dtype([("text", "V16"), ("first", "<u4")])
#: The place of a record that stands for texts that have been told.
_TOLD = 0xFFFFFFFF


def _dealt(records: np.ndarray, bucket: np.ndarray, buckets: int):
    """The records of each bucket that has some."""
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    for k in np.flatnonzero(np.diff(ends, prepend=0)):
        yield int(k), records[order[(ends[k - 1] if k else 0) : ends[k]]]


def _groups(texts: list[bytes], values: list[bytes]) -> pa.RecordBatch:
    out: dict[bytes, list[bytes]] = defaultdict(list)
    for t, v in zip(texts, values, strict=True):
        out[t].append(v)
    return pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array([b"".join(v) for v in out.values()], pa.binary())], names=["text_key", "found"])


def _sent(rows: list[tuple[int, bytes]], told: list[tuple[bytes, bytes]], buckets: int):
    """Rows for buckets, and what is already known of texts, which goes to a bucket of theirs."""
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary()), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.binary())], names=["bucket", "blob", "text_key", "found"])
    if told:
        some = _groups(*map(list, zip(*told, strict=True)))
        home = [int.from_bytes(k[:4], "little") % buckets for k in some.column("text_key").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.nulls(some.num_rows, pa.binary()), *some.columns], names=["bucket", "blob", "text_key", "found"])


def _received(table) -> tuple[pa.RecordBatch, list[bytes]]:
    """What is already known of texts, and the blobs."""
    table = table.combine_chunks()
    known = table.filter(table.column("text_key").is_valid()).select(["text_key", "found"]).combine_chunks()
    told = known.to_batches()[0] if known.num_rows else _groups([], [])
    return told, [x for x in table.column("blob").to_pylist() if x is not None]


def repeated_windows(contexts: list[tuple[int, int, bytes]], copies: np.ndarray, width: int, kind: type = np.uint8) -> list[list[tuple[int, int]]]:
    """For each distinct (hash, place, context): the ranges of its windows that occur elsewhere too. kind: of the units.

    contexts that are copies of each other are given once, with their number.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    groups: dict[int, list[int]] = defaultdict(list)
    for c, (h, _, text) in enumerate(contexts):
        if copies[c] > 1:
            out[c] = [(0, len(text) // np.dtype(kind).itemsize - width)]
        groups[h].append(c)
    chunk: list[int] = []
    size = 0
    for members in groups.values():
        if len(members) > 1 and any(copies[c] < 2 for c in members):
            chunk += members
            size += sum(len(contexts[c][2]) for c in members)
            if size > CHUNK:
                _order(contexts, chunk, copies, width, out, kind)
                chunk, size = [], 0
    if chunk:
        _order(contexts, chunk, copies, width, out, kind)
    return out


def _order(contexts, chunk: list[int], copies: np.ndarray, width: int, out: list[list[tuple[int, int]]], kind: type) -> None:
    """Ranges of the windows of these contexts that are equal to others."""
    texts = [contexts[c][2] for c in chunk]
    raw = np.frombuffer(b"".join(texts) + bytes(DIGIT), kind)
    sizes = np.fromiter(map(len, texts), np.int64) // raw.itemsize
    base = np.cumsum(sizes) - sizes
    windows = sizes - width + 1
    owner = np.repeat(np.arange(len(chunk)), windows)
    step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    hashes = np.array([contexts[c][0] for c in chunk], np.uint64)
    places = np.array([contexts[c][1] for c in chunk], np.int64)
    # only suffixes at the same place beside the same anchor can be equal
    key = mix64(hashes[owner] ^ mix64((places[owner] - step).astype(np.uint64)))
    pos = radix_groups(raw, base[owner] + step, key, width)
    pos.sort()
    owner = np.searchsorted(base, pos, side="right") - 1
    cut = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1] + 1) | (owner[1:] != owner[:-1])])) if len(pos) else np.zeros(0, np.int64)
    ends = np.concatenate([cut[1:], [len(pos)]])[: len(cut)] - 1
    for k, a, b in zip(owner[cut].tolist(), pos[cut].tolist(), pos[ends].tolist(), strict=True):
        if copies[chunk[k]] < 2:
            out[chunk[k]].append((a - int(base[k]), b - int(base[k])))


def radix_groups(raw: np.ndarray, pos: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes (their starts) that share key and ``depth`` units with another, in the order of key, then units.

    raw: with ``DIGIT`` bytes to spare. A pass orders, within each group, by
    the next digit; groups whose suffixes agree in it are left as they are.
    """
    digits, each = raw, 1
    if raw.dtype == np.uint8:
        digits, each = np.zeros(len(raw) - DIGIT + 1, np.uint64), DIGIT
        for k in range(DIGIT):
            digits = (digits << np.uint64(8)) | raw[k : len(raw) - DIGIT + 1 + k]

    def shared(pos: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without what stands alone; new: where a group begins."""
        stay = ~(new & np.append(new[1:], True))
        pos, new = pos[stay], new[stay]
        return pos, np.cumsum(new) - 1

    order = np.argsort(key, kind="stable")
    pos, key = pos[order], key[order]
    pos, group = shared(pos, np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool))
    for at in range(0, depth, each):
        if not len(pos):
            break
        digit = digits[pos + at]
        if depth - at < each:  # the last pass goes no deeper than the depth
            digit >>= np.uint64(8 * (DIGIT - (depth - at)))
        apart = (group[1:] == group[:-1]) & (digit[1:] != digit[:-1])
        if not apart.any():
            continue
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[1:][apart]] = True
        some = np.flatnonzero(mixed[group])
        by = some[np.lexsort((digit[some], group[some]))]
        pos[some], digit[some] = pos[by], digit[by]
        pos, group = shared(pos, np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]))
    return pos


def _distinct_texts(docs: DataFrame) -> DataFrame:
    """text_key, text: copies within a task only once, then dealt by key."""

    def work(batches):
        seen: set[bytes] = set()
        for b in text_slices(batches, limit=SLICE):
            keys = b.column("text_key").to_pylist()
            first = []
            for k, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    first.append(k)
            yield b.take(pa.array(first, pa.int64()))

    return docs.mapInArrow(work, "text_key binary, text string").repartition(tasks(docs.sparkSession), "text_key")


def _found(texts: DataFrame, found: DataFrame, name: str = "found") -> DataFrame:
    """Each text with what has been found for it; the texts stay where they are."""
    lists = found.groupBy("text_key").agg(F.collect_list(name).alias(name))
    return texts.join(lists.hint("shuffle_hash"), "text_key", "left")


def distinct_texts(docs: DataFrame, column: str = "text") -> DataFrame:
    """text_key, text of what is dealt once for all passes; a text may still stand there twice."""
    plain = docs.select(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias("text"))
    return _distinct_texts(plain.select(F.unhex(F.md5("text")).alias("text_key"), "text"))


def repeated_spans(texts: DataFrame, width: int = WIDTH, words: bool = False) -> DataFrame:
    """text_key, found (pairs of 32 bits: ranges of units that repeated windows cover, not merged) of the texts that have some."""
    buckets, kind = tasks(texts.sparkSession, 4), np.uint64 if words else np.uint8

    def see(batches):
        seen: set[bytes] = set()
        for b in text_slices(batches, limit=SLICE):
            keys = b.column("text_key").to_pylist()
            fresh = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
            b = b.take(pa.array(fresh, pa.int64())) if len(fresh) < len(keys) else b
            raw, at = units_of(b.column("text"), words)
            runs = anchors(raw, at, width)
            ids = np.array([keys[k] for k in fresh], "V16") if fresh else np.zeros(0, "V16")
            _, back, often = np.unique(runs["hash"], return_inverse=True, return_counts=True)
            alone = often[back] < 2
            told = [(ids[row].tobytes(), place.to_bytes(4, "little")) for row, place in zip(runs["row"][~alone].tolist(), runs["place"][~alone].tolist(), strict=True)]
            markers = np.unique(runs["hash"][~alone])
            records = np.zeros(int(alone.sum()) + len(markers), _SEEN)
            records["hash"] = np.concatenate([runs["hash"][alone], markers])
            records["text"][: alone.sum()], records["place"][: alone.sum()] = ids[runs["row"][alone]], runs["place"][alone]
            records["place"][alone.sum() :] = _TOLD
            bucket = (records["hash"] % np.uint64(buckets)).astype(np.int64)
            yield from _sent([(k, r.tobytes()) for k, r in _dealt(records, bucket, buckets)], told, buckets)

    def twice(table):
        told, blobs = _received(table)
        records = np.concatenate([np.zeros(0, _SEEN), *(np.frombuffer(x, _SEEN) for x in blobs)])
        order = np.argsort(records["hash"])
        hashes = records["hash"][order]
        same = hashes[1:] == hashes[:-1]
        some = records[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(order) else records
        some = some[some["place"] != _TOLD]
        whole, places = some["text"].tobytes(), some["place"].tobytes()
        return pa.Table.from_batches([told, _groups([whole[16 * k : 16 * k + 16] for k in range(len(some))], [places[4 * k : 4 * k + 4] for k in range(len(some))])])

    def surround(batches):
        for b in text_slices(batches, limit=SLICE):
            b = b.filter(b.column("found").is_valid())
            if not b.num_rows:
                continue
            keys, places = b.column("text_key").to_pylist(), b.column("found").to_pylist()
            raw, at = units_of(b.column("text"), words)
            runs = anchors(raw, at, width)
            wanted = np.unique(np.concatenate([np.frombuffer(b"".join(x), "<u4").astype(np.int64) | (k << 32) for k, x in enumerate(places)]))
            hit = np.flatnonzero(np.isin(runs["place"] | (runs["row"] << 32), wanted))
            blob, unit = raw.tobytes(), raw.itemsize
            dealt: dict[int, dict[tuple[int, int, bytes], dict[bytes, None]]] = defaultdict(lambda: defaultdict(dict))
            lists = [runs[k][hit].tolist() for k in ("row", "first", "last", "place", "hash")]
            starts = at.tolist()
            for row, first, last, place, h in zip(*lists, strict=True):
                around = blob[unit * (starts[row] + first) : unit * (starts[row] + last + width)]
                dealt[h % buckets][h, place - first, around][keys[row] + first.to_bytes(4, "little")] = None
            rows, told = [], []
            for k, some in dealt.items():
                for (_, _, around), refs in some.items():
                    if len(refs) > 1:  # repeated here: its texts need not go along
                        told += [(ref[:16], ref[16:] + (int.from_bytes(ref[16:], "little") + len(around) // unit).to_bytes(4, "little")) for ref in refs]
                        refs.clear()
                heads = np.array([(h, p, len(t), len(refs)) for (h, p, t), refs in some.items()], _HEAD)
                rows.append((k, len(heads).to_bytes(4, "little") + heads.tobytes() + b"".join(x for refs in some.values() for x in refs) + b"".join(t for _, _, t in some)))
            yield from _sent(rows, told, buckets)

    def order(table):
        told, blobs = _received(table)
        met: dict[tuple[int, int, bytes], dict] = {}
        for blob in blobs:
            n = int.from_bytes(blob[:4], "little")
            heads = np.frombuffer(blob, _HEAD, n, 4)
            ref = 4 + n * _HEAD.itemsize
            text = ref + int(heads["refs"].sum()) * _REF.itemsize
            for h, p, size, refs in heads.tolist():
                met.setdefault((h, p, blob[text : text + size]), {})[blob[ref : ref + 20] if refs else None] = None
                ref, text = ref + 20 * refs, text + size
        contexts, refs = list(met), list(met.values())
        ranges = repeated_windows(contexts, np.fromiter((2 if None in x else len(x) for x in refs), np.int64, len(refs)), width, kind)
        texts, values = [], []
        for some, owners in zip(ranges, refs, strict=True):
            for ref in owners if some else ():
                for a, b in some if ref is not None else ():
                    first = int.from_bytes(ref[16:], "little")
                    texts.append(ref[:16])
                    values.append((first + a).to_bytes(4, "little") + (first + b + width).to_bytes(4, "little"))
        return pa.Table.from_batches([told, _groups(texts, values)])

    found = "text_key binary, found binary"
    sent = "bucket int, blob binary, text_key binary, found binary"
    places = texts.mapInArrow(see, sent).groupBy("bucket").applyInArrow(twice, found)
    # a filter on found here would go below the texts' shuffle, which then could not be reused
    return _found(texts, places).mapInArrow(surround, sent).groupBy("bucket").applyInArrow(order, found)


def merged(pairs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of byte ranges."""
    some = np.frombuffer(pairs, "<u4").reshape(-1, 2).astype(np.int64)
    some = some[np.argsort(some[:, 0], kind="stable")]
    far = np.maximum.accumulate(some[:, 1]) if len(some) else some[:, 1]
    new = np.concatenate([[True], some[1:, 0] > far[:-1]]) if len(some) else np.zeros(0, bool)
    starts = some[new, 0]
    ends = far[np.concatenate([np.flatnonzero(new)[1:], [len(some)]]) - 1] if len(some) else starts
    return starts, ends


def _keyed(docs: DataFrame, column: str = "text"):
    return F.unhex(F.md5(F.coalesce(docs[column].cast("string"), F.lit(""))))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def counted(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The words of each row."""
    inside = ~_BLANK[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][np.diff(at) > 0]
    begins[first] = inside[first]
    total = np.concatenate([[0], np.cumsum(begins)])
    return total[at[1:]] - total[at[:-1]]


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_repeated_words of every document.

    The last are the words in passages of ``WORDS`` words or more that stand
    elsewhere too; nothing is removed for them. Texts with copies are repeated
    whole if they are as long as the width.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _keyed(docs).alias("text_key"))

    def keep(batches):
        for b in text_slices(batches, limit=SLICE):
            raw, at = bytes_of(b.column("text"))
            blob, out = raw.tobytes(), []
            words = counted(raw, at)
            for k, (key, found, more) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text_key", "found", "more")), strict=True)):
                text = blob[at[k] : at[k + 1]]
                starts, ends = merged(b"".join(found or ()))
                kept, before = hashlib.sha256(), 0
                for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
                    kept.update(text[before:x])
                    before = y
                kept.update(text[before:])
                first, last = merged(b"".join(more or ()))
                out.append((key, len(text), int((ends - starts).sum()), len(starts), int(words[k]), int((last - first).sum()), kept.hexdigest()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:6]), pa.array(cols[6], pa.string())], names=["text_key", "n_bytes", "n_removed", "n_spans", "n_words", "n_repeated_words", "kept_sha256"])

    texts = distinct_texts(docs)
    both = _found(_found(texts, repeated_spans(texts, width)), repeated_spans(texts, WORDS, words=True).withColumnRenamed("found", "more"), "more")
    judged = both.mapInArrow(keep, "text_key binary, n_bytes long, n_removed long, n_spans long, n_words long, n_repeated_words long, kept_sha256 string").dropDuplicates(["text_key"])
    copied = keyed.groupBy("text_key").agg(F.count("*").alias("copies"))
    per_text = judged.join(copied, "text_key")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    per_text = per_text.select(
        "text_key", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(whole, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when((F.col("copies") > 1) & (F.col("n_words") >= WORDS), F.col("n_words")).otherwise(F.col("n_repeated_words")).alias("n_repeated_words"),
    )
    return keyed.join(per_text, "text_key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words")


def without(text: bytes, starts: np.ndarray, ends: np.ndarray) -> str:
    """The characters of which no byte is removed."""
    out, before = [], 0
    for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
        out.append(text[before:x])
        before = y
    out.append(text[before:])
    return "".join(x.decode("utf-8", "ignore") for x in out)


def clean(docs: DataFrame, width: int = WIDTH, column: str = "text") -> DataFrame:
    """All columns of ``docs`` with the repeated bytes cut from the text; a character goes with any of its bytes.

    Null texts stay null; a text with copies is empty if it is as long as the width.
    """
    key = "__suffix_key"
    while key in docs.columns:
        key += "_"

    def keep(batches):
        for b in text_slices(batches, limit=SLICE):
            raw, at = bytes_of(b.column("text"))
            blob = raw.tobytes()
            left = [without(blob[at[k] : at[k + 1]], *merged(b"".join(found or ()))) for k, found in enumerate(b.column("found").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("text_key"), pa.array(left, pa.string())], names=["text_key", "kept"])

    texts = distinct_texts(docs, column)
    changed = _found(texts, repeated_spans(texts, width)).where("found is not null").mapInArrow(keep, "text_key binary, kept string").dropDuplicates(["text_key"])
    keyed = docs.withColumn(key, _keyed(docs, column))
    copied = keyed.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("text_key"), F.lit(True).alias("copied"))
    facts = changed.join(copied, "text_key", "full").select(F.struct("text_key", "kept", "copied").alias("__fact"))
    out = keyed.join(facts, F.col(key) == F.col("__fact.text_key"), "left")
    text = F.col(f"`{column}`").cast("string")
    new = F.when(F.col("__fact.copied") & (F.octet_length(text) >= width), F.lit("")).otherwise(F.coalesce(F.col("__fact.kept"), text))
    return out.select(*(F.when(text.isNotNull(), new).alias(c) if c == column else F.col(f"`{c}`") for c in docs.columns))


def oracle(width: int = WIDTH) -> str:
    """The same in SQL, by every window's bytes."""
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (SELECT rid, b, unnest(range(1, octet_length(b) - {width - 2})) AS p FROM d),
windows AS MATERIALIZED (SELECT rid, p, md5_number(array_slice(b, p, p + {width - 1})) AS k FROM places),
twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
hit AS (SELECT rid, p FROM windows SEMI JOIN twice USING (k)),
run AS (SELECT *, sum(CASE WHEN p <= before + {width} THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY p) AS n FROM (SELECT *, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM hit)),
span AS (SELECT rid, n, min(p) AS a, max(p) + {width} AS z FROM run GROUP BY rid, n),
gap AS (SELECT rid, z AS a, lead(a) OVER (PARTITION BY rid ORDER BY a) AS z FROM (SELECT rid, a, z FROM span UNION ALL SELECT rid, 0, 1 FROM d)),
kept AS (SELECT rid, string_agg(hex(array_slice(b, gap.a, coalesce(z, octet_length(b) + 1) - 1)), '' ORDER BY gap.a) AS h FROM gap JOIN d USING (rid) WHERE coalesce(z, octet_length(b) + 1) > gap.a GROUP BY rid),
gone AS (SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY rid),
w AS MATERIALIZED (SELECT row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
passages AS MATERIALIZED (SELECT rid, p, md5_number(array_to_string(w[p : p + {WORDS - 1}], ' ')) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - {WORDS - 2})) AS p FROM w)),
more AS (SELECT rid, p FROM passages SEMI JOIN (SELECT k FROM passages GROUP BY k HAVING count(*) > 1) USING (k)),
repeated AS (SELECT rid, CAST(sum(least({WORDS}, after - p)) AS BIGINT) AS n FROM (SELECT rid, p, coalesce(lead(p) OVER (PARTITION BY rid ORDER BY p), p + {WORDS}) AS after FROM more) GROUP BY rid)
SELECT d.doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256, coalesce(repeated.n, 0) AS n_repeated_words
FROM d LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid) LEFT JOIN repeated USING (rid)"""
