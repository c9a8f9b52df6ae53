"""BPE encoding and decoding with a public tokenizer file, by tree concatenation.

A text longer than ``LEAF`` characters is cut there, wherever that falls. The
halves of halves of all texts of a batch are encoded in parallel, as rows of
one vectorised call; each distinct word of theirs is encoded once per worker
and kept in a bounded table. Then a level of the tree after the other, windows
around all joins of that level are encoded anew by the library, and grow until
both sides agree exactly with what they had. A word that stands unsplit for
more than ``LONG`` characters, as in a window, is encoded by halves in the same
way, on tokens (:class:`TreeEncoder`).

Words end at ASCII white space. Files of other kinds, whose tokens hold white
space, are not cut: the library encodes their texts whole.

Defined cases: null and empty texts have no tokens and decode to ''; a null
``doc_id`` is carried; extra columns are not read; repeated rows give repeated
results.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix64, no_nulls, ragged, text_slices, two_prints, words_of

#: Characters of a leaf of a text's tree.
LEAF = 2048
#: Characters from which an unsplit word is encoded by halves, and characters of a leaf then.
LONG, WORD_LEAF = 2048, 512
#: Words on either side that a window around a join begins with.
AROUND = 2
#: Pieces of words that a worker keeps encoded, and words that are joined for one call.
KEPT, JOINED = 800_000, 1000

#: Bytes of text that a worker encodes together; its arrays are some fifty times as large.
SLICE = 2 << 20

#: Words made of these letters, then of these marks, pass the tokenizer's normaliser unchanged
#: but for case, and split into the letters and the marks.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = f"^[{_LETTERS}]{{1,64}}[{re.escape(_MARKS)}]{{0,16}}$"


def byte_symbols() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for i, b in enumerate(x for x in range(256) if x not in table):
        table[b] = chr(256 + i)
    return table


#: ASCII white space, where words end.
_SPACE = frozenset(" \t\n\x0b\x0c\r")
#: Normalisers that change nothing across white space, and pre-tokenizers that drop it.
_LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _ends_at_space(spec: dict) -> bool:
    """Whether no token of a tokenizer file holds white space, so that its words can be encoded one by one."""
    flat = lambda x, inner: [] if x is None else [z for y in x[inner] for z in flat(y, inner)] if x["type"] == "Sequence" else [x]
    blanks = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    if not all(n["type"] in _LOCAL or n == blanks for n in flat(spec.get("normalizer"), "normalizers")):
        return False
    steps = flat(spec.get("pre_tokenizer"), "pretokenizers")
    drops = bool(steps) and (steps[0]["type"] in ("Whitespace", "WhitespaceSplit") or (steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and steps[0]["pattern"] == {"Regex": _WORDS}))
    marks = all(not (a["lstrip"] or a["rstrip"] or a["single_word"]) and not _SPACE & set(a["content"]) for a in spec.get("added_tokens", ()))
    return drops and marks and spec["model"]["type"] == "BPE" and not any(s.get("add_prefix_space") for s in steps)


def cut(column: pa.Array, leaf: int) -> tuple[pa.Array, np.ndarray]:
    """Leaves of at most ``leaf`` characters, and which of them are each row's first (n + 1)."""
    column = no_nulls(column)
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.maximum(1, -(-sizes // leaf))
    first = np.concatenate([[0], np.cumsum(counts)])
    if (counts == 1).all():
        return column, first
    out: list[str] = []
    for x in column.to_pylist():
        out += [x[k : k + leaf] for k in range(0, len(x), leaf)] or [x]
    return pa.array(out, pa.string()), first


class TreeEncoder:
    """Encodes one long pre-token (a string of byte-level symbols) by tree concatenation.

    A token sequence is the encoding of its text exactly if every two
    neighbours are the encoding of theirs. So after each join a window of
    tokens around it is encoded anew, and grows until the pairs at both of its
    edges agree.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        from tokenizers import Tokenizer, models

        self.suffix = suffix
        self.names = {i: t for t, i in vocab.items()}
        self.closed = models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=suffix)
        self.open = models.BPE(vocab=vocab, merges=merges)
        self.leaves = Tokenizer(self.open)

    def _plain(self, text: str, last: bool) -> list[int]:
        return [t.id for t in (self.closed if last else self.open).tokenize(text)]

    def _text(self, ids: list[int], last: bool) -> str:
        out = "".join(self.names[i] for i in ids)
        return out[: -len(self.suffix)] if last else out

    def _agree(self, a: int, b: int, last: bool) -> bool:
        return self._plain(self._text([a, b], last), last) == [a, b]

    def encode(self, text: str) -> list[int]:
        leaves = [text[i : i + WORD_LEAF] for i in range(0, len(text), WORD_LEAF)] or [""]
        # in parallel, in as many threads as the task has
        parts = [e.ids for e in self.leaves.encode_batch_fast(leaves[:-1], add_special_tokens=False)] + [self._plain(leaves[-1], True)]
        while len(parts) > 1:  # a level of the tree
            parts = [self._join(parts[k], parts[k + 1], k + 2 >= len(parts)) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]

    def _join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        size = 4
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            ends = last and j == len(right)
            window = self._plain(self._text(left[i:] + right[:j], ends), ends)
            sound_left = i == 0 or self._agree(left[i - 1], window[0], ends and len(window) == 1)
            sound_right = j == len(right) or self._agree(window[-1], right[j], last and j + 1 == len(right))
            if sound_left and sound_right:
                return left[:i] + window + right[j:]
            size *= 2


class WordEncoder:
    """Word -> token ids, as the tokenizers library has them, in flat tables that grow to a bound."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = self.whole.get_vocab(with_added_tokens=True)
        self.added = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.path, self._tree = path, None
        self.quick = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix))
        self.quick.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        symbols = byte_symbols()
        # letters whose symbols hold one of these letters themselves stand first, so that none is replaced twice
        latin = {chr(c): "".join(symbols[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        made = set("".join(latin.values()))
        self.latin = sorted(latin.items(), key=lambda x: x[0] not in made)
        self.names = [""] * (max(self.vocab.values()) + 1)
        for t, i in self.vocab.items():
            self.names[i] = t
        self.closing = np.array([bool(self.suffix) and t.endswith(self.suffix) for t in self.names])
        self.by_words = _ends_at_space(spec)
        self.reset()
        # this file lower-cases, splits off marks and drops white space; only then is the quick way the same
        probe = "The, cat; Évian. Ça!! oui? à: zoë$$$ x(y) <a>"
        self.plain = bool(self.suffix) and self.by_words
        self.plain = self.plain and self.encode(pa.array([probe]))[0].tolist() == self.whole.encode(probe, add_special_tokens=False).ids
        self.reset()

    @property
    def tree(self) -> TreeEncoder:
        """Made when a long word comes."""
        if self._tree is None:
            model = json.loads(open(self.path, encoding="utf-8").read())["model"]
            self._tree = TreeEncoder(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], self.suffix)
        return self._tree

    def reset(self) -> None:
        """Row 0 of the tables is the empty piece. Pieces are found by two 64-bit fingerprints, 20 bytes a piece."""
        self.keys, self.checks, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.starts, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 1

    def _long(self, word: str) -> list[int]:
        """A long unsplit word: its pre-tokens as the library makes them, long ones by tree concatenation."""
        out: list[int] = []
        for piece in re.split(f"({'|'.join(map(re.escape, self.added))})", word) if self.added else [word]:
            if piece in self.added:
                out.append(self.vocab[piece])
                continue
            text = self.whole.normalizer.normalize_str(piece) if self.whole.normalizer else piece
            for part, _ in self.whole.pre_tokenizer.pre_tokenize_str(text):
                out += self.tree.encode(part) if len(part) > LONG else [t.id for t in self.tree.closed.tokenize(part)]
        return out

    def _symbols(self, text: str) -> str:
        """Latin letters as the symbols of their bytes; a replacement a letter is far quicker than one pass over characters."""
        if not text.isascii():
            for letter, symbols in self.latin:
                text = text.replace(letter, symbols)
        return text

    def _fresh(self, pieces: list[str], cores: bool) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of pieces. cores: they are lower-case letters."""
        if cores:
            joined = [self._symbols(" ".join(pieces[k : k + JOINED])) for k in range(0, len(pieces), JOINED)]
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.quick.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.flatnonzero(self.closing[flat])  # one in each piece
            return flat, np.diff(ends, prepend=-1)
        lists: list = [None] * len(pieces)
        short = [k for k, x in enumerate(pieces) if len(x) <= LONG]
        for k, e in zip(short, self.whole.encode_batch_fast([pieces[k] for k in short], add_special_tokens=False), strict=True):
            lists[k] = e.ids
        for k, x in enumerate(pieces):
            if len(x) > LONG:
                lists[k] = self._long(x)
        return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64)

    def _append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.starts[self.n])
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[used : used + len(flat)] = flat
        self.starts[self.n + 1 : self.n + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.n += len(sizes)

    def _rows(self, pieces: pa.Array, cores: bool) -> np.ndarray:
        """The table row of each piece; makes missing rows."""
        if not len(pieces):
            return np.zeros(0, np.int64)
        key, check = two_prints(pieces)
        if cores:  # kinds of pieces are kept apart
            key = mix64(key)
        out = np.full(len(key), -1, np.int64)
        out[pc.equal(pc.binary_length(pieces), 0).to_numpy(zero_copy_only=False)] = 0
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (self.checks[at] == check) & (out < 0)
            out[hit] = self.rows[at[hit]]
        missing = np.flatnonzero(out < 0)
        if len(missing):
            _, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
            if (check[missing[first]][back] != check[missing]).any():  # one print, two pieces: by their texts
                texts, seen = pieces.take(pa.array(missing)).to_pylist(), {}
                back = np.array([seen.setdefault(x, len(seen)) for x in texts])
                first = np.unique(back, return_index=True)[1]
            new = missing[first]
            start = self.n
            self._append(*self._fresh(pieces.take(pa.array(new)).to_pylist(), cores))
            out[missing] = start + back
            order = np.argsort(key[new], kind="stable")
            where = np.searchsorted(self.keys, key[new][order])
            self.keys = np.insert(self.keys, where, key[new][order])
            self.checks = np.insert(self.checks, where, check[new][order])
            self.rows = np.insert(self.rows, where, (start + np.arange(len(new)))[order].astype(np.int32))
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint32) of a string column and n + 1 offsets by row."""
        return self.encode_counted(column)[:2]

    def encode_counted(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Also the joins that each row's tree took."""
        if not self.by_words:
            lists = [e.ids for e in self.whole.encode_batch_fast([x or "" for x in column.to_pylist()], add_special_tokens=False)]
            sizes = np.array([len(x) for x in lists], np.int64)
            return np.array([i for x in lists for i in x], np.uint32), np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(lists), np.int64)
        if self.n > KEPT:
            self.reset()
        leaves, first = cut(column, LEAF)
        coded, at = words_of(leaves)
        words = coded.dictionary
        head, tail = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        plain = pc.match_substring_regex(words, _PLAIN) if self.plain else pa.array(np.zeros(len(words), bool))
        simple = plain.to_numpy(zero_copy_only=False)
        some = words.filter(plain)
        cores = pc.utf8_rtrim(some, characters=_MARKS)
        head[simple] = self._rows(pc.utf8_lower(cores), True)
        tail[simple] = self._rows(pc.replace_substring_regex(some, f"^[{_LETTERS}]+", ""), False)
        head[~simple] = self._rows(words.filter(pc.invert(plain)), False)
        which = coded.indices.to_numpy(zero_copy_only=False)
        rows = np.stack([head, tail], axis=1)[which] if len(words) else np.zeros((0, 2), np.int64)
        if len(leaves) > len(column):
            self._concatenate(leaves, first, coded, at, rows)
        rows = rows.ravel()
        sizes = self.starts[rows + 1] - self.starts[rows]
        ids = self.ids[ragged(self.starts[rows], sizes)]
        before = np.concatenate([[0], np.cumsum(sizes)])[::2]
        return ids, before[at[first]], np.maximum(0, np.diff(first) - 1)

    def _concatenate(self, leaves: pa.Array, first: np.ndarray, coded: pa.DictionaryArray, at: np.ndarray, rows: np.ndarray) -> None:
        """The tree over the leaves of each text; corrects ``rows`` around its joins.

        A word that a cut has parted is kept in the place of its first part;
        the other's place is empty.
        """
        texts: dict[int, str] = {}
        gone: set[int] = set()
        which, words = coded.indices, coded.dictionary
        word = lambda k: texts[k] if k in texts else words[which[k].as_py()].as_py()

        def known(k: int) -> list[int]:
            return [i for r in rows[k].tolist() for i in self.ids[self.starts[r] : self.starts[r + 1]].tolist()]

        def beside(k: int, step: int, end: int, n: int) -> list[int]:
            """The next n words from place k on that are still there."""
            out: list[int] = []
            while k != end and len(out) < n:
                if k not in gone:
                    out.append(k)
                k += step
            return out

        many = np.flatnonzero(np.diff(first) > 1)
        edges = {k: leaves[k].as_py() for t in many.tolist() for k in range(first[t], first[t + 1])}
        edges = {k: (x[0] not in _SPACE, x[-1] not in _SPACE) for k, x in edges.items()}
        level = 1
        while len(many):
            # join: the cut's place among the words, both sides' bounds, whether a word is parted
            joins = []
            for a, b in zip(first[many].tolist(), first[many + 1].tolist(), strict=True):
                for c in range(a + level, b, 2 * level):
                    joins.append((int(at[c]), int(at[c - level]), int(at[min(b, c + level)]), edges[c - 1][1] and edges[c][0]))
            size = AROUND
            while joins:
                windows = []
                for place, low, high, parted in joins:
                    left, right = beside(place - 1, -1, low - 1, size)[::-1], beside(place, 1, high, size)
                    near = [word(k) for k in left], [word(k) for k in right]
                    middle = [near[0][-1] + near[1][0]] if parted else near[0][-1:] + near[1][:1]
                    windows.append((left, right, middle, " ".join([*near[0][:-1], *middle, *near[1][1:]])))
                again = []
                for join, (left, right, middle, _), ids in zip(joins, windows, self._windows([w[3] for w in windows]), strict=True):
                    parted = join[3]
                    # the outer words must come out as they were; a side without more words ends with its text or waits for its own join
                    before = [i for k in left[:-1] for i in known(k)]
                    after = [i for k in right[1:] for i in known(k)]
                    inner = ids[len(before) : len(ids) - len(after)]
                    agree = ids[: len(before)] == before and ids[len(ids) - len(after) :] == after and len(before) + len(after) <= len(ids)
                    if agree and not parted:
                        agree = inner == [i for k in left[-1:] + right[:1] for i in known(k)]
                    if agree:
                        if parted:
                            texts[left[-1]] = middle[0]
                            gone.add(right[0])
                            self._append(np.array(inner, np.uint32), np.array([len(inner)]))
                            rows[left[-1]], rows[right[0]] = (self.n - 1, 0), (0, 0)
                    elif len(left) < size and len(right) < size:
                        raise ValueError("a window as wide as both sides does not agree with them: white space does not end this file's tokens")
                    else:
                        again.append(join)
                joins, size = again, 2 * size
            level *= 2
            many = many[np.diff(first)[many] > level]

    def _windows(self, texts: list[str]) -> list[list[int]]:
        """The library's ids of windows; very long unsplit words in them go by halves."""
        out: list = [None] * len(texts)
        short = [k for k, x in enumerate(texts) if len(x) <= LONG]
        for k, e in zip(short, self.whole.encode_batch_fast([texts[k] for k in short], add_special_tokens=False), strict=True):
            out[k] = e.ids
        for k, x in enumerate(texts):
            if len(x) > LONG:
                out[k] = [i for w in x.split(" ") for i in (self._long(w) if len(w) > LONG else self.whole.encode(w, add_special_tokens=False).ids)]
        return out

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """What the library's decode gives for each row: without a decoder in the file, tokens with a blank between."""
        if self.whole.decoder is not None:
            return [self.whole.decode(ids[a:b].tolist(), skip_special_tokens=False).encode() for a, b in zip(at[:-1], at[1:], strict=True)]
        if not hasattr(self, "name_bytes"):
            coded = [(t + " ").encode() for t in self.names]
            self.name_bytes = np.frombuffer(b"".join(coded), np.uint8)
            self.name_at = np.concatenate([[0], np.cumsum([len(x) for x in coded])])
        out: list[bytes] = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            some = ids[a:b]
            starts = self.name_at[some]
            out.append(self.name_bytes[ragged(starts, self.name_at[some + 1] - starts)].tobytes()[:-1])
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker; the library has as many threads as a task has cores."""
    import os

    from pyspark import TaskContext

    cores = TaskContext.get().cpus() if TaskContext.get() else 1
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if cores > 1 else "false")
    os.environ.setdefault("RAYON_NUM_THREADS", str(cores))
    return WordEncoder(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds an ``out`` column array<int> with the token ids of ``text``; all other columns stay."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    schema = StructType([*[f for f in docs.schema.fields if f.name != out], StructField(out, ArrayType(IntegerType()), False)])
    keep = [f.name for f in schema.fields[:-1]]

    def work(batches):
        coder = encoder(path)
        for b in text_slices(batches, text, SLICE):
            ids, at = coder.encode(b.column(text))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), lists], names=[*keep, out])

    return docs.select(*[f"`{k}`" for k in dict.fromkeys([*keep, text])]).mapInArrow(work, schema)


def decode_ids(frame: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds an ``out`` string column with the text that the token ids of ``ids`` decode to."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*[f for f in frame.schema.fields if f.name != out], StructField(out, StringType(), False)])
    keep = [f.name for f in schema.fields[:-1]]

    def work(batches):
        coder = encoder(path)
        for b in batches:
            lists = b.column(ids)
            sizes = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
            texts = coder.decode(flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array([t.decode() for t in texts], pa.string())], names=[*keep, out])

    return frame.mapInArrow(work, schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_joins (of the text's tree) of every text, in one pass without a shuffle."""

    def work(batches):
        coder = encoder(path)
        for b in text_slices(batches, limit=SLICE):
            ids, at, joins = coder.encode_counted(b.column("text"))
            whole = memoryview(ids.astype("<u4", copy=False)).cast("B")
            shas = [hashlib.sha256(whole[4 * x : 4 * y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            texts = [hashlib.sha256(t).hexdigest() for t in coder.decode(ids, at)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), pa.array(shas), pa.array(texts), pa.array(joins)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_joins"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_joins long")


def encoded(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep, n_tokens, ids (uint32, little-endian, as binary), ids_sha256 and decoded_sha256 of every text."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema += ", n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"

    def work(batches):
        coder = encoder(path)
        for b in text_slices(batches, limit=SLICE):
            ids, at = coder.encode(b.column("text"))
            raw = ids.astype("<u4", copy=False).tobytes()
            parts = [raw[4 * x : 4 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            own = [hashlib.sha256(x).hexdigest() for x in parts]
            texts = [hashlib.sha256(t).hexdigest() for t in coder.decode(ids, at)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.diff(at)), pa.array(parts, pa.binary()), pa.array(own), pa.array(texts)], names=[*keep, "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return docs.select(*keep, "text").mapInArrow(work, schema)
