"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of key characters that is long enough and mixed, or what
is assigned to a telling name. Its features are its length and entropy, the
transitions between its characters (against those of dictionary words, and
between kinds of characters), how much of it dictionary words cover, the path
or URL it stands in, and the words beside it. The forest learns from labelled
findings: a table of text, first, last and label, or :func:`labelled`, which
makes such a table from patterns of public key formats and of common false
alarms (this corpus has no labelled findings of its own).

One pass over whole texts, no shuffle; the model is small and bounded.

Defined cases: null and empty texts have no findings; a null ``doc_id`` is
carried; overlapping candidates are one, the longest; repeated rows are scanned
alike; other columns are not read.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import text_slices

#: Labelled findings learnt from at most, trees, their depth, score from which a finding is kept.
FINDINGS, TREES, DEPTH, CUT = 20_000, 40, 9, 0.5
#: Names that values are assigned to, words that speak against a secret, file endings.
NAMES = ("access", "api", "apikey", "auth", "authorization", "bearer", "credential", "key", "passwd", "password", "private", "pwd", "secret", "token")
AGAINST = ("blob", "checksum", "commit", "digest", "etag", "example", "hash", "id", "md5", "request", "revision", "sha1", "sha256", "trace", "uuid", "version")
ENDINGS = ("css", "gif", "html", "jpg", "js", "json", "md", "pdf", "png", "py", "svg", "txt", "xml")
PREFIXES = ("AKIA", "ghp_", "sk-", "xoxb-", "eyJ", "AIza")

_RUN = re.compile(r"[A-Za-z0-9_\-+/.~]{16,}(?:={1,2}(?![A-Za-z0-9]))?")
_ASSIGNED = re.compile(r"(?i)\b[\w\-]*(?:" + "|".join(NAMES) + r")[\w\-]*[\"']?\s{0,4}[=:]\s{0,4}[\"']?([^\s\"'<>,;]{8,})")
_WORDS = re.compile(r"[A-Za-z]+")
#: Characters before and after a candidate in which its neighbours are looked for.
BESIDE = 48
#: Characters beyond which a value that is no secret itself is looked into, as a long address may hold one.
LONG = 200


def candidates(text: str, first: int = 0, last: int | None = None) -> list[tuple[int, int]]:
    """Character ranges from first to last that may be secrets, without overlaps."""
    spans, last = [], len(text) if last is None else last
    for m in _RUN.finditer(text, first, last):
        a, b = m.span()
        while b > a and text[b - 1] in ".-":
            b -= 1
        x = text[a:b]
        if b - a >= 16 and (any(c.isdigit() for c in x) or (x != x.lower() and x != x.upper() and not x.istitle())):
            spans.append((a, b))
    if "=" in text or ":" in text:
        spans += [m.span(1) for m in _ASSIGNED.finditer(text, first, last)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0] - s[1], s)):
        if all(b <= x or a >= y for x, y in out):
            out.append((a, b))
    return sorted(out)


def inner(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Candidates within a long one."""
    return [s for s in candidates(text, a, b) if s != (a, b)] if b - a > LONG else []


class Lexicon:
    """Dictionary words and the transitions of their letters, from a public vocabulary file."""

    def __init__(self, path: str):
        vocab = json.loads(open(path, encoding="utf-8").read())["model"]["vocab"]
        whole = (t[:-4] for t in vocab if t.endswith("</w>"))
        self.words = frozenset(w for w in whole if 3 <= len(w) <= 16 and w.isascii() and w.isalpha())
        pairs = Counter(w[k : k + 2] for w in self.words for k in range(len(w) - 1))
        total = sum(pairs.values())
        self.rare = math.log(0.5 / total)
        self.pairs = {p: math.log(n / total) for p, n in pairs.items()}

    def coverage(self, x: str) -> float:
        """The share of letters that dictionary words of three letters or more cover, longest first."""
        low, at, covered = x.lower(), 0, 0
        while at < len(low):
            for size in range(min(16, len(low) - at), 2, -1):
                if low[at : at + size] in self.words:
                    covered, at = covered + size, at + size
                    break
            else:
                at += 1
        return covered / max(1, len(low))

    def transitions(self, x: str) -> float:
        low = x.lower()
        return sum(self.pairs.get(low[k : k + 2], self.rare) for k in range(len(low) - 1)) / max(1, len(low) - 1)


@lru_cache(maxsize=2)
def lexicon(path: str) -> Lexicon:
    return Lexicon(path)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


FEATURES = (
    "length", "entropy", "pairs", "covered", "digits", "upper", "lower", "marks", "changes", "distinct", "hex", "vowels", "longest_run",
    "slashes", "dots", "url", "ending", "at", "prefix", "named", "named_far", "against", "assigned", "quoted", "word_before", "word_after", "repeats",
)


def features(text: str, a: int, b: int, known: Lexicon) -> list[float]:
    x, n = text[a:b], b - a
    before, after = text[max(0, a - BESIDE) : a], text[b : b + BESIDE]
    kinds = [_kind(c) for c in x]
    counts = Counter(x)
    left = [w.lower() for w in _WORDS.findall(before)]
    right = [w.lower() for w in _WORDS.findall(after)]
    run = best = 1
    for k in range(1, n):
        run = run + 1 if kinds[k] == kinds[k - 1] else 1
        best = max(best, run)
    start = max(text.rfind(c, max(0, a - 200), a) for c in " \n\t\"'") + 1
    around = text[start:b]
    tail = before.rstrip(" \"'")
    return [
        float(min(n, 400)), -sum(v / n * math.log2(v / n) for v in counts.values()), known.transitions(x), known.coverage(x),
        kinds.count(0) / n, kinds.count(2) / n, kinds.count(1) / n, kinds.count(3) / n, sum(p != q for p, q in zip(kinds, kinds[1:], strict=False)) / n, len(counts) / n,
        float(all(c in "0123456789abcdef" for c in x.lower())), sum(c in "aeiouAEIOU" for c in x) / n, best / n,
        float(around.count("/")), float(x.count(".")), float("://" in around), float(x.rpartition(".")[2].lower() in ENDINGS and "." in x), float("@" in around or after[:1] == "@"),
        float(x.startswith(PREFIXES)), float(bool(left) and any(m in left[-1] for m in NAMES)), float(any(m in w for w in left[-4:] for m in NAMES)),
        float(any(w in AGAINST for w in left[-2:])), float(tail[-1:] in ("=", ":")), float(before[-1:] in ('"', "'") and after[:1] == before[-1:]),
        float(bool(left) and left[-1] in known.words), float(bool(right) and right[0] in known.words), max(counts.values()) / n,
    ]


class Forest:
    """Trees as flat arrays: statistic, bound, children, share of ones."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for which, bound, low, high, share in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = which[node] >= 0
                go = x[rows, np.maximum(which[node], 0)] <= bound[node]
                node = np.where(inner, np.where(go, low[node], high[node]), node)
            total += share[node]
        return total / max(1, len(self.trees))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Forest:
    """A forest on bootstrap samples and, at each split, a random square root of the features."""
    rng, n = np.random.default_rng(seed), len(y)
    trees = []
    for _ in range(TREES if n else 0):
        rows = rng.integers(0, n, n)
        which, bound, low, high, share = [], [], [], [], []

        def grow(rows: np.ndarray, depth: int, nodes=(which, bound, low, high, share)) -> int:
            which, bound, low, high, share = nodes
            node, mean = len(which), float(y[rows].mean())
            for part, value in zip(nodes, (-1, 0.0, 0, 0, mean), strict=True):
                part.append(value)
            if depth == DEPTH or mean in (0.0, 1.0) or len(rows) < 8:
                return node
            best = (1e-12, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, math.isqrt(x.shape[1]) + 1), replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, good = x[rows, f][order], np.cumsum(y[rows][order])
                cut = np.flatnonzero(v[1:] > v[:-1])
                if not len(cut):
                    continue
                m = cut + 1.0
                gain = good[cut] ** 2 / m + (good[-1] - good[cut]) ** 2 / (len(rows) - m) - good[-1] ** 2 / len(rows)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
            _, f, at = best
            if f < 0:
                return node
            left = x[rows, f] <= at
            which[node], bound[node] = f, at
            low[node] = grow(rows[left], depth + 1)
            high[node] = grow(rows[~left], depth + 1)
            return node

        grow(rows, 0)
        trees.append(tuple(np.array(v) for v in (which, bound, low, high, share)))
    return Forest(trees)


def labelled(n: int = 4000, seed: int = 3, words: tuple[str, ...] = ("the", "build", "server", "river", "north", "und", "des", "para", "config", "lines")) -> list[tuple[str, int, int, int]]:
    """Findings (text, first, last, label) made from public key formats and common false alarms."""
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    hexes, caps = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    base = caps + caps.lower() + "0123456789"
    word = lambda: rng.choice(words) if rng.random() < 0.5 else pick("aeinorstlud", rng.randint(2, 9))
    say = lambda k: " ".join(word() for _ in range(rng.randint(0, k)))
    key = lambda: rng.choice([lambda: pick(hexes, rng.choice([32, 40, 64])), lambda: pick(hexes, 40).upper(), lambda: pick(base + "+/", rng.choice([24, 32, 43])) + rng.choice(["", "="]), lambda: pick(base, rng.randint(20, 40)), lambda: "AKIA" + pick(caps + "234567", 16), lambda: "ghp_" + pick(base, 36), lambda: "sk-" + pick(base, 32), lambda: "xoxb-" + pick("0123456789", 11) + "-" + pick(base, 24)])()
    out = []
    while len(out) < n:
        real, name, mark = rng.random() < 0.5, rng.choice(NAMES), rng.choice(["=", ":", " = ", ": "])
        quote = rng.choice(["", '"', "'"])
        if real:
            x = key()
            kind = rng.random()
            if kind < 0.7:
                lead = rng.choice([name, name.upper(), f"my_{name}", f"client_{name}", name.title()]) + mark + quote
            elif kind < 0.8:
                lead, quote = "Authorization: Bearer ", ""
            else:
                x, lead, quote = rng.choice(["AKIA" + pick(caps + "234567", 16), "ghp_" + pick(base, 36), "sk-" + pick(base, 32)]), "", ""
        else:
            kind, lead = rng.randrange(12), ""
            if kind == 0:
                x, quote = "-".join(word() for _ in range(5)) + pick("0123456789", 2), ""
            elif kind == 1:
                x, quote = "/".join(["", "usr", word(), word() + pick("0123456789", 3), word() + "." + rng.choice(ENDINGS)]), ""
            elif kind == 2:
                x, lead, quote = "//www.example.com/" + word() + "/" + pick("0123456789", 6) + "/" + word(), "https:", ""
            elif kind == 3:
                x, quote = pick("0123456789", rng.randint(16, 22)), ""
            elif kind == 4:
                x, lead = "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), rng.choice(["request id ", "uuid: ", "trace="]) + quote
            elif kind == 5:
                x, lead, quote = pick(hexes, rng.choice([32, 40, 64])), rng.choice(["commit ", "checksum: ", "sha256: ", "md5 = ", "revision "]), ""
            elif kind == 6:
                x, lead = rng.choice(["x" * rng.randint(16, 30), "your_" + name + "_here_123", "changeme" * 2 + "1", "0" * 32, "<" + "insert-value-here1>", "example_" + name + "_value0"]), name + mark + quote
            elif kind == 7:
                x, lead, quote = f"mail{pick('0123456789', 1)}.{word()}.example.com", word() + ".55@", ""
            elif kind == 8:
                x, quote = "".join(word().title() for _ in range(4)) + "Test" + pick("0123456789", 1), ""
            elif kind == 9:
                x, quote = "2024-" + pick("01", 2) + "-11T10:00:" + pick("012345", 2) + "." + pick("0123456789", 6), ""
            elif kind == 10:
                x, lead, quote = "".join(word() for _ in range(4)), name + mark, ""
            else:
                x, quote = "_".join(word().upper() for _ in range(4)) + "_V" + pick("0123456789", 1), ""
            if len(x) < 8:
                x += "padding" + pick("0123456789", 3)
        before = say(6)
        before = before + " " if before else ""
        text = before + lead + quote + x + quote + " " + say(6)
        first = len(before + lead + quote)
        out.append((text, first, first + len(x), int(real)))
    return out


def train(findings, path: str, limit: int = FINDINGS) -> Forest:
    """findings: a DataFrame or list of (text, first, last, label); those with the smallest hashes are taken up to the limit."""
    if isinstance(findings, DataFrame):
        some = findings.where("text is not null and label in (0, 1)").orderBy(F.xxhash64("text", "first", "last"), "text", "first", "last", "label").limit(limit)
        findings = [tuple(r) for r in some.select("text", "first", "last", "label").collect()]
    known = lexicon(path)
    rows = [(features(t, a, b, known), y) for t, a, b, y in findings[:limit] if 0 <= a < b <= len(t)]
    return fit(np.array([r[0] for r in rows], np.float64).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows], np.float64))


_FOUND = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, forest: Forest, path: str, cut: float = CUT) -> DataFrame:
    """doc_id, n_candidates, findings (first, last, score of those kept) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def work(batches):
        known = lexicon(path)
        for b in text_slices(batches):
            places, rows, counts = [], [], []
            for text in b.column("text").to_pylist():
                some = [((x, y), inner(text, x, y)) for x, y in candidates(text)] if text else []
                places.append(some)
                counts.append(sum(1 + len(more) for _, more in some))
                rows += [features(text, x, y, known) for span, more in some for x, y in (span, *more)]
            scores = iter(shared.value.score(np.array(rows, np.float64)).tolist() if rows else ())
            found = []
            for some in places:
                found.append([])
                for span, more in some:
                    whole, *parts = [{"first": x, "last": y, "score": next(scores)} for x, y in (span, *more)]
                    found[-1] += [whole] if whole["score"] >= cut else [f for f in parts if f["score"] >= cut]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, _FOUND)], names=["doc_id", "n_candidates", "findings"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, n_candidates long, findings array<struct<first:long,last:long,score:double>>")


def digest(docs: DataFrame, path: str, findings=None) -> DataFrame:
    """doc_id, n_candidates, n_secrets and spans (first-last with commas) of every document. findings: labelled ones to learn from, as :func:`train` takes them."""
    found = scan(docs, train(labelled() if findings is None else findings, path), path)
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws("-", f["first"].cast("string"), f["last"].cast("string"))), ",")
    return found.select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"), spans.alias("spans"))
