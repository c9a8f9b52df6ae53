import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest


def brute(rows, width, words=None):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + width] for _, t in texts for k in range(len(t) - width + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = True
        edges = np.diff(gone.astype(int), prepend=0)
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((i, len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    if words:
        lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
        seen = Counter(tuple(w[k : k + words]) for w in lists for k in range(len(w) - words + 1))
        covered = [len({j for k in range(len(w) - words + 1) if seen[tuple(w[k : k + words])] > 1 for j in range(k, k + words)}) for w in lists]
        out = [(*r, n) for r, n in zip(out, covered, strict=True)]
    return sorted(out, key=str)


def corpus(width, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinorsté") for _ in range(rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(width // 3) for _ in range(3)]
    rows = [None, "", "x", "a" * (3 * width), "ab" * (2 * width), "a" * (width - 1)]
    for _ in range(40):
        body = text(rng.randint(0, width))
        if rng.random() < 0.5:
            s = rng.choice(shared)
            cut = rng.randint(0, len(s) // 3)
            body = body[: len(body) // 2] + s[cut:] + body[len(body) // 2 :]
        rows.append(body)
    rows += [rows[10]] * 3 + [rows[12] + "!", "?" + rows[12], rows[14] + rows[14]]
    return [*enumerate(rows), (None, rows[20]), (5, rows[5])]


@pytest.mark.parametrize("width,seed,words", [(40, 1, 5), (60, 2, 9), (400, 3, 51), (33, 4, 2)])
def test_against_brute_force(spark, width, seed, words, monkeypatch):
    from rastrel.llm import suffix_dedup

    rows = corpus(width, seed)
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, text_key string").repartition(3)
    monkeypatch.setattr(suffix_dedup, "WORDS", words)
    got = sorted(map(tuple, suffix_dedup.dedup(docs, width).collect()), key=str)
    assert got == brute(rows, width, words) and sum(r[5] > 0 for r in got) > 5


def test_blocks_do_not_matter(spark, monkeypatch):
    from rastrel.llm import suffix_dedup as s

    rows = corpus(40, 9)
    raw = "".join(t or "" for _, t in rows).encode()
    at = np.concatenate([[0], np.cumsum([len((t or "").encode()) for _, t in rows])])
    whole = s.anchors(np.frombuffer(raw, np.uint8), at, 40)
    monkeypatch.setattr(s, "BLOCK", 97)
    cut = s.anchors(np.frombuffer(raw, np.uint8), at, 40)
    assert all((whole[k] == cut[k]).all() for k in ("row", "first", "last", "hash"))


def test_radix_groups_are_the_repeated_windows():
    from rastrel.llm import suffix_dedup as s

    rng = random.Random(7)
    for depth in (1, 7, 8, 9, 20, 33):
        raw = bytes(rng.choice(b"ab" if depth > 8 else b"abcd") for _ in range(600))
        raw += raw[100:160]
        n = len(raw) - depth + 1
        key = np.array([k % 2 for k in range(n)], np.uint64)
        got = s.radix_groups(np.frombuffer(raw + bytes(s.DIGIT), np.uint8), np.arange(n), key, depth)
        seen = Counter((k % 2, raw[k : k + depth]) for k in range(n))
        want = [k for k in range(n) if seen[k % 2, raw[k : k + depth]] > 1]
        assert sorted(got.tolist()) == want
        assert [(k % 2, raw[k : k + depth]) for k in got.tolist()] == sorted((k % 2, raw[k : k + depth]) for k in want)


def test_clean_returns_the_text_that_is_left(spark):
    from rastrel.llm import suffix_dedup as s

    rows = corpus(60, 5)
    docs = spark.createDataFrame([(*r, "k", k) for k, r in enumerate(rows)], "doc_id long, text string, text_key string, __suffix_key int").repartition(3)
    out = s.clean(docs, 60)
    assert out.columns == docs.columns
    judged = dict(zip(range(len(rows)), [None] * len(rows), strict=True))
    seen = Counter(b[k : k + 60] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - 59))
    for n, (_, t) in enumerate(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 59):
            if seen[b[k : k + 60]] > 1:
                gone[k : k + 60] = True
        at, left = 0, []
        for c in t or "":
            if not gone[at : at + len(c.encode())].any():
                left.append(c)
            at += len(c.encode())
        judged[n] = None if t is None else "".join(left)
    assert {r["__suffix_key"]: r.text for r in out.collect()} == judged and out.count() == len(rows)


def test_slices_do_not_matter(spark, monkeypatch):
    """Texts above a slice, and repeats within and across slices."""
    from rastrel.llm import suffix_dedup as s

    rows = corpus(40, 11) + [(900, "".join(random.Random(3).choice("abcdefg ") for _ in range(9000)))]
    monkeypatch.setattr(s, "SLICE", 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, s.dedup(docs, 40).collect()), key=str) == brute(rows, 40, s.WORDS)


def test_empty(spark):
    from rastrel.llm import suffix_dedup

    assert suffix_dedup.clean(spark.createDataFrame([], "doc_id long, text string")).count() == 0

    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
