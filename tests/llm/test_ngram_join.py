import random
import re
from types import SimpleNamespace

import numpy as np
import pytest


def brute(rows, size=5, percent=75):
    sets = []
    for _, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                i, j = sorted((find(a), find(b)))
                root[j] = i
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinorsté") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(40)]
    rows = [None, "", " \t\n", "one two", "One  TWO", "a b c d e", "A b c d e ", "a b c d", "É É É", "é é é"]
    while len(rows) < n:
        x = [word() for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.4:
            x = x[: len(x) // 2] + passage + x[len(x) // 2 :]
        rows.append(" ".join(x))
        for _ in range(rng.choice([0, 0, 1, 3, 20])):  # near copies, chains of them too
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(len(x))] = word()
            if rng.random() < 0.3:
                x = x[: max(3, len(x) - rng.randint(0, len(x) // 5))]
            rows.append(" ".join(x))
    ids = rng.sample(range(-500, 5000), len(rows))
    return [*zip(ids, rows, strict=True), (9000, rows[20]), (9001, rows[20]), (None, rows[30])]


@pytest.mark.parametrize("seed,pairs,part", [(1, 64, 1_000_000), (2, 3, 1_000_000), (3, 1, 1_000_000), (4, 1, 150), (5, 2, 600)])
def test_against_brute_force(spark, seed, pairs, part, monkeypatch):
    from rastrel.llm import ngram_join

    monkeypatch.setattr(ngram_join, "PAIRS", pairs)
    monkeypatch.setattr(ngram_join, "PART", part)
    monkeypatch.setattr(ngram_join, "ADDED", 2 if seed == 2 else 32)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long").repartition(9)
    got = ngram_join.join(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_large_blocks_are_dealt_to_parts(spark, monkeypatch):
    """Chains of near copies whose ends don't link, in parts of a few texts."""
    from rastrel.llm import ngram_join

    rng = random.Random(8)
    rows = []
    for _ in range(3):
        x = [f"w{rng.randrange(9)}x{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(40):
            x = x[:]
            x[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(x)))
    rng.shuffle(rows)
    monkeypatch.setattr(ngram_join, "PAIRS", 2)
    monkeypatch.setattr(ngram_join, "PART", 200)
    crossed = []
    whole = ngram_join._crossed
    monkeypatch.setattr(ngram_join, "_crossed", lambda *a: crossed.append(1) or whole(*a))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows) and crossed


def test_components(spark):
    from rastrel.llm.components import components

    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(200, 200 + k) for k in range(50)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_empty(spark):
    from rastrel.llm import ngram_join

    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


class Steps:
    """Takes the functions that candidates are made with, to run them on chosen slices."""

    def mapInArrow(self, work, schema):
        self.first = work
        return self

    def applyInArrow(self, work, schema):
        self.meet = work
        return self

    def groupBy(self, *_):
        return self

    distinct = groupBy


def slices(seed, chained):
    """A family that shares one shingle with a text of other words, whose partners are in other slices; the family's first text leads.

    Whether the shingle comes first in the family's order depends on hashes and so on the seed.
    """
    rng = random.Random(seed)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    head, family, tail = own(5), own(8 if chained else 5), own(12 if chained else 5)
    first = [" ".join([*head, *family, *own(1)]) for _ in range(20 if chained else 10)]
    first.append(" ".join([*head, *tail, *own(0 if chained else 1)]))
    others = [[" ".join([*head, *tail, *own(4 if chained else 1)]) for _ in range(3)] for _ in range(3 if chained else 1)]
    common = [" ".join([*own(9), *head[1:], *tail]) for _ in range(40)]
    return [first, *others, common]


@pytest.mark.parametrize("chained", [False, True])
@pytest.mark.parametrize("seed", [4, 9, 16, 21])
def test_leads_speak_for_all_they_replace(seed, chained, monkeypatch):
    """What links is joined by chains and linking pairs, also where a slice gives one text for many."""
    import pyarrow as pa

    from rastrel.llm import ngram_join

    monkeypatch.setattr(ngram_join, "PAIRS", 4)
    parts = slices(seed, chained)
    texts = [t for p in parts for t in p]
    sets = ngram_join.shingles(pa.array(texts), 5)[0]
    counts = np.bincount(np.concatenate(sets).astype(np.int64) & (ngram_join.CELLS - 1), minlength=ngram_join.CELLS)
    steps = Steps()
    ngram_join._candidates(steps, SimpleNamespace(value=np.log2(counts + 1).astype(np.uint8)), 5, 75, 1)
    blobs, at = [], 0
    for p in parts:
        ids = range(at, at := at + len(p))
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([str(i).encode() for i in ids]), pa.array(p)], names=["id", "text_key", "text"])
        blobs += [b.column("blob") for b in steps.first([batch])]
    made = steps.meet(pa.table({"blob": pa.chunked_array(blobs)})).to_pylist()
    links = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
    root = list(range(len(texts)))
    for r in made:
        if r["kind"] or links(r["a"], r["b"]):
            old, new = root[r["a"]], root[r["b"]]
            root = [new if x == old else x for x in root]
    assert [(a, b) for a in range(len(texts)) for b in range(a) if root[a] != root[b] and links(a, b)] == []


def test_what_is_often_goes_behind_in_the_order(spark, monkeypatch):
    """Phrases that many texts share don't chain these to one block, also where the table of counts is too full to tell them."""
    from rastrel.llm import ngram_join

    rng = random.Random(11)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    phrases = [own(5) for _ in range(40)]
    rows = []
    for _ in range(400):
        x = [w for p in rng.sample(phrases, 4) for w in [*own(15), *p]]
        rows.append((len(rows), " ".join(x)))
        if rng.random() < 0.1:
            x[40] = "other"
            rows.append((len(rows), " ".join(x)))
    monkeypatch.setattr(ngram_join, "CELLS", 64)
    monkeypatch.setattr(ngram_join, "PAIRS", 4)
    monkeypatch.setattr(ngram_join, "SHARE", 1, raising=False)
    largest = []
    whole = ngram_join._verified

    def seen(texts, blocks, *rest):
        largest.extend(r["count"] for r in blocks.groupBy("component").count().collect())
        return whole(texts, blocks, *rest)

    monkeypatch.setattr(ngram_join, "_verified", seen)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert max(largest) < 20


def test_pairs_of_long_texts_are_bounded(spark):
    """A bitmap of fixed size is full for long texts; theirs are as wide as their sets."""
    from rastrel.llm import ngram_join

    rng = random.Random(12)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    shared = own(50)
    texts = [[*own(12_000 + 300 * k), *shared] for k in range(4)]
    copy = [*texts[1][:-1500], *own(900)]
    rows = [(k, f"k{k}".encode(), k, " ".join(x)) for k, x in enumerate([*texts, copy])]
    docs = spark.createDataFrame(rows, "doc_id long, text_key binary, id long, text string")
    measured = ngram_join.saved(ngram_join._measure(docs, 5), "shingles")
    pairs = spark.createDataFrame([(0, a, b) for b in range(5) for a in range(b)], "kind int, a long, b long")
    assert [tuple(r) for r in ngram_join._bounded(pairs, measured, 75).collect()] == [(1, 4)]


@pytest.mark.parametrize("words", [1, 1 << 19])
def test_copies_in_many_tasks(spark, words, monkeypatch):
    """Copies are not brought together before shingles meet; a bitmap that lets all pass changes nothing."""
    from rastrel.llm import ngram_join

    rng = random.Random(15)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(30):
        x = own(30)
        for _ in range(1 + 11 * (k % 3 == 0)):
            rows.append((len(rows), " ".join(x)))
        x[2] = "other"
        rows.append((len(rows), " ".join(x)))
    rows += [(len(rows), ""), rows[0], rows[-1]]
    monkeypatch.setattr(ngram_join, "SIEVE", words, raising=False)
    monkeypatch.setattr(ngram_join, "PAIRS", 4)
    kinds = []
    whole = ngram_join._bounded
    monkeypatch.setattr(ngram_join, "_bounded", lambda candidates, *a: kinds.extend(r.kind for r in candidates.collect()) or whole(candidates, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = ngram_join.join(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert kinds == [0] * 30  # a pair for each text and its near copy, none of a text with itself, no chain
    kept = sorted(r.doc_id for r in ngram_join.keep_first(docs).collect())
    assert kept == sorted({i for i, n, c in brute(rows) if i == c or not n})
