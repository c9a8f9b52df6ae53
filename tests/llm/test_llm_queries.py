"""The registered queries on the smallest tables, against SQL or brute force."""

import glob
import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(map(tuple, spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()))


def run(spark, name):
    import __spark_entry__

    return __spark_entry__.queries()[name](spark, DATA)


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_ngram_join", "op3_suffix_dedup", "op5_line_dedup", "op6_cover_tree", "op8_decontaminate"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    out = run(spark, name)
    columns = sorted(out.columns)
    want = c.execute(__spark_entry__.oracle_sql()[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == columns
    assert sorted(repr(tuple(r[k] for k in columns)) for r in out.collect()) == sorted(repr(tuple(r[at.index(k)] for k in columns)) for r in want.fetchall())


def test_op2(spark, docs):
    from test_ngram_join import brute

    assert sorted(map(tuple, run(spark, "op2_ngram_join").collect()), key=str) == brute(docs)


def test_op3(spark, docs):
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[k : k + 400] for _, t in texts for k in range(len(t) - 399))
    want = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = np.frombuffer(t, np.uint8)[~gone[: len(t)]].tobytes()
        want.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert sorted(tuple(r)[:5] for r in run(spark, "op3_suffix_dedup").collect()) == want and any(w[2] for w in want)


def test_op4(spark, docs):
    import re

    texts = dict(docs)
    found = {r.doc_id: r for r in run(spark, "op4_secret_scan").collect()}
    assert set(found) == set(texts)
    for i, t in texts.items():
        spans = {(m.start(1), m.end(1)) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t or "")}
        got = {tuple(map(int, s.split("-"))) for s in found[i].spans.split(",") if s}
        assert got == spans and found[i].n_secrets == len(spans)


def test_op4_against_brute_force(spark, docs):
    """All columns: candidates found a character at a time, trees followed a row at a time."""
    import re

    from rastrel.llm import secret_scan as s

    path = str(P.path("word_bpe_49k.json"))
    forest, known = s.train(s.labelled(), path), s.lexicon(path)
    runs = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/.~")
    value = re.compile("(?i)(?<![\\w])[\\w\\-]*(?:" + "|".join(s.NAMES) + ")[\\w\\-]*[\"']?\\s{0,4}[=:]\\s{0,4}[\"']?([^\\s\"'<>,;]{8,})")

    def spans(t):
        out, k = [], 0
        while k < len(t):
            e = k
            while e < len(t) and t[e] in runs:
                e += 1
            if e - k >= 16:
                end = e
                marks = len(t[e:]) - len(t[e:].lstrip("="))
                if marks in (1, 2) and not (t[e + marks : e + marks + 1].isascii() and t[e + marks : e + marks + 1].isalnum()):
                    end = e + marks
                elif marks > 2:
                    end = e + 2
                while t[end - 1] in ".-":
                    end -= 1
                x = t[k:end]
                if len(x) >= 16 and (any(c.isdigit() for c in x) or (x != x.lower() and x != x.upper() and not x.istitle())):
                    out.append((k, end))
            k = max(e, k + 1)
        out += [m.span(1) for m in value.finditer(t)]
        kept = []
        for a, b in sorted(out, key=lambda x: (x[0] - x[1], x)):
            if not any(a < y and x < b for x, y in kept):
                kept.append((a, b))
        return sorted(kept)

    def score(row):
        total = 0.0
        for which, bound, low, high, share in forest.trees:
            node = 0
            while which[node] >= 0:
                node = int(low[node] if row[which[node]] <= bound[node] else high[node])
            total += share[node]
        return total / len(forest.trees)

    found = {r.doc_id: tuple(r) for r in run(spark, "op4_secret_scan").collect()}
    for i, t in docs:
        some = spans(t or "")
        assert not any(b - a > s.LONG for a, b in some)  # longer ones are looked into, which other tests cover
        hits = [f"{a}-{b}" for a, b in some if score(s.features(t, a, b, known)) >= s.CUT]
        assert found[i] == (i, len(some), len(hits), ",".join(hits))


def test_op7_against_brute_force(spark, docs):
    """Scores from statistics counted in Python and rules followed one by one."""
    import math

    import regex

    from rastrel.llm import quality_rules as q

    frame, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    model = q.train(frame, labels)
    assert model.rules

    def statistics(t):
        n, words, lines = len(t), regex.split(r"[ \t\n\x0B\f\r]+", t), t.split("\n")
        count = lambda marks: sum(c in marks for c in t)
        share = lambda a, b: a / b if b > 0 else 0.0
        letters = len(regex.findall(r"\p{L}", t))
        return {
            "log_chars": math.log1p(n), "letters": share(letters, n), "upper": share(len(regex.findall(r"\p{Lu}", t)), n), "digits": share(count("0123456789"), n), "symbols": share(count("#$%&*+=<>^~_{}[]\\/@"), n),
            "bars": share(count("|"), n), "bangs": share(count("!"), n), "stops": share(count(".?"), n), "commas": share(count(",;:"), n), "spaces": share(count(" \t"), n), "word_length": share(letters, len(words)),
            "distinct_words": share(len(set(words)), len(words)), "log_words": math.log1p(len(words)), "line_length": share(n, len(lines)), "distinct_lines": share(len(set(lines)), len(lines)), "full_lines": share(sum(bool(x) for x in lines), len(lines)),
        }

    got = {r.doc_id: r for r in run(spark, "op7_quality_rules").collect()}
    for i, t in docs:
        stats = statistics(t or "")
        total = model.base + sum(r.weight for r in model.rules if all(low < stats[name] <= high for name, low, high in r.bounds))
        want = 1 / (1 + math.exp(-total))
        assert abs(got[i].score - want) < 1e-9 and got[i].predicted == int(got[i].score >= 0.7) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_op6(spark):
    from test_cover_tree import brute

    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, run(spark, "op6_cover_tree").collect())) == brute(rows, 20, 20)


def test_op7(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op7_quality_rules").collect()}
    told = dict(map(tuple, spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality").collect()))
    assert set(got) == {i for i, _ in docs}
    held = [i for i in told if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and np.mean([got[i].predicted == told[i] for i in held]) > 0.8


def test_op9_and_op10(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    t.no_truncation(), t.no_padding()
    start, shards, digests = 0, [], []
    for i, x in docs:
        ids = t.encode(x or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        digests.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        shards.append((i, start, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())))
        start += len(ids) + 1
    got = sorted(map(tuple, run(spark, "op10_bpe").collect()))
    assert [r[:4] for r in got] == digests
    assert [r[4] for r in got] == [max(0, -(-len(x or "") // 2048) - 1) for _, x in docs] and sum(r[4] for r in got) > 0
    assert sorted(map(tuple, run(spark, "op9_token_shards").collect())) == shards
