import random
import zlib

import numpy as np
import pytest


def corpus(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            w = [x + rng.choice(["$$$", "###", "&&&"]) for x in w] if i % 8 else [rng.choice(w[:4]) for _ in w]
        rows.append((i, " ".join(w), 0 if bad else 1))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", 3.0, 1) for i, t, _ in rows], "doc_id long, text string, lang string, score double, held_out int")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")


def test_held_out_accuracy(spark):
    from rastrel.llm import quality_rules as q

    rows = corpus(600)
    got = {r.doc_id: r for r in q.judge(*frames(spark, rows)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    out = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(out) > 100 and np.mean([a == b for a, b in out]) > 0.95


def test_held_out_labels_do_not_count(spark):
    from rastrel.llm import quality_rules as q

    rows = corpus(300)
    flipped = [(i, t, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, t, y in rows]
    a, b = ({r.doc_id: r.score for r in q.judge(*frames(spark, x)).collect()} for x in (rows, flipped))
    assert a == b


def test_rule_columns_match_numpy(spark):
    from rastrel.llm import quality_rules as q

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    m = q.fit(["a", "b", "c"], x, y)
    assert m.rules and all(len(r.bounds) <= q.DEPTH for r in m.rules)
    got = [r.s for r in spark.createDataFrame(x.tolist(), "a double, b double, c double").select(m.column().alias("s")).collect()]
    total = np.full(400, m.base)
    for r in m.rules:
        hit = np.ones(400, bool)
        for name, low, high in r.bounds:
            v = x[:, "abc".index(name)]
            hit &= (v > low) & (v <= high)
        total += r.weight * hit
    assert np.allclose(got, 1 / (1 + np.exp(-total))) and ((np.array(got) > 0.5) == (y == 1)).mean() > 0.97


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, None)]])
def test_odd_texts_and_labels(spark, labels):
    from rastrel.llm import quality_rules as q

    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t "), (None, "a b"), (3, "x" * 50_000), (3, "x" * 50_000)], "doc_id long, text string")
    got = q.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert q.judge(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0
