import hashlib
import random
from collections import Counter

import pytest


def chunks(text):
    """The lines, and where chunks of two begin."""
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    r = [31 * x + y for x, y in zip(h, h[1:], strict=False)]
    return lines, [k for k in range(len(r)) if k in (0, len(r) - 1) or r[k] <= r[k - 1] or r[k] <= r[k + 1]]


def brute(rows):
    places: dict = {}
    at = lambda i, t, k: (i is not None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), k)
    for i, t in rows:
        lines, starts = chunks(t)
        for k in starts:
            places.setdefault((lines[k], lines[k + 1]), set()).add(at(i, t, k))
    out = []
    for i, t in rows:
        lines, starts = chunks(t)
        again = [k for k in starts if min(places[lines[k], lines[k + 1]]) != at(i, t, k)]
        gone = {j for k in again for j in (k, k + 1)}
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone) if again else t, len(lines), len(gone), len(again)))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    line = lambda: " ".join("".join(rng.choice("aeinost") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 5)))
    blocks = [[line() for _ in range(rng.randint(5, 14))] for _ in range(4)]
    rows = [None, "", "\n", "\n\n\n", "a", "a\na\na\na\na\na\na\na"]
    for _ in range(80):
        x = [line() for _ in range(rng.randint(0, 12))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randint(0, len(x))
            x = x[:at] + rng.choice(blocks) + x[at:]
        rows.append("\n".join(x))
    rows += ["\n".join(blocks[0] * 3), "\n".join(["same"] * 3000)]
    ids = rng.sample(range(-50, 500), len(rows))
    return [*zip(ids, rows, strict=True), (777, rows[20]), (778, rows[20]), (None, rows[21]), (None, rows[22]), (777, rows[20])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    from rastrel.llm import line_dedup

    rows = corpus(seed)
    docs = spark.createDataFrame([(i, "en", t, 5, 6, 7, 8) for i, t in rows], "doc_id long, lang string, text string, k int, first int, row int, `d` int").repartition(3)
    got = line_dedup.dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed", "n_chunks"]
    want = brute(rows)
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_removed", "n_chunks").collect()), key=str) == want
    assert Counter(w[4] > 0 for w in want)[True] > 20


@pytest.mark.parametrize("n", [2, 3, 4, 6, 8])
def test_repeated_passages_are_found(spark, n):
    """Passages of n lines, each in two documents of its own: with three lines or more, all but perhaps the first and last go from the second."""
    from rastrel.llm import line_dedup

    rng = random.Random(n)
    line = lambda: " ".join("".join(rng.choice("aeinost") for _ in range(6)) for _ in range(8))
    passages = [[line() for _ in range(n)] for _ in range(60)]
    rows = [(2 * k + half, "\n".join([*(line() for _ in range(rng.randint(1, 4))), *p, *(line() for _ in range(rng.randint(1, 4)))])) for k, p in enumerate(passages) for half in (0, 1)]
    got = dict(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect())
    texts = dict(rows)
    found = 0
    for k, p in enumerate(passages):
        assert got[2 * k] == texts[2 * k]
        left = [x for x in p if x in got[2 * k + 1].split("\n")]
        assert n < 3 or not set(left) & set(p[1:-1])
        assert [x for x in texts[2 * k + 1].split("\n") if x not in p] == [x for x in got[2 * k + 1].split("\n") if x not in p]
        found += n - len(left)
    assert found >= (0.35 if n == 2 else 0.6) * 60 * n


def test_very_long_text(spark):
    from rastrel.llm import line_dedup

    rng = random.Random(8)
    lines = [str(rng.random()) for _ in range(60_000)]
    out = dict((r[0], r[1:]) for r in line_dedup.dedup(spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[30_000:])), (3, "x" * 3_000_000)], "doc_id long, text string")).select("doc_id", "n_lines", "n_removed").collect())
    assert out[1] == (60_000, 0) and out[2][0] == 30_000 and out[2][1] >= 29_998 and out[3] == (1, 0)


def test_oracle(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from rastrel.llm import line_dedup

    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in corpus(3)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "p"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/p/*.parquet'")
    assert sorted(map(str, c.execute(line_dedup.oracle()).fetchall())) == sorted(str(tuple(r)) for r in line_dedup.digest(frame).collect())


def test_plan_is_native_and_empty(spark):
    from rastrel.llm import line_dedup

    frame = line_dedup.digest(spark.createDataFrame([], "doc_id long, text string"))
    assert frame.count() == 0
    assert not any(x in frame._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
