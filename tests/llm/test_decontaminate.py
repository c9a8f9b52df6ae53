import itertools
import random
import re

import pytest


def cut(t):
    return [w for w in re.split(r"[^a-zäöüé0-9]+", (t or "").lower()) if w]


def brute(docs, items, window=13, misses=2):
    out = []
    for i, t in docs:
        w, found = cut(t), []
        for b, x in items:
            v = cut(x)
            if b is not None and any(
                sum(w[p + k] == v[q + k] for k in range(window)) >= window - misses for p in range(len(w) - window + 1) for q in range(len(v) - window + 1)
            ):
                found.append(b)
            elif b is not None and 0 < len(v) < window and any(w[p : p + len(v)] == v for p in range(len(w) - len(v) + 1)):
                found.append(b)
        found = sorted(set(found))
        out.append((i, int(bool(found)), len(found), ",".join(map(str, found))))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "und", "é"]) if rng.random() < 0.3 else "".join(rng.choice("aeinorstü") for _ in range(rng.randint(2, 6)))
    items = [(k, [word() for _ in range(rng.choice([5, 12, 13, 20, 40]))]) for k in range(12)]
    rows = [None, "", "...", "the of"]
    for _ in range(110):
        x = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            p = list(rng.choice(items)[1])
            a = rng.randint(0, len(p) // 3)
            p = p[a : len(p) - rng.randint(0, len(p) // 3)]
            for _ in range(rng.choice([0, 1, 2, 2, 3, 6])):
                p[rng.randrange(len(p))] = word()
            at = rng.randint(0, len(x))
            x = x[:at] + p + x[at:]
        rows.append((rng.choice([" ", "&&& ", "\n"])).join(x).title())
    docs = [*enumerate(rows), (3, "the of"), (None, rows[10]), (500, " ".join(items[8][1]) * 3)]
    return docs, [(k, " ".join(v)) for k, v in items] + [(3, " ".join(items[3][1])), (None, " ".join(items[4][1])), (99, None), (98, "")]


def frames(spark, seed):
    docs, items = corpus(seed)
    return docs, items, spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, seed int").repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed,broadcast", [(1, 64 << 20), (2, 64 << 20), (1, 0)])
def test_against_brute_force(spark, seed, broadcast, monkeypatch):
    from rastrel.llm import decontaminate as d

    docs, items, frame, bench = frames(spark, seed)
    got = d.hits(d._keyed(frame, "text"), bench, d._P + "key", broadcast=broadcast)
    assert got.count() == d.hits(d._keyed(frame, "text"), bench, d._P + "key").count()
    want = brute(docs, items)
    assert sorted(map(tuple, d.digest(frame, bench).collect()), key=str) == want
    assert 10 < sum(w[1] for w in want) < 90
    left = d.clean(frame, bench)
    assert left.columns == frame.columns and left.count() == sum(not w[1] for w in want)


def test_masks_leave_no_place_for_two_misses():
    from rastrel.llm import decontaminate as d

    for miss in itertools.combinations(range(d.WINDOW), d.MISSES):
        assert any(all(c == "0" or a + k not in miss for k, c in enumerate(m)) for m in d.MASKS for a in range(d.WINDOW - len(m) + 1))


def test_oracle(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from rastrel.llm import decontaminate as d

    _, _, frame, bench = frames(spark, 3)
    frame.write.parquet(str(tmp_path / "d"))
    bench.write.parquet(str(tmp_path / "b"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    c.execute(f"create view benchmark as select * from '{tmp_path}/b/*.parquet'")
    assert sorted(map(str, c.execute(d.oracle()).fetchall())) == sorted(str(tuple(r)) for r in d.digest(frame, bench).collect())


def test_native_and_empty(spark):
    from rastrel.llm import decontaminate as d

    _, _, frame, bench = frames(spark, 1)
    assert d.digest(frame.limit(0), bench).count() == 0 and d.digest(frame, bench.limit(0)).agg({"contaminated": "sum"}).first()[0] == 0
    assert not any(x in d.digest(frame, bench)._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


def test_long_items_are_bounded(spark):
    """What is broadcast of an item of 100,000 words are its seeds, each with the words around it; the bound holds."""
    from rastrel.llm import decontaminate as d

    rng = random.Random(4)
    item = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(100_000)]
    assert 100_000 * len(d.MASKS) * d.SEED_BYTES < d.BROADCAST
    own = [f"own{k}" for k in range(30)]
    docs = [(1, " ".join(own + item[70_000:70_020])), (2, " ".join(own + item[5:15])), (3, " ".join(item[99_980:99_990] + ["x"] + item[99_991:]))]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    for limit in (d.BROADCAST, 0):
        got = d.hits(d._keyed(frame, "text"), bench, d._P + "key", broadcast=limit)
        assert sorted(r[0].split(":")[0] for r in got.collect()) == ["1", "3"]


def test_very_long_text(spark):
    from rastrel.llm import decontaminate as d

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200_000)]
    bench = spark.createDataFrame([(1, " ".join(words[150_000:150_013])), (2, "nothing of this stands in any text at all here today my dear friend")], "item_id long, text string")
    got = d.digest(spark.createDataFrame([(9, " ".join(words))], "doc_id long, text string"), bench).collect()
    assert [tuple(r) for r in got] == [(9, 1, 1, "1")]
