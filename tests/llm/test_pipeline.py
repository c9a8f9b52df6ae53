"""The stages against brute-force versions, on a small corpus with planted cases."""

import hashlib
import random
import zlib

import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8)))
    line = lambda: " ".join(word() for _ in range(rng.randint(4, 12)))
    passage = [line() for _ in range(12)]
    item = " ".join(word() for _ in range(30))
    docs, labels = [], []

    def add(text, quality=None):
        docs.append((len(docs), text, "en", "s", len(text or "")))
        if quality is not None:
            labels.append((len(docs) - 1, quality, 0))

    for k in range(240):
        x = [line() for _ in range(rng.randint(4, 14))]
        if k % 4 == 0:
            add("\n".join(" ".join(w + rng.choice(["$$$", "###"]) for w in y.split()) for y in x), 0)
        else:
            if k % 10 == 1:
                x = x[:2] + passage + x[2:]
            if k % 24 == 3:
                x = [*x[:1], item, *x[1:]]
            add("\n".join(x), 1 if k % 3 else None)
            if k % 8 == 5:  # a near copy
                w = " ".join(x).split(" ")
                w[len(w) // 2] = "other"
                add(" ".join(w), None)
    add(None), add(""), add(docs[1][1])
    return docs, labels, [(0, item)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels, items = corpus()
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_run_against_brute_force(spark, folder):
    from test_decontaminate import brute as leaks
    from test_line_dedup import brute as lines
    from test_ngram_join import brute as near
    from tokenizers import Tokenizer

    from rastrel.llm import quality_rules
    from rastrel.llm.queries import tokenizer_path

    docs, labels, items = corpus()
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_rules.train(frame, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r.doc_id for r in quality_rules.score(frame, model).collect() if r.score >= quality_rules.CUT}
    told = {i: q for i, q, _ in labels}
    assert sum((i in good) == bool(q) for i, q in told.items() if zlib.crc32(str(i).encode()) % 4 == 2) > 0.9 * sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in told)
    rows = [(i, t) for i, t, *_ in docs if i in good]
    rows = [(i, t) for i, t, n, gone, _ in lines(rows) if gone < n]
    first = {i for i, n, c in near(rows) if i == c or not n}
    rows = [r for r in rows if r[0] in first]
    bad = {i for i, hit, *_ in leaks(rows, items) if hit}
    assert len(first) < len(good) and bad
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation(), t.no_padding()
    want = {}
    for i, x in rows:
        if i not in bad:
            ids = t.encode(x or "", add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = pipeline.run(spark, folder).collect()
    assert {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in got} == want and len(got) == len(want)
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and len(r.ids) == 4 * r.n_tokens for r in got)


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "lines", "near_copies", "leaks", "tokens"]
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0
        if name != "tokens":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_stages_take_clashing_columns(spark, folder):
    """Columns named as those that the operators use inside stay as they are."""
    from pyspark.sql import functions as F

    names = ["__score", "__stat_letters", "__join_key", "__decon_key", "row", "n_lines", "n_removed", "n_chunks", "new", "least", "root", "text_key", "score", "lines", "gone", "d", "i"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = docs.select("*", *(F.concat_ws("-", F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    for name, stage in pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, folder), stage(spark, more, folder)
        assert out.columns == more.columns, name
        rows = out.collect()
        assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((r.doc_id, r.text or "") for r in plain.collect()), name
        assert all(r[n] == f"{n}-{r.doc_id}" for r in rows for n in names), name
    assert pipeline.STAGES[-1][1](spark, more, folder).count() == docs.count()


def test_near_copies_of_texts_with_common_phrases(spark, folder, monkeypatch):
    """Texts that only share phrases are no block that is dealt to parts, each pair of which is compared."""
    from test_ngram_join import brute

    from rastrel.llm import ngram_join

    rng = random.Random(13)
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    phrases = [own(5) for _ in range(40)]
    rows = []
    for k in range(300):
        x = [w for p in rng.sample(phrases, 4) for w in [*own(15), *p]]
        rows.append((len(rows), " ".join(x)))
        if k % 10 == 0:
            x[40] = "other"
            rows.append((len(rows), " ".join(x)))
    monkeypatch.setattr(ngram_join, "CELLS", 64)
    monkeypatch.setattr(ngram_join, "PAIRS", 4)
    monkeypatch.setattr(ngram_join, "PART", 3_000)
    monkeypatch.setattr(ngram_join, "SHARE", 1, raising=False)
    crossed = []
    whole = ngram_join._crossed
    monkeypatch.setattr(ngram_join, "_crossed", lambda *a: crossed.append(1) or whole(*a))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in pipeline.near_copies(spark, docs, folder).collect())
    assert got == [i for i, _, c in sorted(brute(rows)) if i == c] and len(got) == 300
    assert not crossed


def test_near_copies_shuffles_few_texts(spark, folder, tmp_path):
    """Only texts that may have a near copy are shuffled, and what all texts' shingles need is less than the texts."""
    from test_ngram_join import brute

    rng = random.Random(14)
    rows = []
    for k in range(200):
        x = [f"o{rng.randrange(10**12):x}" for _ in range(rng.randint(500, 1500))]
        rows.append((len(rows), " ".join(x)))
        if k % 20 == 0:
            x[100] = "other"
            rows.append((len(rows), " ".join(x)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 1, ""), (len(rows) + 2, rows[3][1]), (None, rows[4][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/docs.parquet")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = pipeline.near_copies(spark, spark.read.parquet(f"{tmp_path}/docs.parquet"), folder).collect()
    shuffled = written() - before
    known = [r for r in rows if r[0] is not None]
    assert sorted(r.doc_id for r in got) == sorted({i for i, n, c in brute(known) if i == c or not n})
    assert {(r.doc_id, r.text) for r in got} <= set(rows)
    assert 0 < shuffled < sum(len(t or "") for _, t in rows)
