import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("word_bpe_49k.json"))


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (700, 3), (5000, 49407), (3000, 100_000)])
def test_matrix_against_brute_force(n, top):
    from rastrel.llm.wavelet import pack, unpack

    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype(np.uint32) % np.uint32(max(1, min(top, 60 if n == 3000 else top)))
    _, at, before, m = unpack(pack(ids, np.array([7]), np.array([0, n]), 11))
    assert before == 11 and at.tolist() == [0, n] and (m.tokens() == ids).all()
    for i in rng.integers(0, n, 50) if n else []:
        s = int(ids[i])
        where = np.flatnonzero(ids == s)
        assert m.access(int(i)) == s and m.count(s) == len(where) and m.rank(s, int(i)) == int((ids[:i] == s).sum())
        assert m.occurrences(s)[:20] == where[:20].tolist()
        assert m.count(s, 10, 300) == int((ids[10:300] == s).sum())
    assert m.count(123_456) == 0
    with pytest.raises(IndexError):
        m.access(n)


def want(rows, end=2):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(PATH), 0, []
    t.no_truncation(), t.no_padding()
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids))))
        start += len(ids)
    return out


def test_digest(spark, tmp_path):
    from rastrel.llm import wavelet

    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 60)))) for i in rng.sample(range(-50, 900), 200)]
    rows += [(1000, None), (1001, ""), (None, "a null id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(7)
    assert sorted(map(tuple, wavelet.digest(docs, PATH).collect()), key=lambda r: (r[0] is not None, r[0])) == want(rows)
    totals = wavelet.write_shards(docs, PATH, str(tmp_path / "s"), shard_tokens=500).collect()
    assert sum(r.shards for r in totals) > len(totals)


def test_ties_and_files_of_another_attempt(spark, tmp_path):
    """Rows with one id have one order; a file that the successful attempt doesn't list is not read."""
    from rastrel.llm import wavelet

    rows = [(k // 4, f"text {k * 37 % 11} " * (k % 5)) for k in range(60)]
    frames = [spark.createDataFrame(x, "doc_id long, text string").repartition(n) for x, n in ((rows, 3), (rows[::-1], 5))]
    a, b = (sorted(map(tuple, wavelet.digest(f, PATH).collect())) for f in frames)
    assert a == b and len(a) == 60
    folder = str(tmp_path / "s")
    real = wavelet.write_shards

    def twice(docs, path, folder, *more):
        out = real(docs, path, folder, *more).collect()
        wavelet._put(folder, "part-000000000-000000099.rwm", wavelet.pack(np.array([5], np.uint32), np.array([4242]), np.array([0, 1]), 0))
        return spark.createDataFrame(out)

    wavelet.write_shards = twice
    try:
        assert sorted(map(tuple, wavelet.digest(frames[0], PATH, folder).collect())) == a
    finally:
        wavelet.write_shards = real


def test_long_documents_cross_shards(spark, monkeypatch):
    from rastrel.llm import wavelet

    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 50)
    rows = [(1, "word " * 400), (2, "x"), (3, "y " * 90), (4, "")]
    assert sorted(map(tuple, wavelet.digest(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect())) == want(rows)


def test_empty(spark):
    from rastrel.llm import wavelet

    assert wavelet.digest(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
