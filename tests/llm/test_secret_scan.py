import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def forest():
    from rastrel.llm import secret_scan as s

    return s.train(s.labelled(), PATH)


def test_held_out_accuracy(forest):
    from rastrel.llm import secret_scan as s

    rows = s.labelled(1500, seed=99)
    x = np.array([s.features(t, a, b, s.lexicon(PATH)) for t, a, b, _ in rows])
    y = np.array([r[3] for r in rows])
    got = forest.score(x) >= s.CUT
    assert got[y == 1].mean() > 0.97 and (~got[y == 0]).mean() > 0.97


def test_scan_finds_and_leaves(spark, forest):
    from rastrel.llm import secret_scan as s

    hexes = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [
        (1, f'Thstorti token = "{hexes}" thhantou'), (2, "see the usual words and nothing else"), (3, "card 9807915762804490 and a.55@mail4.example.com"), (4, None), (5, ""),
        (6, "x " * 30_000 + f"password: {hexes}" + " y" * 30_000), (7, f'TOKEN = "{hexes.upper()}"!! TOKEN = "{hexes.upper()}"'), (None, f"secret={hexes}"), (8, "commit " + hexes), (1, f'Thstorti token = "{hexes}" thhantou'),
    ]
    got = s.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, findings int"), forest, PATH).collect()
    by_id = {r.doc_id: r for r in got}
    texts = dict(rows)
    assert len(got) == len(rows)
    for i in (1, 6, 7, None):
        assert by_id[i].findings and all(texts[i][f.first : f.last].lower() == hexes for f in by_id[i].findings)
    assert len(by_id[7].findings) == 2
    assert not any(by_id[i].findings for i in (2, 3, 4, 5, 8)) and by_id[3].n_candidates > 0


def test_table_of_findings_and_empty(spark, forest):
    from rastrel.llm import secret_scan as s

    rows = [*s.labelled(300), (None, 0, 1, 1), ("ab", 5, 9, 1)]
    small = s.train(spark.createDataFrame(rows, "text string, first int, last int, label int"), PATH)
    assert len(small.trees) == s.TREES
    assert s.digest(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    assert s.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0, 0]


def test_long_values(spark, forest):
    """The span of a value of over 200 characters is whole; what a long address holds is found where the address is no secret."""
    import random

    from rastrel.llm import secret_scan as s

    rng = random.Random(4)
    pick = lambda n, more="": "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + more) for _ in range(n))
    values = {n: pick(n - 1, "%!") + "7" for n in (150, 201, 260, 1000)}
    key = "ghp_" + pick(36)
    address = "https://www.example.com/" + "the/river/%20/" * 20 + "?token=" + key
    rows = [(n, f'password = "{x}" and more') for n, x in values.items()] + [(0, f"auth_url={address} and more")]
    got = {r.doc_id: r.findings for r in s.scan(spark.createDataFrame(rows, "doc_id long, text string"), forest, PATH).collect()}
    texts = dict(rows)
    assert {n: [texts[n][f.first : f.last] for f in got[n]] for n in values} == {n: [x] for n, x in values.items()}
    assert [texts[0][f.first : f.last] for f in got[0]] == [key]
