import re

import pytest

URLS = [
    (1, "http://a.example.org/es/7?x#y"), (2, "HTTPS://Example.ORG/en/12"), (3, "https://example.org/en/2"), (4, "http://org"), (5, "http://org/"),
    (6, "http://x.com/fr/casino"), (7, "http://x.com/FR/casino"), (8, "http://m.casino-win.example.com/en/1"), (9, "http://casinos.example.net/"),
    (10, "http://free-bets.example.net/"), (11, "http://free-free.example.net/free"), (12, None), (13, ""), (14, "no scheme casino"), (15, "a://b://c/d"),
    (16, "http://xorg/"), (17, "http://h?://org/"), (None, "http://É.org/é?casino"), (18, "http://x.net/éfreeébets\u00e9"), (18, "http://x.net/éfreeébets\u00e9"),
    (19, "http://notcom/de/"), (20, "http://u@y.com:80/de/"), (21, "http://x.com/de/1" + "/adult" * 9000), (22, "http://q.net/\nfree bets"), (23, "://org/x"),
]


def brute(url):
    from rastrel.llm import url_filter as u

    m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    low = re.sub("[A-Z]", lambda x: x[0].lower(), url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for rule, verdict in u.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    n = lambda terms: sum(bool(re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)) for t in terms)
    hard, soft = n(u.STRICT), n(u.SOFT)
    return host, path, best[0] if best else None, best[1] if best else "block" if hard or soft >= u.SOFT_LIMIT else "allow", hard, soft


def test_against_brute_force(spark):
    from rastrel.llm import url_filter

    got = url_filter.judge(spark.createDataFrame([(*u, "html", "clash") for u in URLS], "page_id long, url string, html string, host string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *brute(u)) for i, u in URLS), key=str)
    by_id = {r.page_id: r for r in got}
    assert by_id[1].rule == "example.org/es/" and by_id[4].rule is None and by_id[5].rule == "org/" and by_id[11].verdict == "allow" and by_id[10].verdict == "block" and by_id[9].verdict == "allow"


def test_vocabulary_from_a_table(spark):
    """Thousands of weighted terms, against each one's own search."""
    from rastrel.llm import url_filter as u

    rng = __import__("random").Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(4000)]
    rows = [(w.upper() if k % 7 == 0 else w, rng.choice([0.5, 1.0, 1.5, 3.0])) for k, w in enumerate(words)] + [(None, 1.0), ("", 5.0), ("abc", None)]
    weights = u.vocabulary(spark.createDataFrame(rows, "term string, weight double"))
    assert weights == {t: max(w for x, w in rows if x and x.lower() == t and w is not None) for t in {x.lower() for x, w in rows if x and w is not None}}
    urls = ["http://h.example/" + "".join(rng.choice(["/", "-", "a", "b", "c", "cc", "Z"]) for _ in range(30)) for _ in range(200)]
    got = {r.page_id: r for r in u.judge(spark.createDataFrame([*enumerate(urls)], "page_id long, url string"), rules=(), weights=weights, limit=3.0).collect()}
    for k, url in enumerate(urls):
        low = url.lower()
        whole = {t for t in weights if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)}
        hard = {t for t in whole if weights[t] >= 3.0}
        assert (got[k].n_strict, got[k].n_soft) == (len(hard), len(whole - hard))
        assert got[k].verdict == ("block" if hard or sum(weights[t] for t in whole) >= 3.0 else "allow")


def test_oracle(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from rastrel.llm import url_filter

    frame = spark.createDataFrame(URLS, "page_id long, url string")
    frame.write.parquet(str(tmp_path / "p"))
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/p/*.parquet'")
    assert sorted(map(str, c.execute(url_filter.oracle()).fetchall())) == sorted(str(tuple(r)) for r in url_filter.judge(frame).collect())


def test_empty(spark):
    from rastrel.llm import url_filter

    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
