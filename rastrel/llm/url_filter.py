"""URL filter: host and path rules, else a weighted vocabulary found with an Aho-Corasick automaton.

The automaton reads each URL once, with A-Z lower-cased. A hit counts only if
the characters beside it are no ASCII letters or digits. Terms have weights: the
limit or more is strict, less is soft. One strict term, or distinct soft ones
whose weights reach the limit, reject. A vocabulary is a list of terms and
weights or a table of them (:func:`vocabulary`, ``TERMS`` at most); the
automaton is built once a task, whatever its size. A rule fits its host and the hosts
below it if the URL's path starts with the rule's; the longest rule decides
(then the first in code point order), and where one fits the vocabulary has no
say. One pass, no shuffle.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
so no rule fits it; the vocabulary still reads it (a null has no hits and is
allowed); a null ``page_id`` is carried; repeated rows are judged alike; other
columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rules, and the terms by weight.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
STRICT = ("casino", "porn", "viagra", "xxx", "escort", "warez", "spam")
SOFT = ("adult", "ads", "bet", "bets", "cheap", "farm", "free", "pills", "poker", "sex", "slots", "track", "win")
SOFT_LIMIT = 2
#: Terms that a vocabulary has at most; it is sent to each task.
TERMS = 1_000_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def parts(url: str | None) -> tuple[str, str]:
    """Host, lower-cased, and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    return host.translate(_LOWER), rest[: min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))]


class Rules:
    """Rules by host, so that a URL asks only for its own host and those above it."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[int, str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((-len(rule), rule, slash + path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        fits, rest = [], host
        while rest:
            fits += [x for x in self.by_host.get(rest, ()) if path.startswith(x[2])]
            rest = rest.partition(".")[2]
        return min(fits)[1::2] if fits else None


def vocabulary(table: DataFrame, term: str = "term", weight: str = "weight") -> dict[str, float]:
    """Weights by term from a table; A-Z is lower-cased, the greatest weight of a term counts, nulls and empty terms don't."""
    rows = table.select(F.col(term).cast("string").alias("t"), F.col(weight).cast("double").alias("w")).where("t <> '' and w is not null").limit(TERMS + 1).collect()
    if len(rows) > TERMS:
        raise ValueError(f"a vocabulary has {TERMS} terms at most")
    out: dict[str, float] = {}
    for t, w in rows:
        t = t.translate(_LOWER)
        out[t] = max(w, out.get(t, w))
    return out


class Vocabulary:
    """The automaton of weighted terms."""

    def __init__(self, weights: dict[str, float], limit: float):
        import ahocorasick

        self.limit, self.found = limit, ahocorasick.Automaton() if weights else None
        for term, weight in weights.items():
            self.found.add_word(term, (term, weight))
        if weights:
            self.found.make_automaton()

    def hits(self, url: str) -> tuple[dict[str, float], dict[str, float]]:
        """The distinct strict and soft terms that stand between boundaries, with their weights."""
        text, strict, soft = url.translate(_LOWER), {}, {}
        for last, (term, weight) in self.found.iter(text) if self.found else ():
            first = last - len(term)
            if (first < 0 or text[first] not in _WORD) and (last + 1 == len(text) or text[last + 1] not in _WORD):
                (strict if weight >= self.limit else soft)[term] = weight
        return strict, soft

    def rejects(self, strict: dict[str, float], soft: dict[str, float]) -> bool:
        return bool(strict) or (bool(soft) and sum(soft.values()) >= self.limit)


#: The terms above with their weights.
WEIGHTS = dict.fromkeys(SOFT, 1.0) | dict.fromkeys(STRICT, float(SOFT_LIMIT))


def judge(pages: DataFrame, rules=RULES, weights: dict[str, float] | None = None, limit: float = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict and n_soft (distinct terms) of every page. weights: by lower-case term."""
    shared = pages.sparkSession.sparkContext.broadcast(WEIGHTS if weights is None else weights)

    def work(batches):
        known, terms = Rules(rules), Vocabulary(shared.value, limit)
        for b in batches:
            out = []
            for url in b.column("url").to_pylist():
                host, path = parts(url)
                rule = known.find(host, path)
                hard, easy = terms.hits(url or "")
                verdict = rule[1] if rule else "block" if terms.rejects(hard, easy) else "allow"
                out.append((host, path, rule[0] if rule else None, verdict, len(hard), len(easy)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, pa.string()) for c in cols[:4]), *(pa.array(c, pa.int64()) for c in cols[4:])], names=["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(work, "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long")


def oracle() -> str:
    """The same in SQL, with a regular expression for each term in place of the automaton."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    count = lambda terms: " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS BIGINT)" for t in terms)
    fits = []
    for rule, verdict in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        host, slash, path = rule.partition("/")
        fits.append((f"(host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '{slash}{path}')", rule, verdict))
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " ELSE NULL END"
    return f"""
WITH cut AS (SELECT page_id, {lower.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, {lower.format("coalesce(url, '')")} AS low FROM pages),
found AS (SELECT *, {case(1)} AS rule, {case(2)} AS said, {count(STRICT)} AS n_strict, {count(SOFT)} AS n_soft FROM cut)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN n_strict > 0 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM found"""
