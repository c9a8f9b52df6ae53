"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Statistics are Spark columns over the whole text. Small trees, grown on
bootstrap samples and random statistics of the labelled rows, give their paths
as rules (``statistic <= bound and ...``); a lasso logistic regression keeps a
few of them; the sum of their weights is compiled to one Spark column. Scoring
is a projection without Python or a shuffle.

Only ``sample`` labelled rows at most (those with the smallest hash of
``doc_id``) reach the driver, with their statistics alone; rows whose
crc32(doc_id as text) mod 4 is 2 are held out and never learnt from. Labels,
lang, source and doc_id are not inputs.

Defined cases: a null text counts as empty, and an empty one has statistics of
zero and a score; without labels of both kinds the score is the share of ones
(0.5 without any); null labels are not learnt from; a null ``doc_id`` is scored
and not held out; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are learnt from at most; score from which a text is good.
SAMPLE, CUT = 20_000, 0.7
#: Trees, their depth, bounds tried for a statistic, least rows of a leaf, rules kept for the lasso at most.
TREES, DEPTH, BINS, LEAST, RULES = 80, 3, 24, 12, 250


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, as columns."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.length(whole)
    words = F.split(whole, r"[ \t\n\x0B\f\r]+", -1)
    lines = F.split(whole, "\n")
    less = lambda marks: chars - F.length(F.regexp_replace(whole, f"[{marks}]+", ""))
    share = lambda n, of: F.when(of > 0, n / of).otherwise(F.lit(0.0))
    letters = chars - F.length(F.regexp_replace(whole, r"\p{L}+", ""))
    upper = chars - F.length(F.regexp_replace(whole, r"\p{Lu}+", ""))
    long_lines = F.size(F.filter(lines, lambda x: F.length(x) > 0))
    return {
        "log_chars": F.log1p(chars.cast("double")),
        "letters": share(letters, chars),
        "upper": share(upper, chars),
        "digits": share(less("0-9"), chars),
        "symbols": share(less(r"#$%&*+=<>^~_{}\[\]\\/@"), chars),
        "bars": share(less("|"), chars),
        "bangs": share(less("!"), chars),
        "stops": share(less(".?"), chars),
        "commas": share(less(",;:"), chars),
        "spaces": share(less(r" \t"), chars),
        "word_length": share(letters, F.size(words)),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "log_words": F.log1p(F.size(words).cast("double")),
        "line_length": share(chars, F.size(lines)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "full_lines": share(long_lines, F.size(lines)),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction: each statistic lies above and at most at its bounds."""

    bounds: tuple[tuple[str, float, float], ...]
    weight: float = 0.0

    def column(self, column=F.col) -> Column:
        out = F.lit(True)
        for name, low, high in self.bounds:
            if low > -np.inf:
                out = out & (column(name) > F.lit(float(low)))
            if high < np.inf:
                out = out & (column(name) <= F.lit(float(high)))
        return out


@dataclass(frozen=True)
class Model:
    base: float
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def column(self, column=F.col) -> Column:
        """The score, from columns of statistics."""
        total = F.lit(float(self.base))
        for r in self.rules:
            total = total + F.when(r.column(column), F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(x: np.ndarray, y: np.ndarray, rows: np.ndarray, bins: list[np.ndarray], coded: np.ndarray, rng) -> list[dict[int, tuple[float, float]]]:
    """The paths to all nodes but the root, as bounds by statistic."""
    out: list[dict[int, tuple[float, float]]] = []

    def grow(rows: np.ndarray, path: dict[int, tuple[float, float]], depth: int) -> None:
        if path:
            out.append(path)
        good = y[rows].sum()
        if depth == DEPTH or len(rows) < 2 * LEAST or good in (0, len(rows)):
            return
        best = (1e-9, -1, 0)
        for f in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
            n = np.cumsum(np.bincount(coded[rows, f], minlength=len(bins[f]) + 1))[:-1]
            g = np.cumsum(np.bincount(coded[rows, f], weights=y[rows], minlength=len(bins[f]) + 1))[:-1]
            m, h = len(rows) - n, good - g
            ok = (n >= LEAST) & (m >= LEAST)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, g * g / n + h * h / m - good * good / len(rows), -1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], int(f), k)
        _, f, k = best
        if f < 0:
            return
        low, high = path.get(f, (-np.inf, np.inf))
        bound, left = float(bins[f][k]), coded[rows, f] <= k
        grow(rows[left], path | {f: (low, min(high, bound))}, depth + 1)
        grow(rows[~left], path | {f: (max(low, bound), high)}, depth + 1)

    grow(rows, {}, 0)
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, m = z.shape
    rate = min(1.0, y.mean())
    grown = np.concatenate([np.ones((n, 1), np.float32), z], axis=1)
    v = np.ones(m + 1, np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = grown.T @ (grown @ v)
        size = float(np.linalg.norm(v))
        v /= size
    step = 4.0 * n / (size * 1.05)
    theta = np.concatenate([[float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))], np.zeros(m)])
    ahead, t = theta.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(grown @ ahead.astype(np.float32), -30, 30)))
        new = ahead - step * (grown.T @ (p - y).astype(np.float32)).astype(np.float64) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, theta, t = new + (t - 1) / t2 * (new - theta), new, t2
    return float(theta[0]), theta[1:]


def fit(names: list[str], x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Learns rules and weights from statistics (rows by names) and 0/1 labels."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(float(np.log(share / (1 - share))))
    order = np.lexsort((y, *x.T))  # the rows' order doesn't count
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    rng = np.random.default_rng(seed)
    bins = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 2)[1:-1])) for f in range(x.shape[1])]
    coded = np.stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bins)], axis=1)
    # few bad rows must still be told apart: half of a tree's rows are of either label
    kinds = [np.flatnonzero(y == k) for k in (0, 1)]
    paths: dict[tuple, None] = {}
    for _ in range(TREES):
        rows = np.concatenate([rng.choice(k, max(LEAST, min(len(y) // 2, 2000)), replace=True) for k in kinds])
        for path in _tree(x, y, rows, bins, coded, rng):
            paths[tuple(sorted((f, *b) for f, b in path.items()))] = None
    masks, kept, seen, lifts = [], [], set(), []
    for path in paths:
        m = np.ones(len(y), bool)
        for f, low, high in path:
            m &= (x[:, f] > low) & (x[:, f] <= high)
        n, key = int(m.sum()), hash(m.tobytes())
        if LEAST <= n <= len(y) - LEAST and key not in seen:
            seen.add(key)
            kept.append(path)
            masks.append(np.packbits(m))
            lifts.append(abs(y[m].sum() - n * y.mean()) / np.sqrt(n * (len(y) - n)))
    if not kept:
        return fit(names, x[:0], y[:0])
    top = np.argsort(-np.array(lifts), kind="stable")[:RULES]
    kept = [kept[k] for k in top]
    z = np.stack([np.unpackbits(masks[k], count=len(y)) for k in top], axis=1).astype(np.float32)
    part = np.arange(len(y)) % 5 == rng.integers(5)
    scores = []
    for penalty in (0.02, 0.006, 0.002, 0.0006):
        b, w = _lasso(z[~part], y[~part], penalty)
        p = 1 / (1 + np.exp(-np.clip(b + z[part] @ w, -30, 30)))
        scores.append((float(-(y[part] * np.log(p + 1e-9) + (1 - y[part]) * np.log(1 - p + 1e-9)).mean()), penalty))
    b, w = _lasso(z, y, min(scores)[1])
    rules = tuple(Rule(tuple((names[f], low, high) for f, low, high in kept[k]), float(w[k])) for k in np.flatnonzero(np.abs(w) > 1e-4))
    return Model(b, rules)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns ``label`` from a bounded sample of labelled rows that are not held out."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    stats = statistics(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")
    table = rows.select(F.col("y").cast("double").alias("y"), *(c.cast("double").alias(k) for k, c in stats.items())).toArrow()
    columns = [table.column(k).to_numpy() for k in ("y", *stats)]
    return fit(list(stats), np.stack(columns[1:], axis=1), columns[0])


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score.

    The score leaves a generator, so that a later filter on it isn't pushed
    down, where each rule would compute its statistics again.
    """
    mark = "__stat_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    names = statistics(F.col("text"))
    stats = docs.withColumns({mark + k: c.cast("double") for k, c in names.items()})
    return stats.select(*(F.col(f"`{c}`") for c in docs.columns if c != out), F.inline(F.array(F.struct(model.column(lambda k: F.col(mark + k)).alias(out)))))


def judge(docs: DataFrame, labels: DataFrame, cut: float = CUT, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, sample=sample)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(plain, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
