"""Exact top-k inner products by dual-tree search over cover trees.

Rows are dealt to the nearest of a few pivots (a farthest-point net of a
bounded sample, which only shapes the blocks) and, by their ids, to blocks of
about ``block_rows`` rows. A block becomes a cover tree once; its queries are
groups with trees of their own. A pair of nodes is left out if the most that
the centres, their covering radii and norms allow,

    <q, c> + |q| r_c + |c| r_q + r_q r_c,

is below the worst k-th score of the query node's rows. Leaves are multiplied
exactly.

A group of queries meets its home block first, which gives it k-th scores.
Then it goes down: to the pivots (at most ``PIVOTS``, the only thing that is
broadcast) whose balls may hold better rows, to all blocks of these, and to
their trees' nodes. No list of blocks, rows or groups leaves the executors.
The k best of all blocks are merged by a ranked window, which keeps k rows of
a query in each task before anything is shuffled.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do rows without an id; an empty vector scores 0 with all; shorter
vectors count as if zeros followed; components of any finite size are exact,
and a score beyond 64 bits is ranked exactly and given as the nearest long;
rows with the query's id are its own; rows with equal ids are ranked each;
fewer than k rows are all given; an empty table gives none.
"""

from __future__ import annotations

import heapq
import pickle
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import saved
from .text import tasks

#: Rows that a block holds at most about, and at least where the table is small; queries that go together.
BLOCK, SMALL, GROUP = 8192, 1024, 1024
#: Groups of queries that share a task and its block.
CHUNK = 16
#: Rows of the sample that pivots come from, and pivots at most.
SAMPLE, PIVOTS = 2048, 64
#: Radii of neighbouring levels of a tree differ by this factor; centres of a block's and of a query group's tree at most.
BASE, CENTRES, QUERY_CENTRES = 1.3, 256, 32
#: Rows for each centre: smaller leaves cost more to visit than to multiply.
LEAF = 32
#: Beyond this, sums of products of doubles may not be whole.
_EXACT, _LONG = 2.0**53, 2**63 - 1


def components_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and the components of these, with zeros up to one width."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64) if len(flat) else np.zeros(0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good = column.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(owner[~np.isfinite(values)], minlength=len(sizes)) == 0)  # nulls come as NaN
    out = np.zeros((int(good.sum()), int(sizes[good].max()) if good.any() else 0))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = good[owner]
    out[(np.cumsum(good) - 1)[owner[keep]], place[keep]] = values[keep]
    return good, out


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles; infinite where only the scaled value has none."""
    with np.errstate(over="ignore"):
        return np.floor(scale * values)


def products(a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
    """Exact inner products of scaled rows: in doubles where they hold every sum, then in 64 bits, then in Python's integers."""
    x, y = whole(a, scale), whole(b, scale)
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    with np.errstate(over="ignore"):
        most = float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1]
    if most < _EXACT:
        return (x @ y.T).astype(np.int64)
    if most < 2.0**62:
        return x.astype(np.int64) @ y.astype(np.int64).T
    factor = Fraction(scale)
    p, q = ([[int(w) if np.isfinite(w) else int(factor * Fraction(v)) for w, v in zip(ws, vs, strict=True)] for ws, vs in zip(z.tolist(), c.tolist(), strict=True)] for z, c in ((x, a), (y, b)))
    out = np.empty((len(p), len(q)), object)
    for i, u in enumerate(p):
        for j, v in enumerate(q):
            out[i, j] = sum(s * t for s, t in zip(u, v, strict=True))
    return out


class CoverTree:
    """A cover tree of rows, down to the level with at most ``most`` centres.

    Centres come in farthest-first order, so those with an insertion distance
    above ``BASE**l`` are level l's: levels are nested, a level's centres are
    farther apart than ``BASE**l`` (separation), and every row and every centre
    of the level below is within ``BASE**l`` of one of them (covering). A node
    holds its centre, level, the measured radius of all its rows (which is what
    pruning uses), and children, or, at the last level, rows; rows of a node
    are adjacent in ``order``.
    """

    def __init__(self, points: np.ndarray, most: int):
        self.first, self.last, self.centre, self.level, self.radius, self.kids = [], [], [], [], [], []
        n = len(points)
        with np.errstate(over="ignore", invalid="ignore"):
            squares = (points**2).sum(1)
        self.sound = bool(np.isfinite(squares).all()) and (not n or float(squares.max()) < 1e300)
        if not self.sound:  # distances have no double: one leaf, which is never left out
            self._leaf(0, np.arange(n), np.inf)
            self.order = np.arange(n)
            self._finish(points)
            return

        def far(k: int) -> np.ndarray:
            return np.sqrt(np.maximum(0, squares - 2 * (points @ points[k]) + squares[k]))

        # rounding makes distances of equal rows a little more than nothing
        least = 1e-6 * (1 + float(np.sqrt(squares.max())))
        centres = [int(np.argmin(np.sqrt(np.maximum(0, squares - 2 * (points @ points.mean(0))))))]
        inserted, near = [np.inf], far(centres[0])
        rest = float(near.max())
        while len(centres) < most and rest > least:
            centres.append(int(np.argmax(near)))
            inserted.append(rest)
            near = np.minimum(near, far(centres[-1]))
            rest = float(near.max())
        top = int(np.ceil(np.log(inserted[1]) / np.log(BASE))) if len(centres) > 1 else 0
        lowest = int(np.ceil(np.log(rest) / np.log(BASE))) if rest > least else int(np.ceil(np.log(inserted[-1]) / np.log(BASE))) - 1 if len(centres) > 1 else 0
        kept = sum(d > BASE**lowest for d in inserted)
        self.centres = np.array(centres[:kept])
        self.levels = np.array([top, *(int(np.ceil(np.log(d) / np.log(BASE))) - 1 for d in inserted[1:kept])])  # the highest that has the centre
        apart = np.sqrt(np.maximum(0, squares[:, None] - 2 * (points @ points[self.centres].T) + squares[self.centres][None, :]))
        owner = np.argmin(apart, axis=1)
        owner[self.centres] = np.arange(kept)
        kids: dict[int, dict[int, list[int]]] = {}
        for k in range(1, kept):
            above = int(np.searchsorted(-self.levels, -self.levels[k], side="left")) or 1
            parent = int(np.argmin(apart[self.centres[k], :above]))
            kids.setdefault(parent, {}).setdefault(int(self.levels[k]) + 1, []).append(k)
        by = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=kept))
        order: list[np.ndarray] = []

        def build(k: int, level: int, at: int) -> tuple[int, int]:
            """The node of centre k whose children are of the levels below this one; its number and its rows' end."""
            steps = [x for x in kids.get(k, ()) if x <= level]
            if not steps:
                rows = by[(ends[k - 1] if k else 0) : ends[k]]
                order.append(rows)
                return self._leaf(at, rows, float(apart[rows, k].max()) if len(rows) else 0.0, centre=int(self.centres[k]), level=lowest), at + len(rows)
            step = max(steps)
            node = self._leaf(at, np.zeros(0, np.int64), 0.0, centre=int(self.centres[k]), level=step)
            end, children, start = at, [], len(order)
            for c, below in ((k, step - 1), *((c, int(self.levels[c])) for c in kids[k][step])):
                child, end = build(c, below, end)
                children.append(child)
            self.last[node], self.kids[node] = end, children
            self.radius[node] = float(apart[np.concatenate(order[start:]), k].max())
            return node, end

        build(0, top, 0)
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self._finish(points)

    def _leaf(self, at: int, rows: np.ndarray, radius: float, centre: int = 0, level: int = 0) -> int:
        for name, value in (("first", at), ("last", at + len(rows)), ("centre", centre), ("level", level), ("radius", radius), ("kids", [])):
            getattr(self, name).append(value)
        return len(self.first) - 1

    def _finish(self, points: np.ndarray) -> None:
        self.points = points[self.centre] if len(points) else np.zeros((len(self.centre), points.shape[1]))
        self.radius = np.array(self.radius) * (1 + 1e-9) + 1e-6
        with np.errstate(over="ignore"):
            self.norm = np.sqrt((self.points**2).sum(1))


class Side:
    """Rows of a block or a group of queries with their tree, and its packed form."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, scale: float, centres: int):
        self.tree = CoverTree(whole(values, scale), min(centres, len(values) // LEAF + 1))
        self.ids, self.values = ids[self.tree.order], values[self.tree.order]

    def pack(self) -> bytes:
        small = self.values.astype(np.float32)
        return pickle.dumps((self.ids, small if (small == self.values).all() else self.values, self.tree), protocol=5)

    @staticmethod
    def unpack(blob: bytes) -> Side:
        out = Side.__new__(Side)
        out.ids, values, out.tree = pickle.loads(blob)
        out.values = values.astype(np.float64)
        return out


class Best:
    """The k best of each query: higher scores, then smaller ids. ``size`` says how many places of each are filled."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.k = ids, k
        self.scores = np.zeros((len(ids), k), np.int64)
        self.found = np.zeros((len(ids), k), np.int64)
        self.size = np.zeros(len(ids), np.int64)
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.astype(np.float64)
        self.worst = self.floor.copy()

    def take(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: of these candidates (columns) for these queries (rows)."""
        if scores.dtype == object and self.scores.dtype != object:
            self.scores = self.scores.astype(object)
        near = _double(scores)
        low = self.worst[rows]
        if scores.shape[1] > 2 * self.k + 2:  # what even this leaf has k better ones for; one more, as a query may meet itself
            low = np.maximum(low, np.partition(near, -self.k - 1, axis=1)[:, -self.k - 1])
        hit = (near >= np.where(np.isfinite(low), low - 1e-9 * (1 + np.abs(low)), low)[:, None]) & (ids[None, :] != self.ids[rows][:, None])
        r, c = np.nonzero(hit)
        if not len(r):
            return
        some = np.unique(r)
        had = np.arange(self.k)[None, :] < self.size[rows[some]][:, None]
        who = np.concatenate([np.repeat(some, had.sum(1)), r])
        s = np.concatenate([self.scores[rows[some]][had], scores[r, c]])
        i = np.concatenate([self.found[rows[some]][had], ids[c]])
        down = -(np.unique(s, return_inverse=True)[1] if s.dtype == object else s)
        order = np.lexsort((i, down, who))
        who, s, i = who[order], s[order], i[order]
        new = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        sizes = np.diff(np.concatenate([new, [len(who)]]))
        place = np.arange(len(who)) - np.repeat(new, sizes)
        keep = place < self.k
        at = rows[who[keep]]
        self.scores[at, place[keep]], self.found[at, place[keep]] = s[keep], i[keep]
        at = rows[some]
        self.size[at] = np.minimum(sizes, self.k)
        full = at[self.size[at] >= self.k]
        self.worst[full] = np.maximum(self.floor[full], _double(self.scores[full, self.k - 1]))


def _double(scores: np.ndarray) -> np.ndarray:
    if scores.dtype != object:
        return scores.astype(np.float64)
    far = 10**300
    return np.vectorize(lambda s: float(min(max(s, -far), far)), otypes=[np.float64])(scores) if scores.size else np.zeros(scores.shape)


def search(queries: Side, best: Best, points: Side, scale: float) -> int:
    """Dual-tree search; ``best`` is in the order of the queries' tree. Returns the leaf products made."""
    if not len(queries.ids) or not len(points.ids):
        return 0
    qt, ct, made = queries.tree, points.tree, 0
    width = max(queries.values.shape[1], points.values.shape[1])
    q_values, c_values, q_centres, c_centres = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries.values, points.values, qt.points, ct.points))
    sound = qt.sound and ct.sound
    with np.errstate(over="ignore", invalid="ignore"):
        dots = q_centres @ c_centres.T
        most = dots + np.outer(qt.norm, ct.radius) + np.outer(qt.radius, ct.norm) + np.outer(qt.radius, ct.radius)
        most += 1e-9 * (1 + np.abs(most) + np.outer(qt.norm + qt.radius, ct.norm + ct.radius))
    if not sound:
        most[:] = np.inf
    heap = [(-most[0, 0], 0, 0)]
    while heap:
        bound, q, c = heapq.heappop(heap)
        low = best.worst[qt.first[q] : qt.last[q]].min()
        if -bound < low:
            continue
        if not qt.kids[q] and not ct.kids[c]:
            rows = np.arange(qt.first[q], qt.last[q])
            best.take(rows, points.ids[ct.first[c] : ct.last[c]], products(q_values[rows], c_values[ct.first[c] : ct.last[c]], scale))
            made += 1
        elif qt.kids[q] and (not ct.kids[c] or qt.radius[q] >= ct.radius[c]):
            for k in qt.kids[q]:
                heapq.heappush(heap, (-most[k, c], k, c))
        else:
            for k in ct.kids[c]:
                if most[q, k] >= low:
                    heapq.heappush(heap, (-most[q, k], q, k))
    return made


def _pivots(vectors: DataFrame, column: str, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """A farthest-point net of a bounded sample, and each pivot's share of it."""
    rows = vectors.select("vec_id", column).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select(column).collect()
    _, some = components_of(pa.array([r[0] for r in rows], pa.list_(pa.float64())))
    some = np.clip(whole(some, scale), -1e100, 1e100)
    if not len(some):
        return np.zeros((1, 0)), np.ones(1)
    chosen = [0]
    far = ((some - some[0]) ** 2).sum(1)
    owner = np.zeros(len(some), np.int64)
    while len(chosen) < min(PIVOTS, len(some)) and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        own = ((some - some[chosen[-1]]) ** 2).sum(1)
        owner[own < far] = len(chosen) - 1
        far = np.minimum(far, own)
    return some[chosen], np.bincount(owner, minlength=len(chosen)) / len(some)


_BLOCKS = "block int, part int, reach double, candidates binary, groups array<binary>"


def _blocks(vectors: DataFrame, column: str, scale: float, every: int, pivots: np.ndarray, parts: np.ndarray) -> DataFrame:
    """A row for each block: its tree, its groups of queries with theirs, and how far from its pivot its rows are."""
    spark = vectors.sparkSession
    known = spark.sparkContext.broadcast((pivots, parts))

    def deal(batches):
        centres, cuts = known.value
        for b in batches:
            good, values = components_of(b.column(column))
            some = b.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            values, good = values[some[good]], good & some
            if not good.any():
                continue
            points = np.clip(whole(values, scale), -1e100, 1e100)
            width = max(points.shape[1], centres.shape[1])
            points, net = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (points, centres))
            near = np.argmin((net**2).sum(1) - 2 * points @ net.T, axis=1).astype(np.int32)
            ids = b.column("vec_id").filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([pa.array(near), ids, pa.array(cuts[near].astype(np.int32)), pa.array([x.tobytes() for x in values], pa.binary())], names=["block", "vec_id", "parts", "vector"])

    dealt = vectors.select(F.col("vec_id").cast("long"), column).mapInArrow(deal, "block int, vec_id long, parts int, vector binary")
    # a pivot that many rows are nearest to is cut by ids and values, so that no block grows with the table
    dealt = dealt.select("block", F.pmod(F.xxhash64("vec_id", "vector"), F.col("parts")).cast("int").alias("part"), "vec_id", "vector")

    def gather(table):
        centres, _ = known.value
        ids = table.column("vec_id").to_numpy()
        blobs = table.column("vector").to_pylist()
        width = max(map(len, blobs))
        values = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in blobs), "<f8").reshape(len(ids), -1)
        block = int(table.column("block")[0].as_py())
        points = np.clip(whole(values, scale), -1e100, 1e100)
        wide = max(points.shape[1], centres.shape[1])
        pivot = np.pad(centres[block], (0, wide - centres.shape[1]))
        reach = float(np.sqrt(((np.pad(points, ((0, 0), (0, wide - points.shape[1]))) - pivot) ** 2).sum(1).max()))
        if not np.abs(points).max(initial=0) < 1e100:
            reach = np.inf
        asks = np.flatnonzero(ids % every == 0)
        groups = [Side(ids[asks[k : k + GROUP]], values[asks[k : k + GROUP]], scale, QUERY_CENTRES).pack() for k in range(0, len(asks), GROUP)]
        row = ([block], [int(table.column("part")[0].as_py())], [reach], [Side(ids, values, scale, CENTRES).pack()], [groups])
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
        return pa.table([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["block", "part", "reach", "candidates", "groups"])

    return dealt.groupBy("block", "part").applyInArrow(gather, _BLOCKS)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.string())])
_SAID = "query_id long, vec_id long, score long, beyond string"


def _beyond(score: int) -> str:
    """Orders scores that are given as the same long: what is greater has the greater string."""
    if -_LONG - 1 <= score <= _LONG:
        return "" if score >= 0 else "~"
    digits = str(abs(score))
    return f"{len(digits):04d}{digits}" if score > 0 else f"{9999 - len(digits):04d}" + "".join(str(9 - int(d)) for d in digits)


def _rows(best: Best) -> pa.RecordBatch:
    had = np.arange(best.k)[None, :] < best.size[:, None]
    scores, beyond = best.scores[had], None
    if scores.dtype == object:
        beyond = [_beyond(s) for s in scores.tolist()]
        scores = np.array([min(max(s, -_LONG - 1), _LONG) for s in scores.tolist()], np.int64)
    else:
        beyond = np.where(scores >= 0, "", "~").tolist()
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(best.ids, best.size)), pa.array(best.found[had]), pa.array(scores), pa.array(beyond, pa.string())], schema=_FOUND)


def _at_home(blocks: DataFrame, k: int, scale: float) -> DataFrame:
    """Each block's groups among its own rows: what they find, and, in a row for each group, its tree, its floors and the least of them."""

    def work(batches):
        for b in batches:
            for block, part, rows, groups in zip(*(b.column(c).to_pylist() for c in ("block", "part", "candidates", "groups")), strict=True):
                points = Side.unpack(rows)
                for at, group in enumerate(groups):
                    asked = Side.unpack(group)
                    best = Best(asked.ids, k)
                    search(asked, best, points, scale)
                    found = _rows(best)
                    tree = asked.tree
                    bounds = (tree.points[0].tobytes(), float(tree.radius[0]), float(tree.norm[0]), float(best.worst.min()))
                    one = [pa.array([x], t) for x, t in zip((block, part, at, pickle.dumps((group, best.worst), protocol=5), *bounds), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64()), strict=True)]
                    names = ["block", "part", "at", "asked", "centre", "radius", "norm", "floor"]
                    yield pa.RecordBatch.from_arrays([*one, *(pa.nulls(1, t) for t in _FOUND.types)], names=[*names, *_FOUND.names])
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(found.num_rows, x.type) for x in one), *found.columns], names=[*names, *_FOUND.names])

    return blocks.select("block", "part", "candidates", "groups").mapInArrow(work, f"block int, part int, at int, asked binary, centre binary, radius double, norm double, floor double, {_SAID}")


def _away(groups: DataFrame, blocks: DataFrame, reach: dict[int, float], pivots: np.ndarray, parts: np.ndarray, chunks: int, k: int, scale: float) -> DataFrame:
    """Groups of queries among the other blocks that may hold better rows. A block goes once to each chunk of groups, a group once to each block it must see."""
    known = groups.sparkSession.sparkContext.broadcast((pivots, reach))

    def see(batches):
        centres, far = known.value
        for b in batches:
            pivot = [[] for _ in range(b.num_rows)]
            for row, (c, r, n, floor) in enumerate(zip(*(b.column(x).to_pylist() for x in ("centre", "radius", "norm", "floor")), strict=True)):
                own = np.frombuffer(c, "<f8")
                width = min(len(own), centres.shape[1])
                for p, radius in far.items():
                    with np.errstate(over="ignore", invalid="ignore"):
                        norm = float(np.sqrt((centres[p] ** 2).sum()))
                        most = float(own[:width] @ centres[p][:width]) + n * radius + norm * r + r * radius
                        most += 1e-6 * (1 + abs(most) + (n + r) * (norm + radius))
                    if not most < floor:  # also where it is no number
                        pivot[row].append(p)
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("part"), b.column("at"), pa.array(pivot, pa.list_(pa.int32()))], names=["block", "part", "at", "pivots"])

    home = F.struct("block", "part", "at")
    shapes = groups.select("block", "part", "at", "centre", "radius", "norm", "floor").mapInArrow(see, "block int, part int, at int, pivots array<int>")
    cuts = F.array(*(F.lit(int(x)) for x in parts))  # PIVOTS numbers
    each = shapes.select(home.alias("home"), F.explode("pivots").alias("block")).select("home", "block", F.explode(F.sequence(F.lit(0), F.get(cuts, F.col("block")) - 1)).alias("part"))
    each = each.where(~((F.col("home.block") == F.col("block")) & (F.col("home.part") == F.col("part")))).withColumn("chunk", F.pmod(F.xxhash64("home"), F.lit(chunks)).cast("int"))
    asks = each.join(groups.select(home.alias("home"), "asked"), "home").select("block", "part", "chunk", "asked")
    wanted = each.select(F.col("block").alias("to"), F.col("part").alias("of"), F.col("chunk").alias("with")).distinct()
    told = wanted.join(blocks.select(F.col("block").alias("to"), F.col("part").alias("of"), "candidates"), ["to", "of"])

    def work(left, right):
        out = []
        if left.num_rows and right.num_rows:
            points = Side.unpack(right.column("candidates")[0].as_py())
            for blob in left.column("asked").to_pylist():
                group, floors = pickle.loads(blob)
                asked = Side.unpack(group)
                best = Best(asked.ids, k, floors)
                search(asked, best, points, scale)
                out.append(_rows(best))
        return pa.Table.from_batches(out, schema=_FOUND)

    return asks.groupBy("block", "part", "chunk").cogroup(told.groupBy("to", "of", "with")).applyInArrow(work, _SAID)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", column)
    pivots, share = _pivots(vectors.where(F.col("vec_id").isNotNull()), column, scale)
    total = vectors.count()
    block_rows = min(BLOCK, max(SMALL, total // tasks(spark)))
    parts = np.maximum(1, np.ceil(share * total / block_rows)).astype(np.int64)
    blocks = saved(_blocks(vectors, column, scale, every, pivots, parts), "blocks")
    at_home = saved(_at_home(blocks.where(F.size("groups") > 0).repartition(tasks(spark), "block", "part"), k, scale), "home")
    groups, home = at_home.where("asked is not null"), at_home.where("query_id is not null").select(*_FOUND.names)
    reach = {r.block: r.reach for r in blocks.groupBy("block").agg(F.max("reach").alias("reach")).collect()}  # a row a pivot
    chunks = max(1, -(-groups.count() // CHUNK))
    found = home.unionByName(_away(groups, blocks, reach, pivots, parts, chunks, k, scale))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    """The same in SQL: every query against every row."""
    return """WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v, true), lambda p: p[1] * p[2])), 0) AS s FROM good q JOIN good c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, CAST(s AS BIGINT) AS score FROM ranked WHERE n <= 20"""
