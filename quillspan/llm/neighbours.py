"""The most similar vectors of every vector.

Unit vectors are projected onto a few random directions with normally
distributed (2-stable) entries. A squared projected distance divided by the
squared true one then follows a chi-square distribution, whatever the vectors
are. The projections are indexed by kd-trees, which are spread over the
workers. A vector's neighbours are verified with their exact similarity in the
order in which the tree yields projected neighbours, and the search stops when
any vector that is still unseen would, by the chi-square test, be closer than
the k-th one found with a probability below 1 - ``confidence``.

The vectors are divided among cells so that groups of alike vectors stay
together, and a cell puts them into leaves: a ball with a mean and a radius each,
large ones cut by the kd-tree. A leaf is left out for a vector if the triangle
inequality in the full space excludes it or if its box fails the test. So work
follows the size of the leaves around a vector and not that of the table, which
the projections alone can't give: a ball in 6 dimensions holds a fixed share of
all vectors.

Two rounds suffice: the own cell bounds the k-th distance, and the cells with
leaves that the resulting ball touches finish the search. The centres are fitted
on a bounded sample; every row is searched. Equal vectors are searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.plans.lineage import stored

DIMENSIONS = 64
PROJECTIONS = 6
CONFIDENCE = 0.8
#: Rows of a worker's cell; small collections get up to FEW_CELLS cells of fewer rows.
CELL_ROWS, FEWEST_ROWS, FEW_CELLS = 65_536, 8_192, 12
#: Sampled rows a cell on which the centres are fitted, and the most of all; the rounds of fitting; lists of centres that are tried for a vector.
SAMPLE_PER_CELL, MOST_SAMPLED, _ROUNDS, _TRIED = 2_048, 262_144, 5, 6
#: A leaf's vectors lie, along any direction, so many standard deviations of its widest direction around its mean.
_DEVIATIONS = 4
SEED = 20_011
_LEAF = 384


def chi_square_quantile(probability: float, degrees: int) -> float:
    """The quantile for an even number of degrees of freedom."""
    if degrees % 2:
        raise ValueError("an even number of degrees is needed")

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < probability else (low, middle)
    return high


def directions(dimensions: int, projections: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, projections)).astype(np.float32)


class Tree(NamedTuple):
    """A kd-tree: inner nodes in level order, leaves as negative children."""

    axis: np.ndarray
    at: np.ndarray
    children: np.ndarray
    low: np.ndarray  # of each leaf's box
    high: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.low)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64) if len(self.axis) else np.full(len(points), -1, np.int64)
        while True:
            inner = np.flatnonzero(node >= 0)
            if not len(inner):
                return -node - 1
            n = node[inner]
            side = points[inner, self.axis[n]] > self.at[n]
            node[inner] = self.children[n, side.astype(np.int64)]


def build_tree(sample: np.ndarray, leaves: int) -> Tree:
    """Halves the most populous cell along its widest axis; equal values stay together."""
    m = sample.shape[1] if sample.size else PROJECTIONS
    axis: list[int] = []
    at: list[float] = []
    children: list[list[int]] = []
    boxes: list[tuple[np.ndarray, np.ndarray]] = []
    depth = max(0, math.ceil(math.log2(max(1, leaves))))

    def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> int:
        if level and len(rows) > 1:
            spread = sample[rows].max(0) - sample[rows].min(0)
            for a in np.argsort(-spread):
                values = sample[rows, a]
                cut = float(np.median(values))
                if cut == values.max():
                    smaller = values[values < cut]
                    if not len(smaller):
                        continue
                    cut = float(smaller.max())
                me = len(axis)
                axis.append(int(a))
                at.append(cut)
                children.append([0, 0])
                left_high, right_low = high.copy(), low.copy()
                left_high[a], right_low[a] = cut, cut
                children[me][0] = grow(rows[values <= cut], low, left_high, level - 1)
                children[me][1] = grow(rows[values > cut], right_low, high, level - 1)
                return me
        boxes.append((low, high))
        return -len(boxes)

    grow(np.arange(len(sample)), np.full(m, -np.inf, np.float32), np.full(m, np.inf, np.float32), depth)
    return Tree(
        np.array(axis, np.int64), np.array(at, np.float32), np.array(children, np.int64).reshape(-1, 2),
        np.array([b[0] for b in boxes], np.float32), np.array([b[1] for b in boxes], np.float32),
    )


def _near(vectors: np.ndarray, k: int) -> float:
    """The similarity at twice the usual distance to the k-th neighbour."""
    n = len(vectors)
    some = np.arange(0, n, -(-n // 256))
    sims = vectors[some] @ vectors.T
    sims[np.arange(len(some)), some] = -3
    return min(4 * float(np.median(np.partition(sims, n - k, axis=1)[:, n - k])) - 3, 0.9999)


def _groups(vectors: np.ndarray, near: float, most: int) -> list[np.ndarray]:
    """Groups of unit vectors with one to which all others have the similarity ``near``; what remains after ``most`` groups is one."""
    rng = np.random.default_rng(SEED)
    left, groups = np.arange(len(vectors)), []
    while len(left):
        if len(groups) > most:
            groups.append(left)
            break
        picks: list[int] = []
        tried = vectors[rng.choice(left, min(64, len(left)), replace=False)]
        alike = tried @ tried.T >= near
        for i in range(len(tried)):
            if not alike[i, picks].any():
                picks.append(i)
        sims = vectors[left] @ tried[picks].T
        owner, covered = sims.argmax(1), sims.max(1) >= near
        by = np.flatnonzero(covered)[np.argsort(owner[covered], kind="stable")]
        groups += [g for g in np.split(left[by], np.cumsum(np.bincount(owner[covered], minlength=len(picks)))[:-1]) if len(g)]
        left = left[~covered]
    return groups


def _reach_of(far: np.ndarray, inner: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """A similarity that the k-th neighbour has at least; ``far``: squared distances to the means of leaves.

    The squared distances of a point to a leaf's vectors sum up to count * (far + inner), so at most
    count - k of them can be beyond the share that count - k vectors would have each.
    """
    full = count > k
    if not full.any():
        return np.full(len(far), -2.0, np.float32)
    share = count[full] / (count[full] - k)
    return (1 - ((far[:, full] + inner[full]) * share).min(1) / 2 - 1e-4).astype(np.float32)


def _distance(similarity: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * similarity, 0)) + np.float32(1e-4)


class Cell:
    """The vectors of one cell in leaves of alike vectors, large groups cut by a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, k: int) -> None:
        done = []
        n = len(vectors)
        small = n <= max(_LEAF, k + 1)
        for g in [np.arange(n)] * bool(n) if small else _groups(vectors, _near(vectors, k), n // 32):
            if len(g) <= _LEAF:
                done.append(g)
                continue
            at = build_tree(projected[g], -(-len(g) // _LEAF)).leaf_of(projected[g])
            done += [g[at == i] for i in np.unique(at)]
        order = np.concatenate(done) if done else np.zeros(0, np.int64)
        self.ids, self.vectors, self.projected = ids[order], np.ascontiguousarray(vectors[order]), projected[order]
        self.edges = np.cumsum([0, *map(len, done)])
        m, start = np.diff(self.edges), self.edges[:-1]
        self.leaf = np.repeat(np.arange(len(done)), m)
        self.count = m.astype(np.float32)
        self.centre = np.zeros((0, vectors.shape[1]), np.float32)
        self.radius = self.inner = np.zeros(0, np.float32)
        self.low = self.high = np.zeros((0, projected.shape[1]), np.float32)
        if done:
            self.centre = np.add.reduceat(self.vectors, start, axis=0) / self.count[:, None]
            apart = self.vectors - self.centre[self.leaf]
            apart = (apart * apart).sum(1)
            self.radius, self.inner = np.sqrt(np.maximum.reduceat(apart, start)), np.add.reduceat(apart, start) / self.count
            self.low, self.high = np.minimum.reduceat(self.projected, start, axis=0), np.maximum.reduceat(self.projected, start, axis=0)

    def search(self, vectors: np.ndarray, projected: np.ndarray, worst: np.ndarray, k: int, factor: float, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids and similarities of up to k vectors better than ``worst``, others marked -2, and the similarity of the k-th.

        ``factor`` is the chi-square quantile of the stopping test; ``own``: the vectors are those of the cell, in its order.
        """
        n = len(vectors)
        best = np.full((n, k), -2.0, np.float32)
        who = np.full((n, k), -1, np.int64)
        reach = np.maximum(worst, np.float32(-2))
        if not len(self.ids) or not n:
            return who, best, reach
        norm = 1 + (self.centre * self.centre).sum(1)
        home = np.concatenate([(norm - 2 * (vectors[i : i + 4096] @ self.centre.T)).argmin(1) for i in range(0, n, 4096)]) if not own else self.leaf
        by_home = np.argsort(home, kind="stable")

        def look(rows: np.ndarray, leaf: int) -> None:
            a, b = self.edges[leaf], self.edges[leaf + 1]
            sims = vectors[rows] @ self.vectors[a:b].T
            if own:
                me = np.flatnonzero((rows >= a) & (rows < b))
                sims[me, rows[me] - a] = -3
            hit = np.flatnonzero(sims.max(1) >= reach[rows])
            if not len(hit):
                return
            rows, sims = rows[hit], sims[hit]
            if sims.shape[1] > k:
                pick = np.argpartition(sims, sims.shape[1] - k, axis=1)[:, -k:]
                sims = np.take_along_axis(sims, pick, 1)
                names = self.ids[a:b][pick]
            else:
                names = np.broadcast_to(self.ids[a:b], sims.shape)
            both, names = np.concatenate([best[rows], sims], axis=1), np.concatenate([who[rows], names], axis=1)
            pick = np.argpartition(both, both.shape[1] - k, axis=1)[:, -k:]
            best[rows] = np.take_along_axis(both, pick, 1)
            who[rows] = np.take_along_axis(names, pick, 1)
            reach[rows] = np.maximum(reach[rows], best[rows].min(1))

        for start in range(0, n, 512):
            q = by_home[start : start + 512]
            homes = home[q]
            for leaf in np.unique(homes):
                look(q[homes == leaf], leaf)
            far = np.maximum(norm - 2 * (vectors[q] @ self.centre.T), 0)
            sure = np.maximum(reach[q], _reach_of(far, self.inner, self.count, k))
            r = _distance(sure)
            rows, leaves = np.nonzero(far <= (r[:, None] + self.radius) ** 2)
            other = leaves != homes[rows]
            rows, leaves = rows[other], leaves[other]
            if not len(rows):
                continue
            gap = np.maximum(np.maximum(self.low[leaves] - projected[q[rows]], projected[q[rows]] - self.high[leaves]), 0)
            gap = (gap * gap).sum(1)
            keep = gap <= _distance(reach[q])[rows] ** 2 * factor  # the test needs neighbours that were found
            rows, leaves, gap = rows[keep], leaves[keep], gap[keep]
            by_leaf = np.argsort(leaves, kind="stable")
            parts = np.split(by_leaf, np.flatnonzero(np.diff(leaves[by_leaf])) + 1) if len(by_leaf) else []
            for part in sorted(parts, key=lambda x: gap[x].min()):
                x, leaf = rows[part], leaves[part[0]]
                still = (gap[part] <= _distance(reach[q[x]]) ** 2 * factor) & (far[x, leaf] <= (_distance(np.maximum(sure[x], reach[q[x]])) + self.radius[leaf]) ** 2)
                if still.any():
                    look(q[x[still]], leaf)
        who[best <= -2] = -1
        best[best < -2] = -2
        return who, best, reach


def _usable(batch: pd.DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the usable vectors of a batch and the vectors, of unit length."""
    column = batch.iloc[:, 1].tolist()
    right = [i for i, e in enumerate(column) if e is not None and len(e) == dimensions]
    if not right:
        return np.zeros(0, np.int64), np.zeros((0, dimensions), np.float32)
    v = np.array([column[i] for i in right], dtype=np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        largest = np.abs(v).max(1)
        good = np.isfinite(v).all(1) & (largest > 0)
        v = v[good] / largest[good][:, None]
        v /= np.sqrt((v * v).sum(1))[:, None]
    return np.array(right)[good], v.astype(np.float32)


def _identities(vectors: np.ndarray) -> np.ndarray:
    import xxhash

    vectors = vectors + np.float32(0)  # one zero
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63 for x in vectors], np.int64)


def _lists(rows) -> pd.Series:
    """A column of lists, of that type even without rows."""
    return pd.Series(list(rows), dtype=object)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), width)


def unit_vectors(rows: DataFrame, key: str, embedding: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, vid, vector): the usable rows; vid identifies the unit vector, which comes once per input partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            at, v = _usable(batch, dimensions)
            ids = _identities(v)
            out = []
            for i, x in zip(ids.tolist(), v):
                out.append(None if i in seen else x.tobytes())
                seen.add(i)
            yield pd.DataFrame({"key": batch.iloc[at, 0].to_numpy(), "vid": ids, "vector": out})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, embedding).mapInPandas(run, f"key {kind}, vid bigint, vector binary")


def _means(sample: np.ndarray, number: int) -> np.ndarray:
    """About so many means of a sample, fitted in a few rounds."""
    means = sample[np.sort(np.random.default_rng(SEED).choice(len(sample), min(number, len(sample)), replace=False))]
    for _ in range(_ROUNDS if len(means) < len(sample) else 0):
        at = _nearest(sample, means)
        count = np.bincount(at, minlength=len(means))
        used = np.flatnonzero(count)
        means[used] = np.add.reduceat(sample[np.argsort(at, kind="stable")], np.r_[0, np.cumsum(count[used])[:-1]], axis=0) / count[used][:, None]
    return means


def _nearest(points: np.ndarray, means: np.ndarray) -> np.ndarray:
    norm = (means * means).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((points[i : i + 4096] @ means.T - norm).argmax(1) for i in range(0, len(points), 4096))])


class _Cells(NamedTuple):
    """Centres of groups of alike vectors in lists by a coarser mean, and the cell of each; a cell holds whole groups, as far as they fit."""

    centre: np.ndarray
    cell: np.ndarray
    mean: np.ndarray
    edges: np.ndarray
    beyond: float  # the squared distance from which on all centres are looked at

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        if not len(points) or len(self.centre) == 1:
            return np.zeros(len(points), np.int64)
        norm = (self.centre * self.centre).sum(1) / 2
        best, where = np.full(len(points), -9, np.float32), np.zeros(len(points), np.int64)
        tried = points @ self.mean.T - (self.mean * self.mean).sum(1) / 2
        few = min(_TRIED, len(self.mean))
        tried = np.argpartition(-tried, few - 1, axis=1)[:, :few].ravel()
        by = np.argsort(tried, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(tried[by])) + 1):
            a, b = self.edges[tried[part[0]]], self.edges[tried[part[0]] + 1]
            if a < b:
                rows = part // few
                score = points[rows] @ self.centre[a:b].T - norm[a:b]
                at, score = score.argmax(1), score.max(1)
                more = score > best[rows]
                best[rows[more]], where[rows[more]] = score[more], a + at[more]
        far = np.flatnonzero(1 - 2 * best > self.beyond)
        step = max(1, 8_000_000 // len(self.centre))
        for i in range(0, len(far), step):
            rows = far[i : i + step]
            where[rows] = (points[rows] @ self.centre.T - norm).argmax(1)
        return self.cell[where]


def _cells(sample: np.ndarray, cells: int) -> _Cells:
    """Divides the groups of a sample among so many cells of about the same weight."""
    sample = np.unique(sample, axis=0)
    near = _near(sample, 1) if len(sample) > 1 else 0.0
    weight = len(sample) / cells
    centres, weights = [], []
    for g in _groups(sample, near, len(sample) // 4):
        parts = [g]
        if len(g) > weight:
            at = _nearest(sample[g], _means(sample[g], math.ceil(2 * len(g) / weight)))
            parts = [g[at == i] for i in np.unique(at)]
        for x in parts:
            centres.append(sample[x].mean(0))
            weights.append(len(x))
    centre, mass = np.stack(centres), np.array(weights)
    mean = _means(centre, round(math.sqrt(len(centre))))
    at = _nearest(centre, mean)
    by = np.argsort(at, kind="stable")
    upto = np.cumsum(mass[by]) - mass[by] / 2
    return _Cells(centre[by], np.minimum((upto / weight).astype(np.int64), cells - 1), mean, np.r_[0, np.cumsum(np.bincount(at, minlength=len(mean)))], 2 - 2 * near)


def _fit(vectors: DataFrame, n: int, dimensions: int) -> tuple[_Cells, int]:
    cells = math.ceil(max(n / CELL_ROWS, min(FEW_CELLS, n / FEWEST_ROWS), 1))
    one = _Cells(np.zeros((1, dimensions), np.float32), np.zeros(1, np.int64), np.zeros((1, dimensions), np.float32), np.array([0, 1]), 0.0)
    if cells == 1:
        return one, 1
    share = min(1.0, min(cells * SAMPLE_PER_CELL, MOST_SAMPLED) / n)
    picked = vectors.filter(F.pmod(F.xxhash64("vid", F.lit(SEED)), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).select("vector")

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"v": [b"".join(batch["vector"])]})

    sample = picked.mapInPandas(joined, "v binary").collect()  # a sample of about so many vectors, a row a batch
    points = np.frombuffer(b"".join(bytes(r.v) for r in sample), np.float32).reshape(-1, dimensions)
    return (_cells(points, cells), cells) if len(points) else (one, 1)


class _Leaves(NamedTuple):
    """The leaves of all cells, in the order of these."""

    cell: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    inner: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def touched(self, cell: np.ndarray, leaf: np.ndarray, vectors: np.ndarray, projected: np.ndarray, reach: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for each other cell with a leaf that a row's ball touches; rows of a leaf come together."""
        r = _distance(reach)
        ball = r**2 * factor  # in the projections
        norm, length = 1 + (self.centre * self.centre).sum(1), np.sqrt((self.centre * self.centre).sum(1))
        found: list[np.ndarray] = []

        def touch(rows: np.ndarray, leaves: np.ndarray, far: np.ndarray) -> None:
            i, j = np.nonzero(far <= (r[rows][:, None] + self.radius[leaves]) ** 2)
            i, j = rows[i], leaves[j]
            away = self.cell[j] != cell[i]
            i, j = i[away], j[away]
            gap = np.maximum(np.maximum(self.low[j] - projected[i], projected[i] - self.high[j]), 0)
            keep = (gap * gap).sum(1) <= ball[i]
            found.append(np.stack([i[keep], self.cell[j[keep]]], 1))

        # rows that are far from their own neighbours are held against every leaf, the others against those that their leaf may touch
        wide = r > 1.2 * np.median(r)
        every = np.arange(len(self.cell))
        step = max(1, 8_000_000 // len(every))
        alone = np.flatnonzero(wide)
        for i in range(0, len(alone), step):
            rows = alone[i : i + step]
            far = np.maximum(norm - 2 * (vectors[rows] @ self.centre.T), 0)
            r[rows] = _distance(np.maximum(reach[rows], _reach_of(far, self.inner, self.count, k)))
            touch(rows, every, far)
        close = np.flatnonzero(~wide)
        runs = np.split(close, np.flatnonzero((np.diff(cell[close]) != 0) | (np.diff(leaf[close]) != 0)) + 1) if len(close) else []
        step = max(1, 8_000_000 // len(every))
        for i in range(0, len(runs), step):
            some = runs[i : i + step]
            means = np.stack([vectors[x].mean(0) for x in some])
            apart = [vectors[x] - c for x, c in zip(some, means)]
            spread = np.sqrt(np.maximum(np.linalg.eigvalsh(np.stack([x.T @ x for x in apart]))[:, -1], 0))
            dots = means @ self.centre.T
            for x, dot, s in zip(some, dots, spread):
                s *= min(1, _DEVIATIONS / math.sqrt(len(x)))
                near = np.flatnonzero(norm - 2 * (dot + (s + 1e-4) * length) <= (r[x].max() + self.radius) ** 2)
                near = near[self.cell[near] != cell[x[0]]]
                if len(near):
                    touch(x, near, np.maximum(norm[near] - 2 * (vectors[x] @ self.centre[near].T), 0))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pairs[:, 0], pairs[:, 1]


def nearest_vectors(vectors: DataFrame, k: int, dimensions: int = DIMENSIONS, projections: int = PROJECTIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """(vid, found array<struct<similarity, nid>>): up to k nearest other vectors, best first, of each distinct vector."""
    spark = vectors.sparkSession
    n = vectors.count()
    fit, cells = _fit(vectors, n, dimensions)
    fitted = spark.sparkContext.broadcast(fit)
    g, factor = directions(dimensions, projections), chi_square_quantile(confidence, projections)

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cell": fitted.value.cell_of(_matrix(batch["vector"], dimensions)), "vid": batch["vid"], "vector": batch["vector"]})

    placed = vectors.select("vid", "vector").mapInPandas(locate, "cell int, vid bigint, vector binary")

    def cell_of(part: pd.DataFrame) -> Cell:
        part = part.drop_duplicates("vid")
        v = _matrix(part["vector"], dimensions)
        return Cell(part["vid"].to_numpy(np.int64), v, v @ g, k)

    def own(part: pd.DataFrame) -> pd.DataFrame:
        cell = cell_of(part)
        who, best, reach = cell.search(cell.vectors, cell.projected, np.full(len(cell.ids), -2.0, np.float32), k, factor, own=True)
        here = int(part["cell"].iloc[0])
        rows = pd.DataFrame({"cell": here, "leaf": cell.leaf, "vid": cell.ids, "vector": [x.tobytes() for x in cell.vectors], "worst": reach, "nids": _lists(who), "sims": _lists(best), "leaves": None})
        about = np.concatenate([cell.centre, cell.radius[:, None], cell.inner[:, None], cell.count[:, None], cell.low, cell.high], axis=1)
        return pd.concat([rows, pd.DataFrame({"cell": [here], "leaf": -1, "vid": 0, "vector": None, "worst": np.float32(0), "nids": None, "sims": None, "leaves": [about.astype(np.float32).tobytes()]})])

    # every cell is a task of its own
    first = placed.repartitionById(cells, "cell").groupBy("cell").applyInPandas(own, "cell int, leaf int, vid bigint, vector binary, worst float, nids array<bigint>, sims array<float>, leaves binary")
    first = stored(first, "own-cell")
    rows = first.filter("leaves is null")
    both = rows.select("vid", "nids", "sims")
    if cells > 1:
        told = sorted(first.filter("leaves is not null").select("cell", "leaves").collect(), key=lambda r: r["cell"])  # a row per cell
        width = dimensions + 3 + 2 * projections
        about = [np.frombuffer(bytes(r["leaves"]), np.float32).reshape(-1, width) for r in told]
        of = np.repeat([r["cell"] for r in told], [len(a) for a in about])
        d = dimensions
        about = np.concatenate(about) if about else np.zeros((0, width), np.float32)
        known = spark.sparkContext.broadcast(_Leaves(of, np.ascontiguousarray(about[:, :d]), about[:, d].copy(), about[:, d + 1].copy(), about[:, d + 2].copy(), about[:, d + 3 : d + 3 + projections].copy(), about[:, d + 3 + projections :].copy()))

        def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                v = _matrix(batch["vector"], dimensions)
                i, to = known.value.touched(batch["cell"].to_numpy(), batch["leaf"].to_numpy(), v, v @ g, batch["worst"].to_numpy(np.float32), k, factor)
                at, start = np.unique(i, return_index=True)
                yield pd.DataFrame({"vid": batch["vid"].to_numpy()[at], "vector": batch["vector"].to_numpy()[at], "worst": batch["worst"].to_numpy()[at], "visits": _lists(np.split(to, start[1:]) if len(at) else [])})

        going = stored(rows.select("cell", "leaf", "vid", "vector", "worst").mapInPandas(visits, "vid bigint, vector binary, worst float, visits array<int>"), "visits")
        guests = going.select(F.explode("visits").alias("cell"), "vid", "vector", "worst")
        # a cell with very many guests is searched in several tasks, each with a copy of the cell
        crowd = going.select(F.explode("visits").alias("cell")).groupBy("cell").count().collect()  # a row per cell
        parts = {r["cell"]: -(-r["count"] // (4 * CELL_ROWS)) for r in crowd if r["count"] > 4 * CELL_ROWS}
        shares = F.coalesce(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])[F.col("cell")], F.lit(1)) if parts else F.lit(1)
        guests = guests.withColumn("part", F.pmod(F.xxhash64("vid"), shares).cast("int"))
        hosts = rows.select("cell", "vid", "vector").withColumn("part", F.explode(F.sequence(F.lit(0), shares - 1)))

        def visit(host: pd.DataFrame, guest: pd.DataFrame) -> pd.DataFrame:
            if not len(host) or not len(guest):
                return pd.DataFrame({"vid": np.zeros(0, np.int64), "nids": _lists([]), "sims": _lists([])})
            v = _matrix(guest["vector"], dimensions)
            who, best, _ = cell_of(host).search(v, v @ g, guest["worst"].to_numpy(np.float32), k, factor)
            hit = best.max(1) > -2
            return pd.DataFrame({"vid": guest["vid"].to_numpy()[hit], "nids": _lists(who[hit]), "sims": _lists(best[hit])})

        second = hosts.groupBy("cell", "part").cogroup(guests.groupBy("cell", "part")).applyInPandas(visit, "vid bigint, nids array<bigint>, sims array<float>")
        both = both.unionByName(second)
    merged = both.groupBy("vid").agg(F.flatten(F.collect_list(F.expr("filter(arrays_zip(sims, nids), x -> x.nids <> vid and x.sims > -2)"))).alias("x"))
    ranked = F.array_sort("x", lambda p, q: F.when(p["sims"] > q["sims"], -1).when(p["sims"] < q["sims"], 1).when(p["nids"] < q["nids"], -1).when(p["nids"] > q["nids"], 1).otherwise(0))
    return merged.withColumn("x", ranked).select(
        "vid", F.expr(f"transform(slice(array_distinct(x), 1, {k}), y -> struct(y.sims as similarity, y.nids as nid))").alias("found")
    )


SALTS = 8


def similar_rows(rows: DataFrame, k: int = 5, key: str = "chunk_id", embedding: str = "embedding", dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """(key, neighbour, similarity, place): the k most similar other rows of every usable row.

    Usable are embeddings of ``dimensions`` finite numbers that aren't all zero,
    of whatever length; null and other embeddings give no row. Rows of the same
    key are one record. Of equally similar rows the smaller key comes first.
    Fewer than k other rows give fewer neighbours.
    """
    table = stored(unit_vectors(rows, key, embedding, dimensions), "unit-vectors")
    vectors = table.filter(F.col("vector").isNotNull()).select("vid", "vector")
    found = stored(nearest_vectors(vectors, k, dimensions, confidence=confidence), "nearest")
    members = table.select("vid", F.col("key").alias("member")).distinct()
    # k + 2 first members of every vector: a list that isn't full has all of them
    order = F.row_number().over(Window.partitionBy("vid").orderBy("member"))
    few = members.withColumn("o", order).filter(F.col("o") <= k + 2).groupBy("vid").agg(F.array_sort(F.collect_list("member")).alias("few"))
    few = stored(few, "members")
    flat = found.select("vid", F.explode("found").alias("f")).select("vid", F.col("f.similarity").alias("similarity"), F.col("f.nid").alias("nid"))
    others = (
        flat.join(few.select(F.col("vid").alias("nid"), "few"), "nid")
        .groupBy("vid")
        .agg(F.flatten(F.collect_list(F.expr("transform(few, m -> struct(-similarity as s, m as m))"))).alias("o"))
        .select("vid", F.slice(F.array_sort("o"), 1, k).alias("others"))
    )
    all_known = few.filter(F.size("few") <= k + 1).join(others, "vid", "left").withColumn("member", F.explode("few"))
    # a vector with more members than that has its members' neighbours among them
    many = few.filter(F.size("few") > k + 1).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = members.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int")).join(many, ["vid", "salt"])
    empty = F.lit(None).cast(others.schema["others"].dataType)
    mine = all_known.select("member", "few", "others").unionByName(copies.select("member", "few", empty.alias("others")))
    chosen = F.expr(f"slice(concat(transform(filter(few, m -> m <> member), m -> struct(-1.0f as s, m as m)), coalesce(others, array())), 1, {k})")
    return mine.select(F.col("member").alias(key), F.posexplode(chosen).alias("place", "n")).select(
        key, F.col("n.m").alias("neighbour"), (-F.col("n.s")).cast("double").alias("similarity"), (F.col("place") + 1).alias("place")
    )


def neighbour_pairs(neighbours: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key_a, key_b), a before b: pairs of which at least one row is among the other's neighbours."""
    return neighbours.select(F.least(key, "neighbour").alias(f"{key}_a"), F.greatest(key, "neighbour").alias(f"{key}_b")).distinct()
