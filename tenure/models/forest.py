"""Random forests of folds, grown level by level from sums over all rows.

Rows are coded once: every input becomes the number of its bin, and a staged table holds blocks
of coded rows, column by column. For each level of a fold's trees, tasks lead their rows down the
trees and count the classes per bin of every node's inputs; Spark adds these counts up, and a
node's best split follows from its sums. Nothing is kept between the levels but the trees.

The forest is that of ``fit_forest``: bags are Poisson(1) counts, a node tries the square root of
the number of inputs, splits lower the Gini impurity, numbers have up to 32 bins, categories are
ordered by their label rate, and two leaves of a split that vote alike become one.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.models.design import fit_design
from tenure.operators.tally import quantile_sketches, sketched_quantiles
from tenure.session import stage

#: Bytes of coded inputs in a staged block, and in the blocks that a task takes together.
BLOCK_BYTES, TASK_BYTES = 4 << 20, 64 << 20
#: Rows whose bag is drawn at once, so that the numbers stay in the processor's cache.
DRAWN = 32_768
#: Bins of a number, and the quantiles of the training rows from which their cuts are chosen.
BINS, GRID, SKETCH = 32, 2000, 4096
#: Poisson(1) counts of 65,536 equal shares of a hash.
POISSON = np.searchsorted(
    np.cumsum([math.exp(-1) / math.factorial(i) for i in range(9)]), (np.arange(65_536) + 0.5) / 65_536
).astype(np.uint8)


@dataclass
class Layout:
    """``sizes`` has the codes of every input, and ``cuts[fold][input]`` numbers those that begin a bin for a fold."""

    sizes: list[int]
    cuts: list[list[np.ndarray]]
    categories: set[int]

    def bins(self, fold: int) -> list[int]:
        return [n if j in self.categories else len(self.cuts[fold][j]) + 1 for j, n in enumerate(self.sizes)]

    def tables(self, fold: int) -> dict[int, np.ndarray]:
        """The bin of each code, for inputs where they differ."""
        return {
            j: np.searchsorted(cut, np.arange(self.sizes[j])).astype(_width(self.sizes))
            for j, cut in enumerate(self.cuts[fold])
            if j not in self.categories and len(cut) + 1 < self.sizes[j]
        }


@dataclass
class Coded:
    """Staged blocks of coded rows, those of class 0 first; inputs with two codes lie as bits before the others."""

    blocks: DataFrame
    layout: Layout


def _width(sizes: Sequence[int]) -> np.dtype:
    return np.min_scalar_type(max([2, *sizes]) - 1)


def _cuts(quantiles: np.ndarray, bins: int) -> np.ndarray:
    """Cuts half-way between neighbouring values, at most ``bins - 1``, with equal numbers of rows in between."""
    values, times = np.unique(quantiles, return_counts=True)
    chosen = np.arange(len(values) - 1)
    if len(chosen) >= bins:
        until = np.cumsum(times)[:-1]
        wanted = np.arange(1, bins) * (len(quantiles) / bins)
        after = np.searchsorted(until, wanted).clip(1, len(until) - 1)
        chosen = np.unique(np.where(wanted - until[after - 1] <= until[after] - wanted, after - 1, after))
    return (values[chosen] + values[chosen + 1]) / 2


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def code_rows(folded: DataFrame, features: Sequence[str], label: str, key: str, k: int, seed: int = 1) -> Coded:
    """Code staged rows with a 0/1 label and a ``fold``; the cuts of a fold follow from the rows of the others."""
    stages, _ = fit_design(folded, features, one_hot=False)
    levels = {c: len(x) + 1 for s in stages if hasattr(s, "labelsArray") for c, x in zip(s.getOutputCols(), s.labelsArray, strict=True)}
    inputs = stages[-1].getInputCols()
    categories = {j for j, c in enumerate(inputs) if c in levels}
    numbers = [c for c in inputs if c not in levels]
    found: list[dict[str, np.ndarray]] = [{} for _ in range(k)]
    if numbers:
        sketches = stage(quantile_sketches(folded, numbers, ["fold"], SKETCH))
        most = max([BINS, *levels.values()])
        others = sketches.withColumnRenamed("fold", "part").join(folded.sparkSession.range(k).withColumnRenamed("id", "fold"), F.col("fold") != F.col("part"))
        for r in sketched_quantiles(others, np.linspace(0, 1, GRID + 1).tolist(), ["fold"]).collect():
            found[r["fold"]][r["variable"]] = _cuts(np.array(r["quantiles"] or [0.0]), most)
    nothing = np.zeros(0)
    own = [[found[f].get(c, nothing) for c in inputs] for f in range(k)]
    edges = [np.unique(np.concatenate([cuts[j] for cuts in own])) for j in range(len(inputs))]
    cuts = [[np.searchsorted(edges[j], cuts[j]) for j in range(len(inputs))] for cuts in own]
    sizes = [levels.get(c, len(edges[j]) + 1) for j, c in enumerate(inputs)]
    width, two, size = _width(sizes), np.array(sizes) == 2, max(1, BLOCK_BYTES // len(inputs))

    def block(parts: list[tuple]) -> pa.RecordBatch:
        keys, folds, y = (np.concatenate([p[i] for p in parts]) for i in range(3))
        if not np.isin(y, (0, 1)).all():
            raise ValueError(f"{label} is not 0 or 1")
        order = np.argsort(y, kind="stable")
        codes = np.concatenate([p[3] for p in parts], axis=1)[:, order]
        held = [keys[order].tobytes(), folds[order].tobytes(), np.packbits(codes[two], axis=1).tobytes(), codes[~two].tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([len(y)]), pa.array([int((y == 0).sum())]), *[pa.array([h], pa.binary()) for h in held]],
            names=["n", "zeros", "keys", "folds", "bits", "codes"],
        )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(3)).T
            codes = np.empty(x.shape, width)
            for j, column in enumerate(x):
                codes[j] = column if j in categories else column > edges[j][0] if sizes[j] == 2 else np.searchsorted(edges[j], column)
            head = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            parts.append((head[0], head[1].astype(np.int16), head[2], codes))
            rows += batch.num_rows
            if rows >= size:
                yield block(parts)
                parts, rows = [], 0
        if parts:
            yield block(parts)

    place = F.xxhash64(F.col(key), F.lit(seed)).alias("place")
    indexed = PipelineModel(stages[:-1]).transform(folded)
    flags = {c for c, kind in indexed.dtypes if kind == "boolean"}
    # The lambda keeps the wide row out of the whole-stage method, which would be too long for the JVM to compile.
    x = F.transform(F.array(*[F.col(c).cast("int") if c in flags else F.col(c) for c in inputs]), lambda v: v.cast("double"))
    vectors = indexed.select(place, "fold", label, x.alias("x"))
    return Coded(stage(vectors.mapInArrow(code, "n long, zeros long, keys binary, folds binary, bits binary, codes binary")), Layout(sizes, cuts, categories))


@dataclass
class Tree:
    """Nodes by number: 1 is the root, 2n and 2n + 1 follow n. ``splits`` hold input and last bin, or the categories, to the left."""

    depth: int
    splits: dict[int, tuple[int, int | np.ndarray]] = field(default_factory=dict)
    counts: dict[int, tuple[int, int]] = field(default_factory=dict)
    open: list[int] = field(default_factory=lambda: [1])
    tried: np.ndarray | None = None

    def draw(self, inputs: int, rng: np.random.Generator) -> None:
        """The inputs that each open node tries."""
        some = math.ceil(math.sqrt(inputs))
        self.tried = np.sort(rng.random((len(self.open), inputs)).argsort(axis=1)[:, :some], axis=1)

    def offsets(self, bins: np.ndarray) -> np.ndarray:
        """Where the counts of each open node's inputs begin, and the end."""
        return np.concatenate(([0], np.cumsum(bins[self.tried].ravel())))

    def leads(self, at: int, columns: Sequence[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        feature, cut = self.splits[at]
        bin_of = columns[feature].take(rows)
        left = cut.take(bin_of) if isinstance(cut, np.ndarray) else ~bin_of if bin_of.dtype == bool else bin_of <= cut
        return rows.compress(left), rows.compress(~left)

    def count(self, columns: Sequence[np.ndarray], bins: np.ndarray, rows: np.ndarray, zeros: int) -> np.ndarray:
        """Rows of both classes in every bin of the open nodes' inputs, then in the nodes.

        Positions below ``zeros`` are of class 0, and all of them come first in ``rows``.
        """
        starts = self.offsets(bins)
        out = np.zeros((2, starts[-1] + len(self.open)), np.int32)
        number = {node: i for i, node in enumerate(self.open)}
        waiting = [(1, rows)]
        while waiting:
            node, rows = waiting.pop()
            if node in self.splits:
                left, right = self.leads(node, columns, rows)
                waiting += [(2 * node, left), (2 * node + 1, right)]
            elif node in number and len(rows):
                i, first = number[node], int(np.searchsorted(rows, zeros))
                out[:, starts[-1] + i] = first, len(rows) - first
                for at, feature in zip(starts[i * self.tried.shape[1] :].tolist(), self.tried[i].tolist(), strict=False):
                    n = bins[feature]
                    if n == 1:
                        continue
                    values = columns[feature].take(rows)
                    for y, part in enumerate((values[:first], values[first:])):
                        if n == 2:
                            ones = np.count_nonzero(part)
                            out[y, at], out[y, at + 1] = len(part) - ones, ones
                        else:
                            out[y, at : at + n] = np.bincount(part, minlength=n)
        return out

    def best(self, out: np.ndarray, bins: np.ndarray, categories: set[int]) -> list[tuple]:
        """(gain, input, cut, left counts, counts) of each open node."""
        starts = self.offsets(bins)
        counts, totals = out[:, : starts[-1]], out[:, starts[-1] :]
        segment = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        node = segment // self.tried.shape[1]
        order = np.arange(starts[-1])
        if categories:
            seen = counts.sum(axis=0)
            rate = np.where(seen > 0, counts[1] / np.maximum(seen, 1), 2.0)
            ranked = np.isin(self.tried.ravel(), list(categories))[segment]
            order = np.lexsort((np.where(ranked, rate, order - starts[segment]), segment))
            counts = counts[:, order]
        summed = np.cumsum(counts, axis=1)
        left = summed - np.concatenate((np.zeros((2, 1), np.int64), summed), axis=1)[:, starts[segment]]
        whole = totals[:, node]
        right = whole - left
        nl, nr, n = left.sum(axis=0), right.sum(axis=0), whole.sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = 2 / n * (whole[0] / n * whole[1] - left[0] / nl * left[1] - right[0] / nr * right[1])
        gain[(nl == 0) | (nr == 0)] = 0.0
        begin = starts[:-1 : self.tried.shape[1]]
        top = np.maximum.reduceat(gain, begin)
        first = np.flatnonzero(gain == top[node])
        first = first[np.unique(node[first], return_index=True)[1]]
        found = []
        for i, at in enumerate(first.tolist()):
            of = segment[at]
            feature, cut = int(self.tried.ravel()[of]), at - int(starts[of])
            if feature in categories:
                cut = np.zeros(bins[feature], bool)
                cut[order[starts[of] : at + 1] - starts[of]] = True
            found.append((float(top[i]), feature, cut, tuple(left[:, at].tolist()), tuple(totals[:, i].tolist())))
        return found

    def grow(self, found: list[tuple]) -> None:
        """Split the open nodes; those of their children that are of both classes and not at full depth are open then."""
        opened = []
        for node, (gain, feature, cut, left, counts) in zip(self.open, found, strict=True):
            self.counts[node] = counts
            if gain <= 0 or node.bit_length() > self.depth:
                continue
            self.splits[node] = (feature, cut)
            right = (counts[0] - left[0], counts[1] - left[1])
            for child, own in ((2 * node, left), (2 * node + 1, right)):
                self.counts[child] = own
                if min(own) > 0 and child.bit_length() <= self.depth:
                    opened.append(child)
        self.open, self.tried = opened, None

    def prune(self) -> None:
        """Make one leaf of two that vote alike."""
        for node in sorted(self.splits, reverse=True):
            if 2 * node not in self.splits and 2 * node + 1 not in self.splits:
                (a, b), (c, d) = self.counts[2 * node], self.counts[2 * node + 1]
                if (b > a) == (d > c):
                    del self.splits[node]

    def add_rates(self, columns: Sequence[np.ndarray], rows: np.ndarray, onto: np.ndarray) -> None:
        """Add each row's share of class 1 in its leaf."""
        waiting = [(1, rows)]
        while waiting:
            node, rows = waiting.pop()
            if node in self.splits:
                left, right = self.leads(node, columns, rows)
                waiting += [(2 * node, left), (2 * node + 1, right)]
            elif len(rows):
                no, yes = self.counts[node]
                onto[rows] += yes / (no + yes) if no + yes else 0.0


@dataclass
class Rows:
    """Coded rows of a task, those of class 0 first."""

    zeros: int
    keys: np.ndarray
    columns: list[np.ndarray]

    def bag(self, factor: np.uint64) -> np.ndarray:
        """Positions of the rows in a tree's bag, each as often as it is in the bag, class 0 first."""
        parts = [np.zeros(0, np.intp)]
        for first, last in ((0, self.zeros), (self.zeros, len(self.keys))):
            for a in range(first, last, DRAWN):
                times = POISSON.take((self.keys[a : min(a + DRAWN, last)] * factor >> np.uint64(48)).astype(np.intp))
                some, n = np.flatnonzero(times), 1
                while len(some):
                    parts.append(some + a)
                    n += 1
                    some = some.compress(times.take(some) >= n)
        return np.concatenate(parts)


def _joined(parts: list[tuple], bins: Sequence[int], tables: dict[int, np.ndarray]) -> Rows:
    """Blocks together, as the bins of one fold."""

    def joined(arrays: list[np.ndarray]) -> np.ndarray:
        zeros = [p[0] for p in parts]
        return np.concatenate([a[:n] for a, n in zip(arrays, zeros, strict=True)] + [a[n:] for a, n in zip(arrays, zeros, strict=True)])

    columns = []
    for j, n in enumerate(bins):
        column = joined([p[2][j] for p in parts])
        columns.append(tables[j].take(column) if j in tables else column)
        if n == 2:
            columns[j] = columns[j].astype(bool, copy=False)
    return Rows(sum(p[0] for p in parts), joined([p[1] for p in parts]), columns)


def _taken(batches: Iterator[pa.RecordBatch], layout: Layout, fold: int, held_out: bool) -> Iterator[Rows]:
    """The rows of a task that are in ``fold``, or those that are not, as many blocks at a time as ``TASK_BYTES`` hold."""
    two = np.array(layout.sizes) == 2
    bins, tables, width = layout.bins(fold), layout.tables(fold), _width(layout.sizes)
    parts, held = [], 0
    for batch in batches:
        for n, zeros, *raw in zip(*batch.columns, strict=True):
            n, zeros = n.as_py(), zeros.as_py()
            keys, folds, bits, codes = (np.frombuffer(r.as_buffer(), t) for r, t in zip(raw, (np.uint64, np.int16, np.uint8, width), strict=True))
            flags = iter(np.unpackbits(bits.reshape(two.sum(), -(-n // 8)), axis=1, count=n).view(bool))
            others = iter(codes.reshape((~two).sum(), n))
            mine = np.flatnonzero((folds == fold) == held_out)
            columns = [next(flags if b else others).take(mine) for b in two]
            parts.append((int(np.searchsorted(mine, zeros)), keys.take(mine), columns))
            held += n * len(two)
            if held >= TASK_BYTES:
                yield _joined(parts, bins, tables)
                parts, held = [], 0
    if parts:
        yield _joined(parts, bins, tables)


def _chooser(shared: Broadcast, bins: np.ndarray, categories: set[int]) -> Callable[[pa.Table], pa.Table]:
    """Add up the counts of a tree and choose the splits of its open nodes."""

    def choose(parts: pa.Table) -> pa.Table:
        t = parts["tree"][0].as_py()
        out = np.zeros(len(parts["counts"][0].as_buffer()) // 8, np.int64)
        for counts in parts["counts"]:
            out += np.frombuffer(counts.as_buffer(), np.int64)
        found = pickle.dumps(shared.value[t].best(out.reshape(2, -1), bins, categories))
        return pa.table({"tree": [t], "found": pa.array([found], pa.binary())})

    return choose


def fit_fold(coded: Coded, fold: int, trees: int = 100, depth: int = 8, seed: int = 1) -> list[Tree]:
    """The trees of the rows that are not in ``fold``: for every level, one sum over all blocks."""
    rng = np.random.default_rng([seed, fold])
    factors = rng.integers(0, 1 << 63, trees, np.uint64) * np.uint64(2) + np.uint64(1)
    layout = coded.layout
    bins = np.array(layout.bins(fold))
    forest = [Tree(depth) for _ in range(trees)]
    context = coded.blocks.sparkSession.sparkContext
    while growing := [t for t in range(trees) if forest[t].open]:
        for t in growing:
            forest[t].draw(len(bins), rng)
        shared = context.broadcast(forest)

        def count(batches: Iterator[pa.RecordBatch], shared=shared, growing=growing) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for rows in _taken(batches, layout, fold, held_out=False):
                for t in growing:
                    out = shared.value[t].count(rows.columns, bins, rows.bag(factors[t]), rows.zeros)
                    sums[t] = sums[t] + out if t in sums else out.astype(np.int64)
            for t, out in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([out.tobytes()], pa.binary())], names=["tree", "counts"])

        sums = coded.blocks.mapInArrow(count, "tree long, counts binary")
        found = sums.groupBy("tree").applyInArrow(_chooser(shared, bins, layout.categories), "tree long, found binary").collect()
        chosen = {r["tree"]: pickle.loads(r["found"]) for r in found}
        for t in growing:  # without any row there are no counts
            forest[t].grow(chosen.get(t, [(0.0, 0, 0, (0, 0), (0, 0))]))
        shared.unpersist()
    for tree in forest:
        tree.prune()
    return forest


def score_fold(coded: Coded, fold: int, forest: Sequence[Tree], label: str) -> DataFrame:
    """(``fold``, label, ``pred``) of the rows in ``fold``: the mean share of class 1 over the trees."""
    layout = coded.layout
    shared = coded.blocks.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _taken(batches, layout, fold, held_out=True):
            own = np.arange(len(rows.keys))
            total = np.zeros(len(own))
            for tree in shared.value:
                tree.add_rates(rows.columns, own, total)
            scored = [np.full(len(own), fold, np.int32), (own >= rows.zeros).astype(np.float64), total / len(shared.value)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in scored], names=["fold", label, "pred"])

    return coded.blocks.mapInArrow(score, f"fold int, `{label}` double, pred double")
