"""Trees grown from histograms of binned rows.

Rows are binned once: a byte a cell, the last code for a missing value, in blocks whose number depends on the data alone. A tree
is grown on the driver from sums per (node, feature, bin) that tasks make of their blocks; one scan serves all nodes that may be
split next, and of two siblings only the smaller one is summed, the other being what is left of the parent. So a tree costs about as many scans
as it has levels, and what meets in a scan is bounded by nodes x features x bins, whatever the rows.

Splits are by second-order gain with regularised leaf weights; each split learns to which side missing values go. Trees grow by levels to a
depth, or best leaf first to a number of leaves.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions.training import map_matrix, summed_arrays
from gapweave.session import settle_table

#: Codes 0 to MISSING - 1 are bins of values.
MISSING = 255
WIDTH = MISSING + 1
BLOCK_ROWS = 32768
#: Histograms (node, feature) made in one scan: some 64 MB of sums.
TOGETHER = 1 << 14
#: Trees after which the numbers of rows are written to a table.
KEEP_EVERY = 10


@dataclass(frozen=True)
class Growth:
    """When to split: by levels to ``depth``, or best leaf first to ``leaves``."""

    depth: int | None = None
    leaves: int | None = None
    min_rows: int = 1
    penalty: float = 1.0
    least_gain: float = 1e-6


@dataclass
class Bins:
    """Upper limits of each feature's bins but the last: a value in bin b is at most cuts[b]. ``tops`` are the largest values."""

    cuts: list[np.ndarray]
    tops: list[float | None]

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], bins: int = MISSING) -> Bins:
        """Limits at quantiles over all rows, from one aggregation whose state is bounded. A feature with no more values
        than bins has a limit at each of them."""
        shares = [i / bins for i in range(1, bins)]
        row = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None)), shares, 20000).alias(f"q{i}") for i, c in enumerate(features)],
                     *[F.max(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"m{i}") for i, c in enumerate(features)]).first()
        cuts = [np.unique(np.array(row[f"q{i}"] or [], float)) for i in range(len(features))]
        return cls([c[c < row[f"m{i}"]] if len(c) else c for i, c in enumerate(cuts)], [row[f"m{i}"] for i in range(len(features))])

    def limit(self, feature: int, cut: int) -> float | None:
        """The largest value that goes left; behind the last limit, all values do."""
        return float(self.cuts[feature][cut]) if cut < len(self.cuts[feature]) else self.tops[feature]

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j, cuts in enumerate(self.cuts):
            out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(cuts, x[:, j], "left"))
        return out


@dataclass
class Tree:
    """Nodes in the order of their making; a leaf has no left child."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for own, v in ((self.feature, 0), (self.cut, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, value)):
            own.append(v)
        return len(self.value) - 1

    def split(self, node: int, s: Split, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.missing_left[node] = s.feature, s.cut, s.missing_left
        self.left[node], self.right[node] = self.add(values[0]), self.add(values[1])
        return self.left[node], self.right[node]

    @property
    def n_leaves(self) -> int:
        return sum(x < 0 for x in self.left)

    def rows_of(self, columns: np.ndarray, wanted: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, its rows) for codes by column; of the ``wanted`` leaves only, if given. Rows are parted node by node, and
        parts without a wanted leaf are left at once."""
        keep = np.array(self.left) < 0 if wanted is None else np.zeros(len(self.value), bool)
        if wanted is not None:
            keep[wanted] = True
        for node in range(len(self.value) - 1, -1, -1):
            if self.left[node] >= 0:
                keep[node] = keep[self.left[node]] or keep[self.right[node]]
        open_ = [(0, np.arange(columns.shape[1]))] if keep[0] else []
        while open_:
            node, rows = open_.pop()
            if self.left[node] < 0:
                yield node, rows
                continue
            code = columns[self.feature[node]][rows]
            goes_left = code <= self.cut[node]
            if self.missing_left[node]:
                goes_left |= code == MISSING
            if keep[self.right[node]]:
                open_.append((self.right[node], rows[~goes_left]))
            if keep[self.left[node]]:
                open_.append((self.left[node], rows[goes_left]))

    def predict(self, columns: np.ndarray) -> np.ndarray:
        out = np.empty(columns.shape[1])
        for node, rows in self.rows_of(columns):
            out[rows] = self.value[node]
        return out


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    left: tuple[float, float, float]   # gradients, weights, rows
    right: tuple[float, float, float]


def best_split(hist: np.ndarray, growth: Growth) -> Split | None:
    """Of (features, WIDTH, 3) sums, the split of the highest gain; ties go to the first feature, the lower cut, then missing values right."""
    total = hist[0].sum(axis=0) if len(hist) else np.zeros(3)
    lam = growth.penalty

    def worth(s):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(s[..., 0] ** 2 / (s[..., 1] + lam), nan=0.0, posinf=0.0)

    seen = np.cumsum(hist[:, :MISSING], axis=1)
    missing = hist[:, MISSING:]
    left = np.stack([seen, seen + missing], axis=2)            # missing right, missing left
    right = total - left
    ok = (left[..., 2] >= max(growth.min_rows, 1)) & (right[..., 2] >= max(growth.min_rows, 1))
    gain = np.where(ok, worth(left) + worth(right) - worth(total), -np.inf)
    if not gain.size or not np.isfinite(gain).any():
        return None
    best = gain.max()
    # Sums are rounded: what is as good as the best counts as equal.
    at = int(np.argmax(gain >= best - 1e-9 * max(abs(best), 1e-300)))
    f, cut, side = np.unravel_index(at, gain.shape)
    if best <= growth.least_gain:
        return None
    return Split(float(best), int(f), int(cut), bool(side), tuple(left[f, cut, side].tolist()), tuple(right[f, cut, side].tolist()))


def binned(df: DataFrame, features: list[str], label: str, bins: Bins, row_id: str, start: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(codes by column, v: ``start(labels)``) in blocks of about BLOCK_ROWS rows; rows without a label are left out."""
    rows = df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))).select(row_id, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("y"))
    most = BLOCK_ROWS
    blocks = max(1, math.ceil(rows.count() / most))
    dealt = rows.repartition(blocks, F.col(row_id)).sortWithinPartitions(row_id).drop(row_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for b in batches:
            if len(b):
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float)
                kept.append((bins.codes(x[:-1].T).T, x[-1]))
                n += len(b)
            if n >= most:
                yield _joined(kept, start)
                kept, n = [], 0
        if kept:
            yield _joined(kept, start)

    return settle_table(dealt.mapInArrow(run, BLOCKS), "bins")


BLOCKS = "codes binary, v binary"


def _joined(kept: list, start: Callable) -> pa.RecordBatch:
    return as_block(np.concatenate([c for c, _ in kept], axis=1), start(np.concatenate([y for _, y in kept])))


def as_block(codes: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (codes, v)], ["codes", "v"])


def unblock(b: pa.RecordBatch, width: int, arrays: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes by column, numbers by array) of each block."""
    for codes, v in zip(*b.columns, strict=True):
        v = np.frombuffer(v.as_buffer()).reshape(arrays, -1)
        yield np.frombuffer(codes.as_buffer(), np.uint8).reshape(width, v.shape[1]), v


class Carried:
    """Blocks whose numbers change from tree to tree. A change is kept where the blocks are, so scans need only look at the tree that grows;
    every KEEP_EVERY changes a table is written, which ends the lineage."""

    def __init__(self, blocks: DataFrame, width: int, arrays: int, level: StorageLevel = StorageLevel.MEMORY_AND_DISK_DESER):
        self.width, self.arrays, self.changes, self.level = width, arrays, 0, level
        self.blocks, self.left_behind = blocks.persist(level), []
        self.parts = blocks.rdd.getNumPartitions()

    def change(self, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """``f(codes, numbers) -> numbers`` for every block."""
        width, arrays = self.width, self.arrays

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for codes, v in unblock(b, width, arrays):
                    yield as_block(codes, f(codes, v))

        self.changes += 1
        new = self.blocks.mapInArrow(run, BLOCKS)
        if self.changes % KEEP_EVERY == 0:
            new = settle_table(new, "boost")
        self.left_behind.append(self.blocks)
        self.blocks = new.persist(self.level)
        self.parts = self.blocks.rdd.getNumPartitions()

    def scanned(self) -> None:
        """After a scan the blocks of now are all kept: those before them may go."""
        while self.left_behind:
            self.left_behind.pop().unpersist()

    def close(self) -> None:
        self.scanned()
        self.blocks.unpersist()


def histograms(state: Carried, tree: Tree, nodes: list[int]) -> np.ndarray:
    """(nodes, features, WIDTH, 3): gradients, weights and rows of the wanted leaves of ``tree``. Blocks hold gradients, and weights if
    rows have any of their own."""
    width, arrays = state.width, state.arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(nodes), width, WIDTH, arrays + 1))
        index = {node: i for i, node in enumerate(nodes)}
        for b in batches:
            for codes, v in unblock(b, width, arrays):
                g, w = (v[0], None) if arrays == 1 else (v[0] * v[1], v[1])
                for node, rows in tree.rows_of(codes, nodes):
                    at, own_g, own_w = total[index[node]], g[rows], None if w is None else w[rows]
                    for f in range(width):
                        code = codes[f][rows]
                        at[f, :, 0] += np.bincount(code, own_g, WIDTH)
                        if own_w is not None:
                            at[f, :, 1] += np.bincount(code, own_w, WIDTH)
                        at[f, :, -1] += np.bincount(code, minlength=WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["model", "part", "v"])

    out = summed_arrays(state.blocks.mapInArrow(run, "model int, part long, v binary"), state.parts)
    state.scanned()
    sums = out[0].reshape(len(nodes), width, WIDTH, arrays + 1) if out else np.zeros((len(nodes), width, WIDTH, arrays + 1))
    return sums if arrays == 2 else np.concatenate([sums, sums[..., 1:]], axis=-1)


def grow(summed: Callable[[Tree, list[int]], np.ndarray], width: int, growth: Growth, rate: float) -> tuple[Tree, int]:
    """A tree, and the scans it took. ``summed(tree, nodes)`` makes histograms."""
    per_scan, scans = max(1, TOGETHER // max(width, 1)), 0
    probe = Tree()

    def weight(s) -> float:
        return -rate * s[0] / (s[1] + growth.penalty) if s[1] + growth.penalty > 0 else 0.0

    root = summed(probe, [probe.add(0.0)])[0]
    scans += 1
    total = root[0].sum(axis=0) if width else np.zeros(3)
    probe.value[0] = weight(total)
    hist, split, depth = {0: root}, {0: best_split(root, growth)}, {0: 0}

    def may_split(node: int) -> bool:
        return split[node] is not None and (growth.depth is None or depth[node] < growth.depth)

    while True:
        # Best first among what is known. A leaf whose children are not known yet holds the choice up; those behind it are
        # looked at ahead, which costs sums, not scans.
        chosen, open_, held = 1, [(-split[0].gain, 0)] if may_split(0) else [], []
        while open_ and (growth.leaves is None or chosen < growth.leaves):
            _, node = heapq.heappop(open_)
            chosen += 1
            if probe.left[node] < 0:
                held.append(node)
                continue
            for child in (probe.left[node], probe.right[node]):
                if may_split(child):
                    heapq.heappush(open_, (-split[child].gain, child))
        if not held:
            return _kept(probe, split, depth, growth), scans
        held = sorted(held, key=lambda n: (-split[n].gain, n))[:per_scan]
        small = []
        for node in held:
            s = split[node]
            pair = probe.split(node, s, (weight(s.left), weight(s.right)))
            for child in pair:
                depth[child] = depth[node] + 1
            small.append(pair[0] if s.left[2] <= s.right[2] else pair[1])
        got = summed(probe, small)
        scans += 1
        for node, child, h in zip(held, small, got, strict=True):
            other = probe.left[node] + probe.right[node] - child
            hist[child], hist[other] = h, hist.pop(node) - h
            split[child], split[other] = best_split(h, growth), best_split(hist[other], growth)


def _kept(probe: Tree, split: dict, depth: dict, growth: Growth) -> Tree:
    """The tree that best-first growth makes of the nodes known: looked-ahead splits that it does not come to are dropped."""
    out = Tree()
    at = {0: out.add(probe.value[0])}
    open_ = [(-split[0].gain, 0)] if probe.left[0] >= 0 else []
    leaves = 1
    while open_ and (growth.leaves is None or leaves < growth.leaves):
        _, node = heapq.heappop(open_)
        pair = probe.left[node], probe.right[node]
        made = out.split(at[node], split[node], (probe.value[pair[0]], probe.value[pair[1]]))
        leaves += 1
        for old, new in zip(pair, made, strict=True):
            at[old] = new
            if probe.left[old] >= 0:
                heapq.heappush(open_, (-split[old].gain, old))
    return out


@dataclass
class Boosted:
    """A sum of trees over binned values."""

    features: list[str]
    bins: Bins
    base: float
    trees: list[Tree]
    scans: int

    def values(self, x: np.ndarray) -> np.ndarray:
        codes = np.ascontiguousarray(self.bins.codes(x).T)
        return sum((t.predict(codes) for t in self.trees), np.full(len(x), self.base))

    def predict(self, df: DataFrame, output: str) -> DataFrame:
        return map_matrix(df, [F.col(c) for c in self.features], [output], lambda x: self.values(x)[:, None])


def boost(df: DataFrame, features: list[str], label: str, rounds: int, rate: float, growth: Growth, row_id: str, bins: int = MISSING) -> Boosted:
    """Trees fitted one after another to what is left of the label; it starts at the mean of the labels."""
    # what leads to the rows is worked out once
    df = settle_table(df.select(row_id, *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias(label)), "rows")
    cuts = Bins.fit(df, features, bins)
    y = F.col(label)
    base = float(df.where(~F.isnan(y)).agg(F.avg(y)).first()[0] or 0.0)
    # many short scans; the table behind the kept blocks is there for a lost executor
    state = Carried(binned(df, features, label, cuts, row_id, lambda y: base - y), len(features), 1)
    trees, scans = [], 0
    for i in range(rounds):
        tree, took = grow(lambda t, nodes: histograms(state, t, nodes), len(features), growth, rate)
        scans += took
        trees.append(tree)
        if tree.n_leaves == 1:
            break  # nothing is left to split, now or later
        if i + 1 < rounds:
            state.change(lambda codes, v, tree=tree: v + tree.predict(codes))
    state.close()
    return Boosted(features, cuts, base, trees, scans)
