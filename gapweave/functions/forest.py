"""Random forests grown level by level over blocks of rows.

A block holds the codes of its rows, a byte a cell, and their labels. How often a row counts in a tree (Poisson of mean one, the
bootstrap of many rows) is drawn anew from the block's own number in every scan, so it needs no room. One scan makes the sums of
all open nodes of all trees; they meet by tree and run of nodes, where the splits are found, so only splits reach the driver. Where there are few rows (WHOLE), a tree is grown by one task over all of them: the same splits, in one job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions.trees import unblock

BINS = 32
#: Values of a feature that stand for a task's rows where the limits of bins are found.
SKETCH = 2048
#: Nodes whose splits are found together.
NODES = 128
#: Bytes of sums that a task makes in one scan.
TOGETHER = 1 << 26
#: Bytes of blocks that one task may hold to grow a whole tree.
WHOLE = 1 << 24
_LEAF = 255


def _draws() -> np.ndarray:
    """How often a row counts, by 16 random bits."""
    share, out, total = math.exp(-1), np.zeros(1 << 16, np.uint8), 0.0
    for k in range(1, 9):
        total += share
        out[min(round(total * (1 << 16)), 1 << 16):] = k
        share /= k
    return out


_COUNT = _draws()


@dataclass
class Tree:
    """Nodes in the order of their making; the right child is behind the left, a leaf is its own left child and sends all rows there."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @classmethod
    def new(cls) -> Tree:
        return cls(np.zeros(1, np.int32), np.full(1, _LEAF, np.uint8), np.zeros(1, np.int32), np.zeros(1))

    def extend(self, open_: np.ndarray, rows: pd.DataFrame, level: int) -> np.ndarray:
        """Takes over the splits of the open nodes; the nodes that are open then."""
        if level == 0:
            self.value[0] = rows["value"].iloc[0]
        rows = rows[rows["feature"] >= 0]
        nodes, first = open_[rows["no"].to_numpy()], len(self.value)
        self.feature[nodes], self.cut[nodes] = rows["feature"], rows["cut"]
        self.left[nodes] = first + 2 * np.arange(len(nodes))
        new = np.arange(first, first + 2 * len(nodes))
        self.feature = np.concatenate([self.feature, np.zeros(len(new), np.int32)])
        self.cut = np.concatenate([self.cut, np.full(len(new), _LEAF, np.uint8)])
        self.left = np.concatenate([self.left, new.astype(np.int32)])
        self.value = np.concatenate([self.value, rows[["left_value", "right_value"]].to_numpy().ravel()])
        return new

    @property
    def size(self) -> int:
        return 17 * len(self.value)

    def nodes_of(self, codes: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
        """The node that each of the rows ``at`` has come to after so many steps."""
        node, flat, n = np.zeros(len(at), np.intp), codes.ravel(), codes.shape[1]
        start, cut, left = self.feature.astype(np.intp) * n, self.cut, self.left.astype(np.intp)
        for _ in range(steps):
            node = left[node] + (flat[start[node] + at] > cut[node])
        return node


@dataclass
class Forest:
    cuts: list[np.ndarray]
    trees: list[Tree]
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean over the trees, for a matrix of rows."""
        codes, at, out = codes_of(x.T, self.cuts), np.arange(len(x)), np.zeros(len(x))
        for t in self.trees:
            out += t.value[t.nodes_of(codes, at, self.depth)]
        return out / len(self.trees)


def codes_of(columns: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(columns.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[j] = np.searchsorted(c, columns[j], "left")
    return out


# --- limits of bins ---------------------------------------------------------


def _reduced(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their counts; beyond ``most``, the values in the middle of equal shares of the rows stand for all."""
    values, back = np.unique(values, return_inverse=True)
    counts = np.bincount(back, counts, len(values))
    if len(values) <= most:
        return values, counts
    ends = np.cumsum(counts)
    at = np.searchsorted(ends, (np.arange(most) + 0.5) * ends[-1] / most)
    return _reduced(values[at], np.full(most, ends[-1] / most), most)


def _limits(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Halfway between neighbouring values: all of them if there are few, else at equal shares of the rows."""
    with np.errstate(over="ignore"):
        half = values[:-1] / 2 + values[1:] / 2
    half = np.where((half >= values[:-1]) & (half < values[1:]), half, values[:-1])
    if len(values) <= bins:
        return half
    ends = np.cumsum(counts)
    at = np.searchsorted(ends, np.arange(1, bins) * ends[-1] / bins)
    return np.unique(half[np.minimum(at, len(half) - 1)])


def limits(blocks: DataFrame, width: int, arrays: int, features: list[int], target: int, bins: int = BINS) -> list[np.ndarray]:
    """Limits of the bins of each feature (numbers of the arrays), over the rows whose code of ``target`` is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.zeros(0), np.zeros(0)) for _ in features]
        for b in batches:
            for codes, v in unblock(b, width, arrays):
                rows = np.flatnonzero(codes[target] == 0)
                for i, f in enumerate(features):
                    x, n = np.unique(v[f][rows], return_counts=True)
                    kept[i] = _reduced(np.concatenate([kept[i][0], x]), np.concatenate([kept[i][1], n]), SKETCH)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(features)), pa.int32()), pa.array([np.stack(k).tobytes() for k in kept], pa.binary())], ["feature", "v"])

    told = [[] for _ in features]
    for r in blocks.mapInArrow(run, "feature int, v binary").collect():
        told[r["feature"]].append(np.frombuffer(r["v"]).reshape(2, -1))
    out = []
    for parts in told:
        values, counts = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0))
        out.append(_limits(*_reduced(values, counts, SKETCH * max(len(parts), 1)), bins) if len(values) else np.zeros(0))
    return out


# --- growing ----------------------------------------------------------------


def _splits(hist: np.ndarray) -> pd.DataFrame:
    """The best split of each node, from (nodes, features, bins, 2) weights and weighted labels; a node that stays whole has feature -1."""
    total = hist[:, 0].sum(axis=1)
    left = np.cumsum(hist, axis=2)
    right = total[:, None, None] - left
    ok = (left[..., 0] > 0.5) & (right[..., 0] > 0.5)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0], -np.inf)
        whole = np.where(total[:, 0] > 0, total[:, 1] ** 2 / total[:, 0], 0.0)
    flat = gain.reshape(len(hist), -1)
    best = flat.max(axis=1)
    # sums are rounded: what is as good as the best, or as no split, counts as equal
    slack = 1e-12 * np.maximum(np.abs(whole), 1e-300)
    at = np.argmax(flat >= (best - slack)[:, None], axis=1)
    f, cut = np.unravel_index(at, gain.shape[1:])
    node = np.arange(len(hist))
    mean = lambda s: np.divide(s[:, 1], s[:, 0], out=np.zeros(len(s)), where=s[:, 0] > 0)
    return pd.DataFrame({"feature": np.where(best > whole + slack, f, -1), "cut": cut, "value": mean(total),
                         "left_value": mean(left[node, f, cut]), "right_value": mean(right[node, f, cut])})


def _often(seed: list[int], tree: int, v: np.ndarray) -> np.ndarray:
    """How often each row of a block counts in a tree."""
    return _COUNT[np.frombuffer(np.random.default_rng([*seed, tree, int(v[1, 0])]).bytes(2 * v.shape[1]), np.uint16)]


def _scan(blocks: DataFrame, trees: dict[int, Tree], open_: dict[int, np.ndarray], level: int, width: int, seed: list[int]) -> pd.DataFrame:
    """Splits of the open nodes (tree, no: place among the tree's open nodes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((2, width, len(open_[t]) * BINS)) for t in trees}
        slot = {}
        for t, tree in trees.items():
            slot[t] = np.full(len(tree.value), -1, np.intp)
            slot[t][open_[t]] = np.arange(len(open_[t])) * BINS
        for b in batches:
            for codes, v in unblock(b, width, 2):
                for t, tree in trees.items():
                    often = _often(seed, t, v)
                    rows = np.flatnonzero(often)
                    place = slot[t][tree.nodes_of(codes, rows, level)]
                    if len(rows) and place.min() < 0:
                        rows, place = rows[place >= 0], place[place >= 0]
                    w = often[rows].astype(float)
                    wy, size = w * v[0][rows], sums[t].shape[2]
                    for f in range(width):
                        cell = place + codes[f][rows]
                        sums[t][0, f] += np.bincount(cell, w, size)
                        sums[t][1, f] += np.bincount(cell, wy, size)
        for t, s in sums.items():
            for at in range(0, len(open_[t]), NODES):
                part = np.ascontiguousarray(s[:, :, at * BINS: (at + NODES) * BINS])
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([at], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["tree", "at", "v"])

    def found(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in pdf["v"])
        out = _splits(total.reshape(2, width, -1, BINS).transpose(2, 1, 3, 0))
        return out.assign(tree=key[0], no=key[1] + np.arange(len(out)))

    made = blocks.mapInArrow(run, "tree int, at int, v binary").groupBy("tree", "at").applyInPandas(
        found, "tree int, no int, feature int, cut int, value double, left_value double, right_value double")
    return made.toPandas()


def _grown_whole(blocks: DataFrame, width: int, trees: int, levels: int, split: bool, seed: list[int]) -> dict[int, Tree]:
    """Trees over so few rows that each is grown by one task; its blocks meet there."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(key[0])
        codes, labels, often = [], [], []
        for c, v in zip(pdf["codes"], pdf["v"]):
            v = np.frombuffer(v).reshape(2, -1)
            count = _often(seed, number, v)
            rows = np.flatnonzero(count)
            codes.append(np.frombuffer(c, np.uint8).reshape(width, -1)[:, rows])
            labels.append(v[0][rows])
            often.append(count[rows])
        codes, w = np.concatenate(codes, axis=1), np.concatenate(often).astype(float)
        wy = w * np.concatenate(labels)
        tree, open_, node, flat = Tree.new(), np.zeros(1, np.intp), np.zeros(len(w), np.intp), codes.ravel()
        at = np.arange(len(w))
        for level in range(levels):
            slot = np.full(len(tree.value), -1, np.intp)
            slot[open_] = np.arange(len(open_)) * BINS
            place = slot[node]
            if len(at) and place.min() < 0:  # rows of leaves that stay
                going = place >= 0
                at, place, node, w, wy = at[going], place[going], node[going], w[going], wy[going]
            size = len(open_) * BINS
            hist = np.empty((2, width, size))
            for f in range(width):
                cell = place + codes[f][at]
                hist[0, f], hist[1, f] = np.bincount(cell, w, size), np.bincount(cell, wy, size)
            rows = _splits(hist.reshape(2, width, -1, BINS).transpose(2, 1, 3, 0))
            open_ = tree.extend(open_, rows.assign(no=np.arange(len(rows))) if split else rows.assign(no=0, feature=-1), level)
            if not len(open_):
                break
            node = tree.left[node].astype(np.intp) + (flat[tree.feature[node].astype(np.intp) * codes.shape[1] + at] > tree.cut[node])
        return pd.DataFrame({"tree": [number], "nodes": [len(tree.value)], "feature": [tree.feature.tobytes()], "cut": [tree.cut.tobytes()],
                             "left": [tree.left.tobytes()], "value": [tree.value.tobytes()]})

    numbers = blocks.sparkSession.range(trees).select(F.col("id").cast("int").alias("tree"))
    made = blocks.crossJoin(F.broadcast(numbers)).repartition(trees, "tree").groupBy("tree").applyInPandas(
        run, "tree int, nodes int, feature binary, cut binary, left binary, value binary").collect()
    kinds = {"feature": np.int32, "cut": np.uint8, "left": np.int32, "value": float}
    return {r["tree"]: Tree(**{k: np.frombuffer(r[k], kind).copy() for k, kind in kinds.items()}) for r in sorted(made, key=lambda r: r["tree"])}


def grow(blocks: DataFrame, cuts: list[np.ndarray], base: float, trees: int, depth: int, seed: list[int]) -> Forest:
    """A forest of regression trees over blocks (codes by feature; labels less ``base``, numbers of the rows). Every split looks at all features."""
    width = len(cuts)
    levels = max(depth, 1) if width else 0
    few = blocks.agg(F.sum(F.length("codes") + F.length("v"))).first()[0] or 0 if levels else 0
    if 0 < few <= WHOLE:
        made = _grown_whole(blocks, width, trees, levels, bool(depth), seed)
        levels = 0
    else:
        made = {t: Tree.new() for t in range(trees)}
    open_ = {t: np.zeros(1, np.intp) for t in range(trees)}
    for level in range(levels):
        at, left = [], list(open_)
        while left:
            group, size = [], 0
            while left and (not group or size + len(open_[left[0]]) * width * BINS * 16 <= TOGETHER):
                group.append(left.pop(0))
                size += len(open_[group[-1]]) * width * BINS * 16
            at.append(_scan(blocks, {t: made[t] for t in group}, {t: open_[t] for t in group}, level, width, seed))
        for t, rows in pd.concat(at).sort_values(["tree", "no"]).groupby("tree"):
            open_[t] = made[t].extend(open_[t], rows if depth else rows.assign(feature=-1), level)
        open_ = {t: n for t, n in open_.items() if len(n)}
        if not open_:
            break
    for tree in made.values():
        tree.value += base
    return Forest(cuts, list(made.values()), depth if width else 0)
