"""Histogram trees against plain searches over all values, on tables with gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.functions import trees
from gapweave.functions.trees import Bins, Growth, Tree, boost


def frame(spark, x, y):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"f{j} double" for j in range(x.shape[1])) + ", y double")


def search(x, g, penalty, min_rows):
    """(gain, feature, limit, missing left) by trying every value as a limit, both sides for missing values."""
    best = None
    for f in range(x.shape[1]):
        gone = np.isnan(x[:, f])
        for limit in np.unique(x[~gone, f]):
            for side in (False, True):
                left = np.where(gone, side, x[:, f] <= limit)
                n = left.sum(), (~left).sum()
                if min(n) < max(min_rows, 1):
                    continue
                gain = g[left].sum() ** 2 / (n[0] + penalty) + g[~left].sum() ** 2 / (n[1] + penalty) - g.sum() ** 2 / (len(g) + penalty)
                if best is None or gain > best[0] + 1e-9 * abs(gain):
                    best = (gain, f, limit, side)
    return best


def grown(x, g, growth, rate):
    """Predictions of a tree grown by plain searches."""
    leaves = [(np.arange(len(g)), 0)]
    while True:
        found = []
        for k, (rows, depth) in enumerate(leaves):
            if growth.depth is None or depth < growth.depth:
                s = search(x[rows], g[rows], growth.penalty, growth.min_rows)
                if s and s[0] > growth.least_gain:
                    found.append((s[0], k, s))
        if not found or (growth.leaves is not None and len(leaves) >= growth.leaves):
            break
        _, k, (_, f, limit, side) = max(found, key=lambda t: t[0])
        rows, depth = leaves.pop(k)
        left = np.where(np.isnan(x[rows, f]), side, x[rows, f] <= limit)
        leaves += [(rows[left], depth + 1), (rows[~left], depth + 1)]
    out = np.empty(len(g))
    for rows, _ in leaves:
        out[rows] = -rate * g[rows].sum() / (len(rows) + growth.penalty)
    return out, len(leaves)


@pytest.mark.parametrize("growth", [Growth(depth=3), Growth(depth=3, penalty=0.0, min_rows=4), Growth(leaves=9, penalty=0.0, min_rows=3), Growth(leaves=31, penalty=0.5)])
@pytest.mark.parametrize("block_rows", [16384, 25])
def test_boosting_equals_plain_searches(spark, monkeypatch, growth, block_rows):
    monkeypatch.setattr(trees, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(trees, "KEEP_EVERY", 2)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((90, 3)).round(1)
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + x[:, 1] * (x[:, 2] > 0) + rng.standard_normal(90) * 0.2
    x[rng.random(x.shape) < 0.25] = np.nan
    y = np.where(np.isnan(x[:, 1]), y + 3, y)  # missing itself tells something
    model = boost(frame(spark, x, y), ["f0", "f1", "f2"], "y", 3, 0.3, growth, "row_id")
    made = np.full(len(y), y.mean())
    for tree in model.trees:
        step, n = grown(x, made - y, growth, 0.3)
        assert tree.n_leaves == n
        made = made + step
    assert np.allclose(model.values(x), made)
    got = {r.row_id: r.p for r in model.predict(frame(spark, x, y), "p").collect()}
    assert np.allclose([got[i] for i in range(len(y))], made)


def test_scans_follow_levels_not_leaves(spark):
    rng = np.random.default_rng(3)
    x = rng.random((600, 2))
    y = np.floor(x[:, 0] * 8) + np.floor(x[:, 1] * 4)
    model = boost(frame(spark, x, y), ["f0", "f1"], "y", 1, 1.0, Growth(leaves=31, penalty=0.0), "row_id")
    assert model.trees[0].n_leaves == 31 and model.scans <= 12


def test_best_leaf_first_beats_equal_depth(spark):
    rng = np.random.default_rng(5)
    x = rng.random((1500, 2))
    y = np.where(x[:, 0] < 0.1, np.floor(x[:, 0] * 300), 0.0)  # all the detail in one corner
    df = frame(spark, x, y)
    first = boost(df, ["f0", "f1"], "y", 1, 1.0, Growth(leaves=31, penalty=0.0), "row_id")
    level = boost(df, ["f0", "f1"], "y", 1, 1.0, Growth(depth=5, penalty=0.0), "row_id")
    assert first.trees[0].n_leaves == 31 and level.trees[0].n_leaves <= 32
    assert ((first.values(x) - y) ** 2).mean() < 0.7 * ((level.values(x) - y) ** 2).mean()


def test_awkward_tables(spark):
    none = spark.createDataFrame([], "row_id long, f0 double, y double")
    model = boost(none, ["f0"], "y", 3, 0.3, Growth(depth=2), "row_id")
    assert model.base == 0.0 and len(model.trees) == 1 and model.trees[0].n_leaves == 1
    one = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 4.0), (3, 1.0, None), (4, 1.0, float("nan"))], "row_id long, f0 double, y double")
    model = boost(one, ["f0"], "y", 3, 0.3, Growth(depth=2), "row_id")
    assert model.base == 3.0 and {r.p for r in model.predict(one, "p").collect()} == {3.0}
    # A side that missing values never took in training goes where the split sends it, without an error.
    gap = frame(spark, np.array([[0.0], [1.0], [2.0], [3.0]]), np.array([0.0, 0.0, 1.0, 1.0]))
    model = boost(gap, ["f0"], "y", 1, 1.0, Growth(depth=1, penalty=0.0), "row_id")
    assert model.values(np.array([[0.5], [2.5], [np.nan]])).tolist() == [0.0, 1.0, 1.0]
    assert Bins.fit(gap, ["f0"]).cuts[0].tolist() == [0.0, 1.0, 2.0]
    assert Tree().add(0.0) == 0 and gap.where(F.col("f0") > 9).count() == 0


def test_boosting_works_out_its_rows_once(spark):
    rng = np.random.default_rng(2)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(v):
        seen.add(1)
        return v

    df = frame(spark, rng.random((200, 2)), rng.random(200)).withColumn("y", told("y"))
    model = boost(df, ["f0", "f1"], "y", 3, 0.3, Growth(depth=2), "row_id")
    assert len(model.trees) == 3 and seen.value == 200


def test_rows_are_parted_down_to_the_wanted_leaves_only():
    tree = Tree()
    root = tree.add(0.0)
    left, right = tree.split(root, trees.Split(1.0, 0, 3, True, (0, 0, 0), (0, 0, 0)), (1.0, 2.0))
    low, high = tree.split(right, trees.Split(1.0, 1, 5, False, (0, 0, 0), (0, 0, 0)), (3.0, 4.0))
    codes = np.array([[0, 9, 9, 255, 9], [7, 5, 6, 0, 255]], np.uint8)
    assert {n: r.tolist() for n, r in tree.rows_of(codes)} == {left: [0, 3], low: [1], high: [2, 4]}
    assert {n: r.tolist() for n, r in tree.rows_of(codes, [high])} == {high: [2, 4]}
    assert tree.predict(codes).tolist() == [1.0, 3.0, 4.0, 1.0, 4.0]


def test_adaboost_equals_a_plain_one(spark):
    """Weighted splits at every value: 60 of them, more than 32 bins hold."""
    from gapweave.operators.regress import AdaBoostRegressor

    rng = np.random.default_rng(11)
    x = rng.permutation(60).astype(float)[:, None]
    y = np.sin(x[:, 0] / 5) + 0.3 * rng.standard_normal(60)
    model = AdaBoostRegressor(["f0"], "y", rounds=6).fit(frame(spark, x, y))

    def plain(rows, w, depth):
        best = None
        for limit in np.unique(x[rows, 0])[:-1] if depth else []:
            parts = [rows[x[rows, 0] <= limit], rows[x[rows, 0] > limit]]
            gain = sum((w[p] @ y[p]) ** 2 / w[p].sum() for p in parts)
            if best is None or gain > best[0] + 1e-9 * abs(gain):
                best = gain, parts
        if best is None:
            return [(rows, w[rows] @ y[rows] / w[rows].sum())]
        return [leaf for p in best[1] for leaf in plain(p, w, depth - 1)]

    w, made, say = np.ones(60), [], []
    for _ in range(6):
        p = np.empty(60)
        for rows, value in plain(np.arange(60), w, 3):
            p[rows] = value
        e = np.abs(y - p)
        loss = w @ e / e.max() / w.sum()
        made.append(p)
        say.append(np.log((1 - loss) / loss))
        w = w * (loss / (1 - loss)) ** (1 - e / e.max())
    assert np.allclose([a for a, _ in model.trees], say)
    order = np.argsort(made, axis=0, kind="stable")
    first = (np.cumsum(np.array(say)[order], axis=0) >= 0.5 * sum(say)).argmax(axis=0)
    want = np.array(made)[order[first, np.arange(60)], np.arange(60)]
    got = {r.row_id: r.prediction for r in model.predict(frame(spark, x, y)).collect()}
    assert np.allclose([got[i] for i in range(60)], want)
    with pytest.raises(ValueError):
        AdaBoostRegressor(["f0"], "y").fit(spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, None)], "row_id long, f0 double, y double"))
