"""Forests grown over blocks, against trees grown on the rows in memory."""

import numpy as np
import pyarrow as pa
import pytest

from gapweave.functions import forest as R
from gapweave.functions.trees import BLOCKS, as_block
from gapweave.operators.impute.base import get_imputer


def brute(codes, y, w, depth):
    """Predictions of a tree on its own rows: the split that leaves the least weighted squares, the first of equals."""
    mean = (w * y).sum() / w.sum()
    best = None
    for f in range(len(codes)) if depth else ():
        for cut in range(R.BINS):
            left = codes[f] <= cut
            if w[left].sum() and w[~left].sum():
                gain = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (left, ~left)) - (w * y).sum() ** 2 / w.sum()
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, left
    out = np.full(len(y), mean)
    if best is not None:
        for s in (best[1], ~best[1]):
            out[s] = brute(codes[:, s], y[s], w[s], depth - 1)
    return out


@pytest.mark.parametrize("nodes", [R.NODES, 1])
def test_forest_against_trees_in_memory(spark, monkeypatch, nodes):
    monkeypatch.setattr(R, "NODES", nodes)
    rng = np.random.default_rng(3)
    sizes, x = (40, 1, 70), rng.integers(0, 9, (3, 111)).astype(float)
    y = x[0] * 2 + (x[1] > 4) * x[2] + rng.normal(0, 0.5, 111)
    cuts = [np.arange(8) + 0.5 for _ in range(3)]
    codes, ends = R.codes_of(x, cuts), np.cumsum((0, *sizes))
    blocks = [as_block(codes[:, a:b], np.stack([y[a:b], np.full(b - a, float(a + 7))])) for a, b in zip(ends, ends[1:])]
    df = spark.createDataFrame(pa.Table.from_batches(blocks).to_pylist(), BLOCKS).repartition(2)
    got = R.grow(df, cuts, 100.0, 3, 4, [5])
    for t, tree in enumerate(got.trees):
        w = np.concatenate([R._COUNT[np.frombuffer(np.random.default_rng([5, t, a + 7]).bytes(2 * (b - a)), np.uint16)] for a, b in zip(ends, ends[1:])])
        own = w > 0
        want = brute(codes[:, own], y[own], w[own].astype(float), 4) + 100.0
        assert np.allclose(tree.value[tree.nodes_of(codes, np.flatnonzero(own), 4)], want)
    assert np.allclose(got.predict(x.T), np.mean([t.value[t.nodes_of(codes, np.arange(111), 4)] for t in got.trees], axis=0))


def test_counts_are_poisson():
    share = np.bincount(R._COUNT, minlength=4)[:4] / len(R._COUNT)
    assert np.allclose(share, np.exp(-1) / np.array([1, 1, 2, 6]), atol=1e-4)


def test_limits_lie_between_values():
    few = np.array([1.0, 2.0, 5.0])
    assert R._limits(few, np.ones(3), 32).tolist() == [1.5, 3.5]
    assert R._limits(np.array([1.0]), np.ones(1), 32).tolist() == []
    next_ = np.nextafter(1.0, 2.0)
    assert R._limits(np.array([1.0, next_]), np.ones(2), 32).tolist() == [1.0]
    x = np.random.default_rng(1).normal(size=50000)
    values, counts = R._reduced(x, np.ones(len(x)), R.SKETCH)
    cuts = R._limits(values, counts, 32)
    assert len(cuts) == 31 and np.allclose(np.bincount(np.searchsorted(cuts, x)) * 32 / len(x), 1.0, atol=0.05)


def test_missforest_gaps_of_all_kinds(spark):
    rows = [(i, None if i % 5 == 0 else float(i % 7), None if i % 7 == 0 else float(i % 7) * 3, None) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, empty double")
    model = get_imputer("missforest", columns=["a", "b", "empty"], trees=5, depth=4, max_rounds=2).fit(df)
    got = {r["row_id"]: r for r in model.transform(df).collect()}
    for i, a, b, _ in rows:
        assert got[i]["empty"] == 0.0 and (a is None or got[i]["a"] == a) and (b is None or got[i]["b"] == b)
        if a is None and b is not None:
            assert abs(got[i]["a"] - i % 7) < 0.2
    with pytest.raises(Exception, match="NaN"):
        model.transform(spark.createDataFrame([(1, float("nan"), 1.0, 1.0)], df.schema)).collect()


def test_missforest_keys_may_repeat_or_be_null(spark):
    rows = [(None if i % 3 == 0 else i // 2, None if i % 4 == 0 else i % 5, None if i % 11 == 0 else float(i % 5)) for i in range(120)] + [(1, None, None)] * 2
    df = spark.createDataFrame(rows, "row_id long, number int, b double")
    got = get_imputer("missforest", columns=["number", "b"], trees=3, depth=3, max_rounds=2).fit(df).transform(df).collect()
    assert len(got) == 122 and all(r["number"] is not None and r["b"] is not None for r in got)
    one = get_imputer("missforest", columns=["b"], trees=3, depth=3, max_rounds=2).fit(df).transform(df).collect()
    mean = np.mean([b for _, _, b in rows if b is not None])
    assert sum(abs(r["b"] - mean) < 1e-9 for r in one) >= sum(b is None for _, _, b in rows)
