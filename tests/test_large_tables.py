"""What training and its tables cost as tables grow."""

import time

import numpy as np
import pytest

from gapweave.functions import training as T
from gapweave.operators.impute import generative as g


def test_large_tables_get_larger_shards(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_ROWS", 10)
    monkeypatch.setattr(T, "SHARDS", 4)
    rows = spark.range(400).selectExpr("id AS row_id", "cast(id AS double) AS x")
    few = T.shard(rows.limit(30), ["x"])
    assert few.rdd.getNumPartitions() == 3 and T._between(30, 3) == T.LOCAL
    data = T.shard(rows, ["x"])
    assert data.rdd.getNumPartitions() == 4 and data.count() == 400
    monkeypatch.setattr(T, "SHARD_CELLS", 50)  # more rows than memory has room for make more shards again
    assert T.shard(rows, ["x"]).rdd.getNumPartitions() == 8
    assert T._between(400, 4) == 1 and T._between(100, 4) == 4
    scans = []
    monkeypatch.setattr(T, "summed_arrays", lambda rows, count, made=T.summed_arrays: scans.append(count) or made(rows, count))

    def epoch(models, active, batches, rng):
        n = sum(len(b) for b in batches)
        return [(m + 1.0, n * (1.0 - min(m[0], 2.0) / 2), n) for m in models]

    models, losses = T.average_epochs(data, [np.zeros(1)], epoch, 7, 50, 3, 0.0)
    # every epoch is followed by an average, and training ends with the third epoch without gain
    assert len(scans) == 6 and models[0][0] == 6.0 and losses == [0.0]


def test_minibatches_are_made_anew_without_room(monkeypatch):
    made = []

    def make():
        made.append(1)
        yield from (1, 2)

    small = T.Ready(make, 8)
    assert [list(small), list(small)] == [[1, 2], [1, 2]] and len(made) == 1
    large = T.Ready(make, T.ROOM + 1)
    assert [list(large), list(large)] == [[1, 2], [1, 2]] and len(made) == 3


class Given:
    def __init__(self, noise, hints):
        self.noise, self.hints = noise, hints

    def uniform(self, low, high, shape):
        return self.noise * high

    def random(self, shape):
        return self.hints


@pytest.mark.parametrize("classic", [True, False])
def test_adversarial_pairs_step_together_as_one_by_one(monkeypatch, classic):
    d, rng = 5, np.random.default_rng(3)
    points = g.grid_points(g.GAIN_GRID, {"alpha": [100, 10]})
    tasks, folds = [g._GainTask(d, points[i // 3], classic) for i in range(6)], [None, None, 1, None, 2, 2]
    want = got = [t.start([0, i]) for i, t in enumerate(tasks)]
    active = [True, False] + [True] * 4
    stacks = g._gain_stacks(tasks, active, folds)
    assert sorted(i for s in stacks for i in s.places) == [0, 2, 3, 4, 5]
    for n in (64, 23, 2, 1):
        rows = rng.random((n, d + 1))
        rows[:, :d][rng.random((n, d)) < 0.3] = np.nan
        rows[:, d] = rng.integers(0, 3, n) if n > 2 else 0.0
        drawn = {}

        def draw(self, n, d, rng):
            u, h = rng.random((len(self.places), n, d)), rng.random((len(self.places), n, d))
            drawn.update({i: (u[j].copy(), h[j]) for j, i in enumerate(self.places)})
            return u, h

        monkeypatch.setattr(g._GainStack, "draw", draw)
        got, loss, used = g._run_gain(stacks, got, [rows], rng)
        want = list(want)
        for i, t in enumerate(tasks):
            mine = g._of_fold(rows, folds[i])
            assert used[i] == (len(mine) if active[i] else 0)
            if active[i] and len(mine):
                want[i], value = t.step(want[i], mine, Given(*drawn[i]))
                assert np.isclose(loss[i], value * len(mine), rtol=1e-9)
            assert np.allclose(want[i], got[i], rtol=1e-6, atol=1e-10)


def test_adversarial_pairs_together_cost_less():
    d, rng = 5, np.random.default_rng(4)
    tasks = [g._GainTask(d, g.grid_points(g.GAIN_GRID, None)[0]) for _ in range(5)]
    models, folds = [t.start([0, i]) for i, t in enumerate(tasks)], [None] * 5
    rows = rng.random((40 * 64, d + 1))
    rows[:, :d][rng.random((len(rows), d)) < 0.2] = np.nan
    batches, took = [rows[i: i + 64] for i in range(0, len(rows), 64)], []
    for run in (lambda: g._run(tasks, models, [True] * 5, batches, rng, folds, lambda t, s, r, u: t.step(s, r, u)),
                lambda: g._run_gain(g._gain_stacks(tasks, [True] * 5, folds), models, batches, rng)):
        run()
        began = time.process_time()
        run()
        run()
        took.append(time.process_time() - began)
    assert took[1] < took[0] / 2, took


def test_gapped_orders_are_worked_out_once(spark, tmp_path):
    from checks import learn

    spark.createDataFrame([(i, 100.0 * i) for i in range(50)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i // 2, i % 2, float(i), 3.0 * i) for i in range(100)], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    a = learn.wide_gaps(spark, str(tmp_path))
    assert a.count() == 50 and "Join" not in a._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("depth", [0, 1, 9])
def test_trees_grown_whole_are_those_grown_by_levels(spark, monkeypatch, depth):
    import pyarrow as pa

    from gapweave.functions import forest as R
    from gapweave.functions.trees import BLOCKS, as_block

    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 9, 600), rng.integers(0, 9, 600), rng.normal(size=600)]).astype(float)
    y, cuts = x[0] + (x[1] > 4) * x[2] + rng.normal(0, 0.5, 600), [np.arange(8) + 0.5] * 2 + [np.arange(31) / 8 - 2]
    codes = R.codes_of(x, cuts)
    blocks = [as_block(codes[:, a: a + 100], np.stack([y[a: a + 100], np.full(100, float(a))])) for a in range(0, 600, 100)]
    df, scans = spark.createDataFrame(pa.Table.from_batches(blocks).to_pylist(), BLOCKS).repartition(3), []
    monkeypatch.setattr(R, "_scan", lambda *a, made=R._scan: scans.append(a) or made(*a))
    whole = R.grow(df, cuts, 2.0, 3, depth, [5])
    assert not scans
    monkeypatch.setattr(R, "WHOLE", 600 * (3 + 16) - 1)
    levels = R.grow(df, cuts, 2.0, 3, depth, [5])
    assert len(scans) >= max(depth, 1) - 1
    for a, b in zip(whole.trees, levels.trees, strict=True):
        assert all(np.array_equal(getattr(a, k), getattr(b, k)) for k in ("feature", "cut", "left")) and np.allclose(a.value, b.value)


def test_blocks_and_tasks_of_forests_are_bounded(spark, monkeypatch):
    from gapweave.functions.trees import unblock
    from gapweave.operators.impute import chained as X

    for name, value in (("LEAST_ROWS", 10), ("MOST_ROWS", 20), ("PARTS", 3), ("PART_ROWS", 500)):
        monkeypatch.setattr(X, name, value)
    parts = []
    monkeypatch.setattr(X, "settle_table", lambda df, label: parts.append(df.rdd.getNumPartitions()) or df)
    df = spark.range(1000).selectExpr("id AS row_id", "if(id % 3 = 0, null, cast(id AS double)) AS a", "cast(id AS double) AS b")
    blocks = X._blocks(df, ["a", "b"], {"a": -1.0, "b": 0.0}, "row_id", 1000).toArrow().to_batches()
    made = [(g, v) for b in blocks for g, v in unblock(b, 2, 4)]
    assert parts == [3] and sum(v.shape[1] for _, v in made) == 1000 and max(v.shape[1] for _, v in made) == 20
    gaps, v = np.concatenate([g for g, _ in made], axis=1), np.concatenate([v for _, v in made], axis=1)
    assert np.array_equal(gaps[0] == 1, v[1] % 3 == 0) and np.array_equal(v[0], np.where(gaps[0] == 1, -1.0, v[1])) and not v[3].any()


def test_largest_change_of_a_round():
    from gapweave.functions import forest as R
    from gapweave.operators.impute import chained as X

    gaps = np.array([[1, 0, 1], [1, 1, 0]], np.uint8)
    v = np.array([[0.0, 5.0, 1.0], [0.0, 1.0, 7.0], [1.0, 2.0, 3.0], [9.0, 9.0, 9.0]])
    constant = lambda c: R.Forest([np.zeros(0)], [R.Tree(np.zeros(1, np.int32), np.full(1, 255, np.uint8), np.zeros(1, np.int32), np.full(1, c))], 0)
    once = X._filled(gaps, v, 0, constant(4.0), True)
    assert once[0].tolist() == [4.0, 5.0, 4.0] and once[3].tolist() == [4.0, 0.0, 3.0]
    twice = X._filled(gaps, once, 1, constant(-1.5), False)
    assert twice[1].tolist() == [-1.5, -1.5, 7.0] and twice[3].tolist() == [4.0, 2.5, 3.0] and twice[2].tolist() == [1.0, 2.0, 3.0]


def test_many_forests_fill_in_several_projections(spark, monkeypatch):
    from gapweave.operators.impute import chained as X
    from gapweave.operators.impute.base import get_imputer

    rows = [(i, None if i % 5 == 0 else float(i % 7), None if i % 6 == 0 else float(i % 7) * 3) for i in range(150)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double").withColumn("kept", X.F.col("row_id") + 1)
    model = get_imputer("missforest", columns=["a", "b"], trees=3, depth=3, max_rounds=3).fit(df)
    assert len(model.steps) == 2 * model.rounds
    want = sorted(model.transform(df).collect())
    monkeypatch.setattr(X, "HELD", 1)
    several = model.transform(df)
    assert several.columns == df.columns and sorted(several.collect()) == want


def test_missforest_query_leaves_rounds_to_the_operator(monkeypatch):
    from checks import learn

    asked = []

    class Stop(Exception):
        pass

    def get(name, **params):
        asked.append((name, params))
        raise Stop

    monkeypatch.setattr(learn, "wide_gaps", lambda spark, sf: None)
    monkeypatch.setattr(learn, "impute", lambda *a: type("D", (), {"agg": lambda *a: type("R", (), {"first": lambda self: [1.0]})()})())
    monkeypatch.setattr(learn, "get_imputer", get)
    monkeypatch.setattr(learn.M, "rmse", lambda columns: None)
    with pytest.raises(Stop):
        learn.impute_missforest(None, "")
    assert asked == [("missforest", {"columns": learn.WIDE})]


@pytest.mark.parametrize("lowest, epochs", [(True, 3), (False, 10)])
def test_patience_counts_from_the_lowest_loss(spark, lowest, epochs):
    """Losses that fall by less than the tolerance: scikit-learn's rule ends there, however far they fall together."""
    data = T.shard(spark.range(20).selectExpr("id AS row_id", "cast(id AS double) AS x"), ["x"])

    def epoch(models, active, batches, rng):
        n = sum(len(b) for b in batches)
        return [(m + 1.0, n * (1.0 - 0.06 * m[0]), n) for m in models]

    _, losses = T.average_epochs(data, [np.zeros(1)], epoch, 7, 10, 2, 0.1, lowest=lowest)
    assert np.isclose(losses[0], 1.0 - 0.06 * (epochs - 1))
