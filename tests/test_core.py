"""Randomness, order statistics, ordering, Gram tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.functions.gram import moments, pairwise, pattern_grams
from gapweave.functions.linear import bayesian_ridge, ridge
from gapweave.functions.ordering import with_global_index, with_previous
from gapweave.functions.rng import choose, draw, hash_uniform
from gapweave.functions.selection import lowest_by_hash, order_statistics, quantiles_linear
from gapweave.model import Descriptor, nan_to_null, with_row_id
from gapweave.operators.split import with_split


def matrix(spark, n=500, seed=0, gaps=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[:, 2] = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=n) + 5
    full = x.copy()
    x[rng.random(x.shape) < gaps] = np.nan
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double").repartition(5), x, full


def test_hash_uniform_matches_driver_and_ignores_partitions(spark):
    df = spark.range(200).withColumnRenamed("id", "row_id")
    want = {i: draw(7, "s", "c", str(i)) for i in range(200)}
    for parts in (1, 7, 64):
        got = {r["row_id"]: r["u"] for r in df.repartition(parts).select("row_id", hash_uniform(7, "s", "c").alias("u")).collect()}
        assert got == want
    assert abs(np.mean(list(want.values())) - 0.5) < 0.08
    assert len(choose(list("abcdef"), 3, 1, "x")) == 3


@pytest.mark.parametrize("shape", ["normal", "ties", "wide", "constant"])
def test_order_statistics_are_exact(spark, shape):
    rng = np.random.default_rng(1)
    v = {"normal": rng.normal(size=6000), "ties": np.repeat([1.0, 2.0, 7.0], [3000, 2000, 1000]),
         "wide": np.concatenate([rng.random(5999), [1e12]]), "constant": np.full(6000, 3.5)}[shape]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    s = np.sort(v)
    ks = [1, 17, 3000, 5999, 6000]
    got = order_statistics(df, {"v": ks})
    assert [got[("v", k)] for k in ks] == [s[k - 1] for k in ks]
    q = quantiles_linear(df, {"v": [0.25, 0.5, 0.75]})
    assert np.allclose([q[("v", p)] for p in (0.25, 0.5, 0.75)], np.percentile(v, [25, 50, 75]))
    with pytest.raises(ValueError):
        order_statistics(df, {"v": [0]})


def test_order_statistics_skip_missing(spark):
    df = spark.createDataFrame([(None,), (3.0,), (1.0,), (None,), (2.0,)], "v double")
    assert order_statistics(df, {"v": [2]})[("v", 2)] == 2.0


def test_lowest_by_hash_is_exact_with_equal_draws(spark):
    df = spark.range(9000).withColumnRenamed("id", "row_id")
    coarse = F.floor(hash_uniform(1, "t", "") * 4) / 4.0
    picked = lowest_by_hash(df, {"u": coarse, "none": coarse, "all": coarse}, {"u": 4000, "none": 0, "all": 9000}, "row_id", 9000)
    got = {r["row_id"] for r in df.where(picked["u"]).collect()}
    rows = df.select("row_id", coarse.alias("u")).collect()
    assert got == {r["row_id"] for r in sorted(rows, key=lambda r: (r["u"], r["row_id"]))[:4000]}
    assert df.where(picked["none"]).count() == 0 and df.where(picked["all"]).count() == 9000


@pytest.mark.parametrize("n", [1, 3, 101])
def test_split_sizes(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    assert with_split(df, 3).where("split = 'test'").count() == math.ceil(n / 4)


def test_global_order(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(300)], "row_id long, y double").repartition(9)
    got = with_global_index(df, ["y", "row_id"]).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(300))
    assert [(r["y"], r["row_id"]) for r in got] == sorted((float(i % 3), i) for i in range(300))
    prev = {r["row_id"]: r["prev_row"] for r in with_previous(df.withColumn("row", F.col("row_id").cast("double")), ["y", "row_id"], ["row"]).collect()}
    order = [i for _, i in sorted((float(i % 3), i) for i in range(300))]
    assert prev[order[0]] is None and all(prev[b] == a for a, b in zip(order, order[1:]))


def test_moments_and_ridge(spark):
    df, x, _ = matrix(spark)
    m = moments(df, ["a", "b", "c"])
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.cross, np.cov(x.T, bias=True) * len(x))
    fit = ridge(m, ["a", "b"], "c")
    a = np.column_stack([x[:, :2], np.ones(len(x))])
    want = np.linalg.lstsq(a, x[:, 2], rcond=None)[0]
    assert np.allclose([*fit.coef, fit.intercept], want)


def test_wide_products_agree(spark, monkeypatch):
    df, _, _ = matrix(spark, gaps=0.2)
    small = pairwise(df, ["a", "b", "c"])
    import gapweave.functions.gram as g

    monkeypatch.setattr(g, "SQL_WIDTH", 1)
    wide = g.pairwise(df, ["a", "b", "c"])
    assert np.allclose(small.corr, wide.corr) and np.allclose(small.cov_samp, wide.cov_samp)
    full, _, _ = matrix(spark)
    wide_m = g.moments(full, ["a", "b", "c"])
    monkeypatch.setattr(g, "SQL_WIDTH", 12)
    assert np.allclose(wide_m.cross, g.moments(full, ["a", "b", "c"]).cross)


def test_pairwise_is_pandas_like(spark):
    import pandas as pd

    df, x, _ = matrix(spark, gaps=0.3)
    p = pairwise(df, ["a", "b", "c"])
    frame = pd.DataFrame(x)
    assert np.allclose(p.corr, frame.corr()) and np.allclose(p.cov_samp, frame.cov())


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(9)], "a double, b double")
    assert np.isnan(pairwise(df, ["a", "b"]).corr[0, 1])


def test_pattern_tables_cover_all_rows(spark):
    df, x, _ = matrix(spark, gaps=0.3)
    t = pattern_grams(df, ["a", "b", "c"], 100)
    assert sum(g.n for g in t.groups) == len(x)
    assert np.array_equal(t.seen_counts, (~np.isnan(x)).sum(0))
    assert pattern_grams(df, ["a", "b", "c"], 2) is None


def test_bayesian_ridge_is_least_squares_with_much_data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 2))
    y = x @ [1.0, -2.0] + 0.01 * rng.normal(size=5000)
    x, y = x - x.mean(0), y - y.mean()
    assert np.allclose(bayesian_ridge(x.T @ x, x.T @ y, y @ y, 5000), [1.0, -2.0], atol=1e-3)


def test_descriptor_rules():
    d = Descriptor.from_dict({"name": "n", "kind": "csv", "text_columns": ["t"], "numeric_columns": ["x", 1], "categorical_columns": ["k"], "dropna": "True"})
    assert d.label == "t" and d.dropna and d.features == ["x", 1, "k"]
    with pytest.raises(ValueError):
        Descriptor.from_dict({"name": "n", "kind": "csv"})
    with pytest.raises(ValueError):
        Descriptor.from_dict({"name": "n", "text_columns": ["t"]})


def test_row_ids_and_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "k int, v double")
    assert {r["row_id"] for r in with_row_id(df, "k").collect()} == {"1", "2"}
    assert nan_to_null(df, ["v"]).where("v is null").count() == 1
