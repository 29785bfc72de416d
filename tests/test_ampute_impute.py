"""Planting gaps and filling them: rates, invariants, quality on planted data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.functions.neighbours import nearest
from gapweave.operators import ampute as A
from gapweave.operators import metrics as M
from gapweave.operators.impute import ImputerError, get_imputer, impute, register
from gapweave.operators.impute.base import Imputer
from gapweave.operators.impute.chained import IceImputer
from test_core import matrix

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    df, _, _ = matrix(spark, n=1500, seed=3)
    return df.persist()


@pytest.mark.parametrize("mecha,opt", [("MCAR", "logistic"), ("MAR", "logistic"), ("MNAR", "logistic"), ("MNAR", "selfmasked")])
def test_rates(planted, mecha, opt):
    mask = A.plan_mask(planted, COLS, 0.3, mecha, 5, opt=opt)
    n = planted.count()
    out = mask.apply(planted).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in COLS]).first()
    for c in COLS:
        if mecha == "MAR" and c in mask.inputs:
            assert out[c] == 0
        else:
            assert abs(out[c] / n - 0.3) < 4 * math.sqrt(0.21 / n)
    if mask.probabilities:
        got = planted.agg(*[F.avg(p).alias(c) for c, p in mask.probabilities.items()]).first()
        assert all(abs(v - 0.3) < 1e-9 for v in got)


@pytest.mark.parametrize("mecha,opt", [("MCAR", "logistic"), ("MAR", "logistic"), ("MNAR", "logistic"), ("MNAR", "selfmasked")])
def test_edge_rates(planted, mecha, opt):
    for p in (0.0, 1.0):
        mask = A.plan_mask(planted, COLS, p, mecha, 5, opt=opt)
        gone = mask.apply(planted).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in mask.conditions]).first()
        assert all(v == (planted.count() if p else 0) for v in gone)


def test_mask_ignores_partitions(planted):
    want = None
    for parts in (1, 7, 64):
        rows = A.ampute_preset(planted.repartition(parts), COLS, 0.4, "MNAR-QUANTILE", 2).orderBy("row_id").collect()
        want = want or rows
        assert rows == want


def test_single_column_mar_and_bad_input(spark, planted):
    one = planted.select("row_id", "a")
    assert A.ampute(one, ["a"], 0.5, "MAR", 1).where("a is null").count() == 0
    with pytest.raises(ValueError):
        A.ampute_preset(planted, COLS, 0.5, "NOPE", 1)
    with pytest.raises(ValueError):
        A.ampute(planted, COLS, 1.5)
    with pytest.raises(ValueError):
        A.ampute_numeric(planted, COLS, 101, "MCAR", 1)
    with pytest.raises(ValueError):  # rank 0 of three rows
        A.mnar_quantile(planted.limit(3), COLS, 0.5, 1)


def test_quantile_cuts(planted):
    for cut in ("upper", "lower"):
        mask = A.mnar_quantile(planted, COLS, 1.0, 3, q=0.25, cut=cut)
        c = mask.inputs[0]
        got = planted.where(mask.conditions[c]).count() / planted.count()
        assert 0.24 < got < 0.27
    extra = A.mnar_quantile(planted, COLS, 0.2, 3, extra_mcar=True)
    assert set(extra.conditions) == set(COLS)


def test_blank_fraction_is_exact(planted):
    out = A.blank_fraction(planted, COLS, 0.2, 1)
    assert all(out.where(F.col(c).isNull()).count() == 300 for c in COLS)


def gappy(planted, p=0.25):
    return A.ampute(planted, COLS, p, "MCAR", 9, keep_truth=True)


def judge(filled):
    r = filled.agg(M.rmse(COLS).alias("rmse"), F.max(F.greatest(*[
        F.when(~F.col(f"{c}__mis"), F.abs(F.col(c) - F.col(f"{c}__true"))).otherwise(F.lit(0.0)) for c in COLS])).alias("moved"),
        F.count_if(F.greatest(*[F.col(c).isNull() for c in COLS])).alias("left")).first()
    assert r["left"] == 0 and r["moved"] < 1e-9
    return r["rmse"]


@pytest.mark.parametrize("name,params,wins", [
    ("MEAN", {}, False), ("knn", {}, True), ("ice", {}, True), ("missforest", {"trees": 5, "depth": 5, "max_rounds": 2}, True),
    ("MLP2", {"max_epochs": 20}, True), ("mlp_regress", {}, True), ("linear_regress", {}, True),
    ("GAIN4", {"grid": {"max_epochs": [3]}}, False),
    ("VAE", {"grid": {"max_epochs": [3], "n_layers": [0, 2], "latent_dim_rel_size": [0.5], "layer_1_rel_size": [0.75]}}, False),
])
def test_imputers(planted, name, params, wins):
    g = gappy(planted).persist()
    mean = judge(impute(g, "mean", COLS))
    got = judge(get_imputer(name, columns=COLS, **params).fit(g).transform(g))
    assert got < mean if wins else math.isfinite(got)


def test_fit_on_train_fill_another_frame(planted):
    g = gappy(planted)
    model = get_imputer("ice", columns=COLS).fit(g.where("row_id < 1000"))
    judge(model.transform(g.where("row_id >= 1000")))


def reference_chain(x, rounds, tol=1e-3):
    """Plain chained Bayesian ridge over a matrix in memory."""
    from gapweave.functions.linear import bayesian_ridge

    gaps = np.isnan(x)
    now = np.where(gaps, np.nanmean(x, 0), x)
    for number in range(rounds):
        old = now.copy()
        for j in np.argsort(gaps.sum(0), kind="stable"):
            o = [i for i in range(x.shape[1]) if i != j]
            rows = ~gaps[:, j]
            xs, ys = now[rows][:, o], now[rows, j]
            mx, my = xs.mean(0), ys.mean()
            xs, ys = xs - mx, ys - my
            coef = bayesian_ridge(xs.T @ xs, xs.T @ ys, ys @ ys, len(ys))
            now[gaps[:, j], j] = (now[gaps[:, j]][:, o] - mx) @ coef + my
        if np.abs(now - old).max() < tol * np.abs(x[~gaps]).max():
            break
    return now, number + 1


def test_ice_equals_plain_chain_in_two_scans(spark):
    df, x, _ = matrix(spark, n=400, seed=5, gaps=0.3)
    want, rounds = reference_chain(x, 50)
    model = IceImputer(COLS).fit(df)
    assert model.rounds == rounds and model.scans <= 2
    got = np.array([[r[c] for c in COLS] for r in model.transform(df).orderBy("row_id").collect()])
    assert np.allclose(got, want, atol=1e-6)
    by_rows = IceImputer(COLS, max_patterns=1).fit(df)
    got = np.array([[r[c] for c in COLS] for r in by_rows.transform(df).orderBy("row_id").collect()])
    assert by_rows.rounds == rounds and np.allclose(got, want, atol=1e-6)


def brute_distances(q, d):
    out = np.full((len(q), len(d)), np.nan)
    for i in range(len(q)):
        for j in range(len(d)):
            both = ~np.isnan(q[i]) & ~np.isnan(d[j])
            if both.any():
                out[i, j] = len(q[i]) / both.sum() * ((q[i][both] - d[j][both]) ** 2).sum()
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_knn_equals_brute_force(spark, monkeypatch, block):
    import gapweave.functions.neighbours as nb

    monkeypatch.setattr(nb, "BLOCK", block)
    df, x, _ = matrix(spark, n=300, seed=8, gaps=0.3)
    dist = brute_distances(x, x)
    want = x.copy()
    for i, j in zip(*np.nonzero(np.isnan(x))):
        ok = [t for t in range(len(x)) if not np.isnan(x[t, j]) and not np.isnan(dist[i, t])]
        near = sorted(ok, key=lambda t: (dist[i, t], t))[:5]
        want[i, j] = x[near, j].mean() if near else np.nanmean(x[:, j])
    got = impute(df, "knn", COLS).orderBy("row_id").collect()
    assert np.allclose([[r[c] for c in COLS] for r in got], want)


def test_knn_with_a_third_of_rows_equal(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(900, 2)), 2)
    x[:300] = 0.5
    rows = [(i, float(a), float(b), float(i)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, y double")
    got = nearest(df, df, ["a", "b"], ["y"], 2, exclude_self=True).collect()
    found = {}
    for r in got:
        found.setdefault(r["row_id"], {})[r["rank"]] = r["donor_id"]
    for i in range(0, 900, 7):
        order = sorted((t for t in range(900) if t != i), key=lambda t: (((x[i] - x[t]) ** 2).sum(), t))[:2]
        assert [found[i][1], found[i][2]] == order


def test_gain_and_vae_gradients():
    from gapweave.functions.training import params
    from gapweave.operators.impute.generative import GAIN_GRID, VAE_GRID, _gain_losses, _GainTask, _VaeTask, grid_points

    rng = np.random.default_rng(0)
    t = _GainTask(3, grid_points(GAIN_GRID, None)[0])
    s = t.start(0)
    g, d = params(s[: t.cut]) + 0.05, params(s[t.cut:]) + 0.05
    x, m = rng.random((8, 3)), (rng.random((8, 3)) < 0.7).astype(float)
    h = m * (rng.random((8, 3)) < 0.9)
    _, _, gg, dg = _gain_losses(g, d, t.sizes, x, m, h, 10.0)
    for theta, grad, which in ((g, gg, 0), (d, dg, 1)):
        for k in rng.choice(theta.size, 12, replace=False):
            up, down = theta.copy(), theta.copy()
            up[k] += 1e-6
            down[k] -= 1e-6
            f = (lambda v: _gain_losses(v, d, t.sizes, x, m, h, 10.0)[0]) if which == 0 else (lambda v: _gain_losses(g, v, t.sizes, x, m, h, 10.0)[1])
            assert abs((f(up) - f(down)) / 2e-6 - grad[k]) < 1e-4
    v = _VaeTask(4, grid_points(VAE_GRID, {"n_layers": [2]})[0])
    state = v.start(1)
    losses = []
    rows = rng.random((64, 4)) * 0.2 + 0.7
    for _ in range(300):
        state, loss = v.step(state, rows, rng)
        losses.append(loss)
    assert np.mean(losses[-20:]) < np.mean(losses[:20])
    assert len(grid_points(VAE_GRID, None)) == 12 and len(grid_points(VAE_GRID, {"junk": [1, 2]})) == 12


def test_generative_targets_and_categories(spark):
    rows = [(i, float(i % 7), "xyz"[i % 3] if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, a double, k string")
    model = get_imputer("gain4", columns=["a", "k"], grid={"max_epochs": [2]}, targets=["k"]).fit(df)
    out = model.transform_with_mask(df)
    assert out.where("k is null or k not in ('x', 'y', 'z')").count() == 0
    assert out.where("k__imputed").count() == 40


def test_registry_and_errors(planted, spark):
    with pytest.raises(ImputerError):
        get_imputer("nothing")
    with pytest.raises(ImputerError):
        impute(planted, "mean", ["zz"])
    with pytest.raises(ImputerError):
        get_imputer("linear_regress", columns=COLS).fit(planted.limit(1))

    class Zero(Imputer):
        def fit(self, train):
            class Filled:
                def transform(_, df):
                    return df.fillna(0.0, self.columns)
            return Filled()

    register("zero", Zero)
    assert impute(A.ampute(planted, COLS, 1.0), "ZERO", COLS).where("a <> 0").count() == 0


def test_empty_column_and_empty_mask(spark):
    df = spark.createDataFrame([(i, float(i), None) for i in range(20)], "row_id long, a double, b double")
    out = impute(df, "mean", ["a", "b"])
    assert out.where("b is not null").count() == 0
    same = A.ampute(df.select("row_id", "a"), ["a"], 0.0, "MCAR", 1, keep_truth=True)
    row = same.agg(M.rmse(["a"]).alias("r"), M.mask_size(["a"]).alias("n")).first()
    assert row["r"] is None and row["n"] == 0


def test_join_and_inline_scores_agree(planted):
    g = gappy(planted)
    filled = impute(g, "mean", COLS)
    inline = filled.agg(M.rmse(COLS), M.mae(COLS)).first()
    joined = M.compare(planted, g, filled, COLS).agg(M.rmse(COLS), M.mae(COLS)).first()
    assert np.allclose(inline, joined)
    n1 = M.normalized_rmse(planted, g, filled.select("row_id", *COLS), COLS).first()[0]
    assert abs(n1 - M.normalized_rmse_inline(filled, COLS).first()[0]) < 1e-12


def test_donors_alike_are_cut_to_the_lowest_ids_before_a_search(spark, monkeypatch):
    """Few values, so most donors are alike in what a query has; against a plain search over all pairs."""
    from gapweave.functions import neighbours

    rng = np.random.default_rng(9)
    x = np.column_stack([rng.integers(0, 3, 400), rng.integers(0, 4, 400), rng.random(400).round(2)]).astype(float)
    x[rng.random(x.shape) < 0.3] = np.nan
    cols = ["a", "b", "c"]
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "row_id long, a double, b double, c double")
    met, search = [], neighbours._search

    def counted(queries, donors, *rest):
        met.append(donors.count())
        return search(queries, donors, *rest)

    monkeypatch.setattr(neighbours, "_search", counted)
    got = {(r.row_id, r.target, r["rank"]): r.donor_id for r in neighbours.nearest(df, df, cols, cols, 2, per_target=True).collect()}
    want = {}
    for i in range(len(x)):
        for j, t in enumerate(cols):
            if np.isnan(x[i, j]):
                both = ~np.isnan(x[i]) & ~np.isnan(x)
                n = both.sum(1)
                near = sorted((np.where(both, (x - x[i]) ** 2, 0.0).sum(1)[m] * 3 / n[m], m) for m in range(len(x)) if n[m] and not np.isnan(x[m, j]))
                want |= {(i, t, r + 1): m for r, (_, m) in enumerate(near[:2])}
    assert got == want
    # a query with a alone: three values, two ids each, two targets
    assert min(met) <= 12
