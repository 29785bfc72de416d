"""Regressors, meta-features, sources, plans, variants, recommendation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.model import Descriptor
from gapweave.operators.encode import CategoryCodec, encode_categories, encode_label
from gapweave.operators.metafeatures import ALL, meta_features
from gapweave.operators.regress import AdaBoostRegressor, get_regressor, scores
from gapweave.operators.scale import fit_gain, fit_minmax, fit_standard, round_few_valued
from gapweave.plans.grid import SMALL_PLAN, absent, dataset_table, plan_grid
from gapweave.plans.recommend import Recommender
from gapweave.plans.results import load, ranking, result_frame, winners
from gapweave.plans.runner import Runner
from gapweave.plans.timing import TimedOut, limited
from gapweave.session import new_folder
from gapweave.sources.files import arff_schema, coerce_numeric, read_arff, union_results
from gapweave.sources.registry import Registry, UnknownDataset
from gapweave.sources.synthetic import generate
from gapweave.sources.variants import VariantStore
from test_core import matrix


@pytest.mark.parametrize("name,params", [
    ("MLPregressor", {"max_epochs": 60}), ("AdaBoostRegressor", {"rounds": 4}), ("ridgeregression", {}), ("svregression", {}),
    ("KNN", {}), ("xgboost", {}), ("lightgbm", {"rounds": 8}), ("linearregression", {}),
])
def test_regressors_beat_the_mean(spark, name, params):
    df, _, _ = matrix(spark, n=1200, seed=4)
    train, test = df.where("row_id < 900"), df.where("row_id >= 900")
    model = get_regressor(name, ["a", "b"], "c", **params)
    with pytest.raises(RuntimeError):
        model.predict(test)
    got = model.fit(train).predict_score(test, "y_test")
    assert got["y_test_r2"] > 0.5 and got["y_test_normrmse"] < 0.2
    assert model.predict(test).count() == 300


def test_regression_with_gaps_and_unknown_name(spark):
    df, _, _ = matrix(spark, n=600, seed=4, gaps=0.2)
    known = df.where("c is not null")
    assert scores(get_regressor("xgboost", ["a", "b"], "c").fit(known).predict(known), "c")["y_r2"] > 0.4
    with pytest.raises(ValueError):
        get_regressor("nope", ["a"], "c")


def test_boosting_votes_with_weighted_median(spark):
    df, _, _ = matrix(spark, n=300, seed=1)
    m = AdaBoostRegressor(["a", "b"], "c", rounds=3).fit(df)
    rows = m._vectors(df)
    for i, (_, t) in enumerate(m.trees):
        rows = t.copy({t.predictionCol: f"p{i}"}).transform(rows)
    got = {r["row_id"]: r["prediction"] for r in m.predict(df).collect()}
    for r in rows.collect():
        votes = sorted((r[f"p{i}"], w) for i, (w, _) in enumerate(m.trees))
        acc, half = 0.0, 0.5 * sum(w for w, _ in m.trees)
        for p, w in votes:
            acc += w
            if acc >= half:
                break
        assert got[r["row_id"]] == p


def test_constant_label_scores(spark):
    df = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "y double, prediction double")
    s = scores(df, "y")
    assert s["y_r2"] is None and s["y_normrmse"] is None and s["y_mae"] == 0.5


def test_meta_features_against_pandas(spark):
    import pandas as pd

    df, x, _ = matrix(spark, n=300, seed=6, gaps=0.2)
    df = df.where("c is not null")
    keep = x[~np.isnan(x[:, 2])]
    X, y = pd.DataFrame(keep[:, :2]), pd.Series(keep[:, 2])
    got = meta_features(df, ["a", "b"], "c")
    assert set(got) == set(ALL)
    zero = np.nan_to_num(X.values)
    want = {
        "MF1": np.isnan(X.values).mean(), "MF2": y.nunique(), "MF5": np.nanstd(X.values), "MF6": y.std(), "MF8": zero.mean(),
        "MF14": X.corr().abs().mean().mean(), "MF15": X.corr().abs().std().mean(), "MF16": X.corrwith(y).abs().mean(),
        "MF17": X.corrwith(y).max(), "MF19": X.cov().abs().mean().mean(), "MF26": X.kurtosis().mean(), "MF27": X.skew().mean(),
        "MF28": y.skew(), "MF29": y.kurtosis(), "MF30": np.percentile(zero, 75), "MF31": np.percentile(y, 75), "MF33": np.percentile(zero, 25),
    }
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-8, abs_tol=1e-10), k
    d = ((zero[:, None] - zero[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    ids = [r["row_id"] for r in df.orderBy("row_id").collect()]
    assert ids == sorted(ids)
    assert math.isclose(got["MF23"], float(((y.values - y.values[d.argmin(1)]) ** 2).mean()), rel_tol=1e-9)
    order = np.argsort(y.values, kind="stable")
    assert math.isclose(got["MF22"], float(np.sqrt((np.diff(zero[order], axis=0) ** 2).sum(1)).mean()), rel_tol=1e-9)
    swapped = meta_features(df, ["a", "b"], "c", ["MF10", "MF11"], published_layout=True)
    assert swapped["MF10"] == got["MF11"]
    with pytest.raises(ValueError):
        meta_features(df, ["a"], "c", ["MF99"])


def test_identities_of_the_published_vector():
    n, d = 1199, 11
    assert math.isclose(d / n, 0.009174312, abs_tol=1e-9) and n // d == 109
    assert math.isclose(1.001981475**2, 1.003966877, abs_tol=1e-8)
    assert math.isclose(0.806188945**2, 0.649398547 * n / (n - 1), abs_tol=1e-8)


def test_scalers_on_odd_columns(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 2.0, 4.0)], "row_id int, k double, v double")
    assert [r["k"] for r in fit_standard(df, ["k"]).transform(df).collect()] == [0.0, 0.0]
    assert [r["k"] for r in fit_minmax(df, ["k"]).transform(df).collect()] == [0.0, 0.0]
    s = fit_gain(df, ["k", "v"])
    assert s.inverse(s.transform(df)).orderBy("row_id").collect() == df.collect()
    filled = spark.createDataFrame([(1, 2.5), (2, 3.5)], "row_id int, k double")
    assert [r["k"] for r in round_few_valued(filled, df, ["k"]).orderBy("row_id").collect()] == [2.0, 4.0]


def test_codes_keep_gaps_and_invert(spark, monkeypatch):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "10"), (4, "2")], "row_id int, k string")
    coded = encode_categories(df, ["k"])
    assert [r["k"] for r in coded.orderBy("row_id").collect()] == [2.0, None, 0.0, 1.0]
    codec = CategoryCodec.fit(df, ["k"])
    wild = coded.withColumn("k", F.col("k") * 9 - 3)
    assert [r["k"] for r in codec.inverse(wild).orderBy("row_id").collect()] == ["b", None, "10", "b"]
    import gapweave.operators.encode as e

    monkeypatch.setattr(e, "BROADCAST_CATEGORIES", 2)
    assert encode_categories(df, ["k"]).orderBy("row_id").collect() == coded.orderBy("row_id").collect()
    assert encode_label(coded, "k") is coded


def test_arff(spark, tmp_path):
    p = tmp_path / "x.arff"
    p.write_text("% note\n@relation r\n@attribute 'BI-RADS' numeric\n@ATTRIBUTE kind {'a,b',c}\n@attribute y real\n@data\n1,'a,b',?\n\n% more\n2.5, c ,3\n?,?,4\n")
    assert arff_schema(spark, str(p)).names == ["BI-RADS", "kind", "y"]
    got = [tuple(r) for r in read_arff(spark, str(p)).collect()]
    assert got == [(1.0, "a,b", None), (2.5, "c", 3.0), (None, None, 4.0)]
    with pytest.raises(Exception):
        bad = spark.createDataFrame([("x",)], "v string")
        coerce_numeric(bad, ["v"]).collect()


def test_registry(spark, tmp_path):
    reg = Registry()
    assert reg.names("openml") == ["mammo", "bupa1"] and reg.names("other") == []
    assert reg.descriptor("bupa1").label == "drinks" and reg.descriptor("mammo").contains_missing
    with pytest.raises(UnknownDataset):
        reg.descriptor("zz")
    (tmp_path / "t.csv").write_text("x,t\n1,a\n,b\n")
    reg.add({"name": "t", "kind": "csv", "numeric_columns": ["x"], "text_columns": ["t"], "dropna": "true"})
    _, df = reg.open(spark, "t", str(tmp_path / "t.csv"))
    assert df.count() == 1
    rows = generate(spark, ["n0", "n1"], ["k"], "y", 50).orderBy("row_id").collect()
    assert rows[3]["n0"] == 4 and rows[3]["n1"] == 13 and rows[3]["y"] == 1003


def opener(spark):
    df, _, _ = matrix(spark, n=300, seed=2)
    df = df.withColumn("k", F.when(F.col("a") > 0, "p").otherwise("n"))
    d = Descriptor("m", numeric=("a", "b"), categorical=("k",), text=("k",), label="c")
    return lambda name: (d, df)


def test_plan_layout(spark):
    grid = plan_grid(dataset_table(spark, ["x", "y"]), SMALL_PLAN)
    assert grid.count() == 2 * 2 * (2 + 4)
    with_none = plan_grid(dataset_table(spark, ["x"]), SMALL_PLAN | {"MISSING": [None], "REPEAT": 1})
    assert with_none.where("mecha is null and imputer is null").count() == 4


def test_runner_end_to_end(spark):
    root = new_folder(spark, "runs")
    plan = plan_grid(dataset_table(spark, ["m"]), {
        "SEED": 1, "MISSING": [None, 0.2], "MECHA": ["MAR"], "IMPUTER": ["MEAN", "BROKEN"], "REGRESSOR": ["ridgeregression"],
        "MISSING_REGRESSOR": ["xgboost"]})
    run = Runner(spark, opener(spark), analyze=["MF1", "MF3"], impute_test=True, original_features=True)
    out = run.run_plan(plan, root, "t1").collect()
    assert len(out) == 4
    by = {(r["missing"], r["imputer"], r["regressor"]): r for r in out}
    ok = by[(0.2, "MEAN", "ridgeregression")]
    assert ok["regressor_error"] is False and ok["mask_size"] > 0 and ok["MF3"] == 225 and ok["y_test_imp_rmse"] > 0
    assert ok["x_test_impute_rmse"] > 0 and ok["t_impute"] > 0 and ok["origmf_MF3"] == 225
    assert by[(0.2, "BROKEN", "ridgeregression")]["imputer_error"] is True
    assert by[(0.2, None, "xgboost")]["mask_size"] is None
    stored = load(spark, root, "t1")
    assert stored.count() == 4 and run.run_plan(plan, root, "t1").count() == 0
    assert absent(plan, load(spark, root, "other")).count() == 1
    assert ranking(stored).where("rank = 1").count() >= 2 and winners(stored).count() >= 2


def test_result_union_and_unknown_fields(spark):
    a = spark.createDataFrame([("x", 1)], "ds_name string, p int")
    b = spark.createDataFrame([("y", 2)], "ds_name string, q int")
    assert union_results([a, b]).columns == ["ds_name", "p", "q"]
    with pytest.raises(ValueError):
        result_frame(spark, [{"ds_name": "x", "junk": 1}])


def test_time_limit(spark):
    import time

    def slow():
        def wait(batches):
            time.sleep(30)
            yield from batches
        return spark.range(1).mapInPandas(wait, "id long").count()

    start = time.time()
    with pytest.raises(TimedOut):
        limited(spark, slow, 1.5)
    assert time.time() - start < 25


def test_variants(spark):
    store = VariantStore(spark, new_folder(spark, "v"), opener(spark))
    plain = store.imputed("m", 20, "MCAR", 1, "MEAN", False)
    again = store.imputed("m", 20, "MCAR", 1, "MEAN", False)
    assert plain.orderBy("row_id").collect() == again.orderBy("row_id").collect()
    gaps = store.missing("m", 20, "MCAR", 1, True)
    lo, hi = gaps.agg(F.min("a"), F.max("a")).first()
    assert lo >= 0 and hi <= 1 and gaps.where("a is null").count() > 0
    assert store.timings("m", 20, "MCAR", 1, "MEAN")["impute_time"] > 0
    assert store.clear(imputers=["MEAN"]) == 2 and store.manifest().count() == 4
    assert store.clear() == 4 and store.manifest().count() == 0


def test_recommender(spark):
    rows = [("MAR", float(i), "A" if i < 20 else "B") for i in range(40)] + [("MCAR", float(i), "C") for i in range(10)]
    t = spark.createDataFrame(rows, "mecha string, MF3 double, best string")
    r = Recommender(["MF3"], trees=5).fit(t, "best")
    got = {x["MF3"]: x["recommended"] for x in r.recommend(spark.createDataFrame([(2.0,), (35.0,)], "MF3 double"), "MAR").collect()}
    assert got == {2.0: "A", 35.0: "B"}
    with pytest.raises(ValueError):
        r.recommend(t, "MNAR")


def test_cross_validated_imputer(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.regression import LinearRegression

    from gapweave.operators.impute import ImputerError
    from gapweave.operators.impute.crossval import CrossValidatedImputer

    rows = [(i, float(i) if i % 4 else None, 2.0 * i, ("hi" if i > 60 else "lo") if i % 5 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, k string")
    imp = CrossValidatedImputer((LinearRegression(), {"regParam": [0.0, 5.0]}), (DecisionTreeClassifier(), {"maxDepth": [1, 2]}))
    with pytest.raises(ImputerError):
        imp.transform(df)
    with pytest.raises(ImputerError):
        imp.fit(df, "a")
    with pytest.raises(ImputerError):
        imp.fit(df, ["zz"])
    out = imp.fit(df, ["a", "k"]).transform(df).orderBy("row_id").collect()
    assert all(abs(r["a"] - r["row_id"]) < 1.0 for r in out)
    assert sum(r["k"] != ("hi" if r["row_id"] > 60 else "lo") for r in out) <= 2
    assert sum(r["a__imputed"] for r in out) == 30 and sum(r["k__imputed"] for r in out) == 24
    assert imp.best_parameters()["a"] == {"regParam": 0.0}
    with pytest.raises(ImputerError):
        imp.fit(df, ["a"])


def test_read_with_position_tells_copies_apart(spark, tmp_path):
    from gapweave.model import read_with_position

    spark.createDataFrame([(1, "x")] * 40, "k int, v string").repartition(3).write.parquet(str(tmp_path / "t"))
    df = read_with_position(spark, str(tmp_path / "t"))
    assert df.select("row_id").distinct().count() == 40


def test_other_masters_need_a_shared_folder(spark, monkeypatch):
    import gapweave.session as session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError):
        session.shared_root(Session())
