"""Model-based imputers and regressors."""

from pyspark.sql import functions as F

from checks.common import LABEL, LINE, LINE_SQL, PART_SQL, SEED, WIDE_SQL, lines, mcar_sql, parts, query, u_sql, wide
from checks.impute import KCOLS, PART3_SQL, part3
from checks.metafeatures import residual_sql
from gapweave.operators import metrics as M
from gapweave.operators.ampute import ampute
from gapweave.operators.impute.base import get_imputer, impute
from gapweave.operators.impute.column import least_missing
from gapweave.operators.regress import get_regressor, score_row
from gapweave.operators.scale import fit_standard
from gapweave.session import settle_table

WIDE = ["qty", "price", "items", "last_line", "o_totalprice"]


def wide_gaps(spark, sf, keep=True):
    """Scaled order features (strongly correlated), 20 % gaps, the truth kept beside them. Worked out once, not for each scan."""
    t = settle_table(wide(spark, sf), "wide")
    return settle_table(ampute(fit_standard(t, WIDE).transform(t), WIDE, 0.2, "MCAR", SEED, keep_truth=keep), "gaps")


def _std(c, t="w"):
    return f"({c} - (SELECT avg({c}) FROM {t})) / (SELECT stddev_pop({c}) FROM {t}) AS {c}"


WIDE_BASE = f"w AS ({WIDE_SQL}), t AS (SELECT row_id, {', '.join(_std(c) for c in WIDE)} FROM w), a AS ({mcar_sql(WIDE, 0.2, 't')})"


def verdict(filled, columns, base=None, more=()):
    """What must hold for any imputer, and whether it beats the column mean (errors are over the same cells)."""
    mean_err = M.rmse(columns) if base is None else base
    kept = [F.count_if(~F.col(f"{c}__mis") & ~(F.abs(F.col(c) - F.col(f"{c}__true")) < 1e-9)) for c in columns]
    return filled.agg(
        F.count("*").alias("n_rows"), M.mask_size(columns).alias("n_filled"),
        sum(kept[1:], kept[0]).alias("changed_observed"),
        sum([F.count_if(F.col(c).isNull()) for c in columns[1:]], F.count_if(F.col(columns[0]).isNull())).alias("left_missing"),
        (M.rmse(columns) < mean_err).alias("beats_mean"), *more)


def _verdict_sql(beats, more=None):
    n = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in WIDE)
    return f"""WITH {WIDE_BASE} SELECT count(*) AS n_rows, ({n})::BIGINT AS n_filled, 0::BIGINT AS changed_observed,
      0::BIGINT AS left_missing, {beats} AS beats_mean{''.join(f', {v} AS {c}' for c, v in (more or {}).items())} FROM a"""


def _judge(spark, sf, name, **params):
    # gap-filled features are standardised, so the mean's error is about one
    a = wide_gaps(spark, sf)
    mean = impute(a, "mean", WIDE).agg(M.rmse(WIDE)).first()[0]
    return verdict(get_imputer(name, columns=WIDE, **params).fit(a).transform(a), WIDE, F.lit(mean))


@query("impute_ice", _verdict_sql("true"))
def impute_ice(spark, sf):
    return _judge(spark, sf, "ice")


@query("impute_missforest", _verdict_sql("true"))
def impute_missforest(spark, sf):
    # A round is five forests of 50 trees; the operator's own rule ends them, after 50 rounds at most.
    return _judge(spark, sf, "missforest")


@query("impute_mlp2", _verdict_sql("true"))
def impute_mlp2(spark, sf):
    return _judge(spark, sf, "mlp2")


@query("impute_mlp_regress", _verdict_sql("true"))
def impute_mlp_regress(spark, sf):
    return _judge(spark, sf, "mlp_regress")


#: Columns that the others tell something about, and those that nothing does.
TOLD = {"qty": True, "price": True, "items": True, "last_line": False, "o_totalprice": False}


@query("impute_gain4", _verdict_sql("true", {f"{c}_beats_mean": str(v).lower() for c, v in TOLD.items()}))
def impute_gain4(spark, sf):
    """Over all cells better than the mean; by column only where the other columns tell something."""
    a = wide_gaps(spark, sf)
    mean = impute(a, "mean", WIDE).agg(M.rmse(WIDE).alias("all"), *[M.rmse([c]).alias(c) for c in WIDE]).first()
    filled = get_imputer("gain4", columns=WIDE).fit(a).transform(a)
    by_column = [(M.rmse([c]) < F.lit(mean[c])).alias(f"{c}_beats_mean") for c in WIDE]
    return verdict(filled, WIDE, F.lit(mean["all"]), by_column)


@query("impute_vae", _verdict_sql("1.0::DOUBLE").replace("AS beats_mean", "AS error_share"))
def impute_vae(spark, sf):
    """The error as a share of the mean's, to a tenth. With the original's weight of the divergence the latent tells nothing here,
    and the decoder gives the column mean."""
    a = wide_gaps(spark, sf)
    mean = impute(a, "mean", WIDE).agg(M.rmse(WIDE)).first()[0]
    return verdict(get_imputer("vae", columns=WIDE).fit(a).transform(a), WIDE, F.lit(mean), [F.round(M.rmse(WIDE) / F.lit(mean), 1).alias("error_share")]).drop("beats_mean")


@query("impute_gain_classic", f"""WITH {WIDE_BASE} SELECT count(*) AS n_rows, ({' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in WIDE)})::BIGINT AS n_filled,
  0::BIGINT AS left_missing FROM a""")
def impute_gain_classic(spark, sf):
    from gapweave.operators.impute.generative import gain

    a = wide_gaps(spark, sf)
    return verdict(gain(a, WIDE, seed=SEED), WIDE, F.lit(0.0)).drop("beats_mean", "changed_observed")


@query("impute_cross_validated", f"""WITH t AS ({PART_SQL}), a AS ({mcar_sql(['p_size', 'p_type'], 0.2, 't', ['p_retailprice'])})
  SELECT count(*) AS n_rows, count(*) - count(p_size) AS size_filled, count(*) - count(p_type) AS type_filled, 0::BIGINT AS left_missing FROM a""")
def impute_cross_validated(spark, sf):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.regression import LinearRegression

    from gapweave.operators.impute.crossval import CrossValidatedImputer

    a = ampute(parts(spark, sf).select("row_id", "p_size", "p_type", "p_retailprice"), ["p_size", "p_type"], 0.2, "MCAR", SEED)
    imp = CrossValidatedImputer((LinearRegression(), {"regParam": [0.0, 0.1]}), (DecisionTreeClassifier(), {"maxDepth": [2, 3]}))
    out = imp.fit(a, ["p_size", "p_type"]).transform(a)
    return out.agg(F.count("*").alias("n_rows"), F.count_if("p_size__imputed").alias("size_filled"),
                   F.count_if("p_type__imputed").alias("type_filled"),
                   F.count_if(F.col("p_size").isNull() | F.col("p_type").isNull()).alias("left_missing"))


def _least_sql(target, features):
    n = " + ".join(f"({c} IS NULL)::INT" for c in features)
    return f"SELECT *, {n} AS n_nan FROM a WHERE {target} IS NOT NULL ORDER BY {n}, row_id LIMIT 250"


@query("least_missing_rows", f"WITH t AS ({PART3_SQL}), a AS ({mcar_sql(KCOLS, 0.3, 't')}) {_least_sql('weight', KCOLS[:2])}")
def least_missing_rows(spark, sf):
    a = ampute(part3(spark, sf), KCOLS, 0.3, "MCAR", SEED)
    return least_missing(a, "weight", KCOLS[:2], "row_id")


PAIR = ["qty", "price"]


def _line_fit(target, feature):
    return f"""s_{target} AS (SELECT * FROM a WHERE {target} IS NOT NULL), f_{target} AS (SELECT {target} AS y,
      coalesce({feature}, (SELECT avg({feature}) FROM s_{target})) AS x FROM s_{target}),
      m_{target} AS (SELECT regr_slope(y, x) AS k_{target}, regr_intercept(y, x) AS c_{target} FROM f_{target})"""


@query("impute_linear", f"""WITH {WIDE_BASE}, {_line_fit('qty', 'price')}, {_line_fit('price', 'qty')},
  one AS (SELECT row_id, coalesce(qty, c_qty + k_qty * coalesce(price, (SELECT avg(price) FROM a))) AS qty, price FROM a, m_qty)
  SELECT row_id, round(qty, 6) AS qty, round(coalesce(price, c_price + k_price * qty), 6) AS price FROM one, m_price""")
def impute_linear(spark, sf):
    a = wide_gaps(spark, sf, keep=False).select("row_id", *PAIR)
    return impute(a, "linear_regress", PAIR).select("row_id", *[F.round(c, 6).alias(c) for c in PAIR])


# --- regressors ----------------------------------------------------------------

# The order total is unrelated to the lines here, so the price of the lines is the label.
X, Y = ["qty", "items", "last_line", "o_totalprice"], "price"
SPLIT = f"CASE WHEN {u_sql('half', '')} < 0.5 THEN 'test' ELSE 'train' END AS split"


def halves(spark, sf):
    from gapweave.functions.rng import hash_uniform

    t = wide(spark, sf)
    t = fit_standard(t, WIDE).transform(t).withColumn("split", F.when(hash_uniform(SEED, "half", "") < 0.5, "test").otherwise("train"))
    return t.where("split = 'train'").drop("split"), t.where("split = 'test'").drop("split")


_STD = f"w AS ({WIDE_SQL}), t AS (SELECT row_id, {', '.join(_std(c) for c in WIDE)} FROM w)"
_RES, _LAST = residual_sql(X, Y, "t")


@query("regress_linear", f"""WITH {_STD}, {_RES} SELECT round(sqrt(avg({Y} ** 2)), 7) AS y_rmse, round(avg({Y} ** 2), 7) AS y_mse,
  round(avg(abs({Y})), 7) AS y_mae, round(1 - avg({Y} ** 2) / (SELECT var_pop({Y}) FROM t), 7) AS y_r2,
  round(sqrt(avg({Y} ** 2)) / (SELECT max({Y}) - min({Y}) FROM t), 7) AS y_normrmse FROM {_LAST}""")
def regress_linear(spark, sf):
    t = wide(spark, sf)
    t = fit_standard(t, WIDE).transform(t)
    out = score_row(get_regressor("linearregression", X, Y).fit(t).predict(t), Y)
    return out.select(*[F.round(c, 7).alias(c) for c in out.columns])


@query("regress_ridge", f"""WITH t AS ({LINE_SQL}), m AS (SELECT regr_count(l_quantity, l_extendedprice) AS n, covar_pop(l_quantity, l_extendedprice) AS cxy,
  var_pop(l_quantity) AS vx, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM t), k AS (SELECT n * cxy / (n * vx + 1) AS b, mx, my FROM m)
  SELECT round(b, 6) AS slope, round(my - b * mx, 4) AS intercept FROM k""")
def regress_ridge(spark, sf):
    t = lines(spark, sf)
    m = get_regressor("RidgeRegression", ["l_quantity"], LABEL).fit(t).model
    return spark.createDataFrame([(round(float(m.coef[0]), 6), round(m.intercept, 4))], "slope double, intercept double")


def _learned(spark, sf, name, **params):
    """Scores on the held-out half: rows counted, and the error as a share of that of predicting the mean, to a tenth."""
    train, test = halves(spark, sf)
    out = get_regressor(name, X, Y, **params).fit(train).predict(test)
    share = F.sqrt(F.avg((F.col(Y) - F.col("prediction")) ** 2) / F.var_pop(Y))
    return out.agg(F.count("prediction").alias("n_test"), F.round(share, 1).alias("error_share"))


def _learned_sql(share):
    return f"WITH {_STD} SELECT count(*) AS n_test, {share}::DOUBLE AS error_share FROM (SELECT *, {SPLIT} FROM t) WHERE split = 'test'"


@query("regress_mlp", _learned_sql(0.5))
def regress_mlp(spark, sf):
    return _learned(spark, sf, "MLPregressor")


@query("regress_adaboost", _learned_sql(0.5))
def regress_adaboost(spark, sf):
    return _learned(spark, sf, "AdaBoostRegressor")


@query("regress_svr", _learned_sql(0.5))
def regress_svr(spark, sf):
    return _learned(spark, sf, "SVregression")


@query("regress_xgboost", _learned_sql(0.5))
def regress_xgboost(spark, sf):
    return _learned(spark, sf, "xgboost")


@query("regress_lightgbm", _learned_sql(0.5))
def regress_lightgbm(spark, sf):
    return _learned(spark, sf, "lightgbm")


def gap_halves(spark, sf):
    """Both halves with 20 % gaps in the features; the label is whole."""
    from gapweave.functions.rng import hash_uniform

    a = wide_gaps(spark, sf).withColumn("y", F.col(f"{Y}__true")).withColumn("test", hash_uniform(SEED, "half", "") < 0.5)
    return a.where(~F.col("test")), a.where("test")


@query("regress_with_gaps", f"""WITH {WIDE_BASE}, h AS (SELECT {u_sql('half', '')} < 0.5 AS test FROM a)
  SELECT count(*) AS n_test, 0.6::DOUBLE AS xgboost_share, 0.6::DOUBLE AS lightgbm_share FROM h WHERE test""")
def regress_with_gaps(spark, sf):
    train, test = gap_halves(spark, sf)
    out = test
    for name, rounds in (("xgboost", 10), ("lightgbm", 20)):  # the whole hundred are in regress_lightgbm
        out = get_regressor(name, X, "y", rounds=rounds).fit(train).predict(out).withColumnRenamed("prediction", name)
    share = [F.round(F.sqrt(F.avg((F.col("y") - F.col(n)) ** 2) / F.var_pop("y")), 1).alias(f"{n}_share") for n in ("xgboost", "lightgbm")]
    return out.agg(F.count("xgboost").alias("n_test"), *share)


@query("boosted_split", f"""WITH t AS ({LINE_SQL}), a AS ({mcar_sql(LINE, 0.3, 't', [LABEL])}), g AS (SELECT *, avg({LABEL}) OVER () - {LABEL} AS g FROM a),
  s AS (SELECT sum(g) AS g, count(*) AS n FROM g),
  v AS ({' UNION ALL '.join(f"SELECT {i} AS no, '{c}' AS feature, {c} AS v, sum(g) AS g, count(*) AS n FROM g WHERE {c} IS NOT NULL GROUP BY {c}" for i, c in enumerate(LINE))}),
  m AS ({' UNION ALL '.join(f"SELECT {i} AS no, sum(g) AS g, count(*) AS n FROM g WHERE {c} IS NULL" for i, c in enumerate(LINE))}),
  l AS (SELECT no, feature, v, sum(g) OVER w AS g, sum(n) OVER w AS n FROM v WINDOW w AS (PARTITION BY no ORDER BY v)),
  c AS (SELECT l.no, feature, v, side, l.g + side * m.g AS gl, l.n + side * m.n AS nl FROM l JOIN m USING (no), (SELECT unnest([0, 1]) AS side)),
  b AS (SELECT c.*, gl ** 2 / (nl + 1) + (s.g - gl) ** 2 / (s.n - nl + 1) - s.g ** 2 / (s.n + 1) AS gain, s.g - gl AS gr, (s.n - nl) AS nr FROM c, s WHERE s.n > nl
    ORDER BY gain DESC, no, v, side LIMIT 1)
  SELECT feature, v AS "limit", side = 1 AS missing_left, nl::BIGINT AS n_left, nr::BIGINT AS n_right, round(-0.3::DOUBLE * gl / (nl + 1), 4) AS left_value,
    round(-0.3::DOUBLE * gr / (nr + 1), 4) AS right_value FROM b""")
def boosted_split(spark, sf):
    """The first split over whole lines with gaps, against a search over all values and both sides for missing ones."""
    from gapweave.functions.trees import Growth, boost

    a = ampute(lines(spark, sf), LINE, 0.3, "MCAR", SEED)
    model = boost(a, LINE, LABEL, 1, 0.3, Growth(depth=1, penalty=1.0), "row_id")
    tree = model.trees[0]
    side = F.when(F.col(LINE[tree.feature[0]]).isNull(), F.lit(tree.missing_left[0])).otherwise(F.col(LINE[tree.feature[0]]) <= model.bins.limit(tree.feature[0], tree.cut[0]))
    return a.agg(F.lit(LINE[tree.feature[0]]).alias("feature"), F.lit(model.bins.limit(tree.feature[0], tree.cut[0])).alias("limit"), F.lit(bool(tree.missing_left[0])).alias("missing_left"),
                 F.count_if(side).alias("n_left"), F.count_if(~side).alias("n_right"), F.lit(round(tree.value[1], 4)).alias("left_value"), F.lit(round(tree.value[2], 4)).alias("right_value"))


KX, KY = KCOLS[:2], KCOLS[2]


@query("regress_knn", f"""WITH t AS (SELECT *, {u_sql('half', '')} < 0.5 AS test FROM ({PART3_SQL})),
  p AS (SELECT q.row_id, q.{KY} AS y, d.{KY} AS dy, row_number() OVER (PARTITION BY q.row_id ORDER BY {' + '.join(f'(q.{c} - d.{c}) ** 2' for c in KX)}, d.row_id) AS rn
    FROM t q, t d WHERE q.test AND NOT d.test)
  SELECT row_id, round(avg(dy), 6) AS prediction FROM p WHERE rn <= 5 GROUP BY row_id""")
def regress_knn(spark, sf):
    from gapweave.functions.rng import hash_uniform

    t = part3(spark, sf).withColumn("test", hash_uniform(SEED, "half", "") < 0.5)
    model = get_regressor("KNN", KX, KY).fit(t.where(~F.col("test")))
    return model.predict(t.where("test")).select("row_id", F.round("prediction", 6).alias("prediction"))


@query("score_regression", f"""WITH t AS ({LINE_SQL}), p AS (SELECT l_extendedprice AS y, l_quantity * 1000 - 5000 AS p FROM t)
  SELECT round(sqrt(avg((y - p) ** 2)), 3) AS y_test_rmse, round(avg((y - p) ** 2), 0) AS y_test_mse, round(avg(abs(y - p)), 3) AS y_test_mae,
  round(1 - avg((y - p) ** 2) / var_pop(y), 6) AS y_test_r2, round(sqrt(avg((y - p) ** 2)) / (max(y) - min(y)), 6) AS y_test_normrmse,
  count(*) FILTER (WHERE p < 0) AS y_test_neg, count(*) FILTER (WHERE y < 0) AS y_test_neg_true FROM p""")
def score_regression(spark, sf):
    t = lines(spark, sf).withColumn("prediction", F.col("l_quantity") * 1000 - 5000)
    out = score_row(t, LABEL, "y_test", counts=True)
    digits = {"y_test_rmse": 3, "y_test_mse": 0, "y_test_mae": 3}
    return out.select(*[F.round(c, digits.get(c, 6)).alias(c) if ty == "double" else F.col(c) for c, ty in out.dtypes])
