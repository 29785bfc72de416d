"""Plans, runs, stored variants and recommendations."""

from pyspark.sql import functions as F

from checks.common import LABEL, LINE, LINE_SQL, PART_SQL, SEED, lines, mcar_sql, mean_sql, parts, query, table, u_sql
from gapweave.model import Descriptor
from gapweave.operators import metrics as M
from gapweave.plans.grid import absent, open_cells, plan_grid
from gapweave.plans.recommend import Recommender
from gapweave.plans.results import ranking, winners
from gapweave.plans.runner import Runner
from gapweave.session import new_folder
from gapweave.sources.variants import VariantStore

PLAN = {"SEED": 1001, "REPEAT": 2, "MISSING": [None, 0.1, 0.5], "MECHA": ["MCAR", "MAR"], "IMPUTER": ["MEAN", "KNN"],
        "NEW_IMPUTER": ["EXTRA"], "REGRESSOR": ["xgboost", "ridgeregression"], "MISSING_REGRESSOR": ["lightgbm"]}


def brand_plan(spark, sf):
    """Every brand's parts count as one dataset."""
    names = table(spark, sf, "part").select(F.col("p_brand").alias("ds_name")).distinct()
    return plan_grid(names, PLAN)


def _unnest(values):
    return "unnest([" + ", ".join(repr(v) if isinstance(v, str) else str(v) for v in values) + "])"


_R = _unnest(PLAN["REGRESSOR"])
_GAPS = f"SELECT ds_name, seed, missing, mecha FROM b, (SELECT {_unnest([0.1, 0.5])}::DOUBLE AS missing), (SELECT {_unnest(PLAN['MECHA'])} AS mecha)"
PLAN_SQL = f"""b AS (SELECT ds_name, seed::INT AS seed FROM (SELECT DISTINCT p_brand AS ds_name FROM part), (SELECT {_unnest([1001, 1002])} AS seed)),
  plan AS (SELECT seed, ds_name, NULL::DOUBLE AS missing, NULL AS mecha, NULL AS imputer, NULL::BOOLEAN AS new_imputer, {_R} AS regressor FROM b
  UNION ALL SELECT seed, ds_name, missing, mecha, NULL, NULL, 'lightgbm' FROM ({_GAPS})
  UNION ALL SELECT seed, ds_name, missing, mecha, imputer, imputer = 'EXTRA', {_R} FROM ({_GAPS}), (SELECT {_unnest(['MEAN', 'KNN', 'EXTRA'])} AS imputer))"""


@query("plan_grid", f"WITH {PLAN_SQL} SELECT * FROM plan")
def plan_grid_(spark, sf):
    return brand_plan(spark, sf)


DONE_SQL = "done AS (SELECT DISTINCT p_brand AS ds_name, 1001 AS seed FROM part WHERE p_size > 45)"


def _done(spark, sf):
    return table(spark, sf, "part").where("p_size > 45").select(F.col("p_brand").alias("ds_name"), F.lit(1001).alias("seed"))


@query("skip_finished_cells", f"""WITH {PLAN_SQL}, {DONE_SQL} SELECT ds_name, seed, count(*) AS cells FROM plan ANTI JOIN done USING (ds_name, seed)
  GROUP BY ds_name, seed""")
def skip_finished(spark, sf):
    return open_cells(brand_plan(spark, sf), _done(spark, sf)).groupBy("ds_name", "seed").agg(F.count("*").alias("cells"))


@query("collect_missing_results", f"WITH {PLAN_SQL}, {DONE_SQL} SELECT DISTINCT seed, ds_name FROM plan ANTI JOIN done USING (ds_name, seed)")
def collect_missing(spark, sf):
    return absent(brand_plan(spark, sf), _done(spark, sf))


# a result table cut from lineitem: one "run" per flag, status, ship year and line number
RES_SQL = """r AS (SELECT l_returnflag AS ds_name, (l_linenumber % 2) / 10.0::DOUBLE AS missing, l_linestatus AS mecha, year(l_shipdate)::INT AS seed,
  'imp' || (l_linenumber % 3) AS imputer, 'reg' || l_linenumber AS regressor, round(stddev_pop(l_extendedprice), 2) AS y_test_rmse
  FROM lineitem GROUP BY ALL)"""


def result_table(spark, sf):
    t = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    return t.groupBy(
        F.col("l_returnflag").alias("ds_name"), ((n % 2) / F.lit(10.0)).alias("missing"), F.col("l_linestatus").alias("mecha"),
        F.year("l_shipdate").alias("seed"), F.concat(F.lit("imp"), (n % 3).cast("string")).alias("imputer"),
        F.concat(F.lit("reg"), n.cast("string")).alias("regressor"),
    ).agg(F.round(F.stddev_pop("l_extendedprice"), 2).alias("y_test_rmse"))


@query("result_ranking", f"""WITH {RES_SQL} SELECT *, rank() OVER (PARTITION BY ds_name, missing, mecha ORDER BY y_test_rmse) AS rank FROM r""")
def result_ranking(spark, sf):
    return ranking(result_table(spark, sf))


@query("result_winners", f"""WITH {RES_SQL} SELECT ds_name, missing, mecha, seed, imputer, regressor FROM (SELECT *, row_number() OVER
  (PARTITION BY ds_name, missing, mecha, seed ORDER BY y_test_rmse, imputer, regressor) AS rn FROM r) WHERE rn = 1""")
def result_winners(spark, sf):
    return winners(result_table(spark, sf))


def opener(spark, sf):
    known = {
        "lineitem": (Descriptor("lineitem", numeric=tuple(LINE), label=LABEL), lambda: lines(spark, sf)),
        "part": (Descriptor("part", numeric=("p_size",), categorical=("p_brand",), text=("p_type",), label="p_retailprice"), lambda: parts(spark, sf)),
    }
    return lambda name: (known[name][0], known[name][1]())


_TRAIN = f"""t AS ({LINE_SQL}), s AS (SELECT *, row_number() OVER (ORDER BY {u_sql('split', '')}, row_id) <= ceil(0.25 * count(*) OVER ()) AS test FROM t),
  m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in LINE)} FROM s WHERE NOT test),
  tr AS (SELECT row_id, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in LINE)} FROM s, m WHERE NOT test), a AS ({mcar_sql(LINE, 0.3, 'tr')}),
  i AS ({mean_sql(LINE, 'a')})"""
_N = " + ".join(f"count(*) FILTER (WHERE a.{c} IS NULL)" for c in LINE)


@query("run_experiment", f"""WITH {_TRAIN} SELECT regressor, 'lineitem' AS ds_name, ({_N})::BIGINT AS mask_size,
  round(sqrt(({' + '.join(f'sum((i.{c} - tr.{c}) ** 2) FILTER (WHERE a.{c} IS NULL)' for c in LINE)}) / ({_N})), 6) AS impute_rmse,
  false AS regressor_error FROM tr JOIN a USING (row_id) JOIN i USING (row_id), (SELECT unnest(['ridgeregression', 'linearregression']) AS regressor) GROUP BY regressor""")
def run_experiment(spark, sf):
    """A plan of two cells that share one filled frame, from table to result rows."""
    plan = plan_grid(spark.createDataFrame([("lineitem",)], "ds_name string"), {
        "SEED": SEED, "MISSING": [0.3], "MECHA": ["MCAR"], "IMPUTER": ["MEAN"], "REGRESSOR": ["ridgeregression", "linearregression"]})
    out = Runner(spark, opener(spark, sf), analyze=["MF3", "MF5"], ignore_errors=False).run_plan(plan)
    return out.select("regressor", "ds_name", "mask_size", F.round("impute_rmse", 6).alias("impute_rmse"), "regressor_error")


def _mm(c):
    return f"(SELECT min({c}) FROM t) AS lo, (SELECT max({c}) - min({c}) FROM t) AS w"


@query("variant_store", f"""WITH t AS ({PART_SQL}), s AS (SELECT row_id, (p_size - lo) / w AS p_size, lo, w FROM t, (SELECT min(p_size) AS lo, max(p_size) - min(p_size) AS w FROM t)),
  a AS ({mcar_sql(['p_size'], 0.2, 's', ['lo', 'w'])}) SELECT a.row_id, round(coalesce(a.p_size, (SELECT avg(p_size) FROM a)) * w + lo, 6) AS p_size, t.p_type
  FROM a JOIN t USING (row_id)""")
def variant_store(spark, sf):
    """Filled, unscaled variant; source and gap variants are made on the way."""
    store = VariantStore(spark, new_folder(spark, "variants"), opener(spark, sf))
    out = store.imputed("part", 20, "MCAR", SEED, "MEAN", False)
    return out.withColumn("p_size", F.round("p_size", 6))


@query("variant_tree", """SELECT 'part' AS dataset, p.missing, p.mecha, p.seed, p.imputer, s.scaled, 'OK' AS status FROM
  (SELECT NULL::DOUBLE AS missing, NULL AS mecha, NULL::INT AS seed, NULL AS imputer UNION ALL SELECT 10, 'MCAR', 5, unnest([NULL, 'MEAN'])
   UNION ALL SELECT 10, 'MCAR', 6, unnest([NULL, 'MEAN'])) p, (SELECT unnest([true, false]) AS scaled) s WHERE (SELECT count(*) FROM part) > 0""")
def variant_tree(spark, sf):
    store = VariantStore(spark, new_folder(spark, "variants"), opener(spark, sf))
    out = store.build(["part"], [10], ["MCAR"], 5, 2, ["MEAN"])
    times = store.timings("part", 10, "MCAR", 5, "MEAN")
    assert times["impute_time"] >= 0 and times["missing_time"] >= 0
    return out.select("dataset", "missing", "mecha", "seed", "imputer", "scaled", "status")


@query("recommend_regressor", """SELECT mecha, count(*) AS n_rows, count(*) AS n_recommended FROM (SELECT DISTINCT l_linestatus AS mecha, l_suppkey, l_linenumber FROM lineitem) GROUP BY mecha""")
def recommend(spark, sf):
    """Meta-features and the winning run per (mechanism, segment); then a recommendation for every segment."""
    t = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("mecha"), "l_suppkey", "l_linenumber", "l_returnflag", *LINE, LABEL)
    keys = ["mecha", "l_suppkey", "l_linenumber"]
    meta = t.groupBy(*keys).agg(
        F.count("*").cast("double").alias("MF3"), F.avg(LABEL).alias("MF9"), F.var_pop(LABEL).alias("MF13"),
        F.avg("l_quantity").alias("MF8"), F.max("l_quantity").alias("MF11"))
    runs = t.groupBy(*keys, "l_returnflag").agg(F.stddev_pop(LABEL).alias("rmse"))
    best = runs.groupBy(*keys).agg(F.min_by("l_returnflag", F.struct("rmse", "l_returnflag")).alias("best"))
    both = meta.join(best, keys).persist()
    feats = ["MF3", "MF8", "MF9", "MF11", "MF13"]
    model = Recommender(feats).fit(both, "best")
    out = [model.recommend(both.where(F.col("mecha") == m), m) for m in ("F", "O")]
    return out[0].unionByName(out[1]).groupBy("mecha").agg(F.count("*").alias("n_rows"), F.count("recommended").alias("n_recommended"))


_SIZES = f"t AS ({PART_SQL}), a AS ({mcar_sql(['p_size'], 0.1, 't', seed=5)})"


@query("clear_variants", f"WITH {_SIZES} SELECT 4::BIGINT AS n_cleared, 6::BIGINT AS n_left, count(*) AS n_rows, round(avg(p_size), 6) AS mean_size, count(*) - count(p_size) AS n_filled FROM a")
def clear_variants(spark, sf):
    """Filled variants of two seeds are forgotten, the others stay, and one is made anew on next use."""
    store = VariantStore(spark, new_folder(spark, "variants"), opener(spark, sf))
    store.build(["part"], [10], ["MCAR"], 5, 2, ["MEAN"])
    cleared, left = store.clear(imputers=["MEAN"]), store.manifest().count()
    again, gaps = store.imputed("part", 10, "MCAR", 5, "MEAN", False), store.missing("part", 10, "MCAR", 5, False)
    n = gaps.agg(F.count_if(F.col("p_size").isNull())).first()[0]
    return again.agg(F.lit(cleared).cast("long").alias("n_cleared"), F.lit(left).cast("long").alias("n_left"), F.count("*").alias("n_rows"), F.round(F.avg("p_size"), 6).alias("mean_size"),
                     F.lit(n).cast("long").alias("n_filled"))


@query("variant_timings", "SELECT count(*) AS n_rows, true AS timed, true AS unknown_is_an_error FROM part")
def variant_timings(spark, sf):
    """Times of a stored variant by its key, those of one that was never made being an error."""
    store = VariantStore(spark, new_folder(spark, "variants"), opener(spark, sf))
    filled = store.imputed("part", 10, "MCAR", 5, "MEAN", False)
    times = store.timings("part", 10, "MCAR", 5, "MEAN")
    try:
        store.timings("part", 10, "MCAR", 6, "MEAN")
        unknown = False
    except KeyError:
        unknown = True
    timed = set(times) == {"impute_time", "missing_time"} and all(t > 0 for t in times.values())
    return filled.agg(F.count("*").alias("n_rows"), F.lit(timed).alias("timed"), F.lit(unknown).alias("unknown_is_an_error"))


@query("reuse_filled", f"""WITH {_TRAIN} SELECT 1::BIGINT AS n_planted, 1::BIGINT AS n_filled, true AS same_frame,
  round(sqrt(({' + '.join(f'sum((i.{c} - tr.{c}) ** 2) FILTER (WHERE a.{c} IS NULL)' for c in LINE)}) / ({_N})), 6) AS impute_rmse
  FROM tr JOIN a USING (row_id) JOIN i USING (row_id)""")
def reuse_filled(spark, sf):
    """Cells that differ in the regressor alone share one planted and one filled frame, and its quality."""
    runner = Runner(spark, opener(spark, sf), ignore_errors=False)
    cell = {"seed": SEED, "ds_name": "lineitem", "missing": 0.3, "mecha": "MCAR", "imputer": "MEAN", "new_imputer": False}
    first = runner.run(**cell, regressor="ridgeregression")
    held = dict(runner._filled)
    second = runner.run(**cell, regressor="linearregression")
    same = all(runner._filled[k] is v for k, v in held.items()) and first["t_impute"] == second["t_impute"]
    filled = next(v[0] for k, v in held.items() if len(k) == 5)
    return filled.agg(F.lit(sum(len(k) == 4 for k in runner._filled)).cast("long").alias("n_planted"), F.lit(sum(len(k) == 5 for k in runner._filled)).cast("long").alias("n_filled"),
                      F.lit(same).alias("same_frame"), F.round(M.rmse(LINE), 6).alias("impute_rmse"))


@query("seed_control", f"""WITH t AS ({LINE_SQL}), a AS ({mcar_sql(LINE, 0.3, 't', seed=7)}), b AS ({mcar_sql(LINE, 0.3, 't', seed=8)})
  SELECT count(*) AS n_rows, count(*) FILTER (WHERE (a.l_quantity IS NULL) <> (b.l_quantity IS NULL)) AS n_other, 0::BIGINT AS n_changed_on_repeat, true AS same_model
  FROM a JOIN b USING (row_id)""")
def seed_control(spark, sf):
    """The same seed plants the same gaps and fits the same model again, another seed plants others."""
    from gapweave.operators.ampute import ampute
    from gapweave.operators.regress import get_regressor

    t = lines(spark, sf)
    gone = [ampute(t.select("row_id", *LINE), LINE, 0.3, "MCAR", s).select("row_id", F.col("l_quantity").isNull().alias(n)) for s, n in ((7, "a"), (7, "again"), (8, "b"))]
    models = [get_regressor("svregression", LINE, LABEL, seed=3, max_epochs=2).fit(t) for _ in range(2)]
    same = bool((models[0].theta == models[1].theta).all())
    return gone[0].join(gone[1], "row_id").join(gone[2], "row_id").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("a") != F.col("b")).alias("n_other"), F.count_if(F.col("a") != F.col("again")).alias("n_changed_on_repeat"), F.lit(same).alias("same_model"))
