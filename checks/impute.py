"""Imputers and imputation quality."""

from pyspark.sql import functions as F

from checks.common import (LABEL, LINE, LINE_SQL, PART_SQL, SEED, WHOLE_LINE_SQL, lines, mcar_sql, mean_sql, parts, query, table, u_sql, whole_lines)
from gapweave.operators import metrics as M
from gapweave.operators.ampute import ampute
from gapweave.operators.impute import fill_targets, impute, impute_numeric
from gapweave.operators.split import with_split

COLS = [*LINE, LABEL]
BASE, WHOLE_BASE = (f"t AS ({source}), a AS ({mcar_sql(COLS, 0.3, 't')}), i AS ({mean_sql(COLS, 'a')})" for source in (LINE_SQL, WHOLE_LINE_SQL))


def gaps(spark, sf, read=lines):
    t = read(spark, sf)
    return t, ampute(t, COLS, 0.3, "MCAR", SEED)


@query("score_mean_by_column", f"""WITH {WHOLE_BASE} SELECT {', '.join(
    f'count(*) FILTER (WHERE a.{c} IS NULL) AS n_{c}, round(sqrt(avg((i.{c} - t.{c}) ** 2) FILTER (WHERE a.{c} IS NULL)), 4) AS rmse_{c}, '
    f'round(avg(abs(i.{c} - t.{c})) FILTER (WHERE a.{c} IS NULL), 4) AS mae_{c}' for c in COLS)}
  FROM t JOIN a USING (row_id) JOIN i USING (row_id)""")
def score_mean_by_column(spark, sf):
    pairs = _pairs(spark, sf, whole_lines)
    return pairs.agg(*[e for c in COLS for e in (
        M.mask_size([c]).alias(f"n_{c}"), F.round(M.rmse([c]), 4).alias(f"rmse_{c}"), F.round(M.mae([c]), 4).alias(f"mae_{c}"))])


@query("impute_mean", f"WITH {BASE} SELECT row_id, {', '.join(f'round({c}, 5) AS {c}' for c in COLS)} FROM i")
def impute_mean(spark, sf):
    _, a = gaps(spark, sf)
    return impute(a, "mean", COLS).select("row_id", *[F.round(c, 5).alias(c) for c in COLS])


@query("impute_numeric_carry_text", f"""WITH t AS ({PART_SQL}), a AS ({mcar_sql(['p_size', 'p_retailprice'], 0.25, 't', ['p_brand', 'p_type'])}),
  i AS ({mean_sql(['p_size', 'p_retailprice'], 'a', ['p_brand', 'p_type'])})
  SELECT row_id, round(p_size, 6) AS p_size, round(p_retailprice, 6) AS p_retailprice, p_brand, p_type FROM i""")
def impute_carry(spark, sf):
    a = ampute(parts(spark, sf), ["p_size", "p_retailprice"], 0.25, "MCAR", SEED)
    out = impute_numeric(a, "mean", ["p_size", "p_retailprice"], ["p_brand", "p_type"])
    return out.withColumns({c: F.round(c, 6) for c in ("p_size", "p_retailprice")})


@query("impute_test_with_train_fit", f"""WITH t AS ({LINE_SQL}), s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {u_sql('split', '')}, row_id)
  <= ceil(0.25 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM t), a AS ({mcar_sql(COLS, 0.3, 's', ['split'])}),
  tr AS (SELECT * FROM a WHERE split = 'train'), te AS (SELECT * FROM a WHERE split = 'test'), i AS ({mean_sql(COLS, 'te', train='tr')})
  SELECT row_id, {', '.join(f'round({c}, 5) AS {c}' for c in COLS)} FROM i""")
def impute_test(spark, sf):
    a = ampute(with_split(lines(spark, sf), SEED), COLS, 0.3, "MCAR", SEED)
    test = a.where("split = 'test'").drop("split")
    out = impute(test, "mean", COLS, train=a.where("split = 'train'"))
    return out.select("row_id", *[F.round(c, 5).alias(c) for c in COLS])


@query("fill_target_columns", f"""WITH {BASE} SELECT a.row_id, round(coalesce(a.l_tax, i.l_tax), 7) AS l_tax, a.l_tax IS NULL AS l_tax__imputed,
  a.l_discount FROM a JOIN i USING (row_id)""")
def fill_target(spark, sf):
    _, a = gaps(spark, sf)
    a = a.select("row_id", "l_tax", "l_discount")
    out = fill_targets(a, impute(a, "mean", ["l_tax", "l_discount"]), ["l_tax"])
    return out.withColumn("l_tax", F.round("l_tax", 7))


def _knn_sql(source, columns, k):
    """Brute force: every pair, gap-aware distance, ties by donor id."""
    both = " + ".join(f"(r.{c} IS NOT NULL AND d.{c} IS NOT NULL)::INT" for c in columns)
    sq = " + ".join(f"coalesce((r.{c} - d.{c}) ** 2, 0)" for c in columns)
    pairs = f"""pairs AS (SELECT r.row_id AS rid, d.row_id AS did, ({both}) AS m, ({sq}) AS sq,
      {', '.join(f'd.{c} AS d_{c}, r.{c} IS NULL AS need_{c}' for c in columns)}
      FROM {source} r, {source} d WHERE {' OR '.join(f'r.{c} IS NULL' for c in columns)}),
      dist AS (SELECT *, sq * ({len(columns)}.0::DOUBLE / m) AS dist FROM pairs WHERE m > 0)"""
    one = "k_{c} AS (SELECT rid, avg(d_{c}) AS v_{c} FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, did) AS rn FROM dist WHERE need_{c} AND d_{c} IS NOT NULL) WHERE rn <= {k} GROUP BY rid)"
    return pairs + ", " + ", ".join(one.format(c=c, k=k) for c in columns)


KCOLS = ["p_size", "p_retailprice", "weight"]
# three columns on comparable scales; the third mixes the first two
PART3_SQL = "SELECT p_partkey AS row_id, p_size::DOUBLE AS p_size, p_retailprice / 20.0::DOUBLE AS p_retailprice, (p_partkey * 37 % 101)::DOUBLE + p_size / 2.0::DOUBLE AS weight FROM part"


def part3(spark, sf):
    t = table(spark, sf, "part")
    return t.select(F.col("p_partkey").alias("row_id"), F.col("p_size").cast("double").alias("p_size"),
                    (F.col("p_retailprice") / 20.0).alias("p_retailprice"),
                    ((F.col("p_partkey") * 37 % 101).cast("double") + F.col("p_size") / 2.0).alias("weight"))


@query("impute_knn", f"""WITH t AS ({PART3_SQL}), a AS ({mcar_sql(KCOLS, 0.2, 't')}), {_knn_sql('a', KCOLS, 5)}
  SELECT a.row_id, {', '.join(f'round(coalesce(a.{c}, v_{c}, (SELECT avg({c}) FROM a)), 5) AS {c}' for c in KCOLS)}
  FROM a {' '.join(f'LEFT JOIN k_{c} ON k_{c}.rid = a.row_id' for c in KCOLS)}""")
def impute_knn(spark, sf):
    a = ampute(part3(spark, sf), KCOLS, 0.2, "MCAR", SEED)
    return impute(a, "knn", KCOLS).select("row_id", *[F.round(c, 5).alias(c) for c in KCOLS])


POOL = f"""p AS (SELECT {' + '.join(f'count(*) FILTER (WHERE a.{c} IS NULL)' for c in COLS)} AS n,
  {' + '.join(f'coalesce(sum((i.{c} - t.{c}) ** 2) FILTER (WHERE a.{c} IS NULL), 0)' for c in COLS)} AS se,
  {' + '.join(f'coalesce(sum(abs(i.{c} - t.{c})) FILTER (WHERE a.{c} IS NULL), 0)' for c in COLS)} AS ae,
  {' + '.join(f'count(*) FILTER (WHERE a.{c} IS NULL AND i.{c} = t.{c})' for c in COLS)} AS eq, count(*) AS n_rows
  FROM t JOIN a USING (row_id) JOIN i USING (row_id))"""


def _pairs(spark, sf, read=lines):
    """Filled frame with truth and mask beside each column: no shuffle anywhere."""
    return impute(ampute(read(spark, sf), COLS, 0.3, "MCAR", SEED, keep_truth=True), "mean", COLS)


@query("masked_rmse", f"WITH {BASE}, {POOL} SELECT round(sqrt(se / n), 4) AS rmse FROM p")
def masked_rmse(spark, sf):
    return _pairs(spark, sf).agg(F.round(M.rmse(COLS), 4).alias("rmse"))


@query("masked_mae", f"WITH {WHOLE_BASE}, {POOL} SELECT round(ae / n, 4) AS mae FROM p")
def masked_mae(spark, sf):
    return _pairs(spark, sf, whole_lines).agg(F.round(M.mae(COLS), 4).alias("mae"))


@query("masked_accuracy", f"""WITH t AS ({WHOLE_LINE_SQL}), a AS ({mcar_sql(LINE, 0.3, 't')}),
  i AS (SELECT row_id, {', '.join(f'coalesce({c}, (SELECT median({c}) FROM t)) AS {c}' for c in LINE)} FROM a)
  SELECT round(({' + '.join(f'count(*) FILTER (WHERE a.{c} IS NULL AND i.{c} = t.{c})' for c in LINE)})::DOUBLE /
  ({' + '.join(f'count(*) FILTER (WHERE a.{c} IS NULL)' for c in LINE)}), 6) AS accuracy FROM t JOIN a USING (row_id) JOIN i USING (row_id)""")
def masked_accuracy(spark, sf):
    from gapweave.functions.selection import quantiles_linear

    t = whole_lines(spark, sf).select("row_id", *LINE)
    a = ampute(t, LINE, 0.3, "MCAR", SEED, keep_truth=True)
    mid = quantiles_linear(t, {c: [0.5] for c in LINE})
    filled = a.withColumns({c: F.coalesce(F.col(c), F.lit(mid[(c, 0.5)])) for c in LINE})
    return filled.agg(F.round(M.accuracy(LINE), 6).alias("accuracy"))


def _code(c):
    return f"(dense_rank() OVER (ORDER BY {c}) - 1)::DOUBLE AS {c}"


MIXED = ["p_size", "p_brand", "p_type"]
MIXED_SQL = f"t AS (SELECT row_id, p_size, {_code('p_brand')}, {_code('p_type')} FROM ({PART_SQL})), a AS ({mcar_sql(MIXED, 0.3, 't')}), i AS ({mean_sql(MIXED, 'a')})"


def _n(cols):
    return "(" + " + ".join(f"count(*) FILTER (WHERE a.{c} IS NULL)" for c in cols) + ")"


def _se(cols):
    return "(" + " + ".join(f"sum((i.{c} - t.{c}) ** 2) FILTER (WHERE a.{c} IS NULL)" for c in cols) + ")"


def _ae(cols):
    return "(" + " + ".join(f"sum(abs(i.{c} - t.{c})) FILTER (WHERE a.{c} IS NULL)" for c in cols) + ")"


_CATS = ["p_brand", "p_type"]


def mixed(spark, sf):
    from gapweave.operators.encode import encode_categories

    t = encode_categories(parts(spark, sf).select("row_id", *MIXED), _CATS)
    a = ampute(t, MIXED, 0.3, "MCAR", SEED, keep_truth=True)
    return impute(a, "mean", MIXED)


@query("score_block", f"""WITH {MIXED_SQL} SELECT {_n(MIXED)} AS mask_size, {_n(['p_size'])} AS mask_size_num, {_n(_CATS)} AS mask_size_cat,
  round({_n(MIXED)} * 100.0::DOUBLE / (count(*) * 3), 6) AS miss_perc, round(sqrt({_se(MIXED)} / {_n(MIXED)}), 6) AS impute_rmse,
  round({_ae(MIXED)} / {_n(MIXED)}, 6) AS impute_mae, round(sqrt({_se(['p_size'])} / {_n(['p_size'])}), 6) AS impute_rmse_num,
  round({_ae(['p_size'])} / {_n(['p_size'])}, 6) AS impute_mae_num, round(sqrt({_se(_CATS)} / {_n(_CATS)}), 6) AS impute_rmse_cat,
  round(({' + '.join(f'count(*) FILTER (WHERE a.{c} IS NULL AND round_even(i.{c}, 0) = t.{c})' for c in _CATS)})::DOUBLE / {_n(_CATS)}, 6) AS impute_acc_cat
  FROM t JOIN a USING (row_id) JOIN i USING (row_id)""")
def score_block(spark, sf):
    out = M.score_block(mixed(spark, sf), ["p_size"], _CATS)
    return out.select(*[F.round(c, 6).alias(c) if f == "double" else F.col(c) for c, f in out.dtypes])


@query("score_block_no_truth", f"""WITH {MIXED_SQL} SELECT {_n(MIXED)} AS mask_size, -99999999.0::DOUBLE AS impute_rmse,
  -99999999.0::DOUBLE AS impute_mae FROM t JOIN a USING (row_id) JOIN i USING (row_id)""")
def score_block_no_truth(spark, sf):
    out = M.score_block(mixed(spark, sf), MIXED, [], contains_missing=True, compat=True)
    return out.select("mask_size", "impute_rmse", "impute_mae")


@query("score_test_frame", f"""WITH {BASE}, {POOL} SELECT round(sqrt(se / n), 4) AS x_test_impute_rmse, round(ae / n, 4) AS x_test_impute_mae FROM p""")
def score_test_frame(spark, sf):
    t, a = gaps(spark, sf)
    out = M.test_scores(M.compare(t, a, impute(a, "mean", COLS), COLS), COLS)
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query("normalised_rmse", f"""WITH {BASE}, r AS (SELECT {', '.join(f'max({c}) - min({c}) + 1e-6 AS r_{c}' for c in COLS)} FROM t)
  SELECT round(sqrt(({' + '.join(f'sum(((i.{c} - t.{c}) / r_{c}) ** 2) FILTER (WHERE a.{c} IS NULL)' for c in COLS)}) / {_n(COLS)}), 6) AS norm_rmse
  FROM t JOIN a USING (row_id) JOIN i USING (row_id), r""")
def normalised_rmse(spark, sf):
    return M.normalized_rmse_inline(_pairs(spark, sf), COLS).select(F.round("norm_rmse", 6).alias("norm_rmse"))


@query("observed_mean", f"WITH {WHOLE_BASE} SELECT {', '.join(f'round(sum({c}) / count({c}), 6) AS {c}' for c in COLS)} FROM a")
def observed_mean(spark, sf):
    _, a = gaps(spark, sf, whole_lines)
    return M.observed_mean(a, COLS).select(*[F.round(c, 6).alias(c) for c in COLS])


@query("audit_table", f"""WITH {BASE} {' UNION ALL '.join(
    f'''SELECT row_id, '{c}' AS "column", t.{c} AS original, round(i.{c}, 5) AS imputed, t.l_extendedprice AS y
    FROM t JOIN a USING (row_id) JOIN i USING (row_id) WHERE a.{c} IS NULL''' for c in LINE)}""")
def audit_table(spark, sf):
    out = M.audit_table(_pairs(spark, sf), LINE, [f"{LABEL}__true"]).withColumnRenamed(f"{LABEL}__true", "y")
    return out.withColumn("imputed", F.round("imputed", 5))


@query("distance_scale", f"""WITH {BASE}, m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in LINE)} FROM a),
  s AS (SELECT {', '.join(f'coalesce(a.{c}, m_{c}) AS {c}' for c in LINE)} FROM a, m ORDER BY {u_sql('pairs', '')}, row_id LIMIT 2000),
  d AS (SELECT ({' + '.join(f'(x.{c} - y.{c}) ** 2' for c in LINE)}) / 2 AS d FROM s x, s y),
  k AS (SELECT d, row_number() OVER (ORDER BY d) AS rn, count(*) OVER () AS n FROM d WHERE d > 0)
  SELECT round(max(d) FILTER (WHERE rn = floor(0.5::DOUBLE * n)) * 0.05::DOUBLE, 6) AS epsilon FROM k""")
def distance_scale(spark, sf):
    """A quantile of all pair distances of a sample of 2,000 lines with gaps."""
    from gapweave.operators.distances import distance_scale as scale

    _, a = gaps(spark, sf)
    return spark.createDataFrame([(round(scale(a, LINE, seed=SEED), 6),)], "epsilon double")
