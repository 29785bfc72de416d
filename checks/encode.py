"""Encoding, scaling, splitting."""

from pyspark.sql import functions as F

from checks.common import (LABEL, LINE, LINE_SQL, ORDER_SQL, PART_SQL, SEED, WHOLE_LINE_SQL, customers, lines, mcar_sql, mean_sql, parts,
                           query, table, u_sql, whole_lines)
from gapweave.operators.ampute import ampute
from gapweave.operators.encode import (CategoryCodec, FeaturePipeline, categories_to_string, encode_categories, encode_label,
                                       restore_types, split_types)
from gapweave.operators.impute import impute
from gapweave.operators.scale import (fit_gain, fit_minmax, fit_standard, inverse_scale_dataset, round_few_valued,
                                      scale_dataset)
from gapweave.operators.split import export_split, load_split, with_split
from gapweave.session import new_folder

CATS = ["o_orderstatus", "o_orderpriority", "c_mktsegment"]


def _codes(c, t):
    return f"(SELECT code FROM (SELECT v, (row_number() OVER (ORDER BY v) - 1)::DOUBLE AS code FROM (SELECT DISTINCT {c} AS v FROM {t})) WHERE v = {c}) AS {c}"


@query("label_encode", f"""WITH t AS ({ORDER_SQL}) SELECT row_id, c_acctbal, c_nationkey, o_totalprice,
  {', '.join(_codes(c, 't') for c in CATS)} FROM t""")
def label_encode(spark, sf):
    return encode_categories(customers(spark, sf), CATS)


@query("label_encode_target", f"""WITH t AS (SELECT event_id, value, event_type FROM events)
  SELECT event_id, value, {_codes('event_type', 't')} FROM t""")
def label_encode_target(spark, sf):
    return encode_label(table(spark, sf, "events").select("event_id", "value", "event_type"), "event_type")


@query("category_codec_roundtrip", """SELECT p_partkey AS row_id, CASE WHEN p_size > 10 THEN p_brand END AS p_brand, p_type FROM part""")
def codec_roundtrip(spark, sf):
    t = parts(spark, sf).select("row_id", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("p_brand"), "p_type")
    codec = CategoryCodec.fit(t, ["p_brand", "p_type"])
    noisy = codec.transform(t).withColumn("p_type", F.col("p_type") + 0.3)
    return codec.inverse(noisy)


TRAIN_SQL = f"""t AS ({LINE_SQL}), s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {u_sql('split', '')}, row_id)
  <= ceil(0.25 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM t)"""


@query("train_test_split", f"WITH {TRAIN_SQL} SELECT row_id, split FROM s")
def train_test_split(spark, sf):
    return with_split(lines(spark, sf), SEED).select("row_id", "split")


@query("standard_scale", f"""WITH {TRAIN_SQL} SELECT row_id, split, {', '.join(
    f"round(({c} - (SELECT avg({c}) FROM s WHERE split = 'train')) / (SELECT stddev_pop({c}) FROM s WHERE split = 'train'), 7) AS {c}" for c in LINE)} FROM s""")
def standard_scale(spark, sf):
    both = with_split(lines(spark, sf), SEED)
    scaled = fit_standard(both.where("split = 'train'"), LINE).transform(both)
    return scaled.select("row_id", "split", *[F.round(c, 7).alias(c) for c in LINE])


def _minmax(c, t):
    return f"({c} - (SELECT min({c}) FROM {t})) / (SELECT max({c}) - min({c}) FROM {t})"


@query("minmax_scale", f"""WITH t AS ({PART_SQL}) SELECT row_id, round({_minmax('p_size', 't')}, 7) AS p_size,
  round({_minmax('p_retailprice', 't')}, 7) AS p_retailprice, {_codes('p_brand', 't')}, {_codes('p_type', 't')} FROM t""")
def minmax_scale(spark, sf):
    out = scale_dataset(parts(spark, sf), ["p_size", "p_retailprice"], ["p_brand", "p_type"])
    return out.withColumns({c: F.round(c, 7) for c in ("p_size", "p_retailprice")})


@query("inverse_minmax", f"""WITH t AS ({PART_SQL}) SELECT row_id, p_size, round(p_retailprice, 4) AS p_retailprice, p_brand FROM t""")
def inverse_minmax(spark, sf):
    src = parts(spark, sf)
    scaled = scale_dataset(src, ["p_size", "p_retailprice"], ["p_brand"])
    back = inverse_scale_dataset(scaled, src, ["p_size", "p_retailprice"], ["p_brand"])
    return back.withColumns({"p_size": F.round("p_size", 4), "p_retailprice": F.round("p_retailprice", 4)})


@query("gain_normalise", f"""WITH t AS ({WHOLE_LINE_SQL}) SELECT row_id, {', '.join(
    f'round(({c} - (SELECT min({c}) FROM t)) / ((SELECT max({c}) - min({c}) FROM t) + 1e-6), 7) AS {c}' for c in LINE)},
    {', '.join(f'round({c}, 7) AS {c}_back' for c in LINE)} FROM t""")
def gain_normalise(spark, sf):
    t = whole_lines(spark, sf)
    scale = fit_gain(t, LINE)
    norm = scale.transform(t)
    both = norm.withColumns({f"{c}_n": F.col(c) for c in LINE})
    back = scale.inverse(both)
    return back.select("row_id", *[F.round(f"{c}_n", 7).alias(c) for c in LINE], *[F.round(c, 7).alias(f"{c}_back") for c in LINE])


FEW = ["l_quantity", "l_discount", "l_tax"]


@query("round_few_valued", f"""WITH t AS ({LINE_SQL}), a AS ({mcar_sql(FEW, 0.3, 't')}), m AS ({mean_sql(FEW, 'a')}),
 k AS (SELECT count(DISTINCT l_quantity) AS q, count(DISTINCT l_discount) AS d, count(DISTINCT l_tax) AS x FROM a)
SELECT row_id, round(CASE WHEN q < 20 THEN round_even(l_quantity, 0) ELSE l_quantity END, 7) AS l_quantity,
 CASE WHEN d < 20 THEN round_even(l_discount, 0) ELSE l_discount END AS l_discount,
 CASE WHEN x < 20 THEN round_even(l_tax, 0) ELSE l_tax END AS l_tax FROM m, k""")
def round_few(spark, sf):
    a = ampute(lines(spark, sf).select("row_id", *FEW), FEW, 0.3, "MCAR", SEED)
    out = round_few_valued(impute(a, "mean", FEW), a, FEW)
    return out.withColumn("l_quantity", F.round("l_quantity", 7))


@query("type_restore", f"""WITH t AS ({ORDER_SQL}) SELECT row_id, CASE WHEN c_nationkey > 4 THEN c_nationkey::INT END AS c_nationkey, c_acctbal, c_mktsegment FROM t""")
def type_restore(spark, sf):
    t = customers(spark, sf).select("row_id", F.when(F.col("c_nationkey") > 4, F.col("c_nationkey").cast("int")).alias("c_nationkey"),
                                    "c_acctbal", "c_mktsegment")
    cats, _ = split_types(t, ["c_acctbal", "c_mktsegment"])
    return restore_types(categories_to_string(t, [*cats, "c_nationkey"]), t.schema)


@query("generative_codec", f"""WITH t AS ({PART_SQL}) SELECT row_id, p_size, p_type FROM t""")
def generative_codec(spark, sf):
    """Codes and [0, 1] scaling, then back: decoding rounds to the nearest known code."""
    t = parts(spark, sf).select("row_id", "p_size", "p_type")
    codec = CategoryCodec.fit(t, ["p_type"])
    coded = codec.transform(t)
    scale = fit_minmax(coded, ["p_size", "p_type"])
    back = codec.inverse(scale.inverse(scale.transform(coded)))
    return back.withColumn("p_size", F.round("p_size", 6))


@query("one_hot_features", f"""WITH t AS ({PART_SQL}), a AS (SELECT row_id, CASE WHEN NOT ({u_sql('mcar', 'p_size')} < 0.3) THEN p_size END AS p_size,
  CASE WHEN NOT ({u_sql('mcar', 'p_type')} < 0.3) THEN p_type END AS p_type FROM t),
 mode AS (SELECT p_type AS m FROM a WHERE p_type IS NOT NULL GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1),
 lev AS (SELECT list(v ORDER BY v) AS l FROM (SELECT DISTINCT p_type AS v FROM a WHERE p_type IS NOT NULL))
SELECT row_id, round(coalesce(p_size, (SELECT avg(p_size) FROM a)), 7) AS f0,
  list_position(l, coalesce(p_type, m)) - 1 AS slot, len(l)::BIGINT AS slots FROM a, mode, lev""")
def one_hot_features(spark, sf):
    from pyspark.ml.functions import vector_to_array

    a = ampute(parts(spark, sf).select("row_id", "p_size", "p_type"), ["p_size", "p_type"], 0.3, "MCAR", SEED)
    pipe = FeaturePipeline.fit(a, ["p_type"], ["p_size"])
    v = pipe.transform(a).select("row_id", vector_to_array("features").alias("v"))
    rest = F.slice("v", F.lit(2), F.size("v"))
    return v.select("row_id", F.round(F.col("v")[0], 7).alias("f0"),
                    (F.array_position(rest, 1.0) - 1).alias("slot"), F.size(rest).cast("long").alias("slots"))


@query("export_reload_split", f"""WITH {TRAIN_SQL} SELECT split, count(*) AS n, round(sum(l_extendedprice), 2) AS label_sum FROM s GROUP BY split""")
def export_reload(spark, sf):
    both = with_split(lines(spark, sf), SEED)
    path = new_folder(spark, "split")
    export_split(both, path)
    train, test = load_split(spark, path, both.schema)
    agg = [F.count("*").alias("n"), F.round(F.sum(LABEL), 2).alias("label_sum")]
    return train.agg(F.lit("train").alias("split"), *agg).unionByName(test.agg(F.lit("test").alias("split"), *agg))
