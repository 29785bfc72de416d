"""NULLs, NaN, infinities, copies and odd files where the library must neither lose nor invent data."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.functions.selection import order_statistics
from gapweave.model import with_row_id
from gapweave.operators.ampute import ampute
from gapweave.operators.impute import impute
from gapweave.operators.regress import get_regressor
from gapweave.plans.timing import TimedOut, limited
from gapweave.sources.files import coerce_numeric, read_arff, read_csv


def test_keys_tell_nulls_apart(spark):
    rows = [(1, None, 2), (1, 2, None), (None, 1, 2), (12, None, None), (1, 2, 2), (12, 2, None)]
    ids = with_row_id(spark.createDataFrame(rows, "a int, b int, c int"))
    assert ids.select("row_id").distinct().count() == len(rows)


@pytest.mark.parametrize("values", [
    [math.inf, -math.inf, 3.0, 1.0, 2.0, math.nan, None, math.inf],
    [5e-324, 1e-300, 1e300, -1e300, 1.7e308, -1.7e308, 0.0, 1.0],
    [7.0] * 50, [0.0, -0.0, 1.0],
])
def test_order_statistics_of_odd_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = sorted(v for v in values if v is not None and not math.isnan(v))
    ranks = list(range(1, len(want) + 1))
    got = order_statistics(df, {"x": ranks})
    assert [got[("x", k)] for k in ranks] == want


def test_order_statistics_need_few_scans(spark, monkeypatch):
    """Values of very different size: few passes, by count of the passes themselves."""
    from gapweave.functions import selection

    passes = []
    real = selection._bucket_counts
    monkeypatch.setattr(selection, "_bucket_counts", lambda *a: passes.append(1) or real(*a))
    x = np.exp(np.random.default_rng(1).uniform(-600, 600, 20000))
    got = order_statistics(spark.createDataFrame([(float(v),) for v in x], "x double"), {"x": [1, 777, 10000, 20000]})
    assert [got[("x", k)] for k in (1, 777, 10000, 20000)] == [float(np.sort(x)[k - 1]) for k in (1, 777, 10000, 20000)]
    assert len(passes) <= 8


def test_nan_counts_as_missing(spark):
    rows = [("a", 1.0), ("b", None), ("c", math.nan), ("d", 3.0)]
    out = impute(spark.createDataFrame(rows, "row_id string, x double"), "mean", ["x"])
    assert {r.row_id: r.x for r in out.collect()} == {"a": 1.0, "b": 2.0, "c": 2.0, "d": 3.0}


def test_gaps_in_the_drivers_do_not_blank_the_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(str(i), *(None if rng.random() < 0.5 else float(v) for v in rng.normal(size=2)), float(rng.normal())) for i in range(4000)]
    df = spark.createDataFrame(rows, "row_id string, a double, b double, c double")
    out = ampute(df, ["a", "b", "c"], 0.1, "MAR", seed=3, keep_truth=True)
    for c in ("a", "b", "c"):
        masked = out.agg(F.count_if(f"{c}__mis").alias("n"), F.count_if(F.col(f"{c}__mis").isNull()).alias("z")).first()
        assert masked.z == 0 and (masked.n == 0 or abs(masked.n / 4000 - 0.1) < 0.03)


def test_arff_keeps_data_lines_with_an_at_sign(spark, tmp_path):
    (tmp_path / "x.arff").write_text("% note\n@RELATION r\n@attribute who string\n@attribute n numeric\n@DATA\nbob,1\n@ann,2\n'a, b',?\n")
    assert sorted((r.who, r.n) for r in read_arff(spark, str(tmp_path / "x.arff")).collect() if r.n) == [("@ann", 2.0), ("bob", 1.0)]


def test_csv_is_strict(spark, tmp_path):
    (tmp_path / "x.csv").write_text('who,n\n"a, ""b""",1\nc,two\n')
    df = read_csv(spark, str(tmp_path / "x.csv"))
    assert df.first().who == 'a, "b"'
    with pytest.raises(Exception, match="two"):
        coerce_numeric(df, ["n"]).collect()


def test_knn_regressor_keeps_rows_without_neighbours(spark):
    train = spark.createDataFrame([(str(i), float(i), float(i)) for i in range(10)], "row_id string, x double, y double")
    test = spark.createDataFrame([("p", 3.0, 0.0), ("q", None, 0.0)], "row_id string, x double, y double")
    got = {r.row_id: r.prediction for r in get_regressor("KNN", ["x"], "y").fit(train).predict(test).collect()}
    assert got["p"] == 3.0 and got["q"] is None


def test_time_limit_also_stops_a_loop_between_jobs(spark):
    def slow():
        time.sleep(1.5)
        return spark.range(10).count()

    with pytest.raises(TimedOut):
        limited(spark, slow, 0.5)


def test_more_than_64_targets(spark):
    """Every one of 70 columns is filled from its neighbours, none by its mean."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 70)) * 10
    x = np.repeat(base, 20, axis=0) + rng.normal(size=(60, 70)) * 0.01
    rows = [[str(i), *map(float, v)] for i, v in enumerate(x)]
    for j in (0, 61, 63, 69):
        rows[5][1 + j] = None
    cols = [f"c{j}" for j in range(70)]
    out = impute(spark.createDataFrame(rows, "row_id string, " + ", ".join(f"{c} double" for c in cols)), "knn", cols)
    got = out.where("row_id = '5'").first()
    assert all(abs(got[f"c{j}"] - base[0, j]) < 0.1 for j in (0, 61, 63, 69))


def test_lines_that_differ_in_any_column_have_keys_of_their_own(spark, tmp_path):
    """Order, part, supplier, number and price alike; each line differs from the first in one other column."""
    import datetime

    from checks.ampute import ampute_mcar

    first = (1, 2, 3, 4, 5.0, 60.0, 0.1, 0.2, "A", "F", datetime.datetime(2020, 1, 1))
    other = {4: 6.0, 6: 0.3, 7: None, 8: "R", 9: "O", 10: datetime.datetime(2020, 1, 2)}
    rows = [first, *(tuple(v if i == k else x for i, x in enumerate(first)) for k, v in other.items())]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert len({r.row_id for r in ampute_mcar(spark, str(tmp_path)).collect()}) == len(rows)
