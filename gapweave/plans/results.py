"""Result tables: layout, storing by tag, collecting, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.functions.ordering import with_global_index
from gapweave.operators.metafeatures import ALL

_TEXT = ["ds_name", "mecha", "imputer", "regressor"]
_SCORES = ["rmse", "mse", "mae", "r2", "normrmse"]
_DOUBLE = [
    "missing", "t_missing", "t_impute", "t_fit", "miss_perc", "impute_rmse", "impute_mae", "impute_rmse_num", "impute_mae_num",
    "impute_rmse_cat", "impute_acc_cat", "x_test_impute_rmse", "x_test_impute_mae", "t_meta", "t_y_test_predict",
    "t_y_train_predict", "t_y_test_imp_predict",
    *[f"{p}_{s}" for p in ("y_test", "y_train", "y_test_imp") for s in _SCORES],
    *ALL, *[f"origmf_{m}" for m in ALL],
]
_LONG = ["mask_size", "mask_size_num", "mask_size_cat"]
_FLAGS = ["new_imputer", "imputer_error", "timedout", "regressor_error"]

SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT] + [T.StructField("seed", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in _DOUBLE] + [T.StructField(c, T.LongType()) for c in _LONG]
    + [T.StructField(c, T.BooleanType()) for c in _FLAGS] + [T.StructField("error", T.StringType())]
)


def result_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Ragged result dicts as one typed table; one row per finished cell."""
    for r in rows:
        unknown = set(r) - set(SCHEMA.names)
        if unknown:
            raise ValueError(f"unknown result fields {sorted(unknown)}")

    def value(r, f):
        v = r.get(f.name)
        return float(v) if v is not None and isinstance(f.dataType, T.DoubleType) else v

    return spark.createDataFrame([tuple(value(r, f) for f in SCHEMA.fields) for r in rows], SCHEMA)


def save(df: DataFrame, root: str, tag: str) -> None:
    df.withColumn("tag", F.lit(tag)).write.mode("append").partitionBy("tag", "seed", "ds_name").parquet(f"{root}/results")


def load(spark: SparkSession, root: str, tag: str) -> DataFrame:
    """Results stored under a tag; empty when none were stored yet."""
    from pyspark.errors import AnalysisException

    schema = T.StructType([*SCHEMA.fields, T.StructField("tag", T.StringType())])
    try:
        stored = spark.read.schema(schema).parquet(f"{root}/results")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], schema)
    return stored.where(F.col("tag") == tag).drop("tag")


def ranking(results: DataFrame, score: str = "y_test_rmse") -> DataFrame:
    """Place of each imputer/regressor pair within its dataset, rate and mechanism (ties share a place, missing scores come last).

    Places are differences of global positions, so no group is sorted in one task.
    """
    group = ["ds_name", "missing", "mecha"]
    gone = F.col(score).isNull().alias("__gone")
    # the hash splits long ties over several range partitions
    spread = F.xxhash64(*results.columns).alias("__any")
    placed = with_global_index(results.select("*", gone, spread), [*group, "__gone", score, "__any"], "__at")
    ties = placed.groupBy(*group, score).agg(F.min("__at").alias("__tie"))
    starts = placed.groupBy(*group).agg(F.min("__at").alias("__start"))

    def same(a, b, keys):
        return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])

    ties = ties.alias("t").join(starts.alias("s"), same(ties, starts, group)).select(
        *[F.col(f"t.{k}").alias(f"__{k}") for k in group], F.col(f"t.{score}").alias("__score"),
        (F.col("__tie") - F.col("__start") + 1).cast("int").alias("rank"))
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in group] + [F.col(score).eqNullSafe(F.col("__score"))])
    return placed.join(ties, on).select(*results.columns, "rank")


def winners(results: DataFrame, score: str = "y_test_rmse") -> DataFrame:
    """The best pair per dataset, rate, mechanism and seed; a grouped minimum, no sort."""
    best = F.min_by(F.struct("imputer", "regressor"), F.struct(F.col(score), "imputer", "regressor"))
    scored = results.where(F.col(score).isNotNull())
    out = scored.groupBy("ds_name", "missing", "mecha", "seed").agg(best.alias("best"))
    return out.select("ds_name", "missing", "mecha", "seed", "best.imputer", "best.regressor")
