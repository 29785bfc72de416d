"""Experiment plans as tables: which cells to run, which are done, which are absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["seed", "ds_name", "missing", "mecha", "imputer", "new_imputer", "regressor"]

# fixed values of the published example plan
SMALL_PLAN = {
    "SEED": 1001,
    "REPEAT": 2,
    "DATASETS": ["bupa1"],
    "MISSING": [0.5],
    "MECHA": ["MCAR"],
    "IMPUTER": ["MLP2"],
    "NEW_IMPUTER": [],
    "ANALYZE_FEATURES": [f"MF{i}" for i in range(1, 34)],
    "REGRESSOR": ["MLPregressor", "svregression", "xgboost", "ridgeregression"],
    "MISSING_REGRESSOR": ["xgboost", "lightgbm"],
}


def _choices(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def dataset_table(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "ds_name string")


def plan_grid(datasets: DataFrame, plan: dict) -> DataFrame:
    """One row per cell: each dataset unfolded over seeds, rates, mechanisms, imputers and regressors.

    A rate of None runs the regressors on complete data, without mechanism or imputer.
    """
    seeds = list(range(plan["SEED"], plan["SEED"] + plan.get("REPEAT", 1)))
    base = datasets.select("ds_name").withColumn("seed", F.explode(_choices(seeds, "int")))
    rates = [m for m in plan["MISSING"] if m is not None]
    none = F.lit(None)

    def cells(frame: DataFrame, imputer: Column, new: Column, regressors: list[str]) -> DataFrame:
        frame = frame.select("*", imputer.alias("imputer"), new.alias("new_imputer"))
        return frame.withColumn("regressor", F.explode(_choices(regressors, "string"))).select(*KEYS)

    parts = []
    if None in plan["MISSING"] and plan["REGRESSOR"]:
        whole = base.select("*", none.cast("double").alias("missing"), none.cast("string").alias("mecha"))
        parts.append(cells(whole, none.cast("string"), none.cast("boolean"), plan["REGRESSOR"]))
    if rates and plan["MECHA"]:
        gaps = base.withColumn("missing", F.explode(_choices(rates, "double"))).withColumn("mecha", F.explode(_choices(plan["MECHA"], "string")))
        if plan.get("MISSING_REGRESSOR"):
            parts.append(cells(gaps, none.cast("string"), none.cast("boolean"), plan["MISSING_REGRESSOR"]))
        for key, flag in (("IMPUTER", False), ("NEW_IMPUTER", True)):
            if plan.get(key) and plan["REGRESSOR"]:
                parts.append(cells(gaps, F.explode(_choices(plan[key], "string")), F.lit(flag), plan["REGRESSOR"]))
    if not parts:
        raise ValueError("the plan has no cells")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def open_cells(plan: DataFrame, finished: DataFrame, keys: list[str] = ("seed", "ds_name")) -> DataFrame:
    """Cells whose (seed, dataset) has no result yet under this tag."""
    return plan.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def absent(plan: DataFrame, results: DataFrame, keys: list[str] = ("seed", "ds_name")) -> DataFrame:
    """(seed, dataset) pairs of the plan that no result file covers."""
    return plan.select(*keys).distinct().join(results.select(*keys).distinct(), list(keys), "left_anti")
