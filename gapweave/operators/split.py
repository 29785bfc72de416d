"""Train/test split and its export."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.functions.rng import hash_uniform
from gapweave.functions.selection import lowest_by_hash
from gapweave.model import ROW_ID

TEST_SHARE = 0.25


def with_split(df: DataFrame, seed: int, test_share: float = TEST_SHARE, row_id: str = ROW_ID) -> DataFrame:
    """Add ``split``: exactly ceil(share * n) rows are 'test'."""
    u = hash_uniform(seed, "split", "", row_id)
    n = df.count()
    test = lowest_by_hash(df, {"u": u}, {"u": math.ceil(test_share * n)}, row_id, n)["u"]
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def train_test(df: DataFrame, seed: int, test_share: float = TEST_SHARE) -> tuple[DataFrame, DataFrame]:
    both = with_split(df, seed, test_share)
    return both.where("split = 'train'").drop("split"), both.where("split = 'test'").drop("split")


def export_split(both: DataFrame, path: str) -> None:
    both.write.partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    both = spark.read.schema(schema).parquet(path)
    return both.where("split = 'train'").drop("split"), both.where("split = 'test'").drop("split")
