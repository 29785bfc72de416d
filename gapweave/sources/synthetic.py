"""Generated datasets with a known layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.functions.rng import hash_uniform
from gapweave.model import ROW_ID

# fixed values
LEVELS = [
    ["AA", "BB", "CC"],
    ["PP", "QQ", "RR", "SS", "TT", "UU", "VV", "WW", "XX", "YY", "ZZ"],
]
LABEL_START = 1000
SEED = 1001


def generate(spark: SparkSession, numeric: list[str], categorical: list[str], label: str, rows: int,
             seed: int = SEED) -> DataFrame:
    """Numeric column i counts up from 10**i; categories are drawn uniformly; the label counts up from 1000."""
    if len(categorical) > len(LEVELS):
        raise ValueError(f"at most {len(LEVELS)} categorical columns can be generated")
    rid = F.col("id").alias(ROW_ID)
    cols = [(F.col("id") + F.lit(10**i)).alias(c) for i, c in enumerate(numeric)]
    for c, levels in zip(categorical, LEVELS):
        at = F.floor(hash_uniform(seed, "enum", c, F.col("id")) * F.lit(float(len(levels)))).cast("int") + 1
        cols.append(F.element_at(F.array(*[F.lit(v) for v in levels]), at).alias(c))
    return spark.range(rows).select(rid, *cols, (F.col("id") + F.lit(LABEL_START)).alias(label))
