"""Per-column profile: distinct values, the values themselves when few, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOW_BELOW = 100


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_unique, values, n_missing), values as sorted text or NULL when there are 100 or more.

    One aggregation over (column, value) pairs; only columns a sketch calls
    narrow are allowed to collect their values.
    """
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    guess = df.agg(*[F.approx_count_distinct(t, 0.05).alias(f"g{i}") for i, t in enumerate(texts)]).first()
    narrow = [c for i, c in enumerate(columns) if guess[f"g{i}"] < 2 * SHOW_BELOW]
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), t.alias("value")) for c, t in zip(columns, texts)])).alias("p")).select("p.*")
    counts = pairs.groupBy("column", "value").count()
    keep = F.when(F.col("column").isin(narrow), F.col("value")) if narrow else F.lit(None).cast("string")
    out = counts.groupBy("column").agg(
        F.count("value").alias("n_unique"),
        F.array_join(F.array_sort(F.collect_set(keep)), ",").alias("values"),
        F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)).alias("n_missing"),
    )
    return out.withColumn("values", F.when(F.col("n_unique") < SHOW_BELOW, F.col("values")))
