"""Global order without a single-partition window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.session import settle

_POSITION_BITS = 33  # layout documented for monotonically_increasing_id


def range_sorted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in key order across partitions; the last key must be unique.

    The checkpoint fixes which rows sit in which partition, so later passes over
    the result agree with each other, also after a lost executor.
    """
    return settle(df.repartitionByRange(*keys).sortWithinPartitions(*keys))


def with_global_index(df: DataFrame, keys: list[str], name: str = "idx") -> DataFrame:
    """Add 0-based positions in key order."""
    ordered = range_sorted(df, keys)
    sizes = ordered.groupBy(F.spark_partition_id().alias("p")).count().collect()
    starts, at = [], 0
    for r in sorted(sizes, key=lambda r: r["p"]):
        starts += [F.lit(r["p"]), F.lit(at)]
        at += r["count"]
    if not starts:
        return ordered.withColumn(name, F.lit(0).cast("long"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return ordered.withColumn(name, F.create_map(*starts)[F.spark_partition_id()].cast("long") + inside)


def with_previous(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Add ``prev_<c>``: the value in the row before, in key order (NULL in the first row)."""
    ordered = range_sorted(df, keys).select(F.spark_partition_id().alias("part"), "*")
    last = (
        ordered.groupBy("part")
        .agg(F.max_by(F.struct(*columns), F.struct(*keys)).alias("last"))
        .collect()
    )
    # one row per partition
    carry, seen = {}, None
    for r in sorted(last, key=lambda r: r["part"]):
        carry[r["part"]] = seen
        seen = [r["last"][c] for c in columns]
    types = {f.name: f for f in ordered.schema.fields}
    schema = T.StructType(
        [f for f in ordered.schema.fields if f.name != "part"]
        + [T.StructField(f"prev_{c}", types[c].dataType, True) for c in columns]
    )

    def shift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for b in batches:
            if b.empty:
                continue
            if before is None:
                before = carry[int(b["part"].iloc[0])] or [None] * len(columns)
            moved = b[columns].shift(1)
            for i, c in enumerate(columns):
                moved[c] = moved[c].astype("float64")
                moved.iloc[0, i] = before[i]
            before = b[columns].iloc[-1].tolist()
            moved.columns = [f"prev_{c}" for c in columns]
            yield pd.concat([b.drop(columns="part"), moved], axis=1)

    return ordered.mapInPandas(shift, schema)
