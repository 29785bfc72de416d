"""Where intermediate tables live, and how long lineages are cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="gapweave-")
    sc.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/gapweave/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: keeps partitions and their order, ends the lineage."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_table(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write to the shared folder and read back: columnar, prunable, no lineage."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
