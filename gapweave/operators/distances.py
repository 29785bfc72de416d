"""A scale from all pairwise distances of a sample: a quantile of the halved squared distances, times a factor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.functions.gram import column_means
from gapweave.functions.rng import hash_uniform
from gapweave.model import ROW_ID

BUCKETS = 4096
#: A bucket with no more pairs than this is read instead of searched further.
FETCH = 8192
#: Points whose distances to a block of points are held at once.
BLOCK = 256


def distance_scale(df: DataFrame, columns: list[str], quant: float = 0.5, mult: float = 0.05, max_points: int = 2000, seed: int = 0, row_id: str = ROW_ID) -> float | None:
    """Missing values count as their column's mean. Of more than ``max_points`` rows those with the lowest hashes are taken, so the
    sample, and what is broadcast, is bounded; pairs are counted block by block in an interval that narrows to the wanted
    rank, and are never stored. None if no two points differ."""
    means = column_means(df, columns)
    filled = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(means[c] or 0.0))).alias(f"x{i}") for i, c in enumerate(columns)]
    rows = df.select(F.col(row_id).alias("row_id"), *filled).orderBy(hash_uniform(seed, "pairs", "", "row_id"), "row_id").limit(max_points).collect()
    points = np.array([r[1:] for r in rows], float).reshape(len(rows), len(columns))
    rank, (n, lo, hi) = None, _count(df.sparkSession, points, 0.0, np.inf, 0)[:3]
    if not n:
        return None
    rank = max(1, int(quant * n))
    while lo < hi:
        n, _, _, counts, lows, highs = _count(df.sparkSession, points, lo, hi, BUCKETS)
        upto = np.cumsum(counts)
        b = int(np.searchsorted(upto, rank))
        rank -= int(upto[b] - counts[b])
        lo, hi = lows[b], highs[b]
        if counts[b] <= FETCH and lo < hi:
            return float(np.sort(_fetch(df.sparkSession, points, lo, hi))[rank - 1]) * mult
    return float(lo) * mult


def _distances(points: np.ndarray, own: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(own), BLOCK):
        x = points[own[at: at + BLOCK]]
        total = np.zeros((len(x), len(points)))
        for j in range(points.shape[1]):
            total += (x[:, j, None] - points[None, :, j]) ** 2
        yield total.ravel() / 2.0


def _parts(spark: SparkSession, points: np.ndarray) -> DataFrame:
    return spark.range(0, len(points), 1, max(1, min(len(points) // BLOCK + 1, 4 * spark.sparkContext.defaultParallelism)))


def _count(spark: SparkSession, points: np.ndarray, lo: float, hi: float, buckets: int):
    """Positive distances within [lo, hi]: how many, least and largest; with buckets, the same for each of these."""
    sent, k = spark.sparkContext.broadcast(points), max(buckets, 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, low, high = np.zeros(k, np.int64), np.full(k, np.inf), np.full(k, -np.inf)
        for f in frames:
            for d in _distances(sent.value, f["id"].to_numpy()):
                d = d[(d > 0) & (d >= lo) & (d <= hi)]
                b = np.minimum(((d - lo) / (hi - lo) * k).astype(np.int64), k - 1) if buckets else np.zeros(len(d), np.int64)
                n += np.bincount(b, minlength=k)
                np.minimum.at(low, b, d)
                np.maximum.at(high, b, d)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"b": some, "n": n[some], "low": low[some], "high": high[some]})

    rows = _parts(spark, points).mapInPandas(run, "b long, n long, low double, high double").groupBy("b").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    counts, lows, highs = np.zeros(k, np.int64), np.full(k, np.inf), np.full(k, -np.inf)
    for r in rows:
        counts[r["b"]], lows[r["b"]], highs[r["b"]] = r["n"], r["low"], r["high"]
    return int(counts.sum()), lows.min(), highs.max(), counts, lows, highs


def _fetch(spark: SparkSession, points: np.ndarray, lo: float, hi: float) -> np.ndarray:
    sent = spark.sparkContext.broadcast(points)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for d in _distances(sent.value, f["id"].to_numpy()):
                yield pd.DataFrame({"d": d[(d >= lo) & (d <= hi)]})

    return np.array([r["d"] for r in _parts(spark, points).mapInPandas(run, "d double").collect()])
