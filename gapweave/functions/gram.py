"""Sufficient statistics for linear methods, in one pass each.

Sums are taken around column means, so large offsets do not eat the digits.
Only results of size O(d^2) per group reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SQL_WIDTH = 12  # wider products are summed by matrix products inside tasks


def column_means(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    row = df.agg(*[F.avg(F.col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}


@dataclass
class Moments:
    """n, means and centred cross products of complete rows."""

    columns: list[str]
    n: int
    mean: np.ndarray
    cross: np.ndarray

    def at(self, names: list[str]) -> list[int]:
        return [self.columns.index(c) for c in names]


def moments(df: DataFrame, columns: list[str]) -> Moments:
    """Cross products of columns without missing values."""
    d = len(columns)
    centre = column_means(df, columns)
    shift = [centre[c] or 0.0 for c in columns]
    x = [F.col(c) - F.lit(m) for c, m in zip(columns, shift)]
    if d <= SQL_WIDTH:
        row = df.agg(
            F.count("*").alias("n"),
            *[F.sum(x[i]).alias(f"s{i}") for i in range(d)],
            *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)],
        ).first()
        n = row["n"]
        s = np.array([row[f"s{i}"] or 0.0 for i in range(d)])
        p = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                p[i, j] = p[j, i] = row[f"p{i}_{j}"] or 0.0
    else:
        total = _summed(df.select(*[xi.alias(c) for xi, c in zip(x, columns)]), lambda m: _with_ones(m).T @ _with_ones(m))
        full = total.reshape(d + 1, d + 1)
        n, s, p = int(full[0, 0]), full[0, 1:], full[1:, 1:]
    mean = s / max(n, 1)
    return Moments(columns, n, mean + np.array(shift), p - n * np.outer(mean, mean))


def _with_ones(m: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(m)), m])


def _summed(df: DataFrame, measure) -> np.ndarray:
    """Add up ``measure(rows)`` over all batches; each task emits one partial result."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for b in batches:
            part = measure(b.to_numpy(dtype="float64")).ravel()
            acc = part if acc is None else acc + part
        if acc is not None:
            yield pd.DataFrame({"pos": np.arange(acc.size), "v": acc})

    rows = df.mapInPandas(partial, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["pos"]] = r["v"]
    return out


@dataclass
class Pairwise:
    """Pairwise-complete covariances; entry (i, j) uses rows where both are observed."""

    n: np.ndarray
    cov_pop: np.ndarray
    var_pop: np.ndarray  # variance of i over the rows where j is observed too

    @property
    def cov_samp(self) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.where(self.n > 1, self.cov_pop * self.n / (self.n - 1), np.nan)

    @property
    def corr(self) -> np.ndarray:
        with np.errstate(all="ignore"):
            scale = np.sqrt(self.var_pop * self.var_pop.T)
            return np.where(scale > 0, self.cov_pop / scale, np.nan)


def pairwise(df: DataFrame, columns: list[str]) -> Pairwise:
    """Pairwise-complete second moments of columns with gaps."""
    d = len(columns)
    if d <= SQL_WIDTH:
        aggs = []
        for i in range(d):
            for j in range(i, d):
                a, b = F.col(columns[i]), F.col(columns[j])
                aggs += [
                    F.count(F.when(b.isNotNull(), a)).alias(f"n{i}_{j}"),
                    F.covar_pop(a, b).alias(f"c{i}_{j}"),
                    F.var_pop(F.when(b.isNotNull(), a)).alias(f"v{i}_{j}"),
                    F.var_pop(F.when(a.isNotNull(), b)).alias(f"v{j}_{i}_"),
                ]
        row = df.agg(*aggs).first()
        n, c, v = np.zeros((d, d)), np.full((d, d), np.nan), np.full((d, d), np.nan)
        for i in range(d):
            for j in range(i, d):
                n[i, j] = n[j, i] = row[f"n{i}_{j}"]
                if row[f"n{i}_{j}"]:
                    c[i, j] = c[j, i] = row[f"c{i}_{j}"]
                    v[i, j], v[j, i] = row[f"v{i}_{j}"], row[f"v{j}_{i}_"]
        return Pairwise(n, c, v)

    centre = column_means(df, columns)
    x = df.select(*[(F.col(c).cast("double") - F.lit(centre[c] or 0.0)).alias(c) for c in columns])

    def masked(m: np.ndarray) -> np.ndarray:
        seen = ~np.isnan(m)
        filled = np.where(seen, m, 0.0)
        seen = seen.astype("float64")
        return np.stack([seen.T @ seen, filled.T @ seen, (filled**2).T @ seen, filled.T @ filled])

    n, s, q, p = _summed(x, masked).reshape(4, d, d)
    with np.errstate(all="ignore"):
        return Pairwise(n, p / n - (s / n) * (s.T / n), np.maximum(q / n - (s / n) ** 2, 0.0))


@dataclass
class PatternGram:
    """Statistics of the rows sharing one pattern of gaps, around ``PatternTable.shift``."""

    seen: np.ndarray  # bool per column
    n: int
    s: np.ndarray
    p: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


@dataclass
class PatternTable:
    columns: list[str]
    shift: np.ndarray
    groups: list[PatternGram]

    @property
    def seen_counts(self) -> np.ndarray:
        return sum(g.n * g.seen for g in self.groups)


def pattern_key(columns: list[str]):
    """Bit j set: column j is missing."""
    bits = [F.when(F.col(c).isNull(), F.lit(1 << j)).otherwise(F.lit(0)).cast("long") for j, c in enumerate(columns)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def pattern_grams(df: DataFrame, columns: list[str], limit: int) -> PatternTable | None:
    """One aggregation per pattern of gaps; None when there are more than ``limit`` patterns.

    Every linear imputer's fit is a function of these tables, whatever the
    number of rows: filled cells are affine in the observed cells of their row.
    """
    d = len(columns)
    if d > SQL_WIDTH:
        return None
    key = pattern_key(columns).alias("pattern")
    if 2**d > limit and df.select(key).distinct().limit(limit + 1).count() > limit:
        return None
    centre = column_means(df, columns)
    shift = np.array([centre[c] or 0.0 for c in columns])
    x = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, shift)]
    rows = df.groupBy(key).agg(
        F.count("*").alias("n"),
        *[f(x[i]).alias(f"{t}{i}") for i in range(d) for t, f in (("s", F.sum), ("lo", F.min), ("hi", F.max))],
        *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)],
    ).collect()
    groups = []
    for r in sorted(rows, key=lambda r: r["pattern"]):
        seen = np.array([not (r["pattern"] >> j) & 1 for j in range(d)])
        p = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                p[i, j] = p[j, i] = r[f"p{i}_{j}"] or 0.0
        pick = lambda t: np.array([r[f"{t}{i}"] or 0.0 for i in range(d)])
        groups.append(PatternGram(seen, r["n"], pick("s"), p, pick("lo"), pick("hi")))
    return PatternTable(list(columns), shift, groups)
