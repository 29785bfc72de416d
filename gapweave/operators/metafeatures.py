"""The 33 dataset meta-features.

Plain statistics share one scan and the pairwise products one more; quantiles
are searched without sorting. Features built on the order of y share one range
sort, and the nearest-neighbour ones use the pruned search.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions.gram import moments, pairwise
from gapweave.functions.linear import ridge
from gapweave.functions.neighbours import nearest
from gapweave.functions.numeric import linear, missing_count, total
from gapweave.functions.ordering import with_previous
from gapweave.functions.rng import hash_uniform
from gapweave.functions.selection import quantiles_linear
from gapweave.model import ROW_ID

ALL = [f"MF{i}" for i in range(1, 34)]


def _skew(g: float | None, n: int) -> float:
    """Bias-corrected skewness from the population one."""
    if n < 3:
        return math.nan
    return 0.0 if g is None else g * math.sqrt(n * (n - 1)) / (n - 2)


def _kurt(k: float | None, n: int) -> float:
    """Bias-corrected excess kurtosis."""
    if n < 4:
        return math.nan
    return 0.0 if k is None else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * k + 6)


def _nanmean(v) -> float:
    v = np.asarray(v, float)
    return float(np.nanmean(v)) if np.isfinite(v).any() else math.nan


def _column_mean(m: np.ndarray) -> float:
    """Mean over columns of each column's mean over its defined entries."""
    return _nanmean([_nanmean(m[:, j]) for j in range(m.shape[1])])


def _basic(df, features, label) -> dict:
    d = len(features)
    y = F.col(label)
    row = df.agg(
        F.count("*").alias("n"), F.sum(missing_count(features)).alias("gaps"),
        F.avg(y).alias("ym"), F.stddev_samp(y).alias("ys"), F.var_pop(y).alias("yv"), F.count(y).alias("yn"),
        F.skewness(y).alias("yg"), F.kurtosis(y).alias("yk"),
        *[f(F.col(c)).alias(f"{t}{i}") for i, c in enumerate(features)
          for t, f in (("c", F.count), ("m", F.avg), ("v", F.var_pop), ("lo", F.min), ("hi", F.max),
                       ("g", F.skewness), ("k", F.kurtosis))],
    ).first()
    n = row["n"]
    counts = np.array([row[f"c{i}"] for i in range(d)], float)
    means = np.array([row[f"m{i}"] or 0.0 for i in range(d)])
    variances = np.array([row[f"v{i}"] or 0.0 for i in range(d)])
    cells = counts.sum()
    flat = (counts * means).sum() / cells if cells else math.nan
    var = (counts * (variances + (means - flat) ** 2)).sum() / cells if cells else math.nan
    lows = [row[f"lo{i}"] for i in range(d) if row[f"lo{i}"] is not None]
    highs = [row[f"hi{i}"] for i in range(d) if row[f"hi{i}"] is not None]
    return {
        "MF1": row["gaps"] / (n * d), "MF3": n, "MF4": d / n, "MF5": math.sqrt(var), "MF6": row["ys"], "MF7": d,
        "MF8": (counts * means).sum() / (n * d), "MF9": row["ym"], "MF10": min(lows, default=math.nan),
        "MF11": max(highs, default=math.nan), "MF12": var, "MF13": row["yv"], "MF25": n / d,
        "MF26": _nanmean([_kurt(row[f"k{i}"], row[f"c{i}"]) for i in range(d)]),
        "MF27": _nanmean([_skew(row[f"g{i}"], row[f"c{i}"]) for i in range(d)]),
        "MF28": _skew(row["yg"], row["yn"]), "MF29": _kurt(row["yk"], row["yn"]),
    }


def _correlations(df, features, label) -> dict:
    d = len(features)
    p = pairwise(df, [*features, label])
    corr, cov = np.abs(p.corr[:d, :d]), np.abs(p.cov_samp[:d, :d])
    with_y = p.corr[:d, d]
    known = with_y[np.isfinite(with_y)]
    spread = [np.nanstd(corr[:, j], ddof=1) if np.isfinite(corr[:, j]).sum() > 1 else math.nan for j in range(d)]
    return {
        "MF14": _column_mean(corr), "MF15": _nanmean(spread), "MF16": _nanmean(np.abs(with_y)),
        "MF17": float(known.max()) if len(known) else math.nan, "MF18": float(known.min()) if len(known) else math.nan,
        "MF19": _column_mean(cov),
    }


def _quantiles(df, features, label) -> dict:
    y = quantiles_linear(df, {label: [0.25, 0.75]})
    # all cells as one column: one pruned read per feature, which columnar files make as cheap as one wide read
    cells = reduce(DataFrame.unionAll, [df.select(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("v")) for c in features])
    v = quantiles_linear(cells, {"v": [0.25, 0.75]})
    return {"MF30": v[("v", 0.75)], "MF31": y[(label, 0.75)], "MF32": y[(label, 0.25)], "MF33": v[("v", 0.25)]}


def interpolate(df: DataFrame, features: list[str], label: str, seed: int, row_id: str = ROW_ID) -> DataFrame:
    """A random point between each row and the one before it in y order, label included; the gap's length as ``step``."""
    pairs = with_previous(df, [label, row_id], [*features, label]).where(F.col(f"prev_{label}").isNotNull())
    lam = hash_uniform(seed, "between", "", row_id)
    step = F.sqrt(total([(F.col(c) - F.col(f"prev_{c}")) ** 2 for c in features]))
    points = [(lam * F.col(c) + (F.lit(1.0) - lam) * F.col(f"prev_{c}")).alias(c) for c in [*features, label]]
    return pairs.select(row_id, *points, step.alias("step"))


def _complexity(df, features, label, wanted, seed, row_id) -> dict:
    zero = df.select(row_id, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features],
                     F.col(label).cast("double").alias(label))
    out = {}
    if wanted & {"MF20", "MF21"}:
        fit = ridge(moments(zero, [*features, label]), features, label)
        if "MF20" in wanted:
            r = zero.agg(F.max(label) - F.min(label)).first()[0]
            out["MF20"] = fit.sse / fit.n / r**2 if r else 0.0
    if wanted & {"MF21", "MF22", "MF24"}:
        between = interpolate(zero, features, label, seed, row_id)
        err = F.col(label) - linear([F.col(c) for c in features], list(fit.coef), fit.intercept) if "MF21" in wanted else F.lit(0.0)
        row = between.agg(F.avg(err * err).alias("l3"), F.avg("step").alias("s2")).first()
        out |= {k: row[c] for k, c in (("MF21", "l3"), ("MF22", "s2")) if k in wanted}
        if "MF24" in wanted:
            out["MF24"] = _nn_error(between, zero, features, label, row_id, False)
    if "MF23" in wanted:
        out["MF23"] = _nn_error(zero, zero, features, label, row_id, True)
    return out


def _nn_error(points, donors, features, label, row_id, exclude_self) -> float:
    """Mean squared difference between a point's label and its nearest donor's."""
    near = nearest(points, donors.withColumnRenamed(label, "__y"), features, ["__y"], 1, row_id, exclude_self)
    both = points.select(row_id, label).join(near.select(row_id, "__y"), row_id)
    return both.agg(F.avg((F.col(label) - F.col("__y")) ** 2)).first()[0]


def meta_features(df: DataFrame, features: list[str], label: str, names: list[str] | None = None, prefix: str = "",
                  seed: int = 0, row_id: str = ROW_ID, published_layout: bool = False) -> dict[str, float]:
    """Selected meta-features of one training frame (gaps included) as a flat dict."""
    names = ALL if names is None else names
    unknown = [n for n in names if n not in ALL]
    if unknown:
        raise ValueError(f"unknown meta-features {unknown}")
    wanted = set(names)
    if published_layout:
        wanted |= {"MF10", "MF11"} if wanted & {"MF10", "MF11"} else set()
    heavy = [f"MF{i}" for i in (2, *range(14, 25), *range(30, 34))]
    scans_again = bool(wanted & set(heavy))
    df = df.select(row_id, *features, label)
    if scans_again:
        # a pruned copy serves all scans; gap masks and keys are not computed again in each
        df = df.persist()
    out = _basic(df, features, label)
    if "MF2" in wanted:
        out["MF2"] = df.agg(F.count_distinct(F.col(label))).first()[0]
    if wanted & {f"MF{i}" for i in range(14, 20)}:
        out |= _correlations(df, features, label)
    if wanted & {f"MF{i}" for i in range(20, 25)}:
        out |= _complexity(df, features, label, wanted, seed, row_id)
    if wanted & {f"MF{i}" for i in range(30, 34)}:
        out |= _quantiles(df, features, label)
    if scans_again:
        df.unpersist()
    if published_layout:
        out["MF10"], out["MF11"] = out["MF11"], out["MF10"]
    return {prefix + n: float(out[n]) if out[n] is not None else math.nan for n in names}


def meta_feature_row(df: DataFrame, features: list[str], label: str, **kw) -> DataFrame:
    values = meta_features(df, features, label, **kw)
    return df.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"{n} double" for n in values))
