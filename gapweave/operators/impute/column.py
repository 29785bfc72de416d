"""One model per column: networks or least squares, filling column after column in place."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions.gram import column_means
from gapweave.functions.mlp import Mlp, fit_mlps, fit_small_mlps
from gapweave.functions.numeric import linear, missing_count
from gapweave.functions.training import map_matrix
from gapweave.operators.impute.base import Imputer, ImputerError, Model

LEAST = 250  # rows of the report of least-missing rows
MIN_TRAIN = 2


def least_missing(df: DataFrame, target: str, features: list[str], row_id: str, keep: int = LEAST) -> DataFrame:
    """The ``keep`` rows with the target and the fewest gaps among the features."""
    gaps = missing_count(features).alias("n_nan")
    return df.where(F.col(target).isNotNull()).select("*", gaps).orderBy("n_nan", row_id).limit(keep)


@dataclass
class NetModel(Model):
    columns: list[str]
    nets: list[Mlp]
    means: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        nets, means = self.nets, self.means

        def fill(x: np.ndarray) -> np.ndarray:
            x = x.copy()
            for j, net in enumerate(nets):
                open_ = np.flatnonzero(np.isnan(x[:, j]))
                if len(open_):
                    rows = np.where(np.isnan(x[open_]), means, x[open_])
                    x[open_, j] = net.predict(rows)
            return x

        return map_matrix(df, [F.col(c) for c in self.columns], self.columns, fill)


def _array(means: dict[str, float | None], cols: list[str]) -> np.ndarray:
    return np.array([means[c] if means[c] is not None else np.nan for c in cols], float)


class MlpImputer(Imputer):
    """A network per column, trained on every row that has the column (at most 2000 epochs)."""

    def __init__(self, columns=None, row_id="row_id", max_epochs: int = 2000, seed: int = 1):
        super().__init__(columns, row_id)
        self.max_epochs, self.seed = max_epochs, seed

    def fit(self, train: DataFrame) -> NetModel:
        cols = self.on(train)
        d = len(cols)
        overall = _array(column_means(train, cols), cols)
        # means over the rows that have the target; an empty column falls back to its overall mean
        row = train.agg(
            *[F.count(F.col(t)).alias(f"n{j}") for j, t in enumerate(cols)],
            *[F.avg(F.when(F.col(t).isNotNull(), F.col(c))).alias(f"m{j}_{i}") for j, t in enumerate(cols) for i, c in enumerate(cols)],
        ).first()
        jobs = []
        for j in range(d):
            if row[f"n{j}"] < MIN_TRAIN:
                raise ImputerError("training set too small")
            inputs = [i for i in range(d) if i != j]
            fill = [overall[i] if row[f"m{j}_{i}"] is None else row[f"m{j}_{i}"] for i in inputs]
            jobs.append((inputs, j, np.nan_to_num(np.array(fill, float))))
        nets = fit_mlps(train, cols, jobs, self.max_epochs, self.seed, self.row_id)
        return NetModel(cols, nets, np.nan_to_num(overall))


class MlpSubsetImputer(Imputer):
    """As above, at most 300 epochs. ``keep`` restricts each target's training to that many rows with
    the fewest gaps, as the original does with 250; without it every row that has the target counts."""

    def __init__(self, columns=None, row_id="row_id", max_epochs: int = 300, keep: int | None = None, seed: int = 1):
        super().__init__(columns, row_id)
        self.max_epochs, self.keep, self.seed = max_epochs, keep, seed

    def fit(self, train: DataFrame) -> NetModel:
        if self.keep is None:
            return MlpImputer(self.columns, self.row_id, self.max_epochs, self.seed).fit(train)
        cols = self.on(train)
        jobs, picked = [], []
        for j in range(len(cols)):
            subset, fill = _subset(train, cols, j, self.row_id, self.keep)
            jobs.append(([i for i in range(len(cols)) if i != j], j, fill))
            picked.append(subset.select(F.lit(j).alias("job"), F.col(self.row_id).alias("row_id"), *cols))
        nets = fit_small_mlps(reduce(DataFrame.unionByName, picked), cols, jobs, self.max_epochs, self.seed)
        return NetModel(cols, nets, np.nan_to_num(_array(column_means(train, cols), cols)))


def _subset(train: DataFrame, cols: list[str], j: int, row_id: str, keep: int | None) -> tuple[DataFrame, np.ndarray]:
    features = [c for i, c in enumerate(cols) if i != j]
    own = train.select(row_id, *cols)
    subset = own.where(F.col(cols[j]).isNotNull()) if keep is None else least_missing(own, cols[j], features, row_id, keep).persist()
    row = subset.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(features)]).first()
    if row["n"] < MIN_TRAIN:
        raise ImputerError("training set too small")
    fill = np.array([row[f"m_{i}"] if row[f"m_{i}"] is not None else np.nan for i in range(len(features))], float)
    if np.isnan(fill).any():
        raise ImputerError("a feature has no values in the training subset")
    return subset, fill


@dataclass
class LinearModel(Model):
    columns: list[str]
    coef: list[np.ndarray]
    intercept: list[float]
    means: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Each target sees the values already filled in the columns before it."""
        now = {c: F.col(c) for c in self.columns}
        for j, target in enumerate(self.columns):
            inputs = [F.coalesce(now[c], F.lit(self.means[c])) for c in self.columns if c != target]
            # one projection per target keeps expressions from growing inside each other
            df = df.withColumn(target, F.coalesce(F.col(target), linear(inputs, list(self.coef[j]), self.intercept[j])))
        return df


class LinearSubsetImputer(Imputer):
    """Least squares per column, on every row that has it, or the ``keep`` ones with the fewest gaps."""

    def __init__(self, columns=None, row_id="row_id", keep: int | None = None):
        super().__init__(columns, row_id)
        self.keep = keep

    def fit(self, train: DataFrame) -> LinearModel:
        from gapweave.functions.gram import moments
        from gapweave.functions.linear import ridge

        cols = self.on(train)
        coef, intercept = [], []
        for j, target in enumerate(cols):
            features = [c for c in cols if c != target]
            subset, fill = _subset(train, cols, j, self.row_id, self.keep)
            full = subset.withColumns({c: F.coalesce(F.col(c), F.lit(float(m))) for c, m in zip(features, fill)})
            fit = ridge(moments(full, cols), features, target)
            if self.keep is not None:
                subset.unpersist()
            coef.append(fit.coef)
            intercept.append(fit.intercept)
        means = column_means(train, cols)
        return LinearModel(cols, coef, intercept, {c: means[c] if means[c] is not None else 0.0 for c in cols})
