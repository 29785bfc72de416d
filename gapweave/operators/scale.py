"""Scalers: one aggregation to fit, one projection to apply."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAIN_EPS = 1e-6
ROUND_BELOW = 20


@dataclass
class LinearScale:
    """x -> (x - shift) / width per column, and back."""

    shift: dict[str, float]
    width: dict[str, float]

    def _map(self, df: DataFrame, f) -> DataFrame:
        return df.withColumns({c: f(F.col(c), F.lit(float(self.shift[c])), F.lit(float(self.width[c]))) for c in self.shift})

    def transform(self, df: DataFrame) -> DataFrame:
        return self._map(df, lambda x, s, w: (x - s) / w)

    def inverse(self, df: DataFrame) -> DataFrame:
        return self._map(df, lambda x, s, w: x * w + s)


def _stats(df: DataFrame, columns: list[str], **aggs) -> dict[str, dict[str, float]]:
    row = df.agg(*[f(F.col(c)).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in aggs.items()]).first()
    return {n: {c: row[f"{n}_{i}"] for i, c in enumerate(columns)} for n in aggs}


def fit_standard(df: DataFrame, columns: list[str]) -> LinearScale:
    """Mean 0, population deviation 1; constant columns are only shifted."""
    s = _stats(df, columns, m=F.avg, d=F.stddev_pop)
    return LinearScale({c: s["m"][c] or 0.0 for c in columns}, {c: s["d"][c] or 1.0 for c in columns})


def fit_minmax(df: DataFrame, columns: list[str]) -> LinearScale:
    """Observed range to [0, 1]; constant columns become 0."""
    s = _stats(df, columns, lo=F.min, hi=F.max)
    return LinearScale(
        {c: float(s["lo"][c] or 0.0) for c in columns},
        {c: float((s["hi"][c] or 0.0) - (s["lo"][c] or 0.0)) or 1.0 for c in columns},
    )


def fit_gain(df: DataFrame, columns: list[str]) -> LinearScale:
    """Shift by the minimum, divide by range + 1e-6."""
    s = _stats(df, columns, lo=F.min, hi=F.max)
    return LinearScale(
        {c: float(s["lo"][c] or 0.0) for c in columns},
        {c: float((s["hi"][c] or 0.0) - (s["lo"][c] or 0.0)) + GAIN_EPS for c in columns},
    )


def scale_dataset(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """Numeric columns to [0, 1], text columns to sorted codes."""
    from gapweave.operators.encode import encode_categories

    return encode_categories(fit_minmax(df, numeric).transform(df), text)


def inverse_scale_dataset(df: DataFrame, original: DataFrame, numeric: list[str], text: list[str],
                          row_id: str = "row_id") -> DataFrame:
    """Undo [0, 1] scaling with the original's range and take its text columns back."""
    back = fit_minmax(original, numeric).inverse(df.select(row_id, *numeric))
    return back.join(original.select(row_id, *text), row_id) if text else back


def few_valued(df: DataFrame, columns: list[str], below: int = ROUND_BELOW) -> list[str]:
    """Columns with fewer than ``below`` distinct observed values.

    A sketch drops the wide columns first, so the exact count shuffles only
    columns that are small or close to the border.
    """
    guess = df.agg(*[F.approx_count_distinct(F.col(c), 0.05).alias(c) for c in columns]).first()
    near = [c for c in columns if guess[c] < 2 * below]
    if not near:
        return []
    exact = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in near]).first()
    return [c for c in near if exact[c] < below]


def round_few_valued(imputed: DataFrame, observed: DataFrame, columns: list[str]) -> DataFrame:
    """Round whole low-cardinality columns half to even, judged on the observed data."""
    cols = few_valued(observed, columns)
    return imputed.withColumns({c: F.rint(F.col(c)) for c in cols}) if cols else imputed


def half_even(x: Column) -> Column:
    return F.rint(x)
