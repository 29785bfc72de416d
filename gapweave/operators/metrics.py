"""Imputation quality on the masked cells, one aggregation per comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions.numeric import ratio, total
from gapweave.model import ROW_ID
from gapweave.operators.scale import fit_gain

NO_GROUND_TRUTH = -99999999.0  # fixed value of the compat mode


def compare(original: DataFrame, missing: DataFrame, imputed: DataFrame, columns: list[str],
            row_id: str = ROW_ID) -> DataFrame:
    """Line up three frames by key: ``c`` filled, ``c__true`` original, ``c__mis`` the mask.

    Frames planted with ``keep_truth`` already look like this and need no join.
    """
    m = missing.select(row_id, *[F.col(c).isNull().alias(f"{c}__mis") for c in columns])
    t = original.select(row_id, *[F.col(c).alias(f"{c}__true") for c in columns])
    return imputed.select(row_id, *columns).join(m, row_id).join(t, row_id)


def _pooled(columns: list[str], cell) -> Column:
    return F.sum(total([F.when(F.col(f"{c}__mis"), cell(c)).otherwise(F.lit(0.0)) for c in columns]))


def _diff(c: str) -> Column:
    return F.col(c) - F.col(f"{c}__true")


def mask_size(columns: list[str]) -> Column:
    return F.sum(total([F.col(f"{c}__mis").cast("long") for c in columns]))


def rmse(columns: list[str]) -> Column:
    return F.sqrt(ratio(_pooled(columns, lambda c: _diff(c) * _diff(c)), mask_size(columns)))


def mae(columns: list[str]) -> Column:
    return ratio(_pooled(columns, lambda c: F.abs(_diff(c))), mask_size(columns))


def accuracy(columns: list[str], half_even: bool = False) -> Column:
    """Share of masked cells that match exactly, optionally after rounding the filled value half to even."""
    def same(c):
        got = F.rint(F.col(c)) if half_even else F.col(c)
        return (got == F.col(f"{c}__true")).cast("double")

    return ratio(_pooled(columns, same), mask_size(columns))


def score_block(pairs: DataFrame, numeric: list[str], categorical: list[str], contains_missing: bool = False,
                compat: bool = False) -> DataFrame:
    """All imputation scores of one experiment cell in one row.

    Without ground truth the scores are NULL, or the sentinel in compat mode.
    """
    both = [*numeric, *categorical]
    scores = {"impute_rmse": rmse(both), "impute_mae": mae(both)}
    if numeric:
        scores |= {"impute_rmse_num": rmse(numeric), "impute_mae_num": mae(numeric)}
    if categorical:
        scores |= {"impute_rmse_cat": rmse(categorical), "impute_acc_cat": accuracy(categorical, half_even=True)}
    if contains_missing:
        blank = F.lit(NO_GROUND_TRUTH if compat else None).cast("double")
        scores = {n: F.max(blank) for n in scores}
    sizes = {"mask_size": mask_size(both)}
    if numeric:
        sizes["mask_size_num"] = mask_size(numeric)
    if categorical:
        sizes["mask_size_cat"] = mask_size(categorical)
    perc = ratio(mask_size(both), F.count("*") * F.lit(len(both))) * 100
    return pairs.agg(*[e.alias(n) for n, e in {**sizes, "miss_perc": perc, **scores}.items()])


def test_scores(pairs: DataFrame, columns: list[str]) -> DataFrame:
    return pairs.agg(rmse(columns).alias("x_test_impute_rmse"), mae(columns).alias("x_test_impute_mae"))


test_scores.__test__ = False


def normalized_rmse(original: DataFrame, missing: DataFrame, imputed: DataFrame, columns: list[str],
                    row_id: str = ROW_ID) -> DataFrame:
    """RMSE over missing cells after scaling both frames by the original's range."""
    scale = fit_gain(original, columns)
    pairs = compare(scale.transform(original), missing, scale.transform(imputed), columns, row_id)
    return pairs.agg(rmse(columns).alias("norm_rmse"))


def normalized_rmse_inline(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """The same on a frame that carries its truth: one scan for the range, one for the error."""
    scale = fit_gain(pairs, [f"{c}__true" for c in columns])
    se = _pooled(columns, lambda c: (_diff(c) / F.lit(scale.width[f"{c}__true"])) ** 2)
    return pairs.agg(F.sqrt(ratio(se, mask_size(columns))).alias("norm_rmse"))


def observed_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sum of the observed values over their number."""
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def audit_table(pairs: DataFrame, columns: list[str], extras: list[str] = (), row_id: str = ROW_ID) -> DataFrame:
    """One row per imputed cell: original against filled value, plus row-level extras such as y and its prediction."""
    cells = F.array(*[
        F.when(F.col(f"{c}__mis"), F.struct(F.lit(c).alias("column"), F.col(f"{c}__true").cast("double").alias("original"),
                                            F.col(c).cast("double").alias("imputed")))
        for c in columns
    ])
    out = pairs.select(row_id, *extras, F.explode(F.array_compact(cells)).alias("cell"))
    return out.select(row_id, "cell.column", "cell.original", "cell.imputed", *extras)
