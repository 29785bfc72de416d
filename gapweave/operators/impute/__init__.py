"""Imputers by name: ``get_imputer(name).fit(train).transform(df)``."""

from gapweave.operators.impute.base import ImputerError, fill_targets, get_imputer, impute, impute_numeric, register

__all__ = ["ImputerError", "fill_targets", "get_imputer", "impute", "impute_numeric", "register"]
