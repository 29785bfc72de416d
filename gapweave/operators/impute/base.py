"""The imputer contract and the registry."""

from __future__ import annotations

from abc import ABC, abstractmethod
from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.model import ROW_ID, nan_to_null


class ImputerError(Exception):
    pass


class Model(ABC):
    """A fitted imputer. ``transform`` fills gaps and leaves observed cells as they are."""

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...


class Imputer(ABC):
    """Fits on one frame; the model can then fill that frame or another one."""

    def __init__(self, columns: list[str] | None = None, row_id: str = ROW_ID):
        self.columns = columns
        self.row_id = row_id

    def on(self, df: DataFrame) -> list[str]:
        cols = self.columns or [c for c in df.columns if c != self.row_id]
        lost = [c for c in cols if c not in df.columns]
        if lost:
            raise ImputerError(f"columns {lost} are not in the frame")
        return cols

    @abstractmethod
    def fit(self, train: DataFrame) -> Model: ...


# fixed names -> module:class
_KNOWN = {
    "mean": "gapweave.operators.impute.mean:MeanImputer",
    "knn": "gapweave.operators.impute.knn:KnnImputer",
    "ice": "gapweave.operators.impute.chained:IceImputer",
    "missforest": "gapweave.operators.impute.chained:MissForestImputer",
    "mlp2": "gapweave.operators.impute.column:MlpImputer",
    "mlp_regress": "gapweave.operators.impute.column:MlpSubsetImputer",
    "linear_regress": "gapweave.operators.impute.column:LinearSubsetImputer",
    "gain4": "gapweave.operators.impute.generative:GainImputer",
    "vae": "gapweave.operators.impute.generative:VaeImputer",
}
_ADDED: dict[str, type] = {}


def register(name: str, cls: type) -> None:
    """Plug in an imputer class of your own."""
    _ADDED[name.lower()] = cls


def get_imputer(name: str, **params) -> Imputer:
    key = name.lower()
    if key in _ADDED:
        return _ADDED[key](**params)
    if key not in _KNOWN:
        raise ImputerError(f"unknown imputer {name!r}")
    module, cls = _KNOWN[key].split(":")
    return getattr(import_module(module), cls)(**params)


def impute(df: DataFrame, name: str, columns: list[str], train: DataFrame | None = None, **params) -> DataFrame:
    """Fill ``columns`` of ``df``, fitting on ``train`` when given, else on ``df`` itself."""
    df = nan_to_null(df, columns)
    train = df if train is None else nan_to_null(train, columns)
    return get_imputer(name, columns=columns, **params).fit(train).transform(df)


def impute_numeric(df: DataFrame, name: str, numeric: list[str], text: list[str], row_id: str = ROW_ID, **params) -> DataFrame:
    """Fill the numeric columns, carry the text columns along."""
    return impute(df, name, numeric, row_id=row_id, **params).select(row_id, *numeric, *text)


def fill_targets(original: DataFrame, proposed: DataFrame, targets: list[str], row_id: str = ROW_ID) -> DataFrame:
    """Take proposed values in the missing cells of the target columns only, with a mask column per target."""
    side = proposed.select(row_id, *[F.col(t).alias(f"__p_{t}") for t in targets])
    out = original.join(side, row_id)
    cols = {f"{t}__imputed": F.col(t).isNull() for t in targets}
    cols |= {t: F.coalesce(F.col(t), F.col(f"__p_{t}")) for t in targets}
    return out.withColumns(cols).drop(*[f"__p_{t}" for t in targets])
