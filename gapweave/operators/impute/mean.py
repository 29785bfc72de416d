from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions.gram import column_means
from gapweave.operators.impute.base import Imputer, Model


@dataclass
class MeanModel(Model):
    means: dict[str, float | None]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(m).cast("double")) for c, m in self.means.items()})


class MeanImputer(Imputer):
    """Column means of the training frame."""

    def fit(self, train: DataFrame) -> MeanModel:
        return MeanModel(column_means(train, self.on(train)))
