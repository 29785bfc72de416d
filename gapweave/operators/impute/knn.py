from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions.gram import column_means
from gapweave.functions.neighbours import nearest
from gapweave.operators.impute.base import Imputer, Model


@dataclass
class KnnModel(Model):
    train: DataFrame
    columns: list[str]
    means: dict[str, float | None]
    k: int
    row_id: str

    def transform(self, df: DataFrame) -> DataFrame:
        open_ = [c for c in self.columns if self.means[c] is not None]
        needy = df.where(F.greatest(*[F.col(c).isNull() for c in self.columns]) if len(self.columns) > 1
                         else F.col(self.columns[0]).isNull())
        near = nearest(needy, self.train, self.columns, open_, self.k, self.row_id, per_target=True)
        filled = near.groupBy(self.row_id).pivot("target", open_).agg(F.avg("value"))
        side = filled.select(F.col(self.row_id), *[F.col(f"`{c}`").alias(f"__f_{c}") for c in open_])
        out = df.join(side, self.row_id, "left")
        # no usable donor at all: the column mean
        fill = {c: F.coalesce(F.col(c), F.col(f"__f_{c}"), F.lit(self.means[c])) for c in open_}
        return out.withColumns(fill).select(*df.columns)


class KnnImputer(Imputer):
    """Mean over the k nearest training rows that have the column, under the gap-aware distance."""

    def __init__(self, columns=None, row_id="row_id", k: int = 5):
        super().__init__(columns, row_id)
        self.k = k

    def fit(self, train: DataFrame) -> KnnModel:
        cols = self.on(train)
        return KnnModel(train.select(self.row_id, *cols), cols, column_means(train, cols), self.k, self.row_id)
