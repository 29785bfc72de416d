"""Learning from result tables which imputer and regressor to use on a new dataset."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Recommender:
    """One forest per mechanism: meta-features in, best choice out."""

    features: list[str]
    trees: int = 50
    depth: int = 5
    seed: int = 0
    _models: dict = field(default_factory=dict)

    def fit(self, table: DataFrame, choice: str) -> Recommender:
        """``table``: mecha, the meta-features, and the winning choice of each run."""
        table = self._filled(table).persist()
        for r in table.select("mecha").distinct().collect():  # mechanisms are few by definition
            rows = table.where(F.col("mecha") == r["mecha"])
            names = StringIndexer(inputCol=choice, outputCol="__y", stringOrderType="alphabetAsc").fit(rows)
            stages = [
                names,
                VectorAssembler(inputCols=self.features, outputCol="__x"),
                RandomForestClassifier(featuresCol="__x", labelCol="__y", predictionCol="__p", numTrees=self.trees,
                                       maxDepth=self.depth, seed=self.seed),
                IndexToString(inputCol="__p", outputCol="recommended", labels=names.labels),
            ]
            self._models[r["mecha"]] = Pipeline(stages=stages[1:]).fit(names.transform(rows))
        table.unpersist()
        return self

    def _filled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)) for c in self.features})

    def recommend(self, table: DataFrame, mecha: str) -> DataFrame:
        """Adds ``recommended`` to a batch of meta-feature rows."""
        if mecha not in self._models:
            raise ValueError(f"no model for mechanism {mecha!r}")
        out = self._models[mecha].transform(self._filled(table))
        return out.drop("__x", "__p", "rawPrediction", "probability")
