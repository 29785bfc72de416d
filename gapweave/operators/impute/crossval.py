"""A tuned MLlib model per target column, built on all other columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions.rng import hash_uniform
from gapweave.operators.encode import CategoryCodec, FeaturePipeline, split_types
from gapweave.operators.impute.base import ImputerError

FOLDS = 5


@dataclass
class CrossValidatedImputer:
    """``numeric`` / ``categorical``: (MLlib estimator, {param name: values}) for each kind of target."""

    numeric: tuple
    categorical: tuple
    one_hot: bool = True
    parallelism: int = 2
    seed: int = 0
    row_id: str = "row_id"
    targets: list[str] | None = None
    _fitted: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, targets: list[str]) -> CrossValidatedImputer:
        if self._fitted:
            raise ImputerError(f"already fitted on {self.targets}")
        if not isinstance(targets, list):
            raise ImputerError("targets must be a list of column names")
        if any(t not in df.columns for t in targets):
            raise ImputerError(f"targets {targets} must be among {df.columns}")
        columns = [c for c in df.columns if c != self.row_id]
        categorical, numeric = split_types(df, columns)
        fold = F.least(F.floor(hash_uniform(self.seed, "fold", "", self.row_id) * F.lit(float(FOLDS))), F.lit(FOLDS - 1)).cast("int")
        for t in targets:
            kind = t in categorical
            estimator, grid = self.categorical if kind else self.numeric
            pipe = FeaturePipeline.fit(df, [c for c in categorical if c != t], [c for c in numeric if c != t], self.one_hot)
            codec = CategoryCodec.fit(df, [t]) if kind else None
            known = df.where(F.col(t).isNotNull())
            rows = (codec.transform(known) if codec else known).withColumn("__y", F.col(t).cast("double")).withColumn("__fold", fold)
            rows = pipe.transform(rows, "__raw").select("__raw", "__y", "__fold").persist()
            model = estimator.copy().setFeaturesCol("__x").setLabelCol("__y").setPredictionCol("__p")
            scaler = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True)
            builder = ParamGridBuilder()
            for name, values in grid.items():
                builder = builder.addGrid(model.getParam(name), values)
            judge = (MulticlassClassificationEvaluator(labelCol="__y", predictionCol="__p", metricName="accuracy") if kind
                     else RegressionEvaluator(labelCol="__y", predictionCol="__p", metricName="r2"))
            search = CrossValidator(estimator=Pipeline(stages=[scaler, model]), estimatorParamMaps=builder.build(), evaluator=judge,
                                    numFolds=FOLDS, foldCol="__fold", parallelism=self.parallelism)
            found = search.fit(rows)
            rows.unpersist()
            score = max(found.avgMetrics)
            chosen = found.getEstimatorParamMaps()[found.avgMetrics.index(score)]
            self._fitted[t] = (pipe, codec, found.bestModel, {p.name: v for p, v in chosen.items()}, score)
        self.targets = targets
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Fill targets one after the other; ``<target>__imputed`` marks filled cells."""
        if not self._fitted:
            raise ImputerError("not fitted")
        order = df.columns
        out = df.withColumns({f"{t}__imputed": F.col(t).isNull() for t in self.targets})
        for t in self.targets:
            pipe, codec, model, _, _ = self._fitted[t]
            out = model.transform(pipe.transform(out, "__raw"))
            extra = [c for c in out.columns if c not in order and not c.endswith("__imputed") and c != "__p"]
            out = out.drop(*extra)
            if codec:
                out = out.withColumn(f"__k_{t}", F.col(t)).withColumn(t, F.col("__p"))
                out = codec.inverse(out).withColumn(t, F.coalesce(F.col(f"__k_{t}"), F.col(t))).drop(f"__k_{t}")
            else:
                out = out.withColumn(t, F.coalesce(F.col(t), F.col("__p").cast(df.schema[t].dataType)))
            out = out.drop("__p")
        return out.select(*order, *[f"{t}__imputed" for t in self.targets])

    def best_parameters(self) -> dict[str, dict]:
        if not self._fitted:
            raise ImputerError("not fitted")
        return {t: v[3] for t, v in self._fitted.items()}
