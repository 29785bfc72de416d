"""Category codes, column typing and one-hot features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.functions.ordering import with_global_index

BROADCAST_CATEGORIES = 100_000


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes 0..k-1 in sorted order of the distinct non-missing values."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    if values.limit(BROADCAST_CATEGORIES + 1).count() <= BROADCAST_CATEGORIES:
        rank = F.row_number().over(Window.orderBy("value")) - 1  # at most BROADCAST_CATEGORIES rows
        return values.select("value", rank.cast("double").alias("code"))
    return with_global_index(values, ["value"], "code").withColumn("code", F.col("code").cast("double"))


@dataclass
class CategoryCodec:
    """Fixed category <-> number tables; missing stays missing both ways."""

    tables: dict[str, DataFrame]
    small: dict[str, bool]
    types: dict[str, T.DataType]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> CategoryCodec:
        tables, small = {}, {}
        for c in columns:
            codes = category_codes(df, c).persist()
            small[c] = codes.count() <= BROADCAST_CATEGORIES
            tables[c] = codes
        return cls(tables, small, {c: df.schema[c].dataType for c in columns})

    def _look_up(self, df: DataFrame, frm: str, to: str) -> DataFrame:
        order = df.columns
        for c, table in self.tables.items():
            side = table.select(F.col(frm).alias("__key"), F.col(to).alias("__new"))
            side = F.broadcast(side) if self.small[c] else side
            df = df.join(side, F.col(c) == F.col("__key"), "left").drop("__key", c).withColumnRenamed("__new", c)
        return df.select(*order)

    def transform(self, df: DataFrame) -> DataFrame:
        return self._look_up(df, "value", "code")

    def inverse(self, df: DataFrame) -> DataFrame:
        """Numbers back to categories, rounding half to even and clipping to known codes."""
        fixed = {
            c: F.least(F.greatest(F.rint(F.col(c).cast("double")), F.lit(0.0)), F.lit(float(self.size(c) - 1)))
            for c in self.tables
        }
        # least/greatest skip NULL, so gaps are put back
        kept = {c: F.when(F.col(c).isNotNull(), e) for c, e in fixed.items()}
        return self._look_up(df.withColumns(kept), "code", "value")

    def size(self, column: str) -> int:
        return self.tables[column].count()


def encode_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted label codes for each column, fitted on all rows."""
    return CategoryCodec.fit(df, columns).transform(df) if columns else df


def encode_label(df: DataFrame, label: str) -> DataFrame:
    """Label codes only where the label is not a number already."""
    if isinstance(df.schema[label].dataType, T.NumericType):
        return df
    return encode_categories(df, [label])


def split_types(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """(categorical, numeric) by storage type."""
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    return [c for c in columns if c not in numeric], numeric


def categories_to_string(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns}) if columns else df


def restore_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(c).cast(schema[c].dataType).alias(c) if c in schema.names else F.col(c) for c in df.columns])


@dataclass
class FeaturePipeline:
    """Mode/mean filling, one-hot or ordinal codes, unit scale: inputs for a per-column model."""

    categorical: list[str]
    numeric: list[str]
    means: dict[str, float]
    modes: dict[str, str | None]
    levels: dict[str, list[str]]
    one_hot: bool = True

    @classmethod
    def fit(cls, df: DataFrame, categorical: list[str], numeric: list[str], one_hot: bool = True) -> FeaturePipeline:
        means = {}
        if numeric:
            row = df.agg(*[F.avg(c).alias(c) for c in numeric]).first()
            means = {c: row[c] for c in numeric}
        modes, levels = {}, {}
        for c in categorical:
            counted = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count()
            top = counted.orderBy(F.desc("count"), "v").first()
            modes[c] = top["v"] if top else None
            found = counted.select("v").orderBy("v").limit(BROADCAST_CATEGORIES + 1).collect()
            if len(found) > BROADCAST_CATEGORIES:
                raise ValueError(f"{c!r} has too many categories for one-hot features")
            levels[c] = [r["v"] for r in found]
        return cls(categorical, numeric, means, modes, levels, one_hot)

    def _code(self, c: str) -> Column:
        filled = F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c]))
        # unseen categories get the extra slot, dropped below ("ignore")
        at = F.array_position(F.lit(self.levels[c]), filled) - 1
        return F.when(at < 0, F.lit(len(self.levels[c]))).otherwise(at).cast("double")

    def transform(self, df: DataFrame, output: str = "features") -> DataFrame:
        cols = {f"__num_{c}": F.coalesce(F.col(c).cast("double"), F.lit(self.means[c] or 0.0)) for c in self.numeric}
        cols |= {f"__cat_{c}": self._code(c) for c in self.categorical}
        df = df.withColumns(cols) if cols else df
        parts = [f"__num_{c}" for c in self.numeric]
        if not self.one_hot:
            parts += [f"__cat_{c}" for c in self.categorical]
        elif self.categorical:
            slots = {}
            for c in self.categorical:
                for i in range(len(self.levels[c])):
                    slots[f"__slot_{c}_{i}"] = (F.col(f"__cat_{c}") == i).cast("double")
            if len(slots) <= 64:
                df = df.withColumns(slots)
                parts += list(slots)
            else:
                enc = OneHotEncoder(inputCols=[f"__cat_{c}" for c in self.categorical],
                                    outputCols=[f"__vec_{c}" for c in self.categorical],
                                    dropLast=True, handleInvalid="keep")
                df = enc.fit(df).transform(df)
                parts += [f"__vec_{c}" for c in self.categorical]
        df = VectorAssembler(inputCols=parts, outputCol=output, handleInvalid="error").transform(df)
        return df.drop(*[c for c in df.columns if c.startswith(("__num_", "__cat_", "__slot_", "__vec_"))])
