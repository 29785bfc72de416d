"""Named datasets and how to open them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.model import Descriptor, nan_to_null
from gapweave.sources.files import coerce_numeric, decode_bytes, read_arff, read_csv

# fixed values: the two published example datasets and their column roles
BUILTIN = [
    {
        "name": "mammo",
        "kind": "arff",
        "contains_missing": "True",
        "source": "openml",
        "numeric_columns": ["BI-RADS", "Age", "Density"],
        "categorical_columns": ["Margin", "Shape"],
        "label_column": "Severity",
        "text_columns": ["Severity"],
    },
    {
        "name": "bupa1",
        "kind": "arff",
        "source": "openml",
        "numeric_columns": ["mcv", "alkphos", "sgpt", "sgot", "gammagt"],
        "text_columns": ["drinks"],
    },
]


class UnknownDataset(KeyError):
    pass


class Registry:
    def __init__(self, entries: list[dict] | None = None):
        self._by_name = {e["name"]: Descriptor.from_dict(e) for e in (BUILTIN if entries is None else entries)}

    def names(self, source: str | None = None) -> list[str]:
        return [n for n, d in self._by_name.items() if not d.disabled and (source is None or d.source == source)]

    def exists(self, name: str) -> bool:
        return name in self._by_name

    def descriptor(self, name: str) -> Descriptor:
        if name not in self._by_name:
            raise UnknownDataset(f"unknown dataset {name!r}")
        return self._by_name[name]

    def add(self, entry: dict | Descriptor) -> None:
        d = entry if isinstance(entry, Descriptor) else Descriptor.from_dict(entry)
        self._by_name[d.name] = d

    def open(self, spark: SparkSession, name: str, path: str | None = None) -> tuple[Descriptor, DataFrame]:
        """Descriptor and rows: decoded, numbers checked, incomplete rows dropped if declared so."""
        d = self.descriptor(name)
        where = path or d.path
        if where is None:
            raise ValueError(f"dataset {name!r} has no path")
        if d.kind == "arff":
            df = read_arff(spark, where)
        elif d.kind == "csv":
            df = read_csv(spark, where)
        elif d.kind == "table":
            df = spark.read.parquet(where)
        else:
            raise ValueError(f"unknown kind {d.kind!r} of dataset {name!r}")
        d = d.resolve(df)
        df = nan_to_null(coerce_numeric(decode_bytes(df, d.decode), list(d.numeric)), list(d.numeric))
        return d, complete_cases(df) if d.dropna else df


def complete_cases(df: DataFrame) -> DataFrame:
    return df.na.drop()


def project(df: DataFrame, d: Descriptor, row_id: str | None = None) -> DataFrame:
    """Numeric and text columns only; categorical ones are not stored."""
    return df.select(*([row_id] if row_id else []), *d.numeric, *d.text)


def summary(df: DataFrame, d: Descriptor) -> DataFrame:
    return df.agg(F.lit(d.name).alias("ds_name"), F.count("*").alias("rows"), F.lit(len(d.features)).alias("features"))
