"""Dataset descriptors and row identity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_ID = "row_id"


def _flag(value) -> bool:
    return str(value).lower() == "true"


@dataclass(frozen=True)
class Descriptor:
    """Column roles of one dataset."""

    name: str
    kind: str = "table"
    source: str | None = None
    path: str | None = None
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    decode: tuple[str, ...] = ()
    label: str | None = None
    dropna: bool = False
    contains_missing: bool = False
    disabled: bool = False
    extra: dict = field(default_factory=dict, compare=False)

    @classmethod
    def from_dict(cls, d: dict) -> Descriptor:
        if "kind" not in d:
            raise ValueError(f"dataset {d.get('name')!r} declares no kind")
        text = tuple(d.get("text_columns", ()))
        label = d.get("label_column") or (text[0] if text else None)
        if label is None:
            raise ValueError(f"dataset {d['name']!r} has neither label_column nor text_columns")
        # both spellings occur in descriptor files
        categorical = d.get("catagorical_columns", d.get("categorical_columns", ()))
        return cls(
            name=d["name"],
            kind=d["kind"],
            source=d.get("source"),
            path=d.get("path"),
            numeric=tuple(d.get("numeric_columns", ())),
            categorical=tuple(categorical),
            text=text,
            decode=tuple(d.get("decode_columns", ())),
            label=label,
            dropna=_flag(d.get("dropna", False)),
            contains_missing=_flag(d.get("contains_missing", False)),
            disabled=_flag(d.get("disabled", False)),
        )

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def resolve(self, df: DataFrame) -> Descriptor:
        """Replace positional column references by names, once."""
        names = df.columns

        def fix(cols):
            return tuple(names[c] if isinstance(c, int) else c for c in cols)

        return Descriptor(
            self.name, self.kind, self.source, self.path, fix(self.numeric), fix(self.categorical),
            fix(self.text), fix(self.decode), self.label, self.dropna, self.contains_missing, self.disabled,
        )


def _marked(columns: list[str]) -> Column:
    text = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def content_id(columns: list[str]) -> Column:
    """A key for tables without one: md5 over all columns, each with its length or a mark for NULL, so
    that rows which differ only in where a NULL or a separator stands differ in the key."""
    return F.md5(_marked(columns))


def with_row_id(df: DataFrame, key: str | list[str] | None = None) -> DataFrame:
    """Add ``row_id`` from a key, or from the whole row where there is none.

    Whole-row keys need distinct rows; tables holding full copies should be
    read with :func:`read_with_position`, which needs no shuffle to tell them apart.
    """
    if key is None:
        return df.withColumn(ROW_ID, content_id(df.columns))
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn(ROW_ID, F.col(keys[0]).cast("string") if len(keys) == 1 else _marked(keys))


def read_with_position(spark, path: str) -> DataFrame:
    """Read Parquet with ``row_id`` = file and row position: unique even among copies."""
    df = spark.read.parquet(path)
    return df.select(
        "*",
        F.concat_ws("#", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string")).alias(ROW_ID),
    )


def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing is NULL everywhere inside; NaN only exists at the borders."""
    floating = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floating}) if floating else df


def feature_frame(df: DataFrame, d: Descriptor, row_id: str = ROW_ID, label: bool = True) -> DataFrame:
    """row_id, features in descriptor order, label as double; nothing else is read."""
    cols = [F.col(row_id).alias(ROW_ID)]
    missing = F.lit(None).cast("double")
    cols += [F.nanvl(F.col(c).cast("double"), missing).alias(c) for c in d.numeric]
    cols += [F.col(c) for c in d.categorical]
    if label:
        cols.append(F.col(d.label).cast("double").alias(d.label))
    return df.select(*cols)
