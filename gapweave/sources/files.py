"""CSV and ARFF sources, number checks, byte decoding, result sinks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ATTRIBUTE = re.compile(r"""^@attribute\s+('[^']*'|"[^"]*"|\S+)\s+(.+?)\s*$""", re.IGNORECASE)
# Header lines; a data line may begin with any other "@".
_HEADER = r"(?i)^@(relation\s|attribute\s|data\s*$)"
_NUMBERS = ("numeric", "real", "integer")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Comma separated with a header. With a schema, a value that doesn't fit raises; without one every
    column is text, for :func:`coerce_numeric` to cast. Nothing is inferred, so files are read once."""
    reader = spark.read.option("header", True).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.csv(path)


def arff_schema(spark: SparkSession, path: str) -> T.StructType:
    """Column names (quotes stripped) and types from the header lines."""
    head = spark.read.text(path).where(F.lower(F.ltrim("value")).startswith("@attribute"))
    found = {}
    for r in head.collect():  # one line per column
        m = _ATTRIBUTE.match(r["value"].strip())
        if not m:
            raise ValueError(f"cannot read attribute line {r['value']!r}")
        kind = m.group(2).split()[0].lower()
        found[m.group(1).strip("'\"")] = T.DoubleType() if kind in _NUMBERS else T.StringType()
    return T.StructType([T.StructField(n, t) for n, t in found.items()])


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """The data lines, parsed in parallel; '?' is missing, malformed rows raise."""
    schema = arff_schema(spark, path)
    line = F.trim("value")
    data = spark.read.text(path).where((F.length(line) > 0) & (F.substring(line, 1, 1) != "%") & ~line.rlike(_HEADER))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"nullValue": "?", "quote": "'", "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "true",
               "ignoreTrailingWhiteSpace": "true"}
    return data.select(F.from_csv(line, ddl, options).alias("r")).select("r.*")


def write_arff(df: DataFrame, path: str, relation: str) -> None:
    """Data lines in parallel, header as a file that sorts first."""
    spark = df.sparkSession
    lines = [f"@relation {relation}"]
    parts = []
    for f in df.schema.fields:
        number = isinstance(f.dataType, T.NumericType)
        lines.append(f"@attribute '{f.name}' {'numeric' if number else 'string'}")
        text = F.col(f"`{f.name}`").cast("string")
        parts.append(F.coalesce(text if number else F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'")), F.lit("?")))
    spark.createDataFrame([("\n".join([*lines, "@data"]),)], "value string").coalesce(1).write.text(path)
    df.select(F.concat_ws(",", *parts).alias("value")).write.mode("append").text(path)


def coerce_numeric(df: DataFrame, columns: list[str], strict: bool = True) -> DataFrame:
    """Declared columns as double; bad text raises, or becomes missing when not strict."""
    cast = (lambda c: F.col(f"`{c}`").cast("double")) if strict else (lambda c: F.col(f"`{c}`").try_cast("double"))
    return df.withColumns({c: cast(c) for c in columns}) if columns else df


def decode_bytes(df: DataFrame, columns: list[str] = ()) -> DataFrame:
    """Binary columns as UTF-8 text: the declared ones and any other left binary."""
    todo = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)]
    todo += [c for c in columns if c not in todo and not isinstance(df.schema[c].dataType, T.StringType)]
    return df.withColumns({c: F.decode(F.col(f"`{c}`"), "UTF-8") for c in todo}) if todo else df


def union_results(frames: list[DataFrame]) -> DataFrame:
    """Ragged result rows as one table, ``ds_name`` first."""
    if not frames:
        raise ValueError("no results to collect")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select("ds_name", *[c for c in out.columns if c != "ds_name"])


def append_results(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)
