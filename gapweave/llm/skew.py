"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has at least this part of all rows, so there are no more hot keys than that.
PARTS = 500


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` left join ``table`` (one row a key, with the number of its rows in ``count``; ``total`` rows in all). Hot
    keys, at most PARTS of them, are broadcast, so their rows stay where they are; the others meet by shuffle. Null
    keys of ``rows`` find nothing. Columns of the table other than the key are added, without ``count``."""
    hot = F.col(count) * PARTS >= max(total, 1)
    few, many = table.where(hot).drop(count), table.where(~hot).drop(count)
    apart = rows.join(F.broadcast(few), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(many, key, "left")
    return apart.unionByName(rest)
