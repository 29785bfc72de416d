"""Random numbers that depend on (seed, salt, column, row) only.

The same row draws the same number on any cluster, under any partitioning and
after any task retry, and another engine can compute it from the same text.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapweave.model import ROW_ID

_SCALE = 4294967296.0


def hash_uniform(seed: int, salt: str, column: str, row_id: str | Column = ROW_ID) -> Column:
    """Uniform number in [0, 1) for each row."""
    rid = F.col(row_id) if isinstance(row_id, str) else row_id
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(salt), F.lit(column), rid.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(_SCALE)


def draw(seed: int, salt: str, column: str, row_id: str = "") -> float:
    """The driver-side twin of :func:`hash_uniform`, for model parameters."""
    text = "|".join([str(seed), salt, column, row_id])
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / _SCALE


def draw_normal(seed: int, salt: str, name: str) -> float:
    u = max(draw(seed, salt, name, "radius"), 1.0 / _SCALE)
    return math.sqrt(-2.0 * math.log(u)) * math.cos(2.0 * math.pi * draw(seed, salt, name, "angle"))


def choose(names: list[str], k: int, seed: int, salt: str) -> list[str]:
    """k of the names without replacement, returned in their original order."""
    picked = set(sorted(names, key=lambda n: draw(seed, salt, n))[:k])
    return [n for n in names if n in picked]
