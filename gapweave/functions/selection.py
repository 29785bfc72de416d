"""Exact order statistics without a sort.

Each pass counts rows per bucket between the current bounds and keeps the one
bucket that holds the wanted rank; bounds are the bucket's own min and max, so
the search ends when both meet. A pass is one map-side-combined aggregation and
at most BUCKETS rows per searched rank reach the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
FETCH = 2048   # a bucket this short is read instead of searched further
STEPS = 32     # borders tried at once in a search over uniform draws


def _number(c: str) -> Column:
    """The column as double; NaN counts as missing."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def order_statistics(df: DataFrame, ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """Value of each 1-based rank among the non-missing values of each column.

    Infinite values are counted, not searched. Passes take turns between buckets of equal width and
    buckets of equal ratio, so values of very different size need few passes as well.
    """
    names = list(ranks)
    df = df.select(*[_number(c).alias(c) for c in names])
    finite = [F.when(F.abs(F.col(c)) < math.inf, F.col(c)) for c in names]
    first = df.agg(*[e.alias(f"{p}{i}") for i, c in enumerate(names) for p, e in (
        ("lo", F.min(finite[i])), ("hi", F.max(finite[i])), ("n", F.count(c)), ("under", F.count_if(F.col(c) == -math.inf)), ("f", F.count(finite[i])))]).first()
    open_: dict[tuple[str, int], tuple[float, float, int]] = {}
    found: dict[tuple[str, int], float] = {}
    for i, c in enumerate(names):
        for k in ranks[c]:
            if not 1 <= k <= first[f"n{i}"]:
                raise ValueError(f"rank {k} of {c!r} is outside 1..{first[f'n{i}']}")
            inner = k - first[f"under{i}"]
            if inner < 1 or inner > first[f"f{i}"]:
                found[(c, k)] = -math.inf if inner < 1 else math.inf
            else:
                open_[(c, k)] = (first[f"lo{i}"], first[f"hi{i}"], inner)
    ratio = False
    while True:
        for key in [key for key, (lo, hi, _) in open_.items() if lo == hi]:
            found[key] = open_.pop(key)[0]
        if not open_:
            return found
        spans = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in open_.items()})
        hits = _bucket_counts(df, spans, ratio)
        ratio = not ratio
        short: dict[tuple, list[tuple]] = {}
        for key, (lo, hi, k) in list(open_.items()):
            rest = k
            for n, b_lo, b_hi in hits[(key[0], lo, hi)]:
                if rest <= n:
                    open_[key] = (b_lo, b_hi, rest)
                    if n <= FETCH and b_lo < b_hi:
                        short.setdefault((key[0], b_lo, b_hi), []).append((key, rest))
                    break
                rest -= n
            else:
                raise ArithmeticError(f"rank {k} of {key[0]!r} lies in no bucket of [{lo}, {hi}]")
        if short:
            values = _values_inside(df, list(short))
            for span, asked in short.items():
                for key, rest in asked:
                    found[key] = values[span][rest - 1]
                    del open_[key]


def _log_size(x: Column) -> Column:
    """Grows with x over all finite doubles, by the logarithm of its size."""
    return F.signum(x) * (F.coalesce(F.log(F.nullif(F.abs(x), F.lit(0.0))), F.lit(0.0)) + 746.0)


def _log_size_of(x: float) -> float:
    return math.copysign(math.log(abs(x)) + 746.0, x) if x else 0.0


def _bucket(x: Column, lo: float, hi: float, ratio: bool, count: int) -> Column:
    """Bucket of x in [lo, hi): 0 below, count + 1 from hi on. Non-decreasing in x."""
    if ratio or math.isinf(hi - lo):
        a, b = _log_size_of(lo), _log_size_of(hi)
        if a < b:
            inner = F.width_bucket(_log_size(x), F.lit(a), F.lit(b), F.lit(count))
            # Rounding of the logarithm must not carry a value over the ends.
            return F.when(x.isNull(), None).when(x < lo, 0).when(x >= hi, count + 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(count), inner.cast("int"))))
    return F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(count)).cast("int")


def _by_column(spans: list[tuple]) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for span in spans:
        out.setdefault(span[0], []).append(span)
    return out


def _bucket_counts(df: DataFrame, spans: list[tuple], ratio: bool) -> dict[tuple, list[tuple]]:
    """(rows, min, max) of each non-empty bucket of each span, in order.

    No filter: rows outside a span fall into its outer buckets, which costs two
    groups and spares evaluating the column once more. Each column is read on
    its own; in columnar files that is as cheap as reading them together.
    """
    sides = [F.lit(None).cast("int")]
    parts = []
    columns = _by_column(spans)
    most = max(len(v) for v in columns.values())
    for i, (c, own) in enumerate(columns.items()):
        x = F.col(c).cast("double")
        codes = [_bucket(x, lo, hi, ratio, BUCKETS).cast("int") for _, lo, hi in own]
        codes += sides * (most - len(codes))
        parts.append(df.select(F.lit(i).alias("c"), x.alias("x"), *[b.alias(f"b{j}") for j, b in enumerate(codes)]))
    keys = ["c", *[f"b{j}" for j in range(most)]]
    rows = reduce(DataFrame.unionAll, parts).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    out: dict[tuple, list[tuple]] = {}
    for i, own in enumerate(columns.values()):
        for j, span in enumerate(own):
            mine = [r for r in rows if r["c"] == i and r[f"b{j}"] is not None]
            inner = sorted((r for r in mine if 1 <= r[f"b{j}"] <= BUCKETS), key=lambda r: r["lo"])
            out[span] = [(r["n"], r["lo"], r["hi"]) for r in inner]
            # values from the upper bound on: the wanted rank, if not found before, is the bound itself
            over = sum(r["n"] for r in mine if r[f"b{j}"] > BUCKETS)
            out[span].append((over, span[2], span[2]))
    return out


def _values_inside(df: DataFrame, spans: list[tuple]) -> dict[tuple, list[float]]:
    """The sorted values of spans already known to be short, all in one job."""
    tagged = [F.when((F.col(c) >= lo) & (F.col(c) <= hi), F.struct(F.lit(i).alias("i"), F.col(c).alias("x"))) for i, (c, lo, hi) in enumerate(spans)]
    rows = df.select(F.explode(F.array_compact(F.array(*tagged))).alias("v")).select("v.*").collect()
    out: dict[tuple, list[float]] = {span: [] for span in spans}
    for r in rows:
        out[spans[r["i"]]].append(r["x"])
    return {span: sorted(v) for span, v in out.items()}


def quantiles_linear(df: DataFrame, wanted: dict[str, list[float]]) -> dict[tuple[str, float], float]:
    """Quantiles with linear interpolation between the two neighbouring ranks."""
    counts = df.agg(*[F.count(_number(c)).alias(c) for c in wanted]).first()
    ranks: dict[str, list[int]] = {}
    places = {}
    for c, qs in wanted.items():
        for q in qs:
            h = (counts[c] - 1) * q
            k = math.floor(h)
            places[(c, q)] = (k + 1, min(k + 2, counts[c]), h - k)
        ranks[c] = sorted({k for q in qs for k in places[(c, q)][:2]})
    values = order_statistics(df, ranks)
    return {
        (c, q): values[(c, a)] + (values[(c, b)] - values[(c, a)]) * w for (c, q), (a, b, w) in places.items()
    }


def lowest_by_hash(df: DataFrame, draws: dict[str, Column], ranks: dict[str, int], row_id: str, n: int) -> dict[str, Column]:
    """Predicates picking exactly ``ranks[name]`` of the ``n`` rows with the lowest draw.

    Draws are uniform, so the border lies close to rank / n: one scan counts
    rows below a few borders around it, and a second one reads the handful of
    rows between two of them. Equal draws are settled by ``row_id``. The result
    is a plain row condition; the rows are neither sorted nor shuffled.
    """
    out = {m: F.lit(k >= n) for m, k in ranks.items()}
    live = {m: k for m, k in ranks.items() if 0 < k < n}
    # (borders still possible, rows below the lower one)
    spans = {}
    for m, k in live.items():
        p = k / n
        reach = 6.0 * math.sqrt(p * (1.0 - p) / n) + 2.0 / n
        spans[m] = (max(0.0, p - reach), min(1.0, p + reach))
    at: dict[str, tuple[float, float, int, int]] = {}
    while spans:
        grid = {m: [lo + (hi - lo) * i / STEPS for i in range(STEPS + 1)] for m, (lo, hi) in spans.items()}
        drawn = df.select(*[draws[m].alias(m) for m in grid])
        row = drawn.agg(*[F.count_if(F.col(m) < F.lit(b)).alias(f"{j}_{i}")
                          for j, m in enumerate(grid) for i, b in enumerate(grid[m])]).first()
        again = {}
        for j, (m, g) in enumerate(grid.items()):
            below = [row[f"{j}_{i}"] for i in range(STEPS + 1)]
            if not below[0] < live[m] <= below[-1]:
                again[m] = (0.0, 1.0)  # an unlikely draw: start over with the whole range
                continue
            i = next(i for i in range(STEPS) if below[i + 1] >= live[m])
            at[m] = (g[i], g[i + 1], below[i], below[i + 1])
            if below[i + 1] - below[i] > FETCH and g[i] < (g[i] + g[i + 1]) / 2 < g[i + 1]:
                again[m] = (g[i], g[i + 1])
        spans = again
    for m, (lo, hi, below, _) in at.items():
        u = draws[m]
        # one reference to the draw: a comparison on each side would hash every row twice
        near = df.where(F.width_bucket(u, F.lit(lo), F.lit(hi), F.lit(1)) == 1).select(u.alias("u"), F.col(row_id).alias("r"))
        edge = near.orderBy("u", "r").limit(live[m] - below).agg(F.max(F.struct("u", "r")).alias("e")).first()["e"]
        out[m] = F.struct(u.alias("u"), F.col(row_id).alias("r")) <= F.struct(F.lit(edge["u"]).alias("u"), F.lit(edge["r"]).alias("r"))
    return out
