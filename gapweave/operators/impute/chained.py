"""Round-robin imputation: each column regressed on all others, again and again."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions.forest import Forest, codes_of, grow, limits
from gapweave.functions.gram import PatternTable, column_means, moments, pattern_grams
from gapweave.functions.linear import bayesian_ridge
from gapweave.functions.numeric import linear
from gapweave.functions.training import map_matrix
from gapweave.functions.trees import BLOCKS, Carried, as_block, unblock
from gapweave.operators.impute.base import Imputer, Model
from gapweave.session import settle_table

MAX_ROUNDS = 50
TOLERANCE = 1e-3
MAX_PATTERNS = 4096
#: Forests: rows of a block, if there are few and if there are many; from how many files on a file has more rows, and how many at most.
LEAST_ROWS, MOST_ROWS = 4096, 8192
PARTS, PART_ROWS = 96, 1 << 19
#: Bytes of trees that a task holds to fill rows.
HELD = 1 << 26


@dataclass
class ChainModel(Model):
    """The sequence of fitted steps: (column, coefficients on the others, intercept)."""

    columns: list[str]
    start: np.ndarray
    steps: list[tuple[int, np.ndarray, float]]
    rounds: int = 0
    scans: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        """Replays all steps on each row in one projection; no state between rounds is stored."""
        start, steps = self.start, self.steps

        def replay(x: np.ndarray) -> np.ndarray:
            gaps = np.isnan(x)
            x = np.where(gaps, start, x)
            for j, coef, intercept in steps:
                open_ = gaps[:, j]
                if open_.any():
                    x[open_, j] = x[open_] @ coef + intercept
            return x

        return map_matrix(df, [F.col(c) for c in self.columns], self.columns, replay)


class _Affine:
    """Filled rows of one pattern as an affine map of their observed cells."""

    def __init__(self, seen: np.ndarray, start: np.ndarray):
        d = len(seen)
        self.a = np.diag(seen.astype(float))
        self.b = np.where(seen, 0.0, start)
        self.seen = seen
        self.d = d

    def step(self, j: int, coef: np.ndarray, intercept: float) -> None:
        if not self.seen[j]:
            self.a[j] = coef @ self.a
            self.b[j] = coef @ self.b + intercept


def _largest_changes(train: DataFrame, model: ChainModel) -> dict[int, float]:
    """Exact largest change of a filled cell in every round, from one scan."""
    start, steps, d = model.start, model.steps, len(model.columns)

    def replay(batches):
        worst = np.zeros(len(steps) // d)
        for b in batches:
            x = b.to_numpy("float64")
            gaps = np.isnan(x)
            x = np.where(gaps, start, x)
            for number in range(len(worst)):
                old = x.copy()
                for j, coef, intercept in steps[number * d: (number + 1) * d]:
                    open_ = gaps[:, j]
                    if open_.any():
                        x[open_, j] = x[open_] @ coef + intercept
                worst[number] = max(worst[number], np.abs(x - old).max(initial=0.0))
        yield pd.DataFrame({"number": np.arange(len(worst)), "change": worst})

    rows = (train.select(*[F.col(c).cast("double").alias(c) for c in model.columns])
            .mapInPandas(replay, "number int, change double").groupBy("number").agg(F.max("change").alias("change")).collect())
    return {r["number"]: r["change"] for r in rows}


class IceImputer(Imputer):
    """Chained Bayesian ridge regressions.

    The rows are scanned once, into products per pattern of gaps. All rounds then
    run on those tables, because a filled cell is an affine function of its row's
    observed cells. A second scan happens only when bounds cannot decide in which
    round the largest change fell under the tolerance.
    """

    def __init__(self, columns=None, row_id="row_id", max_rounds: int = MAX_ROUNDS, tol: float = TOLERANCE,
                 max_patterns: int = MAX_PATTERNS):
        super().__init__(columns, row_id)
        self.max_rounds, self.tol, self.max_patterns = max_rounds, tol, max_patterns

    def fit(self, train: DataFrame) -> ChainModel:
        cols = self.on(train)
        table = pattern_grams(train, cols, self.max_patterns)
        if table is None:
            return self._fit_rows(train, cols)
        return self._fit_patterns(train, cols, table)

    # --- on pattern tables ---------------------------------------------------

    def _fit_patterns(self, train: DataFrame, cols: list[str], table: PatternTable) -> ChainModel:
        d = len(cols)
        counts = table.seen_counts
        with np.errstate(all="ignore"):
            centred = np.where(counts > 0, sum(np.where(g.seen, g.s, 0.0) for g in table.groups) / counts, 0.0)
        order = np.argsort(sum(g.n for g in table.groups) - counts, kind="stable")
        maps = [_Affine(g.seen, centred) for g in table.groups]
        top = max((max(abs(v + s) for v in (lo, hi)) for g in table.groups
                   for lo, hi, s, seen in zip(g.lo, g.hi, table.shift, g.seen) if seen), default=0.0)
        model = ChainModel(cols, centred + table.shift, [], scans=1)
        undecided = []
        for number in range(self.max_rounds):
            before = [(m.a.copy(), m.b.copy()) for m in maps]
            for j in order:
                coef, intercept = self._solve(table, maps, int(j), d)
                for m in maps:
                    m.step(int(j), coef, intercept)
                # back from centred to raw values
                model.steps.append((int(j), coef, float(intercept + table.shift[j] - coef @ table.shift)))
            low, high = self._change_bounds(table, maps, before)
            if high < self.tol * top:
                break
            if low < self.tol * top:
                undecided.append(number)
        model.rounds = number + 1
        if undecided:
            # rounds beyond a possible stop were cheap; one scan settles all of them
            model.scans += 1
            change = _largest_changes(train, model)
            for number in undecided:
                if change[number] < self.tol * top:
                    model.rounds = number + 1
                    model.steps = model.steps[: model.rounds * d]
                    break
        return model

    @staticmethod
    def _solve(table: PatternTable, maps: list[_Affine], j: int, d: int):
        others = np.arange(d) != j
        n, s, p = 0, np.zeros(d), np.zeros((d, d))
        for g, m in zip(table.groups, maps):
            if g.seen[j]:
                mean = m.a @ g.s
                n += g.n
                s += mean + g.n * m.b
                p += m.a @ g.p @ m.a.T + np.outer(mean, m.b) + np.outer(m.b, mean) + g.n * np.outer(m.b, m.b)
        if n == 0:
            return np.zeros(d), 0.0
        mean = s / n
        cross = p - n * np.outer(mean, mean)
        coef = np.zeros(d)
        coef[others] = bayesian_ridge(cross[np.ix_(others, others)], cross[others, j], max(cross[j, j], 0.0), n)
        return coef, float(mean[j] - coef @ mean)

    @staticmethod
    def _change_bounds(table, maps, before) -> tuple[float, float]:
        """Root mean square and box bounds on the largest change of a filled cell in one round."""
        low = high = 0.0
        for g, m, (a, b) in zip(table.groups, maps, before):
            da, db = m.a - a, m.b - b
            if g.seen.all():
                continue
            sq = np.einsum("ij,jk,ik->i", da, g.p, da) + 2 * db * (da @ g.s) + g.n * db**2
            low = max(low, math.sqrt(max(float(sq.max()) / g.n, 0.0)))
            lo, hi = np.where(g.seen, g.lo, 0.0), np.where(g.seen, g.hi, 0.0)
            up = np.where(da > 0, da * hi, da * lo).sum(1) + db
            down = np.where(da > 0, da * lo, da * hi).sum(1) + db
            high = max(high, float(np.maximum(np.abs(up), np.abs(down)).max()))
        return low, high

    # --- too many patterns: rows stay filled in a table, one per round ---------

    def _fit_rows(self, train: DataFrame, cols: list[str]) -> ChainModel:
        means = column_means(train, cols)
        start = np.array([means[c] if means[c] is not None else 0.0 for c in cols])
        stats = train.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                          *[F.max(F.abs(c)).alias(f"x{i}") for i, c in enumerate(cols)]).first()
        order = sorted(range(len(cols)), key=lambda i: -stats[f"n{i}"])
        top = max(stats[f"x{i}"] or 0.0 for i in range(len(cols)))
        gaps = {c: f"__gap_{c}" for c in cols}
        state = settle_table(train.select(*[F.col(c).isNull().alias(gaps[c]) for c in cols],
                                          *[F.coalesce(F.col(c), F.lit(float(m))).alias(c) for c, m in zip(cols, start)]), "ice")
        model = ChainModel(cols, start, [])
        for _ in range(self.max_rounds):
            now = state.withColumns({f"__old_{c}": F.col(c) for c in cols})
            for j in order:
                m = moments(now.where(~F.col(gaps[cols[j]])), cols)
                others = np.arange(len(cols)) != j
                coef = np.zeros(len(cols))
                if m.n:
                    coef[others] = bayesian_ridge(m.cross[np.ix_(others, others)], m.cross[others, j], m.cross[j, j], m.n)
                intercept = float(m.mean[j] - coef @ m.mean)
                guess = linear([F.col(c) for c in cols], list(coef), intercept)
                now = now.withColumn(cols[j], F.when(F.col(gaps[cols[j]]), guess).otherwise(F.col(cols[j])))
                model.steps.append((j, coef, intercept))
                model.scans += 2
            now = settle_table(now, "ice")
            model.rounds += 1
            change = now.agg(F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"__old_{c}")) for c in cols]))).first()[0]
            state = now.drop(*[f"__old_{c}" for c in cols])
            if change < self.tol * top:
                break
        return model


@dataclass
class ForestModel(Model):
    columns: list[str]
    start: dict[str, float]
    steps: list[tuple[str, Forest]] = field(default_factory=list)
    rounds: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        """Replays all steps on the gaps of each row, in one projection if tasks have room for the trees. Else rows are kept on disk between
        projections that hold some of the steps each."""
        cols, start = self.columns, np.array([self.start[c] for c in self.columns])
        parts, size = [[]], 0
        for step in self.steps:
            own = sum(t.size for t in step[1].trees)
            if parts[-1] and size + own > HELD:
                parts.append([])
                size = 0
            parts[-1].append(step)
            size += own
        given = [f"__given_{c}" for c in cols]
        now = df.withColumns({g: _no_nan(c) for g, c in zip(given, cols)})
        kept = None
        for i, steps in enumerate(parts):

            def fill(x: np.ndarray, steps=steps, first=i == 0) -> np.ndarray:
                gaps, x = np.isnan(x[:, : len(cols)]), x[:, len(cols):]
                x = np.where(gaps, start, x) if first else x.copy()
                for c, forest in steps:
                    j = cols.index(c)
                    _replay(x.T, gaps[:, j], j, forest)
                return x

            now = map_matrix(now, [*map(F.col, given), *(_no_nan(c) for c in cols)], cols, fill)
            if i + 1 < len(parts):
                now = now.persist(StorageLevel.DISK_ONLY)
                now.count()
                if kept is not None:
                    kept.unpersist()
                kept = now
        return now.drop(*given)


def _replay(x: np.ndarray, gaps: np.ndarray, j: int, forest: Forest) -> None:
    """Fill the gaps of row j of a matrix (columns by rows) in place."""
    at = np.flatnonzero(gaps)
    if len(at):
        x[j, at] = forest.predict(np.delete(x[:, at], j, axis=0).T)


def _no_nan(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(F.isnan(v), F.raise_error(F.lit(f"column {c} has NaN")).cast("double")).otherwise(v)


class MissForestImputer(Imputer):
    """Chained random forests: 50 trees of depth 10 per column and round. Rows stay on disk between scans."""

    def __init__(self, columns=None, row_id="row_id", trees: int = 50, depth: int = 10, max_rounds: int = MAX_ROUNDS,
                 tol: float = TOLERANCE, seed: int = 0):
        super().__init__(columns, row_id)
        self.trees, self.depth, self.max_rounds, self.tol, self.seed = trees, depth, max_rounds, tol, seed

    def fit(self, train: DataFrame) -> ForestModel:
        cols = self.on(train)
        d = len(cols)
        # what leads to the rows is worked out once
        train = settle_table(train.select(self.row_id, *[_no_nan(c).alias(c) for c in cols]), "forest")
        means = column_means(train, cols)
        stats = train.agg(F.count("*").alias("n"), *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                          *[F.max(F.abs(c)).alias(f"x{i}") for i, c in enumerate(cols)]).first()
        order = sorted(range(d), key=lambda i: -stats[f"n{i}"])
        top = max(stats[f"x{i}"] or 0.0 for i in range(d))
        model = ForestModel(cols, {c: means[c] if means[c] is not None else 0.0 for c in cols})
        state = Carried(_blocks(train, cols, model.start, self.row_id, stats["n"]), d, d + 2, StorageLevel.DISK_ONLY)
        for _ in range(self.max_rounds):
            fresh = True
            for j in order:
                if stats[f"n{j}"] == 0:
                    continue
                others, base = [i for i in range(d) if i != j], model.start[cols[j]]
                cuts = limits(state.blocks, d, d + 2, others, j)
                state.scanned()
                rows = _seen(state.blocks, d, others, j, cuts, base).persist(StorageLevel.DISK_ONLY)
                forest = grow(rows, cuts, base, self.trees, self.depth, [self.seed, len(model.steps)])
                rows.unpersist()
                state.change(lambda gaps, v, j=j, forest=forest, fresh=fresh: _filled(gaps, v, j, forest, fresh))
                model.steps.append((cols[j], forest))
                fresh = False
            model.rounds += 1
            if _change(state) < self.tol * top:
                break
        state.close()
        return model


def _blocks(rows: DataFrame, cols: list[str], start: dict[str, float], row_id: str, n: int) -> DataFrame:
    """(which cells are gaps; values, a number of the row, its largest change of the round) in blocks whose number depends on the data alone."""
    most = min(MOST_ROWS, max(LEAST_ROWS, math.ceil(n / 16)))
    parts = max(1, min(math.ceil(n / most), max(PARTS, math.ceil(n / PART_ROWS))))
    dealt = rows.repartition(parts, F.col(row_id)).sortWithinPartitions(row_id, *cols)
    number = F.pmod(F.xxhash64(row_id), F.lit(1 << 32)).cast("double").alias("__number")
    fill = np.array([start[c] for c in cols])[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((len(cols) + 1, 0))
        for b in batches:
            rest = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float)], axis=1)
            while rest.shape[1] >= most:
                yield block(rest[:, :most])
                rest = rest[:, most:]
        if rest.shape[1]:
            yield block(rest)

    def block(x: np.ndarray) -> pa.RecordBatch:
        gaps = np.isnan(x[:-1])
        return as_block(gaps.astype(np.uint8), np.concatenate([np.where(gaps, fill, x[:-1]), x[-1:], np.zeros((1, x.shape[1]))]))

    return settle_table(dealt.select(*cols, number).mapInArrow(run, BLOCKS), "forest")


def _seen(blocks: DataFrame, d: int, others: list[int], j: int, cuts: list[np.ndarray], base: float) -> DataFrame:
    """(codes of the other columns; labels from their mean, numbers) of the rows that have column j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for gaps, v in unblock(b, d, d + 2):
                at = np.flatnonzero(gaps[j] == 0)
                if len(at):
                    codes = codes_of(v[others][:, at], cuts)
                    yield as_block(codes, np.stack([v[j, at] - base, v[d, at]]))

    return blocks.mapInArrow(run, BLOCKS)


def _filled(gaps: np.ndarray, v: np.ndarray, j: int, forest: Forest, fresh: bool) -> np.ndarray:
    old, v = v[j], v.copy()
    _replay(v[: len(gaps)], gaps[j] != 0, j, forest)
    change = np.abs(v[j] - old)
    v[-1] = change if fresh else np.maximum(v[-1], change)
    return v


def _change(state: Carried) -> float:
    """The largest change of a cell in this round."""
    d, arrays = state.width, state.arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = [float(v[-1].max()) for _, v in unblock(b, d, arrays)]
            yield pa.RecordBatch.from_arrays([pa.array(most, pa.float64())], ["most"])

    out = state.blocks.mapInArrow(run, "most double").agg(F.max("most")).first()[0]
    state.scanned()
    return out or 0.0
