"""Exact nearest neighbours with gaps, without comparing all pairs.

Donor rows are put into cells: rows with the same pattern of gaps, cut by a
k-d tree grown on a sample. The trees, with the bounding box of every node and
a few sampled donors per cell, are broadcast; their size is bounded. A query
walks the trees: sampled donors bound its k-th distance from above, boxes bound
the distance to any row below them, so it is sent only to the cells that can
still hold one of its neighbours.
Cells are cut into blocks of bounded size on both sides before rows meet, so a
dense cell or a hot pattern is spread over many tasks.

Distance: sqrt(d / m * sum over the m jointly observed columns of diff^2).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.functions.gram import pattern_key
from gapweave.functions.rng import hash_uniform

SAMPLE = 200000      # donor rows used to grow the trees
PROBE = 1000         # donor rows used for the first upper bound
MAX_LEAVES = 32768   # bound on the broadcast trees
MAX_PATTERNS = 1024  # bound on patterns with trees of their own
ROWS_PER_LEAF = 512
PER_CELL = 8         # sampled donors per cell, for the second upper bound
PAIRS = 200000       # (query, node) pairs looked at together
BLOCK = 4096         # rows of one side that meet in one task call
CHUNK = 256          # queries compared at once, bounds memory
EMIT = 50000         # rows handed on at once
TARGETS = 60         # targets searched together
QUERY_PATTERNS = 64  # sets of observed columns of queries that get a search of their own


@dataclass
class _Tree:
    """k-d cuts of one pattern; node = (column, cut, left, right) or leaf number."""

    nodes: list

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype="int64")
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                out[rows] = node
                continue
            j, cut, left, right = node
            low = x[rows, j] <= cut
            stack += [(left, rows[low]), (right, rows[~low])]
        return out


def _grow(x: np.ndarray, seen: np.ndarray, leaves: int) -> _Tree:
    """Cut the widest observed column at its median until enough leaves exist."""
    nodes: list = []
    count = [0]
    usable = np.flatnonzero(seen)

    def build(rows: np.ndarray, want: int) -> int:
        at = len(nodes)
        nodes.append(None)
        cut = None
        if want > 1 and len(rows) > 1 and len(usable):
            spread = np.ptp(x[rows][:, usable], axis=0)
            j = int(usable[int(np.argmax(spread))])
            if spread.max() > 0:
                values = x[rows, j]
                cut = float(np.median(values))
                if cut >= values.max():
                    cut = float(values[values < values.max()].max())
        if cut is None:
            nodes[at] = count[0]
            count[0] += 1
            return at
        low = x[rows, j] <= cut
        left = build(rows[low], want // 2)
        right = build(rows[~low], want - want // 2)
        nodes[at] = (j, cut, left, right)
        return at

    build(np.arange(len(x)), leaves)
    return _Tree(nodes)


def _bits(mask: np.ndarray) -> np.ndarray:
    """Pattern number of each row: bit j set where column j is missing."""
    return mask @ (1 << np.arange(mask.shape[1], dtype="int64"))


def _pattern_columns(donors: DataFrame, columns: list[str]) -> list[int]:
    """Columns whose gaps define a cell; fewer when patterns would be too many."""
    use = list(range(min(len(columns), 60)))
    while use:
        seen = donors.select(pattern_key([columns[j] for j in use]).alias("p")).distinct().limit(MAX_PATTERNS + 1)
        if seen.count() <= MAX_PATTERNS:
            return use
        use = use[: len(use) // 2]
    return use


def _lower_bound(x, seen, lo, hi, every, some):
    """Least possible d/m * sum diff^2 between each query and the rows in its paired box.

    Columns all rows have are in every joint set; columns only some rows have may
    or may not be. The least mean over the possible joint sets is reached by
    adding optional columns in ascending order. Infinite where no column can be shared.
    """
    q = np.where(seen, x, 0.0)
    gap = np.maximum(np.maximum(lo - q, q - hi), 0.0) ** 2
    must, may = seen & every, seen & some & ~every
    n, start = must.sum(-1), np.where(must, gap, 0.0).sum(-1)
    with np.errstate(all="ignore"):
        best = np.where(n > 0, start / n, np.inf)
        mixed = np.flatnonzero(may.any(-1))
        if len(mixed):
            extra = np.sort(np.where(may[mixed], gap[mixed], np.inf), axis=-1)
            means = (start[mixed, None] + np.cumsum(extra, axis=-1)) / (n[mixed, None] + np.arange(1, x.shape[1] + 1))
            best[mixed] = np.minimum(best[mixed], means.min(-1))
    return x.shape[1] * best


def _pair_distances(x, d):
    """Squared scaled distance of paired rows."""
    both = ~np.isnan(x) & ~np.isnan(d)
    n = both.sum(-1)
    with np.errstate(all="ignore"):
        return np.where(n > 0, np.where(both, (x - d) ** 2, 0.0).sum(-1) * x.shape[1] / n, np.nan)


@dataclass
class _Forest:
    """All trees as arrays; ``cell`` is -1 inside and a cell number at leaves that hold donors."""

    roots: np.ndarray
    children: np.ndarray
    cell: np.ndarray
    box: dict
    have: np.ndarray      # donors per cell and target
    blocks: np.ndarray    # blocks per cell
    probe: tuple          # sampled donors, and which targets they have
    near: tuple           # sampled donors by cell, which targets they have, start and count per cell

    def bounds(self, x, wanted, k):
        """Upper bound on the k-th squared distance of each query and target, from the probe rows."""
        rows, has = self.probe
        dist = _distances(x, rows)
        out = np.full(wanted.shape, np.inf)
        for i in range(wanted.shape[1]):
            ok = np.where(has[:, i] & ~np.isnan(dist), dist, np.inf)
            if ok.shape[1] >= k:
                out[:, i] = np.partition(ok, k - 1, axis=1)[:, k - 1]
        return out

    def walk(self, x, reach):
        """(query, cell, lower bound) of all leaves within each query's reach."""
        seen = ~np.isnan(x)
        far = np.where(np.isfinite(reach), reach * (1 + 1e-9) + 1e-300, np.inf)
        stack = [(np.repeat(np.arange(len(x)), len(self.roots)), np.tile(self.roots, len(x)))]
        found = []
        while stack:
            q, node = stack.pop()
            if len(q) > PAIRS:
                stack += [(q[PAIRS:], node[PAIRS:])]
                q, node = q[:PAIRS], node[:PAIRS]
            low = _lower_bound(x[q], seen[q], *(self.box[t][node] for t in ("lo", "hi", "every", "some")))
            ok = (low <= far[q]) & np.isfinite(low)
            q, node, low = q[ok], node[ok], low[ok]
            leaf = self.cell[node] >= 0
            found.append((q[leaf], self.cell[node[leaf]], low[leaf]))
            q, pair = q[~leaf], self.children[node[~leaf]]
            if len(q):
                q, node = np.repeat(q, 2), pair.ravel()
                stack.append((q[node >= 0], node[node >= 0]))
        return tuple(np.concatenate(v) for v in zip(*found))

    def tighten(self, x, q, cell, reach, k):
        """Improve the upper bounds with the sampled donors of the cells found."""
        rows, has, start, count = self.near
        times = count[cell]
        at = np.repeat(start[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        who = np.repeat(q, times)
        dist = _pair_distances(x[who], rows[at])
        for i in range(reach.shape[1]):
            ok = has[at, i] & ~np.isnan(dist)
            w, v = who[ok], dist[ok]
            order = np.lexsort((v, w))
            w, v = w[order], v[order]
            first = np.searchsorted(w, np.arange(len(x)))
            last = np.searchsorted(w, np.arange(len(x)), side="right")
            enough = last - first >= k
            reach[enough, i] = np.minimum(reach[enough, i], v[first[enough] + k - 1])
        return reach


def _plant(trees: dict, stats: pd.DataFrame, d: int) -> tuple:
    """Join the trees with the measured cells; node boxes are made from the leaves up."""
    cells = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(stats["pkey"], stats["leaf"]))}

    def table(prefix):
        return stats[[f"{prefix}{j}" for j in range(d)]].to_numpy("float64")

    count = table("n")
    leaf_box = {"lo": np.nan_to_num(table("lo"), nan=np.inf), "hi": np.nan_to_num(table("hi"), nan=-np.inf),
                "every": count == stats["rows"].to_numpy("float64")[:, None], "some": count > 0}
    children, cell, boxes = [], [], []

    def add(pair, number, box):
        children.append(pair)
        cell.append(number)
        boxes.append(box)
        return len(cell) - 1

    def grow(key, nodes, at):
        node = nodes[at]
        if isinstance(node, int):
            number = cells.get((key, node))
            return -1 if number is None else add((-1, -1), number, {t: v[number] for t, v in leaf_box.items()})
        pair = [grow(key, nodes, side) for side in node[2:]]
        kept = [c for c in pair if c >= 0]
        if len(kept) < 2:
            return kept[0] if kept else -1
        a, b = (boxes[c] for c in kept)
        return add(tuple(pair), -1, {"lo": np.minimum(a["lo"], b["lo"]), "hi": np.maximum(a["hi"], b["hi"]),
                                     "every": a["every"] & b["every"], "some": a["some"] | b["some"]})

    roots = [grow(int(p), trees[int(p)].nodes if int(p) in trees else [0], 0) for p in sorted(set(stats["pkey"]))]
    box = {t: np.array([b[t] for b in boxes]) for t in leaf_box}
    box["lo"] = np.where(box["some"], box["lo"], 0.0)
    box["hi"] = np.where(box["some"], box["hi"], 0.0)
    return cells, np.array(roots), np.array(children), np.array(cell), box


def _distances(x, d):
    """Squared scaled distances between two sets of rows with gaps (NaN where undefined)."""
    seen_x, seen_d = ~np.isnan(x), ~np.isnan(d)
    fx, fd = np.where(seen_x, x, 0.0), np.where(seen_d, d, 0.0)
    both = seen_x.astype("float64") @ seen_d.T.astype("float64")
    if both.size and both.min() == x.shape[1]:
        total = np.zeros(both.shape)
        for j in range(x.shape[1]):
            total += (x[:, j, None] - d[None, :, j]) ** 2
        return total
    total = np.zeros(both.shape)
    for j in range(x.shape[1]):
        diff = (fx[:, j, None] - fd[None, :, j]) ** 2
        total += diff * (seen_x[:, j, None] & seen_d[None, :, j])
    with np.errstate(all="ignore"):
        return np.where(both > 0, total * (x.shape[1] / both), np.nan)


def nearest(
    queries: DataFrame,
    donors: DataFrame,
    columns: list[str],
    payload: list[str],
    k: int,
    row_id: str = "row_id",
    exclude_self: bool = False,
    per_target: bool = False,
) -> DataFrame:
    """The k nearest donors of each query: (row_id, target, rank, dist2, donor_id, value).

    ``payload`` names the donor columns handed back. With ``per_target`` each
    payload column is searched on its own, among donors that have it and for
    queries that lack it; otherwise one search returns all payload values.
    Equal distances are settled by donor ``row_id``.
    """
    if per_target and len(payload) > TARGETS:
        # Wanted targets travel as bits of one number: more of them are searched in turn.
        parts = [nearest(queries, donors, columns, payload[i:i + TARGETS], k, row_id, exclude_self, True) for i in range(0, len(payload), TARGETS)]
        return reduce(DataFrame.unionByName, parts)
    if per_target and set(payload) <= set(columns):
        clean = [F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns]
        asking, giving = queries.select(row_id, *clean), donors.select(row_id, *clean)
        lacks = reduce(Column.__or__, [F.col(t).isNull() for t in payload])
        found = asking.where(lacks).select(pattern_key(columns[:TARGETS]).alias("p")).distinct().limit(QUERY_PATTERNS + 1).collect()
        if len(columns) <= TARGETS and len(found) <= QUERY_PATTERNS:
            return _by_pattern(asking, giving.persist(), columns, payload, k, row_id, exclude_self, sorted(r["p"] for r in found))
    return _search(queries, donors, columns, payload, k, row_id, exclude_self, per_target)


def _by_pattern(queries, donors, columns, payload, k, row_id, exclude_self, patterns) -> DataFrame:
    """One search for each set of columns that queries have. Donors alike in these are equally far from such a query, so of those
    that have a target only the lowest ids can be chosen. The others go before any search: they all would lie within reach of
    every query that shares their values."""
    parts = []
    for p in patterns:
        seen = [c for j, c in enumerate(columns) if not p >> j & 1]
        wanted = [t for t in payload if t not in seen]
        if not seen or not wanted:
            continue
        names = {t: f"__v_{t}" for t in wanted}
        nothing = F.lit(None).cast("double")
        alike = Window.partitionBy(*seen).orderBy(row_id)
        some = donors.where(reduce(Column.__or__, [F.col(c).isNotNull() for c in seen]))
        chosen = []
        for t in wanted:
            first = some.where(F.col(t).isNotNull()).withColumn("__n", F.row_number().over(alike)).where(F.col("__n") <= k + int(exclude_self))
            chosen.append(first.select(row_id, *[F.col(c) if c in seen else nothing.alias(c) for c in columns],
                                       *[F.col(t).alias(names[u]) if u == t else nothing.alias(names[u]) for u in wanted]))
        own = reduce(DataFrame.unionByName, chosen).persist()
        if own.isEmpty():
            continue
        asking = queries.where(pattern_key(columns) == p).withColumns({v: nothing for v in names.values()})
        near = _search(asking, own, columns, list(names.values()), k, row_id, exclude_self, True)
        parts.append(near.withColumn("target", F.substr("target", F.lit(len("__v_") + 1))))
    if parts:
        return reduce(DataFrame.unionByName, parts)
    if donors.isEmpty():
        raise ValueError("no donor rows")
    return donors.select(row_id, F.lit("").alias("target"), F.lit(0.0).alias("dist2"), F.col(row_id).alias("donor_id"), F.lit(0.0).alias("value"), F.lit(1).alias("rank")).limit(0)


def _search(queries: DataFrame, donors: DataFrame, columns: list[str], payload: list[str], k: int, row_id: str, exclude_self: bool,
            per_target: bool) -> DataFrame:
    spark = donors.sparkSession
    d = len(columns)
    targets = payload if per_target else ["*"]
    extra = [c for c in payload if c not in columns]
    need = list(dict.fromkeys([row_id, *columns, *extra]))
    donors = donors.select(*need)
    if not per_target:
        # copies of one point: only the k lowest ids can ever be neighbours (one more when a row skips itself)
        w = Window.partitionBy(*columns).orderBy(row_id)
        donors = (
            donors.withColumn("copy", F.row_number().over(w))
            .where(F.col("copy") <= k + int(exclude_self)).drop("copy")
        )
    donors = donors.persist()
    n_donors = donors.count()
    if n_donors == 0:
        raise ValueError("no donor rows")

    # --- cells -----------------------------------------------------------
    cut_by = _pattern_columns(donors, columns)
    share = min(1.0, SAMPLE / n_donors)
    sample = donors.where(hash_uniform(0, "cells", "", row_id) <= share).select(*columns, *extra).toPandas()
    sx = sample[columns].to_numpy("float64")
    miss = np.isnan(sx)
    keys = _bits(miss[:, cut_by]) if cut_by else np.zeros(len(sx), "int64")
    leaves_total = int(min(MAX_LEAVES, len(sx) // 2 + 1, max(1, n_donors // ROWS_PER_LEAF)))
    trees = {}
    for p in np.unique(keys):
        rows = sx[keys == p]
        seen = np.zeros(d, bool)
        seen[cut_by] = [not (int(p) >> b) & 1 for b in range(len(cut_by))]
        trees[int(p)] = _grow(np.nan_to_num(rows), seen, max(1, int(leaves_total * len(rows) / max(1, len(sx)))))

    def place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = np.isnan(x)
        key = _bits(m[:, cut_by]) if cut_by else np.zeros(len(x), "int64")
        leaf = np.zeros(len(x), "int64")
        for p in np.unique(key):
            if int(p) in trees:
                rows = key == p
                leaf[rows] = trees[int(p)].leaf(np.nan_to_num(x[rows]))
        return key, leaf

    donor_fields = [f for f in donors.schema.fields]
    placed_schema = T.StructType(
        [T.StructField("pkey", T.LongType()), T.StructField("leaf", T.LongType()), *donor_fields])

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            key, leaf = place(b[columns].to_numpy("float64"))
            yield pd.concat([pd.DataFrame({"pkey": key, "leaf": leaf}, index=b.index), b], axis=1)

    placed = donors.mapInPandas(to_cells, placed_schema).persist()
    have = [F.col(t) for t in payload] if per_target else [F.lit(1)]
    stats = placed.groupBy("pkey", "leaf").agg(
        F.count("*").alias("rows"),
        *[f(F.col(c).cast("double")).alias(f"{t}{j}") for j, c in enumerate(columns)
          for t, f in (("lo", F.min), ("hi", F.max), ("n", F.count))],
        *[F.count(h).alias(f"t{i}") for i, h in enumerate(have)],
    ).toPandas().sort_values(["pkey", "leaf"], ignore_index=True)

    numbers, roots, children, cell, box = _plant(trees, stats, d)
    has = sample[payload].notna().to_numpy() if per_target else np.ones((len(sample), 1), bool)
    key, leaf = place(sx)
    home = np.array([numbers.get((int(a), int(b)), -1) for a, b in zip(key, leaf)], dtype="int64")
    order = np.argsort(home, kind="stable")
    first = np.searchsorted(home[order], np.arange(len(stats)))
    inside = np.searchsorted(home[order], np.arange(len(stats)), side="right") - first
    step = max(1, len(sx) // PROBE)
    forest = _Forest(
        roots, children, cell, box, stats[[f"t{i}" for i in range(len(targets))]].to_numpy("float64"),
        np.ceil(stats["rows"].to_numpy() / BLOCK).astype("int64"), (sx[::step], has[::step]),
        (sx[order], has[order], first, np.minimum(inside, PER_CELL)))
    # Plain values: a broadcast names classes by module, which workers need not have.
    small = spark.sparkContext.broadcast(tuple(getattr(forest, f.name) for f in fields(forest)))
    need_k = k + int(exclude_self)

    # --- send each query to the cells that can matter ----------------------
    queries = queries.select(F.col(row_id), *[F.col(c).cast("double").alias(c) for c in columns],
                             *([F.col(t).isNull().alias(f"lack_{t}") for t in extra] if per_target else []))
    visit_schema = T.StructType(
        [T.StructField("cell", T.LongType()), T.StructField("block", T.LongType()),
         T.StructField("targets", T.LongType()), T.StructField(row_id, queries.schema[row_id].dataType),
         *[T.StructField(f"q{j}", T.DoubleType()) for j in range(d)]])
    places = [f"q{j}" for j in range(d)]

    def wanted(b: pd.DataFrame) -> np.ndarray:
        if not per_target:
            return np.ones((len(b), 1), bool)
        return np.column_stack([b[t].isna() if t in columns else b[f"lack_{t}"].astype(bool) for t in payload])

    def to_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = _Forest(*small.value)
        for whole in batches:
            for at in range(0, len(whole), CHUNK):
                b = whole.iloc[at: at + CHUNK]
                lacks = wanted(b)
                b, lacks = b[lacks.any(1)], lacks[lacks.any(1)]
                if b.empty:
                    continue
                x = b[columns].to_numpy("float64")
                reach = forest.bounds(x, lacks, need_k)
                q, c, low = forest.walk(x, np.where(lacks, reach, 0.0).max(1))
                reach = forest.tighten(x, q, c, reach, need_k)
                # slack: bounds and distances are summed in different order
                ok = (low[:, None] <= reach[q] * (1 + 1e-9) + 1e-300) & (forest.have[c] > 0) & lacks[q]
                bits = (ok.astype("int64") << np.arange(ok.shape[1], dtype="int64")).sum(1)
                q, c, bits = (v[bits > 0] for v in (q, c, bits))
                times = forest.blocks[c]
                block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                q, c, bits = (np.repeat(v, times) for v in (q, c, bits))
                for cut in range(0, len(q), EMIT):
                    i, j, t, m = (v[cut: cut + EMIT] for v in (q, c, block, bits))
                    yield pd.DataFrame({"cell": j, "block": t, "targets": m, row_id: b[row_id].to_numpy()[i],
                                        **dict(zip(places, x[i].T))})

    visits = queries.mapInPandas(to_visits, visit_schema).persist()

    # --- blocks of queries meet blocks of donors ---------------------------
    first_cells = spark.sparkContext.broadcast((numbers, forest.blocks))
    slot_schema = T.StructType(
        [T.StructField("cell", T.LongType()), T.StructField("block", T.LongType()), *donor_fields])

    def to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, blocks_of = first_cells.value
        for b in batches:
            cell = np.array([numbers[(int(p), int(q))] for p, q in zip(b["pkey"], b["leaf"])], dtype="int64")
            spread = pd.util.hash_array(b[row_id].to_numpy(), categorize=False) % blocks_of[cell].astype("uint64")
            yield pd.concat([pd.DataFrame({"cell": cell, "block": spread.astype("int64")}, index=b.index),
                             b.drop(columns=["pkey", "leaf"])], axis=1)

    blocks = placed.mapInPandas(to_blocks, slot_schema)
    # queries of a popular cell are spread as well; the donors of that block follow them
    load = visits.groupBy("cell", "block").count().withColumn("parts", F.ceil(F.col("count") / F.lit(BLOCK)).cast("long"))
    load = load.select("cell", "block", "parts")
    spread_visits = visits.join(load, ["cell", "block"]).withColumn(
        "part", F.pmod(F.xxhash64(row_id), F.col("parts"))).drop("parts")
    copies = blocks.join(load, ["cell", "block"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    names = list(targets)
    id_type = donors.schema[row_id].dataType
    out_schema = T.StructType(
        [T.StructField(row_id, id_type), T.StructField("target", T.StringType()),
         T.StructField("dist2", T.DoubleType()), T.StructField("donor_id", id_type),
         *([T.StructField("value", T.DoubleType())] if per_target else
           [T.StructField(c, T.DoubleType()) for c in payload])])

    def meet(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        blank = pd.DataFrame({f.name: [] for f in out_schema.fields}, dtype=object)
        if q.empty or m.empty:
            return blank
        m = m.sort_values(row_id, ignore_index=True)
        dx = m[columns].to_numpy("float64")
        ids = m[row_id].to_numpy()
        parts = []
        for at in range(0, len(q), CHUNK):
            piece = q.iloc[at: at + CHUNK]
            dist = _distances(piece[places].to_numpy("float64"), dx)
            me = piece[row_id].to_numpy()
            if exclude_self:
                dist[me[:, None] == ids[None, :]] = np.nan
            for i, t in enumerate(names):
                asks = np.flatnonzero((piece["targets"].to_numpy() >> i) & 1)
                if not len(asks):
                    continue
                has = m[t].notna().to_numpy() if per_target else np.ones(len(m), bool)
                mine = np.where(has & ~np.isnan(dist[asks]), dist[asks], np.inf)
                last = min(k, mine.shape[1]) - 1
                edge = np.partition(mine, last, axis=1)[:, last]
                rows, cols = np.nonzero((mine <= edge[:, None]) & np.isfinite(mine))
                # donors are in id order, so the column settles equal distances
                order = np.lexsort((cols, mine[rows, cols], rows))
                rows, cols = rows[order], cols[order]
                keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                rows, cols = rows[keep], cols[keep]
                if not len(rows):
                    continue
                found = {row_id: me[asks][rows], "target": t, "dist2": mine[rows, cols], "donor_id": ids[cols]}
                if per_target:
                    found["value"] = m[t].to_numpy("float64")[cols]
                else:
                    found.update({c: m[c].to_numpy("float64")[cols] for c in payload})
                parts.append(pd.DataFrame(found))
        return pd.concat(parts, ignore_index=True) if parts else blank

    keys = ["cell", "block", "part"]
    near = spread_visits.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(meet, out_schema)
    w = Window.partitionBy(row_id, "target").orderBy("dist2", "donor_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
