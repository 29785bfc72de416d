"""Compression of vectors to codes: per part of a vector, the nearest entry of a small codebook, by exact integer
k-means with adaptive distance bounds.

For every part the ``b`` closest entries are kept with ordered lower bounds on the distances of all but the first, and one outer
bound for the entries that are not listed. When entries move, bounds fall by as much as their entry has moved, the
outer one by the largest move. A part whose entry is closer than the first bound keeps it; one that is closer
than the z-th bound looks at z entries only; any other looks at all. All that is looked at is measured in whole numbers, and a
bound that is only reached, not cleared, counts as uncertain, so results are those of the plain method. ``b``
starts at a quarter of the entries and falls to what parts needed in the last round (an eighth at least).

Vectors are packed once, in blocks of the shared folder; each round writes a block's bounds (two bytes each, rounded down) to a new file.
What meets between rounds are sums and counts per entry, added up by Spark; the driver holds the codebooks
(entries times components) and nothing that grows with the rows.

Rows with a null vector or with null or infinite components are left out, as are those whose number of components is not the
most frequent one (the smaller of equals). If that number is no multiple of the parts, zeros fill the last part. With fewer vectors than
entries, a codebook has as many entries as there are vectors. Null keys count as the largest; equal keys go by components. Repeated rows
are coded each. Components beyond 2^28 after scaling raise an OverflowError. No rows give no codes.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.files import Writer, block
from gapweave.llm.skew import join_counted
from gapweave.llm.tokens import column
from gapweave.session import new_folder, settle_table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 1 << 28
#: Vectors in a block.
BLOCK = 1 << 15
#: Bounds are kept in units of the largest one in 65534; this value stands for no further entry.
ENDLESS = 65535


def _integers(df: DataFrame, key: str, vector: str, label: str | None, scale: int) -> DataFrame:
    """key, label, v (array of long) of the rows that count, of any number of components."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = F.lit(None).cast("int") if label is None else F.col(label)
    return df.where(F.col(vector).isNotNull() & finite).select(F.col(key).alias("key"), own.alias("label"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def distances(v: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    d = v - entry
    return (d * d).sum(axis=-1)


class Bounds:
    """Of one part position: the listed entries of each vector, nearest first, and the bounds behind them. ``low[:, z - 1]`` is for
    entry z of the list, the last for all that are not listed; bounds never fall along a row."""

    def __init__(self, listed: np.ndarray, low: np.ndarray):
        self.listed, self.low = listed, low

    @staticmethod
    def measured(v: np.ndarray, book: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
        """From distances to all entries; and the least of these."""
        every = np.stack([distances(v, e) for e in book], axis=1)
        order = np.argsort(every, axis=1, kind="stable")  # ties to the lower index
        near = np.take_along_axis(every, order, axis=1)
        low = np.full((len(v), b), np.inf)
        beyond = np.sqrt(near[:, 1:b + 1].astype(np.float64))
        low[:, :beyond.shape[1]] = beyond
        return Bounds(order[:, :b].astype(np.uint8), low), near[:, 0]

    def moved(self, moves: np.ndarray, b: int) -> None:
        """Entries have moved by at most ``moves``; from now on ``b`` are listed."""
        low = self.low
        low[:, :-1] -= moves[self.listed[:, 1:]]
        low[:, -1] -= moves.max(initial=0.0)
        low[:] = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
        # What stands behind the last listed entry bounds the entries that leave the list, too.
        self.listed, self.low = self.listed[:, :b].copy(), low[:, :b].copy()

    def assign(self, v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance to the nearest entry, now first in the list, and how many entries each vector looked at."""
        b = self.listed.shape[1]
        best = distances(v, book[self.listed[:, 0]])
        reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-12) + 1e-6
        looked = 1 + (self.low <= reach[:, None]).sum(axis=1)  # bounds are ordered
        for z in np.unique(looked[looked > 1]):
            at = np.flatnonzero(looked == z)
            if z > b:
                fresh, best[at] = Bounds.measured(v[at], book, b)
                self.listed[at], self.low[at] = fresh.listed, fresh.low
                continue
            own = self.listed[at, :z]
            d = np.stack([distances(v[at], book[own[:, k]]) for k in range(z)], axis=1)
            order = np.lexsort((own, d), axis=1)
            own, d = np.take_along_axis(own, order, axis=1), np.take_along_axis(d, order, axis=1)
            self.listed[at, :z], best[at] = own, d[:, 0]
            # Bounds further on may lie below: then they hold for these as well.
            self.low[at, :z - 1] = np.minimum(np.sqrt(d[:, 1:].astype(np.float64)), self.low[at, z - 1][:, None])
        return best, np.where(looked > b, len(book), looked)

    def packed(self) -> bytes:
        unit = np.max(self.low, initial=0.0, where=np.isfinite(self.low)) / (ENDLESS - 1) or 1.0
        small = np.where(np.isfinite(self.low), np.clip(np.floor(self.low / unit * (1 - 1e-12)), 0, ENDLESS - 1), ENDLESS)
        return np.float64(unit).tobytes() + self.listed.tobytes() + small.astype(np.uint16).tobytes()

    @staticmethod
    def unpacked(raw: memoryview, n: int, b: int) -> Bounds:
        unit = np.frombuffer(raw, np.float64, 1)[0]
        listed = np.frombuffer(raw, np.uint8, n * b, 8).reshape(n, b)
        small = np.frombuffer(bytes(raw[8 + n * b:8 + 3 * n * b]), np.uint16).reshape(n, b)
        return Bounds(listed, np.where(small == ENDLESS, np.inf, small * unit))


def _pack(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """Vectors in blocks: where each lies and how many it holds."""
    folder = new_folder(rows.sparkSession, "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        file, held, made = Writer(folder, part), [], []

        def write() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            v = table["v"].chunk(0) if table["v"].num_chunks else pa.array([], table.schema.field("v").type)
            flat = v.flatten().to_numpy().reshape(len(table), width)
            if np.abs(flat).max(initial=0) > LARGEST:
                raise OverflowError(f"a component lies beyond {LARGEST} after scaling")
            full = np.zeros((len(table), -(-width // parts) * parts), np.int64)
            full[:, :width] = flat
            kind = np.int16 if np.abs(full).max(initial=0) < 1 << 15 else np.int64
            sink = io.BytesIO()
            rest = table.drop_columns(["v"])
            with pa.ipc.new_stream(sink, rest.schema) as out:
                out.write_table(rest)
            raw = full.astype(kind).tobytes()
            made.append(((part << 32) + len(made), len(table), np.dtype(kind).itemsize, *file.put(raw + sink.getvalue())))
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BLOCK:
                write()
        if held and sum(map(len, held)):
            write()
        file.close()
        if made:
            cols = list(zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in cols], ["block", "n", "bytes", "path", "at", "size"])

    return settle_table(rows.mapInArrow(run, "block long, n long, bytes long, path string, at long, size long"), "blocks")


def _vectors(row: dict, width: int) -> tuple[np.ndarray, bytes]:
    raw = block(row["path"], row["at"], row["size"])
    size = row["n"] * width * row["bytes"]
    kind = np.int16 if row["bytes"] == 2 else np.int64
    return np.frombuffer(raw[:size], kind).astype(np.int64).reshape(row["n"], width), raw[size:]


def _bounds(row: dict, v: list[np.ndarray], books: np.ndarray, moves: np.ndarray | None, b_was: int, b: int) -> list[tuple[Bounds, np.ndarray, np.ndarray]]:
    """(bounds, squared distance, entries looked at) by part, from the block's bounds of the round before, if any."""
    out = []
    if moves is None:
        for own, book in zip(v, books, strict=True):
            bounds, best = Bounds.measured(own, book, b)
            out.append((bounds, best, np.full(len(own), len(book))))
        return out
    raw, n, at = memoryview(block(row["state"], row["state_at"], row["state_size"])), row["n"], 0
    for own, book, move in zip(v, books, moves, strict=True):
        bounds = Bounds.unpacked(raw[at:at + 8 + 3 * n * b_was], n, b_was)
        at += 8 + 3 * n * b_was
        bounds.moved(move, b)
        out.append((bounds, *bounds.assign(own, book)))
    return out


def _sums(v: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(own, kind="stable")
    first = np.searchsorted(own[order], np.arange(k))
    total = np.r_[np.zeros((1, v.shape[1]), np.int64), np.cumsum(v[order], axis=0)]
    edge = np.r_[first, len(own)]
    return total[edge[1:]] - total[edge[:-1]], np.diff(edge)


def _round(blocks: DataFrame, books: np.ndarray, moves: np.ndarray | None, b_was: int, b: int) -> tuple[DataFrame, np.ndarray]:
    """Assign all parts; the blocks with their new bounds, and added up: components and parts by entry, and parts by
    how many entries they looked at."""
    spark = blocks.sparkSession
    folder = new_folder(spark, "bounds")
    parts, k, w = books.shape
    given = ["block", "n", "bytes", "path", "at", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, made = Writer(folder, TaskContext.get().partitionId()), []
        for batch in batches:
            for row in batch.to_pylist():
                whole, _ = _vectors(row, parts * w)
                v = [whole[:, p * w:(p + 1) * w] for p in range(parts)]
                got = _bounds(row, v, books, moves, b_was, b)
                added = [_sums(x, g[0].listed[:, 0], k) for x, g in zip(v, got, strict=True)]
                looked = np.bincount(np.concatenate([g[2] for g in got]), minlength=k + 1)
                numbers = np.concatenate([np.stack([a[0] for a in added]).ravel(), np.stack([a[1] for a in added]).ravel(), looked])
                made.append((*[row[c] for c in given], *file.put(b"".join(g[0].packed() for g in got)), numbers.tolist()))
        file.close()
        for m in made:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(m, kinds, strict=True)], names)

    names = [*given, "state", "state_at", "state_size", "numbers"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    schema = "block long, n long, bytes long, path string, at long, size long, state string, state_at long, state_size long, numbers array<long>"
    done = settle_table(_dealt(blocks).mapInArrow(run, schema), "round")
    added = np.zeros(parts * k * w + parts * k + k + 1, np.int64)
    for r in done.select(F.posexplode("numbers")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        added[r["pos"]] = r["n"]
    return done.drop("numbers"), added


def _dealt(blocks: DataFrame) -> DataFrame:
    """A block is work for a task of its own: its row only says where it lies."""
    return blocks.repartition(max(1, min(blocks.count(), 1 << 16)), "block")


def _moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.sqrt(distances(old, new).astype(np.float64)) * (1 + 1e-12) + 1e-6


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error) of every vector that counts, and the codebooks (parts, entries, components). A code has an
    entry's number per part; the error is the sum of squared distances."""
    rows = _integers(df, key, vector, label, scale)
    kinds = df.schema[key].dataType.simpleString(), "int" if label is None else df.schema[label].dataType.simpleString()
    schema = f"key {kinds[0]}, label {kinds[1]}, code binary, error long"
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if most is None:
        return df.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    width = most["n"]
    rows = rows.where(F.size("v") == width)
    first = rows.orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).collect()
    w = -(-width // parts)
    start = np.zeros((len(first), parts * w), np.int64)
    start[:, :width] = np.array([r["v"] for r in first], np.int64).reshape(len(first), width)
    books = np.ascontiguousarray(start.reshape(len(first), parts, w).transpose(1, 0, 2))
    k = len(first)
    least = max(1, min(k, k // 8))
    b_was = b = max(least, k // 4)
    blocks, moves = _pack(rows, width, parts), None
    for _ in range(rounds):
        blocks, added = _round(blocks, books, moves, b_was, b)
        sums, counts, looked = added[:parts * k * w].reshape(parts, k, w), added[parts * k * w:parts * k * (w + 1)].reshape(parts, k, 1), added[parts * k * (w + 1):]
        new = np.where(counts > 0, sums // np.maximum(counts, 1), books)
        b_was = b
        if moves is not None:  # the first round had to look at all
            b = max(least, min(b, int(np.flatnonzero(looked).max(initial=1))))
        moves = np.stack([_moved(x, y) for x, y in zip(books, new, strict=True)])
        books = new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                whole, rest = _vectors(row, parts * w)
                got = _bounds(row, [whole[:, p * w:(p + 1) * w] for p in range(parts)], books, moves, b_was, b)
                codes = np.stack([g[0].listed[:, 0] for g in got], axis=1)
                error = np.sum([g[1] for g in got], axis=0)
                table = pa.ipc.open_stream(rest).read_all()
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                whole_table = pa.table([table["key"], table["label"], packed, pa.array(error, pa.int64())], ["key", "label", "code", "error"])
                yield from whole_table.combine_chunks().to_batches()

    if rounds == 0:
        b_was = b
    return _dealt(blocks).mapInArrow(run, schema), books


def report(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, code (two hex digits a part), error, label_error (error over equal labels, nulls together), codebooks_sha256."""
    coded, books = compress(df, key, vector, label)
    coded = settle_table(coded.withColumn("mark", F.array("label")), "codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # In an array, null equals null.
    totals = settle_table(coded.groupBy("mark").agg(F.count("*").alias("rows"), F.sum("error").alias("label_error")), "labels")
    return join_counted(coded, totals, "mark", "rows", coded.count()).select(
        F.col("key").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
