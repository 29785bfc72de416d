"""Near-duplicate documents by b-bit MinHash, with every link confirmed on full shingle sets.

Nodes are distinct shingle sets, so copies cost one node however many there are. A set's minima
under many hash functions give band keys (candidates) and, their low bits packed, a signature
whose bit counts estimate the similarity; the estimate is corrected for chance collisions.

Buckets are cut into blocks of bounded size. In a block, pairs that the signatures allow are taken from
the most similar on; a pair whose ends are joined already is passed over, any other is checked on its
full sets and, if confirmed, joins them. So a block of n nodes emits n - 1 links at most, and a group of
copies costs about as many checks as it has members. A first wave does so with a few bands and the
blocks themselves; the second takes all bands where buckets still hold several components, deals the nodes
outside a bucket's largest component into blocks as well, and lets each of these meet every other block once. Full sets are sent only for the
nodes that the signatures give a partner. Links and components are tables throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.llm.graph import components
from gapweave.llm.tokens import SPACE, Slice, column, lists, mix, shingle_hash, slices, words
from gapweave.session import settle, settle_table

SHINGLE = 5
#: A pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^28 < 1e-6.
BANDS, ROWS = 28, 4
#: Minima in the signature, low bits kept of each, and how far below the wanted similarity an
#: estimate may lie before the pair is given up (some five standard deviations).
MINIMA, BITS, MARGIN = 256, 4, 0.125
#: Nodes in a block, on average (two blocks may meet); pairs estimated together.
BLOCK, PAIRS = 256, 1 << 19
#: Bands of the first wave.
FIRST_BANDS = 4

_rng = np.random.Generator(np.random.PCG64(20))
FACTORS = _rng.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sets(part: Slice) -> list[np.ndarray]:
    """Distinct shingle hashes of each row."""
    w = words(part, SPACE)
    grams, n, out = shingle_hash(w.hash, SHINGLE), w.per_row, []
    for at, k in zip(w.bounds[:-1].tolist(), n.tolist(), strict=True):
        if k >= SHINGLE:
            out.append(np.unique(grams[at:at + k - SHINGLE + 1]))
        elif k:
            out.append(shingle_hash(w.hash[at:at + k], k))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _node(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, MINIMA) of sets that aren't empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(flat * a, starts) for a in FACTORS], axis=1)


def _pack(minima: np.ndarray) -> np.ndarray:
    """Low bits of each minimum, two to a byte."""
    low = (mix(minima) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << BITS)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures: equal b-bit values, less what chance makes equal."""
    x = np.ascontiguousarray(a ^ b).view(np.uint64)
    for shift in (1, 2):
        x = x | (x >> np.uint64(shift))
    unlike = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1)
    chance = 2.0 ** -BITS
    return (1 - unlike / MINIMA - chance) / (1 - chance)


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, node (digest of the set, null if empty), bands, signature."""
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {docs.schema[key].dataType.simpleString()}, n_shingles long, node binary, bands array<long>, signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(column(batch, "text")):
                sets = _sets(part)
                full = [i for i, s in enumerate(sets) if len(s)]
                node, bands, signature = ([None] * part.rows for _ in range(3))
                if full:
                    minima = _minima([sets[i] for i in full])
                    packed = _pack(minima)
                    keys = np.stack([shingle_hash(np.ascontiguousarray(minima[:, k * ROWS:(k + 1) * ROWS]).ravel(), ROWS)[::ROWS] ^ mix(np.full(1, k, np.uint64) + FACTORS[:1])
                                     for k in range(BANDS)], axis=1).view(np.int64)
                    for row, i in enumerate(full):
                        node[i] = _node(sets[i])
                        bands[i] = row
                        signature[i] = packed[row].tobytes()
                    lengths = np.array([0 if b is None else BANDS for b in bands])
                    band_lists = lists(keys.ravel(), lengths, pa.int64())
                else:
                    band_lists = lists(np.zeros(0, np.int64), np.zeros(part.rows, np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    column(batch, "key").slice(part.first, part.rows), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()),
                    band_lists, pa.array(signature, pa.binary())], ["key", "n_shingles", "node", "bands", "signature"])

    return keyed.mapInArrow(run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(node, shingles: 48 bits of each shingle's hash, sorted) of the wanted (node, key). Only the texts
    of those keys are read again for it."""
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    own = keyed.join(wanted.select(F.col("key").alias("_key"), F.col("node").alias("_node")), F.col("key").eqNullSafe(F.col("_key"))).select("_node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = column(batch, "_node").to_pylist()
            for part in slices(column(batch, "text")):
                made = [(n, (x >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                        for n, x in zip(nodes[part.first:part.first + part.rows], _sets(part), strict=True) if len(x) and _node(x) == n]
                if made:
                    n, x = zip(*made, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(n, pa.binary()), pa.array(x, pa.binary())], ["node", "shingles"])

    # Rows repeating a key and a text give a set more than once.
    return own.mapInArrow(run, "node binary, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _wide(six: bytes) -> np.ndarray:
    """48-bit hashes as numbers."""
    raw = np.frombuffer(six, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64).ravel()


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    together = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((together[1:] == together[:-1]).sum())
    return 100 * shared >= percent * (len(together) - shared)


def _root(parent: dict[bytes, bytes], x: bytes) -> bytes:
    while (up := parent.get(x, x)) != x:
        parent[x] = x = parent.get(up, up)
    return x


def _links(left: list[int], right: list[int], comp: list[bytes], shingles: list[bytes], percent: int, parent: dict[bytes, bytes]) -> None:
    """Join in ``parent`` the components of pairs, best first, that are not joined yet and whose sets confirm the link."""
    sets: dict[int, np.ndarray] = {}

    def full(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = _wide(shingles[i])
        return sets[i]

    for i, j in zip(left, right, strict=True):
        a, b = _root(parent, comp[i]), _root(parent, comp[j])
        if a != b and similar(full(i), full(j), percent):
            parent[a] = b
            parent.setdefault(b, b)


def _stars(parent: dict[bytes, bytes]) -> list[tuple[bytes, bytes]]:
    """Each joined component with the least of its group."""
    least: dict[bytes, bytes] = {}
    for x in list(parent):
        r = _root(parent, x)
        least[r] = min(x, least.get(r, x))
    return [(x, c) for x in parent if (c := least[_root(parent, x)]) != x]


def _block_task(least: float, percent: int | None):
    """Works on rows sorted by (bucket, block). Without ``percent``, rows that have a partner of
    another component by signature come out again; with it, links confirmed on the rows' sets."""

    def partners(group: np.ndarray, comp: np.ndarray, signature: np.ndarray, side: np.ndarray):
        """(left, right) pairs within groups, the best first: some whole groups at a time, or a group of
        more than PAIRS in parts. Rows pair with those of the other side, rows of side 2 also among themselves."""
        n = len(group)
        new = np.r_[True, group[1:] != group[:-1]]
        start = np.flatnonzero(new)[np.cumsum(new) - 1]  # begin and end of each row's group
        last = np.r_[np.flatnonzero(new)[1:], n][np.cumsum(new) - 1]
        count = last - np.arange(n) - 1
        upto = np.cumsum(count)
        at = 0
        while at < n:
            to = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right"))
            if to < n and start[to] > at:
                to = int(start[to])
            to = max(to, at + 1)
            left = np.repeat(np.arange(at, to), count[at:to])
            before = np.cumsum(count[at:to]) - count[at:to]
            right = left + 1 + np.arange(len(left)) - np.repeat(before, count[at:to])
            ok = ((side[left] != side[right]) | (side[left] == 2)) & (comp[left] != comp[right])
            left, right = left[ok], right[ok]
            est = estimate(signature[left], signature[right])
            ok = est >= least
            left, right, est = left[ok], right[ok], est[ok]
            order = np.lexsort((right, left, -est))
            yield left[order], right[order]
            at = to

    def whole_groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, block = table["bucket"].to_numpy(), table["block"].to_numpy()
        group = np.cumsum(np.r_[False, (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])])
        comps = table["comp"].to_pylist()
        number = {c: i for i, c in enumerate(set(comps))}
        signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(len(table), -1)
        pairs = partners(group, np.array([number[c] for c in comps]), signature, table["side"].to_numpy())
        if percent is None:
            keep = np.zeros(len(table), bool)
            for left, right in pairs:
                keep[left] = keep[right] = True
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()
            return
        shingles = table["shingles"].to_pylist()
        parent: dict[bytes, bytes] = {}
        for left, right in pairs:
            _links(left.tolist(), right.tolist(), comps, shingles, percent, parent)
        found = _stars(parent)
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            bucket, block = table["bucket"].to_numpy(), table["block"].to_numpy()
            other = np.flatnonzero((bucket != bucket[-1]) | (block != block[-1]))
            tail = int(other[-1]) + 1 if len(other) else 0
            if tail:
                yield from whole_groups(table.slice(0, tail))
            held = table.slice(tail)
        if held is not None:
            yield from whole_groups(held)

    return run


def memberships(nodes: DataFrame) -> DataFrame:
    """(band, bucket, node) of all buckets with several nodes. The signatures stay behind."""
    bands = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    several = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return bands.join(several, "bucket").select("band", "bucket", "node")


def wave(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, bands: int, across: bool) -> DataFrame:
    """Confirmed links (a, b) between components (``nodes``: node, comp, signature), from nodes that share
    one of the first ``bands`` bands: within blocks, or with ``across`` also between them."""
    rows = members.where(F.col("band") < bands).join(nodes.select("node", "comp", "signature"), "node")
    split = rows.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(
        F.sum("n").alias("n"), F.max("n").alias("major"), F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("largest")).where("comps > 1")
    by = F.xxhash64("node", F.lit(bands))

    def blocks(n: Column) -> Column:
        return F.ceil(n / BLOCK).cast("int")

    if across:
        # Blocks 0 to low - 1 hold the nodes outside the largest component, low to all - 1 its own. Of two that
        # meet, the lesser is on the left; its nodes meet each other where it meets block low.
        split = split.select("bucket", "largest", blocks(F.col("n") - F.col("major")).alias("low"), blocks(F.col("major")).alias("high"))
        minor, low, own, other = F.col("comp") != F.col("largest"), F.col("low"), F.col("own"), F.col("other")
        rows = rows.join(split, "bucket").withColumn("all", low + F.col("high")).withColumn(
            "own", F.when(minor, F.pmod(by, low)).otherwise(low + F.pmod(by, F.col("high"))).cast("int")).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.when(minor, F.col("all")).otherwise(low) - 1))).where("other <> own")
        block = F.least(own, other).cast("long") * F.col("all") + F.greatest(own, other)
        side = F.when(other < own, 1).when(other == low, 2).otherwise(0)
    else:
        rows = rows.join(split.select("bucket", blocks(F.col("n")).alias("all")), "bucket")
        block, side = F.pmod(by, F.col("all")).cast("long"), F.lit(2)
    rows = rows.select("bucket", block.alias("block"), "node", "comp", "signature", side.cast("int").alias("side"))
    least = percent / 100 - MARGIN
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition("bucket", "block").sortWithinPartitions("bucket", "block")

    paired = settle_table(dealt(rows).mapInArrow(_block_task(least, None), kinds), "paired")
    return dealt(paired.join(sets, "node")).mapInArrow(_block_task(least, percent), "a binary, b binary").distinct()


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """key, n_shingles, component_id (least key reachable over links), kept, of every row of ``docs``.

    A text without words has no set, links to nothing and is kept. Rows that repeat a key count as
    one document each, linked if their sets are. A null key is never a component's id if another is
    there.
    """
    rows = settle_table(sketches(docs, key, text), "sketches")
    nodes = settle_table(rows.where("node is not null").groupBy("node").agg(
        F.min("key").alias("key"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "nodes")
    members = settle_table(memberships(nodes), "members")
    wanted = nodes.select("node", "key").join(members.select("node").distinct(), "node", "left_semi")
    sets = settle_table(full_sets(docs, wanted, key, text), "sets")
    labelled, links = nodes.withColumn("comp", F.col("node")), None
    for bands, across in ((FIRST_BANDS, False), (BANDS, True)):
        new = settle(wave(members, labelled, sets, percent, bands, across))
        links = new if links is None else links.unionByName(new)
        labelled = nodes.select("node", "key", "signature").join(components(links), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        labelled = settle_table(labelled, "labels")
    group = labelled.groupBy("comp").agg(F.min("key").alias("component_id"))
    ids = labelled.select("node", "comp").join(group, "comp").select("node", "component_id")
    return rows.select("key", "n_shingles", "node").join(ids, "node", "left").select(
        F.col("key").alias(key), "n_shingles", F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their group; rows are told apart by doc_id and text, so
    full copies of a row stay or go together."""
    own = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id"), F.xxhash64("text").alias("mark")).alias("id"), "text")
    gone = near_copies(own, "id", percent=percent).where("not kept").select(F.col("id").alias("gone")).distinct()
    return own.join(gone, F.col("id").eqNullSafe(F.col("gone")), "left_anti").select("row.*")
