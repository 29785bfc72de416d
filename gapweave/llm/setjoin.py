"""Exact Jaccard self-join of documents on sets of word shingles, by prefix index with set-relation skipping.

A set's tokens are ordered from rare to frequent over the corpus; two sets of the wanted similarity share a token of
their prefixes. Only tokens of two sets or more are listed, so a text that is mostly its own takes part in nothing.

Sets that share a prefix token meet in units. A set's block is named by the least set in any of its lists, so near
copies stand in one block (cut by hash where it grows beyond UNIT_BYTES). A unit is a block, or two
blocks for those of their sets that share a token: every pair that can be similar meets in just one unit, and a unit is
work for a task of its own.

In a unit, index lists hold (position, size, set) and are cut into blocks of one position: what the positions of both sets leave for the
overlap bounds the sizes that count, and once none is left, all blocks behind are skipped. If a set has candidates, its
overlaps with all sets of the unit are counted from the lists. For the sets found similar to it, overlaps are then
derived: copied, and corrected by the lists of the few tokens in which the two sets differ. No pairs
are put out, but each set's number of links and a star per group found.

Sets that are equal are one node with a number of copies. A text without words has an empty set and no link; one of fewer words
than a shingle has one token. Repeated keys are documents of their own; a null key is never a component's id if another is there. Other
columns are not read. An empty table gives no rows. A very long text is one set, held whole by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.files import Writer, block
from gapweave.llm.graph import components
from gapweave.llm.skew import join_counted
from gapweave.llm.tokens import SPACE, Slice, column, lists, ranges, shingle_hash, slices, words
from gapweave.session import new_folder, settle_table

SHINGLE, PERCENT = 5, 80
#: Bytes of text in a slice and per bucket of tokens; bytes of sets in a block.
SLICE_BYTES, BUCKET_BYTES, UNIT_BYTES = 4 << 20, 16 << 20, 8 << 20
#: Bits of a place within a slice, and of a slice's number within its task.
BITS = 22


def shingle_sets(part: Slice, size: int = SHINGLE) -> list[np.ndarray]:
    """Distinct shingle hashes of each row, sorted; of the whole sequence if it is shorter."""
    w = words(part, SPACE)
    grams, out = shingle_hash(w.hash, size), []
    for at, k in zip(w.bounds[:-1].tolist(), w.per_row.tolist(), strict=True):
        if k >= size:
            own = np.sort(grams[at:at + k - size + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        else:
            out.append(shingle_hash(w.hash[at:at + k], k)[:1] if k else grams[:0])
    return out


def _pack(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Write the texts in slices; a row per slice: where it lies, and keys, sizes, set sizes and set digests of its rows."""
    folder = new_folder(docs.sparkSession, "texts")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        file, coder, made, keys = Writer(folder, part), zstandard.ZstdCompressor(level=3), [], []
        for batch in batches:
            for s in slices(column(batch, "text"), SLICE_BYTES):
                sets = shingle_sets(s)
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                made.append(((part << BITS) + len(made), *file.put(coder.compress(s.data.tobytes())), np.diff(s.offsets).tolist(), [len(x) for x in sets], digests))
                keys.append(column(batch, "key").slice(s.first, s.rows))
        file.close()
        for m, k in zip(made, keys, strict=True):
            own = pa.ListArray.from_arrays(pa.array([0, len(k)], pa.int32()), k)
            yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(m, kinds, strict=True)], own], names)

    names = ["slice", "path", "at", "size", "sizes", "counts", "digests", "keys"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
    return settle_table(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"slice long, path string, at long, size long, sizes array<long>, counts array<long>, digests array<binary>, keys array<{kind}>"), "texts")


def _live_sets(row: dict) -> list[np.ndarray]:
    """Sets of a slice's rows that stand for their node."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(block(row["path"], row["at"], row["size"])), np.uint8)
    sets = shingle_sets(Slice(0, data, np.r_[0, np.cumsum(np.array(row["sizes"], np.int64))]))
    return [sets[x["place"]] for x in row["live"]]


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _wide(raw: memoryview | bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(np.uint64).ravel()


def _shared_tokens(refs: DataFrame, buckets: int) -> DataFrame:
    """(slice, shared: (h: 48 bits of tokens, sorted within a bucket, n: in how many sets of the corpus they are)) of tokens in two sets or more."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *_live_sets(row)]) >> np.uint64(16), return_counts=True)
                to = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    own = order[cut[b]:cut[b + 1]]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([row["slice"]], pa.int64()), pa.array([_six(h[own])], pa.binary()),
                                                      pa.array([n[own].astype(np.uint32).tobytes()], pa.binary())], ["bucket", "slice", "h", "n"])

    def meet(table: pa.Table) -> pa.Table:
        hs = [_wide(x.as_buffer()) for x in table["h"]]
        size = np.array([len(x) for x in hs])
        h = np.concatenate(hs)
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table["n"]]).astype(np.int64)
        own = np.repeat(np.arange(len(size), dtype=np.int32), size)
        order = np.argsort(h, kind="stable")
        at = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        total = np.repeat(np.add.reduceat(n[order], at), np.diff(np.r_[at, len(h)]))
        keep, total = order[total > 1], total[total > 1]
        again = np.argsort(own[keep], kind="stable")
        keep, total = keep[again], np.minimum(total[again], 0xFFFFFFFF).astype(np.uint32)
        cut = np.searchsorted(own[keep], np.arange(len(size) + 1))
        some = np.flatnonzero(np.diff(cut))
        ids = table["slice"].to_numpy()
        return pa.table({"slice": pa.array(ids[some], pa.int64()), "h": pa.array([_six(h[keep[cut[i]:cut[i + 1]]]) for i in some], pa.binary()),
                         "n": pa.array([total[cut[i]:cut[i + 1]].tobytes() for i in some], pa.binary())})

    sent = refs.mapInArrow(emit, "bucket long, slice long, h binary, n binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "slice long, h binary, n binary")
    return met.groupBy("slice").agg(F.collect_list(F.struct("h", "n")).alias("shared"))


def _candidates(listed: DataFrame, percent: int) -> DataFrame:
    """(node, copies, size, tokens: those of its prefix that other sets have, shingles) of sets that have such tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h = np.concatenate([_wide(x["h"]) for x in row["shared"]])
                n = np.concatenate([np.frombuffer(x["n"], np.uint32) for x in row["shared"]])
                order = np.argsort(h)
                h, n = h[order], n[order]
                sets = _live_sets(row)
                size = np.array([len(x) for x in sets], np.int64)
                flat = np.concatenate(sets) >> np.uint64(16)
                at = np.minimum(np.searchsorted(h, flat), len(h) - 1)
                found = np.where(h[at] == flat, n[at], 1)
                of = np.repeat(np.arange(len(sets)), size)
                alone = np.bincount(of[found == 1], minlength=len(sets))
                prefix = size - -(-size * percent // 100) + 1
                some = np.flatnonzero(alone < prefix)
                if not len(some):
                    continue
                begin = np.cumsum(size) - size
                pick = ranges(begin[some], size[some])
                order = np.lexsort((flat[pick], found[pick], of[pick]))
                token, many = flat[pick][order], found[pick][order] > 1
                place = ranges(np.zeros(len(some), np.int64), size[some])
                listed_ = many & (place < np.repeat(prefix[some], size[some]))
                count = np.add.reduceat(listed_.astype(np.int64), np.cumsum(size[some]) - size[some])
                live = [row["live"][i] for i in some.tolist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array([(row["slice"] << BITS) + x["place"] for x in live], pa.int64()), pa.array([x["copies"] for x in live], pa.int64()), pa.array(size[some]),
                    lists(token[listed_].view(np.int64), count, pa.int64()), pa.array([sets[i].tobytes() for i in some.tolist()], pa.binary())],
                    ["node", "copies", "size", "tokens", "shingles"])

    return settle_table(listed.mapInArrow(run, "node long, copies long, size long, tokens array<long>, shingles binary"), "candidates")


def _units(cands: DataFrame, unit_bytes: int) -> DataFrame:
    """(node, lo, hi, side): the units in which each set takes part. Within one (lo = hi) all sets meet, else those of both sides."""
    posts = settle_table(cands.select("node", "size", F.explode("tokens").alias("token")), "postings")
    total = posts.count()
    token_lists = posts.groupBy("token").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    posts = settle_table(join_counted(posts, settle_table(token_lists, "lists"), "token", "n", total).where("least IS NOT NULL"), "postings")
    named = settle_table(posts.groupBy("node").agg(F.min("least").alias("label"), F.first("size").alias("size")), "named")
    labels = named.groupBy("label").agg(F.count("*").alias("n"), F.ceil(F.sum("size") * 8 / unit_bytes).cast("int").alias("parts"))
    named = join_counted(named, settle_table(labels, "labels"), "label", "n", total)
    named = settle_table(named.select("node", F.xxhash64("label", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts"))).alias("block")), "blocks")
    placed = settle_table(posts.select("node", "token").join(named, "node"), "placed")
    spread = placed.groupBy("token").agg(F.count("*").alias("n"), F.collect_set("block").alias("blocks")).where(F.size("blocks") > 1)
    met = join_counted(placed, settle_table(spread, "spread"), "token", "n", total).where("blocks IS NOT NULL")
    across = met.select("node", "block", F.explode("blocks").alias("other")).where("block <> other").distinct()
    own = named.select("node", F.col("block").alias("lo"), F.col("block").alias("hi"), F.lit(0).alias("side"))
    return own.unionByName(across.select("node", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side")))


class Unit:
    """The sets of one unit, with lists of all their tokens, and prefix lists cut by position."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.m = percent, len(sets)
        self.size = np.array([len(s) for s in sets], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)]
        of = np.repeat(np.arange(self.m), self.size)
        _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.empty(len(count), np.int64)
        number[np.argsort(count, kind="stable")] = np.arange(len(count))  # rare ones first
        token = number[token]
        self.token = token[np.lexsort((token, of))]
        by = np.argsort(self.token, kind="stable")
        self.rows, self.count = of[by], np.sort(count)
        self.first = np.cumsum(self.count) - self.count
        place = np.arange(len(of)) - self.start[of]
        self.prefix = self.size - -(-self.size * percent // 100) + 1
        listed = np.flatnonzero((place < self.prefix[of]) & (self.count[self.token] > 1))
        # By token, then position, then size: a run of one position is a block.
        listed = listed[np.lexsort((self.size[of[listed]], place[listed], self.token[listed]))]
        self.entry, self.entry_size = of[listed], self.size[of[listed]]
        new = np.flatnonzero(np.r_[True, (np.diff(self.token[listed]) != 0) | (np.diff(place[listed]) != 0)][:len(listed)])
        self.block_from, self.block_to = new, np.r_[new[1:], len(listed)][:len(new)]
        self.block_place = place[listed[new]]
        self.blocks_of = np.searchsorted(self.token[listed[new]], np.arange(len(count) + 1))

    def tokens(self, i: int) -> np.ndarray:
        return self.token[self.start[i]:self.start[i + 1]]

    def candidates(self, i: int) -> bool:
        """Whether the lists leave any set that may be similar to set i."""
        p, n = self.percent, int(self.size[i])
        least, most = -(-n * p // 100), n * 100 // p
        for place, t in enumerate(self.tokens(i)[:self.prefix[i]].tolist()):
            # 1 + what follows in set i must reach the overlap wanted for a set of size s: s is at most top.
            top = min(most, (n - place) * (100 + p) // p - n)
            for b in range(self.blocks_of[t], self.blocks_of[t + 1]):
                # The same for the other set: s - its position reaches (s + n) p / (100 + p).
                low = max(least, -(-(self.block_place[b] * (100 + p) + p * n) // 100))
                if low > top:
                    break  # positions rise: the blocks behind want larger sets still
                a, z = self.block_from[b], self.block_to[b]
                sizes = self.entry_size[a:z]
                f, g = np.searchsorted(sizes, low), np.searchsorted(sizes, top, "right")
                if g - f > 1 or (g > f and self.entry[a + f] != i):
                    return True
        return False

    def overlaps(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set has, from their lists."""
        tokens = tokens[self.count[tokens] > 1]
        return np.bincount(self.rows[ranges(self.first[tokens], self.count[tokens])], minlength=self.m)

    def derived(self, i: int, leader: int, known: np.ndarray) -> np.ndarray:
        """Overlaps of set i from those of a similar one. Of its own tokens that no other set has, only itself would know."""
        a, b = self.tokens(i), self.tokens(leader)
        return known + self.overlaps(np.setdiff1d(a, b, True)) - self.overlaps(np.setdiff1d(b, a, True))

    def links(self, side: np.ndarray | None, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By set: how many documents it links with here, and the least set of its group. With ``side`` only sets of different sides link."""
        linked, group = np.zeros(self.m, np.int64), np.arange(self.m)
        open_ = np.ones(self.m, bool)
        p = self.percent

        def take(i: int, overlap: np.ndarray) -> np.ndarray:
            open_[i] = False
            near = (100 + p) * overlap >= p * (self.size[i] + self.size)
            near[i] = False
            fresh = near & open_ if side is None else near & open_ & (side != side[i])
            hit = np.flatnonzero(fresh)
            linked[i] += copies[hit].sum()
            linked[hit] += copies[i]
            while len(other := hit[group[hit] != group[i]]):
                a, b = sorted((int(group[i]), int(group[other[0]])))
                group[group == b] = a
            return near

        for i in np.argsort(-self.size, kind="stable").tolist():
            if not open_[i]:
                continue
            if not self.candidates(i):
                open_[i] = False
                continue
            known = self.overlaps(self.tokens(i))
            near = take(i, known)
            for j in np.flatnonzero(near & open_).tolist():
                take(j, self.derived(j, i, known))
        return linked, group


def _met(table: pa.Table, percent: int) -> pa.Table:
    """One unit: (a: node, b: centre of its group or null, n: links of the node)."""
    node, side, copies = (table[c].to_numpy() for c in ("node", "side", "copies"))
    across = table["lo"][0].as_py() != table["hi"][0].as_py()
    a, b, n = (np.zeros(0, np.int64) for _ in range(3))
    if len(node) > 1:
        order = np.argsort(node)
        sets = [np.frombuffer(table["shingles"][i].as_buffer(), np.uint64) for i in order.tolist()]
        linked, group = Unit(sets, percent).links(side[order] if across else None, copies[order])
        hit = np.flatnonzero(linked)
        a, b, n = node[order][hit], node[order][group[hit]], linked[hit]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """key, n_shingles, component_id (least key reachable by links), n_links (documents it links with, copies included) of every row."""
    packed = _pack(docs, key, text)
    rows = packed.select("slice", F.posexplode(F.arrays_zip("keys", "counts", "digests")).alias("place", "d")).select(
        F.col("d.keys").alias("key"), F.col("d.counts").alias("n_shingles"), F.col("d.digests").alias("digest"), "slice", "place")
    rows = settle_table(rows, "rows")
    nodes = settle_table(rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("key").alias("least"), F.count("*").alias("copies"), F.min(F.struct("slice", "place")).alias("at")), "nodes")
    live = nodes.groupBy("at.slice").agg(F.collect_list(F.struct("at.place", "copies")).alias("live"))
    refs = settle_table(packed.select("slice", "path", "at", "size", "sizes").join(live, "slice"), "refs")
    total = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    spread = max(1, min(refs.count(), 4 * docs.sparkSession.sparkContext.defaultParallelism + total // (64 << 20)))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(spread, "slice")

    shared = settle_table(_shared_tokens(dealt(refs), max(1, total // BUCKET_BYTES)), "tokens")
    cands = _candidates(dealt(refs.join(shared, "slice")), percent)
    units = _units(cands, unit_bytes).join(cands.select("node", "copies", "shingles"), "node")
    found = settle_table(units.groupBy("lo", "hi").applyInArrow(lambda t: _met(t, percent), "a long, b long, n long"), "found")
    comps = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    own = nodes.select((F.shiftleft("at.slice", BITS) + F.col("at.place")).alias("node"), "digest", "least", "copies")
    own = settle_table(own.join(links, "node", "left").join(comps, "node", "left").select(
        "digest", "copies", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp")), "labelled")
    count = rows.count()
    ids = settle_table(own.groupBy("comp").agg(F.count("*").alias("in_comp"), F.min("least").alias("component_id")), "ids")
    own = join_counted(own, ids, "comp", "in_comp", count).select("digest", "copies", "n_links", "component_id")
    known = join_counted(rows, settle_table(own, "labelled"), "digest", "copies", count)
    return known.select(F.col("key").alias(key), "n_shingles", F.when(F.col("digest").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
                        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
