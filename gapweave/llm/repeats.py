"""Removal of long repeated byte strings by a distributed difference-cover suffix sort.

A byte goes if a string of ``LENGTH`` bytes around it also starts in a document with a smaller id.
Positions i with i mod 7 in {1, 2, 4} are the sample: for any two positions some shift below 7 takes both
into the sample. Sampled suffixes are dealt into buckets so that equal strings of LENGTH bytes meet and, in each
bucket, sorted by triples of characters that are themselves named by sorting triples of machine words;
equal neighbours in that order share 44 bytes. The remaining suffixes are merged through the sample: the
string that starts d bytes before a sampled suffix is its d bytes before, its name, and 6 - d bytes after. So
comparing neighbours of the sample for every d compares all suffixes.

For LENGTH bytes this finds what one order of all suffixes would: equal neighbours there share their first LENGTH bytes, hence the
bucket, and names that cover 44 bytes need one level of recursion (triples of triples of words).

Two lossless reductions come first. A copy of a whole text in a document with a smaller id goes as a
whole. And of the others only strings are sorted whose minimizer (the least hash of the 24-byte strings
in them, equal for equal strings) occurs in two documents. The minimizer also decides the bucket, so what is sent are stretches of text
that share one, and suffixes are made of them where they are sorted. Within a slice, equal stretches meet
before they are sent, so a passage in a third of all documents reaches its bucket once per slice.

Slices of text are kept in files of the shared folder, written under names of their attempt and listed in a
table that Spark commits; what meets by join is a few numbers per slice. Ids are integers; a null
id counts as the smallest. A null text is empty. Rows equal in id are the same document to each other.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.files import opened
from gapweave.llm.tokens import M1, column, mix, ranges, slices
from gapweave.session import new_folder, settle_table

LENGTH = 50
PERIOD, COVER = 7, (1, 2, 4)
DEPTH = LENGTH - PERIOD + 1
GRAM = 24
#: Bytes of a slice; bytes of text per bucket of minimizers, and per bucket of suffixes that are sorted together.
SLICE_BYTES, BUCKET_BYTES, SORTED_BYTES = 2 << 20, 8 << 20, 1 << 20
MISSING = -(1 << 63)


def pack(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Write the texts in slices; a row per slice: where it is, and ids, sizes and digests of its
    documents."""
    folder = new_folder(docs.sparkSession, "slices")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part}-{uuid.uuid4().hex}"
        coder, at, made, out = zstandard.ZstdCompressor(level=3), 0, [], None
        for batch in batches:
            ids = column(batch, "id").to_numpy()
            for s in slices(column(batch, "text"), SLICE_BYTES):
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                packed = coder.compress(s.data.tobytes())
                out.write(packed)
                raw = s.data.tobytes()
                digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)]
                made.append(((part << 32) + len(made), f"{folder}/{name}", at, len(packed), ids[s.first:s.first + s.rows].tolist(), np.diff(s.offsets).tolist(), digests))
                at += len(packed)
        if out:
            out.close()
        for m in made:  # only when the file is complete
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(m, kinds, strict=True)], names)

    names = ["slice", "path", "at", "packed", "ids", "sizes", "digests"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(MISSING)).alias("id"), F.col(text).alias("text"))
    return settle_table(rows.mapInArrow(run, "slice long, path string, at long, packed long, ids array<long>, sizes array<long>, digests array<binary>"), "slices")


def _load(path: str, at: int, packed: int) -> np.ndarray:
    fs, name = opened(path)
    with fs.open_input_file(name) as f:
        f.seek(at)
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(f.read(packed)), np.uint8)


def _copies(packed: DataFrame) -> DataFrame:
    """(slice, copies: places of documents whose whole text is in a document with a smaller id)."""
    own = packed.select("slice", F.posexplode(F.arrays_zip("ids", "sizes", "digests")).alias("place", "d")).select("slice", "place", "d.*").where(F.col("sizes") >= LENGTH)
    least = own.groupBy("digests").agg(F.min("ids").alias("least"), F.max("ids").alias("most")).where("least < most").select("digests", "least")
    return own.join(least, "digests").where("ids > least").groupBy("slice").agg(F.collect_list("place").alias("copies"))


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a big-endian number's bytes; zeros beyond the end."""
    padded = np.zeros(len(data) + 64, np.uint8)
    padded[:len(data)] = data
    return np.ndarray((len(data) + 56,), np.dtype(">u8"), padded.data, 0, (1,))


def _starts(row: dict, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the slice: the end of its document, or 0 if a whole copy; and its begin."""
    sizes = np.array(row["sizes"], np.int64)
    ends = np.cumsum(sizes)
    live = np.ones(len(sizes), bool)
    live[np.array(row["copies"] or [], np.int64)] = False
    return np.repeat(np.where(live, ends, 0), sizes), np.repeat(ends - sizes, sizes)


def _minimizers(data: np.ndarray) -> np.ndarray:
    """For each place, the least hash of the GRAM-byte strings within the LENGTH bytes from it on (48
    bits). Places near the end of the slice are short of bytes and must not be used."""
    eight = _words_at(data).astype(np.uint64)
    n = len(data)
    h = mix((eight[:n] * M1) ^ mix(eight[8:n + 8] * M1 + M1) ^ (mix(eight[16:n + 16] + M1) * M1)) >> np.uint64(16)
    want, have = LENGTH - GRAM + 1, 1
    h = np.r_[h, np.full(want, np.iinfo(np.uint64).max, np.uint64)]
    while have < want:
        step = min(have, want - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h[:n]


def _shared_minimizers(listed: DataFrame, buckets: int) -> DataFrame:
    """(slice, shared: sorted minimizers of it that occur in two documents of the corpus)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = _load(row["path"], row["at"], row["packed"])
                end, begin = _starts(row, data)
                ok = np.arange(len(data)) + LENGTH <= end
                h, doc = _minimizers(data)[ok], begin[ok]
                new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][:len(h)]
                h, doc = h[new], doc[new]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                first = np.r_[True, h[1:] != h[:-1]][:len(h)]
                at = np.flatnonzero(first)
                last = np.r_[at[1:], len(h)][:len(at)] - 1
                twice = doc[at] != doc[last]
                h = h[at]
                bucket = (h * np.uint64(buckets)) >> np.uint64(48) if buckets < 1 << 16 else h % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cut)):
                    own = order[cut[b]:cut[b + 1]]
                    six = h[own].view(np.uint8).reshape(-1, 8)[:, :6]
                    yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int64()), pa.array([row["slice"]], pa.int64()), pa.array([six.tobytes()], pa.binary()),
                                                      pa.array([np.packbits(twice[own]).tobytes()], pa.binary())], ["bucket", "slice", "h", "twice"])

    def meet(table: pa.Table) -> pa.Table:
        hs = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 6) for x in table["h"]]
        n = np.array([len(x) for x in hs])
        wide = np.zeros((n.sum(), 8), np.uint8)
        wide[:, :6] = np.concatenate(hs)
        h = wide.view(np.uint64).ravel()
        twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=k) for x, k in zip(table["twice"], n, strict=True)])
        own = np.repeat(np.arange(len(n)), n)
        order = np.argsort(h, kind="stable")
        at = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        size = np.diff(np.r_[at, len(h)])
        many = (size > 1) | (np.add.reduceat(twice[order].astype(np.int64), at) > 0)
        keep = order[np.repeat(many, size)]
        keep = keep[np.argsort(own[keep], kind="stable")]
        cut = np.searchsorted(own[keep], np.arange(len(n) + 1))
        some = np.flatnonzero(np.diff(cut))
        ids = table["slice"].to_numpy()
        return pa.table({"slice": pa.array(ids[some], pa.int64()), "h": pa.array([h[keep[cut[i]:cut[i + 1]]].tobytes() for i in some], pa.binary())})

    sent = listed.mapInArrow(emit, "bucket long, slice long, h binary, twice binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "slice long, h binary")
    return met.groupBy("slice").agg(F.collect_list("h").alias("shared"))


def _segments(listed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, slice, entries): stretches of starts that share one minimizer, by bucket of the minimizer. Entries hold, for
    each stretch, id, place of its first start, number of starts, and the bytes from there to the end of the last string. A stretch whose very bytes are also
    in a smaller document of the slice is found already: it goes without bytes, in a bucket of the slice's own (below 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row in batch.to_pylist():
                if not row["shared"]:
                    continue
                data = _load(row["path"], row["at"], row["packed"])
                n = len(data)
                end, begin = _starts(row, data)
                shared = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in row["shared"]]))
                h = _minimizers(data)
                new = np.r_[True, (h[1:] != h[:-1]) | (begin[1:] != begin[:-1])]
                first = np.flatnonzero(new)
                at = np.minimum(np.searchsorted(shared, h[first]), len(shared) - 1)
                last = np.minimum(np.r_[first[1:], n], end[first] - LENGTH + 1)  # behind the last start
                some = np.flatnonzero((shared[at] == h[first]) & (last > first))
                first, count = first[some], (last - first)[some]
                if not len(first):
                    continue
                own = np.repeat(np.array(row["ids"], np.int64), np.array(row["sizes"], np.int64))[first]
                raw = data.tobytes()
                texts = [raw[a:a + k] for a, k in zip(first.tolist(), (count + LENGTH - 1).tolist(), strict=True)]
                least: dict[bytes, int] = {}
                for t, i in zip(texts, own.tolist(), strict=True):
                    if (was := least.get(t)) is None or i < was:
                        least[t] = i
                found = own > np.fromiter((least[t] for t in texts), np.int64, len(texts))
                if found.any():
                    yield _piece(coder, -1 - row["slice"], row["slice"], own[found], first[found], count[found], [])
                keep = np.flatnonzero(~found)
                to = (mix(h[first[keep]]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(to[order]) > 0])
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
                    i = keep[order[a:b]]
                    yield _piece(coder, int(to[order[a]]), row["slice"], own[i], first[i], count[i], [texts[k] for k in i.tolist()])

    return listed.mapInArrow(run, "bucket long, slice long, entries binary")


def _piece(coder, bucket: int, slice_: int, own: np.ndarray, first: np.ndarray, count: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    blob = b"".join([np.int64(len(own)).tobytes(), own.tobytes(), first.astype(np.uint32).tobytes(), count.astype(np.uint32).tobytes(), *texts])
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([slice_], pa.int64()), pa.array([coder.compress(blob)], pa.binary())], ["bucket", "slice", "entries"])


def _unpiece(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint32, n, 8 + 8 * n).astype(np.int64), np.frombuffer(raw, np.uint32, n, 8 + 12 * n).astype(np.int64), raw[8 + 16 * n:]


def _sampled(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled suffixes of all stretches: the 56 bytes from six before it on as words, id, place, valid shifts, and part. A shift d is valid if the
    string that begins d bytes before is among the stretch's; bytes that no valid shift uses may be anything."""
    pad = PERIOD - 1
    own, first, count = (np.concatenate([p[k] for p in parts]) for k in range(3))
    size = count + LENGTH - 1
    begin = np.cumsum(size + 2 * pad) - (size + 2 * pad) + pad
    data = np.zeros(int((size + 2 * pad).sum()) + 64, np.uint8)
    data[ranges(begin, size)] = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    # Of each stretch, all places from the first start to six behind the last one.
    reach = count + pad
    which, off = np.repeat(np.arange(len(own)), reach), ranges(np.zeros(len(own), np.int64), reach)
    take = np.isin((first[which] + off) % PERIOD, COVER)
    which, off = which[take], off[take]
    bits = np.zeros(len(which), np.uint8)
    for d in range(PERIOD):
        bits |= ((off >= d) & (off - d < count[which])).astype(np.uint8) << np.uint8(d)
    eight = _words_at(data)
    at = begin[which] + off - pad
    x = np.stack([eight[at + 8 * k] for k in range(7)], axis=1).astype(np.uint64)
    part = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    return x, own[which], (first[which] + off).astype(np.uint32), bits, part[which]


def _depth_words(x: np.ndarray) -> np.ndarray:
    """The DEPTH bytes from the suffix on, as six words: the last holds four bytes."""
    w = np.stack([(x[:, k] << np.uint64(48)) | (x[:, k + 1] >> np.uint64(16)) for k in range(6)], axis=1)
    w[:, 5] &= np.uint64(0xFFFFFFFF00000000)
    return w


def _names(rows: np.ndarray) -> np.ndarray:
    """Rank of each row among the distinct rows, in order: rows are sorted by one column after another, and ranks so far
    go before the ranks of the next column."""

    def ranked(v: np.ndarray) -> np.ndarray:
        order = np.argsort(v)
        out = np.empty(len(v), np.uint64)
        out[order] = np.cumsum(np.r_[False, v[order[1:]] != v[order[:-1]]])
        return out

    name = ranked(rows[:, 0])
    for k in range(1, rows.shape[1]):
        name = ranked(name << np.uint64(32) | ranked(rows[:, k]))
    return name


def _bucket_task(table: pa.Table) -> pa.Table:
    if table["bucket"][0].as_py() >= 0:
        return _sorted_bucket(table)
    blobs = []
    for entries in table["entries"]:
        _, first, count, _ = _unpiece(zstandard.ZstdDecompressor().decompress(entries.as_buffer()))
        place = ranges(first, count).astype(np.uint32)
        blobs.append(place.tobytes() + np.ones(len(place), np.uint8).tobytes())
    return pa.table({"slice": table["slice"], "finds": pa.array(blobs, pa.binary())})


def _sorted_bucket(table: pa.Table) -> pa.Table:
    """One bucket: sort and name its sampled suffixes, then compare neighbours for every shift. A name that only one suffix has
    has no equal neighbour for any shift."""
    reader = zstandard.ZstdDecompressor()
    x, own, place, bits, of = _sampled([_unpiece(reader.decompress(blob.as_buffer())) for blob in table["entries"]])
    w = _depth_words(x)
    # Triples of words are named by sorting, then the suffixes by their triples' names.
    half = _names(np.concatenate([w[:, :3], w[:, 3:]]))
    name = _names(np.stack([half[:len(w)], half[len(w):]], axis=1))
    del w, half
    several = np.bincount(name.astype(np.int64)) > 1
    keep = np.flatnonzero(several[name.astype(np.int64)])
    # Documents in order, so that a stable sort puts the smallest id of equals first.
    keep = keep[np.argsort(own[keep], kind="stable")]
    before = x[keep, 0] >> np.uint64(16)                          # the six bytes before
    after = x[keep, 6] & np.uint64(0xFFFFFFFFFFFF)                # the six from DEPTH on
    name = (np.cumsum(several) - 1)[name[keep].astype(np.int64)].astype(np.uint64)
    own, place, bits, of = own[keep], place[keep], bits[keep], of[keep]
    packed = int(name.max(initial=0)) < 1 << 16
    found = np.zeros(len(name), np.uint8)
    for d in range(PERIOD):
        valid = np.flatnonzero(bits >> np.uint8(d) & np.uint8(1))
        if not len(valid):
            continue
        left = before[valid] & np.uint64((1 << 8 * d) - 1)       # its last d bytes
        right = after[valid] >> np.uint64(8 * d)                 # its first 6 - d bytes
        around = left << np.uint64(8 * (PERIOD - 1 - d)) | right
        # Name and 48 bits around it, in one number where they fit.
        key = name[valid] << np.uint64(48) | around if packed else _names(np.stack([name[valid], around], axis=1))
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.r_[True, key[order[1:]] != key[order[:-1]]])
        order = valid[order]
        least = np.repeat(own[order[head]], np.diff(np.r_[head, len(order)]))
        found[order[own[order] > least]] |= np.uint8(1 << d)
    hit = np.flatnonzero(found)
    hit = hit[np.argsort(of[hit], kind="stable")]
    cut = np.searchsorted(of[hit], np.arange(table.num_rows + 1))
    some = np.flatnonzero(np.diff(cut))
    ids = table["slice"].to_numpy()
    blobs = [place[hit[cut[i]:cut[i + 1]]].tobytes() + found[hit[cut[i]:cut[i + 1]]].tobytes() for i in some]
    return pa.table({"slice": pa.array(ids[some], pa.int64()), "finds": pa.array(blobs, pa.binary())})


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", kept: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``kept``, also ``spans`` (from,
    to) of the removed runs."""
    packed = pack(docs, key, text)
    total = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    refs = packed.select("slice", "path", "at", "packed", "ids", "sizes").join(_copies(packed), "slice", "left")
    refs = settle_table(refs, "slice-refs")
    # A slice is work for a task of its own: a few numbers decide where it is read.
    spread = max(1, min(refs.count(), 4 * docs.sparkSession.sparkContext.defaultParallelism + total // (64 << 20)))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(spread, "slice")

    shared = settle_table(_shared_minimizers(dealt(refs), max(1, total // BUCKET_BYTES)), "minimizers")
    sent = _segments(dealt(refs.join(shared, "slice")), max(1, total // SORTED_BYTES))
    finds = settle_table(sent.groupBy("bucket").applyInArrow(_bucket_task, "slice long, finds binary"), "finds")
    by_slice = finds.groupBy("slice").agg(F.collect_list("finds").alias("finds"))
    whole = dealt(refs.join(by_slice, "slice", "left"))
    extra = ", spans array<struct<`from`:bigint,`to`:bigint>>" if kept else ""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = _load(row["path"], row["at"], row["packed"])
                cover = np.zeros(len(data) + 1, np.int32)
                for raw in row["finds"] or []:
                    n = len(raw) // 5
                    place, bits = np.frombuffer(raw, np.uint32, n).astype(np.int64), np.frombuffer(raw, np.uint8, n, 4 * n)
                    for d in range(PERIOD):
                        at = place[bits >> np.uint8(d) & np.uint8(1) > 0] - d
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + LENGTH, -1)
                gone = np.cumsum(cover)[:-1] > 0
                sizes = np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                for c in row["copies"] or []:
                    gone[begins[c]:ends[c]] = True
                out = []
                for i, a, b in zip(row["ids"], begins.tolist(), ends.tolist(), strict=True):
                    g = gone[a:b]
                    edge = np.diff(np.r_[False, g, False].astype(np.int8))
                    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    rest = data[a:b][~g] if len(first) else data[a:b]
                    out.append((None if i == MISSING else i, b - a, int((last - first).sum()), len(first), hashlib.sha256(rest.tobytes()).hexdigest(),
                                *([[{"from": f, "to": t} for f, t in zip(first.tolist(), last.tolist(), strict=True)]] if kept else [])))
                if out:
                    cols = list(zip(*out, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"][:len(cols)])

    out = whole.mapInArrow(run, f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}")
    return out.select(F.col("id").cast(kind).alias(key), *out.columns[1:])
