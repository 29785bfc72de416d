"""Benchmark decontamination by a positional inverted index of the training documents.

``build_index`` stores, for runs of documents (shards), every word's postings: sorted 64-bit
word hashes, counts, and positions. ``search`` looks up the windows of benchmark items: the
windows' rarest terms over the whole corpus lead, and the lists of the other terms, moved by
their offsets, are intersected from rare to frequent. It returns exact phrase matches and
proximity matches (the three rarest terms of a window near each other, in any order).

The index is partitioned by document, so no word, however frequent, gathers in one task. Items
are searched in groups of bounded size, so only a group is ever sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.llm.tokens import ALNUM, Slice, column, lists, ranges, slices, words
from gapweave.session import new_folder

WINDOW = 10
#: Words within which the rarest terms of a window count as near.
SLOP, NEAR_TERMS = 20, 3
#: Bytes of item text in one group: what is sent to tasks is a small multiple of it.
GROUP_BYTES = 4 << 20


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the index to the shared folder and read it back. One row is a shard: the keys of its
    documents, their word counts, and the postings. Null texts have no words; keys may repeat."""
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("n_words", T.ArrayType(T.LongType())),
        T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("postings", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = column(batch, key)
            for part in slices(column(batch, text)):
                w = words(part, ALNUM)
                order = np.argsort(w.hash, kind="stable").astype(np.uint32)
                sorted_ = w.hash[order]
                first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]][:len(sorted_)])
                counts = np.diff(np.r_[first, len(sorted_)]).astype(np.uint32)
                steps = np.diff(order, prepend=np.uint32(0))
                own = keys.slice(part.first, part.rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard], pa.int64()), pa.ListArray.from_arrays(pa.array([0, part.rows], pa.int32()), own),
                    lists(w.per_row, np.array([part.rows]), pa.int64()),
                    *[pa.array([x.tobytes()], pa.binary()) for x in (sorted_[first], counts, steps)]], schema.names)
                shard += 1

    spark = docs.sparkSession
    path = new_folder(spark, "postings")
    docs.select(key, text).mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _term_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each term in the corpus, from the terms and counts alone."""
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for terms, counts in zip(column(batch, "terms"), column(batch, "counts"), strict=True):
                terms, counts = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint32)
                at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
                hit = known[at] == terms
                total[at[hit]] += counts[hit]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    found = index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    sent.unpersist()
    return out


def _windows(texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: the item's number, and the hashes of its words (zero beyond a short one)."""
    data = [t.encode() for t in texts]
    part = Slice(0, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    w = words(part, ALNUM)
    n = w.per_row
    per_item = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
    item = np.repeat(np.arange(len(n)), per_item)
    start = ranges(w.bounds[:-1], per_item)
    size = np.minimum(n[item], window)
    grid = start[:, None] + np.arange(window)
    inside = np.arange(window) < size[:, None]
    return item, np.where(inside, w.hash[np.minimum(grid, max(len(w.hash) - 1, 0))] if len(w.hash) else 0, 0), size


def search(index: DataFrame, items: DataFrame, item_key: str = "item_id", text: str = "text", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Per indexed document: key, n_words, hits (item, from, to: maximal runs of words covered by
    windows of that item), near (items of which a window matches by proximity only or exactly).

    Items are taken in groups of at most about ``GROUP_BYTES``; a group is one pass over the index,
    and several groups are put together by document.
    """
    items = items.select(F.col(item_key).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    kind = items.schema["item"].dataType
    found = []
    for g in range(groups):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g) if groups > 1 else items
        found.append(_search_group(index, own.toArrow(), kind, window, slop))
    if groups == 1:
        return found[0].drop("shard", "place")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("shard", "place").agg(
        F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")).drop("shard", "place")


def _search_group(index: DataFrame, group: pa.Table, item_kind: T.DataType, window: int, slop: int) -> DataFrame:
    spark = index.sparkSession
    item, grams, size = _windows(group["text"].to_pylist(), window)
    names = group["item"].combine_chunks()
    vocabulary, inverse = np.unique(grams, return_inverse=True)
    inverse = inverse.reshape(grams.shape)
    if len(vocabulary) == 0:
        vocabulary = np.zeros(1, np.uint64)
    counts = _term_counts(index, vocabulary)
    # Offsets from the rarest term to the most frequent; places beyond a short window come last.
    weight = np.where(np.arange(window) < size[:, None], counts[inverse], np.iinfo(np.int64).max)
    offset = np.argsort(weight, axis=1, kind="stable").astype(np.int32)
    term = np.take_along_axis(inverse, offset, 1).astype(np.int64)
    lead = np.argsort(term[:, 0], kind="stable")
    by_term = np.searchsorted(term[lead, 0], np.arange(len(vocabulary) + 1))
    sent = spark.sparkContext.broadcast((vocabulary, lead, by_term, term, offset, size.astype(np.int64), item.astype(np.int64), names))
    hit_kind = T.ArrayType(T.StructType([T.StructField("item", item_kind), T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("place", T.LongType()),
        T.StructField("key", index.schema["keys"].dataType.elementType), T.StructField("n_words", T.LongType()),
        T.StructField("hits", hit_kind), T.StructField("near", T.ArrayType(item_kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = {n: column(batch, n)[at] for n in batch.schema.names}
                yield _search_shard(row, sent.value, slop, schema.names)

    return index.mapInArrow(run, schema)


def _search_shard(row, sent, slop: int, names_out: list[str]) -> pa.RecordBatch:
    vocabulary, lead, by_term, term, offset, size, item, names = sent
    terms, counts = (np.frombuffer(row[c].as_buffer(), t) for c, t in (("terms", np.uint64), ("counts", np.uint32)))
    postings = np.cumsum(np.frombuffer(row["postings"].as_buffer(), np.uint32), dtype=np.uint32).astype(np.int64)
    n_words = row["n_words"].values.to_numpy()
    bounds = np.r_[0, np.cumsum(n_words)]
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    known = vocabulary[at] == terms
    ends = np.cumsum(counts.astype(np.int64))
    # The postings of known terms alone, in term order; and which known term stands at each place.
    own_t, own_n = at[known], counts[known].astype(np.int64)
    places = postings[ranges(ends[known] - own_n, own_n)]
    of = np.repeat(own_t, own_n)
    standing = np.full(len(postings) + 1, -1, np.int64)
    standing[places] = of
    first = np.zeros(len(vocabulary) + 1, np.int64)
    first[own_t + 1] = own_n
    have = first[1:].copy()
    np.cumsum(first, out=first)
    # Windows led by a term of this shard, of which all terms occur in it.
    led = np.sort(lead[ranges(by_term[own_t], by_term[own_t + 1] - by_term[own_t])])
    near_led = led
    for k in range(1, term.shape[1]):
        led = led[(size[led] <= k) | (have[term[led, k]] > 0)]
        if k == min(NEAR_TERMS, term.shape[1]) - 1:
            near_led = led

    def spread(win):
        """Each window with each place of its rarest term."""
        n = have[term[win, 0]]
        return np.repeat(win, n), places[ranges(first[term[win, 0]], n)]

    win, lead_at = spread(led)
    doc = np.searchsorted(bounds, lead_at, "right") - 1
    start = lead_at - offset[win, 0]
    ok = (start >= bounds[doc]) & (start + size[win] <= bounds[doc + 1])
    win, start, doc = win[ok], start[ok], doc[ok]
    for k in range(1, term.shape[1]):
        # An offset-adjusted intersection: the k-th list, moved by its offset, holds this start.
        ok = (size[win] <= k) | (standing[np.minimum(start + offset[win, k], len(standing) - 1)] == term[win, k])
        win, start, doc = win[ok], start[ok], doc[ok]

    order = np.lexsort((start, item[win], doc))
    win, start, doc = win[order], start[order], doc[order]
    own = item[win]
    new = np.ones(len(win), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (start[1:] > start[:-1] + size[win[:-1]])
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(new)][:len(head)] - 1
    hit_doc = doc[head]
    hits = pa.StructArray.from_arrays(
        [names.take(pa.array(own[head])), pa.array(start[head] - bounds[hit_doc]), pa.array(start[tail] + size[win[tail]] - bounds[hit_doc])],
        ["item", "from", "to"])
    n_docs = len(n_words)

    # Proximity: the next rarest terms within ``slop`` words of the rarest, in the same document.
    nwin, nat = spread(near_led)
    ndoc = np.searchsorted(bounds, nat, "right") - 1
    line = of << 32 | places
    for k in range(1, min(NEAR_TERMS, term.shape[1])):
        wanted = term[nwin, k] << 32 | nat
        j = np.searchsorted(line, wanted)
        close = size[nwin] <= k
        for side in (j - 1, j):
            side_at = np.clip(side, 0, max(len(line) - 1, 0))
            if len(line):
                close |= (of[side_at] == term[nwin, k]) & (np.abs(places[side_at] - nat) <= slop) & (places[side_at] >= bounds[ndoc]) & (places[side_at] < bounds[ndoc + 1])
        nwin, nat, ndoc = nwin[close], nat[close], ndoc[close]
    pairs = np.unique(np.stack([ndoc, item[nwin]]), axis=1) if len(nwin) else np.zeros((2, 0), np.int64)

    def listed(values, of_doc):
        offsets = np.searchsorted(of_doc, np.arange(n_docs + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n_docs, row["shard"].as_py()), pa.int64()), pa.array(np.arange(n_docs), pa.int64()), row["keys"].values, pa.array(n_words),
        listed(hits, hit_doc), listed(names.take(pa.array(pairs[1])), pairs[0])], names_out)


def covered(hits: str = "hits"):
    """Words covered by the runs of any item."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["from"].alias("a"), h["to"].alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    return F.aggregate(spans, start, lambda s, h: F.struct(
        (s["n"] + F.greatest(F.lit(0).cast("long"), h["b"] - F.greatest(h["a"], s["upto"]))).alias("n"), F.greatest(h["b"], s["upto"]).alias("upto")))["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated, n_near of every row of ``docs``."""
    found = search(build_index(docs, key), benchmark)
    ids = F.array_distinct(F.transform("hits", lambda h: F.coalesce(h["item"].cast("string"), F.lit(""))))
    return found.select(
        F.col("key").alias(key), "n_words", covered().alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark window; rows are told apart by doc_id and text."""
    mark = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text"))
    own = docs.select(F.struct("*").alias("row"), mark.alias("id"), "text")
    hit = search(build_index(own, "id"), benchmark).where(F.size("hits") > 0).select(F.col("key").alias("id")).distinct()
    return own.join(hit, "id", "left_anti").select("row.*")
