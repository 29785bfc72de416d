"""Language-model scores by masked pseudo-likelihood.

A token is a word of the corpus's most frequent ones, or a class of rarer words by hash. A small network
sees the ``REACH`` tokens on either side of a place and predicts the token there. The probability of a rarer
word is that of its class times the word's share of the class, by its count in the whole corpus; words not
in the corpus have together the share that one occurrence more would have. A document's score
is the sum of the logarithms of these conditional probabilities over all of its words.

All words of all documents are counted, in a table that is never gathered. The tokens of all documents are written once, in shards that
depend on the texts alone. In each round every shard starts from the same weights, goes through all of its tokens, and returns
its weights; their mean, weighted by tokens and summed in a tree, begins the next round. So
what is learned from, counted and moved grows with the corpus; no more than a few sets of weights reach the driver.

A null or empty text has no tokens: log_prob 0 and a null mean. Equal texts score alike, in repeated rows as well; an empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.llm.tokens import ALNUM, column, mix, slices, words
from gapweave.session import settle_table

#: A token's id is (high, low) digit in base SIDE; the network predicts high, then low given high.
SIDE, HIDDEN, REACH = 32, 16, 2
TOKENS, KNOWN = SIDE * SIDE, 3 * SIDE * SIDE // 4
OFFSETS = [*range(-REACH, 0), *range(1, REACH + 1)]
ROUNDS, BATCH, RATE = 2, 8192, 0.005
#: Tokens of a shard, and bytes of ids handled at once.
SHARD, TOGETHER = 1 << 22, 1 << 19
#: Sets of weights summed by one task of the tree, and at most on the driver.
FAN = 16
#: Logarithms of counts are added up as whole numbers of this part.
UNITS = 10**9

Weights = dict[str, np.ndarray]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word: hash, n) of every word of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(column(batch, text)):
                h, n = np.unique(words(part, ALNUM).hash, return_counts=True)
                both = np.concatenate([held_h, h])
                held_h, inverse = np.unique(both, return_inverse=True)
                held_n = np.bincount(inverse, np.concatenate([held_n, n]), len(held_h)).astype(np.int64)
                if len(held_h) > 1 << 19:
                    yield pa.RecordBatch.from_arrays([pa.array(held_h.view(np.int64)), pa.array(held_n)], ["word", "n"])
                    held_h, held_n = held_h[:0], held_n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held_h.view(np.int64)), pa.array(held_n)], ["word", "n"])

    return docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame) -> np.ndarray:
    """Sorted hashes of the most frequent words; ties go to the smaller hash."""
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN)
    return np.sort(np.array([r["word"] for r in top.collect()], np.int64).view(np.uint64))


def vocabulary(docs: DataFrame, text: str = "text") -> np.ndarray:
    return frequent(word_counts(docs, text))


def class_counts(counts: DataFrame, known: np.ndarray) -> np.ndarray:
    """Occurrences of the words of each class."""
    rows = counts.groupBy(F.pmod("word", F.lit(TOKENS - KNOWN)).cast("int").alias("c")).agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TOKENS - KNOWN, np.int64)
    out[[r["c"] for r in rows]] = [r["n"] for r in rows]
    for r in counts.where(F.col("word").isin(known.view(np.int64).tolist())).collect():
        out[r["word"] % (TOKENS - KNOWN)] -= r["n"]
    return out


def ids_of(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Token of each word: its place among the known ones, else a class from its hash."""
    other = KNOWN + (hashes % np.uint64(TOKENS - KNOWN)).astype(np.int64)
    if not len(known):
        return other
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, other)


def token_table(docs: DataFrame, text: str, known: np.ndarray) -> DataFrame:
    """(ids: two bytes a token) of every document that has any, written once. Documents are dealt by a hash of their ids into shards of about
    SHARD tokens, each in order, so what a shard trains on depends on the texts alone."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(column(batch, text)):
                found = words(part, ALNUM)
                ids = ids_of(found.hash, sent.value).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), part.rows, [None, pa.py_buffer((found.bounds * 2).astype(np.int32)), pa.py_buffer(ids)])], ["ids"])

    rows = settle_table(docs.select(text).mapInArrow(run, "ids binary").where(F.octet_length("ids") > 0), "tokens")
    total = rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    shards = max(1, -(-total // (2 * SHARD)))
    # A shard is one file of one row group, so a task always reads it whole.
    return settle_table(rows.repartition(shards, F.xxhash64("ids")).sortWithinPartitions("ids").select(F.spark_partition_id().alias("shard"), "ids"), "shards")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, ids, bounds) of some documents of one shard at a time."""
    for batch in batches:
        shard, col = column(batch, "shard").to_numpy(), column(batch, "ids").cast(pa.large_binary())
        offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        raw, at = col.buffers()[2], 0
        while at < len(col):
            to = min(int(np.searchsorted(offsets, offsets[at] + TOGETHER, "right")) - 1, int(np.searchsorted(shard, shard[at], "right")))
            to = max(to, at + 1)
            yield int(shard[at]), np.frombuffer(raw, np.uint16, (offsets[to] - offsets[at]) // 2, offsets[at]).astype(np.int64), (offsets[at:to + 1] - offsets[at]) // 2
            at = to


def beginning(seed: int = 3) -> Weights:
    rng = np.random.Generator(np.random.PCG64(seed))

    def start(*shape):
        return (rng.standard_normal(shape) * 0.1).astype(np.float32)

    # One more token, TOKENS, stands beyond either end of a document.
    return {"around": start(len(OFFSETS), TOKENS + 1, HIDDEN), "hidden": np.zeros(HIDDEN, np.float32), "high": start(SIDE, HIDDEN), "high_bias": np.zeros(SIDE, np.float32),
            "low": start(SIDE, HIDDEN), "low_bias": np.zeros((SIDE, SIDE), np.float32)}


def neighbours(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(places, 2 REACH) tokens around each place; TOKENS beyond the document."""
    n = len(ids)
    place = np.arange(n)
    first, last = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
    out = np.empty((n, len(OFFSETS)), np.int64)
    for k, o in enumerate(OFFSETS):
        at = place + o
        inside = (at >= first) & (at < last)
        out[:, k] = np.where(inside, ids[np.clip(at, 0, max(n - 1, 0))], TOKENS)
    return out


def _forward(w: Weights, around: np.ndarray, ids: np.ndarray):
    """Log-probability of each token, and what training needs. Softmax sums need no shift: hidden
    units are within (-1, 1) and weights are kept within bounds."""
    h = w["around"][0].take(around[:, 0], axis=0)
    for k in range(1, len(OFFSETS)):
        h += w["around"][k].take(around[:, k], axis=0)
    h += w["hidden"]
    h /= 1 + np.abs(h)
    high, low = ids // SIDE, ids % SIDE
    place = np.arange(len(ids))
    a = w["high"] @ h.T
    a += w["high_bias"][:, None]
    b = w["low"] @ h.T
    b += w["low_bias"].T.take(high, axis=1)
    log_p = a[high, place] + b[low, place]
    np.exp(a, out=a)
    np.exp(b, out=b)
    sa, sb = a.sum(axis=0), b.sum(axis=0)
    log_p -= np.log(sa) + np.log(sb)
    return log_p, h, a, b, sa, sb, high, low


def _sum_rows(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by number."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    sorted_ = at[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[sorted_[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def _gradients(w: Weights, around: np.ndarray, ids: np.ndarray) -> Weights:
    _, h, a, b, sa, sb, high, low = _forward(w, around, ids)
    place, n = np.arange(len(ids)), np.float32(len(ids))
    a /= sa
    b /= sb
    a[high, place] -= 1
    b[low, place] -= 1
    a /= n
    b /= n
    dh = (a.T @ w["high"] + b.T @ w["low"]) * (1 - np.abs(h)) ** 2
    return {"around": np.stack([_sum_rows(dh, around[:, k], TOKENS + 1) for k in range(len(OFFSETS))]), "hidden": dh.sum(axis=0), "high": a @ h, "high_bias": a.sum(axis=1),
            "low": b @ h, "low_bias": _sum_rows(np.ascontiguousarray(b.T), high, SIDE)}


def _pack(w: Weights) -> bytes:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float32).tobytes()


def _unpack(flat: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, v in sorted(beginning().items()):
        out[k] = flat[at:at + v.size].astype(np.float32).reshape(v.shape)
        at += v.size
    return out


def _round(tokens: DataFrame, weights: Weights) -> Weights:
    """One pass over the documents of each shard, from the same weights, and the mean of what the shards have learned."""
    sc = tokens.sparkSession.sparkContext
    sent = sc.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = total = step = 0
        w = first = second = {}
        for shard, ids, bounds in _runs(batches):
            if not total or shard != part:
                if total:
                    yield _row(part, float(total), np.frombuffer(_pack(w), np.float32))
                part, total, step = shard, 0, 0
                w = {k: v.copy() for k, v in sent.value.items()}
                first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
            around = neighbours(ids, bounds)
            total += len(ids)
            for at in range(0, len(ids), BATCH):
                step += 1
                rate = RATE * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                for k, g in _gradients(w, around[at:at + BATCH], ids[at:at + BATCH]).items():
                    first[k] += np.float32(0.1) * (g - first[k])
                    second[k] += np.float32(0.001) * (g * g - second[k])
                    w[k] -= np.float32(rate) * first[k] / (np.sqrt(second[k]) + np.float32(1e-8))
                    np.clip(w[k], -4, 4, out=w[k])
        if total:
            yield _row(part, float(total), np.frombuffer(_pack(w), np.float32))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, w, part = 0.0, None, None
        for batch in batches:
            for p, m, v in zip(column(batch, "part").to_pylist(), column(batch, "n").to_pylist(), column(batch, "w"), strict=True):
                v = np.frombuffer(v.as_buffer(), np.float32) * m
                n, w, part = n + m, v if w is None else w + v, p if part is None else min(p, part)
        if w is not None:
            yield _row(part, n, w / n)

    schema = "part long, n double, w binary"
    count, rows = (tokens.agg(F.max("shard")).first()[0] or 0) + 1, tokens.mapInArrow(run, schema)
    while count > FAN:
        count = -(-count // FAN)
        rows = rows.repartition(count, "part").sortWithinPartitions("part").mapInArrow(add, schema)
    parts = sorted(rows.collect(), key=lambda r: r["part"])
    sent.unpersist()
    if not parts:
        return weights
    return _unpack(np.sum([np.frombuffer(r["w"], np.float32) * r["n"] for r in parts], axis=0) / sum(r["n"] for r in parts))


def _row(part: int, n: float, w: np.ndarray) -> pa.RecordBatch:
    """Mean weights of ``n`` tokens, half as long as their sum would be."""
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n]), pa.array([w.astype(np.float32).tobytes()], pa.binary())], ["part", "n", "w"])


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple[np.ndarray, Weights, DataFrame]:
    """Known words, weights, and the counts of all words."""
    counts = settle_table(word_counts(docs, text), "words")
    known, weights = frequent(counts), beginning()
    tokens = token_table(docs, text, known)
    for _ in range(rounds):
        weights = _round(tokens, weights)
    return known, weights, counts


def _totals(w: Weights, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the logarithms over each document's tokens."""
    around = neighbours(ids, bounds)
    log_p = np.concatenate([np.zeros(0), *[_forward(w, around[at:at + BATCH], ids[at:at + BATCH])[0].astype(np.float64) for at in range(0, len(ids), BATCH)]])
    upto = np.r_[0.0, np.cumsum(log_p)]
    return upto[bounds[1:]] - upto[bounds[:-1]]


def score(docs: DataFrame, model: tuple, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, log_prob (sum over tokens), mean_log_prob of every row. ``model`` is known words and
    weights, for scores of tokens, and the counts of all words, for scores of the words themselves."""
    if len(model) > 2:
        return _word_scores(docs, *model, key, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = sent.value
        for batch in batches:
            for part in slices(column(batch, text)):
                found = words(part, ALNUM)
                total, n = _totals(w, ids_of(found.hash, known), found.bounds), found.per_row
                mean = pa.array(np.round(total / np.maximum(n, 1), 6), mask=n == 0)
                yield pa.RecordBatch.from_arrays([column(batch, key).slice(part.first, part.rows), pa.array(n, pa.int64()), pa.array(np.round(total, 4)), mean], [key, "n_tokens", "log_prob", "mean_log_prob"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, log_prob double, mean_log_prob double")


def _word_scores(docs: DataFrame, known: np.ndarray, weights: Weights, counts: DataFrame, key: str, text: str) -> DataFrame:
    """A share is the word's count over that of its class: the class's part is added where the document
    is read, the word's by a join with the counts, once for each rarer word of a document."""
    sent = docs.sparkSession.sparkContext.broadcast((known, weights, np.log(class_counts(counts, known) + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_known, w, of_class = sent.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(column(batch, text)):
                found = words(part, ALNUM)
                ids, n = ids_of(found.hash, words_known), found.per_row
                rare = np.flatnonzero(ids >= KNOWN)
                at = np.repeat(np.arange(part.rows), n)[rare]
                less = np.bincount(at, of_class[ids[rare] - KNOWN], part.rows)
                # One row for each document, under a word of no count; then its words.
                order = np.lexsort((found.hash[rare], at))
                at, word = at[order], found.hash[rare][order]
                new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (word[1:] != word[:-1])][:len(at)])
                times = np.diff(np.r_[new, len(at)])
                own, other = np.arange(part.rows), np.ones(part.rows + len(new), bool)
                other[:part.rows] = False
                keys = column(batch, key).slice(part.first, part.rows).take(pa.array(np.r_[own, np.zeros(len(new), np.int64)], mask=other))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.r_[own, at[new]]), pa.array(np.r_[mix((row + own).astype(np.uint64)), word[new]].view(np.int64)), pa.array(np.r_[np.zeros_like(own), times]), keys,
                    pa.array(np.r_[n, np.zeros(len(new), np.int64)], pa.int64(), mask=other), pa.array(np.r_[_totals(w, ids, found.bounds) - less, np.zeros(len(new))], mask=other)],
                    ["row", "word", "times", "key", "n_tokens", "total"])
                row += part.rows

    rows = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"row long, word long, times long, key {docs.schema[key].dataType.simpleString()}, n_tokens long, total double")
    # Sums of whole numbers don't depend on their order. Words met once add nothing.
    logs = counts.where("n > 1").select("word", F.round(F.log("n") * UNITS).cast("long").alias("log"))
    sums = rows.join(logs, "word", "left").groupBy("row").agg(
        F.first("key", True).alias(key), F.max("n_tokens").alias("n_tokens"), F.max("total").alias("total"), F.sum(F.col("times") * F.coalesce("log", F.lit(0))).alias("more"))
    total = F.col("total") + F.col("more") / UNITS
    return sums.select(F.col(f"`{key}`"), "n_tokens", F.round(total, 4).alias("log_prob"), F.when(F.col("n_tokens") > 0, F.round(total / F.col("n_tokens"), 6)).alias("mean_log_prob"))
