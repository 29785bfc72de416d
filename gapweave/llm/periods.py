"""Maximal periodic stretches of words (runs) by uniting suffix classes in the order of falling LCP.

Suffixes of a text's word sequence are sorted; neighbours in that order are united from the longest common
prefix (LCP) down, each class being an ordered set of positions. When two positions become neighbours in
a set at LCP l and lie p <= l apart, the words from the first on have period p over p + l words. The
first position of a run and the one a period later become neighbours in just this way, so every run is found.

Before that, what cannot be in a run is put aside: a run asked for repeats some GRAM words after
one period, so only stretches of such repeated grams are sorted, and only those whose nearest repetition is near
enough. No text without such a stretch costs more than one sort of its grams.

A null or empty text has no words and no runs. Rows are read one by one, whatever their key: repeated rows give
repeated results, and columns of any name pass through ``find``. A very long text is held whole by one task,
some hundred bytes a word. Ties between runs go to the smallest start, then the smallest period.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gapweave.llm.tokens import M1, SPACE, Slice, Words, column, mix, ranges, shingle_hash, slices, words


@dataclass(frozen=True)
class Rule:
    """Runs have at least ``copies`` periods and ``words`` words."""

    copies: int = 4
    words: int = 6

    @property
    def gram(self) -> int:
        """The least LCP of two positions that are one period apart at the start of a run."""
        return max(1, min(max(self.words - q, (self.copies - 1) * q) for q in range(1, self.words + 1)))


RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def _stretches(h: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """[from, to) of the words in which runs may lie: covered by grams that occur again in their row near enough."""
    gram, n = rule.gram, len(h)
    none = np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    g = shingle_hash(h, gram)
    at = np.flatnonzero(row[:len(g)] == row[gram - 1:]) if len(g) else none
    if len(at) < 2:
        return none, none
    key = mix(g[at] ^ (row[at].astype(np.uint64) * M1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return none, none
    place = at[order]
    far = np.int64(n) * 4
    step = np.where(same, np.diff(place), far)
    near = np.minimum(np.r_[far, step], np.r_[step, far])     # to the nearest copy of the gram, on either side
    held = near < far
    place, near = place[held], near[held]
    order = np.argsort(place)
    place, near = place[order], near[order]
    begin = np.flatnonzero(np.r_[True, (np.diff(place) > gram) | (row[place[1:]] != row[place[:-1]])])
    last = np.r_[begin[1:], len(place)] - 1
    # No common prefix reaches over the end of a stretch.
    left = np.repeat(place[last], last - begin + 1) + gram - place
    some = np.maximum.reduceat((near * (rule.copies - 1) <= left).astype(np.int8), begin) > 0
    return place[begin[some]], place[last[some]] + gram


def _suffixes(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``seq``, and the LCP of each with the one before it (0 for the first).

    Prefix doubling; the ranks of every level give LCPs by halving."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    levels, size = [rank.astype(np.int64)], 1
    while size < n:
        rank = levels[-1]
        behind = np.zeros(n, np.int64)
        behind[:n - size] = rank[size:] + 1
        pair = rank * (n + 1) + behind
        order = np.argsort(pair, kind="stable")
        new = np.cumsum(np.r_[0, pair[order][1:] != pair[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        levels.append(rank)
        size *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        live = np.flatnonzero((a < n) & (b < n))
        eq = live[levels[k][a[live]] == levels[k][b[live]]]
        # Ranks stand for 2^k words, or for all up to the end; equal ones at different places are whole.
        lcp[eq] += 1 << k
        a[eq] += 1 << k
        b[eq] += 1 << k
    return order, np.r_[0, lcp]


def _seeds(order: np.ndarray, lcp: np.ndarray, rule: Rule) -> Iterator[tuple[int, int, int]]:
    """(i, j, LCP) of positions that become neighbours in a class, near enough for a run."""
    steps = np.flatnonzero(lcp >= rule.gram)
    steps = steps[np.argsort(-lcp[steps], kind="stable")]
    need = rule.copies - 1
    sets: dict[int, list[int]] = {}
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for l, a, b in zip(lcp[steps].tolist(), order[steps - 1].tolist(), order[steps].tolist(), strict=True):
        a, b = root(a), root(b)
        big, small = sets.pop(a, None) or [a], sets.pop(b, None) or [b]
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        parent[b] = a
        sets[a] = big
        for x in small:
            k = bisect_left(big, x)
            if k and (x - big[k - 1]) * need <= l:
                yield big[k - 1], x, l
            if k < len(big) and (big[k] - x) * need <= l:
                yield x, big[k], l
            big.insert(k, x)


def runs_of(h: np.ndarray, bounds: np.ndarray, rule: Rule = Rule()) -> np.ndarray:
    """Rows (row, start, length, period), by row, start and period, of all runs; ``h`` are the words' hashes, and row r has
    words bounds[r] to bounds[r + 1]. Starts count from the row's first word."""
    first, last = _stretches(h, bounds, rule)
    if not len(first):
        return np.zeros((0, 4), np.int64)
    size = last - first
    words_at = ranges(first, size)
    row = np.searchsorted(bounds, words_at, "right") - 1
    # Words of different rows differ, and after each stretch stands a mark of its own.
    begin = np.cumsum(size + 1) - (size + 1)
    n = int((size + 1).sum())
    _, ids = np.unique(mix(h[words_at] ^ mix(row.astype(np.uint64) + M1)), return_inverse=True)
    seq = np.empty(n, np.int64)
    place = ranges(begin, size)
    seq[place] = ids
    seq[begin + size] = len(words_at) + np.arange(len(size))
    order, lcp = _suffixes(seq)
    got = np.array(list(_seeds(order, lcp, rule)), np.int64).reshape(-1, 3)
    i, j, l = got.T
    period = j - i
    length = period + l
    # A pair seen again after its sets have met, or within a run, does not reach to both ends.
    whole = (length >= np.maximum(rule.words, rule.copies * period)) & (seq[j + l] != seq[i + l]) & ((i == 0) | (seq[i - 1] != seq[j - 1]))
    i, period, length = i[whole], period[whole], length[whole]
    source = np.full(n, -1, np.int64)
    source[place] = words_at
    at = source[i]
    row = np.searchsorted(bounds, at, "right") - 1
    out = np.stack([row, at - bounds[row], length, period], axis=1)
    out = out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]
    # Of the same stretch of words, the smallest period is meant.
    return out[np.r_[True, (out[1:, :3] != out[:-1, :3]).any(axis=1)]] if len(out) else out


def kept_words(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each word stays if of every run only the first period does."""
    edge = np.zeros(int(bounds[-1]) + 1, np.int64)
    at = bounds[found[:, 0]] + found[:, 1]
    np.add.at(edge, at + found[:, 3], 1)
    np.add.at(edge, at + found[:, 2], -1)
    return np.cumsum(edge)[:-1] == 0


def joined(part: Slice, w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words joined by one space, and where each row's begin (rows + 1)."""
    held = np.flatnonzero(keep)
    row = w.row()[held]
    edge = np.zeros(len(part.data) + 2, np.int8)
    edge[w.start[held]] += 1
    # The byte behind a word is white if another word of the row follows: it becomes the space.
    more = np.r_[row[1:] == row[:-1], np.zeros(min(1, len(held)), bool)]
    edge[w.end[held] + more] -= 1  # all different
    inside = np.cumsum(edge, dtype=np.int8)[:len(part.data)] > 0
    data = part.data.copy()
    data[w.end[held[more]]] = 0x20
    return data[inside], np.r_[0, np.cumsum(inside)][part.offsets]


def _analysed(batch: pa.RecordBatch, text: str, rule: Rule) -> Iterator[tuple[Slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By slice: the runs, where each row's begin, and the collapsed bytes of each row."""
    for part in slices(column(batch, text)):
        w = words(part, SPACE, lower=False)
        found = runs_of(w.hash, w.bounds, rule)
        data, at = joined(part, w, kept_words(found, w.bounds))
        yield part, found, np.searchsorted(found[:, 0], np.arange(part.rows + 1)), data, at


def find(docs: DataFrame, text: str = "text", rule: Rule = Rule(), runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Add the runs (start, length, period, in words) of each text, and the text that is left if of every run only
    the first period stays, its words joined by one space. A null text has no runs and collapses to an empty text."""
    kept = [f for f in docs.schema.fields if f.name not in (runs, collapsed)]
    schema = T.StructType([*kept, T.StructField(runs, RUN), T.StructField(collapsed, T.StringType())])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found, cut, data, at in _analysed(batch, text, rule):
                lists_ = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found[a:b, 1:].tolist()] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[column(batch, f.name).slice(part.first, part.rows) for f in kept], pa.array(lists_, kind), pa.array(texts, pa.string())], schema.names)

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """Per row: key, n_runs, the longest run (start, length, period, exponent_milli; nulls without a run), and digests of all runs
    and of the collapsed text. Only these few numbers leave the task."""
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found, cut, data, at in _analysed(batch, text, rule):
                rows = []
                view = memoryview(np.ascontiguousarray(data))
                for a, b, f, t in zip(cut[:-1].tolist(), cut[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = found[a:b, 1:].tolist()
                    best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=None)
                    lines = "".join(f"{s},{n},{p}\n" for s, n, p in own)
                    rows.append((b - a, *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(view[f:t]).hexdigest()))
                if rows:
                    made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.string()] * 2, strict=True)]
                    yield pa.RecordBatch.from_arrays([column(batch, key).slice(part.first, part.rows), *made], [key, *names])

    kinds = ", ".join(f"{n} {'string' if 'sha256' in n else 'long'}" for n in names)
    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {kinds}")
