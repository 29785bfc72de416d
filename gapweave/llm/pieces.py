"""SentencePiece merge-type vocabularies: encoding by an agenda of symbol pairs, decoding by a table.

``encode`` and ``decode`` are column-to-column operators on any frame. A text is cut between bytes that no piece of the
vocabulary has side by side, so chunks can be merged apart. The chunks of some megabytes of text are counted once
(dictionary encoding in Arrow), and only those a task has not met are merged. The agenda of a chunk are its
adjacent pairs by (score, place from the left), the order in which the library merges; the agendas of all new chunks with as many
symbols are the rows of one table, from which each takes its first pair at a time. Chunks that are very long, or hold a
character without a piece, go through a heap one by one.

The library encodes again: every chunk merged for the first time, every 64th text, and every text with two bytes on either side of
a cut that the task has not met yet; a difference stops the job.

Null texts count as empty and give no ids. Other columns are passed through, repeated rows are coded each, an empty table stays empty. A text
without a cut, however long, is one chunk, and held with its agenda by one task.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.llm.tokens import column, lists, ranges, slices

SPACE = "▁"
#: Chunks of more symbols than this take the heap; those longer than LONG_CHUNK are merged anew each time; chunks a task keeps before it
#: starts over.
WIDE, LONG_CHUNK, CACHE = 48, 64, 400_000
#: Bytes of text handled at once; rows decoded at once.
TOGETHER, ROWS = 2 << 20, 1024
#: Every so many-th text is checked whole.
CHECK_EVERY = 64
#: Symbols that are no pieces: this plus the code point.
OTHER = 1 << 20


@dataclass
class Vocabulary:
    """What encoding and decoding need of a model; plain data, so that it travels with tasks. ``pairs`` are the symbols (left << 21 | right) that
    may be joined, in order, ``joined`` the pieces they give; ``apart`` tells of two bytes whether a text may be cut between."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    unknown: int
    table: list[bytes]
    score: np.ndarray
    pairs: np.ndarray
    joined: np.ndarray
    apart: np.ndarray


def library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def vocabulary(model: bytes) -> Vocabulary:
    """Read a model. Only what is needed for exact results is accepted: identity normalisation
    with a leading space, byte fallback, no unused or user-defined pieces."""
    lib = library(model)
    ids, scores, table, fallback = {}, {}, [], [-1] * 256
    for i in range(lib.vocab_size()):
        piece = lib.id_to_piece(i)
        if lib.is_unused(i):
            raise ValueError("models with unused pieces are not supported")
        if lib.is_byte(i):
            fallback[int(piece[3:5], 16)] = i
            table.append(bytes([int(piece[3:5], 16)]))
        elif lib.is_control(i):
            table.append(b"")
        elif lib.is_unknown(i):
            table.append(" ⁇ ".encode())
        else:
            ids[piece], scores[piece] = i, lib.get_score(i)
            table.append(piece.replace(SPACE, " ").encode())
    probe = "A  ①ﬁ é x "
    if lib.decode(lib.encode(probe)) != probe or lib.encode_as_pieces("a")[0][0] != SPACE or -1 in fallback:
        raise ValueError("the model normalises its input or lacks byte pieces")
    symbols = {p[i] for p in ids for i in range(len(p))} | set(ids)
    number = {p: ids.get(p, OTHER + ord(p[0])) for p in symbols}
    pairs, apart = {}, np.ones((256, 256), bool)
    for p, i in ids.items():
        for k in range(1, len(p)):
            a, b = p[:k], p[k:]
            if a in number and b in number:
                pairs[number[a] << 21 | number[b]] = i
        raw = np.frombuffer(p.replace(SPACE, " ").encode(), np.uint8)
        apart[raw[:-1], raw[1:]] = False
    apart[:, 0x80:0xC0] = False  # within a character
    keys = np.array(sorted(pairs), np.int64)
    score = np.full(len(table), -np.inf, np.float32)
    score[list(ids.values())] = list(scores.values())
    return Vocabulary(ids, scores, fallback, lib.unk_id(), table, score, keys, np.array([pairs[k] for k in keys.tolist()], np.int32), apart)


def merge(v: Vocabulary, chunk: str) -> list[int]:
    """Ids of one chunk: pop the best adjacent pair, join it, put its new neighbours on the agenda."""
    ids, scores = v.ids, v.scores
    n = len(chunk)
    size, before, after = [1] * n, list(range(-1, n - 1)), [*range(1, n), -1]
    agenda = [(-scores[p], i, 2) for i in range(n - 1) if (p := chunk[i:i + 2]) in scores]
    heapq.heapify(agenda)
    while agenda:
        _, i, total = heapq.heappop(agenda)
        j = after[i]
        if not size[i] or j < 0 or size[i] + size[j] != total:
            continue
        size[i], size[j] = total, 0
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (p := chunk[i:k + size[k]]) in scores:
                heapq.heappush(agenda, (-scores[p], i, total + size[k]))
        h = before[i]
        if h >= 0 and (p := chunk[h:i + total]) in scores:
            heapq.heappush(agenda, (-scores[p], h, size[h] + total))
    out, i = [], 0
    while i < n:
        p = chunk[i:i + size[i]]
        if p in ids:
            out.append(ids[p])
        else:
            out += [v.bytes_[b] for b in p.encode()]
        i += size[i]
    return out


class Coder:
    """Encodes in one task. Ids of chunks met are kept in one long array, by slot."""

    def __init__(self, model: bytes, v: Vocabulary):
        self.v, self.lib = v, library(model)
        self.first = np.arange(0x110000, dtype=np.int32) + OTHER
        for p, i in v.ids.items():
            if len(p) == 1:
                self.first[ord(p)] = i
        self.first[0x20] = self.first[ord(SPACE)]
        self.number = [b"%d," % i for i in range(len(v.table))]
        self.met = np.zeros((256, 256), bool)
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.decimal: list[bytes] = []  # ids of each slot with a comma behind each
        self.raw: list[bytes] = []      # and what they decode to
        self.at, self.size, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _joins(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that pairs of symbols give, and their scores (-inf for none)."""
        v, key = self.v, left.astype(np.int64) << 21 | right
        at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
        piece = v.joined[at]
        return piece, np.where(v.pairs[at] == key, v.score[piece], -np.inf).astype(np.float32)

    def _merged(self, symbols: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """Symbols of each chunk after all joins. Chunks of equally many symbols are rows of one table; each row takes the best pair of its
        agenda, the leftmost of equals, and goes on with one symbol less."""
        out: list[np.ndarray] = [None] * len(size)
        order = np.argsort(-size, kind="stable")
        begin, width = 0, int(size.max(initial=0))
        who, sym, piece, score = np.zeros(0, np.int64), np.zeros((0, width), np.int64), np.zeros((0, width - 1), np.int32), np.zeros((0, width - 1), np.float32)
        while width:
            end = int(np.searchsorted(-size[order], -width, "right"))
            if end > begin:
                new = order[begin:end]
                own = symbols[at[new][:, None] + np.arange(width)].astype(np.int64)
                p, q = self._joins(own[:, :-1], own[:, 1:])
                who, sym, piece, score, begin = np.r_[who, new], np.concatenate([sym, own]), np.concatenate([piece, p]), np.concatenate([score, q]), end
            if width == 1:
                best, live = np.zeros(len(who), np.int64), np.zeros(len(who), bool)
            else:
                best = score.argmax(axis=1)
                live = score[np.arange(len(who)), best] > -np.inf
            for i, x in zip(who[~live].tolist(), sym[~live], strict=True):
                out[i] = x
            width -= 1
            who, sym, piece, score, best = who[live], sym[live], piece[live], score[live], best[live][:, None]
            if not width:
                break
            row, place = np.arange(len(who)), np.arange(width)[None]
            made = piece[row, best[:, 0]]
            sym = np.take_along_axis(sym, place + (place > best), axis=1)
            sym[row, best[:, 0]] = made
            place = place[:, :-1]
            keep = place + (place >= best)
            piece, score = np.take_along_axis(piece, keep, axis=1), np.take_along_axis(score, keep, axis=1)
            for shift in (-1, 0):  # the pairs on either side of the new symbol
                k = best[:, 0] + shift
                r = np.flatnonzero((k >= 0) & (k < width - 1))
                piece[r, k[r]], score[r, k[r]] = self._joins(sym[r, k[r]], sym[r, k[r] + 1])
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Ids of chunks, appended slot by slot and checked by the library."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbols = self.first[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        at = np.cumsum(size) - size
        plain = np.add.reduceat((symbols >= OTHER).astype(np.int64), at) == 0 if len(chunks) else np.zeros(0, bool)
        easy = np.flatnonzero(plain & (size <= WIDE))
        ids: list[np.ndarray] = [None] * len(chunks)
        for i, x in zip(easy.tolist(), self._merged(symbols, at[easy], size[easy]), strict=True):
            ids[i] = x
        for i in np.flatnonzero(~(plain & (size <= WIDE))).tolist():
            ids[i] = np.array(merge(self.v, chunks[i].replace(" ", SPACE)), np.int64)
        self._check(chunks, ids)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        for x in ids:
            own = x.tolist()
            self.decimal.append(b"".join([self.number[i] for i in own]))
            self.raw.append(b"".join([self.v.table[i] for i in own]))
        self.flat = np.concatenate([self.flat, *ids]).astype(np.int32)
        self.size = np.r_[self.size, lengths]
        self.at = np.r_[0, np.cumsum(self.size)]

    def _check(self, chunks: list[str], ids: list[np.ndarray]) -> None:
        """The library puts a space before every text: a chunk that begins with one loses it first, any other follows a line
        end, if no piece joins that to it, or is merged once more with a space."""
        begin = self.lib.encode("\n")
        texts, skip, want = [], [], []
        for c, x in zip(chunks, ids, strict=True):
            if c[0] == " ":
                texts.append(c[1:])
                skip.append(0)
            elif self.v.apart[0x0A, c[0].encode()[0]] and c[0] != "\n":
                texts.append("\n" + c)
                skip.append(len(begin))
            else:
                texts.append(c)
                skip.append(0)
                x = np.array(merge(self.v, SPACE + c.replace(" ", SPACE)))
            want.append(x)
        for c, n, x, got in zip(chunks, skip, want, self.lib.encode(texts, num_threads=1), strict=True):
            if c != " " and got[n:] != x.tolist():
                raise AssertionError(f"the library encodes {c!r} as {got[n:]}")

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(chunk by place: its number among the distinct ones, where each text's chunks begin, distinct chunks, their slots)."""
        texts = pc.replace_substring(texts, SPACE, " ")
        spaced = pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type))
        part = next(slices(spaced, 1 << 62))
        data, edge = part.data, part.offsets
        full = np.diff(edge) > 1
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = self.v.apart[data[:-1], data[1:]]
        inner = np.flatnonzero(cut)
        cut[edge] = True
        places = np.flatnonzero(cut)
        chunks = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = chunks.dictionary_encode()
        names = coded.dictionary.to_pylist()
        fresh = [c for c in names if c not in self.slots]
        if fresh:
            if len(self.slots) > CACHE:
                self.clear()
                fresh = names
            at = len(self.size)
            self._learn(fresh)
            self.slots |= {c: at + i for i, c in enumerate(fresh)}
        slot = np.fromiter((self.slots[c] for c in names), np.int64, len(names))
        for c in fresh:
            if len(c) > LONG_CHUNK:
                del self.slots[c]
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.searchsorted(places[:-1], edge)
        self._empty = ~full  # only the space before it, which gives no ids
        self._check_texts(texts, data, edge, inner, full, slot[code], bounds)
        return code, bounds, coded.dictionary, slot

    def ids(self, code: np.ndarray, bounds: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has. A text of one chunk that is the space before it has none."""
        own = slot[code]
        size = self.size[own]
        size[bounds[:-1][self._empty]] = 0
        upto = np.r_[0, np.cumsum(size)]
        return self.flat[ranges(self.at[own], size)], upto[bounds[1:]] - upto[bounds[:-1]]

    def _check_texts(self, texts: pa.Array, data: np.ndarray, edge: np.ndarray, inner: np.ndarray, full: np.ndarray, slots: np.ndarray, bounds: np.ndarray) -> None:
        a, b = data[inner - 1], data[inner]
        new = inner[~self.met[a, b]]
        self.met[a, b] = True
        rows = np.searchsorted(edge, new, "right") - 1
        for i in np.unique(np.r_[rows, np.flatnonzero(full)[::CHECK_EVERY]]).tolist():
            s = slots[bounds[i]:bounds[i + 1]]
            if full[i] and self.lib.encode(texts[i].as_py()) != self.flat[ranges(self.at[s], self.size[s])].tolist():
                raise AssertionError(f"the library encodes a text otherwise: {texts[i].as_py()[:80]!r}")


def _parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows of some megabytes of text, nulls as empty."""
    for batch in batches:
        for s in slices(column(batch, text), TOGETHER):
            own = batch.slice(s.first, s.rows)
            yield own, pc.fill_null(column(own, text).cast(pa.large_string()), "")


def _sent(docs: DataFrame, model: bytes):
    """The model and what is read from it, read once and sent to every executor (some megabytes)."""
    return docs.sparkSession.sparkContext.broadcast((model, vocabulary(model)))


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids`` (array of int) for each whole text, without begin or end ids."""
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != ids], T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    kept = [f.name for f in schema.fields[:-1]]
    sent = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*sent.value)
        for own, texts in _parts(batches, text):
            code, bounds, _, slot = coder.coded(texts)
            flat, count = coder.ids(code, bounds, slot)
            yield pa.RecordBatch.from_arrays([*[column(own, c) for c in kept], lists(flat, count, pa.int32())], [*kept, ids])

    return docs.mapInArrow(run, schema)


def tokenized(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", count: str = "n_tokens", same: str = "round_trip") -> DataFrame:
    """Add in one pass: how many ids each whole text has, whether they decode to the text (a null one counting as empty), and the ids."""
    new = [T.StructField(count, T.LongType()), T.StructField(same, T.BooleanType()), T.StructField(ids, T.ArrayType(T.IntegerType(), False))]
    schema = T.StructType([*[f for f in docs.schema.fields if f.name not in (ids, count, same)], *new])
    kept = [f.name for f in schema.fields[:-3]]
    sent = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*sent.value)
        for own, texts in _parts(batches, text):
            code, bounds, _, slot = coder.coded(texts)
            flat, n = coder.ids(code, bounds, slot)
            raw, at = _joined([coder.raw[x] for x in slot.tolist()], code, bounds)
            said = [_decoded(bytes(raw[a:b])) if k else "" for a, b, k in zip(at[:-1], at[1:], n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[column(own, c) for c in kept], pa.array(n, pa.int64()), pc.equal(pa.array(said, pa.large_string()), texts), lists(flat, n, pa.int32())], schema.names)

    return docs.mapInArrow(run, schema)


def _decoded(whole: bytes) -> str:
    """The text of joined pieces: the space before it goes; bytes that are not UTF-8 become U+FFFD each, as in the library."""
    whole = whole[1:] if whole.startswith(b" ") else whole
    try:
        return whole.decode()
    except UnicodeDecodeError:
        return _replaced(whole)


def decode(docs: DataFrame, model: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the text of ``ids``. Null ids give an empty text."""
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != decoded], T.StructField(decoded, T.StringType())])
    kept = [f.name for f in schema.fields[:-1]]
    sent = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(sent.value[1].table, object)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, len(whole), ROWS)):
            col = column(batch, ids)
            if col.null_count:
                col = pa.array([x or [] for x in col.to_pylist()], pa.list_(pa.int32()))
            flat, offsets = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            texts = [_decoded(b"".join(table[flat[a:b]])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in kept], pa.array(texts, pa.string())], [*kept, decoded])

    return docs.mapInArrow(run, schema)


def _replaced(whole: bytes) -> str:
    """Every byte that is not part of valid UTF-8 becomes one U+FFFD."""
    out = []
    while whole:
        try:
            out.append(whole.decode())
            break
        except UnicodeDecodeError as e:
            out += [whole[:e.start].decode(), "�"]
            whole = whole[e.start + 1:]
    return "".join(out)


def _joined(values: list[bytes], code: np.ndarray, bounds: np.ndarray) -> tuple[memoryview, list[int]]:
    """The values of all chunks in a row, and where each text's begin."""
    out = pa.array(values, pa.large_binary()).take(pa.array(code))
    offsets = np.frombuffer(out.buffers()[1], np.int64, len(out) + 1, out.offset * 8)
    return memoryview(out.buffers()[2] or b""), offsets[bounds].tolist()


def coded(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 of every whole text, in one pass: ids and their decoded bytes are made
    once a distinct chunk and put together by chunk. Every text that the library checks is decoded by it as well."""
    sent = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*sent.value)
        for own, texts in _parts(batches, text):
            code, bounds, _, slot = coder.coded(texts)
            flat, count = coder.ids(code, bounds, slot)
            ids, i_at = _joined([coder.decimal[x] for x in slot.tolist()], code, bounds)
            raw, d_at = _joined([coder.raw[x] for x in slot.tolist()], code, bounds)
            rows = []
            for i, n in enumerate(count.tolist()):
                got = bytes(raw[d_at[i]:d_at[i + 1]]) if n else b""
                said = _decoded(got)
                if i % CHECK_EVERY == 0 and n and coder.lib.decode(flat[int(count[:i].sum()):int(count[:i + 1].sum())].tolist()) != said:
                    raise AssertionError(f"the library decodes a text otherwise: {said[:80]!r}")
                rows.append((hashlib.sha256(ids[i_at[i]:i_at[i + 1] - 1] if n else b"").hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([column(own, key), pa.array(count, pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())],
                                             [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    return coded(docs, model)
