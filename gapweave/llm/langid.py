"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``LENGTH`` bytes from both ends, gives every byte a probability for each
language, and a document the mean over all of its bytes. It is trained on the driver, in numpy, by
backpropagation through time, on a bounded sample: at most ``SAMPLE`` excerpts of ``EXCERPT``
characters per language, taken by hash from all eligible documents and from anywhere in them.
Prediction covers every byte of every text. A null text, or one without a letter, is ``und``; equal texts come out alike, and of
languages with equal probability the first by name is taken. An empty table gives no rows, and without any labelled text all are ``und``. Other columns,
whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.llm.tokens import column, ranges, slices

LENGTH, HIDDEN = 64, 8
SAMPLE, EXCERPT = 600, 256
#: Training takes so many steps for each language, however many excerpts there are.
STEPS, BATCH, RATE = 240, 128, 0.01
#: Windows that go through the network at once in a task.
TOGETHER = 4096
UNKNOWN = "und"

Model = dict[str, np.ndarray]


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, LENGTH) bytes, each window's row, and how many of its bytes are text. Rows are cut
    from their beginning; the last window of a row is filled up with zero bytes."""
    size = np.diff(offsets)
    n = -(-size // LENGTH)
    row = np.repeat(np.arange(len(size)), n)
    first = ranges(np.zeros(len(n), np.int64), n) * LENGTH
    used = np.minimum(size[row] - first, LENGTH)
    out = np.zeros((len(row), LENGTH), np.uint8)
    out.ravel()[ranges(np.arange(len(row)) * LENGTH, used)] = data
    return out, row, used


def _softsign(a: np.ndarray, spare: np.ndarray) -> None:
    """a / (1 + |a|) in place; its derivative is (1 - |value|) ** 2."""
    np.abs(a, out=spare)
    spare += 1
    a /= spare


def _steps(table: np.ndarray, recur: np.ndarray, x: np.ndarray, keep: bool):
    """States (LENGTH, HIDDEN, windows) of one direction; with ``keep`` also what training needs.
    Units are rows, so that every operation runs over contiguous windows. Gates z and r are
    (1 + softsign) / 2, r acts on the recurrent part of the candidate, which is a softsign."""
    t, b = x.shape
    h = np.zeros((HIDDEN, b), np.float32)
    states = np.empty((t, HIDDEN, b), np.float32)
    spare2, spare1 = np.empty((2 * HIDDEN, b), np.float32), np.empty((HIDDEN, b), np.float32)
    cache = []
    for k in range(t):
        given = table.take(x[k], axis=1)
        own = recur @ h
        gate = given[:2 * HIDDEN]
        gate += own[:2 * HIDDEN]
        _softsign(gate, spare2)
        gate *= 0.5
        gate += 0.5
        z, r, own_n = gate[:HIDDEN], gate[HIDDEN:], own[2 * HIDDEN:]
        n = given[2 * HIDDEN:]
        np.multiply(r, own_n, out=spare1)
        n += spare1
        _softsign(n, spare1)
        if keep:
            cache.append((h, z, r, n, own_n))
        new = states[k]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        h = new
    return states, cache


def _backward(table: np.ndarray, recur: np.ndarray, x: np.ndarray, cache, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and the recurrent weights from those of the states."""
    d_given, d_recur = np.empty((len(x), 3 * HIDDEN, x.shape[1]), np.float32), np.zeros_like(recur)
    dh = np.zeros_like(given[0])
    for k in range(len(x) - 1, -1, -1):
        h, z, r, n, own_n = cache[k]
        dh = dh + given[k]
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        # z = (1 + s) / 2, so dz/da = (1 - |2 z - 1|) ** 2 / 2
        d = d_given[k]
        d[:HIDDEN] = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        d[HIDDEN:2 * HIDDEN] = dn * own_n * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        d[2 * HIDDEN:] = dn
        d_own = d.copy()
        d_own[2 * HIDDEN:] *= r
        d_recur += d_own @ h.T
        dh = dh * z + recur.T @ d_own
    d_table = np.zeros((table.shape[1], table.shape[0]), np.float32)
    np.add.at(d_table, x.ravel(), d_given.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN))
    return np.ascontiguousarray(d_table.T), d_recur


def _positions(m: Model, x: np.ndarray, keep: bool = False):
    """Probabilities (LENGTH, languages, windows) of windows given as (LENGTH, windows)."""
    x = x.astype(np.intp)
    ahead, c1 = _steps(m["table1"], m["recur1"], x, keep)
    back, c2 = _steps(m["table2"], m["recur2"], x[::-1], keep)
    back = back[::-1]
    logit = np.matmul(m["out1"], ahead)
    logit += np.matmul(m["out2"], back)
    logit += m["bias"][:, None]
    logit -= logit.max(axis=1, keepdims=True)
    np.exp(logit, out=logit)
    logit /= logit.sum(axis=1, keepdims=True)
    return (logit, ahead, back, c1, c2) if keep else logit


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fit on excerpts and their languages."""
    names = sorted(set(labels))
    number = {v: i for i, v in enumerate(names)}
    data = [t.encode() for t in texts]
    x, row, used = windows(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    y = np.array([number[v] for v in labels], np.int64)[row] if len(row) else np.zeros(0, np.int64)
    rng = np.random.Generator(np.random.PCG64(seed))

    def start(*shape):
        return (rng.standard_normal(shape) * 0.3).astype(np.float32)

    m = {"table1": start(3 * HIDDEN, 256), "recur1": start(3 * HIDDEN, HIDDEN), "table2": start(3 * HIDDEN, 256), "recur2": start(3 * HIDDEN, HIDDEN),
         "out1": start(len(names), HIDDEN), "out2": start(len(names), HIDDEN), "bias": np.zeros(len(names), np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    step = 0
    steps = STEPS * len(names)
    while len(x) and step < steps:
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            own = order[at:at + BATCH]
            xs = np.ascontiguousarray(x[own].T)
            p, ahead, back, c1, c2 = _positions(m, xs, keep=True)
            p[:, y[own], np.arange(len(own))] -= 1
            p *= (np.arange(LENGTH)[:, None] < used[own])[:, None, :] / np.float32(max(1, used[own].sum()))
            g = {"out1": np.einsum("tlb,thb->lh", p, ahead, optimize=True), "out2": np.einsum("tlb,thb->lh", p, back, optimize=True), "bias": p.sum(axis=(0, 2))}
            g["table1"], g["recur1"] = _backward(m["table1"], m["recur1"], xs, c1, np.matmul(m["out1"].T, p))
            g["table2"], g["recur2"] = _backward(m["table2"], m["recur2"], xs[::-1], c2, np.matmul(m["out2"].T, p)[::-1])
            step += 1
            if step > steps:
                break
            rate = RATE * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, v in g.items():
                v = v.clip(-1, 1)
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                m[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return m | {"names": np.array(names, object)}


def sample(docs: DataFrame, eligible: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[list[str], list[str]]:
    """At most ``SAMPLE`` excerpts per language, the same in every run."""
    own = docs.where(eligible & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("t"), F.col(lang).alias("lang"), F.col(key).alias("key"))
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    grain = 1 << 30
    # Twice as many as wanted pass by hash, then the lowest hashes are taken.
    chosen = F.lit(False)
    for name, n in counts.items():
        chosen = chosen | ((F.col("lang") == name) & (F.pmod(F.col("h"), F.lit(grain)) < int(min(1.0, 2 * SAMPLE / n) * grain)))
    begin = F.pmod(F.shiftright("h", 31), F.greatest(F.char_length("t") - EXCERPT, F.lit(0)) + 1).cast("int") + 1
    rows = own.withColumn("h", F.xxhash64("key", "t")).where(chosen).select("lang", "h", F.substring("t", begin, F.lit(EXCERPT)).alias("x")).collect()
    taken, texts, labels = dict.fromkeys(counts, 0), [], []
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["x"])):
        if taken[r["lang"]] < SAMPLE:
            taken[r["lang"]] += 1
            texts.append(r["x"])
            labels.append(r["lang"])
    return texts, labels


def predict(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score", runs: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """Add the language of each whole text and its mean probability; with ``runs``, also the runs of
    bytes of one label (from, to, label). An existing column of such a name is replaced. With ``carry``, only those
    columns come back beside the new ones: texts that nobody reads again need not cross twice."""
    new = [lang, score, *([runs] if runs else [])]
    kept = [c for c in (docs.columns if carry is None else carry) if c not in new]
    mark = next(f"letter{i}" for i in range(len(docs.columns) + 1) if f"letter{i}" not in {c.lower() for c in docs.columns})
    sent_in = [c for c in docs.columns if c in kept or c == text]
    marked = docs.select(*sent_in, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(mark))
    run_kind = "array<struct<`from`:bigint,`to`:bigint,label:string>>"
    extra = f", {runs} {run_kind}" if runs else ""
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept], f"{lang} string, {score} double{extra}"])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = m["names"].tolist()
        for batch in batches:
            for part in slices(column(batch, text)):
                x, row, used = windows(part.data, part.offsets)
                total = np.zeros((part.rows, max(1, len(names))))
                labelled = []
                for at in range(0, len(x) if names else 0, TOGETHER):
                    own = slice(at, at + TOGETHER)
                    p = _positions(m, np.ascontiguousarray(x[own].T))
                    p *= (np.arange(LENGTH, dtype=np.int64)[:, None] < used[own])[:, None, :]
                    np.add.at(total, row[own], p.sum(axis=0).T)
                    if runs:
                        labelled.append(p.argmax(axis=1).T)
                letter = column(batch, mark).slice(part.first, part.rows).to_numpy(zero_copy_only=False).astype(bool)
                size = np.maximum(np.diff(part.offsets), 1)
                best = total.argmax(axis=1)
                langs = [names[i] if ok and names else UNKNOWN for i, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                scores = np.where(letter, np.round(np.minimum(total[np.arange(part.rows), best] / size, 1.0), 6), 0.0)
                out = [*[column(batch, c).slice(part.first, part.rows) for c in kept], pa.array(langs, pa.string()), pa.array(scores)]
                if runs:
                    flat = np.concatenate(labelled).ravel()[(np.arange(LENGTH) < used[:, None]).ravel()] if labelled else np.zeros(0, np.int64)
                    out.append(pa.array([_runs(flat[a:b], names) for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True)],
                                        pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("label", pa.string())]))))
                yield pa.RecordBatch.from_arrays(out, [*kept, *new])

    return marked.mapInArrow(run, schema)


def _runs(labels: np.ndarray, names: list[str]) -> list[dict]:
    if not len(labels) or not names:
        return []
    cut = np.flatnonzero(labels[1:] != labels[:-1]) + 1
    edges = [0, *cut.tolist(), len(labels)]
    return [{"from": a, "to": b, "label": names[labels[a]]} for a, b in zip(edges[:-1], edges[1:], strict=True)]


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows not held out."""
    model = train(*sample(docs, ~F.coalesce(held_out(), F.lit(False))))
    return predict(docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), model, carry=["doc_id", "held_out"])
