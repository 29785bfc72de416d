"""Training small networks where the rows are.

Rows are hashed once into shards whose number depends on the data, not on the
cluster. In each round every shard runs a few epochs of Adam over its own
minibatches, starting from the broadcast parameters; the results are averaged,
weighted by rows, in a tree. Only parameters travel, one array per shard and
model, so a round costs one scan and a small shuffle, and a lost executor only
repeats its shards.

A large table gets larger shards rather than ever more of them, and the averages are
taken after as many steps as in a small one. So an epoch brings a network as much
further as its rows allow, and training ends after fewer epochs, by the rule it has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_ROWS = 65536
SHARDS = 48              # beyond so many, shards become larger
SHARD_CELLS = 8_000_000  # a shard is held in memory while it is trained on
LOCAL = 10               # epochs between two averages, in shards of up to SHARD_ROWS
ROOM = 1 << 28           # bytes of minibatches kept ready
FAN = 32                 # arrays summed by one task of the tree


def shard(df: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """Cached copy of the columns, in hashed shards with a fixed row order."""
    n = df.count()
    shards = max(1, min(math.ceil(n / SHARD_ROWS), SHARDS), math.ceil(n * len(columns) / SHARD_CELLS))
    return (
        df.select(row_id, *columns).repartition(shards, F.col(row_id)).sortWithinPartitions(row_id)
        .select(*columns).persist()
    )


def batches_of(frames: Iterator[pd.DataFrame], size: int) -> Iterator[np.ndarray]:
    """Minibatches as matrices; their borders do not depend on how rows arrive."""
    rest = None
    for f in frames:
        m = f.to_numpy("float64")
        m = m if rest is None else np.concatenate([rest, m])
        full = len(m) // size * size
        for at in range(0, full, size):
            yield m[at: at + size]
        rest = m[full:]
    if rest is not None and len(rest):
        yield rest


def _between(rows: int, shards: int) -> int:
    """Epochs between two averages: about as many rows of a shard as LOCAL epochs of SHARD_ROWS have."""
    return max(1, min(LOCAL, LOCAL * SHARD_ROWS * shards // max(rows, 1)))


class Ready:
    """Minibatches as an epoch wants them, for one epoch after another; kept if their ``size`` in bytes has room."""

    def __init__(self, made: Callable[[], Iterator], size: int):
        self.made = made
        self.kept = list(made()) if size <= ROOM else None

    def __iter__(self):
        return iter(self.kept) if self.kept is not None else self.made()


def average_epochs(
    data: DataFrame,
    models: list[np.ndarray],
    epoch: Callable,
    batch: int,
    max_epochs: int,
    patience: int,
    tol: float = 0.0,
    seed: int = 0,
    prepare: Callable | None = None,
    lowest: bool = False,
) -> tuple[list[np.ndarray], list[float]]:
    """Train several models over the same rows; returns parameters and last losses.

    ``epoch(models, active, minibatches, rng)`` runs in a shard and returns, per
    model, (parameters, loss sum, rows used). A model that has not improved by
    ``tol`` for ``patience`` epochs in a row is left as it is: on the last loss that was such a gain, or
    (``lowest``, scikit-learn's rule) on the lowest so far. ``prepare(minibatches,
    active)`` makes of a shard's minibatches what all epochs of a round then see.
    """
    spark = data.sparkSession
    shards = data.rdd.getNumPartitions()
    best = [math.inf] * len(models)
    stale = [0] * len(models)
    losses = [math.nan] * len(models)
    done, at_most = 0, _between(data.count(), shards)
    while done < max_epochs and any(s < patience for s in stale):
        active = [s < patience for s in stale]
        local = min(at_most, max_epochs - done)
        shared = spark.sparkContext.broadcast(models)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part = TaskContext.get().partitionId()
            rng = np.random.default_rng([seed, done, part])  # noqa: B023
            now, rows = list(shared.value), list(batches_of(frames, batch))  # noqa: B023
            rows = prepare(rows, active) if prepare else rows  # noqa: B023
            told = [[] for _ in now]
            for _ in range(local):  # noqa: B023
                for i, (theta, loss, used) in enumerate(epoch(now, active, iter(rows), rng)):  # noqa: B023
                    now[i] = theta
                    told[i] += [loss, used]
            for i, theta in enumerate(now):
                if active[i] and told[i] and told[i][-1] > 0:  # noqa: B023
                    v = np.concatenate([theta * told[i][-1], told[i]])
                    yield pd.DataFrame({"model": [i], "part": [part], "v": [v.tobytes()]})

        out = summed_arrays(data.mapInPandas(run, _SUMS), shards)
        shared.unpersist()
        models = list(models)
        for i in [i for i, a in enumerate(active) if a]:
            if i not in out:
                stale[i] = patience
                continue
            v, k = out[i], 2 * local
            sums = v[-k:].reshape(local, 2)
            if not np.isfinite(v).all():
                stale[i] = patience
                continue
            models[i] = v[:-k] / sums[-1, 1]
            for loss, used in sums:
                losses[i] = loss / used
                if losses[i] < best[i] - tol:
                    best[i], stale[i] = losses[i], 0
                else:
                    stale[i] += 1
                    best[i] = min(best[i], losses[i]) if lowest else best[i]
                if stale[i] >= patience:
                    break
        done += local
    return models, losses


_SUMS = "model int, part long, v binary"


def summed_arrays(rows: DataFrame, count: int) -> dict[int, np.ndarray]:
    """The sum of the arrays ``v`` of each model, from rows (model, part, v). Tasks add up ``FAN`` parts each until few are left."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, least = {}, {}
        for f in frames:
            for i, part, v in zip(f["model"], f["part"], f["v"], strict=True):
                v = np.frombuffer(v)
                total[i] = total[i] + v if i in total else v
                least[i] = min(part, least.get(i, part))
        if total:
            yield pd.DataFrame({"model": list(total), "part": [least[i] for i in total], "v": [v.tobytes() for v in total.values()]})

    while count > FAN:
        count = math.ceil(count / FAN)
        rows = rows.repartition(count, "part").sortWithinPartitions("part").mapInPandas(add, _SUMS)
    out: dict[int, np.ndarray] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["model"], r["part"])):
        v = np.frombuffer(r["v"])
        out[r["model"]] = out[r["model"]] + v if r["model"] in out else v
    return out


def total_loss(data: DataFrame, models: list[np.ndarray], loss: Callable, batch: int, seed: int = 0) -> list[float]:
    """Mean of ``loss(models, minibatches, rng)`` = [(sum, rows)] over all shards."""
    shared = data.sparkSession.sparkContext.broadcast(models)

    def run(frames):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        done = loss(shared.value, batches_of(frames, batch), rng)
        yield pd.DataFrame([(i, float(s), float(n)) for i, (s, n) in enumerate(done)], columns=["model", "s", "n"])

    out = data.mapInPandas(run, "model int, s double, n double").groupBy("model").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    by = {r["model"]: r["s"] / r["n"] if r["n"] else math.nan for r in out}
    return [by.get(i, math.nan) for i in range(len(models))]


# --- networks as flat vectors ---------------------------------------------


def glorot(sizes: list[int], rng, normal: bool = False) -> np.ndarray:
    out = []
    for a, b in zip(sizes, sizes[1:]):
        if normal:
            w = rng.normal(0.0, math.sqrt(2.0 / (a + b)), (a, b))
        else:
            limit = math.sqrt(6.0 / (a + b))
            w = rng.uniform(-limit, limit, (a, b))
        out += [w.ravel(), np.zeros(b)]
    return np.concatenate(out) if out else np.zeros(0)


def layers(theta: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((theta[at: at + a * b].reshape(a, b), theta[at + a * b: at + a * b + b]))
        at += a * b + b
    return out


def forward(theta: np.ndarray, sizes: list[int], x: np.ndarray, last: str = "linear") -> list[np.ndarray]:
    """Activations of every layer, input first; hidden layers are ReLU."""
    outs = [x]
    net = layers(theta, sizes)
    for i, (w, b) in enumerate(net):
        z = outs[-1] @ w + b
        if i < len(net) - 1 or last == "relu":
            z = np.maximum(z, 0.0)
        elif last == "sigmoid":
            z = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
        outs.append(z)
    return outs


def backward(theta, sizes, outs, grad, last: str = "linear") -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the parameters and of the input, given the gradient of the output."""
    net = layers(theta, sizes)
    pieces = []
    for i in range(len(net) - 1, -1, -1):
        y = outs[i + 1]
        if i < len(net) - 1 or last == "relu":
            grad = grad * (y > 0)
        elif last == "sigmoid":
            grad = grad * y * (1.0 - y)
        pieces.append(np.concatenate([(outs[i].T @ grad).ravel(), grad.sum(0)]))
        grad = grad @ net[i][0].T
    return (np.concatenate(pieces[::-1]) if pieces else np.zeros(0)), grad


def with_adam(theta: np.ndarray) -> np.ndarray:
    """Parameters followed by both Adam moments and the step count."""
    return np.concatenate([theta, np.zeros(2 * theta.size), [0.0]])


def params(state: np.ndarray) -> np.ndarray:
    return state[: (state.size - 1) // 3]


def adam(state: np.ndarray, grad: np.ndarray, rate: float, b1=0.9, b2=0.999, eps=1e-8, clip: float | None = None) -> np.ndarray:
    k = grad.size
    theta, m, v, t = state[:k], state[k: 2 * k], state[2 * k: 3 * k], state[-1] + 1
    if clip is not None:
        grad = np.clip(grad, -clip, clip)
    m = b1 * m + (1 - b1) * grad
    v = b2 * v + (1 - b2) * grad * grad
    step = rate * math.sqrt(1 - b2**t) / (1 - b1**t)
    return np.concatenate([theta - step * m / (np.sqrt(v) + eps), m, v, [t]])


def adam_rows(states: np.ndarray, grad: np.ndarray, rate: float | np.ndarray, b1=0.9, b2=0.999, eps=1e-8, clip: float | None = None) -> None:
    """The same step for several models, a row each, in place; ``rate`` may be a column with the rate of each."""
    k = grad.shape[1]
    if clip is not None:
        np.clip(grad, -clip, clip, out=grad)
    m, v, t = states[:, k: 2 * k], states[:, 2 * k: 3 * k], states[:, -1:]
    t += 1
    m *= b1
    m += (1 - b1) * grad
    v *= b2
    grad *= grad
    grad *= 1 - b2
    v += grad
    np.sqrt(v, out=grad)
    grad += eps
    np.divide(m, grad, out=grad)
    grad *= rate * np.sqrt(1 - b2**t) / (1 - b1**t)
    states[:, :k] -= grad


# --- applying fitted functions to rows --------------------------------------


def map_matrix(df: DataFrame, inputs: list[Column], outputs: list[str], f: Callable) -> DataFrame:
    """Replace or add columns by ``f(matrix) -> matrix``; only the inputs cross into Python."""
    schema = T.StructType([T.StructField(f"o{i}", T.DoubleType()) for i in range(len(outputs))])

    @F.pandas_udf(schema)
    def run(x: pd.DataFrame) -> pd.DataFrame:
        out = np.asarray(f(x.to_numpy("float64")), dtype="float64").reshape(len(x), len(outputs))
        return pd.DataFrame(out, columns=[f"o{i}" for i in range(len(outputs))])

    packed = F.struct(*[c.cast("double").alias(f"i{i}") for i, c in enumerate(inputs)])
    df = df.withColumn("__out", run(packed))
    return df.withColumns({c: F.col("__out")[f"o{i}"] for i, c in enumerate(outputs)}).drop("__out")


def row_uniforms(seed_column: np.ndarray, k: int) -> np.ndarray:
    """k uniforms per row from one integer per row (SplitMix64 finaliser)."""
    mix = np.uint64
    with np.errstate(over="ignore"):
        z = seed_column.astype("uint64")[:, None] + (np.arange(1, k + 1, dtype="uint64") * mix(0x9E3779B97F4A7C15))[None, :]
        z = (z ^ (z >> mix(30))) * mix(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> mix(27))) * mix(0x94D049BB133111EB)
        z = z ^ (z >> mix(31))
    return (z >> mix(11)).astype("float64") / float(1 << 53)
