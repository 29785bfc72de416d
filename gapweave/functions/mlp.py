"""One-hidden-layer regressors, several targets trained side by side."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gapweave.functions.training import adam_rows, average_epochs, forward, glorot, params, shard, with_adam

HIDDEN = 100
RATE = 0.001
BATCH = 200
DECAY = 1e-4
TOLERANCE = 1e-4
PATIENCE = 10
#: Targets that take their steps together, minibatches that are made of rows at once, and bytes of them kept ready.
TOGETHER = 8
AHEAD = 64
ROOM = 1 << 28


@dataclass
class Mlp:
    """Network for one target; ``fill`` replaces gaps in its inputs."""

    inputs: list[int]
    theta: np.ndarray
    fill: np.ndarray

    @property
    def sizes(self) -> list[int]:
        return [len(self.inputs), HIDDEN, 1]

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = x[:, self.inputs]
        return forward(self.theta, self.sizes, np.where(np.isnan(x), self.fill, x))[-1][:, 0]


@dataclass
class _Stack:
    """One minibatch for several targets with as many inputs: the rows that have the target, filled up with rows of zeros."""

    targets: list[int]
    x: np.ndarray      # targets, rows, inputs and a one
    y: np.ndarray      # targets, rows
    valid: np.ndarray  # targets, rows
    n: np.ndarray      # targets


def _stacks(plans: list, groups: list[list[int]], batches: list[np.ndarray]) -> Iterator[_Stack]:
    """The stacks of some minibatches; what a target needs of their rows is picked out at once."""
    rows, ends, own = np.concatenate(batches), np.cumsum([0, *map(len, batches)]), {}
    for k in sum(groups, []):
        inputs, target, fill, _ = plans[k]
        at = np.flatnonzero(~np.isnan(rows[:, target]))
        x, given = np.ones((len(at), len(inputs) + 1)), rows[np.ix_(at, inputs)]
        x[:, :-1] = np.where(np.isnan(given), fill, given)
        own[k] = x, rows[at, target], np.searchsorted(at, ends).tolist()
    for b in range(len(batches)):
        for g in groups:
            seen = [(k, own[k][2][b], own[k][2][b + 1]) for k in g if own[k][2][b] < own[k][2][b + 1]]
            if not seen:
                continue
            n = np.array([to - at for _, at, to in seen])
            x, y = np.zeros((len(seen), n.max(), own[g[0]][0].shape[1])), np.zeros((len(seen), n.max()))
            for i, (k, at, to) in enumerate(seen):
                x[i, : to - at], y[i, : to - at] = own[k][0][at:to], own[k][1][at:to]
            yield _Stack([k for k, _, _ in seen], x, y, (np.arange(n.max()) < n[:, None]).astype(float), n)


class _Stacks:
    """The minibatches of a shard as stacks, for one epoch after another; kept if there is room."""

    def __init__(self, plans: list, rows: list[np.ndarray], active: list[bool]):
        own = [k for k, a in enumerate(active) if a]
        widths = [plans[k][3][0] for k in own]
        alike = [[k for k, w in zip(own, widths) if w == width] for width in dict.fromkeys(widths)]
        self.plans, self.rows = plans, rows
        self.groups = [g[i: i + TOGETHER] for g in alike for i in range(0, len(g), TOGETHER)]
        size = 8 * sum(map(len, rows)) * sum(w + 3 for w in widths)
        self.kept = list(self._made()) if size <= ROOM else None

    def _made(self):
        for at in range(0, len(self.rows) if self.groups else 0, AHEAD):
            yield from _stacks(self.plans, self.groups, self.rows[at: at + AHEAD])

    def __iter__(self):
        return iter(self.kept) if self.kept is not None else self._made()


class _Space:
    """Matrices that steps write to, over and over in the same place."""

    def __init__(self):
        self.made = {}

    def __call__(self, name: str, shape: tuple, kind=float) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.made or self.made[name].size < size:
            self.made[name] = np.empty(size, kind)
        return self.made[name][:size].reshape(shape)


def _gradients(theta: np.ndarray, b: _Stack, space: _Space) -> tuple[np.ndarray, np.ndarray]:
    """(Gradients, half the sums of squared errors) of the targets of a stack, from their parameters, a row a target."""
    k, n, width = b.x.shape
    first, second = theta[:, : width * HIDDEN].reshape(k, width, HIDDEN), theta[:, width * HIDDEN: -1]
    hidden, on, open_ = space("hidden", (k, n, HIDDEN)), space("on", (k, n, HIDDEN)), space("open", (k, n, HIDDEN), bool)
    np.matmul(b.x, first, out=hidden)
    np.greater(hidden, 0.0, out=open_)
    np.copyto(on, open_)
    # Where its units are open or not, a row's output is linear in its inputs.
    out = np.einsum("knw,knw->kn", b.x, np.matmul(on, (first * second[:, None, :]).transpose(0, 2, 1)))
    err = (out + theta[:, -1:] - b.y) * b.valid
    slope = err / b.n[:, None]
    summed = np.matmul((b.x * slope[:, :, None]).transpose(0, 2, 1), on)
    grad = np.empty_like(theta)
    np.multiply(summed, second[:, None, :], out=grad[:, : width * HIDDEN].reshape(k, width, HIDDEN))
    np.einsum("kwh,kwh->kh", first, summed, out=grad[:, width * HIDDEN: -1])
    grad[:, -1] = slope.sum(axis=1)
    return grad, 0.5 * np.einsum("kn,kn->k", err, err)


def _epoch(plans):
    """One pass of minibatch steps; the targets of a stack take theirs together."""

    def epoch(models, active, batches, rng):
        models = list(models)
        loss, used = np.zeros(len(models)), np.zeros(len(models))
        held, state, space = None, None, _Space()

        def put():
            for i, k in enumerate(held or []):
                models[k] = state[i]

        for b in batches:
            if b.targets != held:
                put()
                held, state = b.targets, np.stack([models[k] for k in b.targets])
                size = (state.shape[1] - 1) // 3
                weights = np.ones(size)
                weights[(b.x.shape[2] - 1) * HIDDEN: b.x.shape[2] * HIDDEN] = 0.0
                weights[-1] = 0.0  # biases carry no penalty
            theta = state[:, :size]
            grad, missed = _gradients(theta, b, space)
            weighed = weights * theta
            loss[held] += missed + 0.5 * DECAY * np.einsum("kp,kp->k", weighed, theta)
            used[held] += b.n
            grad += weighed * (DECAY / b.n)[:, None]
            adam_rows(state, grad, RATE)
        put()
        return list(zip(models, loss, used))

    return epoch


def _start(inputs: list[int], target: int, seed: int) -> np.ndarray:
    return with_adam(glorot([len(inputs), HIDDEN, 1], np.random.default_rng([seed, target])))


def fit_mlps(df: DataFrame, columns: list[str], jobs: list[tuple[list[int], int, np.ndarray]], max_epochs: int,
             seed: int = 1, row_id: str = "row_id") -> list[Mlp]:
    """jobs: (input positions, target position, input fill); rows lacking the target are skipped."""
    data = shard(df, columns, row_id)
    plans = [(list(i), t, np.asarray(f, float), [len(i), HIDDEN, 1]) for i, t, f in jobs]
    start = [_start(i, t, seed) for i, t, _, _ in plans]
    done, _ = average_epochs(data, start, _epoch(plans), BATCH, max_epochs, PATIENCE, TOLERANCE, seed,
                             lambda rows, active: _Stacks(plans, rows, active), lowest=True)
    data.unpersist()
    return [Mlp(i, params(m), f) for (i, _, f, _), m in zip(plans, done)]


def fit_small_mlps(subsets: DataFrame, columns: list[str], jobs: list[tuple[list[int], int, np.ndarray]], max_epochs: int,
                   seed: int = 1) -> list[Mlp]:
    """One task per target, for training sets whose size is bounded by definition (column ``job``, rows in ``row_id`` order)."""
    plans = [(list(i), t, np.asarray(f, float), [len(i), HIDDEN, 1]) for i, t, f in jobs]

    def train(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        plan = plans[int(key[0])]
        rows = pdf.sort_values("row_id")[columns].to_numpy("float64")
        step, stacks = _epoch([plan]), _Stacks([plan], [rows[i: i + BATCH] for i in range(0, len(rows), BATCH)], [True])
        state, best, stale = _start(plan[0], plan[1], seed), np.inf, 0
        rng = np.random.default_rng([seed, plan[1]])
        for _ in range(max_epochs):
            (state, loss, used), = step([state], [True], stacks, rng)
            stale = 0 if loss / used < best - TOLERANCE else stale + 1
            best = min(best, loss / used)
            if stale >= PATIENCE:
                break
        return pd.DataFrame({"job": [int(key[0])], "theta": [params(state)]})

    out = subsets.groupBy("job").applyInPandas(train, "job int, theta array<double>").collect()
    theta = {r["job"]: np.array(r["theta"]) for r in out}
    return [Mlp(i, theta[k], f) for k, (i, _, f, _) in enumerate(plans)]
