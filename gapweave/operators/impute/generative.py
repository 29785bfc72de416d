"""Generative imputers (adversarial and variational), trained by averaged epochs."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions.rng import hash_uniform
from gapweave.functions.training import (Ready, adam, adam_rows, average_epochs, backward, forward, glorot, map_matrix, params,
                                         row_uniforms, shard, total_loss, with_adam)
from gapweave.operators.encode import CategoryCodec, split_types
from gapweave.operators.impute.base import Imputer, ImputerError, Model, fill_targets
from gapweave.operators.scale import LinearScale, fit_gain, fit_minmax, round_few_valued

FOLDS = 3

# fixed default parameter grids
GAIN_GRID = {
    "alpha": [100], "hint_rate": [0.9], "noise": [0.01],
    "batch_size": [64], "max_epochs": [50], "early_stop": [3],
    "generator_rate": [0.0005], "discriminator_rate": [0.00005],
    "beta_1": [0.9], "beta_2": [0.999], "epsilon": [1e-7],
}
VAE_GRID = {
    "batch_size": [64], "max_epochs": [50], "early_stop": [3],
    "rate": [0.001], "beta_1": [0.9], "beta_2": [0.999], "epsilon": [1e-7],
    "latent_dim_rel_size": [0.5, 0.2], "n_layers": [0, 1, 2],
    "layer_1_rel_size": [0.75, 0.5], "layer_2_rel_size": [0.25],
}
_EPS = 1e-8


def grid_points(defaults: dict[str, list], given: dict[str, list] | None) -> list[dict]:
    """All combinations; known keys of ``given`` replace the defaults, others are ignored."""
    merged = {k: (given or {}).get(k, v) for k, v in defaults.items()}
    return [dict(zip(merged, values)) for values in itertools.product(*merged.values())]


def _of_fold(rows: np.ndarray, fold: int | None) -> np.ndarray:
    """The rows that are left without fold ``fold`` - 1, or (below zero) those in it alone; the last column tells the fold."""
    return rows[:, :-1] if fold is None else rows[(rows[:, -1] == abs(fold) - 1) == (fold < 0), :-1]


def _noisy(x: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs with noise in the gaps, and the mask of observed cells."""
    seen = ~np.isnan(x)
    return np.where(seen, x, noise), seen.astype(float)


# --- adversarial ------------------------------------------------------------


def _gain_sizes(d: int, classic: bool) -> list[int]:
    return [2 * d, d if classic else 2 * d, d, d]


def _gain_losses(g_theta, d_theta, sizes, x, m, hint, alpha):
    """Both losses and both gradients of one minibatch."""
    n = m.size
    g_in = np.concatenate([x, m], 1)
    g_outs = forward(g_theta, sizes, g_in, "sigmoid")
    made = g_outs[-1]
    d_in = np.concatenate([m * x + (1 - m) * made, hint], 1)
    d_outs = forward(d_theta, sizes, d_in, "sigmoid")
    prob = d_outs[-1]
    d_loss = -np.mean(m * np.log(prob + _EPS) + (1 - m) * np.log(1 - prob + _EPS))
    share = max(m.mean(), _EPS)
    mse = np.mean((m * x - m * made) ** 2) / share
    g_loss = -np.mean((1 - m) * np.log(prob + _EPS)) + alpha * mse
    d_grad, _ = backward(d_theta, sizes, d_outs, -(m / (prob + _EPS) - (1 - m) / (1 - prob + _EPS)) / n, "sigmoid")
    _, into = backward(d_theta, sizes, d_outs, -((1 - m) / (prob + _EPS)) / n, "sigmoid")
    at_made = into[:, : m.shape[1]] * (1 - m) + alpha * 2.0 * m * (made - x) / n / share
    g_grad, _ = backward(g_theta, sizes, g_outs, at_made, "sigmoid")
    return g_loss, d_loss, g_grad, d_grad


class _GainTask:
    """One generator/discriminator pair as a single state vector."""

    def __init__(self, d: int, point: dict, classic: bool = False):
        self.d, self.point, self.sizes = d, point, _gain_sizes(d, classic)
        self.clip = None if classic else 1.0
        self.width = sum(a * b + b for a, b in zip(self.sizes, self.sizes[1:]))
        self.cut = 3 * self.width + 1

    def start(self, seed) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([with_adam(glorot(self.sizes, rng, normal=True)) for _ in range(2)])

    def _draw(self, rows, rng):
        x, m = _noisy(rows, rng.uniform(0, self.point["noise"], rows.shape))
        return x, m, m * (rng.random(rows.shape) < self.point["hint_rate"])

    def step(self, state, rows, rng):
        p = self.point
        g, d = state[: self.cut], state[self.cut:]
        x, m, h = self._draw(rows, rng)
        loss, _, gg, dg = _gain_losses(params(g), params(d), self.sizes, x, m, h, p["alpha"])
        g = adam(g, gg, p["generator_rate"], p["beta_1"], p["beta_2"], p["epsilon"], self.clip)
        d = adam(d, dg, p["discriminator_rate"], p["beta_1"], p["beta_2"], p["epsilon"], self.clip)
        return np.concatenate([g, d]), loss

    def loss(self, state, rows, rng):
        x, m, h = self._draw(rows, rng)
        return _gain_losses(params(state[: self.cut]), params(state[self.cut:]), self.sizes, x, m, h, self.point["alpha"])[0]

    def draw(self, state, rows, bits, number):
        """One generator's values for all cells, with noise of its own in the gaps."""
        u = row_uniforms(bits, self.d * (number + 1))[:, self.d * number:]
        x, m = _noisy(rows, u * self.point["noise"])
        return forward(params(state[: self.cut]), self.sizes, np.concatenate([x, m], 1), "sigmoid")[-1]

    def fill(self, states, rows, bits, categorical=()):
        return _averaged(rows, np.stack([self.draw(s, rows, bits, i) for i, s in enumerate(states)]), categorical)


def _averaged(rows: np.ndarray, made: np.ndarray, categorical: list[int]) -> np.ndarray:
    """Gaps filled by the mean over draws; codes of categories by the lower median, which some draw has made."""
    value = made.mean(axis=0)
    if len(categorical):
        value[:, categorical] = np.sort(made[:, :, categorical], axis=0)[(len(made) - 1) // 2]
    return np.where(np.isnan(rows), value, rows)


class _GainStack:
    """Pairs of one layout and one grid point that take their steps together, on the rows of one fold: a matrix a layer and pair."""

    def __init__(self, tasks: list[_GainTask], places: list[int], fold: int | None):
        self.places, self.fold, self.task = np.array(places), fold, tasks[0]
        sizes = self.task.sizes
        ends = np.cumsum([0, *[a * b + b for a, b in zip(sizes, sizes[1:])]])
        self.layers = list(zip(ends, ends[1:], sizes, sizes[1:]))  # a layer's biases are the last row of its matrix
        point = self.task.point
        self.rates = np.tile([[point["generator_rate"]], [point["discriminator_rate"]]], (len(tasks), 1))

    def net(self, theta: np.ndarray) -> list[np.ndarray]:
        return [theta[:, p:q].reshape(len(theta), a + 1, b) for p, q, a, b in self.layers]

    @staticmethod
    def forward(net: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
        """What each layer is given, a one behind it, and the output."""
        outs, last = [x], len(net) - 1
        for i, w in enumerate(net):
            if i < last:
                z = np.empty((*x.shape[:2], w.shape[2] + 1))
                z[:, :, -1] = 1.0
                np.maximum(np.matmul(outs[-1], w), 0.0, out=z[:, :, :-1])
            else:
                z = np.matmul(outs[-1], w)
                np.clip(z, -500, 500, out=z)
                np.negative(z, out=z)
                np.exp(z, out=z)
                z += 1.0
                np.reciprocal(z, out=z)
            outs.append(z)
        return outs

    def backward(self, net: list[np.ndarray], outs: list[np.ndarray], slope: np.ndarray, grad: np.ndarray | None) -> np.ndarray | None:
        """From the gradient of the output: puts that of the parameters into ``grad``, or returns that of the input."""
        slope = slope * outs[-1]
        slope *= 1.0 - outs[-1]
        for i in range(len(net) - 1, -1, -1):
            if grad is not None:
                p, q, a, b = self.layers[i]
                np.matmul(outs[i].transpose(0, 2, 1), slope, out=grad[:, p:q].reshape(len(grad), a + 1, b))
                if i == 0:
                    return None
            slope = np.matmul(slope, net[i][:, :-1].transpose(0, 2, 1))
            if i > 0:
                slope *= outs[i][:, :, :-1] > 0
        return slope

    def draw(self, n: int, d: int, rng) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of its own for each pair: for the noise in gaps, and for the hints."""
        return rng.random((len(self.places), n, d)), rng.random((len(self.places), n, d))

    def step(self, state: np.ndarray, rows: np.ndarray, rng) -> np.ndarray:
        """One step of every pair, in place; the generators' losses before it."""
        (n, d), k, p = rows.shape, len(state), self.task.point
        seen = ~np.isnan(rows)
        m, gap = seen.astype(float), (~seen).astype(float)
        noise, hints = self.draw(n, d, rng)
        g_in, d_in = np.empty((k, n, 2 * d + 1)), np.empty((k, n, 2 * d + 1))
        x = g_in[:, :, :d]
        noise *= p["noise"]
        noise *= gap
        np.add(noise, np.where(seen, rows, 0.0), out=x)
        g_in[:, :, d:-1], g_in[:, :, -1], d_in[:, :, -1] = m, 1.0, 1.0
        pairs = state.reshape(2 * k, -1)  # generators and discriminators by turns
        theta = pairs[:, : (pairs.shape[1] - 1) // 3]
        g_net, d_net = self.net(theta[::2]), self.net(theta[1::2])
        g_outs = self.forward(g_net, g_in)
        made = g_outs[-1]
        off = made - x
        off *= m
        np.add(x, made * gap, out=d_in[:, :, :d])
        d_in[:, :, :d] -= noise
        np.multiply(hints < p["hint_rate"], m, out=d_in[:, :, d:-1])
        d_outs = self.forward(d_net, d_in)
        size, share = n * d, max(m.mean(), _EPS)
        prob = d_outs[-1] + _EPS
        lost = -np.einsum("knd,nd->k", np.log(prob), gap) / size + p["alpha"] * np.einsum("knd,knd->k", off, off) / size / share
        up = gap / size / prob
        grad = np.empty(theta.shape)
        off *= p["alpha"] * 2.0 / size / share
        off -= self.backward(d_net, d_outs, up, None)[:, :, :d] * gap
        self.backward(g_net, g_outs, off, grad[::2])
        self.backward(d_net, d_outs, gap / size / (1.0 + _EPS - d_outs[-1]) - m / size / prob, grad[1::2])
        adam_rows(pairs, grad, self.rates, p["beta_1"], p["beta_2"], p["epsilon"], self.task.clip)
        return lost


def _gain_stacks(tasks: list[_GainTask], active: list[bool], folds: list[int | None]) -> list[_GainStack]:
    kinds = [(f, t.clip, tuple(t.sizes), *t.point.items()) for t, f in zip(tasks, folds)]
    return [_GainStack([tasks[i] for i in own], own, folds[own[0]]) for kind in dict.fromkeys(kinds)
            if (own := [i for i, k in enumerate(kinds) if k == kind and active[i]])]


def _run_gain(stacks: list[_GainStack], models, batches, rng):
    """As _run, for steps of adversarial networks: those of one kind go together."""
    loss, used, models = np.zeros(len(models)), np.zeros(len(models)), list(models)
    states = [np.stack([models[i] for i in s.places]) for s in stacks]
    for rows in batches:
        for s, state in zip(stacks, states):
            mine = _of_fold(rows, s.fold)
            if len(mine):
                loss[s.places] += s.step(state, mine, rng) * len(mine)
                used[s.places] += len(mine)
    for s, state in zip(stacks, states):
        for i, theta in zip(s.places, state):
            models[i] = theta.copy()
    return models, loss, used


# --- variational --------------------------------------------------------------


class _VaeTask:
    def __init__(self, d: int, point: dict):
        self.d, self.point = d, point
        self.latent = max(1, int(round(point["latent_dim_rel_size"] * d)))
        hidden = [max(1, int(round(point[f"layer_{i + 1}_rel_size"] * d))) for i in range(point["n_layers"])]
        self.enc = [d, *hidden, 2 * self.latent]
        self.dec = [self.latent, *hidden[::-1], d]
        self.enc_width = sum(a * b + b for a, b in zip(self.enc, self.enc[1:]))

    def start(self, seed) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return with_adam(np.concatenate([glorot(self.enc, rng), glorot(self.dec, rng)]))

    def _pass(self, theta, x, eps):
        e = forward(theta[: self.enc_width], self.enc, x)
        mean, logvar = e[-1][:, : self.latent], np.clip(e[-1][:, self.latent:], -30, 30)
        z = mean + np.exp(0.5 * logvar) * eps
        return e, mean, logvar, forward(theta[self.enc_width:], self.dec, z, "sigmoid")

    @staticmethod
    def _missed(x, m, made):
        """Per row, the mean squared error of its observed cells: a gap has no likelihood."""
        return ((made - x) ** 2 * m).sum(-1) / np.maximum(m.sum(-1), 1)

    def _loss(self, x, m, mean, logvar, made):
        kl = -0.5 * (1 + logvar - mean**2 - np.exp(logvar)).sum(1).mean()
        return float(self._missed(x, m, made).sum() + kl)

    def step(self, state, rows, rng):
        p = self.point
        x, m = _noisy(rows, rng.uniform(0, 0.01, rows.shape))
        eps = rng.standard_normal((len(x), self.latent))
        theta = params(state)
        e, mean, logvar, dec = self._pass(theta, x, eps)
        made, n = dec[-1], len(x)
        d_grad, at_z = backward(theta[self.enc_width:], self.dec, dec, 2.0 * (made - x) * m / np.maximum(m.sum(1), 1)[:, None], "sigmoid")
        at_mean = at_z + mean / n
        at_logvar = at_z * eps * 0.5 * np.exp(0.5 * logvar) + 0.5 * (np.exp(logvar) - 1) / n
        e_grad, _ = backward(theta[: self.enc_width], self.enc, e, np.concatenate([at_mean, at_logvar], 1))
        new = adam(state, np.concatenate([e_grad, d_grad]), p["rate"], p["beta_1"], p["beta_2"], p["epsilon"])
        return new, self._loss(x, m, mean, logvar, made)

    def loss(self, state, rows, rng):
        x, m = _noisy(rows, rng.uniform(0, 0.01, rows.shape))
        _, mean, logvar, dec = self._pass(params(state), x, rng.standard_normal((len(x), self.latent)))
        return self._loss(x, m, mean, logvar, dec[-1])

    def fill(self, states, rows, bits, categorical=()):
        """The mean over latent draws, weighted by how likely each makes the observed cells: a row's loss counts ``batch_size`` times
        its squared error against one divergence, so that is the scale of the likelihood."""
        k, n = self.latent, self.point.get("draws", 10)
        u = row_uniforms(bits, self.d + 2 * k * n)
        x, m = _noisy(rows, u[:, : self.d] * 0.01)
        made, score = [], []
        for i in range(n):
            at = self.d + 2 * k * i
            eps = np.sqrt(-2 * np.log(np.maximum(u[:, at: at + k], 1e-300))) * np.cos(2 * np.pi * u[:, at + k: at + 2 * k])
            _, mean, logvar, dec = self._pass(params(states[0]), x, eps)
            z = mean + np.exp(0.5 * logvar) * eps
            made.append(dec[-1])
            score.append(-self.point["batch_size"] * self._missed(x, m, dec[-1]) + 0.5 * (eps**2 + logvar - z**2).sum(1))
        made, score = np.stack(made), np.stack(score)
        weight = np.exp(score - score.max(axis=0))
        value = (weight[:, :, None] * made).sum(axis=0) / weight.sum(axis=0)[:, None]
        if len(categorical):
            value[:, categorical] = made[score.argmax(axis=0), np.arange(len(rows))][:, categorical]  # the likeliest draw
        return np.where(m > 0, rows, value)


@dataclass
class _Rows:
    """A minibatch for several folds: the rows that each has, filled up with rows that count for nothing. Columns by rows."""

    x: np.ndarray      # folds, columns and a one, rows; gaps are zero
    gaps: np.ndarray   # folds, columns, rows
    weight: np.ndarray  # folds, columns, rows: one over the observed cells of the row
    share: np.ndarray  # folds, 1, rows: one over the rows of the fold
    n: np.ndarray      # folds


def _fold_rows(rows: np.ndarray, folds: list[int | None]) -> _Rows:
    own = [_of_fold(rows, f) for f in folds]
    n = np.array([len(r) for r in own])
    k, d, most = len(own), rows.shape[1] - 1, max(n.max(), 1)
    x, gaps, weight, share = np.zeros((k, d + 1, most)), np.zeros((k, d, most)), np.zeros((k, d, most)), np.zeros((k, 1, most))
    for i, r in enumerate(own):
        seen = ~np.isnan(r.T)
        x[i, :-1, : len(r)], x[i, -1, : len(r)] = np.where(seen, r.T, 0.0), 1.0
        gaps[i, :, : len(r)] = ~seen
        weight[i, :, : len(r)] = seen / np.maximum(seen.sum(0), 1)
        share[i, 0, : len(r)] = 1.0 / max(len(r), 1)
    return _Rows(x, gaps, weight, share, n)


class _VaeStack:
    """Networks of as many layers as one: parameters of a layer side by side, narrow layers filled up with units that stay zero.
    A layer's matrix holds the biases in its last column."""

    def __init__(self, tasks: list[_VaeTask], places: list[int]):
        self.tasks, self.places, self.point = tasks, np.array(places), tasks[0].point
        self.latent = max(t.latent for t in tasks)
        nets = [[*zip(t.enc, t.enc[1:]), *zip(t.dec, t.dec[1:])] for t in tasks]
        self.turn = len(tasks[0].enc) - 1
        # the output of the encoder is two halves, means and variances, each filled up
        self.shapes = [tuple(max(n[i][j] for n in nets) for j in (1, 0)) for i in range(len(nets[0]))]
        self.shapes[self.turn - 1] = (2 * self.latent, self.shapes[self.turn - 1][1])
        sizes = [b * (a + 1) for b, a in self.shapes]
        self.ends = np.cumsum([0, *sizes])
        self.size = int(self.ends[-1])
        self.at = [self._places(t, n) for t, n in zip(tasks, nets)]
        self.real = np.zeros((len(tasks), self.latent, 1))
        for i, t in enumerate(tasks):
            self.real[i, : t.latent] = 1.0

    def _places(self, task, net) -> np.ndarray:
        """Where the network's parameters, in their own order, stand among the stack's."""
        out = []
        for i, (a, b) in enumerate(net):
            to = np.arange(b)
            if i == self.turn - 1:
                to = np.concatenate([np.arange(task.latent), self.latent + np.arange(task.latent)])
            at = self.ends[i] + to * (self.shapes[i][1] + 1)
            out += [(at[None, :] + np.arange(a)[:, None]).ravel(), at + self.shapes[i][1]]
        return np.concatenate(out)

    def packed(self, states: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(states), 3 * self.size + 1))
        for i, (s, at) in enumerate(zip(states, self.at)):
            k = len(at)
            for part in range(3):
                out[i, part * self.size + at] = s[part * k: (part + 1) * k]
            out[i, -1] = s[-1]
        return out

    def unpacked(self, state: np.ndarray) -> list[np.ndarray]:
        return [np.concatenate([*[row[part * self.size + at] for part in range(3)], row[-1:]]) for row, at in zip(state, self.at)]

    def draw(self, b: _Rows, rng) -> tuple[np.ndarray, np.ndarray]:
        """Noise of its own for each network: for the gaps, and for the latent."""
        n = len(self.tasks), b.x.shape[2]
        return rng.random((n[0], self.tasks[0].d, n[1])) * 0.01, rng.standard_normal((n[0], self.latent, n[1]))

    def pass_(self, theta: np.ndarray, b: _Rows, fold: np.ndarray, noise: np.ndarray, eps: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """(Losses, gradients if wanted) of the networks, each on the rows of its fold."""
        k, n = len(theta), b.x.shape[2]
        w = [theta[:, p: q].reshape(k, rows, cols + 1) for p, q, (rows, cols) in zip(self.ends, self.ends[1:], self.shapes)]
        x, weight, share = b.x[fold], b.weight[fold], b.share[fold]
        x[:, :-1] += b.gaps[fold] * noise
        eps = eps * self.real
        into, last = [x], len(w) - 1
        for i, layer in enumerate(w):
            z = np.matmul(layer, into[i])
            if i == self.turn - 1:
                mean, logvar = z[:, : self.latent], np.clip(z[:, self.latent:], -30, 30)
                std = np.exp(0.5 * logvar)
                z = mean + std * eps
            elif i < last:
                np.maximum(z, 0.0, out=z)
            else:
                made = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
                break
            with_one = np.ones((k, z.shape[1] + 1, n))
            with_one[:, :-1] = z
            into.append(with_one)
        off, var = made - x[:, :-1], std * std
        miss = off * weight
        kl = 1 + logvar - mean * mean - var
        loss = np.einsum("kdn,kdn->k", miss, off) - 0.5 * np.einsum("kdn,kn->k", kl, share[:, 0])
        if not back:
            return loss, None
        grad = np.empty_like(theta)
        slope = 2.0 * miss * made * (1.0 - made)
        for i in range(last, -1, -1):
            if self.turn - 1 < i < last or i < self.turn - 1:
                slope *= into[i + 1][:, :-1] > 0
            p, q = self.ends[i], self.ends[i + 1]
            np.matmul(slope, into[i].transpose(0, 2, 1), out=grad[:, p:q].reshape(w[i].shape))
            if i == 0:
                break
            slope = np.matmul(w[i][:, :, :-1].transpose(0, 2, 1), slope)
            if i == self.turn:
                slope = np.concatenate([slope + mean * share, slope * eps * 0.5 * std + 0.5 * (var - 1) * share], axis=1)
        return loss, grad


def _stacked(tasks: list, active: list[bool]) -> list[_VaeStack]:
    kinds = [len(t.enc) for t in tasks]
    return [_VaeStack([tasks[i] for i in own], own) for kind in dict.fromkeys(kinds)
            if (own := [i for i, k in enumerate(kinds) if k == kind and active[i]])]


def _run_stacked(stacks: list[_VaeStack], models, batches, rng, fold: np.ndarray, train: bool):
    """As _run, for variational networks: those of as many layers go together."""
    loss, used, models = np.zeros(len(models)), np.zeros(len(models)), list(models)
    states = [s.packed([models[i] for i in s.places]) for s in stacks]
    for b in batches:
        for s, state in zip(stacks, states):
            own = fold[s.places]
            n = b.n[own]
            value, grad = s.pass_(state[:, : s.size], b, own, *s.draw(b, rng), train)
            loss[s.places] += value * n
            used[s.places] += n
            if train:
                p, skip = s.point, n == 0
                kept = state[skip]
                adam_rows(state, grad, p["rate"], p["beta_1"], p["beta_2"], p["epsilon"])
                state[skip] = kept  # without a row there is no step
    for s, state in zip(stacks, states):
        for i, theta in zip(s.places, s.unpacked(state)):
            models[i] = theta
    return models, loss, used


def _fold_places(folds: list) -> tuple[list, np.ndarray]:
    kinds = list(dict.fromkeys(folds))
    return kinds, np.array([kinds.index(f) for f in folds])


# --- shared driver ------------------------------------------------------------


def _run(tasks, models, active, batches, rng, folds, action):
    loss, used = np.zeros(len(models)), np.zeros(len(models))
    models = list(models)
    for rows in batches:
        for i, task in enumerate(tasks):
            if not active[i]:
                continue
            mine = _of_fold(rows, folds[i])
            if len(mine):
                models[i], value = action(task, models[i], mine, rng)
                loss[i] += value * len(mine)
                used[i] += len(mine)
    return models, loss, used


def _pace(point: dict) -> tuple[int, int, int]:
    return int(point["batch_size"]), int(point["max_epochs"]), int(point["early_stop"])


def train_tasks(data: DataFrame, tasks: list, folds: list[int | None], seed: int):
    """Train all tasks over the same shards; ``folds[i] = k`` leaves fold k-1 out. Tasks that differ in
    minibatch size, epochs or patience are trained one kind after the other, each with its own values."""
    kinds = [_pace(t.point) for t in tasks]
    if len(set(kinds)) > 1:
        states, losses = [None] * len(tasks), [None] * len(tasks)
        for kind in dict.fromkeys(kinds):
            own = [i for i, k in enumerate(kinds) if k == kind]
            got, lost = train_tasks(data, [tasks[i] for i in own], [folds[i] for i in own], seed)
            for i, s, v in zip(own, got, lost, strict=True):
                states[i], losses[i] = s, v
        return states, losses
    point = tasks[0].point

    def epoch(models, active, batches, rng):
        return list(zip(*_run_gain(_gain_stacks(tasks, active, folds), models, batches, rng)))

    start = [t.start([seed, i]) for i, t in enumerate(tasks)]
    if all(isinstance(t, _VaeTask) for t in tasks):
        kinds, fold = _fold_places(folds)

        def together(models, active, batches, rng):
            return list(zip(*_run_stacked(_stacked(tasks, active), models, batches, rng, fold, True)))

        return average_epochs(data, start, together, int(point["batch_size"]), int(point["max_epochs"]), int(point["early_stop"]), 0.0, seed,
                              lambda rows, active: Ready(lambda: (_fold_rows(r, kinds) for r in rows), 8 * len(kinds) * (3 * tasks[0].d + 2) * sum(map(len, rows))))
    return average_epochs(data, start, epoch, int(point["batch_size"]), int(point["max_epochs"]), int(point["early_stop"]), 0.0, seed)


def held_out(data: DataFrame, tasks: list, models: list, folds: list[int], seed: int) -> list[float]:
    def measure(models, batches, rng):
        flipped = [-f for f in folds]
        if all(isinstance(t, _VaeTask) for t in tasks):
            kinds, fold = _fold_places(flipped)
            _, loss, used = _run_stacked(_stacked(tasks, [True] * len(tasks)), models, (_fold_rows(r, kinds) for r in batches), rng, fold, False)
            return list(zip(loss, used))
        _, loss, used = _run(tasks, models, [True] * len(tasks), batches, rng, flipped, lambda t, s, r, g: (s, t.loss(s, r, g)))
        return list(zip(loss, used))

    return total_loss(data, models, measure, int(tasks[0].point["batch_size"]), seed)


@dataclass
class GenerativeModel(Model):
    columns: list[str]
    targets: list[str]
    codec: CategoryCodec | None
    scale: LinearScale
    task: object
    states: list[np.ndarray]
    seed: int
    row_id: str
    best: dict
    cv_loss: dict[int, float]

    def transform(self, df: DataFrame) -> DataFrame:
        task, states = self.task, self.states
        categorical = [self.columns.index(c) for c in self.codec.tables] if self.codec else []

        def fill(x):
            return task.fill(states, x[:, :-1], x[:, -1], categorical)

        inputs = [F.col(c) for c in self.columns] + [_row_bits(self.seed, self.row_id)]
        if self.codec is None:
            # the filled frame still has every row in place: no join needed
            keep = df.withColumns({f"__o_{c}": F.col(c) for c in self.columns})
            made = self.scale.inverse(map_matrix(self.scale.transform(keep), inputs, self.columns, fill))
            put = {c: F.coalesce(F.col(f"__o_{c}"), F.col(c)) if c in self.targets else F.col(f"__o_{c}") for c in self.columns}
            return made.withColumns(put).drop(*[f"__o_{c}" for c in self.columns])
        encoded = self.scale.transform(self.codec.transform(df))
        made = self.scale.inverse(map_matrix(encoded, inputs, self.columns, fill))
        return fill_targets(df, self.codec.inverse(made), self.targets, self.row_id).drop(*[f"{t}__imputed" for t in self.targets])

    def transform_with_mask(self, df: DataFrame) -> DataFrame:
        """The filled frame plus one mask column per target."""
        return fill_targets(df, self.transform(df), self.targets, self.row_id)


def _row_bits(seed: int, row_id: str) -> Column:
    return F.floor(hash_uniform(seed, "generate", "", row_id) * F.lit(4294967296.0))


class _GenerativeImputer(Imputer):
    defaults: dict = {}
    draws = 1

    def __init__(self, columns=None, row_id="row_id", grid: dict | None = None, targets: list[str] | None = None, seed: int = 0,
                 retry: bool = True, draws: int | None = None):
        super().__init__(columns, row_id)
        self.grid, self.targets, self.seed, self.retry = grid, targets, seed, retry
        self.draws = draws or self.draws

    def make(self, d: int, point: dict):
        raise NotImplementedError

    def fit(self, train: DataFrame) -> GenerativeModel:
        try:
            return self._fit(train, self.seed)
        except (ValueError, FloatingPointError, ArithmeticError):
            if not self.retry:
                raise
            return self._fit(train, self.seed + 1)

    def _fit(self, train: DataFrame, seed: int) -> GenerativeModel:
        cols = self.on(train)
        targets = cols if self.targets is None else self.targets
        if any(t not in cols for t in targets):
            raise ImputerError(f"targets {targets} must be among {cols}")
        categorical, _ = split_types(train, cols)
        codec = CategoryCodec.fit(train, categorical) if categorical else None
        coded = codec.transform(train.select(self.row_id, *cols)) if codec else train.select(self.row_id, *cols)
        scale = fit_minmax(coded, cols)
        fold = F.floor(hash_uniform(seed, "fold", "", self.row_id) * F.lit(float(FOLDS))).cast("double")
        data = shard(scale.transform(coded).withColumn("__fold", fold), [*cols, "__fold"], self.row_id)
        points = grid_points(self.defaults, self.grid)
        best, cv = 0, {}
        if len(points) > 1:
            # every grid point and fold is trained in the same scans, each from its own start
            tasks = [self.make(len(cols), p) for p in points for _ in range(FOLDS)]
            folds = [f + 1 for _ in points for f in range(FOLDS)]
            models, _ = train_tasks(data, tasks, folds, seed)
            losses = held_out(data, tasks, models, folds, seed)
            cv = {i: float(np.mean(losses[i * FOLDS: (i + 1) * FOLDS])) for i in range(len(points))}
            best = min(cv, key=lambda i: (np.inf if np.isnan(cv[i]) else cv[i], i))
        task = self.make(len(cols), points[best])
        # All draws are trained in the same scans.
        models, _ = train_tasks(data, [task] * self.draws, [None] * self.draws, seed)
        data.unpersist()
        return GenerativeModel(cols, targets, codec, scale, task, models, seed, self.row_id, points[best], cv)


class GainImputer(_GenerativeImputer):
    """Generator against discriminator, with hints.

    A generator scatters where the other columns tell nothing, which costs a factor of the root of two against the
    expected value. So a gap gets the mean over ``draws`` generators, trained from starts of their own; one is the original's single draw.
    """

    defaults = GAIN_GRID
    draws = 5

    def make(self, d, point):
        return _GainTask(d, point)


class VaeImputer(_GenerativeImputer):
    """Encoder, sampled latent, decoder; the layout is chosen by cross-validation over a grid."""

    defaults = VAE_GRID

    def make(self, d, point):
        return _VaeTask(d, point)


def gain(df: DataFrame, columns: list[str], batch_size: int = 128, hint_rate: float = 0.9, alpha: float = 100,
         iterations: int = 50, seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """The classic form: own scaling, hidden width d, whole low-cardinality columns rounded at the end."""
    point = {"alpha": alpha, "hint_rate": hint_rate, "noise": 0.01, "batch_size": batch_size, "max_epochs": iterations,
             "early_stop": iterations, "generator_rate": 0.001, "discriminator_rate": 0.001, "beta_1": 0.9, "beta_2": 0.999,
             "epsilon": 1e-8}
    scale = fit_gain(df, columns)
    task = _GainTask(len(columns), point, classic=True)
    data = shard(scale.transform(df).withColumn("__fold", F.lit(0.0)), [*columns, "__fold"], row_id)
    models, _ = train_tasks(data, [task], [None], seed)
    data.unpersist()
    inputs = [F.col(c) for c in columns] + [_row_bits(seed, row_id)]
    made = scale.inverse(map_matrix(scale.transform(df), inputs, columns, lambda x: task.fill(models, x[:, :-1], x[:, -1])))
    return round_few_valued(made, df, columns)
