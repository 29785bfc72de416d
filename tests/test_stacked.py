"""Steps that several networks take together, against steps one by one."""

import time

import numpy as np
import pytest

from gapweave.functions import mlp
from gapweave.functions.training import adam, backward, forward, params
from gapweave.operators.impute import generative as g


def one_by_one(plans, models, batches):
    models, loss, used = list(models), np.zeros(len(plans)), np.zeros(len(plans))
    for rows in batches:
        for k, (inputs, target, fill, sizes) in enumerate(plans):
            b = rows[~np.isnan(rows[:, target])]
            n = len(b)
            if not n:
                continue
            x = np.where(np.isnan(b[:, inputs]), fill, b[:, inputs])
            theta = params(models[k])
            outs = forward(theta, sizes, x)
            err = outs[-1][:, 0] - b[:, target]
            grad, _ = backward(theta, sizes, outs, err[:, None] / n)
            weights = np.ones(theta.size)
            weights[sizes[0] * mlp.HIDDEN: sizes[0] * mlp.HIDDEN + mlp.HIDDEN] = 0.0
            weights[-1] = 0.0
            models[k] = adam(models[k], grad + mlp.DECAY * weights * theta / n, mlp.RATE)
            loss[k] += 0.5 * float(err @ err) + 0.5 * mlp.DECAY * float((weights * theta) @ theta)
            used[k] += n
    return models, loss, used


def planned(inputs):
    return [(i, t, np.full(len(i), 0.1 * t), [len(i), mlp.HIDDEN, 1]) for t, i in enumerate(inputs)]


@pytest.mark.parametrize("room", [mlp.ROOM, 0])
def test_targets_step_together_as_one_by_one(monkeypatch, room):
    monkeypatch.setattr(mlp, "ROOM", room)
    monkeypatch.setattr(mlp, "TOGETHER", 3)
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(430, 5))
    rows[rng.random(rows.shape) < 0.3] = np.nan
    rows[:200, 2] = np.nan  # a minibatch without a target
    batches = [rows[i: i + 200] for i in range(0, 430, 200)]
    plans = planned([[1, 2, 3, 4], [0, 2, 3, 4], [0, 1, 3, 4], [0, 1], [0, 1, 2, 3]])
    want = got = [mlp._start(i, t, 1) for i, t, _, _ in plans]
    active = [True] * 5
    stacks = mlp._Stacks(plans, batches, active)
    for _ in range(3):
        want, loss, used = one_by_one(plans, want, batches)
        made = mlp._epoch(plans)(got, active, iter(stacks), rng)
        got = [m for m, _, _ in made]
        assert np.allclose([s for _, s, _ in made], loss, rtol=1e-9) and [n for _, _, n in made] == used.tolist()
    assert all(np.allclose(a, b, rtol=1e-7, atol=1e-10) for a, b in zip(want, got, strict=True))
    left = mlp._epoch(plans)(want, [True, False] + [True] * 3, iter(mlp._Stacks(plans, batches, [True, False] + [True] * 3)), rng)
    assert left[1][0] is want[1] and left[1][2] == 0


def test_steps_together_cost_less():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(8000, 5))
    rows[rng.random(rows.shape) < 0.2] = np.nan
    batches, plans = [rows[i: i + 200] for i in range(0, 8000, 200)], planned([[i for i in range(5) if i != t] for t in range(5)])
    start = [mlp._start(i, t, 1) for i, t, _, _ in plans]
    stacks, took = mlp._Stacks(plans, batches, [True] * 5), []
    for run in (lambda: one_by_one(plans, start, batches), lambda: mlp._epoch(plans)(start, [True] * 5, iter(stacks), rng)):
        run()
        began = time.process_time()
        for _ in range(5):
            run()
        took.append(time.process_time() - began)
    assert took[1] < took[0] / 2, took


class Given:
    """Random numbers that are known beforehand."""

    def __init__(self, noise, eps):
        self.noise, self.eps = noise, eps

    def uniform(self, low, high, shape):
        return self.noise

    def standard_normal(self, shape):
        return self.eps


def vaes(d):
    return [g._VaeTask(d, p) for p in g.grid_points(g.VAE_GRID, None) for _ in range(g.FOLDS)], [f + 1 for _ in range(12) for f in range(g.FOLDS)]


@pytest.mark.parametrize("folded", [True, False])
def test_variational_networks_step_together_as_one_by_one(folded):
    d, rng = 5, np.random.default_rng(2)
    tasks, folds = vaes(d)
    if not folded:
        tasks, folds = tasks[:1], [None]
    models = [t.start([0, i]) for i, t in enumerate(tasks)]
    batches = []
    for n in (64, 23, 2):
        rows = rng.random((n, d + 1))
        rows[:, :d][rng.random((n, d)) < 0.3] = np.nan
        rows[0, :d] = np.nan
        rows[:, d] = rng.integers(0, 3, n) if n > 2 else 0.0  # the last minibatch has rows of one fold only
        batches.append(rows)
    kinds, fold = g._fold_places(folds)
    stacks = g._stacked(tasks, [True] * len(tasks))
    got = list(models)
    for rows in batches:
        drawn = {}

        def draw(self, b, rng):
            noise, eps = rng.random((len(self.tasks), d, b.x.shape[2])) * 0.01, rng.standard_normal((len(self.tasks), self.latent, b.x.shape[2]))
            drawn.update({i: (noise[j], eps[j]) for j, i in enumerate(self.places)})
            return noise, eps

        with pytest.MonkeyPatch.context() as m:
            m.setattr(g._VaeStack, "draw", draw)
            got, loss, used = g._run_stacked(stacks, got, [g._fold_rows(rows, kinds)], rng, fold, True)
        for i, t in enumerate(tasks):
            mine = rows[:, :-1] if folds[i] is None else rows[rows[:, -1] != folds[i] - 1, :-1]
            assert used[i] == len(mine)
            if len(mine):
                given = Given(drawn[i][0].T[: len(mine)], drawn[i][1].T[: len(mine), : t.latent])
                models[i], value = t.step(models[i], mine, given)
                assert np.isclose(loss[i], value * len(mine), rtol=1e-8)
                assert np.isclose(t.loss(models[i], mine, given) * len(mine), one_loss(g, t, models[i], rows, folds[i], drawn[i]), rtol=1e-8)
            assert np.allclose(got[i], models[i], rtol=1e-6, atol=1e-9)


def one_loss(g, task, model, rows, fold, drawn):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(g._VaeStack, "draw", lambda self, b, rng: (drawn[0][None, :, : b.x.shape[2]], drawn[1][None, : self.latent, : b.x.shape[2]]))
        _, loss, _ = g._run_stacked(g._stacked([task], [True]), [model], [g._fold_rows(rows, [fold])], None, np.array([0]), False)
    return loss[0]


def test_variational_networks_together_cost_less():
    d, rng = 5, np.random.default_rng(4)
    tasks, folds = vaes(d)
    rows = rng.random((20 * 64, d + 1))
    rows[:, :d][rng.random((len(rows), d)) < 0.2] = np.nan
    rows[:, d] = rng.integers(0, 3, len(rows))
    batches = [rows[i: i + 64] for i in range(0, len(rows), 64)]
    models, (kinds, fold) = [t.start([0, i]) for i, t in enumerate(tasks)], g._fold_places(folds)
    ready, took = [g._fold_rows(b, kinds) for b in batches], []
    for run in (lambda: g._run(tasks, models, [True] * 36, batches, rng, folds, lambda t, s, r, u: t.step(s, r, u)),
                lambda: g._run_stacked(g._stacked(tasks, [True] * 36), models, ready, rng, fold, True)):
        run()
        began = time.process_time()
        run()
        run()
        took.append(time.process_time() - began)
    print("us a minibatch of 36 networks", [round(t / 40 * 1e6) for t in took])
    assert took[1] < took[0] / 3, took
