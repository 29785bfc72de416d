"""The set join against all pairs, in one unit and over the whole path with small units."""

import random
import re
import string

import numpy as np
import pytest

from gapweave.llm import setjoin
from gapweave.llm.graph import components

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=80):
    """(key, n_shingles, component, links) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    near = [[bool(a and b) and i != j and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    comp = list(range(len(rows)))
    for i, line in enumerate(near):
        for j, linked in enumerate(line):
            if linked and comp[i] != comp[j]:
                old, new = comp[j], comp[i]
                comp = [new if c == old else c for c in comp]
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp)}
    return sorted(((k, len(sets[i]), least[comp[i]], sum(near[i])) for i, (k, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("percent", [50, 80, 95, 100])
def test_unit_equals_all_pairs(percent):
    rng = np.random.default_rng(percent)
    for _ in range(60):
        sets = []
        for _ in range(int(rng.integers(1, 5))):
            base = rng.choice(400, int(rng.integers(1, 40)), False)
            for _ in range(int(rng.integers(1, 12))):
                own = base[rng.random(len(base)) > rng.choice([0, 0.03, 0.1, 0.3])]
                sets.append(np.unique(np.r_[own, rng.choice(400, int(rng.integers(0, 3)))]).astype(np.uint64))
        sets = [s for s in sets if len(s)]
        side = rng.integers(0, 2, len(sets)) if rng.random() < 0.5 else None
        copies = rng.integers(1, 4, len(sets))
        linked, group = setjoin.Unit(sets, percent).links(side, copies)
        want = [0] * len(sets)
        near = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and (side is None or side[i] != side[j])
                and 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]
        for i, j in near:
            want[i] += copies[j]
        assert linked.tolist() == want
        assert all(group[i] == group[j] for i, j in near) and all(group[i] <= i for i in range(len(sets)))
        comp = np.arange(len(sets))
        for i, j in near:
            comp[comp == comp[max(i, j)]] = comp[min(i, j)] if comp[min(i, j)] < comp[max(i, j)] else comp[max(i, j)]
        assert len(set(group.tolist())) == len(sets) - sum(1 for _ in _tree(near, len(sets)))


def _tree(links, n):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            yield i, j


def test_overlaps_are_derived_exactly():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.choice(60, 30)).astype(np.uint64) for _ in range(20)]
    unit = setjoin.Unit(sets, 80)
    known = unit.overlaps(unit.tokens(0))
    for j in range(20):
        got = unit.derived(j, 0, known)
        assert all(got[k] == len(np.intersect1d(sets[j], sets[k])) for k in range(20) if k != j)


@pytest.mark.parametrize("unit_bytes", [setjoin.UNIT_BYTES, 1500])
def test_join_equals_all_pairs(spark, awkward, unit_bytes):
    rng = random.Random(4)
    base = [[rng.choice(string.ascii_lowercase) + str(rng.randrange(300)) for _ in range(rng.choice([4, 30, 70]))] for _ in range(5)]
    shared = ["passage" + str(i) for i in range(25)]
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(10**6))
        if rng.random() < 0.2:
            w += shared
        rows.append((100 + i, " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS slice", "'n' AS node", "3 AS n", "4 AS size").repartition(5)
    got = setjoin.join(docs, unit_bytes=unit_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_join_of_nothing(spark, empty):
    assert setjoin.join(empty).count() == 0
    one = setjoin.join(spark.createDataFrame([(None, None), (None, "a b")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, one), key=str) == [(None, 0, None, 0), (None, 1, None, 0)]


def test_components_of_stars_chains_and_cycles(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7), (300, 210), (210, 300), (5, 300)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    comp = {x: x for x in nodes}
    for _ in range(100):
        for a, b in links:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
