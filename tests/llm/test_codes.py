"""Vector codes, against plain integer k-means."""

import numpy as np
import pytest

from gapweave.llm import codes


def plain(vectors, parts=codes.PARTS, entries=codes.ENTRIES, rounds=codes.ROUNDS, scale=codes.SCALE):
    """Entries, errors and codebooks of vectors in order of their keys."""
    v = np.floor(np.array(vectors, np.float64) * scale).astype(np.int64)
    w = -(-v.shape[1] // parts)
    v = np.pad(v, ((0, 0), (0, parts * w - v.shape[1]))).reshape(len(v), parts, w)
    books = v[:entries].transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((v[:, :, None] - books[None]) ** 2).sum(-1)
        own = d.argmin(-1)
        if r < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    if (own[:, p] == e).any():
                        books[p, e] = v[own[:, p] == e, p].sum(0) // (own[:, p] == e).sum()
    return own, d.min(-1).sum(-1), books


def close(got, books, keys, want):
    own, error, expected = want
    rows = {r.key: r for r in got}
    assert (books == expected).all() and len(rows) == len(keys)
    for i, k in enumerate(keys):
        assert (list(rows[k].code), rows[k].error) == (own[i].tolist(), error[i])


@pytest.mark.parametrize("width, n, spread", [(64, 700, 0.3), (10, 300, 0.002), (7, 5, 1.0), (16, 40, 300.0)])
def test_codes_equal_plain_kmeans(spark, width, n, spread):
    rng = np.random.default_rng(width)
    centres = rng.standard_normal((6, width))
    vectors = (centres[rng.integers(0, 6, n)] + rng.standard_normal((n, width)) * 0.2) * spread
    vectors[n // 2] = vectors[n // 3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    coded, books = codes.compress(df, label=None)
    close(coded.collect(), books, range(n), plain(vectors))


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(2)
    v = (rng.integers(0, 8, 4000)[:, None] * 900 + rng.integers(-60, 60, (4000, 4))).astype(np.int64)
    book = np.unique(v[:16], axis=0)
    bounds, _ = codes.Bounds.measured(v, book, 4)
    new = book + rng.integers(-3, 4, book.shape)
    again = codes.Bounds.unpacked(memoryview(bounds.packed()), len(v), 4)
    again.moved(codes._moved(book, new), 3)
    best, looked = again.assign(v, new)
    every = ((v[:, None] - new[None]) ** 2).sum(-1)
    assert (best == every.min(1)).all() and (again.listed[:, 0] == every.argmin(1)).all()
    assert looked.mean() < len(new) / 2 and again.listed.shape[1] == 3
    # Bounds hold, and are ordered.
    for i in range(0, 4000, 97):
        rest = np.sqrt(every[i][[e for e in range(len(new)) if e not in again.listed[i]]])
        assert (np.diff(again.low[i]) >= 0).all() and again.low[i, -1] <= rest.min() + 1e-6
        assert all(again.low[i, z - 1] <= np.sqrt(every[i][again.listed[i, z]]) + 1e-6 for z in (1, 2))


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    good = [(3, [0.1, -0.2, 0.0], "a"), (1, [0.5, 0.5, 0.5], None), (1, [0.1, 0.5, 0.5], None), (None, [0.9, 0.0, 0.0], "b"), (7, [-0.0, 0.0, 0.0], "a")]
    bad = [(4, None, "a"), (5, [1.0, None, 0.0], "a"), (6, [nan, 0.0, 0.0], "a"), (8, [inf, 0.0, 0.0], "b"), (9, [], None), (10, [1.0], "b")]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, label string").selectExpr("*", "1 AS key", "2 AS rows", "3 AS mark", "4 AS v", "5 AS code")
    order = [2, 1, 0, 4, 3]  # by key, nulls last, equal keys by components
    own, error, books = plain([np.float32(good[i][1]).tolist() for i in order])
    got = codes.report(df).collect()
    assert len(got) == len(good)
    by_error = {i: int(e) for i, e in zip(order, error, strict=True)}
    total = {}
    for i, (_, _, label) in enumerate(good):
        total[label] = total.get(label, 0) + by_error[i]
    assert sorted((r.vec_id, r.error, r.label_error) for r in got if r.vec_id is not None) == sorted((k, by_error[i], total[label]) for i, (k, _, label) in enumerate(good) if k is not None)
    assert all(len(r.code) == 16 for r in got) and len({r.codebooks_sha256 for r in got}) == 1
    assert codes.report(df.limit(0)).count() == 0
    assert codes.report(spark.createDataFrame(bad[:2], "vec_id long, embedding array<float>, label string")).count() == 0
    with pytest.raises(Exception, match="after scaling"):
        codes.compress(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), label=None)
