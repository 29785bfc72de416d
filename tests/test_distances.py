import numpy as np
import pytest

from gapweave.operators import distances
from gapweave.operators.distances import distance_scale


@pytest.mark.parametrize("fetch", [8192, 0])
def test_quantile_of_all_pair_distances(spark, monkeypatch, fetch):
    monkeypatch.setattr(distances, "FETCH", fetch)
    monkeypatch.setattr(distances, "BUCKETS", 16)
    monkeypatch.setattr(distances, "BLOCK", 32)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((150, 3)).round(1)
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "row_id long, a double, b double, c double")
    full = np.where(np.isnan(x), np.nanmean(x, 0), x)
    d = np.sort(((full[:, None] - full[None]) ** 2).sum(2).ravel() / 2)
    d = d[d > 0]
    for quant in (0.0, 0.5, 0.9, 1.0):
        assert distance_scale(df, ["a", "b", "c"], quant) == pytest.approx(d[max(1, int(quant * len(d))) - 1] * 0.05)


def test_no_two_points_differ(spark):
    same = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "row_id long, a double")
    assert distance_scale(same, ["a"]) is None and distance_scale(same.limit(0), ["a"]) is None
    two = spark.createDataFrame([(1, 1.0), (2, 3.0)], "row_id long, a double")
    assert distance_scale(two, ["a"]) == pytest.approx(0.1)
    assert distance_scale(two, ["a"], max_points=1) is None
