"""Exact percentiles of large groups against numpy."""

import numpy as np
import pytest

from lectern.plans import quantiles


@pytest.mark.parametrize("room", [1, 20, 10**6])
def test_percentiles(spark, room):
    rng = np.random.default_rng(9)
    groups = {"even": rng.uniform(0, 1, 3000), "ties": rng.integers(0, 3, 2000).astype(float), "one": np.array([4.0]), "same": np.full(500, 7.0), None: rng.normal(size=900), "tail": np.concatenate([np.zeros(1000), [1e9, -1e9, 5.0]])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("even", None), ("empty", None)]
    shares = [0.0, 0.25, 0.5, 0.95, 0.999, 1.0]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(3)
    made = {r.g: r.p for r in quantiles.percentiles(frame, ["g"], "v", shares, room).collect()}
    assert set(made) == set(groups)
    for g, values in groups.items():
        assert np.allclose(made[g], np.quantile(values, shares), rtol=1e-12, atol=1e-12), g
    whole = quantiles.percentiles(frame, [], "v", [0.5], room).collect()
    assert len(whole) == 1 and np.isclose(whole[0].p[0], np.median(np.concatenate(list(groups.values()))))
    assert quantiles.percentiles(frame.limit(0), ["g"], "v", [0.5], room).count() == 0
