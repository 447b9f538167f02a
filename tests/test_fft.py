"""The block-wise transform against numpy's, at lengths that are powers, primes and products."""

import numpy as np
import pytest

from orbitflow.operators import fft


@pytest.mark.parametrize("cells", [16, 1 << 17])
def test_equals_the_transform_in_memory(spark, cells):
    rng = np.random.default_rng(3)
    data = {f"r{n}": rng.normal(size=(n, 2)) + 5 for n in (8, 9, 64, 101, 257, 1000, 1024)}
    rows = [(name, len(x), i, float(a), float(b)) for name, x in data.items() for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "recording_id string, _n long, _i long, u double, v double")
    got = fft.transform(df, ["u", "v"], cells).toPandas()
    for name, x in data.items():
        own = got[got["recording_id"] == name].sort_values("k")
        want = np.fft.rfft(x, axis=0)
        assert own["k"].tolist() == list(range(len(want)))
        for j, c in enumerate("uv"):
            assert np.abs(own[f"re_{c}"].to_numpy() + 1j * own[f"im_{c}"].to_numpy() - want[:, j]).max() < 1e-9 * np.abs(want).max()


def test_shapes_hold_the_convolution():
    for n in (8, 9, 1000, 1 << 20, (1 << 20) + 1):
        r, c = fft.shape(n)
        assert 2 * n - 1 <= r * c < 4 * n and r in (c, 2 * c)
