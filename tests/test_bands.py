import itertools
import math

import numpy as np
import pytest

from tests.conftest import triples
from voxhive.operators.bands import band_kernel, surface_band


def brute(points, size, reach):
    half = math.ceil(reach / size) + 1
    out = set()
    for p in points:
        own = np.floor(np.array(p) / size).astype(int)
        for o in itertools.product(range(-half, half + 1), repeat=3):
            cell = own + o
            d = (cell + 0.5) * size - p
            if math.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) <= reach:
                out.add(tuple(int(c) for c in cell))
    return out


@pytest.mark.parametrize("size, reach", [(0.5, 0.6), (0.25, 0.7), (1.0, 0.3), (0.5, 0.0)])
def test_band_equals_brute_force(spark, size, reach):
    rng = np.random.default_rng(3)
    points = [tuple(map(float, p)) for p in rng.uniform(-3, 3, (60, 3))]
    points += points[:5] + [(0.25, 0.25, 0.25), (-0.5, 1.0, 0.0)]  # repeats, a centre, a corner
    points += [tuple(map(float, p)) for p in rng.uniform(0, size, (80, 3))]  # one crowded cell
    df = spark.createDataFrame(points, "px double, py double, pz double")
    cells = surface_band(df, size, reach)
    assert triples(cells) == brute(points, size, reach) and cells.count() == len(triples(cells))


def test_band_edges(spark):
    rows = [(None, 0.0, 0.0), (float("nan"), 0.0, 0.0), (0.0, float("inf"), 0.0), (0.0, 0.0, -float("inf")), (1e6, -1e6, 0.25)]
    df = spark.createDataFrame(rows, "px double, py double, pz double")
    assert triples(surface_band(df, 0.5, 0.5)) == brute([(1e6, -1e6, 0.25)], 0.5, 0.5)
    assert surface_band(df.where("false"), 0.5, 0.5).count() == 0
    with pytest.raises(ValueError):
        surface_band(df, 0.0, 0.5)


def test_kernel_bounds():
    always, rim = band_kernel(0.1, 0.35)
    assert (0, 0, 0) in always and not set(always) & set(rim) and len(rim) > 62
