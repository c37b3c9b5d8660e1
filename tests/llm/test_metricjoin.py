import numpy as np
import pytest

from voxhive.llm import metricjoin
from voxhive.operators.blocks import min_label

SCHEMA = "vec_id long, embedding array<float>, label int, cls string, links int"


def rows():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(25, 16))
    near = [b + rng.normal(scale=s, size=16) for b in base[:14] for s in (0.02, 0.05, 0.09, 0.12) for _ in range(3)]
    vectors = [v.astype(np.float32).tolist() for v in [*base, *near]]
    vectors += [vectors[3]] * 9 + [[2 * x for x in vectors[3]]]
    vectors += [None, [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [], [1.0, 2.0], [1.0, 2.1], [5.0]]
    return [(len(vectors) - i, v, 0, "x", 1) for i, v in enumerate(vectors)]


def expected(data):
    n = len(data)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, *_ in data]
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(data[i][1]) == len(data[j][1]):
                a, b = (np.array(data[k][1], np.float32).astype(float) for k in (i, j))
                near[i, j] = near[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95
    order = np.argsort([d[0] for d in data])
    label = min_label(n, *np.nonzero(near[np.ix_(order, order)]))
    ids = np.array([data[k][0] for k in order])
    return {int(ids[p]): (int(near[k].sum()), int(ids[label[p]])) for p, k in enumerate(order)}


@pytest.mark.parametrize("block,pivots", [(4096, 48), (7, 5), (30, 1)])
def test_equals_brute_force(spark, block, pivots):
    data = rows()
    got = metricjoin.near_vectors(spark.createDataFrame(data, SCHEMA), block=block, pivots=pivots).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == expected(data)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and len(got) == len(data)


def test_cells_far_from_each_other_are_not_visited():
    rng = np.random.default_rng(0)
    centres = np.eye(8)
    x = np.repeat(centres, 20, axis=0) + rng.normal(scale=0.02, size=(160, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    own = metricjoin.distances(x, centres)
    cells = [(8, p, 20, float(own[p * 20:p * 20 + 20, p].max())) for p in range(8)]
    layout = metricjoin.Layout({8: centres}, cells, 0.316, 10)
    assert (layout.open_cells(8, x, own.min(axis=1)) == (own < 0.5)).all()


def test_null_ids_and_no_rows(spark):
    got = metricjoin.near_vectors(spark.createDataFrame(
        [(None, [1.0, 0.0], 0, "", 0), (1, [1.0, 0.0], 0, "", 0), (1, [1.0, 0.0], 0, "", 0)], SCHEMA)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == [(1, 1, 1, True)] * 2 + [(None, 0, None, False)]
    assert metricjoin.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
