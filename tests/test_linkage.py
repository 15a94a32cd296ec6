"""Average linkage against always merging the nearest pair."""

import numpy as np
import pytest

from parlance.operators import linkage


def nearest_pairs(x, height):
    clusters = [[i] for i in range(len(x))]
    while len(clusters) > 1:
        d, a, b = min((np.mean([np.linalg.norm(x[i] - x[j]) for i in p for j in q]), a, b) for a, p in enumerate(clusters) for b, q in enumerate(clusters) if a < b)
        if d > height:
            break
        clusters[a] += clusters.pop(b)
    return {frozenset(c) for c in clusters}


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_cut_equals_nearest_pairs(n):
    rng = np.random.default_rng(n)
    x = rng.normal(rng.integers(0, 4, (n, 1)) * 2.0, 0.8, (n, 3))
    for height in (0.5, 1.5, 3.0, 9.0):
        of = linkage.cut(x, height)
        assert {frozenset(np.flatnonzero(of == c).tolist()) for c in set(of.tolist())} == nearest_pairs(x, height)


def test_two_hundred_points_and_small_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (k, 2)) for c, k in (((0, 0), 120), ((6, 0), 70), ((0, 6), 7), ((3, 3.2), 3))])
    points = spark.createDataFrame([("m", i, v) for i, v in enumerate(x.tolist())] + [("one", 1, [0.0, 0.0]), ("one", 2, None)], "group string, id long, v array<double>")
    rows = linkage.average_linkage(points, 2.0, 0.02, 2).collect()
    sizes = sorted(np.bincount([r.cluster for r in rows if r.group == "m"]).tolist())
    assert sizes in ([7, 70, 123], [7, 73, 120], [10, 70, 120]) and [r.cluster for r in rows if r.group == "one"] == [0]
    with pytest.raises(Exception, match="200 points"):
        linkage.average_linkage(points, 2.0, most=100).collect()
