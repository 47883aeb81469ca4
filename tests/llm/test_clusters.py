import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import clusters as c


def plain(rows, k=16, rounds=3, d=64):
    """key, cluster, distance, cluster_inertia, inertia, centroid by plain loops."""
    fit = lambda v: v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)
    own = [(key, [math.floor(64 * x) for x in v]) for key, v in rows if key is not None and fit(v)]
    at = [v for _, v in sorted(own, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), i) for i, m in enumerate(at))
    for _ in range(rounds):
        by = {}
        for _, v in own:
            by.setdefault(near(v)[1], []).append(v)
        at = [[sum(x) // len(by[i]) for x in zip(*by[i])] if i in by else m for i, m in enumerate(at)]
    found = [(key, *near(v)[::-1]) for key, v in own]
    of = lambda i: sum(x for _, j, x in found if j == i)
    return sorted((key, i, x, of(i), sum(y for *_, y in found), at[i]) for key, i, x in found)


def got(df):
    return sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(key, v, 0, 1) for key, v in rows], "vec_id long, embedding array<double>, cluster int, v int")


def vectors(n, seed=2, groups=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, 64))
    return [(i, (middle[rng.integers(groups)] + 0.3 * rng.normal(size=64)).tolist()) for i in range(n)]


def test_clusters_equal_plain_loops(spark):
    odd = [(None, [0.5] * 64), (900, None), (901, [0.1] * 63), (902, [float("nan")] * 64), (903, [None] + [0.1] * 63), (904, [0.1] * 65), (905, [float("inf")] * 64), (906, [])]
    rows = vectors(150) + odd + [(7, [0.25] * 64), (7, [0.25] * 64), (-3, [-0.0] * 64)]
    assert got(c.clustered(frame(spark, rows))) == plain(rows)


def test_fewer_vectors_than_centroids_ties_and_empty_tables(spark):
    same = [(i, [0.5] * 64) for i in range(20)]
    out = c.clustered(frame(spark, same))
    assert got(out) == plain(same) and {r.cluster for r in out.collect()} == {0}
    assert got(c.clustered(frame(spark, same[:3]))) == plain(same[:3])
    none = c.clustered(frame(spark, same).limit(0))
    assert none.count() == 0 and none.columns == out.columns


def test_large_components(spark):
    rows = [(i, [float((-1) ** i * 3e6 * (i + 1))] + [0.25] * 63) for i in range(20)]
    assert got(c.clustered(frame(spark, rows))) == plain(rows)
    with pytest.raises(Exception, match="range of a long"):
        c.clustered(frame(spark, [(i, [1e300 * i] * 64) for i in range(20)])).collect()


def test_float_columns_are_read_as_doubles(spark):
    rows = vectors(40)
    df = frame(spark, rows).selectExpr("vec_id", "CAST(embedding AS array<float>) AS embedding")
    assert got(c.clustered(df)) == plain([(key, [float(np.float32(x)) for x in v]) for key, v in rows])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 20), st.integers(1, 9), st.sampled_from([1, 3, 50]))
def test_search_equals_all_distances(seed, k, d, wide):
    rng = np.random.default_rng(seed)
    x, at = rng.integers(-wide, wide, size=(30, d)), rng.integers(-wide, wide, size=(k, d))
    full = ((x[:, None, :] - at[None]) ** 2).sum(2)
    own, away = c.nearest(x, at, rng.permutation(d), (1, 3))
    assert own.tolist() == full.argmin(1).tolist() and away.tolist() == full.min(1).tolist()


def test_dimensions_of_large_variance_come_first(spark):
    rows = [(i, [1.0] * 3 + [float(i)] + [0.01 * i] + [0.0] * 59) for i in range(10)]
    assert c.by_variance(c.whole_vectors(frame(spark, rows)), 64).tolist()[:2] == [3, 4]
