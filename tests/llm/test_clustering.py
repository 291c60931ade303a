"""Clusters by bounds against plain rounds that scan every centroid."""

import hashlib
import math

import numpy as np
import pytest
from conftest import rows_of

from ledgertide.llm import clustering as K


def plain(rows, n=K.CENTROIDS, rounds=K.ROUNDS, size=K.SIZE):
    kept = [(i, [math.floor(K.SCALE * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:n]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), k) for k, w in enumerate(c))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for k in set(of):
            mine = [v for (_, v), j in zip(kept, of, strict=True) if j == k]
            c[k] = [sum(xs) // len(mine) for xs in zip(*mine, strict=True)]
    best = [nearest(v) for _, v in kept]
    inertia = {k: sum(d for d, j in best if j == k) for _, k in best}
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), sha[k]) for (i, _), (d, k) in zip(kept, best, strict=True)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_op11_against_sql(spark, sf, duck):
    assert rows_of(K.op11_centroid_clustering(spark, sf).toPandas()) == rows_of(duck.execute(K.OP11_SQL).df())


@pytest.mark.parametrize("spread", [0.01, 1.0, 3000.0])
def test_clusters_of_odd_rows(spark, spread):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=4) * spread]) for k in range(120)]
    rows += [(None, [0.0] * 4), (None, [1.0] * 4), (7, [0.5] * 4), (7, [0.5] * 4), (500, [-0.0039] * 4)]
    rows += [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0]), (903, [float("nan")] * 4), (904, [float("inf")] * 4), (905, [1.0] * 5)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, id string").repartition(3)
    for n, rounds in ((12, 5), (1, 2), (3, 0), (1000, 1)):
        assert found(K.clustered(df, size=4, n=n, rounds=rounds)) == plain(rows, n, rounds, 4)


def test_empty_and_too_large(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert K.clustered(empty).count() == 0 and K.clustered(empty).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="beyond"):
        K.clustered(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), size=1).collect()


@pytest.mark.parametrize("keep", [0, 1, 3, 11])
def test_bounds_certify_only_the_nearest(keep):
    rng = np.random.default_rng(keep)
    x = rng.integers(-50, 50, size=(600, 3))
    c = rng.integers(-50, 50, size=(12, 3))
    b = K.Bounds.scanned(x, c, keep)
    scans = 0
    for step in range(12):
        moved = c + rng.integers(-3, 4, size=c.shape) // (1 + step // 3)
        drift = np.sqrt(((moved - c) ** 2).sum(axis=1)) * K.UP
        c = moved
        b.moved(drift, keep)
        b.settle(x, c)
        d = K.squared(x, c)
        assert (b.cluster == d.argmin(axis=1)).all()
        assert (b.upper**2 >= d[np.arange(len(x)), b.cluster] * (1 - 1e-6)).all()
        scans += int((b.used > keep).sum())
    assert keep == 0 or scans < 12 * len(x)


def test_large_components_are_exact():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-K.LARGEST, K.LARGEST, size=(5, 64)), rng.integers(-K.LARGEST, K.LARGEST, size=(3, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
    assert K.squared(x, c).tolist() == want
