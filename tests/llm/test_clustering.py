"""Operator 13 against plain Python."""

import hashlib
import math
import random

import pytest

from ledgerlens.llm import sharded_lloyd


def lloyd(vectors, dims, k, rounds, seed):
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]
    centroids = [v for _, v in first]
    if not centroids:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {}
    for _, d, n in found:
        inertia[n] = inertia.get(n, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, d, n in found]


def odd_vectors(n, dims):
    r = random.Random(dims)
    base = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in base[i % 5]]) for i in range(n)]
    rows += [(n + i, base[0]) for i in range(n)]  # one common vector
    rows += [(7, base[1]), (7, base[2]), (None, base[3]), (None, None), (-1, []), (-2, base[0][1:]), (-3, base[0][:-1] + [None]), (-4, base[0][:-1] + [float("nan")]), (-5, base[0][:-1] + [float("inf")]), (-6, [0.0] * dims), (-7, [-1e6] * dims)]
    return rows


@pytest.mark.parametrize(("dims", "k", "rounds", "block", "tile"), [(64, 16, 3, 16, 1024), (10, 4, 2, 3, 7), (5, 1, 0, 8, 2), (3, 500, 1, 1, 50)])
def test_same_as_plain_lloyd(spark, equal, dims, k, rounds, block, tile):
    rows = odd_vectors(60, dims)
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label string, cluster int, tile long").repartition(3)
    got = sharded_lloyd.sharded_lloyd(df, dims=dims, k=k, rounds=rounds, seed="s", block=block, tile_rows=tile)
    equal(got.collect(), lloyd(rows, dims, k, rounds, "s"))


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert sharded_lloyd.sharded_lloyd(df).count() == 0
    assert sharded_lloyd.sharded_lloyd(df.limit(0)).count() == 0


def test_slices_that_are_too_large_to_broadcast(spark, equal, monkeypatch):
    rows = odd_vectors(20, 6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(sharded_lloyd, "BROADCAST_NUMBERS", 0)
    equal(sharded_lloyd.sharded_lloyd(df, dims=6, k=3, block=4).collect(), lloyd(rows, 6, 3, 3, "1"))
