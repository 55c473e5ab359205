"""Clusters by bit planes against plain whole-number arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from docsentry.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, cluster string, id string, norm string, planes string"


def brute(vectors, k, rounds, tag="2:"):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"{tag}{'' if r[0] is None else r[0]}".encode()).hexdigest())
    centroids = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, n, d in found:
        inertia[n] = inertia.get(n, 0) + d
    return [(i, n, d, inertia[n], sum(inertia.values()), centroids[n]) for i, n, d in found]


def rows_of(df):
    return sorted([(r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], list(r["centroid"])) for r in df.collect()], key=str)


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in vectors], SCHEMA)


def test_dots_and_planes_are_exact():
    rng = np.random.default_rng(1)
    for top in (1, 2, 200, 70_000, clustering.LIMIT - 1):
        a, c = rng.integers(-top, top, (50, 64)), rng.integers(-top, top, (7, 64))
        pa, pc = clustering.planes_of(a), clustering.planes_of(c)
        assert (clustering.values_of(pa) == a).all() and (clustering.dots(pa, pc) == a @ c.T).all()
    assert clustering.planes_of(np.zeros((2, 64), np.int64)).tolist() == [[0], [0]]
    assert clustering.values_of(clustering.planes_of(np.full((1, 64), -1))).tolist() == [[-1] * 64]


def test_clusters_are_those_of_plain_arithmetic(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 0.3) for _ in range(64)] for _ in range(6)]
    vectors = [(i, [x + rng.gauss(0, 0.1) for x in centres[i % 6]]) for i in range(300)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(40)]  # one very common vector
    vectors += [(2000 + i, [rng.gauss(0, 10.0 ** (i % 4)) for _ in range(64)]) for i in range(12)]  # rows with other numbers of planes
    for k, rounds in ((8, 5), (1, 2), (8, 0)):
        want = sorted(brute(vectors, k, rounds), key=str)
        assert rows_of(clustering.clustered(frame(spark, vectors).repartition(5), k, rounds)) == want


def test_edges(spark):
    one = [0.5] * 64
    vectors = [(1, one), (1, [-0.001] * 64), (2, one), (None, [1.0] * 64), (None, None), (4, []), (5, [0.1] * 63), (6, [0.1] * 65), (7, [None, *one[1:]]),
               (8, [math.nan, *one[1:]]), (9, [math.inf, *one[1:]]), (10, [-math.inf, *one[1:]]), (11, [0.0] * 64), (12, [-0.0] * 64)]
    got = rows_of(clustering.clustered(frame(spark, vectors), 40, 5))
    assert len(got) == 6 and {r[0] for r in got} == {1, 2, None, 11, 12}
    want = brute(vectors, 40, 5)
    assert sorted(r[2:5] for r in got) == sorted(r[2:5] for r in want)
    assert clustering.clustered(frame(spark, []), 40, 5).collect() == []
    assert clustering.clustered(frame(spark, [(1, [0.1])]), 40, 5).collect() == []
    with pytest.raises(Exception, match="would not fit"):
        clustering.clustered(frame(spark, [(1, [1e30] * 64)]), 2, 1).collect()
