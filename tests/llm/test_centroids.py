import hashlib
import math
import random

import numpy as np
import pytest
from palimpsest.llm import centroids as cc


def brute(vectors, k, rounds, dims, scale=256, salt="2:"):
    """Plain Lloyd over Python integers: [(vec_id, cluster, distance)] and the centroids."""
    rows = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in vectors if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [x for _, x in start]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))

    def assign():
        return [min(range(len(centroids)), key=lambda j: (far(x, centroids[j]), j)) for _, x in rows]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            mine = [x for (_, x), a in zip(rows, at) if a == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(i, a, far(x, centroids[a])) for (i, x), a in zip(rows, assign())], centroids


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def check(spark, vectors, k, rounds, dims):
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, cluster string").repartition(3)
    state, centroids = cc.clustered(cc.whole_vectors(df, dims=dims), k, rounds)
    got = cc.report(state, centroids).collect()
    want, known = brute(vectors, k, rounds, dims)
    assert centroids == known
    assert key((r.vec_id, r.cluster, r.distance) for r in got) == key(want)
    sums = {}
    for _, c, d in want:
        sums[c] = sums.get(c, 0) + d
    for r in got:
        assert r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, known[r.cluster])).encode()).hexdigest()
    return state, len(want)


def test_against_plain_lloyd(spark):
    rnd = random.Random(3)
    middles = [[rnd.gauss(0, 3) for _ in range(6)] for _ in range(9)]
    vectors = [(i, [m + rnd.gauss(0, 0.4) for m in rnd.choice(middles)]) for i in range(400)]
    vectors += [(900, None), (901, [1.0] * 5), (902, [1.0] * 5 + [float("nan")]), (903, [1.0] * 5 + [None]), (904, [float("-inf")] * 6), (905, [])]
    vectors += [(None, [0.5] * 6), (None, [0.5] * 6), (3, [2.0] * 6), (3, [2.0] * 6)]
    state, n = check(spark, vectors, 9, 5, 6)
    looked = state.selectExpr("sum(scanned)").first()[0]
    assert looked < 0.5 * 9 * n  # the bounds and balls spare the rest


def test_ties_on_a_grid(spark):
    rnd = random.Random(4)
    # equal vectors, mirrored centroids and empty clusters: many exact ties
    vectors = [(i, [rnd.choice([-1, 0, 1]) / 256 for _ in range(3)]) for i in range(120)]
    check(spark, vectors, 12, 5, 3)
    check(spark, [(i, [1.0, 2.0]) for i in range(30)], 4, 3, 2)


def test_few_and_large(spark):
    check(spark, [(1, [0.1, 0.2]), (2, [5e5, -5e5])], 40, 5, 2)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cc.report(*cc.clustered(cc.whole_vectors(empty))).count() == 0
    with pytest.raises(Exception, match="units"):
        cc.whole_vectors(spark.createDataFrame([(1, [1e6, 0.0])], "vec_id long, embedding array<float>"), dims=2).collect()
