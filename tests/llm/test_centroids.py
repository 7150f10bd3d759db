import hashlib
import math
import random

from daymill.llm.centroids import MOST, cluster, with_inertia


def brute(vectors, k, rounds, dims):
    kept = [(i, [max(-MOST, min(MOST, math.floor(64 * x))) for x in v]) for i, v in vectors
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    cents = [q for _, q in start[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        cents = [[sum(x) // len(g) for x in zip(*g)] if (g := groups.get(j)) else c for j, c in enumerate(cents)]
    return [(i, near(q)[1], near(q)[0]) for i, q in kept], cents


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), -1 / 64, 0.5]) for _ in range(6)]) for i in range(400)]
    rows += [(500 + i, [0.25] * 6) for i in range(200)]  # one vector in a third of the rows
    rows += [(None, [0.1] * 6), (7, [0.3] * 6), (7, [0.2] * 6), (900, [1e30, -1e30] * 3)]
    rows += [(901, None), (902, []), (903, [0.1] * 5), (904, [0.1] * 5 + [None]), (905, [float("nan")] * 6), (906, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, q string, DISTANCE int").repartition(5)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found, cents = cluster(df, k=9, rounds=3, dims=6)
    assert found.columns == ["vec_id", "embedding", "q", "cluster", "distance"]
    want, centroids = brute(rows, 9, 3, 6)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert cents == centroids
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=key) == sorted(want, key=key)
    sums = {}
    for _, c, d in want:
        sums[c] = sums.get(c, 0) + d
    for r in with_inertia(found.where("vec_id < 900"), cents).collect():
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()
    small = found.where("vec_id < 900").collect()
    assert {r.inertia for r in with_inertia(found.where("vec_id < 900"), cents).collect()} == {sum(r.distance for r in small)}


def test_ties_few_vectors_and_empty(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    found, cents = cluster(df, k=16, rounds=2, dims=2)
    got = {r.vec_id: r.cluster for r in found.collect()}
    assert len(cents) == 3 and got[1] == got[2] == min(c for c, v in enumerate(cents) if v == [0, 0])
    empty, none = cluster(df.limit(0), dims=2)
    assert none == [] and with_inertia(empty, none).count() == 0
    assert with_inertia(empty, none).columns == ["vec_id", "embedding", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
