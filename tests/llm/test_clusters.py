"""Clusters against plain Lloyd rounds in Python integers."""

import hashlib
import math
import random

import numpy as np

from rillstone.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, cluster string, k int"


def plain(rows, size, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cent = [v for _, v in order[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(cent)), key=lambda j: (dist(v, cent[j]), j))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        for j in range(len(cent)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                cent[j] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [(i, near(v), dist(v, cent[near(v)])) for i, v in kept]
    per = {}
    for _, j, d in out:
        per[j] = per.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    cut = lambda x: x if x < 2**63 else None
    total = sum(per.values())
    if any(d >= 2**63 for _, _, d in out):
        total = 2**63
    lost = {j for _, j, d in out if d >= 2**63}
    return sorted(((i, j, cut(d), None if j in lost else cut(per[j]), cut(total), sha[j]) for i, j, d in out), key=repr)


def check(spark, rows, size, **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    got = clusters.cluster_vectors(df, size=size, **more)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, size, **more)


def test_against_plain_rounds(spark):
    rng = random.Random(4)
    at = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in at[i % 12]]) for i in range(400)]
    check(spark, rows, 6)


def test_ties_repeats_and_odd_vectors(spark):
    grid = [(i, [float(i % 3) / 1024, float(i % 2) / 1024, 0.0]) for i in range(40)] + [(7, [1.0, 1.0, 1.0])] * 3 + [(7, [0.5, 0.25, -1.0])]
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [math.nan, 0.0, 0.0]), (54, [math.inf, 0.0, 0.0]), (55, [1.0, 2.0]), (None, [0.1, 0.2, 0.3])]
    check(spark, grid + odd, 3)


def test_very_large_components(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 3, 9, 17, 38])] * 2) for i in range(60)]
    check(spark, rows, 2, rounds=4)


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, [(1, [0.0, 1.0]), (2, [3.0, 1.0])], 2)
    assert clusters.cluster_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_save_evaluations_and_keep_the_nearest():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-40, 40, (200, 5)) + 300 * g for g in range(4)]).astype(np.int64)
    history = [(np.arange(4)[:, None] * 300 + rng.integers(-30, 30, (4, 5))).tolist()]
    d = np.stack([clusters.squared(x, np.array(c)) for c in history[0]], 1)
    cluster, far, at = d.argmin(1), np.sqrt(d), np.zeros((800, 4), np.int32)
    for t in range(1, 9):
        history.append([[v + int(s) for v, s in zip(c, rng.integers(-25, 25, 5), strict=True)] for c in history[-1]])
        now = clusters.rows_of(history[-1])
        cluster = clusters.assign(x, cluster, far, at, now, clusters.displacements(history))
        assert (cluster == np.stack([clusters.squared(x, c) for c in now], 1).argmin(1)).all()
        assert (at == t).mean() < 0.3
