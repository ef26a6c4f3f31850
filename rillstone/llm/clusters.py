"""Centroid clustering of vectors in exact integers, with ns-bounds.

Lloyd's rounds over a table of vectors.  For every vector the table keeps its cluster and, for each centroid, the distance when it
was last evaluated and the round of that.  The driver keeps where every centroid has been in every round.  In a later round the
stored distance to a centroid is loosened by the norm of that centroid's total displacement since then (the norm of the sum, which
is never more than the sum of the rounds' drifts): less it, it is a lower bound; the one of the own centroid, plus it, an upper bound.
Where some other centroid's lower bound isn't above the upper bound, the own distance is evaluated; the centroids that still
aren't above it are evaluated too, in exact integers, and the nearest (the smaller number at ties) wins.  Bounds are doubles, widened by a part in
10 ** 9, so that they never decide what integers would decide otherwise.

A round reads and writes one table (Scratch); the sums of the clusters change only by the vectors that moved, which each task adds up
before they are shuffled.  What reaches the driver are the sums: (components + 1) numbers a cluster, in limbs of 31 bits, so that no sum
overflows.

Vectors that are null, of another length, or hold a null or a component that isn't finite take no part and have no row.  Repeated rows
count each; where ids repeat, the first centroids follow the components.  A null id is hashed as an empty one.  With fewer vectors
than centroids there are as many clusters as vectors; an empty table gives an empty table.  A distance or a sum of distances
that a long can't hold is null; the clusters are right all the same.  Columns besides the id and the vector don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: components of greater size are kept as doubles and handled as Python integers
SMALL = 2**27
LONG = 2**63 - 1
LIMB = 31
#: part by which bounds are widened, far above the rounding of a few operations on doubles
SLACK = 1e-9
VECTOR = "v array<int>, big array<double>"
STATE = f"{VECTOR}, cluster int, before int, far array<double>, at array<int>"


def whole_vectors(vectors: DataFrame, key: str, vector: str, size: int, factor: int) -> DataFrame:
    """k, v, big: of each vector that takes part, floor(factor * x) of its components if all are small, else the components as given."""
    given = vectors.select(vectors[key].alias("k"), vectors[vector].cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    kept = given.filter(F.size("x") == size).filter(finite)
    small = F.forall("x", lambda x: F.abs(x * factor) < SMALL)
    return kept.select("k", F.when(small, F.transform("x", lambda x: F.floor(x * factor).cast("int"))).alias("v"), F.when(~small, F.col("x")).alias("big"))


def integers(v: pa.Array, big: pa.Array, size: int, factor: int) -> np.ndarray:
    """The vectors as rows of 64-bit integers, or of Python integers where one doesn't fit."""
    rows = np.zeros((len(v), size), np.int64)
    there = v.is_valid().to_numpy(zero_copy_only=False)
    rows[there] = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    if there.all():
        return rows
    rows = rows.astype(object)
    for i in np.flatnonzero(~there):
        rows[i] = [int(x) * factor if abs(x) >= 2**53 else math.floor(factor * x) for x in big[int(i)].as_py()]
    return rows


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    apart = x - c
    return (apart * apart).sum(-1)


def roots(n: np.ndarray) -> np.ndarray:
    if n.dtype != object:
        return np.sqrt(n.astype(float))
    out = np.empty(n.shape)
    for i, x in np.ndenumerate(n):
        try:
            out[i] = math.sqrt(x)
        except OverflowError:
            out[i] = math.inf
    return out


def rows_of(centroids: list[list[int]]) -> np.ndarray:
    fits = all(abs(x) <= SMALL for c in centroids for x in c)
    return np.array(centroids, np.int64 if fits else object)


def displacements(history: list[list[list[int]]]) -> np.ndarray:
    """How far each centroid is now from where it was in each round (rounds x centroids)."""
    return np.array([roots(squared(rows_of(history[-1]).astype(object), rows_of(then).astype(object))) for then in history])


def assign(x: np.ndarray, cluster: np.ndarray, far: np.ndarray, at: np.ndarray, now: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Nearest centroids of the rows of x in this round; far and at are updated in place.  Returns the new clusters."""
    t, n, k = len(drift) - 1, np.arange(len(x)), len(now)
    with np.errstate(invalid="ignore", over="ignore"):
        low = (far - drift[at, np.arange(k)]) * (1 - SLACK) - (far + drift[at, np.arange(k)]) * SLACK
        own = (far[n, cluster] + drift[at[n, cluster], cluster]) * (1 + SLACK)
    low[n, cluster] = math.inf
    doubt = np.flatnonzero(~(low > own[:, None]).all(1))
    best = cluster.copy()
    if not len(doubt):
        return best
    least = squared(x[doubt], now[cluster[doubt]])
    far[doubt, cluster[doubt]], at[doubt, cluster[doubt]] = roots(least), t
    open_ = ~(low[doubt] > (far[doubt, cluster[doubt]] * (1 + SLACK))[:, None])
    open_[np.arange(len(doubt)), cluster[doubt]] = False
    for j in range(k):
        some = np.flatnonzero(open_[:, j])
        if len(some):
            rows = doubt[some]
            d = squared(x[rows], now[j])
            far[rows, j], at[rows, j] = roots(d), t
            nearer = (d < least[some]) | ((d == least[some]) & (j < best[rows]))
            best[rows[nearer]], least[some[nearer]] = j, d[nearer]
    return best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).copy()


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel(), kind))


def first_round(table: DataFrame, centroids: list[list[int]], size: int, factor: int) -> DataFrame:
    """Every distance is evaluated once."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = rows_of(centroids)
        for b in batches:
            x = integers(b.column("v"), b.column("big"), size, factor)
            d = np.stack([squared(x, c) for c in now], 1)
            best = d.argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("k"), b.column("v"), b.column("big"), pa.array(best), pa.array(np.full(len(x), -1, np.int32)), _lists(roots(d), pa.float64()), _lists(np.zeros((len(x), k), np.int32), pa.int32())],
                ["k", "v", "big", "cluster", "before", "far", "at"],
            )

    return table.mapInArrow(run, f"k {table.schema['k'].dataType.simpleString()}, {STATE}")


def next_round(state: DataFrame, history: list[list[list[int]]], size: int, factor: int) -> DataFrame:
    """The state after an assignment to the last centroids of the history."""
    k = len(history[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, drift = rows_of(history[-1]), displacements(history)
        for b in batches:
            x = integers(b.column("v"), b.column("big"), size, factor)
            before, far, at = b.column("cluster").to_numpy(), _matrix(b.column("far"), k), _matrix(b.column("at"), k)
            best = assign(x, before, far, at, now, drift)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("v"), b.column("big"), pa.array(best), pa.array(before), _lists(far, pa.float64()), _lists(at, pa.int32())], b.schema.names)

    return state.mapInArrow(run, state.schema)


def moved_sums(state: DataFrame, size: int, factor: int) -> dict[tuple[int, int], int]:
    """By cluster and component (``size``: the count), how much the sums changed by the vectors that moved in the last round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for b in batches:
            x = integers(b.column("v"), b.column("big"), size, factor)
            for column, sign in (("cluster", 1), ("before", -1)):
                owner = b.column(column).to_numpy()
                for j in np.unique(owner[owner >= 0]).tolist():
                    mine = x[owner == j]
                    held = sums.setdefault(j, [0] * (size + 1))
                    for i, s in enumerate([*mine.sum(0).tolist(), len(mine)]):
                        held[i] += sign * s
        out = []
        for j, held in sums.items():
            for i, s in enumerate(held):
                sign, s, limb = (1 if s >= 0 else -1), abs(s), 0
                while s:
                    out.append((j, i, limb, sign * (s & (2**LIMB - 1))))
                    s, limb = s >> LIMB, limb + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["cluster", "part", "limb", "value"])

    parts = state.filter("cluster <> before").select("v", "big", "cluster", "before").mapInArrow(run, "cluster long, part long, limb long, value long")
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "part", "limb").agg(F.sum("value").alias("value")).collect():
        out[r.cluster, r.part] = out.get((r.cluster, r.part), 0) + (r.value << (LIMB * r.limb))
    return out


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = 64, factor: int = 1024, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each vector that takes part.

    The first centroids are the k vectors with the least SHA-256 of ``seed:key``; each of the rounds assigns all vectors to their nearest
    centroid (squared Euclidean distance, ties to the smaller number) and moves every centroid that has some to floor(sum / count)."""
    disk = Scratch(vectors.sparkSession, "clusters")
    table = whole_vectors(vectors, key, vector, size, factor)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.lit(""))), 256)
    start = table.withColumn("drawn", drawn).orderBy("drawn", F.coalesce("big", F.transform("v", lambda x: x / factor))).limit(k).select("v", "big")
    start = start.toArrow().combine_chunks()
    if not start.num_rows:
        return table.select(F.col("k").alias(key), *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    history = [integers(start["v"].combine_chunks(), start["big"].combine_chunks(), size, factor).tolist()]
    sums: dict[tuple[int, int], int] = {}
    state = disk.save(first_round(table, history[0], size, factor), "round-0")
    for t in range(1, rounds + 1):
        for at, change in moved_sums(state, size, factor).items():
            sums[at] = sums.get(at, 0) + change
        history.append([[sums.get((j, i), 0) // n for i in range(size)] if (n := sums.get((j, size), 0)) else c for j, c in enumerate(history[-1])])
        state = disk.save(next_round(state, history, size, factor), f"round-{t}")
        disk.drop_all_but(f"round-{t}")

    last = history[-1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = rows_of(last)
        for b in batches:
            d = squared(integers(b.column("v"), b.column("big"), size, factor), now[b.column("cluster").to_numpy()])
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("cluster"), pa.array([x if x <= LONG else None for x in d.tolist()], pa.int64())], ["k", "cluster", "distance"])

    found = disk.save(state.select("k", "v", "big", "cluster").mapInArrow(measure, f"k {state.schema['k'].dataType.simpleString()}, cluster int, distance long"), "found")
    disk.drop_all_but("found")
    exact = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(20,0)")))
    held = {r.cluster: r.held for r in found.groupBy("cluster").agg(exact.alias("held")).collect()}
    fits = lambda x: int(x) if x is not None and x <= LONG else None
    total = fits(sum(held.values())) if None not in held.values() else None
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last]
    facts = found.sparkSession.createDataFrame([(j, fits(x), total, hashes[j]) for j, x in held.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("k").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
