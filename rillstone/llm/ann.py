"""Approximate nearest neighbours over learned partitions.

Fit, on a bounded sample of ``MAX_SAMPLE`` vectors drawn by hash: the sample's neighbour graph is cut into balanced parts (regions
grown from far-apart seeds up to their share, then moves of single vectors to the part most of their neighbours lie in, as long
as balance lasts), and a small network learns to tell from a vector in which parts its neighbours lie.

Index: the network gives every vector its most probable part.  A part is stored in blocks of about ``BLOCK`` vectors, dealt by a hash of
the id, so that a part that holds a third of all rows is many tasks' work and not one's.

Search: a query goes to its most probable parts, as many as it takes to reach ``mass`` of its probability.  The mass is chosen on the
sample, as the least that reaches ``TARGET`` of the true neighbours of sample queries.  Blocks meet the queries routed to their part,
a block of them at a time, keep the best k of each, and the best of all blocks are taken by exact distance in double precision.
Where vectors have no neighbourhoods to speak of, nearly all parts are searched, and the search nears an exact one.

Vectors that are null, zero, of another length than most of the sample, or with null or non-finite components take no part, neither as query
nor as candidate.  Equal distances go to the smaller id; a query's own id is never its neighbour, repeated rows of another id are.  Repeated queries are
answered once for each id.  With fewer candidates than k all are returned; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MAX_SAMPLE = 4096
GRAPH = 12
#: vectors to a part where the table is small; their number grows with the table up to MAX_PARTS
PER_PART, MAX_PARTS = 2048, 1024
BLOCK = 2048
SLACK = 1.05
TARGET = 0.97
HIDDEN, EPOCHS, RATE = 64, 60, 0.01
OUT = "query_id long, vec_id long, score double"


class Router(NamedTuple):
    a: np.ndarray
    a0: np.ndarray
    b: np.ndarray
    b0: np.ndarray
    mass: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        most = np.abs(x).max(1, keepdims=True)
        x = x / np.where(most > 0, most, 1)
        norm = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        z = np.tanh((x / norm) @ self.a + self.a0) @ self.b + self.b0
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        return z / z.sum(1, keepdims=True)

    def routes(self, x: np.ndarray) -> list[np.ndarray]:
        """The parts of each row that reach the mass, most probable first."""
        p = self.probabilities(x)
        order = np.argsort(-p, 1, kind="stable")
        total = np.cumsum(np.take_along_axis(p, order, 1), 1)
        return [o[: int(np.searchsorted(t, self.mass)) + 1] for o, t in zip(order, total, strict=True)]


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean, from differences in double precision, one query at a time.

    Differences whose squares leave the range of a double are scaled by the largest of them first."""
    out = np.empty((len(q), len(x)))
    for i, row in enumerate(q):
        with np.errstate(over="ignore", under="ignore"):
            d = x - row
            squares = np.einsum("ij,ij->i", d, d)
        out[i] = np.sqrt(squares)
        odd = np.flatnonzero((squares < 1e-280) | (squares > 1e300))
        most = np.abs(d[odd]).max(1, initial=0.0)
        odd, most = odd[(most > 0) & np.isfinite(most)], most[(most > 0) & np.isfinite(most)]
        out[i, odd] = most * np.sqrt(((d[odd] / most[:, None]) ** 2).sum(1))
    return out


def near(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances by one product; for picking, not for results."""
    return np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for lo in range(0, len(x), 512):
        d = near(x[lo : lo + 512], x)
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        out[lo : lo + 512] = np.argpartition(d, out.shape[1] - 1, 1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """A part for each vector, none with more than SLACK times its share, few graph edges cut."""
    n, room = len(x), int(np.ceil(SLACK * len(x) / parts))
    seeds = [0]
    far = near(x[:1], x)[0]
    for _ in range(parts - 1):
        seeds.append(int(far.argmax()))
        far = np.minimum(far, near(x[seeds[-1]][None], x)[0])
    to_seed = near(x, x[seeds])
    part, size = np.full(n, -1), np.zeros(parts, np.int64)
    # nearest seeds first, while there is room
    for i in np.argsort(to_seed.min(1), kind="stable"):
        for p in np.argsort(to_seed[i], kind="stable"):
            if size[p] < room:
                part[i] = p
                size[p] += 1
                break
    both = [set(r) for r in graph.tolist()]
    for i, r in enumerate(graph.tolist()):
        for j in r:
            both[j].add(i)
    around = [np.fromiter(s, np.int64) for s in both]
    for _ in range(rounds):
        moved = 0
        for i in range(n):
            votes = np.bincount(part[around[i]], minlength=parts)
            votes[size >= room] = np.where(np.arange(parts)[size >= room] == part[i], votes[size >= room], -1)
            best = int(votes.argmax())
            if votes[best] > votes[part[i]] and size[part[i]] > 1:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


def learn_router(x: np.ndarray, target: np.ndarray, seed: int = 9) -> Router:
    """A network with one hidden layer; target: the share of each row's neighbours in each part."""
    rng = np.random.Generator(np.random.PCG64(seed))
    dim, parts = x.shape[1], target.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(dim), (dim, HIDDEN)) * 2, np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    z = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(z))
        for lo in range(0, len(order), 256):
            some = order[lo : lo + 256]
            h = np.tanh(z[some] @ w[0] + w[1])
            o = h @ w[2] + w[3]
            o -= o.max(1, keepdims=True)
            p = np.exp(o)
            p /= p.sum(1, keepdims=True)
            g = (p - target[some]) / len(some)
            back = (g @ w[2].T) * (1 - h * h)
            step += 1
            for v, m, s, d in zip(w, first, second, (z[some].T @ back, back.sum(0), h.T @ g, g.sum(0)), strict=True):
                d = d + 1e-5 * v
                m += 0.1 * (d - m)
                s += 0.01 * (d * d - s)
                v -= RATE * (1 - 0.9 * epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return Router(*w, 1.0)


def fit_router(x: np.ndarray, parts: int, k: int) -> Router:
    """From the sample, in double precision.  A quarter of it is queries that choose the mass and takes no part in learning."""
    # copies are one point of the graph
    x = np.unique(x, axis=0)
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        dim = x.shape[1] if x.ndim == 2 else 1
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0)
    order = np.random.Generator(np.random.PCG64(1)).permutation(len(x))
    asks, base = x[order[: len(x) // 4][:512]], x[order[len(x) // 4 :]]
    graph = neighbour_graph(base, GRAPH)
    part = balanced_parts(base, graph, parts)
    target = np.zeros((len(base), parts))
    for j in range(graph.shape[1]):
        np.add.at(target, (np.arange(len(base)), part[graph[:, j]]), 1.0)
    np.add.at(target, (np.arange(len(base)), part), 2.0)
    router = learn_router(base, target / target.sum(1, keepdims=True))
    placed = router.probabilities(base).argmax(1)
    best = np.argpartition(near(asks, base), min(k, len(base)) - 1, 1)[:, :k]
    p = router.probabilities(asks)
    rank = np.argsort(-p, 1, kind="stable")
    before = np.cumsum(np.take_along_axis(p, rank, 1), 1) - np.take_along_axis(p, rank, 1)
    # the mass that must be exceeded for a neighbour's part to be searched: what stands before it in the order
    need = np.empty_like(p)
    np.put_along_axis(need, rank, before, 1)
    needs = np.sort(np.take_along_axis(need, placed[best], 1).ravel())
    mass = float(needs[min(len(needs) - 1, int(np.ceil(TARGET * len(needs))))]) + 1e-9
    return router._replace(mass=min(1.0, mass))


def usable(v: Column) -> Column:
    """Neither null nor zero, with finite components only."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _best(ids: np.ndarray, d: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k nearest by (distance, id), without those of the query's own id."""
    fine = np.flatnonzero(ids != own)
    if len(fine) > k:
        edge = np.partition(d[fine], k - 1)[k - 1]
        fine = fine[d[fine] <= edge]
    return fine[np.lexsort((ids[fine], d[fine]))][:k]


def nearest(vectors: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", max_sample: int = MAX_SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (distance) of each row for which ``queries`` holds (over columns ``id`` and ``v``)."""
    spark = vectors.sparkSession
    disk = Scratch(spark, "ann")
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = common[0].dim, common[0].n
    rows = rows.filter(F.size("v") == dim)
    share = min(1.0, max_sample / total)
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit("ann")), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("id").limit(2 * max_sample)
    sample = np.array([r.v for r in drawn.select("v").collect()], np.float64).reshape(-1, dim)
    router = fit_router(sample, min(MAX_PARTS, max(8, total // PER_PART)), k)
    sent = spark.sparkContext.broadcast(router)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(1), dim)
            part = sent.value.probabilities(x).argmax(1) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part.astype(np.int32))], ["id", "v", "part"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.routes(_vectors(batch.column(1), dim)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.tolist() for f in found], pa.list_(pa.int32()))], ["id", "v", "parts"])

    index = disk.save(rows.mapInArrow(place, "id long, v array<double>, part int"), "index")
    asks = rows.filter(queries).groupBy("id").agg(F.min("v").alias("v"))
    asks = disk.save(asks.mapInArrow(route, "id long, v array<double>, parts array<int>"), "queries")
    # parts are few: how many blocks of vectors and of queries each is cut into
    held = index.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    asked = asks.select(F.explode("parts").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("q"))
    cuts = held.join(asked, "part").select("part", F.ceil(F.col("n") / BLOCK).cast("int").alias("vs"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qs"))
    cuts = F.broadcast(disk.save(cuts, "cuts"))
    deal = lambda name, n: F.pmod(F.xxhash64(name), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = index.join(cuts, "part").select("part", deal("id", F.col("vs")).alias("vb"), every(F.col("qs")).alias("qb"), "id", "v")
    right = asks.select("id", "v", F.explode("parts").alias("part")).join(cuts, "part").select("part", every(F.col("vs")).alias("vb"), deal("id", F.col("qs")).alias("qb"), "id", "v")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, asked_ids = a["id"].to_numpy(), b["id"].to_numpy()
        out: list[tuple] = []
        if len(ids) and len(asked_ids):
            x, q = _vectors(a["v"].combine_chunks(), dim), _vectors(b["v"].combine_chunks(), dim)
            for i, own in enumerate(asked_ids):
                d = distances(q[i : i + 1], x)[0]
                out += [(own, ids[j], d[j]) for j in _best(ids, d, own, k)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    keys = ["part", "vb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, OUT)
    # at most k rows for each block of a query's parts
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    flat = best.select("query_id", F.posexplode("best").alias("rank", "b"))
    return flat.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
