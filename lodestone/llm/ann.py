"""Approximate nearest neighbours by balanced posting lists.

A bounded sample gives centroids, which a greedy walk over an in-memory neighbour graph searches.
Every vector is stored in its nearest list and, near a boundary, in further lists whose centroid
distance is within a ratio of the nearest. A query visits the lists whose centroid distance is
within a larger ratio of its own nearest, and scores their vectors exactly, in double precision. The
FIRST_VISITS nearest lists give a bound, its k-th best score so far; the others yield what reaches it.

Inner product becomes distance by one more coordinate, which brings every vector to the largest norm; a
query's is 0. Lists are cut into parts of PART vectors, and the queries that visit one into parts of PART
queries, by hashes, so that no list, however full of copies or however often visited, is scored in one task.

There are as many lists as the square root of the vectors, so that a list grows as slowly as their number; a sample of SAMPLE
rows gives LISTS of them at most. Only the sample and the centroids reach the driver.

Edge cases: vectors that are null, zero, of another length than most of the sample, or hold a null
or non-finite component take no part; ties go to the smaller vec_id; rows of one vec_id are
one candidate with its best score, and never their own query's; fewer than k candidates give all; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

SAMPLE, LISTS, PART, SEED = 40_000, 4_096, 4_096, 77
STORE_RATIO, STORE_LISTS, ROUNDS, NEIGHBOURS, BEAM = 1.05, 4, 8, 16, 64
VISIT_RATIO, LEAST_VISITS, FIRST_VISITS = 1.25, 24, 8


def usable(vector) -> F.Column:
    """True for vectors that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass
class Centroids:
    points: np.ndarray  # lists by dim + 1
    links: np.ndarray  # lists by neighbours, nearest first
    norm: float

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """x with the coordinate that turns inner product into distance."""
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(1)))
        return np.concatenate([x, more[:, None]], 1)

    def near(self, point: np.ndarray, ratio: float, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists by distance within ratio of the nearest, between least and most of them: best-first over the graph.

        The walk goes on while it finds centroids within the ratio, or among the best `beam`.
        """
        n = len(self.points)
        beam = min(n, max(BEAM, least))
        seen = np.zeros(n, bool)
        start = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))
        seen[start] = True
        d = ((self.points[start] - point) ** 2).sum(1)
        queue = list(zip(d.tolist(), start.tolist()))
        heapq.heapify(queue)
        found, best = dict(zip(start.tolist(), d.tolist())), [-x for x in d.tolist()]
        heapq.heapify(best)
        nearest = min(found.values())
        while queue:
            at, i = heapq.heappop(queue)
            if len(best) >= beam and at > -best[0] and at > nearest * ratio * ratio:
                break
            new = self.links[i][~seen[self.links[i]]]
            if not len(new):
                continue
            seen[new] = True
            for x, j in zip(((self.points[new] - point) ** 2).sum(1).tolist(), new.tolist()):
                found[j] = x
                nearest = min(nearest, x)
                if len(best) < beam or x < -best[0] or x <= nearest * ratio * ratio:
                    heapq.heappush(queue, (x, j))
                    heapq.heappush(best, -x)
                    if len(best) > beam:
                        heapq.heappop(best)
        lists, distance = np.array(list(found.keys())), np.array(list(found.values()))
        order = np.lexsort((lists, distance))
        lists, distance = lists[order], distance[order]
        keep = min(most, max(least, int((distance <= distance[0] * ratio * ratio).sum())))
        return lists[:keep], distance[:keep]


def balanced_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """Splits the largest cluster in two, by a few 2-means rounds cut at the median, until there are `lists`; then refines by k-means rounds."""
    rng = np.random.default_rng(SEED)
    heap, count = [(-len(x), 0, np.arange(len(x)))], 1
    while len(heap) < lists:
        size, _, rows = heapq.heappop(heap)
        if size >= -1:
            heapq.heappush(heap, (0, count, rows))
            break
        y = x[rows]
        axis = y[rng.integers(len(y))] - y[rng.integers(len(y))] + rng.normal(size=y.shape[1]) * 1e-9
        for _ in range(4):
            side = y @ axis
            upper = side >= np.median(side)
            if upper.all() or not upper.any():
                break
            axis = y[upper].mean(0) - y[~upper].mean(0)
        order = np.argsort(y @ axis, kind="stable")
        for part in (order[: len(order) // 2], order[len(order) // 2 :]):
            heapq.heappush(heap, (-len(part), count := count + 1, rows[part]))
    points = np.array([x[rows].mean(0) for _, _, rows in sorted(heap, key=lambda h: h[1])])
    for _ in range(ROUNDS):
        nearest = np.concatenate([((points * points).sum(1) - 2 * part @ points.T).argmin(1) for part in np.array_split(x, -(-len(x) // 2_000))])
        n = np.bincount(nearest, minlength=len(points))
        sums = np.zeros_like(points)
        np.add.at(sums, nearest, x)
        points = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], points)
    return points


def neighbour_graph(points: np.ndarray) -> np.ndarray:
    """Each centroid's nearest others, and a ring through all of them so that every one can be reached."""
    n = len(points)
    k = min(NEIGHBOURS, n - 1)
    square, links = (points * points).sum(1), np.empty((n, k + 1), np.int64)
    for part in np.array_split(np.arange(n), -(-n // 512)):
        d = square - 2 * points[part] @ points.T
        d[np.arange(len(part)), part] = np.inf
        links[part, :k] = np.argsort(d, axis=1, kind="stable")[:, :k]
    links[:, k] = (np.arange(n) + 1) % n
    return links


def fit(vectors: DataFrame) -> Centroids | None:
    """Centroids from a bounded sample, the first rows by a hash: the square root of the vectors, LISTS at most."""
    n, norm = vectors.agg(F.count("*"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)))).first()
    if not n:
        return None
    picked = vectors.select(F.xxhash64("vec_id", F.lit(SEED), "embedding").alias("at"), F.transform("embedding", lambda v: v.cast("float")).alias("e"))
    rows = picked.filter(F.shiftrightunsigned("at", 11) / float(1 << 53) < min(1.0, 0.9 * SAMPLE / n)).orderBy("at", "e").limit(SAMPLE).toArrow()
    rows = rows.column("e") if rows.num_rows else picked.orderBy("at", "e").limit(1).toArrow().column("e")
    lengths = pa.compute.list_value_length(rows)
    dim = int(pd.Series(lengths.to_numpy()).mode()[0])
    x = rows.filter(pa.compute.equal(lengths, dim)).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    out = Centroids(x[:1], np.zeros((1, 1), np.int64), float(norm))
    points = balanced_centroids(out.lift(x), int(np.clip(round(n**0.5), 1, min(LISTS, len(x)))))
    out.points, out.links = points, neighbour_graph(points)
    return out


def placed(vectors: DataFrame, index: Centroids, query: bool) -> DataFrame:
    """vec_id, embedding, list, turn (from 0, the nearest list), one row per list that stores the vector or that the query visits."""
    dim, n = index.points.shape[1] - 1, len(index.points)
    ratio, least, most = (VISIT_RATIO, LEAST_VISITS, n) if query else (STORE_RATIO, 1, STORE_LISTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2_048):
                part = b.slice(at, 2_048)
                part = part.filter(pa.compute.equal(pa.compute.list_value_length(part.column("embedding")), dim))
                if not part.num_rows:
                    continue
                x = index.lift(part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), query)
                found = [index.near(v, ratio, least, most)[0] for v in x]
                rows = np.repeat(np.arange(len(x)), [len(f) for f in found])
                yield pa.record_batch([part.column("vec_id").take(pa.array(rows)), part.column("embedding").take(pa.array(rows)), pa.array(np.concatenate(found).astype(np.int32)), pa.array(np.concatenate([np.arange(len(f), dtype=np.int32) for f in found]))], ["vec_id", "embedding", "list", "turn"])

    kinds = dict(vectors.dtypes)
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, embedding {kinds['embedding']}, list int, turn int")


def search(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of vectors (vec_id, embedding), without the query itself."""
    vectors = vectors.select("vec_id", "embedding").filter(usable("embedding") & F.col("vec_id").isNotNull())
    queries = queries.select("vec_id", "embedding").filter(usable("embedding") & F.col("vec_id").isNotNull())
    kind, out = dict(vectors.dtypes)["vec_id"], "query_id {0}, vec_id {0}, score double"
    index = fit(vectors)
    if index is None:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    stored = scratch.write(placed(vectors, index, False).drop("turn"), "postings")
    asked = scratch.write(placed(queries, index, True), "visits")
    counted = lambda rows, name: rows.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias(name))
    parts = counted(stored, "parts").join(counted(asked, "askers"), "list")
    numbers = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    own = lambda name: F.pmod(F.xxhash64("vec_id"), F.col(name)).cast("int")
    stored = stored.join(parts, "list").select("list", own("parts").alias("part"), numbers("askers").alias("asker"), "vec_id", "embedding")
    asked = asked.join(parts, "list").select("list", numbers("parts").alias("part"), own("askers").alias("asker"), "vec_id", "embedding", "turn")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": left.column("vec_id").slice(0, 0), "vec_id": left.column("vec_id").slice(0, 0), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        matrix = lambda t: t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        ids, asking = right.column("vec_id").to_numpy(), left.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, candidates, got = ids[order], matrix(right)[order], []
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        everyone, bounds = matrix(left), left.column("bound").to_numpy()
        for at in range(0, len(asking), 256):
            scores = everyone[at : at + 256] @ candidates.T
            scores[asking[at : at + 256, None] == ids[None]] = -np.inf
            for i, (q, row) in enumerate(zip(asking[at : at + 256], scores)):
                by_id = np.maximum.reduceat(row, starts) if len(starts) < len(row) else row  # rows of one vec_id are one candidate
                least = np.partition(by_id, len(by_id) - k)[len(by_id) - k] if len(by_id) > k else -np.inf
                keep = np.flatnonzero((row >= least - 1e-9 * (1 + abs(least))) & np.isfinite(row)) if np.isfinite(least) else np.flatnonzero(np.isfinite(row))
                exact = (candidates[keep] * everyone[at + i]).sum(1)  # equal vectors get equal scores, whatever the block
                keep, exact = keep[exact >= bounds[at + i]], exact[exact >= bounds[at + i]]
                best = np.lexsort((ids[keep], -exact))
                best = best[np.sort(np.unique(ids[keep][best], return_index=True)[1])][:k]
                got.append((np.full(len(best), q), ids[keep][best], exact[best]))
        return pa.table({n: np.concatenate([g[i] for g in got]) for i, n in enumerate(("query_id", "vec_id", "score"))})

    def visit(asking: DataFrame) -> DataFrame:
        asking = asking.select("list", "part", "asker", "vec_id", "embedding", "bound")
        key = ("list", "part", "asker")
        return asking.groupBy(*key).cogroup(stored.groupBy(*key)).applyInArrow(scored, out.format(kind))

    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = visit(asked.filter(F.col("turn") < FIRST_VISITS).withColumn("bound", F.lit(float("-inf"))))
    first = scratch.write(first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "first")
    bounds = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    rest = asked.filter(F.col("turn") >= FIRST_VISITS).join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    found = first.drop("rank").unionByName(visit(rest)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 20 = 0"), Scratch(spark, "op8"))


QUERIES = {"op8_nearest": op8_nearest}
ORACLES: dict[str, str] = {}
