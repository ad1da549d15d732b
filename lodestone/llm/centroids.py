"""Centroid clustering: k-means on integer vectors, by filtering partition-local ball trees.

Each partition cuts its vectors into blocks of at most BLOCK and builds a metric tree over each: a node's ball has a centre (the mean of
its vectors), a radius, the number of its vectors and their integer sum; the trees are written once. A round goes down every tree level by level:
a ball whose farthest point is nearer to one centroid than its nearest point could be to any other goes to it whole, by count and sum; a leaf
that is left is decided vector by vector in exact integer arithmetic. Of a round only k counts and sums meet on the driver, whose size
depends on k and the dimension alone; a lost executor's blocks are read again from the written trees.

Component x becomes floor(SCALE * x). New centroids are the exact floor of sum / count; ties of distance go to the smaller centroid.

Edge cases: vectors that are null, have another number of components, or hold null, NaN or infinite ones take no part; neither do those
with a component beyond LARGEST in size, whose squared distances would not fit a long; a null vec_id takes part, its hash comes last as a starting centroid; rows of
one vec_id are vectors of their own (equal ones may start two equal centroids, of which the later gets nothing and stays); fewer vectors than k
give as many centroids; an empty table gives no rows; columns beyond the two named ones are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SCALE, DIMENSION, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, "3"
#: Largest component in size: 64 squared differences of twice SCALE times that fit a long.
LARGEST = 1 << 16
#: Vectors of one tree, and of one leaf, at most.
BLOCK, LEAF = 4096, 24
#: Components below this in size keep every term of a distance, 64 of them, below 2 ** 53, where float64 is exact.
EXACT = 1 << 21
#: What rounding may cost a distance between floats, at most, and in proportion.
SLACK = 1e-6


def integer_vectors(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", dimension: int = DIMENSION) -> DataFrame:
    """id and point (array of long) of the vectors that take part."""
    x = F.col(vector)
    fits = lambda e: F.coalesce(F.abs(e.cast("double")) <= LARGEST, F.lit(False))  # noqa: E731  false for null, NaN and infinity
    good = vectors.filter(F.coalesce((F.size(x) == dimension) & F.forall(x, fits), F.lit(False)))
    return good.select(F.col(id_).alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * SCALE)).alias("point"))


@dataclass
class Tree:
    """Vectors in the order of the leaves, and the nodes in the order they were made, so that parents come before children."""

    points: np.ndarray  # n x dimension, int64
    first: np.ndarray  # of each node, as places in points
    last: np.ndarray
    left: np.ndarray  # child nodes; -1 in leaves
    right: np.ndarray
    radius: np.ndarray  # not below the distance of any of the node's vectors from its centre
    sums: np.ndarray  # nodes x dimension, int64

    @functools.cached_property
    def centres(self) -> np.ndarray:
        return self.sums / (self.last - self.first)[:, None]


def ball_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The tree over points, and the order its points come in. A ball is cut between the two points that are farthest out."""
    order, spans, children, radius, sums = np.arange(len(points)), [(0, len(points))], [], [], []
    at = 0
    while at < len(spans):
        first, last = spans[at]
        own = points[order[first:last]]
        total = own.sum(axis=0)
        out = np.sqrt(((own - total / len(own)) ** 2).sum(axis=1))
        sums.append(total)
        radius.append(out.max() * (1 + SLACK) + SLACK)
        cut = last - first > leaf and out.max() > 0
        if cut:
            a = own[out.argmax()]
            b = own[((own - a).astype(np.float64) ** 2).sum(axis=1).argmax()]
            half = (last - first) // 2
            order[first:last] = order[first:last][np.argpartition((own - a) @ (b - a).astype(np.float64), half)]
            spans += [(first, first + half), (first + half, last)]
        children.append((len(spans) - 2, len(spans) - 1) if cut else (-1, -1))
        at += 1
    (first, last), (left, right) = np.array(spans).T, np.array(children).T
    return Tree(points[order], first, last, left, right, np.array(radius), np.array(sums)), order


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, points x centroids, int64."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT and points.shape[1] <= 64:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


@dataclass
class Filtered:
    nodes: np.ndarray  # balls that went whole
    of_nodes: np.ndarray  # to these centroids
    rows: np.ndarray  # points decided one by one
    of_rows: np.ndarray


def filtered(tree: Tree, centroids: np.ndarray) -> Filtered:
    """Every point of the tree once: in a ball that goes whole, or in a leaf."""
    z, at, leaves, whole, whole_to = centroids.astype(np.float64), np.array([0]), [], [], []
    while len(at):
        away = np.sqrt(((tree.centres[at][:, None, :] - z) ** 2).sum(axis=2))
        best = away.argmin(axis=1)
        nearest = away[np.arange(len(at)), best]
        away[np.arange(len(at)), best] = np.inf
        sure = nearest + 2 * tree.radius[at] < away.min(axis=1) * (1 - SLACK) - SLACK
        whole.append(at[sure])
        whole_to.append(best[sure])
        at = at[~sure]
        inner = tree.left[at] >= 0
        leaves.append(at[~inner])
        at = np.concatenate([tree.left[at[inner]], tree.right[at[inner]]])
    leaves = np.concatenate(leaves)
    rows = np.concatenate([np.arange(tree.first[i], tree.last[i]) for i in leaves]) if len(leaves) else np.zeros(0, np.int64)
    return Filtered(np.concatenate(whole), np.concatenate(whole_to), rows, squared_distances(tree.points[rows], centroids).argmin(axis=1))


TREE = "ids array<{id}>, points binary, first array<int>, last array<int>, left array<int>, right array<int>, radius array<double>, sums binary"


def write_trees(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """A row a tree over at most BLOCK of the vectors (id, point) of one partition."""
    schema = TREE.format(id=dict(vectors.dtypes)["id"])

    def row(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        tree, order = ball_tree(points)
        listed = lambda x: pa.array([x.tolist()], pa.list_(pa.float64() if x.dtype == np.float64 else pa.int32()))
        own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        return pa.record_batch([own, pa.array([tree.points.astype("<i8").tobytes()]), *map(listed, (tree.first, tree.last, tree.left, tree.right, tree.radius)), pa.array([tree.sums.astype("<i8").tobytes()])], ["ids", "points", "first", "last", "left", "right", "radius", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                held.append(batch.slice(at, BLOCK))
                n += len(held[-1])
                if n >= BLOCK:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    yield _block(whole.slice(0, BLOCK), row)
                    held, n = whole.slice(BLOCK).to_batches(), n - BLOCK
        if n:
            yield _block(pa.Table.from_batches(held), row)

    return scratch.write(vectors.mapInArrow(run, schema), "trees")


def _block(block: pa.Table, row) -> pa.RecordBatch:
    block = block.combine_chunks()
    points = block.column("point").chunk(0).flatten().to_numpy().reshape(len(block), -1)
    return row(block.column("id").chunk(0), points)


def _trees(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(len(batch)):
        cell = lambda c: batch.column(c)[i]
        first, last, left, right, radius = (cell(c).values.to_numpy() for c in ("first", "last", "left", "right", "radius"))
        points, sums = (np.frombuffer(cell(c).as_py(), "<i8") for c in ("points", "sums"))
        yield cell("ids").values, Tree(points.reshape(last[0], -1), first, last, left, right, radius, sums.reshape(len(first), -1))


def totals(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """Count and sum of each centroid's vectors; k x (dimension + 1) numbers a task, added up by Spark."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((k, d + 1), np.int64)
        for batch in batches:
            for _, tree in _trees(batch):
                f = filtered(tree, centroids)
                np.add.at(found, f.of_nodes, np.column_stack([tree.last[f.nodes] - tree.first[f.nodes], tree.sums[f.nodes]]))
                for c in range(k):
                    own = f.rows[f.of_rows == c]
                    found[c] += np.concatenate([[len(own)], tree.points[own].sum(axis=0)])
        cluster, part = np.nonzero(found)
        yield pa.record_batch([pa.array(cluster.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(found[cluster, part])], ["cluster", "part", "value"])

    sums = np.zeros((k, d + 1), object)
    for r in trees.mapInArrow(run, "cluster int, part int, value long").groupBy("cluster", "part").agg(F.sum("value").alias("value")).collect():
        sums[r["cluster"], r["part"]] = r["value"]
    return {c: (sums[c, 0], sums[c, 1:]) for c in range(k) if sums[c, 0]}


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster and squared distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _trees(batch):
                f, cluster = filtered(tree, centroids), np.zeros(len(ids), np.int32)
                for node, c in zip(f.nodes, f.of_nodes):
                    cluster[tree.first[node] : tree.last[node]] = c
                cluster[f.rows] = f.of_rows
                yield pa.record_batch([ids, pa.array(cluster), pa.array(((tree.points - centroids[cluster]) ** 2).sum(axis=1))], ["id", "cluster", "distance"])

    return trees.mapInArrow(run, f"id {dict(trees.dtypes)['ids'][6:-1]}, cluster int, distance long")


def starting_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose seeded ids hash lowest, in that order; equal hashes by the vector."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash"), "point")
    return np.array([r["point"] for r in hashed.orderBy(F.asc_nulls_last("hash"), "point").limit(k).collect()], np.int64)


def cluster(vectors: DataFrame, scratch: Scratch, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """id, cluster and distance of every vector (id, point), and the final centroids. Rounds that would change nothing are not run."""
    trees, centroids = write_trees(vectors, scratch), starting_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        new = centroids.copy()
        for c, (n, sums) in totals(trees, centroids).items():
            new[c] = [s // n for s in sums]
        if (new == centroids).all():
            break
        centroids = new
    return scratch.write(assigned(trees, centroids), "assigned"), centroids


def _chosen(values: dict[int, object], kind: str) -> Column:
    """The value of the row's cluster, out of one a cluster."""
    return F.get(F.array(*[F.lit(values.get(c)).cast(kind) for c in range(max(values, default=-1) + 1)]) if values else F.array().cast(f"array<{kind}>"), F.col("cluster"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(integer_vectors(table(spark, sf_dir, "embeddings")), Scratch(spark, "op12"))
    own = {r["cluster"]: r["sum"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}
    digests = {c: hashlib.sha256(",".join(map(str, z.tolist())).encode()).hexdigest() for c, z in enumerate(centroids)}
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", _chosen(own, "long").alias("cluster_inertia"), F.lit(sum(own.values())).cast("long").alias("inertia"), _chosen(digests, "string").alias("centroid_sha256"))


def oracle() -> str:
    """The rounds written out: exact distances of all vectors to all centroids, integer floors by remainder."""
    good = f"embedding IS NOT NULL AND len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x::DOUBLE) <= {LARGEST})) = {DIMENSION}"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS p FROM embeddings WHERE {good})",
        f"z0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h NULLS LAST, p) - 1)::INT AS c, p AS z FROM (SELECT sha256('{SEED}:' || vec_id) AS h, p FROM v) ORDER BY h NULLS LAST, p LIMIT {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        away = "list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - z[i]) * (p[i] - z[i])))::BIGINT"
        steps.append(f"a{i} AS MATERIALIZED (SELECT row_no, min(struct_pack(d := {away}, c := c)) AS best FROM v, z{i} GROUP BY row_no)")
        if i < ROUNDS:
            parts = f"SELECT best.c AS c, i, sum(p[i])::BIGINT AS s, count(*) AS n FROM a{i} JOIN v USING (row_no), range(1, {DIMENSION + 1}) AS r(i) GROUP BY ALL"
            steps.append(f"m{i} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS z FROM ({parts}) GROUP BY c)")
            steps.append(f"z{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.z, z{i}.z) AS z FROM z{i} LEFT JOIN m{i} USING (c))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, best.c AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(z{ROUNDS}.z, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN v USING (row_no) JOIN z{ROUNDS} ON z{ROUNDS}.c = best.c"""


QUERIES = {"op12_centroid_clustering": op12_centroid_clustering}
ORACLES = {"op12_centroid_clustering": oracle()}
