"""Ball-tree filtering against k-means over all distances."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import centroids as cc
from lodestone.llm.common import Scratch

from .support import agrees


def plain(points, start, rounds):
    z = [list(map(int, p)) for p in start]
    away = lambda p: [sum((a - b) ** 2 for a, b in zip(p, c)) for c in z]
    near = lambda p: min(range(len(z)), key=lambda c: away(p)[c])
    for _ in range(rounds):
        own = [near(p) for p in points]
        for c in range(len(z)):
            mine = [p for p, o in zip(points, own) if o == c]
            if mine:
                z[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(near(p), min(away(p))) for p in points], z


@pytest.mark.parametrize("spread, scale", [(0.02, 1), (1.0, 1), (0.0, 1), (0.3, 1 << 14)])
def test_filtering_is_exact(spread, scale):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 16)) * 1000 * scale
    points = np.floor(middles[rng.integers(0, 6, 700)] + rng.normal(size=(700, 16)) * 1000 * scale * spread).astype(np.int64)
    points = np.concatenate([points, points[:40], np.zeros((3, 16), np.int64)])
    z = np.concatenate([points[:5], points[:1], np.floor(middles[:2]).astype(np.int64)])
    tree, order = cc.ball_tree(points)
    assert (np.sort(order) == np.arange(len(points))).all() and (tree.points == points[order]).all()
    f = cc.filtered(tree, z)
    got = np.full(len(points), -1)
    for node, c in zip(f.nodes, f.of_nodes):
        assert (got[tree.first[node] : tree.last[node]] == -1).all()
        got[tree.first[node] : tree.last[node]] = c
    got[f.rows] = f.of_rows
    brute = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c)) for c in z] for p in tree.points], object)
    assert got.tolist() == [min(range(len(z)), key=lambda c: row[c]) for row in brute.tolist()]
    assert (cc.squared_distances(tree.points, z) == brute.astype(np.int64)).all()
    if spread < 0.1:  # with a centroid a group, whole balls go
        assert len(cc.filtered(tree, np.floor(middles).astype(np.int64)).rows) < len(points) / 4


def test_trees_hold_radius_count_and_sum():
    points = np.random.default_rng(1).integers(-500, 500, (1000, 8))
    tree, _ = cc.ball_tree(points)
    for i in range(len(tree.first)):
        own = tree.points[tree.first[i] : tree.last[i]]
        assert (tree.sums[i] == own.sum(axis=0)).all()
        assert np.sqrt(((own - own.mean(axis=0)) ** 2).sum(axis=1)).max() <= tree.radius[i]
        if tree.left[i] >= 0:
            assert tree.last[tree.left[i]] - tree.first[tree.left[i]] + tree.last[tree.right[i]] - tree.first[tree.right[i]] == len(own)
        else:
            assert len(own) <= cc.LEAF or tree.radius[i] < 1e-5


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cluster string")


def test_rounds_equal_plain_k_means(spark):
    rng = np.random.default_rng(2)
    data = np.repeat(rng.normal(size=(150, 4)), 3, axis=0).astype(np.float32)
    rows = [(i // 2, v.tolist(), 1, "x") for i, v in enumerate(data)]
    odd = [(900, None, 1, "x"), (901, [], 1, "x"), (902, [1.0, 2.0, 3.0], 1, "x"), (903, [1.0, None, 2.0, 3.0], 1, "x"), (904, [1.0, float("nan"), 2.0, 3.0], 1, "x"), (905, [float("inf"), 1.0, 2.0, 3.0], 1, "x"), (906, [1e30, 0.0, 0.0, 0.0], 1, "x"), (None, [0.5, 0.25, -0.1, 0.0], 1, "x")]
    whole = cc.integer_vectors(vectors(spark, rows + odd).repartition(3), dimension=4)
    found, z = cc.cluster(whole, Scratch(spark, "t"), k=8, rounds=4)
    kept = [(r["id"], r["point"]) for r in whole.collect()]
    assert len(kept) == len(rows) + 1
    assert {tuple(p) for i, p in kept if i is None} == {(512, 256, -103, 0)}
    hashed = sorted(((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest(), p) for i, p in kept))
    own, middle = plain([p for _, p in kept], [p for _, _, p in hashed[:8]], 4)
    assert z.tolist() == middle
    assert sorted(map(str, found.collect())) == sorted(f"Row(id={i}, cluster={c}, distance={d})" for (i, _), (c, d) in zip(kept, own))


def test_few_and_no_vectors(spark):
    none = cc.integer_vectors(vectors(spark, [(1, None, 1, "x")]), dimension=4)
    found, z = cc.cluster(none, Scratch(spark, "t"))
    assert found.count() == 0 and len(z) == 0
    two = cc.integer_vectors(vectors(spark, [(1, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x")]), dimension=2)
    found, z = cc.cluster(two, Scratch(spark, "t"))
    assert {tuple(r) for r in found.collect()} == {(1, 0, 0)} and z.tolist() == [[1024, 0], [1024, 0]]  # of equal centroids the later gets nothing


def test_blocks_cut_large_partitions(spark):
    many = spark.range(10_000).coalesce(1).select("id", F.array(F.col("id") % 97, F.col("id") % 89).alias("point"))
    trees = cc.write_trees(many, Scratch(spark, "t"))
    assert sorted(r[0] for r in trees.select(F.size("ids")).collect()) == [10_000 - 2 * cc.BLOCK, cc.BLOCK, cc.BLOCK]
    assert trees.select(F.explode("ids").alias("i")).distinct().count() == 10_000


def test_query_equals_its_sql(spark, duck):
    agrees(spark, duck, "op12_centroid_clustering", "/root/testdata/sf0.001")
