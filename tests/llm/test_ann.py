import numpy as np
import pytest

from lodestone.llm import ann
from lodestone.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, list int, score double"


def brute(x, ids, queries, k):
    out = {}
    for q in queries:
        s = x @ x[q]
        s[ids == ids[q]] = -np.inf
        order = np.lexsort((ids, -s))[:k]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in order if np.isfinite(s[i])]
    return out


def found(df, k=20):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(c) for c in v], 0, 7, 0.1) for i, v in zip(ids, x.astype(np.float32))], SCHEMA)


@pytest.mark.parametrize("norms", [False, True])
def test_recall_and_exact_scores(spark, monkeypatch, norms):
    monkeypatch.setattr(ann, "PART", 100)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 24)) * 0.7
    x *= rng.uniform(0.3, 3, (3000, 1)) if norms else 1 / np.linalg.norm(x, axis=1, keepdims=True)
    x, ids = x.astype(np.float32).astype(np.float64), np.arange(3000)
    vectors = frame(spark, x, ids)
    got = found(ann.search(vectors, vectors.filter("vec_id % 50 = 0"), Scratch(spark, "t")))
    expected = brute(x, ids, range(0, 3000, 50), 20)
    assert got.keys() == expected.keys() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) / 20 for q in expected])
    assert recall >= 0.9
    for q, rows in got.items():
        assert all(s == pytest.approx(float(x[i] @ x[q]), abs=1e-9) for i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, size):
    """Every row whose id is divisible by 50 against all rows, at two sizes."""
    vectors = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    rows = vectors.filter(ann.usable("embedding")).select("vec_id", "embedding").toArrow()
    ids, x = rows.column("vec_id").to_numpy(), np.array(rows.column("embedding").to_pylist(), np.float64)
    expected = brute(x, ids, np.flatnonzero(ids % 50 == 0), 20)
    got = found(ann.search(vectors, vectors.filter("vec_id % 50 = 0"), Scratch(spark, "t")))
    assert got.keys() == expected.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) / 20 for q in expected]) >= 0.95


def test_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 50)
    rng = np.random.default_rng(8)
    x = np.concatenate([np.tile(rng.normal(size=8), (400, 1)), rng.normal(size=(200, 8))]).astype(np.float32).astype(np.float64)
    ids = rng.permutation(600)
    vectors = frame(spark, x, ids)
    got = found(ann.search(vectors, vectors.filter("vec_id = %d" % ids[0]), Scratch(spark, "t")))[int(ids[0])]
    assert [i for i, _ in got] == sorted(int(i) for i in ids[1:400])[:20] or got[0][1] > float(x[0] @ x[0])


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [float("inf"), 0.0]), (6, []), (20, [0.5, 0.5]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (None, [1.0, 2.0]), (40, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame([(*r, 0, 1, 0.0) for r in rows], SCHEMA)
    got = found(ann.search(vectors, vectors.filter("vec_id % 20 = 0"), Scratch(spark, "t")))
    assert got == {0: [(7, 1.0), (20, 0.5)], 20: [(7, 1.0), (0, 0.5)]}
    assert ann.search(vectors.limit(0), vectors.limit(0), Scratch(spark, "t")).count() == 0
    alone = vectors.filter("vec_id = 0")
    assert ann.search(alone, alone, Scratch(spark, "t")).count() == 0


def test_graph_walk_equals_a_scan_for_a_wide_ratio():
    rng = np.random.default_rng(9)
    points = rng.normal(size=(300, 6))
    index = ann.Centroids(points, ann.neighbour_graph(points), 1.0)
    for _ in range(20):
        q = rng.normal(size=6)
        lists, d = index.near(q, 1.0, 10, 10)
        true = np.sort(((points - q) ** 2).sum(1))[:10]
        assert (np.isclose(d[:, None], true[None]).any(1)).mean() >= 0.8 and np.isclose(d[0], true[0])


def test_clusters_are_balanced():
    x = np.random.default_rng(10).normal(size=(1000, 5))
    points = ann.balanced_centroids(x, 16)
    sizes = np.bincount(((x[:, None] - points[None]) ** 2).sum(2).argmin(1), minlength=16)
    assert len(points) == 16 and sizes.max() < 6 * sizes.mean()


def test_repeated_rows_are_one_candidate(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 8)).astype(np.float32).astype(np.float64)
    vectors = frame(spark, np.repeat(x, 25, axis=0), np.repeat(np.arange(60), 25))
    got = found(ann.search(vectors, frame(spark, x[:3], np.arange(3)), Scratch(spark, "t")))
    expected = brute(x, np.arange(60), range(3), 20)
    assert {q: [i for i, _ in rows] for q, rows in got.items()} == {q: [i for i, _ in rows] for q, rows in expected.items()}


def test_all_lists_within_the_ratio_are_visited(spark):
    points = np.eye(101)[:100]  # lists at equal distances from a query between them
    index = ann.Centroids(points, ann.neighbour_graph(points), 1.0)
    query = spark.createDataFrame([(1, [0.1] * 100)], "vec_id long, embedding array<float>")
    assert ann.placed(query, index, True).count() == 100
