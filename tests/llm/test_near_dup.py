import random
import re

import duckdb
import numpy as np
import pytest

from lodestone.llm import near_dup
from lodestone.llm.common import Scratch

from .support import documents, empty


def brute_force(rows, size=4):
    """Every pair of texts, compared; rows of one doc_id are one node."""
    sets = []
    for doc_id, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append((doc_id, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if s and t and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def copies(rng, n_bases, n, words, change):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows = []
    for _ in range(n_bases):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(n):
            rows.append([w if rng.random() > change else rng.choice(vocabulary) for w in base])
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("n_bases, n, words, change", [(6, 30, 120, 0.012), (1, 150, 60, 0.02), (40, 3, 200, 0.01)])
def test_components_equal_brute_force(spark, n_bases, n, words, change):
    rows = copies(random.Random(n), n_bases, n, words, change)
    rows += [(1000 + i, t.upper().replace(" ", "\t ")) for i, t in rows[:5]] + [(2000, "three words here"), (2001, "Three  words\nhere"), (2002, "a b c d"), (2003, ""), (2004, " "), (2005, "x")]
    assert found(spark, rows, 4) == brute_force(rows)


def found(spark, rows, size):
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), size)
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect())


@pytest.mark.parametrize("limits", [("BLOCK", 8), ("BLOCK_SHINGLES", 200)])
def test_small_blocks_give_the_same(spark, monkeypatch, limits):
    rows = copies(random.Random(3), 2, 60, 60, 0.02)
    monkeypatch.setattr(near_dup, *limits)
    assert found(spark, rows, 5) == brute_force(rows, 5)


def test_texts_of_one_doc_id_are_one_node(spark):
    rows = [(3, "b b b b b b"), (5, "a one a two a"), (5, "b b b b b b"), (7, "a one a two a"), (9, "other words stand in here")]
    assert [x[::2] for x in found(spark, rows, 4)] == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 9)] == [x[::2] for x in brute_force(rows)]


def test_documents_that_share_a_passage(spark):
    """A bucket of texts that mostly aren't links: a common passage in texts of their own words, and chains of small changes."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(500)}" for _ in range(rng.randrange(8, 30))])) for i in range(150)]
    assert found(spark, rows, 4) == brute_force(rows)


def test_documents_equal_brute_force(spark):
    """The rows of documents whose id is divisible by 5, against each other."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 5 = 0").select("doc_id", "text").collect()]
    assert found(spark, rows, 4) == brute_force(rows)


def test_sketches_of_pairs_at_the_threshold_agree_enough():
    """Recall of the sketch filter: pairs of similarity 0.8 agree in LEAST_EQUAL minhashes."""
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(2_000):
        x = rng.integers(0, 2**63, 120).astype(np.uint64)
        sets += [np.unique(x[:108]), np.unique(np.concatenate([x[:96], x[108:]]))]  # 96 of 120 in common
    rows = near_dup.sketches(sets)
    assert ((rows[::2] == rows[1::2]).sum(1) >= near_dup.LEAST_EQUAL).all()
    keys = near_dup.table_keys(rows)
    assert (keys[::2] == keys[1::2]).any(1).all()


@pytest.mark.parametrize("n", [60, 120])
def test_sets_of_texts_with_a_common_passage_are_not_joined(spark, monkeypatch, n):
    """Two thirds of every text are one passage, in no pair enough for a link: rows whose sets are joined come from real candidates only."""
    rng, asked, sets_of = random.Random(12), [], near_dup.full_sets
    passage = [f"p{i}" for i in range(120)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(100_000)}" for _ in range(40)])) for i in range(n)]
    rows += [(n, f"{rows[-1][1]} and a few words more")]
    monkeypatch.setattr(near_dup, "full_sets", lambda ids, *rest: (asked.append(ids.count()), sets_of(ids, *rest))[1])
    assert found(spark, rows, 5) == brute_force(rows, 5)
    assert len(asked) == 2 and sum(asked) <= 2 * near_dup.HALVES**2, asked


@pytest.mark.parametrize("shared, own", [(4, 1), (8, 2), (40, 10), (120, 30), (400, 100), (2_000, 500)])
def test_links_pass_the_bins(shared, own):
    """Pairs at the threshold, with the other shingles on one side or on both; pairs of similarity 0.5 don't pass in large sets."""
    rng = np.random.default_rng(shared)
    for _ in range(300):
        x = rng.integers(0, 2**63, shared + own).astype(np.uint64)
        for cut in (own, own // 2):
            a, b = np.unique(x[: shared + cut]), np.unique(np.concatenate([x[:shared], x[shared + cut :]]))
            bins = near_dup.binned([a, b])
            assert near_dup.may_link(np.array([len(a)]), len(b), bins[:1], bins[1]).all()
    far = near_dup.binned([np.unique(x[: len(x) * 3 // 4]), np.unique(x[len(x) // 4 :])])
    assert shared < 40 or not near_dup.may_link(np.array([len(x) * 3 // 4]), len(x) - len(x) // 4, far[:1], far[1]).any()


def test_a_bin_keeps_its_smallest_hash():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 50, 3_000)]
    for s, row in zip(sets, near_dup.binned(sets)):
        least = {int(h) % near_dup.BINS: int(h) for h in s[::-1]}
        assert row.tolist() == [least[k] // near_dup.BINS % 255 + 1 if k in least else 0 for k in range(near_dup.BINS)]


def test_odd_rows(spark):
    out = near_dup.near_duplicates(documents(spark), Scratch(spark, "t")).collect()
    assert len(out) == 10
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[1]["n_shingles"] == 0 and by_id[1]["kept"] and by_id[2]["component_id"] == 2
    assert by_id[6]["component_id"] == 5 and not by_id[6]["kept"]
    assert by_id[None]["kept"] and by_id[None]["component_id"] is None
    assert by_id[4]["n_shingles"] == 4
    assert near_dup.near_duplicates(empty(spark), Scratch(spark, "t")).count() == 0


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 200)] + [(500, 300), (400, 500)]
    got = dict(map(tuple, near_dup.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()))
    assert all(got[i] == 0 for i in range(201)) and got[500] == got[400] == got[300] == 300


def test_minhash_shares_estimate_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    sk = near_dup.sketches([np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))])
    assert abs((sk[0] == sk[1]).mean() - 0.8) < 0.2
    assert near_dup.table_keys(sk).shape == (2, near_dup.HALVES**2)


def test_query_equals_its_sql(spark):
    path = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{path}/documents.parquet'")
    theirs = sorted(duck.execute(near_dup.ORACLES["op5_near_duplicates"]).fetchall())
    got = near_dup.op5_near_duplicates(spark, path)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and sorted(map(tuple, got.collect())) == theirs
