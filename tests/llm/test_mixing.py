import math
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import mixing
from lodestone.llm.common import Scratch

from .support import documents, empty


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0) -> dict:
    """Excess over the cap shared again by weight, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def words(text) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("case", ["odd", "table"])
def test_mix_holds_its_contract(spark, case):
    docs = documents(spark) if case == "odd" else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs, Scratch(spark, "t")).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    sizes: dict = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    expected = targets(sizes)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r["doc_id"] or -1, words(r["text"])) for r in rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 4 * mixing.BLOCK_WORDS + 0.01 * expected[s]


def test_mix_is_the_same_again(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id < 20")).unionByName(docs.filter("doc_id between 20 and 30").withColumn("doc_id", F.lit(None).cast(dict(docs.dtypes)["doc_id"])))
    again = docs.repartition(7)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(mixing.mix(docs, Scratch(spark, "t"))) == rows(mixing.mix(again, Scratch(spark, "t")))
    assert rows(mixing.mixed_documents(docs, Scratch(spark, "t"))) == rows(mixing.mixed_documents(again, Scratch(spark, "t")))


def spark_hash(*values):
    """The engine's xxhash64: each value's hash is the next one's seed; null changes nothing."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q" if isinstance(v, Long) else "<i", v), h)
    return h - (1 << 64) if h >> 63 else h


class Long(int):
    """A 64-bit value."""


def permuted(x, n, key):
    for r in range(mixing.ROUNDS):
        partner = (spark_hash(Long(key), r, mixing.SEED) % n - x) % n
        if spark_hash(Long(key), r, Long(max(x, partner))) & 1:
            x = partner
    return x


@pytest.mark.parametrize("shard_slots", [16_384, 37])
def test_taken_equals_a_slow_run(spark, shard_slots):
    """Blocks, draws, permutations and words, one by one."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").collect()]
    rows += rows[:3] + [(None, "a text of no one", None), (None, "", "src1")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), Scratch(spark, "t"), shard_slots=shard_slots).collect()
    marked = sorted(((spark_hash(None if d is None else Long(d), s, t, mixing.SEED), spark_hash(None if d is None else Long(d), s, t, mixing.SEED + 1), d, t, s) for d, t, s in rows), key=lambda r: r[:2])
    n_runs, copies, order = max(64, len(rows) // mixing.RUN_DOCS), {}, []
    for mark, sign, d, t, s in marked:
        copies[mark, sign] = copies.get((mark, sign), 0) + 1
        order.append((spark_hash(Long(mark), Long(copies[mark, sign]), mixing.SEED) % n_runs, mark, sign, copies[mark, sign], d, t, s))
    sizes, block = {}, mixing.BLOCK_WORDS
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    target = targets(sizes)
    names = sorted((s for s in sizes if sizes[s]), key=lambda s: (s is None, s or ""))
    blocks = {s: -(-sizes[s] // block) for s in names}
    expected = [target[s] * blocks[s] / sizes[s] for s in names]
    total = round(sum(expected))
    shards, drawn = max(1, -(-total // shard_slots)), dict.fromkeys(names, 0)
    for k in range(shards):
        size = (k + 1) * total // shards - k * total // shards
        want = [e / sum(expected) * size for e in expected]
        upto = [0.0]
        for w in want:
            upto.append(upto[-1] + w - math.floor(w))
        thrown = [((spark_hash(Long(k), i, mixing.SEED) % (1 << 64)) >> 11) / (1 << 53) * upto[-1] for i in range(1, size - sum(map(math.floor, want)) + 1)]
        for i, s in enumerate(names):
            drawn[s] += math.floor(want[i]) + sum(upto[i] <= u < upto[i + 1] for u in thrown)
    taken = []
    for s in sizes:
        used = {}
        for slot in range(min(drawn.get(s, 0), 2 * blocks.get(s, 0))):
            b = permuted(slot % blocks[s], blocks[s], spark_hash(s))
            used[b] = used.get(b, 0) + 1
        at = 0
        for _, _, _, _, d, t, _ in sorted((x for x in order if x[6] == s), key=lambda x: x[:4]):
            taken.append((d, s, words(t), sum(used.get(w // block, 0) for w in range(at, at + words(t)))))
            at += words(t)
    assert sorted(map(repr, taken)) == sorted(repr((r["doc_id"], r["source"], r["size"], r["taken"])) for r in got)


def test_draws_decide_the_totals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sums = lambda n: {r["source"]: r["t"] for r in mixing.mix(docs, Scratch(spark, "t"), shard_slots=n).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert sums(16) != sums(16_384)


def test_mix_of_nothing(spark):
    assert mixing.mix(empty(spark), Scratch(spark, "t")).count() == 0
    assert mixing.mixed_documents(empty(spark), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(spark, n):
    key, size = F.lit(99).cast("long"), F.lit(n).cast("long")
    out = spark.range(n).select("id", mixing.permuted(F.col("id"), size, key).alias("p")).select("id", "p", mixing.permuted(F.col("p"), size, key, inverse=True).alias("back")).collect()
    assert sorted(r["p"] for r in out) == list(range(n)) and all(r["back"] == r["id"] for r in out)


def test_slots_use_each_block_at_most_twice(spark):
    sizes = spark.createDataFrame([("a", 10_000), ("b", 300), (None, 70), ("c", 0)], "source string, source_size long")
    slots = mixing.slots(mixing.shard_counts(mixing.quotas(mixing.source_targets(sizes)), 16)).collect()
    used: dict = {}
    for s in slots:
        used[s["source"], s["block"]] = used.get((s["source"], s["block"]), 0) + 1
    assert max(used.values()) <= 2
    per_shard: dict = {}
    for s in slots:
        per_shard.setdefault(s["shard"], set()).add(s["source"])
    assert len(per_shard) > 1 and any(len(v) > 1 for v in per_shard.values())


def test_mixed_documents_keeps_columns(spark):
    docs = documents(spark)
    out = mixing.mixed_documents(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns and out.filter("text is null").count() == 1


def test_emitted_words_meet_the_targets(spark):
    """Long documents are neither all dropped nor all kept: a source's words are within one document of its target."""
    lengths = [1_000 + 37 * (i % 90) for i in range(400)]
    docs = documents(spark, [(i, "w " * n, "en", ("hot", "b", "c", None)[min(3, i * 7 // 400)], 2 * n) for i, n in enumerate(lengths)])
    expected = {r["source"]: r["target"] for r in mixing.mix(docs, Scratch(spark, "t")).collect()}
    emitted = dict.fromkeys(expected, 0)
    for r in mixing.mixed_documents(docs, Scratch(spark, "t")).collect():
        emitted[r["source"]] += words(r["text"])
    assert len(expected) == 4 and all(abs(emitted[s] - expected[s]) <= max(lengths) + 4 * mixing.BLOCK_WORDS for s in expected), (emitted, expected)
