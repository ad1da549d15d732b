"""Mixing sources to target weights, in DataFrame functions only.

Each source's words are packed into fixed-length blocks. Every output shard draws how many of its slots each source
fills: the whole part of its expected share for certain, and the shard's remaining slots by a multinomial draw over the fractions
(residual resampling), so that the draws decide the sources' totals, which stay within a few blocks of their targets. The k-th
slot of a source, counted over the shards, maps through a pseudorandom permutation of that source's block indices, and slots meet
blocks by a join on (source, block). A source gets two passes over its blocks at most; a draw beyond that is left out.

Everything follows from hashes of row contents, never from where a row lies: reruns and repartitioned inputs agree.

Edge cases: a null text has no words and a document without words takes none; null is a source of its own and sorts last; a
repeated row is one more document, told apart by its number among its equals; rows of one doc_id, or of none, are spread by their
texts' hashes; a very long text is cut into blocks like any other; an empty table gives no rows; columns other than doc_id, text
and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, few, fresh, n_words, table

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
BLOCK_WORDS, SHARD_SLOTS, ROUNDS, SEED = 64, 16_384, 10, 20_011
#: Documents in one ordered run of a source, and slots in one task, about.
RUN_DOCS, TASK_SLOTS = 2_000, 100_000
#: A remainder of a copy is kept in units of 2 ** -UNIT_BITS.
UNIT_BITS = 32


def permuted(x: Column, size: Column, key: Column, inverse: bool = False) -> Column:
    """Swap-or-not permutation of [0, size): in each round x and key_r - x change places or stay, by a hash of the larger."""
    rounds = range(ROUNDS)[::-1] if inverse else range(ROUNDS)

    def step(v: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r, F.lit(SEED)), size) - v, size)
        return F.when(F.xxhash64(key, r, F.greatest(v, partner)).bitwiseAND(F.lit(1).cast("long")) == 1, partner).otherwise(v)

    return F.aggregate(F.array(*[F.lit(r) for r in rounds]), x.cast("long"), step)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size -> the same with target. One row per source.

    Water filling: with sources ordered by cap / weight, a source is full when the level that the
    remaining amount gives the remaining weights reaches its cap; the others share by weight.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    everything = W.partitionBy()
    return (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumns({"weight": weight, "most": F.col("source_size") * cap})
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumns(
            {
                "left": F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
                "weights_left": F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)),
            }
        )
        .withColumn("level", F.col("left") / F.col("weights_left"))
        .withColumn("level", F.min_by(F.when(F.col("level") < F.col("ratio"), F.col("level")), F.when(F.col("level") < F.col("ratio"), F.col("ratio"))).over(everything))
        .withColumn("target", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("level"))))
        .select("source", "source_size", "target")
    )


def quotas(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """source, blocks, short (words of the last block), expected slots: as many blocks as hold target words on average."""
    n = F.col("source_size")
    blocks = F.ceil(n / block).cast("long")
    return targets.filter((n > 0) & (F.col("target") > 0)).select("source", blocks.alias("blocks"), (n - (blocks - 1) * block).alias("short"), (F.col("target") * blocks / n).alias("expected"))


def shard_counts(plan: DataFrame, shard_slots: int = SHARD_SLOTS, tasks: int = 8) -> DataFrame:
    """shard, source, blocks, short, n: the slots of each shard that a source fills. The table of sources goes along as one array."""
    one = F.struct(F.col("source").isNull().alias("last"), "source", "blocks", "short", "expected")
    whole = plan.agg(F.sort_array(F.collect_list(one)).alias("sources"), F.sum("expected").alias("sum"))
    total = F.round("sum").cast("long")
    shards = F.greatest(F.lit(1), F.ceil(total / shard_slots)).cast("long")
    rows = whole.filter("sum > 0").select("sources", "sum", total.alias("total"), shards.alias("shards")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).repartition(tasks, "shard")
    upto = lambda k: F.floor(k * F.col("total") / F.col("shards")).cast("long")
    rows = rows.withColumn("size", upto(F.col("shard") + 1) - upto(F.col("shard")))
    rows = rows.withColumn("want", F.transform("sources", lambda x: x["expected"] / F.col("sum") * F.col("size")))
    rows = rows.withColumn("rest", (F.col("size") - F.aggregate("want", F.lit(0).cast("long"), lambda s, x: s + F.floor(x).cast("long"))).cast("int"))
    running = F.aggregate("want", F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x - F.floor(x))))
    rows = rows.withColumn("upto", running)
    thrown = F.transform(F.sequence(F.lit(1), F.col("rest")), lambda i: F.shiftrightunsigned(F.xxhash64(F.col("shard"), i, F.lit(SEED)), 11) / float(1 << 53) * F.element_at("upto", -1))
    rows = rows.withColumn("thrown", F.when(F.col("rest") > 0, thrown).otherwise(F.array().cast("array<double>")))
    drawn = F.transform("want", lambda x, i: F.floor(x).cast("long") + F.size(F.filter("thrown", lambda u: (u >= F.get("upto", i)) & (u < F.get("upto", i + 1)))))
    rows = rows.select("shard", F.explode(F.arrays_zip(F.col("sources").alias("source"), drawn.alias("n"))).alias("x"))
    return rows.select("shard", "x.source.source", "x.source.blocks", "x.source.short", "x.n").filter("n > 0")


def slots(counts: DataFrame, block: int = BLOCK_WORDS, tasks: int = 8) -> DataFrame:
    """shard, source, slot (of the source, from 0), block, take (its words): which block fills each output slot.

    The few rows of counts become very many; `tasks` keeps them from being dealt to as few tasks as their own size suggests.
    """
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = counts.withColumn("from_slot", before).withColumn("n", F.least("n", F.col("blocks") * 2 - F.col("from_slot"))).filter("n > 0").repartition(tasks, "source", "shard")
    laid = placed.withColumn("slot", F.explode(F.sequence(F.col("from_slot"), F.col("from_slot") + F.col("n") - 1)))
    laid = laid.withColumn("block", permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.xxhash64("source")))
    return laid.select("shard", "source", "slot", "block", F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(F.lit(block).cast("long")).alias("take"))


ROW = ("doc_id", "source", "size", "mark", "sign")


def mix_rows(rows: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """rows (ROW; mark and sign are hashes that tell different rows apart) with copy (a row's number among its equals), source_size,
    target and taken.

    A source's documents follow each other in hash order; prefix sums go over runs of (source, hash bucket) first, so that a
    hot source is never ordered in one task.
    """
    base = rows.groupBy(*ROW).agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    base = scratch.write(base, "sizes")
    n, words = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    runs, tasks = max(64, n // RUN_DOCS), max(8, int(words * share) // block // TASK_SLOTS)
    base = base.withColumn("run", F.pmod(F.xxhash64("mark", "copy", F.lit(SEED)), F.lit(runs)))
    per_run = base.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    sources = scratch.write(source_targets(per_run.groupBy("source").agg(F.sum("run_size").alias("source_size")), weights, share, cap), "targets")
    before = F.sum("run_size").over(W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1))
    starts = per_run.withColumn("run_start", F.coalesce(before, F.lit(0).cast("long"))).alias("a")
    starts = starts.join(sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "a.run", "run_start", "source_size", "target")
    within = W.partitionBy("source", "run").orderBy("mark", "sign", "copy").rowsBetween(W.unboundedPreceding, 0)
    placed = base.withColumn("to", F.sum("size").over(within)).alias("a").join(starts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.run") == F.col("b.run")))
    placed = scratch.write(placed.select("doc_id", "a.source", "size", "mark", "sign", "copy", "source_size", "target", (F.col("run_start") + F.col("to")).alias("to")), "placed")
    size = F.lit(block).cast("long")
    at = placed.filter("size > 0").withColumn("at", F.col("to") - F.col("size"))
    parts = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / size).cast("long"), F.floor((F.col("to") - 1) / size).cast("long"))))
    words_of = F.least("to", (F.col("block") + 1) * size) - F.greatest("at", F.col("block") * size)
    parts = parts.select("source", "to", "block", words_of.alias("words"))
    counts = scratch.write(shard_counts(quotas(sources, block), shard_slots, tasks), "counts")
    used = slots(counts, block, tasks).groupBy("source", "block").agg(F.count("*").alias("times"))
    used = used.select(F.col("source").alias("source_"), F.col("block").alias("block_"), "times").hint("merge")
    met = parts.join(used, F.col("source").eqNullSafe(F.col("source_")) & (F.col("block") == F.col("block_")))
    taken = met.groupBy("source", "to").agg(F.sum(F.col("words") * F.col("times")).alias("taken")).alias("b")  # a row with words is told by where it ends
    a = placed.alias("a")
    out = a.join(taken, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.to") == F.col("b.to")) & (F.col("a.size") > 0), "left")
    return out.select("doc_id", "a.source", "size", "mark", "sign", "copy", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mix(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, text, source). Texts are read once."""
    marks = [F.xxhash64("doc_id", "source", "text", F.lit(s)).alias(c) for s, c in ((SEED, "mark"), (SEED + 1, "sign"))]
    return mix_rows(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *marks), scratch, **how).drop("mark", "sign", "copy")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def whole_copies(mixed: DataFrame, scratch: Scratch) -> DataFrame:
    """mark, sign, copies for the rows with words of mixed (of mix_rows): floor(taken / size), and one more by a seeded systematic draw.

    A source's remainders follow each other by size; a row gets one more copy where their running sum passes a whole number, so
    that a source's words stay within its largest document of those taken. Sums go over (source, size, run) first.
    """
    size, whole = F.col("size"), F.floor(F.col("taken") / F.col("size")).cast("long")
    drawn = mixed.filter("size > 0").withColumn("whole", whole)
    drawn = drawn.select("mark", "sign", "copy", "source", "size", "whole", F.floor((F.col("taken") - F.col("whole") * size) / size * float(1 << UNIT_BITS)).cast("long").alias("rest"))
    n = mixed.count()
    drawn = scratch.write(drawn.withColumn("run", F.pmod(F.xxhash64("mark", "copy", F.lit(SEED)), F.lit(max(64, n // RUN_DOCS)))), "drawn")
    unit = lambda c: F.pmod(c, F.lit(1 << UNIT_BITS))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    runs = scratch.write(drawn.groupBy("source", "size", "run").agg(unit(F.sum("rest")).alias("run_rest")), "draw_runs")
    sizes = runs.groupBy("source", "size").agg(unit(F.sum("run_rest")).alias("size_rest"))
    sizes = sizes.select("source", "size", unit(before("size_rest", W.partitionBy("source").orderBy("size")) + unit(F.xxhash64("source", F.lit(SEED)))).alias("size_start")).alias("b")
    runs = runs.withColumn("run_start", before("run_rest", W.partitionBy("source", "size").orderBy("run"))).alias("a")
    starts = runs.join(sizes, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")))
    starts = starts.select("a.source", "a.size", "run", unit(F.col("run_start") + F.col("size_start")).alias("start")).alias("b")
    upto = F.sum("rest").over(W.partitionBy("source", "size", "run").orderBy("mark", "sign", "copy").rowsBetween(W.unboundedPreceding, 0))
    placed = drawn.withColumn("upto", upto).alias("a").join(starts, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.run") == F.col("b.run")))
    to = F.col("start") + F.col("upto")
    more = F.shiftright(to, UNIT_BITS) - F.shiftright(to - F.col("rest"), UNIT_BITS)
    return placed.groupBy("mark", "sign").agg(F.sum(F.col("whole") + more).cast("int").alias("copies"), F.count("*").alias("rows"))


def mixed_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs, each row in whole copies, drawn so that each source's words meet those that the mix takes; a row without words once.

    Equal rows stand for each other: the first of them is repeated as often as all of them are taken.
    """
    names = docs.columns
    mark, sign, copies, size = (fresh(c, names) for c in ("mix_mark", "mix_sign", "mix_copies", "mix_size"))
    rest = F.to_json(F.struct(F.lit(0).alias("_"), *[c for c in names if c != "text"]))
    told = docs.withColumns({mark: F.xxhash64(rest, "text", F.lit(SEED)), sign: F.xxhash64(rest, "text", F.lit(SEED + 1)), size: n_words(F.col("text"))})
    rows = told.select("doc_id", "source", F.col(size).alias("size"), F.col(mark).alias("mark"), F.col(sign).alias("sign"))
    times = whole_copies(scratch.write(mix_rows(rows, scratch), "mixed"), scratch).filter("copies > 0")
    times = scratch.write(times.select(F.col("mark").alias(mark), F.col("sign").alias(sign), F.col("copies").alias(copies), "rows"), "times")
    more = lambda met: met.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*names)
    single = more(told.join(times.filter("rows = 1").drop("rows"), [mark, sign]))
    equals = told.join(few(times.filter("rows > 1").drop("rows")), [mark, sign]).groupBy(mark, sign).agg(F.first(F.struct(*names)).alias("row"), F.first(copies).alias(copies))
    equals = more(equals.select("row.*", copies))
    return single.unionByName(equals).unionByName(told.filter(F.col(size) == 0).select(*names))


QUERIES = {"op3_mixing": op3_mixing}
ORACLES: dict[str, str] = {}
