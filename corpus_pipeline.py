"""A training-corpus pipeline over documents: each stage takes what the one before kept.

Rejected documents go (toxicity), one document of each near-duplicate group stays, personal data is masked,
the mix repeats documents as often as it takes their words, and the last stage encodes them.

Edge cases: a null or empty text is scored like one without words, is nobody's duplicate, has nothing to mask, is kept
once by the mix and has no ids; a row without doc_id is nobody's duplicate; near-duplicates (five-word shingles, similarity 0.8)
leave the row of the smallest id, and one of rows with equal id and text; unlike texts under one id are documents of their own, and all stay; doc_id is
a whole number; columns beyond those of documents pass through unchanged, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, near_dup, pii, sentencepiece_spans, toxicity
from lodestone.llm.common import Scratch, bound_batches, few, fresh, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), Scratch(spark, "stage2"))
    name = fresh("toxicity", docs.columns)
    return toxicity.score(docs, model, name).filter(F.col(name) < 0.5).select(*docs.columns)


def near_nodes(docs: DataFrame, scratch: Scratch, node: str) -> tuple[DataFrame, DataFrame]:
    """docs with a node each: its doc_id, or a hash of id and text where an id stands on different texts; and near, owner: the doc_id of each such node."""
    owner = fresh("near_owner", [*docs.columns, node])
    texts = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    several = scratch.write(texts.filter("low <> high and doc_id is not null").select(F.col("doc_id").alias(owner)), "several")
    met = docs.join(few(several), F.col("doc_id") == F.col(owner), "left")
    met = met.withColumn(node, F.when(F.col(owner).isNull(), F.col("doc_id").cast("long")).otherwise(F.xxhash64("doc_id", "text")))
    owners = met.filter(F.col(owner).isNotNull()).select(F.col(node).alias("near"), F.col("doc_id").cast("long").alias("owner")).distinct()
    return met.select(*docs.columns, node), scratch.write(owners, "owners")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch, names = Scratch(spark, "stage5"), docs.columns
    node = fresh("near_node", names)
    noded, owners = near_nodes(docs, scratch, node)
    found = near_dup.near_duplicates(noded.select(F.col(node).alias("doc_id"), "text"), scratch).filter("n_shingles > 0 and doc_id is not null")
    found = scratch.write(found.groupBy(F.col("doc_id").alias("near"), "component_id").agg(F.count("*").alias("rows")), "found")
    owned = found.join(few(owners), "near", "left").withColumn("first", F.struct(F.coalesce("owner", "near").alias("owner"), "near"))
    kept = scratch.write(owned.groupBy("component_id").agg(F.min("first").alias("first")).select("first.near"), "kept")
    gone = found.join(kept, "near", "left_anti").select(F.col("near").alias(node))
    repeated = found.filter("rows > 1").join(kept, "near", "left_semi").select(F.col("near").alias(node))
    left = noded.join(few(gone), node, "left_anti")
    again = left.join(few(repeated), node, "left_semi")
    row = F.to_json(F.struct(*names))
    one = again.groupBy(node).agg(F.min_by(F.struct(*names), F.struct(F.xxhash64(row), row)).alias("row"))
    return left.join(few(repeated), node, "left_anti").select(*names).unionByName(one.select("row.*"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs, Scratch(spark, "stage10"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, Scratch(spark, "stage3"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the decoded text."""
    bound_batches(spark)
    return sentencepiece_spans.digests(docs, sentencepiece_spans.default_path(), ids=True)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("pii", mask_personal_data), ("mix", mix_sources), ("sentencepiece", encode)]
#: Learned scores, minhash tables, graph rounds and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each written to the shared folder and read again, the last one's rows returned."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.write(docs, name)
    return docs
