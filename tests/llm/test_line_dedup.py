"""Line dedup against a plain walk over all lines, and its SQL."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from lodestone.llm import line_dedup
from lodestone.llm.common import Scratch, spread_join

from . import support
from .support import agrees

SPACE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARED = "ÉTÉ: this Passage stands in a good many of the documents"


def plain(rows, least_chars=40, least_docs=5):
    """(id, text) -> the same with the lines that stay, and the numbers of lines."""
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for id_, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars and id_ is not None:
                holders[key(line)].add(id_)
    out = []
    for id_, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(holders[key(x)]) < least_docs or id_ == max(holders[key(x)])]
        out.append((id_, None if text is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def test_equals_a_plain_walk(spark):
    texts = [
        f"one\n{SHARED}\ntwo", f"  {SHARED.upper()}\t\r\n{SHARED}\n", f"{SHARED}", f"a\n\n{SHARED}x\nb", f"\n{SHARED.translate(LOWER)}\n\n", f"{SHARED.lower()}", f"z\n\x0b{SHARED}", None, "", "\n", "short line\n" * 3,
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(20 + i, "short line\nboth") for i in range(6)] + [(3, f"again\n{SHARED}"), (6, texts[6]), (None, f"no id\n{SHARED}"), (2, texts[2])]
    rows += [(40, support.LONG + "\n" + "\n".join(f"{i} " + SHARED for i in range(3000)))] + [(50 + i, f"{i % 7} {SHARED}\nown") for i in range(40)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_lines string").repartition(5)
    for least_docs in (5, 2):
        got = line_dedup.without_shared_lines(docs, Scratch(spark, "t"), least_docs=least_docs)
        assert got.columns == ["doc_id", "text", "n_lines", "n_lines_", "n_dropped"]
        assert sorted([(r[0], r[1], r[3], r[4]) for r in got.collect()], key=str) == plain(rows, least_docs=least_docs)


def test_a_hot_line_keeps_its_largest_document(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.lit("head"), F.lit("x" * 40), F.col("id").cast("string")).alias("text"))
    got = line_dedup.without_shared_lines(docs, Scratch(spark, "t"))
    assert [r["doc_id"] for r in got.filter("n_dropped = 0").collect()] == [2999]
    assert got.filter("n_dropped = 1").count() == 2999


def test_odd_and_empty_tables(spark):
    got = line_dedup.without_shared_lines(support.documents(spark), Scratch(spark, "t"))
    assert got.count() == len(support.ODD) and got.filter("n_dropped > 0").count() == 0
    assert line_dedup.without_shared_lines(support.empty(spark), Scratch(spark, "t")).count() == 0


def test_query_equals_its_sql(spark, duck):
    agrees(spark, duck, "op11_line_dedup", "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    digests = {(i, n, d, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, n, d in plain(rows)}
    assert {tuple(r) for r in line_dedup.op11_line_dedup(spark, "/root/testdata/sf0.01").collect()} == digests


def test_spread_join_is_a_join(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 50) for i in range(2000)], "row int, k int")
    side = rows.filter("k is null or k < 30").groupBy("k").agg(F.count("*").alias("n"), F.max("row").alias("top"))
    for how in ("left", "inner"):
        got = spread_join(rows, side, ["k"], "n", how)
        plain_ = rows.join(side.withColumnRenamed("k", "j"), F.expr("k <=> j"), how).select("row", "k", "n", "top")
        assert got.columns == plain_.columns and sorted(map(str, got.collect())) == sorted(map(str, plain_.collect()))
    # the third of the rows without a key lies in many salts
    assert "salt" in spread_join(rows, side, ["k"], "n")._jdf.queryExecution().optimizedPlan().toString()
