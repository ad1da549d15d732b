"""Line dedup: lines that many documents share go, but for the document of the largest id that holds them.

A line's key is the line without white space at both ends, A-Z lower-cased. Lines are exploded to rows of hashes (two 64-bit
hashes of the key), never as texts:
1. a count of rows by key leaves the keys that could be in least_docs documents;
2. the rows of those keys are written, and their different documents counted, first by (key, document), then by key, so that a
   line that a third of the documents hold is counted in many tasks;
3. the places of dropped lines are gathered by text, as a mask over its lines, and each text is put together again by place.
Texts move once, in the join with the masks.

Edge cases: a null or empty text is one empty line, and a null text stays null; a row without doc_id is in no count and is never
the one that keeps a line; rows that repeat a doc_id are one document, and all of them keep what the largest doc_id keeps; a line
that a document repeats counts once and goes, or stays, at every place; columns other than doc_id and text pass
through whatever their names, and the new ones get longer names where they would clash; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, spread_join, table

#: Stripped from both ends of a line.
SPACE = " \t\n\x0b\f\r"
#: Keys of at least so many code points, in at least so many documents, are dropped.
LEAST_CHARS, LEAST_DOCS = 40, 5
KEY = ["key_a", "key_b"]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keyed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, text_key, place and key hashes of every line whose key is long enough."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(split_lines(F.col("text"))).alias("place", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(SPACE))).filter(F.char_length("line") >= least_chars)
    # lower() changes A-Z alone in ASCII text, and is the faster there
    key = F.when(F.octet_length("line") == F.char_length("line"), F.lower("line")).otherwise(F.translate("line", string.ascii_uppercase, string.ascii_lowercase))
    lines = lines.withColumn("line", key)
    return lines.select("doc_id", "text_key", "place", F.xxhash64("line").alias("key_a"), F.xxhash64(F.lit(1), "line").alias("key_b"))


def dropped_places(docs: DataFrame, scratch: Scratch, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text_key, n, mask: how many lines each text loses, and which (true), up to the last of them."""
    lines = keyed_lines(docs, least_chars)
    often = scratch.write(lines.groupBy(*KEY).agg(F.count("*").alias("n")).filter(F.col("n") >= least_docs), "often")
    shared = scratch.write(spread_join(lines, often, KEY, "n", "inner").select("doc_id", "text_key", "place", *KEY), "shared")
    holders = shared.groupBy(*KEY, "doc_id").agg(F.count("*").alias("n"))
    over = holders.groupBy(*KEY).agg(F.count("doc_id").alias("docs"), F.max("doc_id").alias("last"), F.sum("n").alias("n"))
    over = scratch.write(over.filter(F.col("docs") >= least_docs), "over")
    gone = spread_join(shared, over, KEY, "n", "inner").filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("place")).alias("places"))
    before = lambda i: F.coalesce(F.get("places", i - 1), F.lit(-1))
    mask = F.flatten(F.transform("places", lambda p, i: F.concat(F.array_repeat(F.lit(False), p - before(i) - 1), F.array(F.lit(True)))))
    return scratch.write(gone.select("doc_id", "text_key", F.size("places").alias("n"), mask.alias("mask")), "gone")


def without_shared_lines(docs: DataFrame, scratch: Scratch, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs with text as it is kept, and n_lines and n_dropped (longer names where docs has these)."""
    names = docs.columns
    n_lines, n_dropped = (fresh(c, names) for c in ("n_lines", "n_dropped"))
    id_, key, mask = (fresh(c, names) for c in ("line_id", "line_key", "line_mask"))
    gone = dropped_places(docs.select("doc_id", "text"), scratch, least_chars, least_docs)
    side = gone.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("n").alias(n_dropped), F.col("mask").alias(mask))
    met = docs.join(side, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left")
    left = F.filter(split_lines(F.col("text")), lambda x, i: ~F.coalesce(F.get(mask, i), F.lit(False)))
    text = F.when(F.col(mask).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    counts = [F.size(split_lines(F.col("text"))).cast("long").alias(n_lines), F.coalesce(n_dropped, F.lit(0)).cast("long").alias(n_dropped)]
    return met.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names], *counts)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = without_shared_lines(docs, Scratch(spark, "op11"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Rows are told apart by their number, since ids and texts may repeat.
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT row_no, doc_id, p AS place, lines[p] AS line, translate(trim(lines[p], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key
  FROM (SELECT row_no, doc_id, lines, unnest(range(1, len(lines) + 1)) AS p FROM docs)
),
over AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
judged AS (SELECT row_no, any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS kept
  FROM (SELECT row_no, doc_id, place, line, over.key IS NOT NULL AND doc_id IS DISTINCT FROM over.last AS gone FROM lines LEFT JOIN over USING (key)) GROUP BY row_no)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM judged
"""

QUERIES = {"op11_line_dedup": op11_line_dedup}
ORACLES = {"op11_line_dedup": SQL}
