"""Choosing among alternatives: ordered windows and aggregates with an ordinal, so that ties fall to the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import quality
from ..functions.contacts import generic_email, priority_score
from ..functions.text import clean_email, html_to_layout, layout, strip_comment_noise, text_of, unescape


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key: the first by order. A partial aggregate (min_by), so that a hot key is merged before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def pick_candidates(candidates: DataFrame) -> DataFrame:
    """doc_id, method, text, score: each document's best candidate (doc_id, ord, method, text), comment noise taken off first."""
    cleaned = candidates.withColumn("text", strip_comment_noise(F.col("text")))
    scored = quality.with_candidate_score(cleaned, "text", "method")
    return first_by(scored, ["doc_id"], -F.col("score"), F.col("ord")).select("doc_id", "method", "text", "score")


def first_valid_backend(attempts: DataFrame) -> DataFrame:
    """path, ord, text: the first attempt (path, ord, text) whose text is valid."""
    return first_by(attempts.filter(quality.valid_text(F.col("text"))), ["path"], F.col("ord"))


def best_attempt(attempts: DataFrame) -> DataFrame:
    """url, ord, method, score: each URL's best attempt with content; the first of equals."""
    return first_by(attempts.filter(text_of(F.col("content")) != "").select("url", "ord", "method", "score"), ["url"], -F.col("score"), F.col("ord"))


def distinct_results(results: DataFrame) -> DataFrame:
    """Each query's results without an empty or an earlier URL."""
    return first_by(results.filter(text_of(F.col("url")) != ""), ["query_id", "url"], F.col("ord"))


def top_results(results: DataFrame, n: int = 10) -> DataFrame:
    """query_id, rank, url, score: each query's n best distinct results by priority."""
    scored = distinct_results(results).withColumn("score", priority_score(F.col("url"), F.col("title"), F.col("snippet")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n).select("query_id", "rank", "url", "score")


def vote(analyses: DataFrame) -> DataFrame:
    """contact_id, title, email from page analyses: Dr. if over half say so, else the commonest gender (the first seen of equals); the first fitting address."""
    genders = analyses.filter("gender is not null and gender <> '' and gender <> 'unknown'").groupBy("contact_id", "gender").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    majority = genders.groupBy("contact_id").agg(F.min_by("gender", F.struct(-F.col("n"), "first")).alias("gender"))
    fits = (text_of(F.col("email_address")) != "") & ~generic_email(F.col("email_address"), F.col("contact_name"))
    per = analyses.groupBy("contact_id").agg(F.count_if("has_doctorate").alias("doctors"), F.count("*").alias("n"), F.min_by(F.when(fits, clean_email(F.col("email_address"))), F.when(fits, F.col("ord"))).alias("email"))
    title = F.when(F.col("doctors") * 2 > F.col("n"), "Dr.").when(F.col("gender") == "male", "Mr.").when(F.col("gender") == "female", "Ms.").otherwise("Mr./Ms.")
    return per.join(majority, "contact_id", "left").select("contact_id", title.alias("title"), F.coalesce("email", F.lit("")).alias("email"), F.col("doctors").cast("long").alias("doctors"), F.col("n").cast("long").alias("pages"))


def jsonld_body(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, body: the longest articleBody or description over all JSON-LD scripts; the first of equals. Pages without one are left out."""
    blocks = F.regexp_extract_all(text_of(F.col("html")), F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    parsed = pages.select(key, F.posexplode(blocks).alias("block", "raw")).withColumn("doc", F.try_parse_json(F.trim("raw"))).filter("doc is not null")
    kind = F.schema_of_variant("doc")
    text = F.col("doc").cast("string")
    nodes = F.when(kind.startswith("ARRAY"), text).otherwise(F.coalesce(F.get_json_object(text, "$.@graph"), F.concat(F.lit("["), text, F.lit("]"))))
    node = F.from_json(nodes, "array<struct<articleBody:string,description:string>>")
    values = parsed.select(key, "block", F.posexplode(node).alias("at", "node")).select(key, "block", "at", F.posexplode(F.array("node.articleBody", "node.description")).alias("k", "value"))
    best = values.filter("value is not null and value <> ''").groupBy(key).agg(F.min_by("value", F.struct(-F.length("value"), "block", "at", "k")).alias("value"))
    return best.select(key, html_to_layout(F.col("value")).alias("body"))


def meta_content(html, name: str, attribute: str = "property"):
    """The content of a meta element, its attributes in either order; empty if none."""
    quoted = name.replace(".", r"\.")
    one = F.regexp_extract(text_of(html), rf"""(?is)<meta[^>]+{attribute}=["']{quoted}["'][^>]*content=["'](.*?)["']""", 1)
    two = F.regexp_extract(text_of(html), rf"""(?is)<meta[^>]+content=["'](.*?)["'][^>]*{attribute}=["']{quoted}["']""", 1)
    return layout(unescape(F.coalesce(F.nullif(one, F.lit("")), two)))


def description(html):
    """The page's own description: the og property, else the named one."""
    return F.coalesce(F.nullif(meta_content(html, "og:description"), F.lit("")), meta_content(html, "description", "name"))
