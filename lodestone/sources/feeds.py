"""RSS feeds as rows. from_xml keeps one struct per item, so that an item without a child stays aligned; malformed XML gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.html_text import line_text
from ..functions.text import strip, text_of, unescape

_ITEM = "struct<title:string,link:string,description:string,pubDate:string>"
_FEED = f"struct<channel:struct<item:array<{_ITEM}>>>"


def items(feeds: DataFrame, limit: int | None = None, search: str | None = None) -> DataFrame:
    """source, ord, title, url, description, published from feeds (source, xml): items with a title and a link, at most `limit` a source."""
    parsed = feeds.select("source", F.from_xml("xml", _FEED)["channel"]["item"].alias("items"))
    rows = parsed.select("source", F.posexplode("items").alias("ord", "i")).select("source", F.col("ord").cast("long"), "i.*")
    title, link = strip(text_of(F.col("title"))), strip(text_of(F.col("link")))
    plain = line_text(F.col("description"))
    rows = rows.filter((title != "") & (link != "")).select("source", "ord", unescape(title).alias("title"), link.alias("url"), plain.alias("description"), strip(text_of(F.col("pubDate"))).alias("published"))
    if search:
        rows = rows.filter(F.contains(F.lower(F.concat_ws(" ", "title", "description")), F.lit(search.lower())))
    if limit is not None:
        rows = rows.withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("ord"))).filter(F.col("n") <= limit).drop("n")
    return rows
