"""The model catalogue: platform, vision, prices and notes from a pricing feed (model_name, model_ratio, completion_ratio, quota_type, model_price, owner_by, endpoints)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import has_any, strip, text_of


def platform(name: Column, owner: Column) -> Column:
    low = F.lower(name)
    out = F.coalesce(F.nullif(owner, F.lit("")), F.lit(L.OTHER_PLATFORM))
    for who, starts in reversed(L.PLATFORM_PREFIXES):
        fits = reduce(lambda a, b: a | b, [low.startswith(s) for s in starts])
        out = F.when(fits | F.contains(low, F.lit("gemini")) if who == "Google" else fits, who).otherwise(out)
    return out


def sees(name: Column) -> Column:
    low = F.lower(name)
    return ~has_any(low, L.TEXT_ONLY_NAMES) & has_any(low, L.VISION_NAMES)


def price_text(c: Column) -> Column:
    return F.when(c.isNull(), "—").otherwise(F.format_string("%.3f", c))


def row_note(note: Column, endpoints: Column) -> Column:
    ends = strip(text_of(endpoints))
    extra = F.when((ends != "") & (ends != "openai"), F.concat(F.lit("端点: "), ends))
    return F.concat_ws("; ", F.nullif(note, F.lit("")), extra)


def price_list(feed: DataFrame) -> DataFrame:
    """place, name, platform, vision, input and output price, note; the cheapest first, prices per call last, ties by name."""
    per_call = (F.coalesce("quota_type", F.lit(0)) == 1) & (F.coalesce("model_price", F.lit(0.0)) != 0)
    ratio = F.coalesce("model_ratio", F.lit(0.0))
    completion = F.coalesce(F.nullif(F.col("completion_ratio"), F.lit(0.0)), F.lit(1.0))
    input_ = F.when(~per_call, ratio * L.BASE_PRICE)
    rows = feed.filter(text_of(F.col("model_name")) != "").select(
        F.col("model_name").alias("name"),
        platform(F.col("model_name"), F.col("owner_by")).alias("platform"),
        sees(F.col("model_name")).alias("vision"),
        input_.alias("price"),
        price_text(input_).alias("input_price"),
        price_text(F.when(~per_call, ratio * completion * L.BASE_PRICE)).alias("output_price"),
        row_note(F.when(per_call, F.concat(F.lit("按次计费 $"), F.col("model_price").cast("string"), F.lit("/次"))).otherwise(""), F.array_join("endpoints", ", ")).alias("note"),
    )
    order = W.orderBy(F.col("price").asc_nulls_last(), "name")  # a catalogue has some hundred rows
    return rows.withColumn("place", F.row_number().over(order)).drop("price")


def catalogue_counts(feed: DataFrame) -> DataFrame:
    return price_list(feed).groupBy("vision").agg(F.count("*").alias("models"))


def is_stale(generated: Column, today: Column) -> Column:
    """A catalogue is written anew once a month."""
    return generated.isNull() | (F.date_trunc("MONTH", generated) != F.date_trunc("MONTH", today))
