"""Queries on what comes from outside as recorded input: result pages, price feeds, the catalogue's age, tables with a fallback, model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_text
from ..operators import assembly, catalog
from ..sources import files, result_pages
from . import fixtures as X

C = F.col


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_pages.results(X.RESULT_PAGES.frame(spark, sf_dir))


def price_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.price_feed(X.PRICE_FEEDS.frame(spark, sf_dir)).withColumn("endpoints", F.array_join("endpoints", ","))


def catalogue_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.CATALOGUES.frame(spark, sf_dir).select("id", catalog.is_stale(C("generated").cast("timestamp"), C("today").cast("timestamp")).alias("stale"))


def table_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.open_table(spark, f"{sf_dir}/not_there.parquet", f"{sf_dir}/nation.parquet")


def model_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of one call over each turn of the shared conversations."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    system = F.when(C("turn") % 2 == 0, "Answer in JSON.")
    body = assembly.request_body(F.lit("m-1"), assembly.messages(system, C("text")), F.lit(512), F.when(C("turn") % 3 == 0, F.lit(0.5)), assembly.wants_json(system, C("text")))
    return talk.select("conv_id", "turn", body.alias("body"))


def model_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.PAYLOADS.frame(spark, sf_dir).select("id", assembly.answer_or_null(json_text.chat_text(C("payload"))).alias("answer"))


QUERIES = {f.__name__: f for f in (search_results, price_feed, catalogue_age, table_fallback, model_request, model_answer)}

_MODELS = "case when json_type(payload, '$.data') = 'ARRAY' then json_extract(payload, '$.data[*]') else json_extract(payload, '$.models[*]') end"

ORACLES = {
    # The results on the fixture's pages, read by hand.
    "search_results": """select * from (values
        (cast(1 as bigint), 'duckduckgo', 0, 'Jo Lee & co', 'https://a.edu/p?q=1', 'a b c'), (1, 'duckduckgo', 1, 'Second', 'https://b.org/people/x', ''), (1, 'duckduckgo', 2, 'Jo Lee', 'https://plain.org/jo', 'Professor of maps'),
        (2, 'bing', 0, 'Uni', 'https://uni.ac.uk/', 'in caption'), (2, 'bing', 1, 'Staff', 'https://www.bing.com/staff/1', 'loose')) as v(query_id, provider, place, title, url, snippet)
        union all select 3, 'duckduckgo', cast(i as integer), 'T' || i, 'https://u' || i || '.edu/', '' from range(10) r(i)
        union all select 1000000 + page_id, case page_id % 2 when 0 then 'duckduckgo' else 'bing' end, 0, case page_id % 2 when 0 then 'T ' || page_id else 'V' || page_id end, case page_id % 2 when 0 then 'https://u' else 'https://v' end || page_id || '.edu/', case page_id % 2 when 0 then '' else 'said' end from pages""",
    "price_feed": f"select j->>'model_name' as model_name, cast(j->>'model_ratio' as double) as model_ratio, cast(j->>'completion_ratio' as double) as completion_ratio, cast(j->>'quota_type' as integer) as quota_type, cast(j->>'model_price' as double) as model_price, j->>'owner_by' as owner_by, array_to_string(cast(json_extract(j, '$.supported_endpoint_types') as varchar[]), ',') as endpoints from (select unnest({_MODELS}) as j from {X.PRICE_FEEDS.sql})",
    "catalogue_age": f"select id, generated is null or left(generated, 7) <> left(today, 7) as stale from {X.CATALOGUES.sql}",
    "table_fallback": "select * from nation",
    "model_request": """select conv_id, turn, '{"model":"m-1","messages":[' || if(turn % 2 = 0, '{"role":"system","content":"Answer in JSON."},', '') || '{"role":"user"' || coalesce(',"content":' || to_json(text), '') || '}],"max_tokens":512' || if(turn % 3 = 0, ',"temperature":0.5', '') || if(contains(lower(if(turn % 2 = 0, 'Answer in JSON.', '') || coalesce(text, '')), 'json'), ',"response_format":{"type":"json_object"}', '') || '}' as body from conversations""",
    # The chat payloads' contents, read by hand.
    "model_answer": "select * from (values (cast(1 as bigint), 'hello'), (2, 'hello'), (3, null), (4, null), (5, null), (6, null)) as v(id, answer) union all select 1000000 + conv_id * 1000 + turn, case when turn % 4 in (0, 1) then role || ' ' || coalesce(length(text), 0) end from conversations",
}
