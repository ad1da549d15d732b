"""Which way a page is fetched, and what to do with each attempt: ordered folds over a URL's few recorded attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import urls
from ..functions.quality import with_web_quality
from ..functions.text import text_of

TIERS, TRIES = ("http", "curl_cffi", "playwright", "ocr", "browser_agent"), 3
BEST_EFFORT = 35


def route(url: Column, content_type: Column) -> Column:
    """The flow that a URL takes, by address first and then by content type."""
    pdf_type = F.contains(F.lower(text_of(content_type)), F.lit("application/pdf"))
    return F.when(urls.is_docs(url), "docs").when(urls.is_drive(url), "drive").when(urls.ats_kind(url).isNotNull(), "ats").when(urls.is_pdf(url) | pdf_type, "pdf").otherwise("web")


def tier_plan(available: Column) -> Column:
    """The tiers of TIERS that are available, in order; http always is."""
    return F.filter(F.array(*[F.lit(t) for t in TIERS]), lambda t: (t == "http") | F.array_contains(available, t))


def retry_action(status: Column, server: Column, ray: Column, attempt: Column) -> Column:
    """challenge, stop, retry or give_up after a failed try (from 0); a null status is a time-out or a broken connection."""
    guarded = F.contains(F.lower(text_of(server)), F.lit("cloudflare")) | ray.isNotNull()
    final = status.between(400, 499) & ~status.isin(408, 429)
    return F.when(status.isin(403, 503) & guarded, "challenge").when(final, "stop").when(attempt >= TRIES - 1, "give_up").otherwise("retry")


def retry_wait(attempt: Column) -> Column:
    return F.pow(F.lit(2), attempt).cast("long")


def escalate(attempts: DataFrame) -> DataFrame:
    """url, method, status, tried from attempts (url, ord, method, content, transport_challenge).

    Each tier is judged in turn; a tier may end the search, or rule out later tiers. Without a good page the best
    one with a score of BEST_EFFORT is taken. A URL has at most a handful of attempts, so its list is small.
    """
    judged = with_web_quality(attempts, "content")
    step = F.struct("ord", "method", "score", "quality", "flags", (text_of(F.col("content")) != "").alias("filled"), F.coalesce("transport_challenge", F.lit(False)).alias("stopped"), urls.ats_signature(F.col("url"), F.col("content")).alias("ats"))
    per_url = judged.groupBy("url").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    agent = F.exists("steps", lambda a: a["method"] == "browser_agent")
    start = F.struct(F.array().cast("array<string>").alias("skip"), F.lit("").alias("end"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("best"), F.lit(-1).alias("top"), F.array().cast("array<string>").alias("tried"))

    def fold(s: Column, a: Column) -> Column:
        flagged = F.array_contains(a["flags"], "challenge_page")
        http, browser = a["method"] == "http", a["method"] == "playwright"
        to_agent = http & (flagged | a["stopped"]) & agent
        hard = http & (a["quality"] != "good") & F.coalesce(a["ats"].isin(L.HARD_ATS), F.lit(False)) & agent
        pdf = F.array_contains(a["flags"], "pdf_like_content")
        more = (
            F.when(to_agent, F.array(F.lit("playwright"), F.lit("ocr")))
            .when(hard, F.array(F.lit("curl_cffi"), F.lit("playwright"), F.lit("ocr")))
            .when(~pdf & flagged & browser & agent, F.array(F.lit("ocr")))
            .otherwise(F.array().cast("array<string>"))
        )
        end = F.when(to_agent | hard, "").when(pdf, "pdf").when(flagged & browser, F.when(agent, "").otherwise("stop")).when(a["quality"] == "good", "good").otherwise("")
        better = a["filled"] & (a["score"] > s["top"])
        new = F.struct(
            F.array_union(s["skip"], more).alias("skip"),
            end.alias("end"),
            F.when(end == "good", a["method"]).when(end == "pdf", "pdf").alias("method"),
            F.when(better, a["method"]).otherwise(s["best"]).alias("best"),
            F.when(better, a["score"]).otherwise(s["top"]).alias("top"),
            F.concat(s["tried"], F.array(a["method"])).alias("tried"),
        )
        return F.when((s["end"] != "") | F.array_contains(s["skip"], a["method"]), s).otherwise(new)

    done = per_url.select("url", F.aggregate("steps", start, fold).alias("s")).select("url", "s.*")
    effort = F.col("top") >= BEST_EFFORT
    return done.select(
        "url",
        F.coalesce("method", F.when(effort, F.col("best"))).alias("method"),
        F.when(F.col("end") == "good", "success").when(F.col("end") == "pdf", "pdf").when(effort, "best_effort").otherwise("failed").alias("status"),
        F.array_join("tried", ",").alias("tried"),
    )


def settled(observations: DataFrame, needed: int = 2) -> DataFrame:
    """page, settled_at: the first observation (page, ord, content_hash, content_length) after which the page was unchanged `needed` times in a row."""
    from pyspark.sql import Window as W

    by_page = W.partitionBy("page").orderBy("ord")
    same = (F.col("content_hash") == F.lag("content_hash").over(by_page)) & (F.col("content_length") == F.lag("content_length").over(by_page))
    runs = observations.withColumn("same", F.coalesce(same, F.lit(False)))
    runs = runs.withColumn("run", F.sum((~F.col("same")).cast("int")).over(by_page))
    runs = runs.withColumn("length", F.sum(F.col("same").cast("int")).over(W.partitionBy("page", "run").orderBy("ord")))
    return runs.groupBy("page").agg(F.min(F.when(F.col("length") >= needed, F.col("ord"))).alias("settled_at"))


def shots(height: Column, viewport: Column) -> Column:
    """How many screenshots a page takes: one up to 1.5 viewports, else at most ten."""
    return F.when(height <= viewport * 1.5, 1).otherwise(F.least(F.lit(10), F.floor(height / viewport).cast("int") + 1))
