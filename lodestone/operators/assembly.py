"""Putting texts together: prompts, messages, page joins, search queries and the searches' order, the catalogue's document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.contacts import clean_name, email_domains, present
from ..functions.json_text import json_object
from ..functions.text import is_blank, strip, text_of
from ..functions.urls import is_useful
from . import catalog, selection

SEARCHES = ("web", "second", "targeted", "tool")
ENOUGH, SHOWN = 3, 10


def wants_json(system: Column, prompt: Column) -> Column:
    return F.contains(F.lower(F.concat(text_of(system), text_of(prompt))), F.lit("json"))


def messages(system: Column, prompt: Column, images: Column | None = None) -> Column:
    """The chat messages as JSON: a system text if there is one, and the prompt, with its images as parts."""
    user = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    if images is not None:
        parts = F.concat(F.array(F.to_json(F.struct(F.lit("text").alias("type"), prompt.alias("text")))), F.transform(images, lambda i: F.to_json(F.struct(F.lit("image_url").alias("type"), F.struct(i.alias("url")).alias("image_url")))))
        user_json = F.concat(F.lit('{"role":"user","content":['), F.array_join(parts, ","), F.lit("]}"))
    else:
        user_json = F.to_json(user)
    system_json = F.to_json(F.struct(F.lit("system").alias("role"), system.alias("content")))
    return F.concat(F.lit("["), F.when(is_blank(system), "").otherwise(F.concat(system_json, F.lit(","))), user_json, F.lit("]"))


def request_body(model: Column, messages_json: Column, most_tokens: Column, temperature: Column, json_mode: Column) -> Column:
    """The body of one chat call as JSON; a null temperature is left to the model."""
    member = lambda name, value: F.concat(F.lit(f',"{name}":'), value)
    quoted = F.substring_index(F.to_json(F.struct(model.alias("m"))), '{"m":', -1)
    quoted = F.left(quoted, F.length(quoted) - 1)
    warmth = F.coalesce(member("temperature", temperature.cast("string")), F.lit(""))
    shape = F.when(json_mode, member("response_format", F.lit('{"type":"json_object"}'))).otherwise("")
    return F.concat(F.lit('{"model":'), quoted, member("messages", messages_json), member("max_tokens", most_tokens.cast("string")), warmth, shape, F.lit("}"))


def answer_or_null(text: Column) -> Column:
    """A call's trimmed answer; one without text is a failed call, here null."""
    return F.nullif(strip(text_of(text)), F.lit(""))


def local_prompt(system: Column, prompt: Column) -> Column:
    """The text that a local model completes: turns between its chat marks, the system's only if there is one."""
    turn = lambda role, text: F.concat(F.lit(f"<|im_start|>{role}\n"), text_of(text), F.lit("<|im_end|>\n"))
    return F.concat(F.when(text_of(system) == "", "").otherwise(turn("system", system)), turn("user", prompt), F.lit("<|im_start|>assistant\n"))


def rendered_text(extracted: Column, shown: Column, least: int = 100) -> Column:
    """The text extracted from a rendered page, else what the browser showed; null unless it has more than `least` characters."""
    text = F.when(text_of(extracted) == "", shown).otherwise(extracted)
    return F.when(F.length(strip(text_of(text))) > least, text)


def attempt_log(attempts: DataFrame) -> DataFrame:
    """page_id, attempts, tried, selected, status of fetch attempts (page_id, ord, method, content, quality, score, reason).

    tried lists method, quality, score and content length in order; the selected method has content and the best score, the first of equals.
    """
    length = F.coalesce(F.length("content"), F.lit(0))
    line = F.concat_ws(":", "method", "quality", F.coalesce(F.col("score").cast("string"), F.lit("-")), length.cast("string"))
    tried = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))), lambda x: x["t"]), ",")
    selected = F.min_by(F.when(length > 0, F.col("method")), F.when(length > 0, F.struct(-F.coalesce("score", F.lit(-1)), "ord")))
    return attempts.groupBy("page_id").agg(F.count("*").alias("attempts"), tried.alias("tried"), selected.alias("selected"), F.when(F.max(length) > 0, "success").otherwise("failed").alias("status"))


def stage_prompt(task: Column, text: Column, today: Column) -> Column:
    """A stage's prompt: its task, the day that years are inferred from, and the text between rules."""
    return F.concat(task, F.lit("\nToday: "), F.date_format(today, "yyyy-MM-dd"), F.lit("\n---\n"), text_of(text), F.lit("\n---"))


def joined_pages(pages: DataFrame, most: int = 10) -> DataFrame:
    """doc, text: recognised pages (doc, page, text) under their numbers, in order; at most `most`, blank ones left out."""
    kept = pages.filter((F.col("page") <= most) & ~is_blank(F.col("text")))
    line = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), strip(F.col("text")))
    return kept.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def spans_text(blocks: Column) -> Column:
    """Blocks of lines of spans as text: a line's spans run on, blank lines go."""
    lines = F.flatten(F.transform(blocks, lambda b: F.coalesce(b["lines"], F.array())))
    texts = F.transform(lines, lambda x: F.array_join(F.transform(x["spans"], lambda s: text_of(s["text"])), ""))
    return F.array_join(F.filter(texts, lambda t: ~is_blank(t)), "\n")


def blocks_text(blocks: Column) -> Column:
    """Text of flat blocks (text, kind) of kind 0."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: (b["kind"] == 0) & ~is_blank(b["text"])), lambda b: b["text"]), "\n")


def trimmed(text: Column, most: int, mark: str = "") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def targeted_queries(name: Column, hints: Column) -> Column:
    """Two queries for each of the first two address domains in a text."""
    who = clean_name(name)
    domains = F.slice(email_domains(hints), 1, 2)
    return F.flatten(F.transform(domains, lambda d: F.array(F.concat(who, F.lit(" @"), d), F.concat(F.lit("site:"), d, F.lit(" "), who, F.lit(" email")))))


def cascade(results: DataFrame) -> DataFrame:
    """query_id, rank, url, score from recorded results (query_id, provider, ord, title, url, snippet).

    The second search runs only after too few results of the first, the targeted one where a result hints at a domain, the
    tool only after too few of all; then distinct results by priority.
    """
    counted = results.groupBy("query_id").agg(
        F.count_if(F.col("provider") == "web").alias("n_web"), F.count_if(F.col("provider") == "second").alias("n_second"), F.count_if(F.col("provider") == "targeted").alias("n_targeted"),
        F.bool_or(F.col("provider").isin("web", "second") & (F.size(email_domains(F.concat_ws(" ", "title", "snippet"))) > 0)).alias("hinted"),
    )
    second = F.col("n_web") < ENOUGH
    so_far = F.col("n_web") + F.when(second, F.col("n_second")).otherwise(0) + F.when(F.col("hinted"), F.col("n_targeted")).otherwise(0)
    p = F.col("provider")
    used = (p == "web") | ((p == "second") & second) | ((p == "targeted") & F.col("hinted")) | ((p == "tool") & (so_far < ENOUGH))
    turn = F.array_position(F.array(*[F.lit(s) for s in SEARCHES]), p) * 1000 + F.col("ord")
    kept = results.join(counted, "query_id").filter(used).withColumn("ord", turn.cast("int"))
    return selection.top_results(kept.select("query_id", "ord", "title", "url", "snippet"), SHOWN)


def chosen_pages(ranked: DataFrame, answers: DataFrame, few: int = 3) -> DataFrame:
    """query_id, rank, url: the pages to read, from the model's answers (query_id, response) on the ranked results (query_id, rank, url).

    `few` results or less are all read. Else the addresses under selected_urls that pass the gate for useful ones, in the model's order, none
    if the answer holds no such list; without an answer, the first `few` results that pass it. Ranked results are at most SHOWN a query.
    """
    found = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]).alias("all"))
    met = found.join(answers.select("query_id", "response"), "query_id", "left")
    selected = F.from_json(F.get_json_object(json_object(F.col("response")), "$.selected_urls"), "array<string>")
    useful = lambda several: F.filter(several, lambda u: is_useful(u))
    chosen = F.when(F.size("all") <= few, F.col("all")).when(text_of(F.col("response")) != "", useful(F.coalesce("selected", F.array().cast("array<string>")))).otherwise(useful(F.slice("all", 1, few)))
    return met.withColumn("selected", selected).select("query_id", F.posexplode(chosen).alias("at", "url")).select("query_id", (F.col("at") + 1).alias("rank"), "url")


def pages_to_read(chosen: DataFrame, ranked: DataFrame, least: int = 3, most: int = 8) -> DataFrame:
    """query_id, place, url: chosen pages first, then the ranked ones, each once, up to max(least, most)."""
    both = chosen.select("query_id", F.lit(0).alias("from"), "rank", "url").unionByName(ranked.select("query_id", F.lit(1).alias("from"), "rank", "url"))
    once = selection.first_by(both, ["query_id", "url"], F.col("from"), F.col("rank"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("from", "rank"))
    return once.withColumn("place", place).filter(F.col("place") <= max(least, most)).select("query_id", "place", "url")


def contact_update(name: Column, email: Column, title: Column, found: Column, formatted: Column) -> tuple[Column, Column]:
    """Name and address after a check: the title before the name, the found address unless there is none."""
    new_name = F.when(title.isin("Dr.", "Mr.", "Ms.") & (formatted != ""), formatted).otherwise(name)
    return new_name, F.when(present(found), found).otherwise(email)


def run_counts(outcomes: DataFrame) -> DataFrame:
    """processed, succeeded, failed and the rate in percent, of rows with `done`."""
    out = outcomes.agg(F.count("*").alias("processed"), F.count_if("done").alias("succeeded"))
    return out.withColumn("failed", F.col("processed") - F.col("succeeded")).withColumn("rate", F.when(F.col("processed") > 0, F.round(F.col("succeeded") * 100 / F.col("processed"), 4)).otherwise(0.0))


def observed(outcomes: DataFrame, counts: Observation) -> DataFrame:
    """outcomes (done) as they are; `counts` is filled by the job that writes them, without a pass of its own."""
    return outcomes.observe(counts, F.count("*").alias("processed"), F.count_if("done").alias("succeeded"))


def observed_counts(counts: Observation) -> dict:
    """What run_counts says, from an observation whose job has ended."""
    n, ok = counts.get["processed"], counts.get["succeeded"]
    return {"processed": n, "succeeded": ok, "failed": n - ok, "rate": round(ok * 100 / n, 4) if n else 0.0}


def is_date(c: Column) -> Column:
    """Text that one of the usual forms of a date reads."""
    forms = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(strip(c), F.lit(f)) for f in forms]).isNotNull()


def media_type(name: Column) -> Column:
    """An image's type by its suffix, image/png if it is none of the known ones."""
    suffix = F.lower(F.regexp_extract(text_of(name), r"\.([A-Za-z0-9]+)$", 1))
    known = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), suffix), F.lit("image/png"))


def tool_name(c: Column) -> tuple[Column, Column]:
    """Server and tool of a name like mcp_server_tool; nulls for another."""
    fits = F.rlike(text_of(c), F.lit("^mcp_[^_]+_.+$"))
    return F.when(fits, F.split_part(c, F.lit("_"), F.lit(2))), F.when(fits, F.regexp_extract(c, "^mcp_[^_]+_(.+)$", 1))


def catalogue_lines(feed: DataFrame) -> DataFrame:
    """vision, place, line: the price tables' rows in the catalogue document."""
    rows = catalog.price_list(feed)
    return rows.select("vision", "place", F.concat(F.lit("| "), F.concat_ws(" | ", F.concat(F.lit("`"), "name", F.lit("`")), "platform", "input_price", "output_price", "note"), F.lit(" |")).alias("line"))
