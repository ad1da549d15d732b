"""Queries on texts: quality verdicts and clean-up, over documents and over fixtures for the branches that documents don't reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import quality, text
from ..operators import main_text, selection
from ..sources.files import spread
from . import fixtures as X
from . import sql_parts as S


#: Added to page ids beside a fixture's.
PAGES = 1_000_000


def documents(spark: SparkSession, sf_dir: str, more: X.Fixture = X.TEXTS) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).unionByName(more.frame(spark, sf_dir))


def _sql(more: X.Fixture = X.TEXTS) -> str:
    return f"(select doc_id, text from documents union all select * from {more.sql})"


def per_text(name: str, f, more: X.Fixture = X.TEXTS):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out: Column = f(F.col("text"))
        return documents(spark, sf_dir, more).select("doc_id", out.alias(name))

    return query


def web_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_web_quality(documents(spark, sf_dir), "text").select("doc_id", "score", "quality", F.array_join("flags", ",").alias("flags"))


def marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower(text.text_of(F.col("text")))
    counts = {"comments": L.COMMENT_MARKERS, "boilerplate": L.BOILERPLATE_MARKERS, "challenges": L.CHALLENGE_MARKERS}
    found = documents(spark, sf_dir).select("doc_id", text.occurrences(low, *counts.values()).alias("found"))
    return found.select("doc_id", *[F.get("found", F.lit(i)).cast("long").alias(n) for i, n in enumerate(counts)])


def candidate_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's best candidate (main-text segments, its whole text, its own description), and the fixture's; pages are told apart from these by PAGES."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.col("page_id") + PAGES).alias("doc_id"), "html"))
    other = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(m).alias("method"), t.alias("text")) for i, (m, t) in enumerate((("innerText", text.html_to_layout(F.col("html"))), ("og:description", selection.description(F.col("html")))), 2)])
    found = main_text.main_texts(pages, "doc_id").unionByName(pages.select("doc_id", F.explode(other).alias("c")).select("doc_id", "c.*"))
    return selection.pick_candidates(found.unionByName(X.CANDIDATES.frame(spark, sf_dir))).withColumn("score", F.round("score", 6))


def main_text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))).select("page_id", "method", "text")


def pdf_backend_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.first_valid_backend(X.PDF_ATTEMPTS.frame(spark, sf_dir))


def placeholder_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", quality.drive_text(F.col("text")).isNotNull().alias("drive"), quality.docs_text(F.col("text")).alias("docs"))


_PDF = f"""(length(t) >= 50 and ({S.hits('left(t, 2000)', L.PDF_INDICATORS)} >= 2 or starts_with({S.strip('t')}, '%PDF-') or (length(t) > 200 and (
  len(regexp_extract_all(left(t, 1000), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) > 0.05 * length(left(t, 1000)) or len(regexp_extract_all(left(t, 1000), '[^\\x00-\\x7f]')) > 0.3 * length(left(t, 1000))))))"""
_GONE = f"(length({S.strip('t')}) < 50 or {S.any_of('lower(t)', L.UNAVAILABLE)} or (length({S.strip('t')}) < 200 and {S.any_of('lower(t)', L.ERROR_WORDS)}))"
_RAW = f"(starts_with({S.strip('t')}, '%PDF-') or {S.hits('t', L.PDF_MARKERS)} >= 3 or len(regexp_extract_all(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) > 0.1 * length(t))"
_CORRUPT = f"""(coalesce(list_max(map_values(list_histogram(regexp_extract_all(t, '\\p{{L}}')))) > 0.4 * len(regexp_extract_all(t, '\\p{{L}}')), false)
  or (len(words) > 10 and list_sum(list_transform(words, lambda w: length(w))) > 25 * len(words))
  or len(regexp_extract_all(t, '[^\\p{{L}}\\p{{N}}_{S.WS[1:-1]}]{{4,}}')) > length(t) / 200.0)"""
_WORDS = f"list_filter(string_split({S.collapse('t')}, ' '), lambda w: regexp_full_match(w, '\\p{{L}}+'))"
_LETTERS = "len(regexp_extract_all(t, '\\p{L}'))"
_SOLID = "length(replace(replace(t, ' ', ''), chr(10), ''))"
_VALID = f"""(length({S.strip('t')}) >= 50 and not {_RAW} and not {_CORRUPT} and len(list_filter(string_split({S.collapse('t')}, ' '), lambda w: w <> '')) >= 5
  and {_SOLID} > 0 and {_LETTERS} >= 0.2 * {_SOLID})"""


def _per(name: str, expression: str, more: X.Fixture = X.TEXTS) -> str:
    return f"select doc_id, {expression} as {name} from (select doc_id, t, {_WORDS} as words from (select doc_id, coalesce(text, '') as t from {_sql(more)}))"


def _cleaned(name: str, expression: str) -> str:
    return f"select doc_id, {expression} as {name} from {_sql(X.RAW_TEXTS)}"


def _fixed(x: str) -> str:
    x = f"coalesce({x}, '')"
    for a, b in (("\ufeff", ""), ("\xa0", " "), ("–", "-"), ("—", "--"), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("…", "...")):
        x = f"replace({x}, {S.q(a)}, {S.q(b)})"
    return x


def _artifacts(x: str) -> str:
    for pattern in (f"\\n{S.WS}*\\p{{Nd}}+{S.WS}*\\n", "\\nPage \\p{Nd}+\\n", f"\\n{S.WS}*www\\.[^\\n]+\\n", f"\\n{S.WS}*http[^\\n]+\\n"):
        x = f"regexp_replace({x}, '{pattern}', chr(10), 'g')"
    return x


def _joined(x: str) -> str:
    x = f"regexp_replace({x}, '([a-z])-{S.WS}*\\n{S.WS}*([a-z])', '\\1\\2', 'g')"
    return f"regexp_replace({x}, '([a-z,]){S.WS}*\\n{S.WS}*([a-z])', '\\1 \\2', 'g')"


_LINES = "string_split(regexp_replace({}, '\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10))"


def _uncommented(x: str) -> str:
    cuts = ", ".join(f"nullif(strpos(lower(coalesce({x}, '')), {S.q(m)}), 0)" for m in L.CUT_MARKERS)
    cut = f"left(coalesce({x}, ''), coalesce(least({cuts}) - 1, length(coalesce({x}, ''))))"
    only = f"(?i){S.WS}*(like|reply|comment|share|repost|follow|connect|\\p{{Nd}}+{S.WS}*(reaction|reactions|comments?|followers?)){S.WS}*"
    return S.layout(f"array_to_string(list_filter({_LINES.format(cut)}, lambda l: not regexp_full_match(l, '{only}')), chr(10))")


def _unchromed(x: str) -> str:
    x = f"coalesce({x}, '')"
    for pattern in (f"File{S.WS}+Edit{S.WS}+View{S.WS}+Tools{S.WS}+Help", f"Accessibility{S.WS}+Debug", f"Tab{S.WS}+External{S.WS}+Share", "Sign in", "JavaScript isn''t enabled.*?Enable and reload", "This browser version is no longer supported.*?upgrade to a supported browser"):
        x = f"regexp_replace({x}, '(?is){pattern}', '', 'g')"
    return S.collapse(x)


def _ocr(x: str) -> str:
    lines = f"list_filter(string_split(coalesce({x}, ''), chr(10)), lambda l: length({S.strip('lower(l)')}) > 1 and not list_contains({X.literal(L.OCR_UI)}, {S.strip('lower(l)')}))"
    kept = L.OCR_KEPT.replace("'", "''")
    one = S.collapse(f"regexp_replace(array_to_string({lines}, chr(10)), '[^\\p{{L}}\\p{{N}}_{S.WS[1:-1]}一-鿿{kept}]', ' ', 'g')")
    return f"(select regexp_replace(case when length(o) >= 3 then o else '' end, '([一-鿿]){S.WS}+([一-鿿])', '\\1\\2', 'g') from (select {one} as o))"


def _web_quality() -> str:
    word = "[\\p{L}\\p{N}\\p{M}_][\\p{L}\\p{N}\\p{M}_-]*"
    return f"""
with m as (select doc_id, t, lower(t) as low, length(t) as n, regexp_extract_all(t, '{word}') as w from (select doc_id, {S.collapse('text')} as t from {_sql()})),
h as (select *, len(w) as words, len(list_distinct(list_transform(list_filter(list_transform(w, lambda x: regexp_replace(x, '-+$', '')), lambda x: length(x) >= 3), lambda x: lower(x)))) as uniq,
  {_PDF} as pdf, {_GONE} as gone,
  regexp_matches(t, '\\{{\\{{[^{{}}]+\\}}\\}}') or regexp_matches(t, '\\{{\\$[^{{}}]+\\}}') or regexp_matches(t, '\\$\\{{[^{{}}]+\\}}') as tpl,
  contains(low, '{{{{$ctrl') as fw, regexp_matches(t, '\\{{\\p{{Nd}}+\\}}') as sess,
  {S.hits('low', L.SHELL_SIGNALS)} as shell, {S.hits('low', L.CHALLENGE_SIGNALS)} as chal, {S.hits('low', L.PORTAL_SIGNALS)} as portal, {S.hits('low', L.BODY_KEYWORDS)} as body, {S.hits('low', L.DETAIL_KEYWORDS)} as detail from m),
s as (select *, case when n = 0 then 0 else greatest(0, least(100, 100 - if(pdf, 80, 0) - if(gone, 45, 0) - if(tpl, 60, 0) - if(fw, 20, 0)
  + case when n < 80 then -55 when n < 200 then -35 when n < 500 then -15 when n > 1500 then 10 else 0 end + case when words < 40 then -20 when words > 250 then 5 else 0 end - if(uniq < 20, 15, 0)
  - if(shell >= 3, least(35, shell * if(n < 800, 10, 4)), 0) - if(chal >= 2, 95, 0) - if(portal >= 2, least(55, portal * 18), 0) - if(sess, 25, 0)
  + if(body = 0, -20, least(20, body * 4)) + case when detail >= 2 then least(25, detail * 8) when portal >= 2 then -20 else 0 end - if(n < 1200 and (chal >= 2 or portal >= 2), 25, 0))) end as score,
  n > 0 and (n >= 500 or detail >= 1) as solid from h)
select doc_id, cast(score as integer) as score, case when not solid and score >= 35 then 'weak' when score >= 60 then 'good' when score >= 35 then 'weak' else 'bad' end as quality,
  case when n = 0 then 'empty_content' else concat_ws(',', if(pdf, 'pdf_like_content', null), if(gone, 'unavailable_page', null), if(tpl, 'template_placeholders', null), if(fw, 'framework_placeholders', null),
  case when n < 80 then 'too_short' when n < 200 then 'short_content' when n < 500 then 'limited_content' end, if(words < 40, 'low_word_count', null), if(uniq < 20, 'low_unique_words', null), if(shell >= 3, 'shell_page_signals', null),
  if(chal >= 2, 'challenge_page', null), if(portal >= 2, 'portal_shell_page', null), if(sess, 'session_placeholders', null), if(body = 0, 'missing_body_keywords', null), if(portal >= 2 and detail < 2, 'missing_detail_sections', null), if(not solid, 'insufficient_substance', null)) end as flags from s"""


def _segments() -> str:
    """The segments by prefix sums: the largest difference of a sum and the least one before it; the last least one starts the stretch."""
    space, h = main_text.SPACE, "coalesce(html, '')"
    h = f"array_to_string(list_transform(string_split({h}, '-->'), lambda x: regexp_replace(x, '(?s)<!--.*', ' ')), ' ')"
    for tag in main_text.UNREAD:
        h = f"array_to_string(list_transform(string_split_regex({h}, '(?i)</{tag}[^<>]*>'), lambda x: regexp_replace(x, '(?is)<{tag}[{space}/>].*', ' ')), ' ')"
    costs = ", ".join(f"({i}, '{m}', {c})" for i, (m, c) in enumerate(main_text.COSTS.items()))
    piece = f"case when starts_with(w, '<') then case when regexp_matches(w, {S.q(main_text.LINE_TAGS)}) then chr(10) else '' end when regexp_matches(w, '^[{space}]') then ' ' else w end"
    return f"""(
with g as (select page_id, regexp_extract_all({h}, '{main_text.TOKEN}') as toks from pages),
m as (select * from (values {costs}) as v(ord, method, cost)),
t as (select page_id, ord, method, w, k, case when starts_with(w, '<') then -cost when regexp_matches(w, '^[{space}]') then 0 else 1 end as s from (select page_id, unnest(toks) as w, generate_subscripts(toks, 1) as k from g), m),
p as (select *, sum(s) over (partition by page_id, ord order by k) - s as before from t),
q as (select *, min(before) over (partition by page_id, ord order by k) as least from p),
r as (select *, before + s - least as total, max(case when before = least then k end) over (partition by page_id, ord order by k) as start from q),
b as (select page_id, ord, min_by(start, struct_pack(a := -total, b := k)) as first, min_by(k, struct_pack(a := -total, b := k)) as last, max(total) as best from r group by page_id, ord)
select g.page_id, m.ord, m.method, {S.layout(S.unescape("coalesce(x.t, '')"))} as text from g cross join m left join (
  select t.page_id, t.ord, string_agg({piece}, '' order by k) as t from t join b on t.page_id = b.page_id and t.ord = b.ord and k between first and last and best > 0 group by all) x on x.page_id = g.page_id and x.ord = m.ord)"""


def _candidates() -> str:
    from .web_queries import _html_layout, _meta

    og, own = _meta("og:description", "property"), _meta("description", "name")
    found = f"""(select page_id + {PAGES} as doc_id, ord, method, text from {_segments()} union all select page_id + {PAGES}, 2, 'innerText', {_html_layout('html')} from pages
      union all select page_id + {PAGES}, 3, 'og:description', case when {og} <> '' then {og} else {own} end from (select page_id, coalesce(html, '') as h from pages) union all select doc_id, ord, method, text from {X.CANDIDATES.sql})"""
    return f"""
with c as (select doc_id, ord, method, {_uncommented('text')} as t from {found}),
l as (select *, lower(t) as low, list_filter({_LINES.format('t')}, lambda x: {S.strip('x')} <> '') as lines from c),
s as (select *, case when t = '' then 0.0 else greatest(0.0, length(t) * case method when 'json-ld' then 1.0 when 'trafilatura' then 1.0 when 'resiliparse' then 1.0 when 'wide_segment' then 1.0 when 'tight_segment' then 1.0 when 'og:description' then 0.9 when 'innerText' then 0.4 when 'soup' then 0.35 else 0.5 end
  - (400 * {S.occurrences('low', L.COMMENT_MARKERS)} + 120 * {S.occurrences('low', L.BOILERPLATE_MARKERS)} + 5000 * {S.occurrences('low', L.CHALLENGE_MARKERS)} + 0.3 * length(t) * (len(list_filter(lines, lambda x: length(x) <= 3)) / greatest(1, len(lines))::double))
  + case method when 'json-ld' then 1200 when 'trafilatura' then 300 when 'resiliparse' then 300 when 'wide_segment' then 300 when 'tight_segment' then 300 when 'og:description' then -200 else 0 end) end as score from l)
select doc_id, method, t as text, cast(round(score, 6) as double) as score from s qualify row_number() over (partition by doc_id order by score desc, ord) = 1"""


QUERIES = {
    "web_quality": web_quality,
    "pdf_like": per_text("pdf_like", lambda c: quality.pdf_like(text.text_of(c))),
    "unavailable": per_text("unavailable", quality.unavailable),
    "raw_pdf": per_text("raw_pdf", quality.raw_pdf),
    "corrupted_text": per_text("corrupted", quality.corrupted),
    "valid_text": per_text("valid", quality.valid_text),
    "challenge": per_text("challenge", quality.challenge),
    "ocr_quality": per_text("fit", quality.ocr_fit),
    "marker_counts": marker_counts,
    "placeholder_texts": placeholder_texts,
    "ws_normalize": per_text("normalized", text.collapse, X.RAW_TEXTS),
    "ws_layout": per_text("normalized", text.layout, X.RAW_TEXTS),
    "encoding_fix": per_text("fixed", text.fix_encoding, X.RAW_TEXTS),
    "page_artifacts": per_text("cleaned", lambda c: text.drop_page_artifacts(text.text_of(c)), X.RAW_TEXTS),
    "line_breaks": per_text("cleaned", lambda c: text.join_lines(text.text_of(c)), X.RAW_TEXTS),
    "pdf_clean": per_text("cleaned", text.clean_pdf_text, X.RAW_TEXTS),
    "comment_strip": per_text("cleaned", text.strip_comment_noise, X.RAW_TEXTS),
    "docs_chrome": per_text("cleaned", text.drop_editor_chrome, X.RAW_TEXTS),
    "ocr_clean": per_text("cleaned", text.clean_ocr, X.RAW_TEXTS),
    "candidate_pick": candidate_pick,
    "main_text_segments": main_text_segments,
    "pdf_backend_pick": pdf_backend_pick,
}

ORACLES = {
    "web_quality": _web_quality(),
    "pdf_like": _per("pdf_like", _PDF),
    "unavailable": _per("unavailable", _GONE),
    "raw_pdf": _per("raw_pdf", _RAW),
    "corrupted_text": _per("corrupted", _CORRUPT),
    "valid_text": _per("valid", _VALID),
    "challenge": _per("challenge", f"{S.hits('lower(t)', L.CHALLENGE_SIGNALS)} >= 2"),
    "ocr_quality": _per("fit", f"length({S.strip('t')}) >= 50 and ({_SOLID} = 0 or {_LETTERS} >= 0.3 * {_SOLID})"),
    "marker_counts": f"select doc_id, cast({S.occurrences('t', L.COMMENT_MARKERS)} as bigint) as comments, cast({S.occurrences('t', L.BOILERPLATE_MARKERS)} as bigint) as boilerplate, cast({S.occurrences('t', L.CHALLENGE_MARKERS)} as bigint) as challenges from (select doc_id, lower(coalesce(text, '')) as t from {_sql()})",
    "placeholder_texts": f"select doc_id, length({S.strip('t')}) >= 200 and not ({S.any_of('t', L.DRIVE_PLACEHOLDERS)} and length({S.strip('t')}) < 500) as drive, case when not ({S.hits('t', L.DOCS_PLACEHOLDERS)} >= 2 and length({S.strip('t')}) < 500) and length({_unchromed('t')}) > 200 then {_unchromed('t')} end as docs from (select doc_id, coalesce(text, '') as t from {_sql()})",
    "ws_normalize": _cleaned("normalized", S.collapse("text")),
    "ws_layout": _cleaned("normalized", S.layout("text")),
    "encoding_fix": _cleaned("fixed", _fixed("text")),
    "page_artifacts": _cleaned("cleaned", _artifacts("coalesce(text, '')")),
    "line_breaks": _cleaned("cleaned", _joined("coalesce(text, '')")),
    "pdf_clean": _cleaned("cleaned", S.strip(_joined(_artifacts(f"regexp_replace({_fixed('text')}, '{S.WS}+', ' ', 'g')")))),
    "comment_strip": _cleaned("cleaned", _uncommented("text")),
    "docs_chrome": _cleaned("cleaned", _unchromed("text")),
    "ocr_clean": _cleaned("cleaned", _ocr("text")),
    "candidate_pick": _candidates(),
    "main_text_segments": f"select page_id, method, text from {_segments()}",
    "pdf_backend_pick": f"select path, ord, text from (select *, coalesce(text, '') as t, {_WORDS.replace('coalesce(t, ', 'coalesce(text, ')} as words from {X.PDF_ATTEMPTS.sql}) where {_VALID} qualify row_number() over (partition by path order by ord) = 1",
}
