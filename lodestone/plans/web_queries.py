"""Queries on URLs, pages, feeds and recorded fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text, urls
from ..operators import policy, postings, selection
from ..sources import feeds
from ..sources.files import spread
from . import fixtures as X
from . import sql_parts as S
from .text_queries import _sql, _web_quality, documents


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "url", F.lit("").alias("html")).unionByName(X.URLS.frame(spark, sf_dir))


_URLS = f"(select page_id as id, url, '' as html from pages union all select * from {X.URLS.sql})"
_HTML = f"(select page_id, url, html from pages union all select * from {X.PAGES.sql})"


def per_url(**columns):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return page_urls(spark, sf_dir).select("id", *[f().alias(n) for n, f in columns.items()])

    return query


def page_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).unionByName(X.PAGES.frame(spark, sf_dir))


U = lambda: F.col("url")


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.REDIRECTS.frame(spark, sf_dir).select("id", urls.unwrap_redirect(F.col("raw"), F.col("base")).alias("target"))


def filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.FILENAMES.frame(spark, sf_dir).select("id", urls.safe_filename(F.col("name")).alias("safe"), urls.docs_export(F.lit("https://docs.google.com/document/d/ID1/edit"), F.col("kind")).alias("export"))


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_html(spark, sf_dir).select("page_id", text.html_to_layout(F.col("html")).alias("text"))


def jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.jsonld_body(page_html(spark, sf_dir))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_html(spark, sf_dir).select("page_id", selection.description(F.col("html")).alias("description"))


def rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.items(X.FEEDS.frame(spark, sf_dir))


def rss_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.items(X.FEEDS.frame(spark, sf_dir), limit=1).select("source", "title", "url")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.ROUTES.frame(spark, sf_dir).select("id", policy.route(U(), F.col("content_type")).alias("route"), F.array_join(policy.tier_plan(F.col("available")), ",").alias("tiers"))


def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return X.RETRIES.frame(spark, sf_dir).select("id", policy.retry_action(c("status"), c("server"), c("ray"), c("attempt")).alias("action"), policy.retry_wait(c("attempt")).alias("wait"))


def attempts_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_attempt(X.ATTEMPTS.frame(spark, sf_dir))


def escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts over the fixture, and over documents: by HTTP for every third one, else empty-handed, then by a browser."""
    docs = documents(spark, sf_dir).select(F.concat(F.lit("https://docs.org/"), "doc_id").alias("url"), "doc_id", "text")
    tried = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(m).alias("method"), text_.alias("content")) for i, (m, text_) in enumerate((("http", F.when(F.col("doc_id") % 3 == 0, F.col("text"))), ("playwright", F.col("text"))))])
    found = docs.select("url", F.explode(tried).alias("a")).select("url", "a.*", F.lit(False).alias("transport_challenge"))
    return policy.escalate(X.ATTEMPTS.frame(spark).drop("score").unionByName(found))


def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.settled(X.LOADS.frame(spark, sf_dir))


def screenshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    heights = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("n_chars").alias("height"))
    return heights.select("doc_id", policy.shots(F.col("height"), F.lit(800)).cast("int").alias("shots"))


def ats_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = page_urls(spark, sf_dir).select("id", "url").unionByName(X.POSTINGS.frame(spark, sf_dir).select(F.col("id") + 1000, "url").toDF("id", "url")).withColumn("kind", urls.ats_kind(U()))
    account, posting = postings.posting_ids(F.col("kind"), U())
    return kinds.filter("kind is not null").select("id", "kind", account.alias("account"), posting.alias("posting"))


def ats_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.decoded(X.POSTINGS.frame(spark, sf_dir), least=1).select("url", "kind", "text")


def _any_host(words: list[str]) -> str:
    return S.any_of(S.host("url"), words)


_KIND = "case " + " ".join(f"when contains(h, '{p}')" + (" or contains(u, 'CandidateExperience') or contains(u, 'hcmUI')" if k == "oracle_hcm" else "") + f" then '{k}'" for p, k in L.ATS_HOSTS) + " end"
_DRIVE_ID = "coalesce(" + ", ".join(f"nullif(regexp_extract(coalesce(url, ''), '{p}', 1), '')" for p in ("/file/d/([a-zA-Z0-9_-]+)", "[?&]id=([a-zA-Z0-9_-]+)", "/uc[?&]id=([a-zA-Z0-9_-]+)")) + ")"


def _param(key: str, of: str = "qs") -> str:
    return f"nullif(url_decode(replace(regexp_extract('&' || {of}, '&{key}=([^&]+)', 1), '+', ' ')), '')"


def _redirects() -> str:
    full = f"""case when origin <> '' and starts_with(raw, '//') then regexp_extract(base, '^([a-zA-Z][a-zA-Z0-9+.-]*:)//', 1) || raw when origin <> '' and starts_with(raw, '/') then origin || raw else raw end"""
    once = ", ".join(f"url_decode({_param(k)})" for k in L.REDIRECT_KEYS)
    return f"""
with r as (select id, {S.strip("coalesce(raw, '')")} as raw, coalesce(base, '') as base, regexp_extract(coalesce(base, ''), '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) as origin from {X.REDIRECTS.sql}),
f as (select id, {full} as u from r), q as (select id, u, regexp_extract(u, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^?#]*\\?([^#]*)', 1) as qs from f)
select id, coalesce({once}, u) as target from q"""


def _safe(x: str) -> str:
    n = f"regexp_replace({x}, '[<>:\"/\\\\|?*]', '_', 'g')"
    return f"(select case when length(n) <= 100 then n when not contains(n, '.') then left(n, 95) when split_part(n, '.', -1) = '' then left(left(n, length(n) - 1), 95) else left(left(n, length(n) - length(split_part(n, '.', -1)) - 1), 95) || '.' || split_part(n, '.', -1) end from (select {n} as n))"


def _html_layout(x: str) -> str:
    x = f"regexp_replace(regexp_replace(coalesce({x}, ''), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?i)<br{S.WS}*/?>', chr(10), 'g'), '(?i)</(p|div|li|h[1-6]|tr)>', chr(10), 'g')"
    return S.layout(S.unescape(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"))


def _meta(prop: str, attribute: str) -> str:
    quote, inner = "[\"'']", f"{attribute}=[\"'']{prop}[\"'']"
    one = f"regexp_extract(h, '(?is)<meta[^>]+{inner}[^>]*content={quote}(.*?){quote}', 1)"
    two = f"regexp_extract(h, '(?is)<meta[^>]+content={quote}(.*?){quote}[^>]*{inner}', 1)"
    return S.layout(S.unescape(f"(case when {one} <> '' then {one} else {two} end)"))


def _jsonld() -> str:
    return f"""
with b as (select page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<script[^>]+type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1)) as raw, generate_subscripts(regexp_extract_all(coalesce(html, ''), '(?is)<script[^>]+type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1), 1) as block from {_HTML}),
j as (select page_id, block, trim(raw)::json as d from b where json_valid(trim(raw))),
n as (select page_id, block, case json_type(d) when 'ARRAY' then d::json[] else coalesce((d->'$."@graph"')::json[], [d]) end as nodes from j),
v as (select page_id, block, unnest(nodes) as node, generate_subscripts(nodes, 1) as spot from n),
k as (select page_id, block, spot, 0 as k, case when json_type(node, '$.articleBody') = 'VARCHAR' then node->>'$.articleBody' end as value from v union all select page_id, block, spot, 1, case when json_type(node, '$.description') = 'VARCHAR' then node->>'$.description' end from v),
best as (select page_id, value from k where coalesce(value, '') <> '' qualify row_number() over (partition by page_id order by length(value) desc, block, spot, k) = 1)
select page_id, {_html_layout('value')} as body from best"""


def _ids() -> str:
    seg = f"list_filter(string_split({S.path('u')}, '/'), lambda s: s <> '')"
    return f"""
with k as (select id, u, h, p, qs, seg, {_KIND} as kind from (select id, coalesce(url, '') as u, {S.host('url')} as h, {S.path('url')} as p, regexp_extract(coalesce(url, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^?#]*\\?([^#]*)', 1) as qs, {seg.replace("coalesce(u, '')", "coalesce(url, '')")} as seg
  from (select id, url from {_URLS} union all select id + 1000, url from {X.POSTINGS.sql}))),
m as (select *, list_position(seg, 'job') as job, list_position(seg, 'jobs') as jobs, list_position(seg, 'careers') as careers, list_position(seg, 'j') as j, list_position(seg, 'sites') as sites, {_param('for')} as board, {_param('token')} as token, {_param('gh_jid')} as jid, split_part(h, '.', 1) as sub from k where kind is not null)
select id, kind, case kind
  when 'greenhouse' then case when contains(p, 'embed') and board is not null then board when regexp_matches(p, '/([^/]+)/jobs/([0-9]+)') then regexp_extract(p, '/([^/]+)/jobs/([0-9]+)', 1) else nullif(regexp_extract(h, '^([^.]+)\\.greenhouse\\.io', 1), '') end
  when 'lever' then nullif(regexp_extract(p, '^/([^/]+)/[0-9a-f-]{{16,}}', 1), '') when 'workday' then case when job > 1 then seg[job - 1] end
  when 'ashby' then seg[1] when 'smartrecruiters' then seg[1] when 'recruitee' then sub when 'workable' then case when starts_with(h, 'apply.') and len(seg) > 0 then seg[1] else sub end
  when 'personio' then h when 'bamboohr' then sub when 'teamtailor' then h when 'eightfold' then sub when 'oracle_hcm' then case when sites > 0 then seg[sites + 1] end end as account,
case kind
  when 'greenhouse' then case when contains(p, 'embed') and board is not null then coalesce(token, jid) when regexp_matches(p, '/([^/]+)/jobs/([0-9]+)') then regexp_extract(p, '/([^/]+)/jobs/([0-9]+)', 2) else jid end
  when 'lever' then nullif(regexp_extract(p, '^/[^/]+/([0-9a-f-]{{16,}})', 1), '') when 'workday' then case when job > 1 then '/' || array_to_string(seg[job:], '/') end
  when 'ashby' then seg[2] when 'smartrecruiters' then nullif(regexp_extract(coalesce(seg[2], ''), '^([0-9]+)', 1), '') when 'recruitee' then seg[-1]
  when 'workable' then coalesce(case when j > 0 then seg[j + 1] end, nullif(regexp_extract(coalesce(seg[-1], ''), '^([A-Z0-9]{{6,}})$', 1), ''))
  when 'personio' then coalesce(case when job > 0 then nullif(regexp_extract(coalesce(seg[job + 1], ''), '^([0-9]+)', 1), '') end, {_param('id')}, {_param('jobId')}, {_param('job_id')})
  when 'bamboohr' then case when careers > 0 then nullif(regexp_extract(coalesce(seg[careers + 1], ''), '^([0-9]+)', 1), '') end
  when 'teamtailor' then case when jobs > 0 then nullif(regexp_extract(coalesce(seg[jobs + 1], ''), '^([0-9]+)', 1), '') end
  when 'eightfold' then coalesce({_param('pid')}, {_param('jobid')}, {_param('job_id')}, list_filter(list_reverse(seg), lambda s: regexp_full_match(s, '[0-9]{{6,}}'))[1])
  when 'oracle_hcm' then case when job > 0 then seg[job + 1] end end as posting from m"""


def _decode() -> str:
    """The decoded texts of the recorded payloads, written out by hand from the payloads."""
    nl = " || chr(10) || "
    lines = {
        1: ("greenhouse", ["Engineer", "Company: Acme", "Location: Berlin", "Build & run", "things"]), 2: ("lever", ["Designer", "Location: Rome", "Team: Art", "Join", " us", "You will", "draw", "Bye"]), 3: ("workday", ["Worker", "Location: Oslo", "Posted: Today", "Do work"]), 4: ("ashby", ["Yes", "Location: Remote", "Type: FullTime", "Hi"]),
        5: ("smartrecruiters", ["Clerk", "Location: Bonn, de", "About", "Us", "Role", "Work"]), 6: ("recruitee", ["By slug", "Location: Lyon", "Employment type: part", "D", "R"]), 7: ("workable", ["Cook", "Location: Wien, Austria", "Cook", "Food"]), 8: ("personio", ["Nurse", "Location: Ulm", "Tasks", "Care"]),
        9: ("bamboohr", ["Tester", "Location: Riga, LV", "Department: QA", "Test"]), 10: ("oracle_hcm", ["Pilot", "Location: Kiel", "Fly"]), 11: ("teamtailor", ["Baker", "Location: Graz", "Employment type: FULL", "Bake"]), 12: ("eightfold", ["Second", "Location: Nice, Lyon", "Department: R&D", "Think"]), 13: ("greenhouse", None), 14: (None, None),
    }
    rows = ", ".join(f"({i}, {X.literal(k)}, {nl.join(map(X.literal, t)) if t else 'null'})" for i, (k, t) in lines.items())
    parts = f"select 'https://boards.greenhouse.io/acme/jobs/' || p_partkey, 'greenhouse', p_name{nl}'Company: ' || p_brand{nl}'Location: ' || p_type{nl}'Build & run'{nl}'size ' || p_size from part"
    return f"select url, kind, cast(text as varchar) as text from {X.POSTINGS.inline} p join (values {rows}) as v(id, kind, text) using (id) union all {parts}"


def _escalated() -> str:
    """The policy for documents' two attempts, the first of which two in three times brings nothing; without an agent nothing is ruled out."""
    flag = lambda f: f"contains(',' || flags || ',', ',{f},')"
    return f"""select url, case e when 'good' then m when 'pdf' then 'pdf' else case when top >= {policy.BEST_EFFORT} then best end end as method, case e when 'good' then 'success' when 'pdf' then 'pdf' else case when top >= {policy.BEST_EFFORT} then 'best_effort' else 'failed' end end as status, tried
from (select 'https://docs.org/' || doc_id as url, case when one <> '' then one when {flag('pdf_like_content')} then 'pdf' when {flag('challenge_page')} then 'stop' when quality = 'good' then 'good' else '' end as e,
  case when one <> '' then 'http' else 'playwright' end as m, case when coalesce(text, '') <> '' then score else -1 end as top, case when doc_id % 3 = 0 then 'http' else 'playwright' end as best, case when one <> '' then 'http' else 'http,playwright' end as tried
  from (select *, case when doc_id % 3 <> 0 then '' when {flag('pdf_like_content')} then 'pdf' when quality = 'good' then 'good' else '' end as one from ({_web_quality()}) join {_sql()} using (doc_id)))"""


QUERIES = {
    "third_party": per_url(third_party=lambda: urls.is_third_party(U())),
    "url_valid": per_url(valid=lambda: urls.is_valid(U())),
    "url_extract": per_url(found=lambda: urls.first_url(U())),
    "pdf_url": per_url(pdf=lambda: urls.is_pdf(U())),
    "drive_ids": per_url(drive=lambda: urls.is_drive(U()), file=lambda: urls.drive_id(U()), download=lambda: urls.drive_download(U())),
    "docs_export": per_url(docs=lambda: urls.is_docs(U()), document=lambda: urls.docs_id(U()), export=lambda: urls.docs_export(U(), F.lit("pdf"))),
    "filename_sanitize": filenames,
    "redirect_unwrap": redirects,
    "useful_url": per_url(useful=lambda: urls.is_useful(U())),
    "ats_kind": per_url(kind=lambda: urls.ats_kind(U())),
    "ats_signature": per_url(kind=lambda: urls.ats_signature(U(), F.col("html"))),
    "search_url": per_url(search=lambda: urls.search_url(F.concat(F.lit("site "), text.text_of(U())))),
    "pdf_cache_key": per_url(key=lambda: urls.cache_key(U())),
    "html_strip": html_strip,
    "jsonld_body": jsonld,
    "meta_desc": meta,
    "rss_items": rss,
    "rss_limited": rss_limited,
    "fetch_route": routes,
    "retry_class": retries,
    "attempt_best": attempts_best,
    "escalation": escalation,
    "stability_run": stability,
    "screenshot_plan": screenshots,
    "ats_ids": ats_ids,
    "ats_decode": ats_decode,
}


def _url(expression: str, name: str) -> str:
    return f"select id, {expression} as {name} from {_URLS}"


_DOCS_ID = "nullif(regexp_extract(coalesce(url, ''), '/document/d/([a-zA-Z0-9_-]+)', 1), '')"
_IS_DOCS = f"(contains({S.host('url')}, 'docs.google.com') and contains({S.path('url')}, '/document/d/'))"
_IS_DRIVE = f"(contains({S.host('url')}, 'drive.google.com') and (contains({S.path('url')}, '/file/d/') or contains({S.path('url')}, '/uc?')))"
_IS_PDF = f"(ends_with(lower(coalesce(url, '')), '.pdf') or contains(lower({S.path('url')}), '.pdf'))"
_NAME = f"split_part({S.path('url')}, '/', -1)"
ORACLES = {
    "third_party": _url(_any_host(L.THIRD_PARTY), "third_party"),
    "url_valid": _url(f"regexp_matches({S.strip(S.q('') + ' || coalesce(url, ' + S.q('') + ')')}, '^https?://[^/?#]+')", "valid"),
    "url_extract": _url(S.first_url("url"), "found"),
    "pdf_url": _url(_IS_PDF, "pdf"),
    "drive_ids": f"select id, {_IS_DRIVE} as drive, {_DRIVE_ID} as file, 'https://drive.google.com/uc?export=download&id=' || {_DRIVE_ID} as download from {_URLS}",
    "docs_export": f"select id, {_IS_DOCS} as docs, {_DOCS_ID} as document, 'https://docs.google.com/document/d/' || {_DOCS_ID} || '/export?format=pdf' as export from {_URLS}",
    "filename_sanitize": f"select id, {_safe('name')} as safe, 'https://docs.google.com/document/d/ID1/export?format=' || case when kind in ('txt', 'pdf', 'html', 'docx', 'rtf', 'odt', 'epub') then kind else 'txt' end as export from {X.FILENAMES.sql}",
    "redirect_unwrap": _redirects(),
    "useful_url": _url(f"(not {S.any_of('lower(coalesce(url, ' + S.q('') + '))', L.BLOCKED_URLS)} and {S.any_of('lower(coalesce(url, ' + S.q('') + '))', L.ALLOWED_URLS)})", "useful"),
    "ats_kind": f"select id, {_KIND} as kind from (select id, coalesce(url, '') as u, {S.host('url')} as h from {_URLS})",
    "ats_signature": "select id, case " + " ".join(f"when {S.any_of('s', w)} then '{k}'" for k, w in L.ATS_SIGNATURES) + f" end as kind from (select id, lower(coalesce(url, '') || ' ' || coalesce(html, '')) as s from {_URLS})",
    "search_url": _url("'https://duckduckgo.com/?q=' || replace('site ' || coalesce(url, ''), ' ', '+')", "search"),
    "pdf_cache_key": _url(f"md5(url) || case when ends_with({_NAME}, '.pdf') then '_' || {_safe(_NAME)} else '.pdf' end", "key"),
    "html_strip": f"select page_id, {_html_layout('html')} as text from {_HTML}",
    "jsonld_body": _jsonld(),
    "meta_desc": f"select page_id, case when {_meta('og:description', 'property')} <> '' then {_meta('og:description', 'property')} else {_meta('description', 'name')} end as description from (select page_id, coalesce(html, '') as h from {_HTML})",
    "rss_items": "select * from (values ('one', cast(0 as bigint), 'PhD in GIS & RS', 'https://a.org/1', 'Text & more', 'Mon, 1 Jan 2024'), ('one', 2, 'Second', 'https://a.org/2', '', ''), ('two', 0, 'Only', 'https://b.org', 'd', '')) as v(source, ord, title, url, description, published) union all select 'd' || page_id, 0, 'Page ' || page_id || ' & more', 'https://a.org/' || page_id, 'On ' || (page_id % 7), 'Mon, 1 Jan 2024' from pages",
    "rss_limited": "select * from (values ('one', 'PhD in GIS & RS', 'https://a.org/1'), ('two', 'Only', 'https://b.org')) as v(source, title, url) union all select 'd' || page_id, 'Page ' || page_id || ' & more', 'https://a.org/' || page_id from pages",
    "fetch_route": f"""select id, case when {_IS_DOCS} then 'docs' when {_IS_DRIVE} then 'drive' when ({_KIND}) is not null then 'ats' when {_IS_PDF} or contains(lower(coalesce(content_type, '')), 'application/pdf') then 'pdf' else 'web' end as route,
array_to_string(list_filter(['http', 'curl_cffi', 'playwright', 'ocr', 'browser_agent'], lambda t: t = 'http' or list_contains(available, t)), ',') as tiers from (select *, coalesce(url, '') as u, {S.host('url')} as h from {X.ROUTES.sql})""",
    "retry_class": f"select id, case when status in (403, 503) and (contains(lower(coalesce(server, '')), 'cloudflare') or ray is not null) then 'challenge' when status between 400 and 499 and status not in (408, 429) then 'stop' when attempt >= 2 then 'give_up' else 'retry' end as action, cast(2 ** attempt as bigint) as wait from {X.RETRIES.sql}",
    "attempt_best": f"select url, ord, method, score from {X.ATTEMPTS.sql} where coalesce(content, '') <> '' qualify row_number() over (partition by url order by score desc, ord) = 1",
    # What the policy gives for each URL, worked out by hand.
    "escalation": """select * from (values ('https://a.org', 'http', 'success', 'http'), ('https://b.org', 'browser_agent', 'success', 'http,curl_cffi,browser_agent'), ('https://c.taleo.net/x', 'http', 'best_effort', 'http,browser_agent'), ('https://d.org', 'pdf', 'pdf', 'http,curl_cffi'),
('https://e.org', 'http', 'best_effort', 'http,playwright'), ('https://f.org', null, 'failed', 'http,curl_cffi,browser_agent'), ('https://g.org', 'http', 'best_effort', 'http,curl_cffi,playwright,browser_agent'), ('https://h.org', null, 'failed', 'http')) as v(url, method, status, tried) union all """
    + _escalated(),
    "stability_run": f"""with s as (select *, coalesce(content_hash = lag(content_hash) over w and content_length = lag(content_length) over w, false) as same from {X.LOADS.sql} window w as (partition by page order by ord))
select a.page, min(case when b.same and a.same and b.ord = a.ord - 1 then a.ord end) as settled_at from s a left join s b on a.page = b.page and b.ord = a.ord - 1 group by a.page""",
    "screenshot_plan": "select doc_id, cast(case when n_chars <= 1200 then 1 else least(10, n_chars // 800 + 1) end as integer) as shots from documents",
    "ats_ids": _ids(),
    "ats_decode": _decode(),
}
