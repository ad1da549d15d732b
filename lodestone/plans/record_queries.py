"""Queries on contacts, records, the work table, model calls and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contacts, json_text, text
from ..functions import lexicon as L
from ..operators import catalog, model_calls, rules, selection, sheet
from ..sources import layout
from ..streaming import flush
from . import fixtures as X
from . import sql_parts as S
from .text_queries import documents

C = F.col


def email_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.EMAILS.frame(spark, sf_dir).select("id", text.clean_email(C("email")).alias("cleaned"))


def email_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = documents(spark, sf_dir).unionByName(X.EMAILS.frame(spark, sf_dir).select(C("id").alias("doc_id"), "text"))
    return both.select("doc_id", F.array_join(contacts.email_candidates(C("text")), ",").alias("emails"))


def email_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.EMAILS.frame(spark, sf_dir).select("id", F.array_join(contacts.email_domains(C("text")), ",").alias("domains"))


def email_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.EMAILS.frame(spark, sf_dir).select("id", contacts.generic_email(C("email"), C("name")).alias("generic"))


def verify_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed, case = contacts.verify_decision(C("name"), C("email"), C("text"))
    return X.EMAILS.frame(spark, sf_dir).select("id", needed.alias("needed"), case.alias("reason"))


def name_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.NAMES.frame(spark, sf_dir).select("id", contacts.clean_name(C("name")).alias("cleaned"))


def name_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.NAMES.frame(spark, sf_dir).select("id", contacts.formatted_name(C("name"), text.text_of(C("title"))).alias("formatted"))


def name_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.NAMES.frame(spark, sf_dir).select("id", contacts.name_relevant(C("text"), C("name")).alias("relevant"))


def profile_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contacts.promising_profile(C("url"), C("title"), C("snippet"), F.lit("Dr. Jo Lee"))
    return X.RESULTS.frame(spark, sf_dir).select("query_id", "ord", found.alias("promising"))


def result_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.distinct_results(X.RESULTS.frame(spark, sf_dir)).select("query_id", "ord", "url")


def result_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top_results(X.RESULTS.frame(spark, sf_dir))


def contact_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.vote(X.ANALYSES.frame(spark, sf_dir))


def label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote over the shared tables: sources as contacts, labelled documents as pages, good quality as the doctorate."""
    labels, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    none = F.lit(None).cast("string")
    pages = labels.join(docs.select("doc_id", "source"), "doc_id").select(C("source").alias("contact_id"), C("doc_id").alias("ord"), (C("quality") == 1).alias("has_doctorate"), *[none.alias(c) for c in ("gender", "email_address", "contact_name")])
    return selection.vote(pages).select(C("contact_id").alias("source"), C("doctors").alias("good"), C("pages").alias("n"), (C("title") == "Dr.").alias("accepted"))


def contact_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.DELTAS.frame(spark, sf_dir).select("id", rules.contact_delta(C("name"), C("email"), C("new_name"), C("new_email")).alias("changes"))


def json_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.JSON_TEXTS.frame(spark, sf_dir).select("id", json_text.json_object(C("response")).alias("found"))


def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.JSON_TEXTS.frame(spark, sf_dir).select("id", json_text.json_array(C("response")).alias("found"))


def chat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C("payload")
    return X.PAYLOADS.frame(spark, sf_dir).select("id", json_text.chat_text(p).alias("chat"), json_text.response_text(p).alias("response"), json_text.candidates_text(p).alias("candidates"))


def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = json_text.data_url(F.lit("text/plain"), C("text").cast("binary"))
    kind, encoded = json_text.split_data_url(C("data_url"))
    return documents(spark, sf_dir).filter("text is not null").select("doc_id", url.alias("data_url")).select("doc_id", "data_url", kind.alias("media_type"), encoded.alias("encoded"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.RECORDS.frame(spark, sf_dir).withColumn("r", rules.record_of(C("record")))


def stage_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C("r")
    return records(spark, sf_dir).select("id", rules.facts_verdict(r).alias("facts"), rules.flags_verdict(r).alias("flags"), rules.flags_strict(r).alias("flags_strict"), rules.labels_verdict(r).alias("labels"))


def places_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("id", rules.places(rules.value(C("r"), "Number_Places")).alias("places"))


def flag_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).filter("r is not null").select("id", rules.rendered(rules.pruned_flags(C("r"))).alias("kept"))


def business_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).filter("r is not null").select("id", rules.rendered(rules.post_processed(C("r"))).alias("record"))


def stage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    record, status, error = rules.merged_stages([rules.record_of(C(c)) for c in ("one", "two", "three")], [C("e1"), C("e2"), C("e3")])
    return X.STAGES.frame(spark, sf_dir).select("id", rules.rendered(record).alias("record"), status.alias("status"), error.alias("error"))


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.directions(C("found"))
    return X.DIRECTIONS.frame(spark, sf_dir).select("id", F.array_join(found, "|").alias("directions"), rules.directions_query(found).alias("query"), rules.direction_flow(C("found"), C("mapped")).alias("mapped"))


def unfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet.open_rows(X.SHEET.frame(spark, sf_dir)).select("row_index")


def row_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet.row_at(X.SHEET.frame(spark, sf_dir), 4)


def link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    link, notes = sheet.link_of(C("Source"), C("Notes"))
    return X.SHEET.frame(spark, sf_dir).select("row_index", link.alias("link"), notes.alias("used_notes"))


def ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.filter(F.split(F.concat_ws("|", "keys"), "\\|"), lambda x: x != "")
    return X.UPDATES.frame(spark, sf_dir).select("row_index", F.array_join(F.transform(sheet.padded(cells, 3), lambda x: F.coalesce(x, F.lit("-"))), ",").alias("cells"))


def sheet_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = X.UPDATES.frame(spark, sf_dir).select("row_index", F.map_from_arrays("keys", "vals").alias("cells"), "verifier", "error")
    return sheet.updated(X.SHEET.frame(spark, sf_dir), updates)


def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet.without_rows(X.SHEET.frame(spark, sf_dir), X.UPDATES.frame(spark, sf_dir))


def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = X.UPDATES.frame(spark, sf_dir).select("row_index", F.get("vals", F.lit(0)).alias("Notes"), C("error").alias("Error"))
    return sheet.with_rows(X.SHEET.frame(spark, sf_dir), new)


def sheet_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet.statistics(X.SHEET.frame(spark, sf_dir))


def sheet_stats_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet.statistics(X.SHEET.frame(spark, sf_dir), reviewed=True)


def row_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    verifier, error, done = sheet.outcome(*(C(c) for c in ("found", "link", "from_notes", "content", "has_results", "stage_error")))
    return X.OUTCOMES.frame(spark, sf_dir).select("id", verifier.alias("verifier"), error.alias("error"), done.alias("done"))


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet.conversation_lines(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def flush_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn is delivered twice; each conversation leaves once."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return flush.flushed_once(turns.unionByName(turns).withColumn("last", F.lit(False)))


def incremental_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales as a work table in ranges of their numbers, after an update by those that arrived over a day late."""
    sales = spark.read.parquet(f"{sf_dir}/sales.parquet")
    text = lambda name: C(name).cast("string")
    path = layout.shared_folder(spark, "sales")
    layout.create(sales.select(C("sale_id").alias("row_index"), "client_id", "status", text("priority").alias("priority"), F.lit(None).cast("string").alias("Verifier"), F.lit("").alias("Error")), path)
    late = sales.filter("arrived_at - sold_at > interval 1 day")
    cells = F.map_from_entries(F.array(F.struct(F.lit("status"), F.concat(F.lit("late "), F.coalesce("status", F.lit("-")))), F.struct(F.lit("priority"), (C("priority") + 1).cast("string"))))
    layout.merge(spark, path, late.select(C("sale_id").alias("row_index"), C("arrived_at").alias("ord"), cells.alias("cells"), F.when(C("priority") > 3, "LLM").otherwise("").alias("verifier"), F.when(C("total") < 50, "low").alias("error")))
    counts = late.groupBy(C("sale_id").alias("row_index")).agg(F.count("*").alias("updates"))
    return layout.load(spark, path).join(counts, "row_index", "left")


def breaker_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaker over the fixture and over events, whose errors stand for refused logins."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    calls = events.select(F.lit("events").alias("client"), C("user_id").cast("string").alias("model"), C("event_id").cast("long").alias("ord"), F.unix_timestamp("ts").alias("ts"), F.when(C("event_type") == "error", 401).otherwise(200).alias("status"))
    return model_calls.breaker(X.MODEL_CALLS.frame(spark, sf_dir).unionByName(calls))


def chain_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of three models over the fixture and over events: each event is its user's request, its kind, value and number say how the models answer, its number which is asked first."""
    outcomes = F.transform(F.arrays_zip("models", "statuses"), lambda x: F.struct(x["models"].alias("model"), x["statuses"].cast("int").alias("status")))
    kind, id_ = C("event_type"), C("event_id").cast("long")
    statuses = {"a": F.when(kind == "error", 401).when(kind == "click", 500).otherwise(200), "b": F.when(C("value") > 30, 403).when(kind == "purchase", 500).otherwise(200), "c": F.when(id_ % 4 == 0, 401).when(id_ % 4 == 1, 429).otherwise(200)}
    chain = F.array(*[F.struct(F.lit(m).alias("model"), status.cast("int").alias("status")) for m, status in statuses.items()])
    turned = F.concat(F.slice(chain, (id_ % 3 + 1).cast("int"), 3), F.slice(chain, F.lit(1), (id_ % 3).cast("int")))
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select(C("user_id").cast("string").alias("client"), id_.alias("ord"), F.unix_timestamp("ts").alias("ts"), turned.alias("outcomes"))
    return model_calls.chain_results(X.CHAINS.frame(spark, sf_dir).select("client", "ord", "ts", outcomes.alias("outcomes")).unionByName(asked))


def model_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.price_list(X.PRICES.frame(spark, sf_dir))


def model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalogue_counts(X.PRICES.frame(spark, sf_dir))


QUERIES = {f.__name__: f for f in (email_clean, email_candidates, email_domains, email_generic, verify_decision, name_clean, name_format, name_relevant, profile_results, result_dedup, result_topk, contact_vote, label_vote, contact_delta, json_object, json_array, chat_text, data_urls, stage_validate, places_digits, flag_prune, business_rules, stage_merge, directions, unfilled, row_lookup, link_resolve, ragged_rows, sheet_update, delete_rows, append_rows, sheet_stats, sheet_stats_reviewed, row_outcome, conversation_log, flush_once, incremental_update, breaker_timeline, chain_pick, model_prices, model_counts)}

_E, _N, _R, _H = X.EMAILS.sql, X.NAMES.sql, X.RECORDS.sql, X.SHEET.sql
_TOKENS = "list_filter(regexp_extract_all(lower(n), '[a-z]+'), lambda t: length(t) >= {})"


def _generic(email: str, name: str) -> str:
    """Over columns e (cleaned, lower), l (local part), tk (tokens)."""
    return f"""case when {S.strip(f"coalesce({email}, '')")} in ('-', '', 'N/A') then false when not contains(e, '@') then true when list_contains({X.literal(L.GENERIC_LOCALS)}, split_part(e, '@', 1)) then true when len(tk) = 0 then false
else len(list_filter(tk, lambda t: contains(split_part(e, '@', 1), t))) = 0 and not (len(tk) >= 2 and contains(split_part(e, '@', 1), left(tk[1], 1) || tk[-1])) end"""


def _with_tokens(source: str, email: str, name: str) -> str:
    return f"(select *, lower({S.clean_email(email)}) as e, {_TOKENS.format(3)} as tk from (select *, {S.clean_name(name)} as n from {source}))"


def _candidates(t: str) -> str:
    w = S.WS
    plain = f"regexp_extract_all({t}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')"
    spaced = f"list_transform(regexp_extract_all({t}, '[A-Za-z0-9._%+-]+{w}*@{w}*[A-Za-z0-9.-]+(?:{w}*\\.{w}*[A-Za-z0-9.-]+)+'), lambda x: regexp_replace(x, '{w}+', '', 'g'))"
    spelled = f"regexp_extract_all({t}, '(?i)[A-Za-z0-9._%+-]+{w}*(?:\\[at\\]|\\(at\\)|{w}at{w}){w}*[A-Za-z0-9.-]+{w}*(?:\\[dot\\]|\\(dot\\)|{w}dot{w}|\\.){w}*[A-Za-z.]{{2,}}')"
    done = f"list_transform(list_concat(list_concat({plain}, {spaced}), {spelled}), lambda x: {S.clean_email('x')})"
    return f"list_sort(list_distinct(list_filter({done}, lambda x: contains(x, '@') and not regexp_matches(x, '^(info|contact|admissions|webmaster|privacy|email)@'))))"


def _decision() -> str:
    w = S.WS
    quoted = "regexp_escape(n)"
    return f"""
with b as (select id, email, {S.strip("coalesce(name, '')")} as name, coalesce(text, '') as text from {_E}), c as (select * from {_with_tokens('b', 'email', 'name')}),
d as (select *, {S.strip("coalesce(email, '')")} not in ('-', '', 'N/A') as has, {_generic('email', 'name')} as g, starts_with(name, 'Dr. ') as doctor,
  regexp_matches(text, '(?i)\\b(?:Dr\\.?|Prof\\.?|Professor|Assistant{w}+Professor|Associate{w}+Professor|Doctor){w}+' || {quoted}) or regexp_matches(text, '(?i)' || {quoted} || '{w}*,?{w}*(?:Ph\\.?D|Professor)') as titled from c),
r as (select id, case when name in ('-', '', 'N/A') then 'no contact' when doctor and has and not g then 'doctor with email' when doctor and has then 'doctor with generic email' when doctor then 'doctor without email'
  when titled and has and not g then 'title and email already present' when titled and has then 'title with generic email' when titled then 'title without email' else 'title unclear' end as reason from d)
select id, reason not in ('no contact', 'doctor with email', 'title and email already present') as needed, reason from r"""


def _formatted() -> str:
    x = "n"
    for pattern in ("(?i)\\b(Ph\\.?D\\.?|PhD|Doctor|Professor|Prof\\.?)\\b", "\\([^)]*\\)", "\\[[^\\]]*\\]", "[,;]", f"[^a-zA-Z{S.WS[1:-1]}.\\-]"):
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    return f"select id, case when f = '' then '' when title in ('Dr.', 'Mr.', 'Ms.') then title || ' ' || f else f end as formatted from (select id, title, {S.collapse(x)} as f from (select *, {S.clean_name('name')} as n from {_N}))"


def _relevant(t: str) -> str:
    return f"""({t} <> '' and nm <> '' and (contains(lower({t}), lower(n)) or (len(tk) >= 2 and contains(lower({t}), tk[-1]) and (contains(lower({t}), tk[1]) or contains(lower({t}), left(tk[1], 1) || '.') or contains(lower({t}), left(tk[1], 1) || ' ')))))"""


def _score() -> str:
    domain = "case " + " ".join(f"when contains(u, '{d}') then {(8 - i) * 10}" for i, d in enumerate(L.PRIORITY_DOMAINS)) + " else 0 end"
    either = lambda words, a, b: f"len(list_filter({X.literal(words)}, lambda w: contains({a}, w) or contains({b}, w)))"
    return f"""{domain} + 18 * {S.hits('u', L.PATH_HINTS)} + if({S.any_of('u', L.HOST_HINTS)}, 15, 0) + if(len({_candidates("t || ' ' || s")}) > 0, 100, 0) - if({S.any_of('u', L.SOCIAL_HINTS)}, 20, 0) + 5 * {either(L.TITLE_WORDS, 't', 's')} + 3 * {either(L.PAGE_WORDS, 'u', 't')}"""


_DISTINCT = f"(select * from {X.RESULTS.sql} where coalesce(url, '') <> '' qualify row_number() over (partition by query_id, url order by ord) = 1)"


def _field(name: str, r: str = "record") -> str:
    return f"json_extract_string({r}, '$.\"{name}\"')"


def _flag(name: str, r: str = "record") -> str:
    return f"{S.strip(f'''coalesce({_field(name, r)}, '')''')} = '1'"


def _keys(r: str = "record") -> str:
    return f"json_keys({r})"


_GEO_N = f"len(list_filter({_keys()}, lambda k: list_contains({X.literal(L.GEO_FIELDS)}, k)))"
_ONES = f"len(list_filter({_keys()}, lambda k: json_extract_string(record, '$.\"' || k || '\"') is distinct from '1')) = 0"
_EMPTY = f"(record is null or len({_keys()}) = 0)"


def _lacks(fields: list[str]) -> str:
    return f"len(list_filter({X.literal(fields)}, lambda f: not list_contains({_keys()}, f))) > 0"


def _rendered(pairs: list[str]) -> str:
    return f"array_to_string(list_sort(list_filter([{', '.join(pairs)}], lambda x: x is not null)), '; ')"


def _pruned() -> str:
    stage2 = [f"case when {_flag(f)} then '{f}=1' end" for f in L.STAGE2_FIELDS]
    others = [f"case when list_contains({_keys()}, '{f}') then '{f}=' || coalesce({_field(f)}, '') end" for f in [*L.STAGE1_FIELDS, *L.STAGE3_FIELDS, "Other"]]
    return f"select id, {_rendered(stage2 + others)} as kept from {_R} where record is not null"


def _ruled() -> str:
    event = " or ".join(_flag(f) for f in L.EVENT_TYPES)
    dl, cn = S.strip(f"coalesce({_field('Deadline')}, '')"), S.strip(f"coalesce({_field('Contact_Name')}, '')")
    fits = f"({dl} in ('', 'Soon') or regexp_matches({dl}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))"
    values = {}
    for f in L.STAGE1_FIELDS + L.STAGE3_FIELDS:
        v = f"coalesce({_field(f)}, '')"
        values[f] = S.strip(v) if f in L.TRIMMED_FIELDS else v
    values["Number_Places"] = f"case when {event} then '' else regexp_extract(coalesce({_field('Number_Places')}, ''), '[0-9]+') end"
    values["Contact_Email"] = f"case when {fits} and {cn} = '-' then '-' else {S.clean_email(values['Contact_Email'])} end"
    pairs = [f"'{f}=' || {v}" for f, v in values.items()] + [f"case when {_flag(f)} then '{f}=1' end" for f in L.STAGE2_FIELDS] + [f"case when list_contains({_keys()}, 'Other') then 'Other=' || {_field('Other')} end"]
    return f"select id, {_rendered(pairs)} as record from {_R} where record is not null"


def _merged() -> str:
    later = lambda f: f"coalesce({_field(f, 'three')}, {_field(f, 'two')}, {_field(f, 'one')})"
    pairs = [f"'{f}=' || {later(f)}" for f in ("Deadline", "Direction", "GIS", "RS", "WX_Label1")]
    failed = "list_filter([e1, e2, e3], lambda e: coalesce(e, '') <> '')"
    return f"select id, {_rendered(pairs)} as record, case len({failed}) when 0 then 'full' when 3 then 'failed' else 'partial' end as status, array_to_string({failed}, '; ') as error from {X.STAGES.sql}"


def _directions() -> str:
    found = "list_filter(coalesce(from_json(json_extract(found, '$.directions'), '[\"VARCHAR\"]'), []), lambda d: coalesce(d, '') <> '')[1:3]"
    mapped = f"array_to_string(list_filter({X.literal(L.GEO_FIELDS)}, lambda f: coalesce(json_extract_string(mapped, '$.\"' || f || '\"') = '1', false)), ',')"
    return f"""select id, array_to_string(d, '|') as directions, array_to_string(list_transform(d, lambda x: '"' || x || '"'), ' and ') || ' relation to Geography GIS Remote Sensing' as query, case when len(d) > 0 then nullif(m, '') end as mapped from (select id, {found} as d, {mapped} as m from {X.DIRECTIONS.sql})"""


def _updated() -> str:
    cell = lambda c: f"case when list_contains(u.keys, '{c}') then u.vals[list_position(u.keys, '{c}')] else s.\"{c}\" end as \"{c}\""
    return f"""select s.row_index, {cell('Notes')}, {cell('Source')}, case when coalesce(u.verifier, '') <> '' then u.verifier else s."Verifier" end as "Verifier", coalesce(u.error, s."Error") as "Error" from {_H} s left join {X.UPDATES.sql} u on s.row_index = u.row_index"""


def _outcome() -> str:
    third = S.any_of(S.host("link"), L.THIRD_PARTY)
    return f"""
with o as (select *, case when not found then '无法获取行数据' when link is null then '未找到有效链接' when coalesce(content, '') = '' then '内容获取失败' end as early, has_results and coalesce(stage_error, '') = '' as ok from {X.OUTCOMES.sql})
select id, case when early is null and ok then 'LLM' end as verifier, coalesce(early, nullif(concat_ws('; ', nullif(stage_error, ''), case when not from_notes and {third} then '可能是第三方网址' end, case when ok and from_notes then '需转换链接' end), '')) as error, early is null and has_results as done from o"""


def _breaker() -> str:
    calls = f"select client, model, ord, ts, status from {X.MODEL_CALLS.sql} union all select 'events', cast(user_id as varchar), event_id, cast(floor(epoch(ts)) as bigint), if(event_type = 'error', 401, 200) from events"
    return f"""
with recursive c as (select *, row_number() over (partition by client, model order by ts, ord) as k from ({calls})),
w as (select *, cast(0 as bigint) as unblock, 'call' as action, case when status in (401, 403) then ts + 1800 else 0 end as later from c where k = 1
  union all select c.*, w.later, case when c.ts < w.later then 'skip' else 'call' end, case when c.ts < w.later then w.later when c.status in (401, 403) then c.ts + 1800 else 0 end from w join c on c.client = w.client and c.model = w.model and c.k = w.k + 1)
select client, model, ord, ts, cast(status as integer) as status, action from w"""


def _chains() -> str:
    """The fixture's results by hand, the events' by a walk along each user's requests with the three models' blocks."""
    use = "if(len(list_filter(chain, lambda o: o.u <= ts)) = 0, chain, list_filter(chain, lambda o: o.u <= ts))"
    block = lambda m: f"case when len(list_filter(tried, lambda o: o.m = '{m}' and o.s in (401, 403))) > 0 then ts + 1800 else u{m} end as u{m}"
    walk = lambda source, blocks: f"""select client, ord, k, {", ".join(map(block, "abc"))}, array_to_string(list_transform(tried, lambda o: o.m), ',') as tried, list_filter(tried, lambda o: o.s = 200)[1].m as model
      from (select *, use[1:coalesce(list_position(list_transform(use, lambda o: o.s), 200), len(use))] as tried from (select *, {use} as use from (select c.client, c.ord, c.k, c.ts, {blocks}, chain_of(c.n, c.sa, c.sb, c.sc, ua, ub, uc) as chain from {source})))"""  # noqa: E731
    turned = lambda a, b, c: "[" + ", ".join(f"{{'m': '{m}', 's': c.s{m}, 'u': u{m}}}" for m in (a, b, c)) + "]"
    chain = f"case c.n when 0 then {turned(*'abc')} when 1 then {turned(*'bca')} else {turned(*'cab')} end"
    first, later = (walk(source, blocks).replace("chain_of(c.n, c.sa, c.sb, c.sc, ua, ub, uc)", text) for source, blocks, text in (("c where c.k = 1", "0::bigint as ua, 0::bigint as ub, 0::bigint as uc", chain.replace("ua", "0::bigint").replace("ub", "0::bigint").replace("uc", "0::bigint")), ("w join c on c.client = w.client and c.k = w.k + 1", "ua, ub, uc", chain)))
    return f"""
with recursive c as (select cast(user_id as varchar) as client, event_id as ord, cast(floor(epoch(ts)) as bigint) as ts, event_id % 3 as n, case event_type when 'error' then 401 when 'click' then 500 else 200 end as sa,
  case when value > 30 then 403 when event_type = 'purchase' then 500 else 200 end as sb, case event_id % 4 when 0 then 401 when 1 then 429 else 200 end as sc, row_number() over (partition by user_id order by event_id, ts) as k from events),
w as ({first} union all {later})
select client, ord, tried, model from w union all
select * from (values ('c', cast(0 as bigint), 'a,b', 'b'), ('c', 1, 'b', 'b'), ('c', 2, 'b', null), ('c', 3, 'a,b', null), ('c', 4, 'b', 'b'), ('c', 5, 'a', 'a'), ('d', 0, 'a', null), ('d', 1, 'a', 'a')) as v(client, ord, tried, model)"""


def _prices() -> str:
    low = "lower(model_name)"
    starts = lambda words: " or ".join(f"starts_with({low}, '{w}')" for w in words)
    platform = "case " + " ".join(f"when {starts(w)}" + (f" or contains({low}, 'gemini')" if p == "Google" else "") + f" then '{p}'" for p, w in L.PLATFORM_PREFIXES) + " else coalesce(nullif(owner_by, ''), '其他') end"
    per_call = "(coalesce(quota_type, 0) = 1 and coalesce(model_price, 0) <> 0)"
    out = "coalesce(model_ratio, 0) * coalesce(nullif(completion_ratio, 0), 1) * 2"
    note = f"concat_ws('; ', case when {per_call} then '按次计费 $' || cast(model_price as varchar) || '/次' end, case when coalesce(array_to_string(endpoints, ', '), '') not in ('', 'openai') then '端点: ' || array_to_string(endpoints, ', ') end)"
    return f"""
with p as (select model_name as name, {platform} as platform, not {S.any_of(low, L.TEXT_ONLY_NAMES)} and {S.any_of(low, L.VISION_NAMES)} as vision, case when not {per_call} then coalesce(model_ratio, 0) * 2 end as price, case when not {per_call} then {out} end as outp, {note} as note from {X.PRICES.sql} where coalesce(model_name, '') <> '')
select name, platform, vision, coalesce(printf('%.3f', price), '—') as input_price, coalesce(printf('%.3f', outp), '—') as output_price, note, cast(row_number() over (order by price nulls last, name) as integer) as place from p"""


_STATS = f"count(*) as total, count_if(coalesce(\"Verifier\", '') <> '') as filled"
ORACLES = {
    "email_clean": f"select id, {S.clean_email('email')} as cleaned from {_E}",
    "email_candidates": f"select doc_id, array_to_string({_candidates('t')}, ',') as emails from (select doc_id, coalesce(text, '') as t from (select doc_id, text from documents union all select * from {X.TEXTS.sql} union all select id, text from {_E}))",
    "email_domains": f"select id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)email at{S.WS}+([A-Za-z0-9.-]+\\.[A-Za-z]{{2,}})', 1), lambda x: lower(x)))), ',') as domains from {_E}",
    "email_generic": f"select id, {_generic('email', 'name')} as generic from {_with_tokens(_E, 'email', 'name')}",
    "verify_decision": _decision(),
    "name_clean": f"select id, {S.clean_name('name')} as cleaned from {_N}",
    "name_format": _formatted(),
    "name_relevant": f"select id, {_relevant('tx')} as relevant from (select id, n, nm, tx, {_TOKENS.format(2)} as tk from (select id, coalesce(text, '') as tx, coalesce(name, '') as nm, {S.clean_name('name')} as n from {_N}))",
    "profile_results": f"select query_id, ord, {_relevant('b')} and ({S.any_of('b', L.PROFILE_WORDS)} or {S.any_of('lower(url)', L.PROFILE_WORDS)}) as promising from (select query_id, ord, coalesce(url, '') as url, lower(coalesce(title, '') || ' ' || coalesce(snippet, '')) as b, 'Jo Lee' as n, 'Dr. Jo Lee' as nm, ['jo', 'lee'] as tk from {X.RESULTS.sql})",
    "result_dedup": f"select query_id, ord, url from {_DISTINCT}",
    "result_topk": f"select query_id, cast(rank as integer) as rank, url, cast(score as integer) as score from (select query_id, url, score, row_number() over (partition by query_id order by score desc, ord) as rank from (select *, {_score()} as score from (select query_id, ord, url, lower(url) as u, lower(coalesce(title, '')) as t, lower(coalesce(snippet, '')) as s from {_DISTINCT}))) where rank <= 10",
    "contact_vote": f"""
with a as (select *, coalesce(email_address, '') <> '' and not ({_generic('email_address', 'contact_name')}) as fits from {_with_tokens(X.ANALYSES.sql, 'email_address', 'contact_name')}),
g as (select contact_id, gender from a where coalesce(gender, '') not in ('', 'unknown') group by contact_id, gender qualify row_number() over (partition by contact_id order by count(*) desc, min(ord)) = 1),
p as (select contact_id, count_if(coalesce(has_doctorate, false)) as doctors, count(*) as pages, arg_min(case when fits then {S.clean_email('email_address')} end, case when fits then ord end) as email from a group by contact_id)
select p.contact_id, case when doctors * 2 > pages then 'Dr.' when gender = 'male' then 'Mr.' when gender = 'female' then 'Ms.' else 'Mr./Ms.' end as title, coalesce(email, '') as email, cast(doctors as bigint) as doctors, pages from p left join g using (contact_id)""",
    "label_vote": "select source, cast(count_if(quality = 1) as bigint) as good, count(*) as n, count_if(quality = 1) * 2 > count(*) as accepted from labels join documents using (doc_id) group by source",
    "contact_delta": f"select id, concat_ws('; ', case when new_name is distinct from name then 'Contact_Name=' || coalesce(new_name, '') end, case when new_email is distinct from email then 'Contact_Email=' || coalesce(new_email, '') end) as changes from {X.DELTAS.sql}",
    # What the six methods give for each response, worked out by hand.
    "json_object": """select * from (values (cast(1 as bigint), '{"a":"1"}'), (2, '{"a":1}'), (3, '{"a":1}'), (4, '[1,2]'), (5, '{"a":2}'), (6, null), (7, '[1,2]'), (8, '{"a":1}'), (9, '{"k":"v"}'), (10, null), (11, null), (12, null), (13, '{"ok":true}')) as v(id, found) union all
select 1000000 + conv_id * 1000 + turn, case when turn % 4 <> 2 then '{"role":"' || role || '"}' end from conversations""",
    "json_array": """select * from (values (cast(1 as bigint), '[]'), (2, '[]'), (3, '[]'), (4, '[1,2]'), (5, '[]'), (6, '[]'), (7, '[1,2]'), (8, '[{"a":1}]'), (9, '[]'), (10, '[]'), (11, '[]'), (12, '[]'), (13, '[]')) as v(id, found) union all
select 1000000 + conv_id * 1000 + turn, case when turn % 4 = 3 then '[{"role":"' || role || '"}]' else '[]' end from conversations""",
    "chat_text": f"""select id, case json_type(payload, '$.choices[0].message.content') when 'ARRAY' then array_to_string(list_transform(json_extract(payload, '$.choices[0].message.content[*]'), lambda x: coalesce(x->>'$.text', '')), '') else coalesce(payload->>'$.choices[0].message.content', '') end as chat,
{S.strip("array_to_string(payload->>'$.output[*].content[*].text', chr(10))")} as response, {S.strip("array_to_string(payload->>'$.candidates[*].content.parts[*].text', chr(10))")} as candidates from {X.PAYLOADS.sql}""",
    "data_urls": f"select doc_id, 'data:text/plain;base64,' || e as data_url, 'text/plain' as media_type, e as encoded from (select doc_id, base64(encode(text)) as e from (select doc_id, text from documents union all select * from {X.TEXTS.sql}) where text is not null)",
    "stage_validate": f"""select id, case when {_EMPTY} then 'empty' when {_lacks(L.STAGE1_FIELDS)} then 'missing fields' else 'ok' end as facts, case when {_EMPTY} then 'empty' when not ({_ONES}) then 'not one' when {_GEO_N} = 0 then 'no direction' when {_GEO_N} > 3 then 'too many directions' else 'ok' end as flags,
coalesce(len(list_filter({_keys()}, lambda k: not list_contains({X.literal(L.STAGE2_FIELDS)}, k))) = 0 and {_ONES} and {_GEO_N} between 1 and 3, false) as flags_strict,
case when {_EMPTY} then 'empty' when {_lacks(L.STAGE3_FIELDS)} then 'missing fields' when {S.strip(f"coalesce({_field('WX_Label1')}, '')")} = '' then 'no label' else 'ok' end as labels from {_R}""",
    "places_digits": f"select id, regexp_extract(coalesce({_field('Number_Places')}, ''), '[0-9]+') as places from {_R}",
    "flag_prune": _pruned(),
    "business_rules": _ruled(),
    "stage_merge": _merged(),
    "directions": _directions(),
    "unfilled": f"select row_index from {_H} where coalesce(\"Verifier\", '') = '' and coalesce(\"Error\", '') = ''",
    "row_lookup": f"select row_index, coalesce(\"Notes\", '') as \"Notes\", coalesce(\"Source\", '') as \"Source\", coalesce(\"Verifier\", '') as \"Verifier\", coalesce(\"Error\", '') as \"Error\" from {_H} where row_index = 4",
    "link_resolve": f"select row_index, coalesce(s, n) as link, s is null and n is not null as used_notes from (select row_index, {S.first_url('\"Source\"')} as s, {S.first_url('\"Notes\"')} as n from {_H})",
    "ragged_rows": f"select row_index, coalesce(keys[1], '-') || ',' || coalesce(keys[2], '-') || ',' || coalesce(keys[3], '-') as cells from {X.UPDATES.sql}",
    "sheet_update": _updated(),
    "delete_rows": f"select * from {_H} where row_index not in (select row_index from {X.UPDATES.sql})",
    "append_rows": f"select * from {_H} union all select row_index, vals[1], null, null, error from {X.UPDATES.sql}",
    "sheet_stats": f"select cast(total as bigint) as total, cast(filled as bigint) as filled, cast(error as bigint) as error, cast(total - filled - error as bigint) as pending, round(100.0 * filled / total, 4)::double as rate from (select {_STATS}, count_if(coalesce(\"Error\", '') <> '') as error from {_H})",
    "sheet_stats_reviewed": f"select cast(total as bigint) as total, cast(filled as bigint) as filled, cast(reviewed as bigint) as reviewed, cast(error as bigint) as error, cast(pending as bigint) as pending, round(100.0 * filled / total, 4)::double as rate from (select {_STATS}, count_if(\"Error\" = 'N') as reviewed, count_if(coalesce(\"Error\", '') not in ('', 'N')) as error, count_if(coalesce(\"Verifier\", '') = '' and coalesce(\"Error\", '') = '') as pending from {_H})",
    "row_outcome": _outcome(),
    "conversation_log": "select conv_id, printf('row_%04d.txt', conv_id) as name, string_agg('[' || role || '] ' || coalesce(text, ''), chr(10) order by turn) as log from conversations group by conv_id",
    "flush_once": "select conv_id, printf('row_%04d.txt', conv_id) as name, count(*) as turns, string_agg('[' || role || '] ' || coalesce(text, ''), chr(10) order by turn) as log from conversations group by conv_id",
    "incremental_update": """with late as (select sale_id, arrived_at, 'late ' || coalesce(status, '-') as s, cast(priority + 1 as varchar) as p, case when priority > 3 then 'LLM' end as v, case when total < 50 then 'low' end as e
from sales where arrived_at - sold_at > interval 1 day and sale_id >= 0),
-- the last value of each cell, the last verifier and error given; nulls among the cells' values count
folded as (select sale_id, (max(struct_pack(a := arrived_at, s := s))).s as s, count(*) as updates, (array_agg(p order by arrived_at desc, p desc nulls last))[1] as p, (max(struct_pack(a := arrived_at, v := v)) filter (where v is not null)).v as v, (max(struct_pack(a := arrived_at, e := e)) filter (where e is not null)).e as e from late group by sale_id)
select sales.sale_id as row_index, client_id, case when f.sale_id is null then status else f.s end as status, case when f.sale_id is null then cast(priority as varchar) else f.p end as priority, f.v as "Verifier", coalesce(f.e, '') as "Error", f.updates
from sales left join folded f on f.sale_id = sales.sale_id""",
    "breaker_timeline": _breaker(),
    # The chains' folds, worked out by hand.
    "chain_pick": _chains(),
    "model_prices": _prices(),
    "model_counts": f"select vision, count(*) as models from ({_prices()}) group by vision",
}
