"""Recorded answers of hosted recruiting systems: which posting a URL means, and the posting as labelled lines of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import fragment_text, joined, labelled, strip, text_of

LEAST_TEXT = 200


def _first(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def _digits(c: Column) -> Column:
    return F.nullif(F.regexp_extract(text_of(c), r"^(\p{Nd}+)", 1), F.lit(""))


def _segment(url: Column, i: int) -> Column:
    return F.get(urls.segments(url), F.lit(i))


def _last(url: Column) -> Column:
    return F.element_at(F.concat(F.array(F.lit("")), urls.segments(url)), -1)


def _sub(url: Column) -> Column:
    return F.substring_index(urls.host(url), ".", 1)


def posting_ids(kind: Column, url: Column) -> tuple[Column, Column]:
    """Account and posting id of a URL; null where the URL names none. A chain of cases, one per kind."""
    path, host, seg = urls.path(url), urls.host(url), urls.segments(url)
    got = lambda pattern, c, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    board = F.contains(path, F.lit("embed")) & urls.parameter(url, "for").isNotNull()
    job = got(r"/([^/]+)/jobs/(\p{Nd}+)", path, 2)
    direct = job.isNotNull() & F.contains(host, F.lit("greenhouse"))
    at = F.array_position(seg, "job").cast("int")
    code = F.coalesce(urls.after_segment(url, "j"), got("^([A-Z0-9]{6,})$", _last(url), 1))
    long_digits = F.filter(F.reverse(seg), lambda s: F.rlike(s, F.lit(r"^\p{Nd}{6,}$")))
    ids = {
        "greenhouse": (
            F.when(board, urls.parameter(url, "for")).when(direct, got(r"/([^/]+)/jobs/(\p{Nd}+)", path, 1)).otherwise(got(r"^([^.]+)\.greenhouse\.io", host, 1)),
            F.when(board, F.coalesce(urls.parameter(url, "token"), urls.parameter(url, "gh_jid"))).when(direct, job).otherwise(urls.parameter(url, "gh_jid")),
        ),
        "lever": (got("^/([^/]+)/([0-9a-f-]{16,})", path, 1), got("^/([^/]+)/([0-9a-f-]{16,})", path, 2)),
        "workday": (F.when(at > 1, F.get(seg, at - 2)), F.when(at > 1, F.concat(F.lit("/"), F.array_join(F.slice(seg, at, F.size(seg) - at + 1), "/")))),
        "ashby": (_segment(url, 0), _segment(url, 1)),
        "smartrecruiters": (_segment(url, 0), _digits(_segment(url, 1))),
        "recruitee": (_sub(url), F.nullif(_last(url), F.lit(""))),
        "workable": (F.when(host.startswith("apply.") & (F.size(seg) > 0), _segment(url, 0)).otherwise(_sub(url)), code),
        "personio": (host, F.coalesce(_digits(urls.after_segment(url, "job")), urls.parameter(url, "id"), urls.parameter(url, "jobId"), urls.parameter(url, "job_id"))),
        "bamboohr": (_sub(url), _digits(urls.after_segment(url, "careers"))),
        "teamtailor": (host, _digits(urls.after_segment(url, "jobs"))),
        "eightfold": (_sub(url), F.coalesce(urls.parameter(url, "pid"), urls.parameter(url, "jobid"), urls.parameter(url, "job_id"), F.get(long_digits, F.lit(0)))),
        "oracle_hcm": (urls.after_segment(url, "sites"), urls.after_segment(url, "job")),
    }
    choose = lambda i: reduce(lambda rest, k: F.when(kind == k, ids[k][i]).otherwise(rest), ids, F.lit(None).cast("string"))
    return choose(0), choose(1)


def _field(payload: Column, path: str) -> Column:
    """A scalar field as text; null for null. Polymorphic fields come as the JSON they are."""
    return F.get_json_object(payload, path)


def _place(payload: Column, path: str, parts: tuple[str, ...]) -> Column:
    """A location that is a text, or an object of which the named parts are joined."""
    whole = _field(payload, path)
    return F.when(whole.startswith("{"), F.nullif(F.concat_ws(", ", *[F.nullif(_field(payload, f"{path}.{p}"), F.lit("")) for p in parts]), F.lit(""))).otherwise(whole)


def _objects(payload: Column, path: str) -> Column:
    """An array's elements, each as JSON text."""
    return F.coalesce(F.transform(F.try_variant_get(F.try_parse_json(F.get_json_object(payload, path)), "$", "array<variant>"), lambda v: F.to_json(v)), F.array().cast("array<string>"))


def _lines(items: Column, f) -> Column:
    return F.array_join(F.filter(F.transform(items, f), lambda x: x.isNotNull()), "\n")


def posting_text(kind: Column, id_: Column, payload: Column) -> Column:
    """The posting `id_` in a recorded payload, as text; null if the payload lacks it."""
    f = lambda p: _field(payload, p)
    html = lambda c: F.nullif(fragment_text(c), F.lit(""))
    first = lambda items, test: F.get(F.filter(items, test), F.lit(0))

    greenhouse = joined(f("$.title"), labelled("Company: ", f("$.company_name")), labelled("Location: ", f("$.location.name")), labelled("Application deadline: ", f("$.application_deadline")), html(f("$.content")))

    one = F.when(payload.startswith("["), F.get_json_object(payload, "$[0]")).otherwise(payload)
    g = lambda p: _field(one, p)
    parts = _lines(_objects(one, "$.lists"), lambda x: joined(_field(x, "$.text"), html(_field(x, "$.content"))))
    lever = joined(g("$.text"), labelled("Location: ", g("$.categories.location")), labelled("Commitment: ", g("$.categories.commitment")), labelled("Team: ", g("$.categories.team")), _first(g("$.descriptionPlain"), html(g("$.description"))), parts, _first(g("$.additionalPlain"), html(g("$.additional"))))

    w = "$.jobPostingInfo."
    workday = joined(f(w + "title"), labelled("Location: ", f(w + "location")), labelled("Posted: ", f(w + "postedOn")), labelled("Start date: ", f(w + "startDate")), html(f(w + "jobDescription")))

    job = first(_objects(payload, "$.jobs"), lambda x: _field(x, "$.id") == id_)
    j = lambda p: _field(job, p)
    ashby = joined(j("$.title"), labelled("Location: ", j("$.location")), labelled("Type: ", j("$.employmentType")), labelled("Department: ", j("$.department")), _first(j("$.descriptionPlain"), html(j("$.descriptionHtml"))))

    # A map's values come in the order of the text; from_json keeps that order.
    sections = F.map_values(F.from_json(f("$.jobAd.sections"), "map<string,struct<title:string,text:string>>"))
    smart_place = F.nullif(F.concat_ws(", ", F.nullif(f("$.location.city"), F.lit("")), F.nullif(f("$.location.country"), F.lit(""))), F.lit(""))
    smart = joined(f("$.name"), labelled("Location: ", smart_place), _lines(F.coalesce(sections, F.array().cast("array<struct<title:string,text:string>>")), lambda s: joined(s["title"], html(s["text"]))))

    offers = _objects(payload, "$.offers")
    tail = F.nullif(F.regexp_extract(text_of(id_), r"(\p{Nd}+)$", 1), F.lit(""))
    offer = F.coalesce(first(offers, lambda x: _field(x, "$.slug") == id_), first(offers, lambda x: _field(x, "$.id") == tail))
    o = lambda p: _field(offer, p)
    recruitee = joined(o("$.title"), labelled("Location: ", _first(o("$.location"), o("$.city"))), labelled("Department: ", o("$.department")), labelled("Employment type: ", _first(o("$.employment_type_code"), o("$.employment_type"))), html(o("$.description")), html(o("$.requirements")))

    short = first(_objects(payload, "$.jobs"), lambda x: _field(x, "$.shortcode") == id_)
    s = lambda p: _field(short, p)
    workable = joined(s("$.title"), labelled("Location: ", _place(short, "$.location", ("city", "country"))), labelled("Employment type: ", s("$.employment_type")), html(s("$.description")), html(s("$.requirements")), html(s("$.benefits")))

    kind_ = "struct<position:array<struct<id:string,name:string,office:string,department:string,employmentType:string,jobDescriptions:struct<jobDescription:array<struct<name:string,value:string>>>>>>"
    positions = F.coalesce(F.from_xml(F.when(kind == "personio", payload), kind_)["position"], F.array().cast("array<struct<id:string,name:string,office:string,department:string,employmentType:string,jobDescriptions:struct<jobDescription:array<struct<name:string,value:string>>>>>"))
    position = F.when(id_.isNotNull(), first(positions, lambda x: strip(text_of(x["id"])) == id_)).when(F.size(positions) == 1, F.get(positions, F.lit(0)))
    descriptions = F.coalesce(position["jobDescriptions"]["jobDescription"], F.array().cast("array<struct<name:string,value:string>>"))
    personio = joined(position["name"], labelled("Location: ", position["office"]), labelled("Department: ", position["department"]), labelled("Employment type: ", position["employmentType"]), _lines(descriptions, lambda d: joined(d["name"], html(d["value"]))))

    bamboo = F.coalesce(f("$.result.jobOpening"), f("$.result"), payload)
    b = lambda p: _field(bamboo, p)
    bamboohr = joined(_first(b("$.jobOpeningName"), b("$.title")), labelled("Location: ", _place(bamboo, "$.location", ("city", "state", "country"))), labelled("Department: ", _first(b("$.departmentLabel"), b("$.department"))), labelled("Employment type: ", b("$.employmentStatusLabel")), html(b("$.description")))

    item = F.get(_objects(payload, "$.items"), F.lit(0))
    i = lambda p: _field(item, p)
    oracle = joined(i("$.Title"), labelled("Location: ", i("$.PrimaryLocation")), html(i("$.ExternalDescriptionStr")), html(i("$.ExternalResponsibilitiesStr")), html(i("$.ExternalQualificationsStr")))

    post = first(_objects(payload, "$.items"), lambda x: F.regexp_extract(text_of(_field(x, "$.url")), r"/jobs/(\p{Nd}+)", 1) == id_)
    t = lambda p: _field(post, p)
    teamtailor = joined(t("$.title"), labelled("Location: ", t("$._jobposting.jobLocation.address.addressLocality")), labelled("Employment type: ", t("$._jobposting.employmentType")), html(t("$.content_html")))

    open_ = F.concat(_objects(payload, "$.positions"), _objects(payload, "$.jobs"))
    eight = F.coalesce(first(open_, lambda x: _first(_field(x, "$.id"), _field(x, "$.pid")) == id_), F.get(open_, F.lit(0)))
    e = lambda p: _field(eight, p)
    places = F.from_json(e("$.locations"), "array<string>")
    place = F.coalesce(F.nullif(F.array_join(F.filter(places, lambda x: text_of(x) != ""), ", "), F.lit("")), e("$.location"))
    eightfold = joined(_first(e("$.name"), e("$.title")), labelled("Location: ", place), labelled("Department: ", e("$.department")), html(_first(e("$.job_description"), e("$.description"))))

    texts = {"greenhouse": greenhouse, "lever": lever, "workday": workday, "ashby": ashby, "smartrecruiters": smart, "recruitee": recruitee, "workable": workable, "personio": personio, "bamboohr": bamboohr, "oracle_hcm": oracle, "teamtailor": teamtailor, "eightfold": eightfold}
    return reduce(lambda rest, k: F.when(kind == k, texts[k]).otherwise(rest), texts, F.lit(None).cast("string"))


def decoded(payloads: DataFrame, least: int = LEAST_TEXT) -> DataFrame:
    """url, kind, account, posting, text of recorded payloads (url, payload); a text shorter than `least` counts as none."""
    known = payloads.withColumn("kind", urls.ats_kind(F.col("url")))
    account, posting = posting_ids(F.col("kind"), F.col("url"))
    named = known.withColumns({"account": account, "posting": posting})
    needs_id = ~(F.col("kind") == "personio")
    text = F.when(F.col("posting").isNotNull() | ~needs_id, strip(posting_text(F.col("kind"), F.col("posting"), F.col("payload"))))
    return named.withColumn("text", text).select("url", "kind", "account", "posting", F.when(F.length("text") >= least, F.col("text")).alias("text"))
