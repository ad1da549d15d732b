"""URL predicates and rewrites as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import bound, has_any, strip, text_of

_PARTS = r"(?s)^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def authority(url: Column) -> Column:
    return F.regexp_extract(text_of(url), _PARTS, 1)


def host(url: Column) -> Column:
    return F.lower(authority(url))


def path(url: Column) -> Column:
    return F.regexp_extract(text_of(url), _PARTS, 2)


def query(url: Column) -> Column:
    return F.regexp_extract(text_of(url), _PARTS, 3)


def parameter(url: Column, name: str) -> Column:
    """The first non-blank value of a query parameter, decoded; null if there is none."""
    return F.try_url_decode(F.nullif(F.regexp_extract(F.concat(F.lit("&"), query(url)), f"&{name}=([^&]+)", 1), F.lit("")))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def after_segment(url: Column, name: str) -> Column:
    """The path segment after the first one of this name; null if there is none."""
    at = F.array_position(segments(url), name).cast("int")
    return F.when(at > 0, F.get(segments(url), at))


def is_third_party(url: Column) -> Column:
    return has_any(host(url), L.THIRD_PARTY)


def is_valid(text: Column) -> Column:
    return F.rlike(strip(text_of(text)), F.lit("^https?://[^/?#]+"))


def first_url(text: Column) -> Column:
    """The whole text if it is a URL, else the first URL in it; null if none."""
    return F.when(is_valid(text), strip(text)).otherwise(F.nullif(F.regexp_extract(text_of(text), L.URL_IN_TEXT, 0), F.lit("")))


def is_pdf(url: Column) -> Column:
    return F.lower(text_of(url)).endswith(".pdf") | F.contains(F.lower(path(url)), F.lit(".pdf"))


def is_drive(url: Column) -> Column:
    return F.contains(host(url), F.lit("drive.google.com")) & (F.contains(path(url), F.lit("/file/d/")) | F.contains(path(url), F.lit("/uc?")))


def drive_id(url: Column) -> Column:
    got = [F.nullif(F.regexp_extract(text_of(url), p, 1), F.lit("")) for p in (r"/file/d/([a-zA-Z0-9_-]+)", r"[?&]id=([a-zA-Z0-9_-]+)", r"/uc[?&]id=([a-zA-Z0-9_-]+)")]
    return F.coalesce(*got)


def drive_download(url: Column) -> Column:
    return F.concat(F.lit("https://drive.google.com/uc?export=download&id="), drive_id(url))


def is_docs(url: Column) -> Column:
    return F.contains(host(url), F.lit("docs.google.com")) & F.contains(path(url), F.lit("/document/d/"))


def docs_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(text_of(url), r"/document/d/([a-zA-Z0-9_-]+)", 1), F.lit(""))


def docs_export(url: Column, kind: Column) -> Column:
    kind = F.when(kind.isin(L.EXPORT_FORMATS), kind).otherwise("txt")
    return F.concat(F.lit("https://docs.google.com/document/d/"), docs_id(url), F.lit("/export?format="), kind)


def safe_filename(name: Column) -> Column:
    """Unsafe characters as _; over 100 characters, 95 of the stem and the extension."""
    name = F.regexp_replace(name, r'[<>:"/\\|?*]', "_")
    ext = F.substring_index(name, ".", -1)
    stem = F.left(name, F.length(name) - F.length(ext) - 1)
    short = F.when(F.contains(name, F.lit(".")), F.concat(F.left(stem, F.lit(95)), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))).otherwise(F.left(name, F.lit(95)))
    return F.when(F.length(name) > 100, short).otherwise(name)


def unwrap_redirect(raw: Column, base: Column) -> Column:
    """A search result's target: relative links against the base, then the first redirect parameter, decoded twice."""
    raw = strip(text_of(raw))
    origin = F.regexp_extract(text_of(base), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(text_of(base), r"^([a-zA-Z][a-zA-Z0-9+.-]*:)//", 1)
    full = F.when((origin != "") & raw.startswith("//"), F.concat(scheme, raw)).when((origin != "") & raw.startswith("/"), F.concat(origin, raw)).otherwise(raw)
    # The parameter is decoded once as a form value and once as text, where + stays.
    again = [F.try_url_decode(F.replace(parameter(full, k), F.lit("+"), F.lit("%2B"))) for k in L.REDIRECT_KEYS]
    return F.coalesce(*again, full)


def is_useful(url: Column) -> Column:
    low = F.lower(text_of(url))
    return ~has_any(low, L.BLOCKED_URLS) & has_any(low, L.ALLOWED_URLS)


def ats_kind(url: Column) -> Column:
    """The recruiting system whose public interface serves this URL; the first that fits, else null."""
    kind = F.lit(None).cast("string")
    for part, name in reversed(L.ATS_HOSTS):
        fits = F.contains(host(url), F.lit(part))
        if name == "oracle_hcm":
            fits = fits | F.contains(text_of(url), F.lit("CandidateExperience")) | F.contains(text_of(url), F.lit("hcmUI"))
        kind = F.when(fits, name).otherwise(kind)
    return kind


def ats_signature(url: Column, html: Column) -> Column:
    """The recruiting system that URL and page bear the signature of; the first that fits, else null. The page is lower-cased once for all signs."""

    def first_of(seen: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name, signs in reversed(L.ATS_SIGNATURES):
            kind = F.when(has_any(seen, signs), name).otherwise(kind)
        return kind

    return bound(F.lower(F.concat(text_of(url), F.lit(" "), text_of(html))), first_of)


def search_url(words: Column, engine: str = "https://duckduckgo.com/?q=") -> Column:
    return F.concat(F.lit(engine), F.replace(words, F.lit(" "), F.lit("+")))


def cache_key(url: Column) -> Column:
    """The file name that a downloaded document is kept under: its digest, and its own name if that is a PDF's."""
    name = F.substring_index(path(url), "/", -1)
    return F.concat(F.md5(url), F.when(name.endswith(".pdf"), F.concat(F.lit("_"), safe_filename(name))).otherwise(".pdf"))
