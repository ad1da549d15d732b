"""Contact names and addresses as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import clean_email, collapse, has_any, hits, strip, text_of


def present(c: Column) -> Column:
    return ~strip(text_of(c)).isin(L.MISSING)


def clean_name(c: Column) -> Column:
    """Without the first title that stands before it, the titles after it, and a quoted nickname."""
    name = strip(F.regexp_replace(strip(text_of(c)), "^(?:" + "|".join(map(re.escape, L.NAME_PREFIXES)) + ") ", ""))
    for suffix in L.NAME_SUFFIXES:
        name = F.regexp_replace(name, f"{L.WS}*{re.escape(suffix)}\\z", "")
    return collapse(F.regexp_replace(name, f'{L.WS}*"[^"]*"{L.WS}*', " "))


def formatted_name(c: Column, title: Column) -> Column:
    """The clean name, in ASCII letters, after Dr., Mr. or Ms. if that is the title."""
    name = clean_name(c)
    for pattern in (r"(?i)\b(Ph\.?D\.?|PhD|Doctor|Professor|Prof\.?)\b", r"\([^)]*\)", r"\[[^\]]*\]", "[,;]", f"[^a-zA-Z{L.WS[1:-1]}.\\-]"):
        name = F.regexp_replace(name, pattern, "")
    name = collapse(name)
    return F.when(name == "", "").when(title.isin("Dr.", "Mr.", "Ms."), F.concat(title, F.lit(" "), name)).otherwise(name)


def name_tokens(c: Column, least: int) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(clean_name(c)), F.lit("[a-z]+"), F.lit(0)), lambda t: F.length(t) >= least)


def name_relevant(text: Column, name: Column) -> Column:
    """The text has the whole name, or the surname with the first name or its initial."""
    low, tokens = F.lower(text_of(text)), name_tokens(name, 2)
    first, last = F.get(tokens, F.lit(0)), F.get(tokens, F.size(tokens) - 1)
    initial = F.left(first, F.lit(1))
    near = F.contains(low, first) | F.contains(low, F.concat(initial, F.lit("."))) | F.contains(low, F.concat(initial, F.lit(" ")))
    whole = F.contains(low, F.lower(clean_name(name)))
    return (text_of(text) != "") & (text_of(name) != "") & (whole | F.coalesce((F.size(tokens) >= 2) & F.contains(low, last) & near, F.lit(False)))


def promising_profile(url: Column, title: Column, snippet: Column, name: Column) -> Column:
    """A result that names the contact and looks like a profile."""
    both = F.lower(F.concat_ws(" ", text_of(title), text_of(snippet)))
    return name_relevant(both, name) & (has_any(both, L.PROFILE_WORDS) | has_any(F.lower(text_of(url)), L.PROFILE_WORDS))


def generic_email(email: Column, name: Column) -> Column:
    """An address of an office, or one that shows nothing of the contact's name."""
    done = F.lower(clean_email(email))
    local, tokens = F.substring_index(done, "@", 1), name_tokens(name, 3)
    surname = F.get(tokens, F.size(tokens) - 1)
    personal = F.exists(tokens, lambda t: F.contains(local, t)) | F.coalesce((F.size(tokens) >= 2) & F.contains(local, F.concat(F.left(F.get(tokens, F.lit(0)), F.lit(1)), surname)), F.lit(False))
    mismatch = (F.size(tokens) > 0) & ~personal
    return F.when(~present(email), False).when(~F.contains(done, F.lit("@")), True).otherwise(local.isin(L.GENERIC_LOCALS) | mismatch)


def email_candidates(text: Column) -> Column:
    """Plain, spaced and spelled-out addresses, cleaned, distinct and sorted, without office prefixes."""
    s, t, none = L.WS, text_of(text), F.array().cast("array<string>")
    # Few texts have an @ or its spelling: the patterns, which go over every word again and again, run on those alone.
    found = lambda test, pattern: F.when(test, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none)
    signed, spelt = F.contains(t, F.lit("@")), F.rlike(t, F.lit(f"(?i)\\[at\\]|\\(at\\)|{s}at{s}"))
    plain = found(signed, L.EMAIL)
    spaced = found(signed, f"[A-Za-z0-9._%+-]+{s}*@{s}*[A-Za-z0-9.-]+(?:{s}*\\.{s}*[A-Za-z0-9.-]+)+")
    spelled = found(spelt, f"(?i)[A-Za-z0-9._%+-]+{s}*(?:\\[at\\]|\\(at\\)|{s}at{s}){s}*[A-Za-z0-9.-]+{s}*(?:\\[dot\\]|\\(dot\\)|{s}dot{s}|\\.){s}*[A-Za-z.]{{2,}}")
    spaced = F.transform(spaced, lambda x: F.regexp_replace(x, f"{s}+", ""))
    done = F.transform(F.concat(plain, spaced, spelled), clean_email)
    office = lambda x: reduce(lambda a, b: a | b, [x.startswith(p) for p in L.BLOCKED_LOCALS])
    return F.array_sort(F.array_distinct(F.filter(done, lambda x: F.contains(x, F.lit("@")) & ~office(x))))


def email_domains(text: Column) -> Column:
    """Domains after `email at`, distinct and sorted."""
    found = F.regexp_extract_all(text_of(text), F.lit(f"(?i)email at{L.WS}+([A-Za-z0-9.-]+\\.[A-Za-z]{{2,}})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(x))))


# Titles before a name (spaces stand for any white space), and after it.
TITLES_BEFORE = [r"Dr\.? ", r"Prof\.? ", "Professor ", "Assistant Professor ", "Associate Professor ", "Doctor "]
TITLES_AFTER = [r"Ph\.?D", "PhD", "Professor"]


def clear_title(text: Column, name: Column) -> Column:
    """The text puts a title beside the clean name, which is quoted so that its signs stand for themselves."""
    quoted = F.concat(F.lit("\\Q"), F.replace(clean_name(name), F.lit("\\E"), F.lit("")), F.lit("\\E"))
    before = F.concat(F.lit("(?i)\\b(?:" + "|".join(t.replace(" ", f"{L.WS}+") for t in TITLES_BEFORE) + ")"), quoted)
    after = F.concat(F.lit("(?i)"), quoted, F.lit(f"{L.WS}*,?{L.WS}*(?:" + "|".join(TITLES_AFTER) + ")"))
    return F.rlike(text_of(text), before) | F.rlike(text_of(text), after)


def verify_decision(name: Column, email: Column, text: Column) -> tuple[Column, Column]:
    """Whether a contact needs a search, and which of eight cases it is."""
    name = strip(text_of(name))
    doctor, has, generic = name.startswith("Dr. "), present(email), present(email) & generic_email(email, name)
    titled = clear_title(text, name)
    case = (
        F.when(~present(name), "no contact")
        .when(doctor & has & ~generic, "doctor with email")
        .when(doctor & generic, "doctor with generic email")
        .when(doctor, "doctor without email")
        .when(titled & has & ~generic, "title and email already present")
        .when(titled & generic, "title with generic email")
        .when(titled, "title without email")
        .otherwise("title unclear")
    )
    return ~case.isin("no contact", "doctor with email", "title and email already present"), case


def priority_score(url: Column, title: Column, snippet: Column) -> Column:
    url, title, snippet = F.lower(text_of(url)), F.lower(text_of(title)), F.lower(text_of(snippet))
    domain = F.lit(0)
    for i, d in reversed(list(enumerate(L.PRIORITY_DOMAINS))):
        domain = F.when(F.contains(url, F.lit(d)), (len(L.PRIORITY_DOMAINS) - i) * 10).otherwise(domain)
    either = lambda words, a, b: reduce(lambda x, y: x + y, [(F.contains(a, F.lit(w)) | F.contains(b, F.lit(w))).cast("int") for w in words])
    return (
        domain
        + hits(url, L.PATH_HINTS) * 18
        + has_any(url, L.HOST_HINTS).cast("int") * 15
        + (F.size(email_candidates(F.concat_ws(" ", title, snippet))) > 0).cast("int") * 100
        - has_any(url, L.SOCIAL_HINTS).cast("int") * 20
        + either(L.TITLE_WORDS, title, snippet) * 5
        + either(L.PAGE_WORDS, url, title) * 3
    )
