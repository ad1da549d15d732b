"""Checks and business rules on extracted records, which are maps from field to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import bound, clean_email, strip, text_of

_TEXTS = "map<string,string>"


def record_of(json: Column) -> Column:
    return F.from_json(json, _TEXTS)


def value(record: Column, field: str) -> Column:
    return F.try_element_at(record, F.lit(field))


def missing_fields(record: Column, fields: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(f) for f in fields]), F.map_keys(record))


def has_fields(record: Column, fields: list[str]) -> Column:
    return F.coalesce(F.size(missing_fields(record, fields)) == 0, F.lit(False))


def geo_count(record: Column) -> Column:
    return F.size(F.array_intersect(F.map_keys(record), F.array(*[F.lit(f) for f in L.GEO_FIELDS])))


def flags_strict(record: Column) -> Column:
    """Only known fields, all "1", one to three directions."""
    known = F.size(F.array_except(F.map_keys(record), F.array(*[F.lit(f) for f in L.STAGE2_FIELDS]))) == 0
    return F.coalesce(known & F.forall(F.map_values(record), lambda v: v.eqNullSafe(F.lit("1"))) & geo_count(record).between(1, 3), F.lit(False))


def flags_verdict(record: Column) -> Column:
    """What stage 2 makes of its answer: ok, or why not. Unknown fields pass."""
    n = geo_count(record)
    return F.when(record.isNull() | (F.size(record) == 0), "empty").when(F.exists(F.map_values(record), lambda v: ~v.eqNullSafe(F.lit("1"))), "not one").when(n == 0, "no direction").when(n > 3, "too many directions").otherwise("ok")


def labels_verdict(record: Column) -> Column:
    """What stage 3 makes of its answer."""
    return F.when(record.isNull() | (F.size(record) == 0), "empty").when(~has_fields(record, L.STAGE3_FIELDS), "missing fields").when(strip(text_of(value(record, "WX_Label1"))) == "", "no label").otherwise("ok")


def facts_verdict(record: Column) -> Column:
    """What stage 1 makes of its answer."""
    return F.when(record.isNull() | (F.size(record) == 0), "empty").when(~has_fields(record, L.STAGE1_FIELDS), "missing fields").otherwise("ok")


def with_defaults(record: Column) -> Column:
    """Absent fields of stages 1 and 3 as empty texts; stage 2 stays sparse."""
    fields = F.array(*[F.lit(f) for f in L.STAGE1_FIELDS + L.STAGE3_FIELDS])

    def filled(r: Column) -> Column:
        return bound(F.array_except(fields, F.map_keys(r)), lambda gaps: F.map_concat(r, F.map_from_arrays(gaps, F.array_repeat(F.lit(""), F.size(gaps)))))

    return bound(record, filled)


def places(c: Column) -> Column:
    """The first run of digits, else empty."""
    return F.regexp_extract(text_of(c), r"(\p{Nd}+)", 1)


def pruned_flags(record: Column) -> Column:
    """Without stage-2 fields other than "1"; a "1" between spaces becomes one."""
    stage2 = lambda k: k.isin(L.STAGE2_FIELDS)
    kept = F.map_filter(record, lambda k, v: ~stage2(k) | (strip(text_of(v)) == "1"))
    return F.transform_values(kept, lambda k, v: F.when(stage2(k), "1").otherwise(v))


def cleaned(record: Column) -> Column:
    """Trimmed fields, a clean address, the places' number, pruned flags."""
    record = F.transform_values(record, lambda k, v: F.when(k.isin(L.TRIMMED_FIELDS), strip(text_of(v))).when(k == "Number_Places", places(v)).otherwise(v))
    record = F.transform_values(record, lambda k, v: F.when(k == "Contact_Email", clean_email(v)).otherwise(v))
    return pruned_flags(record)


def deadline_fits(record: Column) -> Column:
    """Empty, `Soon`, or something that begins like a date (no calendar check)."""
    d = text_of(value(record, "Deadline"))
    return (d == "") | (d == "Soon") | F.rlike(d, F.lit(r"^\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}"))


def ruled(record: Column) -> Column:
    """Events have no places; a contact without a name has no address, but only where the deadline fits."""

    def verdicts(r: Column) -> Column:
        event = F.exists(F.array(*[value(r, f) for f in L.EVENT_TYPES]), lambda v: v == "1")
        unnamed = deadline_fits(r) & text_of(value(r, "Contact_Name")).eqNullSafe(F.lit("-"))
        return F.struct(F.coalesce(event, F.lit(False)).alias("event"), unnamed.alias("unnamed"))

    def applied(r: Column, s: Column) -> Column:
        return F.transform_values(r, lambda k, v: F.when(s["event"] & (k == "Number_Places"), "").when(s["unnamed"] & (k == "Contact_Email"), "-").otherwise(v))

    return bound(record, lambda r: bound(verdicts(r), lambda s: applied(r, s)))


def post_processed(record: Column) -> Column:
    return ruled(cleaned(with_defaults(record)))


def rendered(record: Column) -> Column:
    """field=value, sorted and joined, for comparing records."""
    return F.array_join(F.sort_array(F.transform(F.map_entries(record), lambda e: F.concat(e["key"], F.lit("="), text_of(e["value"])))), "; ")


def _without(record: Column, keys: Column) -> Column:
    return F.map_filter(record, lambda k, v: ~F.array_contains(keys, k))


def merged_stages(stages: list[Column], errors: list[Column]) -> tuple[Column, Column, Column]:
    """The stages' records in one, later ones over earlier ones; full, partial or failed; the errors joined."""
    record = F.from_json(F.lit("{}"), _TEXTS)
    for s in stages:
        s = F.coalesce(s, F.from_json(F.lit("{}"), _TEXTS))
        record = F.map_concat(_without(record, F.map_keys(s)), s)
    failed = F.filter(F.array(*errors), lambda e: text_of(e) != "")
    status = F.when(F.size(failed) == 0, "full").when(F.size(failed) < len(errors), "partial").otherwise("failed")
    return record, status, F.array_join(failed, "; ")


def directions(json: Column) -> Column:
    """Up to three non-empty directions of a model's answer."""
    return F.slice(F.filter(F.coalesce(F.from_json(json, "struct<directions:array<string>>")["directions"], F.array().cast("array<string>")), lambda d: text_of(d) != ""), 1, 3)


def directions_query(found: Column) -> Column:
    return F.concat(F.array_join(F.transform(found, lambda d: F.concat(F.lit('"'), d, F.lit('"'))), " and "), F.lit(" relation to Geography GIS Remote Sensing"))


def mapped_directions(json: Column) -> Column:
    """Known direction fields that an answer sets to 1, as text or number, in their own order."""
    record = record_of(json)
    return F.filter(F.array(*[F.lit(f) for f in L.GEO_FIELDS]), lambda f: F.coalesce(F.try_element_at(record, f) == "1", F.lit(False)))


def direction_flow(found_json: Column, mapped_json: Column) -> Column:
    """The mapped fields, joined; null where no direction was found or none maps."""
    mapped = F.array_join(mapped_directions(mapped_json), ",")
    return F.when(F.size(directions(found_json)) > 0, F.nullif(mapped, F.lit("")))


def contact_delta(name: Column, email: Column, new_name: Column, new_email: Column) -> Column:
    """The contact fields that a check changed."""
    changed = F.array(F.when(~new_name.eqNullSafe(name), F.concat(F.lit("Contact_Name="), text_of(new_name))), F.when(~new_email.eqNullSafe(email), F.concat(F.lit("Contact_Email="), text_of(new_email))))
    return F.array_join(F.array_compact(changed), "; ")
