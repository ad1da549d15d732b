"""What the model is asked at each stage: the task, its fields with their rules, and the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import text_of

ONLY = "Use only what the text states. Answer with one JSON object and nothing else."

BASICS = {
    "Deadline": 'the last day to apply as YYYY-MM-DD; "Soon" if none is given',
    "Number_Places": 'how many places there are, summed over the positions; "1" for a position without a number, "" for an event',
    "Direction": "the topic of the work, or a short summary of it; a capital only for the first word and for names",
    "University_EN": "the whole official English name of the parent institution, not of its department, without abbreviations; \"\" if only an abbreviation is given",
    "Contact_Name": 'the first contact, with "Dr. " before professors and doctors, else "Mr. ", "Ms. " or nothing; no other title, degree or nickname; "-" if there is none',
    "Contact_Email": 'the address that is printed, with [at] and [dot] in any spelling written as @ and .; never a guess; "-" if there is none',
}
CHINESE = {
    "University_CN": "the institution's whole Chinese name, of the main one if there are several",
    "Country_CN": "the Chinese name of its country",
    "WX_Label1": "the discipline that fits best; must be given",
    "WX_Label2": "a further discipline or line of research",
    "WX_Label3": "another line of research, if there is one",
    "WX_Label4": "empty",
    "WX_Label5": "empty",
}
PERSON = {
    "is_target_person": "true if the page is about the person asked for",
    "has_doctorate": "true if it shows a doctorate or a professorship",
    "gender": '"male", "female" or "unknown", as the page\'s words show',
    "email": 'the person\'s own address as printed; "" if there is none',
}


def rules(fields: dict[str, str]) -> str:
    return "\n".join(f'- "{name}": {rule}' for name, rule in fields.items())


def task(stage: int) -> str:
    """The task of stage 1 (basics), 2 (kind and field) or 3 (Chinese labels)."""
    if stage == 1:
        return f"Extract from a posting for researchers:\n{rules(BASICS)}\n{ONLY} Give every field."
    if stage == 2:
        kinds, fields = (", ".join(f'"{x}"' for x in names) for names in (L.POSITION_TYPES, L.GEO_FIELDS))
        return f'Mark what a posting for researchers offers.\n- Kinds, all that are named: {kinds}. An assistant who needs a doctorate is a "PostDoc".\n- Fields, one at least and three at most, the closest: {fields}.\n{ONLY} Give marked names only, each with the value "1".'
    if stage == 3:
        return f"Extract from a posting for researchers, in simplified Chinese characters alone:\n{rules(CHINESE)}\nLabels are narrower than the fields that the posting is filed under, and six characters long at most.\n{ONLY} Give every field; leave unknown ones empty."
    raise ValueError(f"no stage {stage}")


def person_task(name: Column) -> Column:
    """The task for a page that may be about a person."""
    return F.concat(F.lit("Say what a page tells about "), text_of(name), F.lit(f":\n{rules(PERSON)}\n{ONLY} Give every field."))


def years(today: Column) -> Column:
    """How a day without a year is read."""
    day, year = F.date_format(today, "yyyy-MM-dd"), F.year(today)
    return F.concat(F.lit("Today is "), day, F.lit(". A day without a year lies in "), year.cast("string"), F.lit(", or in "), (year + 1).cast("string"), F.lit(" if it has passed."))


def prompt(what: Column, text: Column, today: Column | None = None) -> Column:
    """A task, the rule on years where a day is given, and the whole text between marks; a null text is empty."""
    head = what if today is None else F.concat(what, F.lit("\n"), years(today))
    return F.concat(head, F.lit("\n<text>\n"), text_of(text), F.lit("\n</text>"))


def stage_prompts(text: Column, today: Column) -> Column:
    """The prompts of stages 1 to 3; only stage 1 reads days."""
    return F.array(*[prompt(F.lit(task(stage)), text, today if stage == 1 else None) for stage in (1, 2, 3)])
