"""JSON out of free-form model output. Spark's parsers take trailing junk and single quotes, so the strict parser is Python's, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon as L

_NESTED = re.compile(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", re.S)
_NOTHING = object()


def _parsed(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return _NOTHING


def _between(text: str, mark: str) -> str | None:
    start = text.find(mark)
    end = text.find("```", start + len(mark)) if start >= 0 else -1
    return text[start + len(mark) : end].strip() if end >= 0 else None


def _outer(text: str) -> str | None:
    start, end = text.find("{"), text.rfind("}")
    return text[start : end + 1] if 0 <= start < end else None


def recovered_object(response: str | None):
    """The first of: a json fence, any fence, first { to last }, a non-empty object nested once, the whole text, what follows an answer marker."""
    if response is None:
        return None
    text = response.strip()
    for piece in (_between(text, "```json"), _between(text, "```"), _outer(text)):
        if piece is not None and (found := _parsed(piece)) is not _NOTHING:
            return found
    for m in _NESTED.finditer(text):
        found = _parsed(m[0])
        if isinstance(found, dict) and found:
            return found
    if (found := _parsed(text)) is not _NOTHING:
        return found
    for marker in L.ANSWER_MARKERS:
        at = text.find(marker)
        piece = _outer(text[at + len(marker) :]) if at >= 0 else None
        if piece is not None and (found := _parsed(piece)) is not _NOTHING:
            return found
    return None


def recovered_array(response: str | None) -> list:
    """The fenced or whole text if it is a list, else its first [ to last ]; else an empty list."""
    text = re.sub(r"\n?```\Z", "", re.sub(r"\A```[a-z]*\n?", "", (response or "").strip())).strip()
    if isinstance(found := _parsed(text), list):
        return found
    m = re.search(r"\[.*\]", text, re.S)
    return found if m and isinstance(found := _parsed(m[0]), list) else []


def _dumped(value) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def json_object(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """What recovered_object() finds, as compact JSON; null if nothing."""
    for s in batches:
        yield pd.Series([_dumped(recovered_object(x)) for x in s], dtype=object)


@F.pandas_udf(StringType())
def json_array(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """What recovered_array() finds, as compact JSON."""
    for s in batches:
        yield pd.Series([_dumped(recovered_array(x)) for x in s], dtype=object)


def chat_text(payload: Column) -> Column:
    """The first choice's content: a text, or the joined texts of its parts."""
    parts = F.from_json(F.get_json_object(payload, "$.choices[0].message.content"), "array<struct<text:string>>")
    content = F.get_json_object(payload, "$.choices[0].message.content")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p.isNotNull()), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return F.coalesce(F.when(content.startswith("["), joined).otherwise(content), F.lit(""))


def response_text(payload: Column) -> Column:
    """Texts of all contents of all outputs, one a line."""
    rows = F.from_json(payload, "struct<output:array<struct<content:array<struct<text:string>>>>>")["output"]
    return _lines(F.flatten(F.transform(rows, lambda o: F.coalesce(o["content"], F.array()))))


def candidates_text(payload: Column) -> Column:
    """Texts of all parts of all candidates, one a line."""
    rows = F.from_json(payload, "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>>")["candidates"]
    return _lines(F.flatten(F.transform(rows, lambda c: F.coalesce(c["content"]["parts"], F.array()))))


def _lines(items: Column) -> Column:
    from .text import strip

    return F.coalesce(strip(F.array_join(F.transform(items, lambda x: x["text"]), "\n")), F.lit(""))


def data_url(media_type: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def split_data_url(url: Column) -> tuple[Column, Column]:
    """Media type and encoded content."""
    head = F.substring_index(url, ",", 1)
    return F.substring_index(F.regexp_replace(head, "^data:", ""), ";", 1), F.substr(url, F.length(head) + 2)
