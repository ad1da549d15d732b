"""Main-text candidates of our own: maximum-subsequence segmentation of a page's tokens.

A page is a row of tokens: words count 1, tags minus a cost, white space nothing. The main text is the stretch of tokens with the largest
sum (the first of equals, as short as it can be at its front): prose outweighs the few tags inside it, menus and link lists don't. A low cost
favours recall, a high one precision. The sum is one fold over the tokens, so a page costs what its length is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import layout, text_of, unescape

SPACE = r"\x20\x09-\x0D"
#: Elements whose content is no text; one that is never closed goes to the end.
UNREAD = ("script", "style", "noscript", "template", "svg", "title", "textarea", "select")
TOKEN = rf"<[^<>]*>|[^<{SPACE}]+|[{SPACE}]+"
#: Tags that end a line; all others stand inside one.
LINE_TAGS = rf"(?i)^</?(p|div|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|section|article|main|aside|nav|header|footer|form|br|hr|pre|blockquote|figure|figcaption)[{SPACE}/>]"
#: What a tag costs, by method.
COSTS = {"wide_segment": 2, "tight_segment": 6}

_TOKEN, _LINE_TAGS, _SPACES = re.compile(TOKEN), re.compile(LINE_TAGS, re.ASCII), frozenset(" \t\n\x0b\x0c\r")
_UNREAD = [(re.compile(rf"(?is)<{tag}[{SPACE}/>].*", re.ASCII), re.compile(rf"(?i)</{tag}[^<>]*>", re.ASCII)) for tag in UNREAD]


def without_unread(page: str) -> str:
    """Comments and unread elements as one space each. Cut at the closing marks first, so that no opening mark is sought twice."""
    page = " ".join(_cut(part, "<!--") for part in page.split("-->"))
    for start, end in _UNREAD:
        page = " ".join(start.sub(" ", part, count=1) for part in end.split(page))
    return page


def _cut(part: str, mark: str) -> str:
    at = part.find(mark)
    return part if at < 0 else part[:at] + " "


def best_stretch(worth: np.ndarray) -> tuple[int, int]:
    """The stretch with the largest sum, as a slice: the first end of equals, then the last start. Empty where no sum is above 0."""
    sums = np.concatenate([[0], np.cumsum(worth)])
    before = sums[:-1]
    total = sums[1:] - np.minimum.accumulate(before)
    end = int(total.argmax()) if len(total) else 0
    if not len(total) or total[end] <= 0:
        return 0, 0
    return int(np.flatnonzero(before[: end + 1] == before[: end + 1].min())[-1]), end + 1


def _stretches(page: str, costs: list[int]) -> list[str]:
    tokens = _TOKEN.findall(without_unread(page))
    tags, spaces = np.array([t[0] == "<" for t in tokens], bool), np.array([t[0] in _SPACES for t in tokens], bool)
    found = []
    for cost in costs:
        start, end = best_stretch(np.where(tags, -cost, np.where(spaces, 0, 1)))
        found.append("".join(t if t[0] != "<" and t[0] not in _SPACES else " " if t[0] != "<" else "\n" if _LINE_TAGS.match(t) else "" for t in tokens[start:end]))
    return found


def stretches(html: Column, costs: list[int]) -> Column:
    """The text of each cost's best stretch: line tags as line ends, other tags left out, white space as one space."""

    @F.arrow_udf(ArrayType(StringType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([_stretches(p.as_py() or "", costs) for p in pages], pa.list_(pa.string()))

    return run(F.make_valid_utf8(html))


def main_texts(pages: DataFrame, key: str = "page_id", html: str = "html", costs: dict[str, int] | None = None) -> DataFrame:
    """key, ord, method, text: a candidate of each page for every cost."""
    costs = costs or COSTS
    texts = pages.select(key, stretches(text_of(F.col(html)), list(costs.values())).alias("texts")).select(key, F.posexplode("texts").alias("ord", "text"))
    method = F.element_at(F.array(*[F.lit(m) for m in costs]), F.col("ord") + 1)
    return texts.select(key, "ord", method.alias("method"), layout(unescape(F.col("text"))).alias("text"))
