"""Recorded result pages of search engines: the results on each page, then the gate and the cap, all inside a page's own row."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import contacts, urls
from ..functions.html_text import NO_CONTENT
from ..functions.text import collapse

MOST = 10
# Where a page has its results, as (element, class) steps from the outside in; of several, the first that is there.
PLACES = {
    "duckduckgo": {"base": "https://html.duckduckgo.com", "block": [("", "result")], "title": [[("", "result__title"), ("a", "")], [("a", "result__a")]], "snippet": [[("", "result__snippet")]]},
    "bing": {"base": "https://www.bing.com", "block": [("li", "b_algo")], "title": [[("h2", ""), ("a", "")]], "snippet": [[("", "b_caption"), ("p", "")], [("", "b_snippet")]]},
}
RESULT = ArrayType(StructType([StructField(c, StringType()) for c in ("href", "title", "snippet")]))


class _Results(HTMLParser):
    """blocks: for each result block, the first element of each place: its link and its text nodes."""

    def __init__(self, places: dict):
        super().__init__(convert_charrefs=True)
        self.block = places["block"]
        self.wanted = [(kind, i, steps) for kind in ("title", "snippet") for i, steps in enumerate(places[kind])]
        self.path, self.count, self.blocks, self.around, self.taking = [], Counter(), [], [], []

    def _is_at(self, steps: list) -> bool:
        left = list(steps)
        for at, (tag, classes) in enumerate(reversed(self.path)):
            if left[-1][0] in ("", tag) and left[-1][1] in ("", *classes):
                left.pop()
            if not left or (at == 0 and len(left) == len(steps)):
                break
        return not left

    def handle_starttag(self, tag, attrs):
        if tag in NO_CONTENT:
            return
        named = dict(attrs)
        self.path.append((tag, (named.get("class") or "").split()))
        self.count[tag] += 1
        for kind, i, steps in self.wanted if self.around else ():
            if self._is_at(steps):
                for _, block in self.around:
                    if (kind, i) not in block:
                        block[kind, i] = found = (named.get("href") or "", [])
                        self.taking.append((len(self.path), found[1]))
        if self._is_at(self.block):
            self.blocks.append({})
            self.around.append((len(self.path), self.blocks[-1]))

    def handle_endtag(self, tag):
        if not self.count[tag]:
            return
        last = None
        while last != tag:
            last = self.path.pop()[0]
            self.count[last] -= 1
        self.around = [x for x in self.around if x[0] <= len(self.path)]
        self.taking = [x for x in self.taking if x[0] <= len(self.path)]

    def handle_data(self, data):
        if data.strip():
            for _, nodes in self.taking:
                nodes.append(data.strip())


def results_of(page: str | None, provider: str | None) -> list[tuple[str, str, str]]:
    """href, title and snippet of each block with a title link; none for an engine that PLACES doesn't have."""
    places = PLACES.get(provider)
    if places is None:
        return []
    parser = _Results(places)
    parser.feed(page or "")
    parser.close()
    first = lambda block, kind: next((block[kind, i] for i in range(len(places[kind])) if (kind, i) in block), None)
    return [(title[0], " ".join(title[1]), " ".join((first(b, "snippet") or ("", []))[1])) for b in parser.blocks if (title := first(b, "title"))]


@F.pandas_udf(RESULT)
def _found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, providers in batches:
        yield pd.Series([[dict(zip(("href", "title", "snippet"), r)) for r in results_of(p, e)] for p, e in zip(pages, providers)], dtype=object)


def results(pages: DataFrame, most: int = MOST) -> DataFrame:
    """query_id, provider, place, title, url, snippet from recorded pages (query_id, provider, html, contact): the first `most`
    results whose link is useful, or which look like the contact's profile. Pages without results give no rows; nothing is shuffled."""
    base = F.create_map(*[F.lit(x) for engine, p in PLACES.items() for x in (engine, p["base"])])
    one = lambda r: F.struct(collapse(r["title"]).alias("title"), urls.unwrap_redirect(r["href"], F.try_element_at(base, F.col("provider"))).alias("url"), collapse(r["snippet"]).alias("snippet"))
    passes = lambda r: r["url"].startswith("http") & (urls.is_useful(r["url"]) | contacts.promising_profile(r["url"], r["title"], r["snippet"], F.col("contact")))
    kept = F.slice(F.filter(F.transform(_found("html", "provider"), one), passes), 1, most)
    return pages.select("query_id", "provider", F.posexplode(kept).alias("place", "r")).select("query_id", "provider", "place", "r.*")
