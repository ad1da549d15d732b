"""Text normalisation and clean-up as column expressions. Null and empty are one and the same: both give an empty text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import lexicon as L


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, which is worked out once: a column named twice, or in a lambda that runs for every field, is worked out each time."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


#: The characters of WS.
WS_CHARACTERS = "".join(chr(c) for c in range(0x3001) if re.fullmatch(L.WS.replace("x{", "u").replace("}", ""), chr(c)))


def strip(c: Column) -> Column:
    """Without white space at the ends. Trimming looks at the ends only; a pattern would try every white space inside as the last one."""
    return F.btrim(c, F.lit(WS_CHARACTERS))


def is_blank(c: Column) -> Column:
    return strip(text_of(c)) == ""


def hits(c: Column, words: list[str]) -> Column:
    """How many of the words occur, each counted once."""
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(w)).cast("int") for w in words])


def has_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def occurrences(c: Column, *lists: list[str]) -> Column:
    """For each list the sum of its words' non-overlapping occurrences, as an array of integers: a text's search for all words is one Arrow call."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[sum(map(t.count, words)) for words in lists] for t in texts.to_pylist()], pa.list_(pa.int32()))

    return run(F.make_valid_utf8(text_of(c)))


def collapse(c: Column) -> Column:
    """Every run of white space as one space; none at the ends. The pattern matches only what changes: most spaces stand alone."""
    return F.trim(F.regexp_replace(text_of(c), f" {L.WS}+|(?! ){L.WS}+", " "))


def layout(c: Column) -> Column:
    """Spaces and tabs collapsed, lines kept, at most one blank line in a row. The patterns match only what changes: most spaces and line ends stand alone."""
    c = F.translate(text_of(c), "\xa0\ufeff", " ")
    for pattern, new in ((" [ \\t]+|\\t[ \\t]*", " "), (" +\\n *|\\n +", "\n"), ("\\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, new)
    return strip(c)


def fix_encoding(c: Column) -> Column:
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), L.ENCODING_FIXES, text_of(c))


def drop_page_artifacts(c: Column) -> Column:
    """Lines that hold only a page number, `Page n`, or a web address."""
    for pattern in (f"\\n{L.WS}*\\p{{Nd}}+{L.WS}*\\n", "\\nPage \\p{Nd}+\\n", f"\\n{L.WS}*www\\.[^\\n]+\\n", f"\\n{L.WS}*http[^\\n]+\\n"):
        c = F.regexp_replace(c, pattern, "\n")
    return c


def join_lines(c: Column) -> Column:
    """Hyphenated words joined; lines that go on in lower case joined by a space."""
    c = F.regexp_replace(c, f"([a-z])-{L.WS}*\\n{L.WS}*([a-z])", "$1$2")
    return F.regexp_replace(c, f"([a-z,]){L.WS}*\\n{L.WS}*([a-z])", "$1 $2")


def clean_pdf_text(c: Column) -> Column:
    """Encoding, white space, page artifacts and line breaks, in this order: white space goes first, so the last two find no lines."""
    return strip(join_lines(drop_page_artifacts(F.regexp_replace(fix_encoding(c), f"{L.WS}+", " "))))


def strip_comment_noise(c: Column) -> Column:
    """The text before the first comment marker, without lines that are only interface words."""
    low = F.lower(text_of(c))
    found = [F.nullif(F.instr(low, m), F.lit(0)) for m in L.CUT_MARKERS]
    c = F.left(text_of(c), F.coalesce(F.least(*found) - 1, F.length(text_of(c))))
    only = f"(?i)^{L.WS}*{L.UI_LINE.replace('@', L.WS)}{L.WS}*$"
    lines = F.filter(F.split(F.regexp_replace(c, L.LINE_END, "\n"), "\n"), lambda x: ~F.rlike(x, F.lit(only)))
    return layout(F.array_join(lines, "\n"))


def drop_editor_chrome(c: Column) -> Column:
    """Without the menus and warnings of a document editor."""
    return collapse(reduce(lambda x, p: F.regexp_replace(x, "(?is)" + p.replace("@", L.WS), ""), L.EDITOR_CHROME, text_of(c)))


def clean_ocr(c: Column) -> Column:
    """Without lines that are one interface word or one character, stray signs, and spaces between CJK characters (pairs, left to right)."""
    words = F.array(*[F.lit(w) for w in L.OCR_UI])

    def kept(line: Column) -> Column:
        bare = strip(F.lower(line))
        return ~F.array_contains(words, bare) & (F.length(bare) > 1)

    c = F.array_join(F.filter(F.split(text_of(c), "\n"), kept), "\n")
    c = collapse(F.regexp_replace(c, f"[^\\p{{L}}\\p{{N}}_{L.WS[1:-1]}一-鿿{L.OCR_KEPT}]", " "))
    c = F.when(F.length(c) >= 3, c).otherwise("")
    return F.regexp_replace(c, f"([一-鿿]){L.WS}+([一-鿿])", "$1$2")


def clean_email(c: Column) -> Column:
    """Spelled-out @ and dots as signs; what then looks like no address comes back unchanged."""
    done = F.lower(strip(c))
    for pattern, sign in (("\\[at\\]", "@"), ("\\(at\\)", "@"), (f"{L.WS}+at{L.WS}+", "@"), ("\\[dot\\]", "."), ("\\(dot\\)", "."), (f"{L.WS}+dot{L.WS}+", "."), (f"{L.WS}+", "")):
        done = F.regexp_replace(done, pattern, sign)
    fits = F.contains(done, F.lit("@")) & F.contains(F.substring_index(done, "@", -1), F.lit("."))
    return F.when(c.isNull() | strip(c).isin(L.MISSING) | ~fits, c).otherwise(done)


def html_to_layout(c: Column) -> Column:
    """An HTML fragment as text with line ends for breaks and blocks; the named and numeric references of unescape()."""
    c = text_of(c)
    for tag in ("script", "style"):
        c = F.regexp_replace(c, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    c = F.regexp_replace(F.regexp_replace(c, f"(?i)<br{L.WS}*/?>", "\n"), "(?i)</(p|div|li|h[1-6]|tr)>", "\n")
    return layout(unescape(F.regexp_replace(c, "<[^>]+>", " ")))


# The character references that the native path decodes; & last, so that nothing is decoded twice.
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", "\xa0"), ("&#160;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&euro;", "€"), ("&#38;", "&"), ("&amp;", "&")]


def unescape(c: Column) -> Column:
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), REFERENCES, c)


def fragment_text(c: Column) -> Column:
    """An (escaped) HTML fragment's text nodes, one a line."""
    c = unescape(F.regexp_replace(unescape(text_of(c)), "(<[^>]*>)+", "\n"))
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), f"\\n{L.WS}*\\n{L.WS}*\\n+", "\n\n"))


def joined(*parts: Column) -> Column:
    """The parts that aren't blank, one a line; null if there are none."""
    kept = F.filter(F.array(*parts), lambda x: x.isNotNull() & ~is_blank(x))
    return F.nullif(F.array_join(kept, "\n"), F.lit(""))


def labelled(label: str, c: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), F.concat(F.lit(label), c))
