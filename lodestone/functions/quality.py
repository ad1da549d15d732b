"""Quality verdicts on texts as column expressions."""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import lexicon as L
from .text import collapse, has_any, hits, is_blank, occurrences, strip, text_of

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def pdf_like(c: Column) -> Column:
    """Text that is the inside of a PDF file: two indicators, its header, or many control or non-ASCII characters at the start."""
    head = F.left(c, F.lit(1000))
    size = F.length(head)
    count = lambda pattern: size - F.length(F.regexp_replace(head, f"{pattern}+", ""))
    odd = (count(CONTROL) > size * 0.05) | (count(r"[^\x00-\x7f]") > size * 0.3)
    return F.coalesce((F.length(c) >= 50) & ((hits(F.left(c, F.lit(2000)), L.PDF_INDICATORS) >= 2) | strip(c).startswith("%PDF-") | ((F.length(c) > 200) & odd)), F.lit(False))


def unavailable(c: Column, low: Column | None = None) -> Column:
    """Texts under 50 characters, with a note that the page can't be shown, or short ones with an error word. low: a column that holds
    the lower-cased text, which is otherwise worked out for every word sought."""
    n, low = F.length(strip(text_of(c))), F.lower(text_of(c)) if low is None else low
    return (n < 50) | has_any(low, L.UNAVAILABLE) | ((n < 200) & has_any(low, L.ERROR_WORDS))


CONTROLS = frozenset(map(chr, [*range(9), 11, 12, *range(14, 32)]))
COUNTS = ("letters", "most", "solid", "controls", "signs", "words", "plain", "plain_size")


LETTER, SPACE, SIGN, CONTROL_CODE, LOOSE = 1, 2, 4, 8, 16


@functools.cache
def _kinds() -> np.ndarray:
    """What each code point is, once a worker. Signs are neither letters, numbers, `_` nor white space; spaces and line ends are loose."""
    chars = list(map(chr, range(sys.maxunicode + 1)))
    of = lambda test: np.fromiter(map(test, chars), bool, len(chars))
    space, named = of(str.isspace), of(str.isalnum)
    named[ord("_")] = True
    kinds = of(str.isalpha) * LETTER + space * SPACE + ~(named | space) * SIGN
    kinds[list(map(ord, CONTROLS))] += CONTROL_CODE
    kinds[[ord(" "), ord("\n")]] += LOOSE
    return kinds.astype(np.uint8)


def _counted(t: str) -> dict[str, int]:
    if not t:
        return dict.fromkeys(COUNTS, 0)
    codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    kinds = _kinds()[codes]
    is_ = lambda kind: (kinds & kind) != 0
    letter, sign, edges = is_(LETTER), is_(SIGN), np.zeros(len(codes) + 2, np.int8)
    edges[1:-1] = ~is_(SPACE)
    edges = np.flatnonzero(np.diff(edges))
    starts, ends = edges[::2], edges[1::2]
    spelled = np.concatenate([[0], np.cumsum(letter)])
    sizes = (ends - starts)[spelled[ends] - spelled[starts] == ends - starts]
    four = sign[:-3] & sign[1:-2] & sign[2:-1] & sign[3:]
    signs = np.count_nonzero(four[1:] & ~four[:-1]) + int(len(four) > 0 and four[0])
    found = codes[letter]
    most = 0 if not len(found) else np.bincount(found).max() if found.max() < 4096 else np.unique(found, return_counts=True)[1].max()
    return {"letters": len(found), "most": int(most), "solid": len(t) - np.count_nonzero(is_(LOOSE)), "controls": np.count_nonzero(is_(CONTROL_CODE)), "signs": signs, "words": len(starts), "plain": len(sizes), "plain_size": int(sizes.sum())}


@F.arrow_udf(StructType([StructField(name, IntegerType()) for name in COUNTS]))
def _text_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([(name, pa.int32()) for name in COUNTS])
    for texts in batches:
        yield pa.array([_counted(t.as_py() or "") for t in texts], kind)


def text_counts(c: Column) -> Column:
    """What the verdicts below need of a text, each character looked at once: letters and the commonest one, characters that are
    neither spaces nor line ends, control characters, runs of signs, words, and words of letters only with their length."""
    return _text_counts(F.make_valid_utf8(text_of(c)))


def raw_pdf(c: Column, n: Column | None = None) -> Column:
    """n: the text's counts, where the caller has them."""
    c = text_of(c)
    n = text_counts(c) if n is None else n
    return strip(c).startswith("%PDF-") | (hits(c, L.PDF_MARKERS) >= 3) | (n["controls"] > F.length(c) * 0.1)


def corrupted(c: Column, n: Column | None = None) -> Column:
    """One letter makes over 40 %, words are over 25 letters on average, or runs of four signs are frequent."""
    n = text_counts(c) if n is None else n
    long_words = (n["plain"] > 10) & (n["plain_size"] > n["plain"] * 25)
    return ((n["letters"] > 0) & (n["most"] / n["letters"] > 0.4)) | long_words | (n["signs"] > F.length(text_of(c)) / 200)


def letter_share(c: Column, n: Column | None = None) -> Column:
    """Letters among the characters that are neither spaces nor line ends; null if there are none of these."""
    n = text_counts(c) if n is None else n
    return F.when(n["solid"] > 0, n["letters"] / n["solid"])


def valid_text(c: Column) -> Column:
    """A text that is too short, or begins like a PDF file, is judged by that alone and not counted."""
    c = text_of(c)
    fits = (F.length(strip(c)) >= 50) & ~strip(c).startswith("%PDF-")
    n = text_counts(F.when(fits, c))
    return fits & ~raw_pdf(c, n) & ~corrupted(c, n) & (n["words"] >= 5) & F.coalesce(letter_share(c, n) >= 0.2, F.lit(False))


def challenge(c: Column) -> Column:
    return hits(F.lower(text_of(c)), L.CHALLENGE_SIGNALS) >= 2


def ocr_fit(c: Column) -> Column:
    c = text_of(c)
    return (F.length(strip(c)) >= 50) & F.coalesce(letter_share(c) >= 0.3, F.lit(True))


def with_web_quality(df: DataFrame, text: str) -> DataFrame:
    """df with score, quality, flags. Metrics are one projection, flags and score the next, so that no pattern runs twice."""
    t = "`q_text`"
    words = F.regexp_extract_all(F.col(t), F.lit(r"(?U)\b[\w-]+\b"), F.lit(0))
    low = F.col("`q_low`")
    measured = df.withColumn("q_text", collapse(F.col(text))).withColumns({"q_low": F.lower(t), "q_words": words, "q_len": F.length(t)})
    measured = measured.withColumns(
        {
            "q_n": F.size("q_words"),
            "q_unique": F.size(F.array_distinct(F.transform(F.filter("q_words", lambda w: F.length(w) >= 3), lambda w: F.lower(w)))),
            "q_pdf": pdf_like(F.col(t)),
            "q_gone": unavailable(F.col(t), low),
            "q_template": F.rlike(F.col(t), F.lit("|".join(L.TEMPLATE_PATTERNS))),
            "q_framework": F.contains(low, F.lit("{{$ctrl")),
            "q_session": F.rlike(F.col(t), F.lit(r"\{\p{Nd}+\}")),
            "q_shell": hits(low, L.SHELL_SIGNALS),
            "q_challenge": hits(low, L.CHALLENGE_SIGNALS),
            "q_portal": hits(low, L.PORTAL_SIGNALS),
            "q_body": hits(low, L.BODY_KEYWORDS),
            "q_detail": hits(low, L.DETAIL_KEYWORDS),
        }
    )
    n, num = F.col("q_len"), lambda cond, v: F.when(cond, v).otherwise(0)
    portal, stopped = F.col("q_portal") >= 2, F.col("q_challenge") >= 2
    score = (
        100
        - num(F.col("q_pdf"), 80)
        - num(F.col("q_gone"), 45)
        - num(F.col("q_template"), 60)
        - num(F.col("q_framework"), 20)
        + F.when(n < 80, -55).when(n < 200, -35).when(n < 500, -15).when(n > 1500, 10).otherwise(0)
        + F.when(F.col("q_n") < 40, -20).when(F.col("q_n") > 250, 5).otherwise(0)
        - num(F.col("q_unique") < 20, 15)
        - num(F.col("q_shell") >= 3, F.least(F.lit(35), F.col("q_shell") * F.when(n < 800, 10).otherwise(4)))
        - num(stopped, 95)
        - num(portal, F.least(F.lit(55), F.col("q_portal") * 18))
        - num(F.col("q_session"), 25)
        + F.when(F.col("q_body") == 0, -20).otherwise(F.least(F.lit(20), F.col("q_body") * 4))
        + F.when(F.col("q_detail") >= 2, F.least(F.lit(25), F.col("q_detail") * 8)).when(portal, -20).otherwise(0)
        - num((n < 1200) & (stopped | portal), 25)
    )
    substance = (n >= 500) | (F.col("q_detail") >= 1)
    flags = [
        (F.col("q_pdf"), "pdf_like_content"),
        (F.col("q_gone"), "unavailable_page"),
        (F.col("q_template"), "template_placeholders"),
        (F.col("q_framework"), "framework_placeholders"),
        (n < 80, "too_short"),
        ((n >= 80) & (n < 200), "short_content"),
        ((n >= 200) & (n < 500), "limited_content"),
        (F.col("q_n") < 40, "low_word_count"),
        (F.col("q_unique") < 20, "low_unique_words"),
        (F.col("q_shell") >= 3, "shell_page_signals"),
        (stopped, "challenge_page"),
        (portal, "portal_shell_page"),
        (F.col("q_session"), "session_placeholders"),
        (F.col("q_body") == 0, "missing_body_keywords"),
        (portal & (F.col("q_detail") < 2), "missing_detail_sections"),
        (~substance, "insufficient_substance"),
    ]
    empty = n == 0
    scored = measured.withColumns(
        {
            "score": F.when(empty, 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), score))).cast("int"),
            "flags": F.when(empty, F.array(F.lit("empty_content"))).otherwise(F.array_compact(F.array(*[F.when(c, f) for c, f in flags]))),
            "q_substance": substance & ~empty,
        }
    )
    quality = F.when(~F.col("q_substance") & (F.col("score") >= 35), "weak").when(F.col("score") >= 60, "good").when(F.col("score") >= 35, "weak").otherwise("bad")
    return scored.withColumn("quality", quality).drop(*[c for c in scored.columns if c.startswith("q_")])


def with_candidate_score(df: DataFrame, text: str, method: str) -> DataFrame:
    """df with score: length by the method's trust, less penalties for markers and very short lines, plus the method's head start; 0 for an empty text.

    The lower-cased text and the lines are columns of a projection before, so that they are not worked out again for every marker.
    """
    weight = lambda i: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, w in L.METHOD_WEIGHTS.items() for x in (k, w[i])]), F.col(method)), F.lit(L.OTHER_WEIGHT[i]))
    lines = F.filter(F.split(F.regexp_replace(text, L.LINE_END, "\n"), "\n"), lambda x: ~is_blank(x))
    measured = df.withColumns({"c_low": F.lower(text), "c_lines": lines})
    low, n, lines = F.col("c_low"), F.length(text), F.col("c_lines")
    counts = measured.withColumns({"c_counts": occurrences(low, L.COMMENT_MARKERS, L.BOILERPLATE_MARKERS, L.CHALLENGE_MARKERS), "c_short": F.size(F.filter(lines, lambda x: F.length(x) <= 3)) / F.greatest(F.size(lines), F.lit(1))})
    penalty = F.get("c_counts", F.lit(0)) * 400 + F.get("c_counts", F.lit(1)) * 120 + F.get("c_counts", F.lit(2)) * 5000
    score = F.when(F.col(text) == "", 0.0).otherwise(F.greatest(F.lit(0.0), n * weight(0) - (penalty + F.col("c_short") * n * 0.3) + weight(1)))
    return counts.withColumn("score", score).drop("c_low", "c_lines", "c_counts", "c_short")


def drive_text(c: Column) -> Column:
    """A rendered file preview's text; null for a placeholder."""
    n = F.length(strip(text_of(c)))
    return F.when((n >= 200) & ~(has_any(text_of(c), L.DRIVE_PLACEHOLDERS) & (n < 500)), c)


def docs_text(c: Column) -> Column:
    """A rendered document's text without the editor's chrome; null for a placeholder or for too little."""
    from .text import drop_editor_chrome

    held = (hits(text_of(c), L.DOCS_PLACEHOLDERS) >= 2) & (F.length(strip(text_of(c))) < 500)
    return F.when(~held & (F.length(drop_editor_chrome(c)) > 200), drop_editor_chrome(c))
