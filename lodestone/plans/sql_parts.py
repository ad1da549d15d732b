"""Building blocks of the checking SQL, written for DuckDB apart from the Spark expressions. Only fixed values are shared."""

from __future__ import annotations

from ..functions import lexicon as L
from .fixtures import literal

WS = L.WS


def q(text: str) -> str:
    return literal(text)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def hits(x: str, words: list[str]) -> str:
    return f"len(list_filter({literal(words)}, lambda w: contains({x}, w)))"


def any_of(x: str, words: list[str]) -> str:
    return f"({hits(x, words)} > 0)"


def occurrences(x: str, words: list[str]) -> str:
    return f"coalesce(list_sum(list_transform({literal(words)}, lambda w: len(string_split({x}, w)) - 1)), 0)"


def layout(x: str) -> str:
    inner = f"replace(replace(coalesce({x}, ''), '\xa0', ' '), '\ufeff', '')"
    inner = f"regexp_replace({inner}, '[ \\t]+', ' ', 'g')"
    inner = f"regexp_replace({inner}, ' *\\n *', chr(10), 'g')"
    return strip(f"regexp_replace({inner}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def unescape(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", "\xa0"), ("&#160;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&euro;", "€"), ("&#38;", "&"), ("&amp;", "&")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def clean_email(x: str) -> str:
    done = f"lower({strip(x)})"
    for pattern, sign in (("\\[at\\]|\\(at\\)", "@"), (f"{WS}+at{WS}+", "@"), ("\\[dot\\]|\\(dot\\)", "."), (f"{WS}+dot{WS}+", "."), (f"{WS}+", "")):
        done = f"regexp_replace({done}, '{pattern}', '{sign}', 'g')"
    return f"(case when {strip(x)} in ('-', '', 'N/A') then {x} when {done} like '%@%' and split_part({done}, '@', -1) like '%.%' then {done} else {x} end)"


def clean_name(x: str) -> str:
    """Prefixes by the first that fits, suffixes each in turn, quoted nicknames, white space."""
    bare = strip(f"coalesce({x}, '')")
    name = "case " + " ".join(f"when starts_with({bare}, {q(p + ' ')}) then {strip(f'substr({bare}, {len(p) + 1})')}" for p in L.NAME_PREFIXES) + f" else {bare} end"
    return f"(select {collapse(_quoted())} from (select {_suffixes('n')} as n from (select {name} as n)))"


def _quoted() -> str:
    return f"""regexp_replace(n, '{WS}*"[^"]*"{WS}*', ' ', 'g')"""


def _suffixes(x: str) -> str:
    for s in L.NAME_SUFFIXES:
        x = f"(select case when ends_with(y, {q(s)}) then {strip(f'left(y, length(y) - {len(s)})')} else y end from (select {x} as y))"
    return x


def authority(x: str) -> str:
    return f"regexp_extract(coalesce({x}, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"


def path(x: str) -> str:
    return f"regexp_extract(coalesce({x}, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1)"


def host(x: str) -> str:
    return f"lower({authority(x)})"


def first_url(x: str) -> str:
    whole = f"regexp_matches({strip(f'coalesce({x}, {q("")})')}, '^https?://[^/?#]+')"
    return f"(case when {whole} then {strip(x)} else nullif(regexp_extract(coalesce({x}, ''), {q(L.URL_IN_TEXT)}), '') end)"
