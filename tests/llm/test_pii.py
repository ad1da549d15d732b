import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import pii
from lodestone.llm.common import Scratch

from .support import agrees, documents, empty


def plain(text):
    """The base patterns as they are written."""
    luhn = lambda d: sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda t: re.sub("[^0-9]", "", t)
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+ 0123456789()é%", max_size=60))
def test_base_equals_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_base_on_chosen_texts():
    for t in ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 10.0.0.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (603) 555-3436, +12", "x@y", "..@a..b", "@a.b", "a@b.c.", "4" * 40, "0000.0.0.0", "+1" + "(" * 50 + "2"]:
        assert pii.base_spans(t) == plain(t)
    assert pii.base_spans("9" * 300_000) == [] and pii.base_spans("a" * 300_000) == []


def numbers(n):
    """Valid card numbers."""
    out, i = [], 4_000_000_000_000_000
    while len(out) < n:
        i += 7_919
        if plain(str(i)):
            out.append(str(i))
    return out


def words_and_spans(text):
    out = []
    for m in re.finditer(r"\S+", text):
        core = re.sub(r"^[^\w@+]+|[^\w]+$", "", m[0])
        if core:
            at = m.start() + re.match(r"[^\w@+]*", m[0]).end()
            out.append((core.lower(), at, at + len(core)))
    return out


def by_hand(rows, rounds):
    """Patterns, instances and spans with strings and dicts."""
    texts = [t or "" for _, t in rows]
    slots = lambda w, i, j: ([("two", w[i - 2][0], w[i - 1][0])] if i >= 2 else []) + ([("around", w[i - 1][0], w[j + 1][0])] if i >= 1 and j + 1 < len(w) else [])
    seen, fills = [], []  # (instance, pattern) of base spans; (pattern, instance, text, start, end, free) of all runs of words
    for n, t in enumerate(texts):
        w, base = words_and_spans(t), plain(t)
        for k, s, e in base:
            before, after = sum(x[2] <= s for x in w), next((i for i, x in enumerate(w) if x[1] >= e), len(w))
            seen += [((k, t[s:e].lower()), p) for p in slots(w, before, after - 1)]
        for i in range(len(w)):
            for j in range(i, min(len(w), i + pii.FILL)):
                free = not any(s < w[j][2] and w[i][1] < e for _, s, e in base)
                fills += [(p, tuple(x[0] for x in w[i : j + 1]), n, w[i][1], w[j][2], free, i == j) for p in slots(w, i, j)]
    scores = {(i, i[0]): 1.0 for i, _ in seen}
    edges, found, patterns, new, last = list(seen), {}, {}, set(), None
    for _ in range(rounds):
        patterns = {}
        for kind in range(4):
            for p in {p for _, p in edges}:
                mine = [i for i, q in edges if q == p]
                support = sum(scores.get((i, kind), 0) for i in set(mine))
                if support >= pii.SUPPORT - 1e-9:
                    hits = sum(scores.get((i, kind), 0) for i in mine)
                    total = sum(f[0] == p and (p[0] == "around" or f[6]) for f in fills)
                    if hits / (max(total, hits) + pii.SMOOTH) >= pii.PROMISING:
                        patterns[p, kind] = hits / (max(total, hits) + pii.SMOOTH)
        if patterns == last:
            break
        last = patterns
        new |= {f[1] for f in fills if f[5] and (f[0][0] == "around" or f[6]) and any((f[0], k) in patterns for k in range(4))}
        standing = [(f[1], f[0]) for f in fills if f[5] and f[1] in new]
        found = {}
        for i in new:
            for k in range(4):
                own = [patterns.get((p, k), 0) for j, p in standing if j == i]
                if sum(own) / len(own) >= pii.PROMISING:
                    found[i, k] = sum(own) / len(own)
        scores = {(i, i[0]): 1.0 for i, _ in seen} | found
        edges = seen + standing
    best = {}
    for (p, k), c in patterns.items():
        if c >= pii.CONFIDENT:
            best[p] = max(best.get(p, (0, 0)), (c, -k))
    out = [plain(t) for t in texts]
    for p, i, n, s, e, free, single in sorted(fills, key=lambda f: (-best.get(f[0], (0, 0))[0], f[3] - f[4], f[3], -best.get(f[0], (0, 0))[1])):
        if p in best and free and (p[0] == "around" or single) and any((i, k) in found for k in range(4)) and not any(a < e and s < b for k, a, b in out[n]):
            out[n].append((-best[p][1], s, e))
    return {p: c for p, c in patterns.items()}, found, [sorted(x) for x in out]


def second_hop_rows():
    """Cards stand in slot A; unseen codes stand in A and in slot B; one more code stands in B alone."""
    rows = [(i, f"greeting w{i} then pay card {c} today please") for i, c in enumerate(numbers(200))]
    codes = ["AB-77", "jane at example dot org", "555 123 4567", "zebra", "Q9 Q8 Q7", *(f"code{i}x" for i in range(9))]
    rows += [(1000 + 100 * k + i, f"he w{i} will pay card {c} today or never w{i}") for i, c in enumerate(codes) for k in range(2)]
    rows += [(2000 + i, f"note n{i} my token is {c} over and out w{i}") for i, c in enumerate(codes[5:])]
    rows += [(3000, "her token is XY-ZW over the counter"), (3001, "nothing of note in 2024-05-06 here"), (3002, "a zeb ra is over"), (3003, None), (3004, "")]
    return rows


def test_patterns_discover_unseen_identifiers_of_any_shape_and_a_second_hop(spark):
    rows = second_hop_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: sorted((x["kind"], x["start"], x["end"]) for x in r["spans"]) for r in pii.detect(frame, Scratch(spark, "t")).collect()}
    texts = dict(rows)
    say = lambda i: [texts[i][s:e] for _, s, e in got[i]]
    assert [say(1000 + i) for i in range(5)] == [["AB-77"], ["jane at example dot org"], ["555 123 4567"], ["zebra"], ["Q9 Q8 Q7"]]
    assert say(3000) == ["XY-ZW"]  # its only slot is a pattern that unseen instances of the first round made
    assert all(got[i] == [] for i in (3001, 3002, 3003, 3004)) and all(len(got[i]) == 1 for i in range(30))
    patterns, instances, spans = by_hand(rows, pii.ROUNDS)
    assert [got[i] for i, _ in rows] == spans
    ours, known = pii.learn(frame, Scratch(spark, "t"))
    assert sorted(round(r["confidence"], 9) for r in ours.collect()) == sorted(round(c, 9) for c in patterns.values())
    assert sorted(round(r["score"], 9) for r in known.collect()) == sorted(round(c, 9) for c in instances.values())


def test_parts_give_the_same(spark, monkeypatch):
    rows = second_hop_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(pii, "PART", 40)
    assert {r["doc_id"]: sorted((x["kind"], x["start"], x["end"]) for x in r["spans"]) for r in pii.detect(frame, Scratch(spark, "t")).collect()} == {i: x for (i, _), x in zip(rows, by_hand(rows, pii.ROUNDS)[2])}


def test_long_texts_take_linear_time():
    began = time.process_time()
    text = "call +1 603 555 3436 or mail a@b.cd now " * 20_000
    assert len(pii.seeds_of(text, pii.Words())) == 40_000
    assert time.process_time() - began < 20


def test_odd_rows_and_masks(spark):
    docs = documents(spark)
    assert pii.detect(docs, Scratch(spark, "t")).count() == 10
    assert pii.detect(empty(spark), Scratch(spark, "t")).count() == 0
    more = documents(spark, [(1, "mail a@b.cd or 10.0.0.1", "en", "s", 23), (2, None, None, None, None), (3, "clean", "en", "s", 5)])
    out = {r["doc_id"]: r for r in pii.masked(more, Scratch(spark, "t")).collect()}
    assert out[1]["text"] == "mail [EMAIL] or [IP]" and out[1]["n_chars"] == 20 and out[2]["text"] is None and out[3]["n_chars"] == 5
    assert pii.masked(more, Scratch(spark, "t")).columns == more.columns


def test_query_columns_equal_the_plain_patterns(spark, duck):
    out = pii.op10_pii(spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(out) == len(texts)
    for r in out:
        base = plain(texts[r["doc_id"]] or "")
        told = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest() and r["spans"] == told  # no discovered span on this table
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(kind == i for kind, _, _ in base) for i in range(4)]
    assert len({tuple(r[f"n_{k}"] for k in pii.KINDS) for r in out}) > 4
    agrees(spark, duck, "op10_pii", "/root/testdata/sf0.001")
