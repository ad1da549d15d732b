"""Personal data: exact base patterns, and bootstrapped contextual extraction beside them.

Base matches are the seeds. An instance is a seed or a filler of another shape: one to FILL words, with or without digits. Lexical
patterns are the slots that instances stand in: the two words before, or the word before and the word after. Spark scores
the graph of patterns and instances in rounds:
1. every slot that a scored instance stands in is a candidate; its support in a kind is the sum of its different instances' scores, and
   it needs SUPPORT, so that copies of one text don't make a pattern;
2. its confidence is the score-weighted share of the slot's fillings in all texts (and one more) that are such instances;
3. fillers of promising slots become instances; one's score is the mean confidence over all slots that it stands in anywhere, so that
   a common word that fills a slot by chance scores near 0. Scored instances support the next round's patterns.
Rounds end when nothing changes, or after ROUNDS; texts are read only for patterns and instances that are new in a round. A filler of a confident slot that is a promising instance is a span.

Base spans always stay; the method only adds spans that overlap none of them, nor each other (higher confidence first).

Every round reads the texts whole, with the patterns or instances in parts of at most PART; more take further passes.
A word is a run without white space, compared in lower case without punctuation at its ends; words of nothing else are no words.

Edge cases: null and empty texts have no spans; repeated rows get equal spans; base matches of any length are found in linear
time, and seeds are placed among words by bisection; an empty table gives no rows; columns other than doc_id and text are ignored;
masking needs no n_chars, and keeps its type where it is there.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, few, fresh, slices, table, texts_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does, and never gives digits back: lookbehind and possessive runs keep that linear.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
EDGE = re.compile(r"^[^\w@+]+|[^\w]+$")
LEAD, RUN = re.compile(r"[^\w@+]*"), re.compile(r"\S+")
ROUNDS, SMOOTH, SUPPORT, FILL = 6, 1.0, 3.0, 6
CONFIDENT, PROMISING = 0.8, 0.5
#: Patterns or instances that go to the workers at once, and words that one worker keeps the hashes of.
PART, CACHED_WORDS = 500_000, 200_000
TWO_BEFORE, AROUND = np.uint64(0x51ED2701A9B4C3D5), np.uint64(0x2545F4914F6CDD1D)


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of a local part, @ and a domain: the local part is the whole run before an @, as far as the last match left it."""
    done, at = 0, text.find("@")
    while at >= 0:
        end = DOMAIN.match(text, at + 1)
        if end:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, end.end()
                done = end.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; in code points."""
    out = [(0, s, e) for s, e in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = "".join(DIGIT.findall(m[0])) if m.end() - m.start() < 40 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    x = (a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Words:
    """Hashes of words in lower case without punctuation at their ends; 0 for what is only punctuation."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def codes(self, text: str) -> np.ndarray:
        """One for every word of the text, without those that are only punctuation."""
        known, out = self.known, []
        for w in text.split():
            code = known.get(w)
            if code is None:
                core = EDGE.sub("", w)
                code = (_hash(core.lower()) or 1) if core else 0
                if len(known) >= CACHED_WORDS:
                    known.clear()
                known[w] = code
            if code:
                out.append(code)
        return np.array(out, np.uint64)


def word_spans(text: str) -> np.ndarray:
    """Start and end of each word's core, a row for every code."""
    out = []
    for m in RUN.finditer(text):
        lead = LEAD.match(m[0]).end()
        core = EDGE.sub("", m[0])
        if core:
            out.append((m.start() + lead, m.start() + lead + len(core)))
    return np.array(out, np.int64).reshape(-1, 2)


def joined(texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The texts' codes behind each other, a 0 after each text, and where each text starts."""
    codes, zero = [words.codes(t) for t in texts], np.zeros(1, np.uint64)
    return np.concatenate([x for c in codes for x in (c, zero)] or [zero]), np.cumsum([0, *(len(c) + 1 for c in codes)])[:-1]


def by_text(at: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each text with rows of at (places in joined codes), and those rows."""
    of = np.searchsorted(starts, at, side="right") - 1
    order = np.argsort(of, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
        if len(rows):
            yield int(of[rows[0]]), rows


def slots(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The patterns, two-before and around, of fillers from word first to word last (inclusive); 0 where words are missing."""
    inside = lambda i: np.where((i >= 0) & (i < len(codes)), codes[np.clip(i, 0, max(0, len(codes) - 1))], np.uint64(0))
    second, one, after = inside(first - 2), inside(first - 1), inside(last + 1)
    return np.where((second != 0) & (one != 0), _mix(_mix(second, one), TWO_BEFORE), np.uint64(0)), np.where((one != 0) & (after != 0), _mix(_mix(one, after), AROUND), np.uint64(0))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values if len(ordered) else np.zeros(len(values), bool)


def fillers(codes: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pattern, first, last of every filling of a slot among patterns (ascending). Two words before are filled by the next word."""
    found, n, gaps = [], len(codes), np.concatenate([[0], np.cumsum(codes == 0)])

    def keep(keys: np.ndarray, before: int, size: int, after: int) -> None:
        hit = np.flatnonzero(_among(keys, patterns))
        hit = hit[gaps[hit + before + size + after] == gaps[hit]]  # no text ends inside
        found.append((keys[hit], hit + before, hit + before + size - 1))

    if n > 2:
        keep(_mix(_mix(codes[:-2], codes[1:-1]), TWO_BEFORE), 2, 1, 0)
    for size in range(1, min(FILL, n - 2) + 1):
        keep(_mix(_mix(codes[: n - size - 1], codes[size + 1 :]), AROUND), 1, size, 1)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def instance_keys(codes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of size words."""
    n = max(0, len(codes) - size + 1)
    out = codes[:n]
    for k in range(1, size):
        out = _mix(out, codes[k : k + n])
    return out


def outside_base(text: str, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which fillers touch no base span; and the words' spans."""
    spans, taken = word_spans(text), np.zeros(len(text) + 1, np.int32)
    for _, s, e in base_spans(text):
        taken[s:e] = 1
    total = np.concatenate([[0], taken.cumsum()])
    return total[spans[last, 1]] == total[spans[first, 0]], spans


def seeds_of(text: str, words: Words) -> list[tuple[int, int, list[int]]]:
    """kind, instance and patterns of every base span."""
    base = base_spans(text)
    if not base:
        return []
    codes, spans, out = words.codes(text), word_spans(text), []
    for kind, s, e in base:
        before, after = int(np.searchsorted(spans[:, 1], s, side="right")), int(np.searchsorted(spans[:, 0], e))
        patterns = [int(p[0]) for p in slots(codes, np.array([before]), np.array([after - 1])) if p[0]]
        out.append((kind, _hash(f"{kind} {text[s:e].lower()}"), patterns))
    return out


SPAN = "struct<kind:int,start:int,end:int>"
_signed = lambda x: np.asarray(x, np.uint64).view(np.int64)


def seed_edges(docs: DataFrame) -> DataFrame:
    """instance, kind, pattern, n of base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches, "text"):
            rows = [(i, k, p) for text in texts_of(b, "text") for k, i, patterns in seeds_of(text, words) for p in patterns]
            if rows:
                yield pa.record_batch([pa.array(_signed([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int32()), pa.array(_signed([r[2] for r in rows]))], ["instance", "kind", "pattern"])

    return docs.select("text").mapInArrow(run, "instance long, kind int, pattern long").groupBy("instance", "kind", "pattern").agg(F.count("*").alias("n"))


def _parts(keys: DataFrame, column: str, scratch: Scratch, label: str) -> Iterator[pa.Table]:
    """The distinct rows of keys by column, ascending (unsigned), in parts of about PART."""
    keys = scratch.write(keys.distinct(), label)
    n = -(-keys.count() // PART)
    for part in range(n):
        rows = keys.filter(F.pmod(F.xxhash64(column), F.lit(n)) == part).toArrow()
        yield rows.take(pa.array(np.argsort(rows.column(column).to_numpy().view(np.uint64))))


def _keys(part: pa.Table, column: str) -> np.ndarray:
    return part.column(column).to_numpy().view(np.uint64)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def slot_totals(docs: DataFrame, patterns: np.ndarray) -> DataFrame:
    """pattern, n: how often each slot is filled in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(len(patterns), np.int64)
        for b in slices(batches, "text", most_bytes=1 << 20):
            np.add.at(total, np.searchsorted(patterns, fillers(joined(texts_of(b, "text"), words)[0], patterns)[0]), 1)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(_signed(patterns[seen])), pa.array(total[seen])], ["pattern", "n"])

    return docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def slot_fillers(docs: DataFrame, patterns: np.ndarray) -> DataFrame:
    """instance, size of the fillers, outside base spans, of slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches, "text", most_bytes=1 << 20):
            texts, found = texts_of(b, "text"), []
            codes, starts = joined(texts, words)
            _, first, last = fillers(codes, patterns)
            free = np.zeros(len(first), bool)
            for i, rows in by_text(first, starts):
                free[rows] = outside_base(texts[i], first[rows] - starts[i], last[rows] - starts[i])[0]
            for size in range(1, FILL + 1):
                found.append((np.unique(instance_keys(codes, size)[first[free & (last - first + 1 == size)]]), size))
            if sum(len(k) for k, _ in found):
                yield pa.record_batch([pa.array(_signed(np.concatenate([k for k, _ in found]))), pa.array(np.concatenate([np.full(len(k), size, np.int32) for k, size in found]))], ["instance", "size"])

    return docs.select("text").mapInArrow(run, "instance long, size int").distinct()


def instance_edges(docs: DataFrame, instances: np.ndarray, sizes: list[int]) -> DataFrame:
    """instance, pattern, n: every slot, outside base spans, that the instances stand in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches, "text", most_bytes=1 << 20):
            texts, pairs = texts_of(b, "text"), []
            codes, starts = joined(texts, words)
            gaps = np.concatenate([[0], np.cumsum(codes == 0)])
            for size in sizes:
                keys = instance_keys(codes, size)
                first = np.flatnonzero(_among(keys, instances))
                first = first[gaps[first + size] == gaps[first]]
                free = np.zeros(len(first), bool)
                for i, rows in by_text(first, starts):
                    free[rows] = outside_base(texts[i], first[rows] - starts[i], first[rows] - starts[i] + size - 1)[0]
                first = first[free]
                pairs += [(keys[first][slot != 0], slot[slot != 0]) for slot in slots(codes, first, first + size - 1)]
            if pairs:
                keys, at = (np.concatenate(x) for x in zip(*pairs))
                yield pa.record_batch([pa.array(_signed(keys)), pa.array(_signed(at))], ["instance", "pattern"])

    return docs.select("text").mapInArrow(run, "instance long, pattern long").groupBy("instance", "pattern").agg(F.count("*").alias("n"))


def learn(docs: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """pattern, kind, confidence of the promising patterns; and instance, size, kind, score of the promising unseen instances."""
    seeds = scratch.write(seed_edges(docs), "seeds")
    own = seeds.select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    edges, scores = seeds.select("instance", "pattern", "n"), own
    known = own.select("instance", F.lit(0).alias("size"), "kind", "score").limit(0)
    patterns = seeds.select("pattern", "kind", F.lit(0.0).alias("confidence")).limit(0)
    totals = standing = found = asked = before = None
    unseen = lambda rows, old, key: rows if old is None else rows.join(old, key, "left_anti")
    more = lambda old, parts: old if not parts else _union([*([old] if old is not None else []), *parts])
    for i in range(rounds):
        hits = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("hits"), F.sum("score").alias("support"))
        hits = scratch.write(hits.filter(F.col("support") >= SUPPORT - 1e-9), f"hits-{i}")
        new = unseen(hits.select("pattern").distinct(), totals, "pattern")
        totals = more(totals, [scratch.write(slot_totals(docs, _keys(part, "pattern")), f"totals-{i}-{j}") for j, part in enumerate(_parts(new, "pattern", scratch, f"new-{i}"))])
        if totals is None:
            break
        patterns = hits.join(totals, "pattern", "left").select("pattern", "kind", (F.col("hits") / (F.greatest(F.coalesce("n", F.lit(0)), "hits") + SMOOTH)).alias("confidence"))
        patterns = scratch.write(patterns.filter(F.col("confidence") >= PROMISING), f"patterns-{i}")
        now = tuple(patterns.agg(F.count("*"), F.round(F.sum("confidence"), 6)).first())
        if not now[0] or now == before:
            break
        before = now
        new = unseen(patterns.select("pattern").distinct(), asked, "pattern")
        filled = [scratch.write(slot_fillers(docs, _keys(part, "pattern")), f"fillers-{i}-{j}") for j, part in enumerate(_parts(new, "pattern", scratch, f"slots-{i}"))]
        asked = scratch.write(more(asked, [new]), f"asked-{i}")
        if filled:
            filled = scratch.write(unseen(_union(filled).distinct(), found, "instance"), f"found-{i}")
            found = more(found, [filled])
            sizes = sorted(r["size"] for r in filled.select("size").distinct().collect())
            standing = more(standing, [scratch.write(instance_edges(docs, _keys(part, "instance"), sizes), f"standing-{i}-{j}") for j, part in enumerate(_parts(filled.select("instance"), "instance", scratch, f"instances-{i}"))])
        if standing is None:
            break
        whole = standing.groupBy("instance").agg(F.sum("n").alias("all"))
        good = standing.join(patterns, "pattern").groupBy("instance", "kind").agg(F.sum(F.col("n") * F.col("confidence")).alias("hits"))
        known = good.join(whole, "instance").join(found, "instance").select("instance", "size", "kind", (F.col("hits") / F.col("all")).alias("score"))
        known = scratch.write(known.filter(F.col("score") >= PROMISING), f"known-{i}")
        scores = own.unionByName(known.groupBy("instance", "kind").agg(F.max("score").alias("score")))
        edges = seeds.select("instance", "pattern", "n").unionByName(standing)
    return patterns, known


def discovered(docs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """doc_id, text_key, more (spans with their confidence) of the rows with unseen identifiers; None without any."""
    patterns, instances = learn(docs, scratch)
    patterns = patterns.filter(F.col("confidence") >= CONFIDENT).groupBy("pattern").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("kind"))).alias("best")).select("pattern", (-F.col("best.kind")).alias("kind"), F.col("best.confidence").alias("confidence"))
    if patterns.isEmpty() or instances.isEmpty():
        return None
    instances = instances.select("instance").distinct()
    kind, parts = dict(docs.dtypes)["doc_id"], []
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    for i, slot_part in enumerate(_parts(patterns, "pattern", scratch, "confident-slots")):
        told = dict(zip(_keys(slot_part, "pattern").tolist(), zip(*(slot_part.column(c).to_pylist() for c in ("kind", "confidence")))))
        for j, part in enumerate(_parts(instances, "instance", scratch, f"promising-{i}")):
            parts.append(scratch.write(_marked(rows, kind, _keys(slot_part, "pattern"), told, _keys(part, "instance")), f"marked-{i}-{j}"))
    return _union(parts).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set("more")).alias("more"))


def _marked(rows: DataFrame, kind: str, patterns: np.ndarray, told: dict, instances: np.ndarray) -> DataFrame:
    span = pa.list_(pa.struct([("confidence", pa.float64()), ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches, "text", most_bytes=1 << 20):
            texts, found = texts_of(b, "text"), {}
            codes, starts = joined(texts, words)
            slot, first, last = fillers(codes, patterns)
            ok = np.zeros(len(first), bool)
            for size in range(1, FILL + 1):
                mine = last - first + 1 == size
                ok[mine] = _among(instance_keys(codes, size)[first[mine]], instances)
            slot, first, last = slot[ok], first[ok], last[ok]
            for i, rows in by_text(first, starts):
                free, at = outside_base(texts[i], first[rows] - starts[i], last[rows] - starts[i])
                spans = [dict(zip(("kind", "confidence"), told[int(slot[r])])) | {"start": int(at[first[r] - starts[i], 0]), "end": int(at[last[r] - starts[i], 1])} for r in rows[free]]
                if spans:
                    found[i] = spans
            if found:
                yield pa.record_batch([b.column("doc_id").take(pa.array(list(found))), b.column("text_key").take(pa.array(list(found))), pa.array(list(found.values()), span)], ["doc_id", "text_key", "more"])

    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, more array<struct<confidence:double,kind:int,start:int,end:int>>")


def all_spans(base: list[tuple[int, int, int]], more: list[dict] | None) -> list[tuple[int, int, int]]:
    """base and those of more that overlap no earlier choice, by kind, then start; the more confident first, then the longer, then the first."""
    out = list(base)
    if more:
        chosen: list[tuple[int, int]] = []
        for x in sorted(more, key=lambda x: (-x["confidence"], x["start"] - x["end"], x["start"], x["kind"])):
            span = x["start"], x["end"]
            at = bisect.bisect(chosen, span)
            if (not at or chosen[at - 1][1] <= span[0]) and (at == len(chosen) or span[1] <= chosen[at][0]):
                chosen.insert(at, span)
                out.append((x["kind"], *span))
    return sorted(out)


def _with_more(docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """docs with a column of discovered spans. Only rows that have some are on the other side of the join."""
    more = discovered(docs.select("doc_id", "text"), scratch)
    if more is None:
        return docs.withColumn(name, F.lit(None).cast("array<struct<confidence:double,kind:int,start:int,end:int>>"))
    id_, key = (fresh(c, [*docs.columns, name]) for c in ("mask_id", "mask_key"))
    side = few(scratch.write(more.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("more").alias(name)), "more"))
    return docs.join(side, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left").select(*docs.columns, name)


def detect(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, base and spans (base and discovered) for every row of docs (doc_id, text)."""
    met = _with_more(docs.select("doc_id", "text"), scratch, "more")
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    listed_ = lambda rows: pa.array([[dict(zip(("kind", "start", "end"), x)) for x in spans] for spans in rows], span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            base = [base_spans(text) for text in texts_of(b, "text")]
            yield pa.record_batch([b.column("doc_id"), listed_(base), listed_([all_spans(x, m) for x, m in zip(base, b.column("more").to_pylist())])], ["doc_id", "base", "spans"])

    return met.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, base array<{SPAN}>, spans array<{SPAN}>")


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
    of_kind = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")  # noqa: E731  a second parameter would be the element's place
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def masked_text(text: str, more: list[dict] | None) -> str:
    """text with each stretch of overlapping spans replaced by its first span's kind in brackets."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in all_spans(base_spans(text), more)):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with personal data masked in text, and n_chars, if there is such a column, to match."""
    names, extra = docs.columns, fresh("mask_more", docs.columns)
    met = _with_more(docs, scratch, extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", most_bytes=1 << 20):
            texts = b.column("text").to_pylist()
            done = [t if t is None else masked_text(t, m) for t, m in zip(texts, b.column(extra).to_pylist())]
            new = {"text": pa.array(done, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([n if t == d else len(d) for t, d, n in zip(texts, done, b.column("n_chars").to_pylist())], b.column("n_chars").type)
            yield pa.record_batch([new.get(c, b.column(c)) for c in names], names)

    return met.mapInArrow(run, docs.schema)


def oracle() -> str:
    """SQL of the base spans; equal where the method finds no further one, as on the shared tables. A match's place is the length of all pieces and matches before it."""
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    doubled = f"list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({digits})[i]::INT ELSE reverse({digits})[i]::INT * 2 - CASE WHEN reverse({digits})[i]::INT > 4 THEN 9 ELSE 0 END END)"
    right = ("true", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0", f"length({digits}) BETWEEN 13 AND 19 AND list_sum({doubled}) % 10 = 0", f"length({digits}) BETWEEN 9 AND 15")
    found = " UNION ALL ".join(
        f"""SELECT row_no, {i} AS kind, s, s + length(m) AS e FROM (SELECT row_no, unnest(range(1, len(ms) + 1)) AS k, ms[k] AS m,
        (list_sum(list_transform(ps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::BIGINT AS s
        FROM (SELECT row_no, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS ps FROM d)) WHERE {ok}"""
        for i, (p, ok) in enumerate(zip(patterns, right))
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, k in enumerate(KINDS))
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
listed AS (SELECT row_no, any_value(doc_id) AS doc_id, {counts}, coalesce(string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY kind, s) FILTER (WHERE kind IS NOT NULL), '') AS spans FROM d LEFT JOIN found USING (row_no) GROUP BY row_no)
SELECT doc_id, {", ".join(f"n_{k}" for k in KINDS)}, sha256(spans) AS base_sha256, spans FROM listed"""


QUERIES = {"op10_pii": op10_pii}
ORACLES = {"op10_pii": oracle()}
