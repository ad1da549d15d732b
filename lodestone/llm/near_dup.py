"""MinHash near-duplicates by tensored banding, with candidates verified on full shingle sets.

Documents with equal shingle sets form a class, of which the smallest doc_id stands for all. Each
class gets two collections of half keys (2 * HALVES * HASHES minhashes); pairing every half key of
one with every half key of the other gives HALVES * HALVES table keys, so that 40 minhashes do for
100 tables of 4 hashes. A pair at the threshold shares a key but for about 7 cases in 100,000.

A bucket is the classes of one key. Bucket sizes come from partial aggregation, and buckets with the same
members, which true copies share in most tables, are taken as one (that of the first table). Links are
found in two steps, so that a bucket of n classes never becomes n * n rows:
1. every member of a bucket against the bucket's smallest class, verified, gives components;
2. in buckets that still hold several components, the members outside the largest one meet all members in place: pairs whose
   sketches agree in at least half of the minhashes (a pair at the threshold fails that in about 5 cases of a million) and whose
   bins allow a link (`may_link`: sets of up to some 180 shingles lose none, larger ones about 2 of a million at the threshold) get their
   full sets, and are verified in the first table they share; a bucket yields only links that join components. Texts that share a
   passage without being links, which a sketch of 40 minhashes lets pass, so leave before their sets are joined.
Pairs within a component need no check: they change no result. Buckets of more than BLOCK members, or
BLOCK_SHINGLES shingles, are dealt as blocks of outside members against chunks of all members to different tasks: a bucket
that is one component but for a few members stays linear.

Edge cases: a text without words, or null, has an empty set and is linked with nothing; so is a row
without doc_id; fewer words than a shingle has are one shingle; repeated rows fall in one class; rows of
one doc_id with several texts are one node, linked with all that any of them is near to; an empty table gives no rows; columns
other than doc_id and text are ignored; a very long text is hashed alone, in memory that follows its length.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, few, slices, table, texts_of

PERCENT, BLOCK, BLOCK_SHINGLES = 80, 1_024, 4_000_000
#: Words in a shingle if the caller names no other number, and the most that can be named.
SHINGLE, MOST_WORDS, SEED = 5, 16, 90_210
HASHES, HALVES = 2, 10  # minhashes in a half key; half keys in each of the two collections
SKETCH = 2 * HASHES * HALVES
LEAST_EQUAL = SKETCH // 2
BINS, DEVIATIONS = 256, 5  # bins of a set's hashes; standard deviations that a link's share of equal bins may fall short
_RNG = np.random.default_rng(SEED)
_ODD = lambda *shape: _RNG.integers(0, 2**63, shape, np.uint64) * np.uint64(2) + np.uint64(1)
BYTE, PLACE, MULTIPLY, ADD = _ODD(256), _ODD(MOST_WORDS + 1), _ODD(SKETCH), _ODD(SKETCH)
POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
POWER_INVERSE = np.uint64(pow(int(POWER), -1, 1 << 64))
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct 64-bit hashes of runs of `shingle` words, ascending.

    All words of the slice are hashed at once: differences of one running sum of byte codes times
    powers give every word's polynomial, whatever its place.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    bounds = 1 + np.cumsum([0, *(len(r) + 1 for r in raw)])
    word = IS_WORD[data]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    powers = np.full(len(data) + 1, POWER)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([[np.uint64(0)], np.add.accumulate(BYTE[data] * powers[:-1])])
    back = np.full(len(data) + 1, POWER_INVERSE)
    back[0] = 1
    back = np.multiply.accumulate(back)
    words = mixed((sums[ends] - sums[starts]) * back[starts])
    first = np.searchsorted(starts, bounds)
    n = max(0, len(words) - shingle + 1)
    runs = mixed(sum(words[k : k + n] * PLACE[k] for k in range(shingle))) if n else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= shingle:
            out.append(np.unique(runs[a : b - shingle + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + PLACE[-1:] * np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """32-bit minhashes, a row of SKETCH for each non-empty set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), SKETCH), np.uint32)
    for k in range(SKETCH):
        out[:, k] = np.minimum.reduceat(((flat * MULTIPLY[k] + ADD[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def binned(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS bytes for each ascending set: its hashes fall in bins, of which each has a byte of its smallest, 0 if it has none."""
    out = np.zeros((len(sets), BINS), np.uint8)
    rows, flat = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[::-1], np.concatenate(sets)[::-1]
    out[rows, flat % np.uint64(BINS)] = (flat // np.uint64(BINS)) % np.uint64(255) + np.uint64(1)  # the last one written, the smallest, stays
    return out


def may_link(n_a: np.ndarray, n_b: np.ndarray, bins_a: np.ndarray, bins_b: np.ndarray) -> np.ndarray:
    """Whether sets of n_a and n_b shingles can be links by their bins.

    A link's union has at most `union` members, of which the filled bins show one each, drawn without return. Those not shown hide
    no more than as many shared ones; for larger sets, chance keeps the shared ones shown within DEVIATIONS of their share.
    """
    share = PERCENT / 100
    shown, same = ((bins_a | bins_b) != 0).sum(-1), ((bins_a == bins_b) & (bins_a != 0)).sum(-1)
    union = (n_a + n_b) / (1 + share)
    least = share * shown - DEVIATIONS * np.sqrt(share * (1 - share) * shown * np.maximum(1 - shown / union, 0))
    return same + 1e-6 >= np.maximum(shown - (1 - share) * union, least)


def table_keys(rows: np.ndarray) -> np.ndarray:
    """64-bit keys of the HALVES * HALVES tables: half key i of the first collection with half key j of the second."""
    halves = np.zeros((len(rows), 2 * HALVES), np.uint64)
    for k in range(HASHES):
        halves = mixed(halves * POWER + rows[:, k::HASHES].astype(np.uint64) + np.uint64(1))
    number = np.arange(HALVES * HALVES, dtype=np.uint64).reshape(1, HALVES, HALVES)
    return mixed(halves[:, :HALVES, None] * PLACE[0] + halves[:, None, HALVES:] * PLACE[1] + number).reshape(len(rows), -1)


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, one, two (a 128-bit hash of the set), sketch, bins for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", most_bytes=1 << 20):
            sets = shingle_sets(texts_of(b, "text"), shingle)
            full = [i for i, s in enumerate(sets) if len(s)]
            found, bins = [None] * len(sets), [None] * len(sets)
            some = [sets[i] for i in full]
            for i, row, own in zip(full, sketches(some), binned(some)) if full else ():
                found[i], bins[i] = row.tobytes(), own.tobytes()
            one = np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            two = np.array([np.bitwise_xor.reduce(mixed(s + PLACE[0])) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two), pa.array(found, pa.binary()), pa.array(bins, pa.binary())], ["doc_id", "n_shingles", "one", "two", "sketch", "bins"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, one long, two long, sketch binary, bins binary")


def _sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SKETCH)


def _bin_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def keyed(classes: DataFrame) -> DataFrame:
    """key, place (the table's number), id for every class (id, sketch) and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                keys = table_keys(_sketch_rows(part.column("sketch")))
                n, tables = keys.shape
                ids = part.column("id").take(pa.array(np.repeat(np.arange(n), tables)))
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(tables, dtype=np.int8), n)), ids], ["key", "place", "id"])

    return classes.select("id", "sketch").mapInArrow(run, f"key long, place tinyint, id {dict(classes.dtypes)['id']}")


def bucket_members(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """key, place, id, size, pivot (the smallest id): the members of each bucket of two or more, once for all buckets with the same
    members. Sizes are counts of partial aggregation; the joins back can split a hot key."""
    rows = keyed(classes)
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    met = scratch.write(rows.join(shared, "key"), "met")
    alike = ("size", "pivot", "mark", "sign")
    marks = met.groupBy("key").agg(F.min("place").alias("place"), F.count("*").alias("size"), F.min("id").alias("pivot"), F.bit_xor(F.xxhash64("id")).alias("mark"), F.bit_xor(F.xxhash64("id", F.lit(SEED))).alias("sign"))
    first = marks.groupBy(*alike).agg(F.min_by("key", "place").alias("key")).select("key", "size", "pivot")
    members = scratch.write(met.join(first, "key"), "members")
    scratch.drop("met")
    return members


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes allow the threshold, whose sketches agree in LEAST_EQUAL minhashes and whose bins allow a link."""
    of = lambda c: classes.select(F.col("id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "sketch", "bins")))
    met = pairs.join(of("a"), "a").join(of("b"), "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT)
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = (_sketch_rows(b.column("sketch_a")) == _sketch_rows(b.column("sketch_b"))).sum(1) >= LEAST_EQUAL
            same &= may_link(*(b.column(c).to_numpy() for c in ("n_a", "n_b")), *(_bin_rows(b.column(c)) for c in ("bins_a", "bins_b")))
            yield pa.record_batch([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(same))

    return met.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b", "bins_a", "bins_b").mapInArrow(run, f"a {kind}, b {kind}")


def full_sets(ids: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """id, shingles (ascending) of the texts concerned, made again from docs."""
    texts = docs.select("doc_id", "text").join(few(ids.withColumnRenamed("id", "doc_id").distinct()), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", most_bytes=1 << 20):
            sets = [np.sort(s.view(np.int64)) for s in shingle_sets(texts_of(b, "text"), shingle)]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["id", "shingles"])

    return texts.mapInArrow(run, f"id {dict(docs.dtypes)['doc_id']}, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links by their full sets (id, shingles)."""
    of = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return met.filter(both * 100 >= (F.size("set_a") + F.size("set_b") - both) * PERCENT).select("a", "b").distinct()


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """id, component (the smallest id reachable) of every id in links (a, b), by alternating large-star and small-star rounds.

    Each round is two aggregations and two skew-splittable joins over as many edges as there are ids; its
    edges are written to the shared folder. A round that changes nothing ends it.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, before, k = scratch.write(edges, f"{label}-0"), None, 0
    while True:
        k += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = scratch.write(small, f"{label}-{k}")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        scratch.drop(f"{label}-{k - 1}")
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted batches as one table for each run of equal keys; only the run at a batch's end is held over."""
    rest = None
    for b in itertools.chain(batches, [None]):
        whole = pa.Table.from_batches([b]) if b is not None else None
        if rest is not None:
            whole = pa.concat_tables([rest, whole]).combine_chunks() if whole is not None else rest
        if whole is None or not whole.num_rows:
            continue
        marks = np.stack([whole.column(k).to_numpy() for k in keys])
        bounds = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), whole.num_rows]
        if b is not None:
            bounds.pop()
            rest = whole.slice(bounds[-1])
        for s, e in zip(bounds, bounds[1:]):
            yield whole.slice(s, e - s)


GROUP = ("key", "left", "right")


def open_members(members: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The members of buckets that hold several components, with sketches and bins, one row for each group (GROUP) that they take part in.

    outside tells a member that isn't of its bucket's largest component, asks one that meets the group's rows there, met one that is
    met. Outside members are dealt to blocks (left), all members to chunks (right), both of a bounded size.
    """
    known = scratch.write(members.filter("size > 2").drop("size", "pivot").join(nodes, "id"), "known")
    parts = known.groupBy("key", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("words"))
    per_key = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.sum("words").alias("words"), F.max(F.struct("rows", "component", "words")).alias("most"))
    blocks = lambda rows, words: F.greatest(F.ceil(rows / BLOCK), F.ceil(words / BLOCK_SHINGLES)).cast("int")
    per_key = per_key.filter("parts > 1").select("key", F.col("most.component").alias("largest"), blocks(F.col("rows") - F.col("most.rows"), F.col("words") - F.col("most.words")).alias("lefts"), blocks(F.col("rows"), F.col("words")).alias("rights"))
    dealt = known.join(per_key, "key").withColumns({"outside": F.col("component") != F.col("largest"), "own_left": F.pmod(F.xxhash64("id", F.lit(SEED)), "lefts").cast("int"), "own_right": F.pmod(F.xxhash64("id"), "rights").cast("int")})
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda left, right, asks, met: F.struct(left.alias("left"), right.alias("right"), asks.alias("asks"), F.lit(met).alias("met"))
    stays = F.transform(numbers("lefts"), lambda x: at(x, F.col("own_right"), F.col("outside") & (x == F.col("own_left")), True))
    goes = F.transform(F.filter(numbers("rights"), lambda x: F.col("outside") & (x != F.col("own_right"))), lambda x: at(F.col("own_left"), x, F.lit(True), False))
    return dealt.withColumn("at", F.explode(F.concat(stays, goes))).select("key", "at.left", "at.right", "at.asks", "at.met", "outside", "place", "id", "component", "n", "sketch", "bins")


def partners(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each asking row with the rows of its group, in order of ids, that may be links: of another component, near in size, alike in
    their sketches and bins, meeting in no earlier table. Two outside members meet where the smaller id asks."""
    column = lambda c: group.column(c).to_numpy()
    rows, bins, n, place = _sketch_rows(group.column("sketch")), _bin_rows(group.column("bins")), column("n"), group.column("place")[0].as_py()
    parts = group.column("component").combine_chunks().dictionary_encode()
    parts = (parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts).indices.to_numpy()
    asks, met, outside, at = column("asks"), column("met"), column("outside"), np.arange(group.num_rows)
    for i in np.flatnonzero(asks).tolist():
        other = np.flatnonzero(met & (parts != parts[i]) & (~outside | (at > i)) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * PERCENT))
        if len(other):
            equal = rows[other] == rows[i]
            enough = equal.sum(1) >= LEAST_EQUAL
            halves = equal[enough].reshape(-1, 2 * HALVES, HASHES).all(2)
            first = halves[:, :HALVES].argmax(1) * HALVES + halves[:, HALVES:].argmax(1)
            found = other[enough][first == place]
            found = found[may_link(n[found], n[i], bins[found], bins[i])]
            if len(found):
                yield i, found


def likely(members: DataFrame) -> DataFrame:
    """The rows of open_members that take part in a pair worth verifying."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, GROUP):
            kept = np.zeros(group.num_rows, bool)
            for i, found in partners(group):
                kept[found] = kept[i] = True
            if kept.any():
                yield from group.filter(pa.array(kept)).combine_chunks().to_batches()

    return members.repartition(*GROUP).sortWithinPartitions(*GROUP, "id").mapInArrow(run, members.schema)


def cross_links(members: DataFrame) -> DataFrame:
    """a, b: links between components, verified on full sets inside each group (the columns of open_members, and shingles).

    A group yields at most one link fewer than it has members: what joins nothing new is left out.
    """
    kind = dict(members.dtypes)["id"]

    def links(group: pa.Table) -> Iterator[tuple[int, int]]:
        column = group.column("shingles").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
        parts = group.column("component").to_pylist()
        roots = {c: c for c in parts}

        def root(c):
            while roots[c] != c:
                roots[c] = c = roots[roots[c]]
            return c

        for i, found in partners(group):
            found = [j for j in found.tolist() if root(parts[j]) != root(parts[i])]
            if not found:
                continue
            mine = flat[offsets[i] : offsets[i + 1]]
            sizes = np.array([offsets[j + 1] - offsets[j] for j in found])
            theirs = np.concatenate([flat[offsets[j] : offsets[j + 1]] for j in found])
            at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            both = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.concatenate([[0], sizes.cumsum()[:-1]]))
            for j in np.flatnonzero(both * 100 >= (len(mine) + sizes - both) * PERCENT).tolist():
                x, y = root(parts[i]), root(parts[found[j]])
                if x != y:
                    roots[max(x, y)] = min(x, y)
                    yield i, found[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, GROUP):
            got = list(links(group)) if group.num_rows > 1 else []
            if got:
                ids = group.column("id").combine_chunks()
                yield pa.record_batch([ids.take(pa.array([g[k] for g in got])) for k in (0, 1)], ["a", "b"])

    return members.repartition(*GROUP).sortWithinPartitions(*GROUP, "id").mapInArrow(run, f"a {kind}, b {kind}")


def own_links(linked: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: each doc_id that has several different sets with the classes that these fall in."""
    several = linked.groupBy("doc_id").agg(F.min("one").alias("low"), F.max("one").alias("high")).filter("low <> high").select("doc_id")
    sets = linked.join(several, "doc_id", "left_semi").select("doc_id", "one", "two").distinct()
    return sets.join(classes, ["one", "two"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b")).filter("a <> b")


def near_duplicates(docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text), by sets of `shingle`-word shingles."""
    docs = docs.select("doc_id", "text")
    signed = scratch.write(signatures(docs, shingle), "signatures")
    linked = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = linked.groupBy("one", "two").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bins").alias("bins"))
    classes = scratch.write(classes, "classes")
    members = bucket_members(classes, scratch)
    stars = members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    stars = scratch.write(plausible(stars, classes), "star-pairs")
    sets = scratch.write(full_sets(stars.select(F.col("a").alias("id")).union(stars.select("b")), docs, shingle), "star-sets")
    links = scratch.write(verified(stars, sets).unionByName(own_links(linked, classes)), "star-links")
    parts = components(links, scratch, "star-parts")
    nodes = classes.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "n", "sketch", "bins")
    rest = scratch.write(likely(open_members(members, nodes, scratch)), "open")
    sets = scratch.write(full_sets(rest.select("id"), docs, shingle), "cross-sets")
    links = scratch.write(links.unionByName(cross_links(rest.join(sets, "id"))), "links")
    parts = components(links, scratch, "parts")
    for label in ("members", "star-pairs", "star-sets", "star-links", "known", "open", "cross-sets"):
        scratch.drop(label)  # the links are written and need them no more
    reached = classes.join(parts, "id", "left").select("one", "two", F.coalesce("component", "id").alias("component"))
    found = signed.withColumn("joins", (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).join(reached.withColumn("joins", F.lit(True)), ["one", "two", "joins"], "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op5"), shingle=4)


QUERIES = {"op5_near_duplicates": op5_near_duplicates}
#: Exact pairs by a join on shingles, and components by a closure over links: for small tables.
ORACLES = {
    "op5_near_duplicates": """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select doc_id, unnest(list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] end)) as g from w),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from g a join g b using (g) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
r as (select doc_id as id, doc_id as root from documents union select links.b, r.root from r join links on links.a = r.id)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.root) as component_id, d.doc_id = min(r.root) as kept from documents d join r on r.id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id"""
}
