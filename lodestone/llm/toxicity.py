"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier over hashed words and word prefixes learns from confirmed toxic documents
and from documents without a label. Its risk is the class-prior-corrected estimate
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)); where the second part falls
below zero, the step climbs back instead (the non-negative correction). The prior is the share of
toxic documents among the learning folds' labels.

Only features whose shares differ clearly between the two sides take part, so that rare words of the
positives aren't learned by heart. The classifier learns from a bounded sample of about POSITIVES and UNLABELLED documents, chosen by a
hash of doc_id; every row and every whole text is scored.

Edge cases: null and empty texts get the score of a text without words; without a confirmed toxic
or an unlabelled document to learn from, every score is 0; a document with several labels is toxic if
one says so; repeated rows score alike; an empty table gives no rows; columns other than doc_id and
text (and doc_id and toxic of the labels) are ignored; a null label is none; documents are chosen by id before any text is read, and a
very long text is one document like the others, counted whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, few, held_out, slices, table, texts_of, unit_hash

POSITIVES, UNLABELLED, SEED = 2_500, 7_500, 411
BUCKETS, PREFIXES, PAD_WORDS, SCALE = 1 << 17, (4, 5, 6, 7), 8, 100.0
STEPS, RATE, DECAY, LEAST_Z, LEAST_SHARE, CACHED_WORDS = 120, 0.1, 1e-5, 4.0, 0.01, 80_000
TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def word_features(word: str) -> list[int]:
    """Buckets of the word and of its prefixes."""
    keys = [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for k in keys]


def telling(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Buckets in at least LEAST_SHARE of one side's documents whose shares p and u differ by LEAST_Z standard errors; else rare words are learned by heart."""
    both = (p * n_p + u * n_u) / (n_p + n_u)
    z = np.abs(p - u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-12)
    return (z >= LEAST_Z) & (np.maximum(p, u) >= LEAST_SHARE)


def risk_and_slopes(f: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """Of logistic loss on margins f: the positives' part of the risk, the corrected unlabelled part, and the direction to descend by.

    Where the second part is below zero, which no true risk can be, the direction climbs back on it alone.
    """
    n_p, n_u = positive.sum(), (~positive).sum()
    p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    plus, minus = np.logaddexp(0, -f), np.logaddexp(0, f)
    negative = minus[~positive].mean() - prior * minus[positive].mean()
    down = np.where(positive, -prior * p / n_p, p / n_u)
    return prior * plus[positive].mean(), negative, down + np.where(positive, -prior * (1 - p) / n_p, 0) if negative >= 0 else -down


def words_of(text: str) -> Counter:
    return Counter(TOKEN.findall(text.lower()))


@dataclass
class PositiveUnlabelled:
    weights: np.ndarray | None = None
    bias: float = 0.0
    cache: dict = field(default_factory=dict)
    older: dict = field(default_factory=dict)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], positive: np.ndarray, prior: float, told: np.ndarray | None = None) -> PositiveUnlabelled:
        """rows: each document's buckets and values; told: the buckets that take part, found from the rows if not given. Adam over the whole sample."""
        index = np.concatenate([r[0] for r in rows]).astype(np.int32)
        value = np.concatenate([r[1] for r in rows]).astype(np.float32)
        lengths = np.array([len(r[0]) for r in rows])
        of = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
        n_p, n_u = positive.sum(), (~positive).sum()
        if told is None:
            shares = [np.bincount(index[side], minlength=BUCKETS) / n for side, n in ((positive[of], n_p), (~positive[of], n_u))]
            told = telling(*shares, n_p, n_u)
        index, value, of = index[told[index]], value[told[index]], of[told[index]]
        w, b = np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
        m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
        for step in range(1, STEPS + 1):
            f = np.bincount(of, weights=value * w[index], minlength=len(rows)) + b
            _, _, g = risk_and_slopes(f, positive, prior)
            grad = np.bincount(index, weights=value * g[of], minlength=BUCKETS) + DECAY * w
            gb = g.sum()
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            mb += 0.1 * (gb - mb)
            vb += 0.01 * (gb * gb - vb)
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
            b -= RATE * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-9)
        self.weights, self.bias = w.astype(np.float32), b
        return self

    def score(self, text: str) -> float:
        if self.weights is None:
            return 0.0
        words, cache, total = words_of(text), self.cache, 0.0
        for word, n in words.items():
            s = cache.get(word)
            if s is None:
                s = self.older.get(word)
                if s is None:
                    s = float(self.weights[word_features(word)].sum())
                if len(cache) >= CACHED_WORDS:  # two generations, so that frequent words outlive a full cache
                    self.older = cache
                    cache = self.cache = {}
                cache[word] = s
            total += n * s
        f = self.bias + SCALE * total / (sum(words.values()) + PAD_WORDS)
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, f)))))


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and the share of words that each stands for, scaled."""
    words = words_of(text)
    found: Counter = Counter()
    for word, n in words.items():
        for k in word_features(word):
            found[k] += n
    scale = SCALE / (sum(words.values()) + PAD_WORDS)
    return np.fromiter(found.keys(), np.int32, len(found)), np.fromiter(found.values(), np.float32, len(found)) * np.float32(scale)


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> PositiveUnlabelled:
    """Fit on the learning folds. One pass over the texts writes the sample's features; how many documents of either side have a
    bucket is summed next to them, and only telling buckets reach the driver."""
    learning = ~held_out(F.col("doc_id"))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learning).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    rest = docs.filter(learning).count() - n
    if not toxic or docs.isEmpty():
        return PositiveUnlabelled()
    prior = min(0.9, toxic / n)
    rate_p, rate_u = positives / toxic, unlabelled / max(1, rest)
    u = unit_hash(F.col("doc_id"), SEED)
    sure = known.filter((F.col("toxic") == 1) & (u < rate_p)).select("doc_id", F.lit(True).alias("positive"))
    open_ = docs.select("doc_id").filter(learning & F.col("doc_id").isNotNull() & (u < rate_u)).distinct().join(known, "doc_id", "left_anti")
    chosen = scratch.write(sure.unionByName(open_.withColumn("positive", F.lit(False))), "chosen")
    picked = docs.select("doc_id", "text").join(few(chosen), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", most_bytes=1 << 20):
            x = [document_features(t) for t in texts_of(b, "text")]
            columns = [pa.array([r[i].tobytes() for r in x], pa.binary()) for i in (0, 1)]
            yield pa.record_batch([b.column("doc_id"), b.column("positive"), *columns], ["doc_id", "positive", "buckets", "shares"])

    kind = dict(docs.dtypes)["doc_id"]
    sample = picked.select("doc_id", "text", "positive")
    sample = scratch.write(sample.mapInArrow(features, f"doc_id {kind}, positive boolean, buckets binary, shares binary"), "sample")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros((2, BUCKETS), np.int32), np.zeros(2, np.int64)
        for b in batches:
            for positive, buckets in zip(b.column("positive").to_pylist(), b.column("buckets").to_pylist()):
                seen[int(positive), np.frombuffer(buckets, np.int32)] += 1
                rows[int(positive)] += 1
        yield pa.record_batch([pa.array([int(rows[0])]), pa.array([int(rows[1])]), pa.array([seen.tobytes()], pa.binary())], ["unlabelled", "positives", "seen"])

    parts = sample.select("positive", "buckets").coalesce(16).mapInArrow(counts, "unlabelled long, positives long, seen binary").toArrow()
    n_u, n_p = (sum(parts.column(c).to_pylist()) for c in ("unlabelled", "positives"))
    if not n_u or not n_p:
        return PositiveUnlabelled()
    seen = sum(np.frombuffer(x, np.int32).reshape(2, BUCKETS).astype(np.int64) for x in parts.column("seen").to_pylist())
    told = telling(seen[1] / n_p, seen[0] / n_u, n_p, n_u)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(np.frombuffer(x, np.int32), np.frombuffer(y, np.float32)) for x, y in zip(b.column("buckets").to_pylist(), b.column("shares").to_pylist())]
            yield pa.record_batch([b.column("positive"), *(pa.array([r[i][told[r[0]]].tobytes() for r in rows], pa.binary()) for i in (0, 1))], ["positive", "buckets", "shares"])

    ordered = sample.orderBy(unit_hash(F.col("doc_id"), SEED + 1), "doc_id").limit(2 * (positives + unlabelled)).select("positive", "buckets", "shares")
    got = ordered.mapInArrow(kept, "positive boolean, buckets binary, shares binary").toArrow()
    rows = [(np.frombuffer(x, np.int32), np.frombuffer(y, np.float32)) for x, y in zip(got.column("buckets").to_pylist(), got.column("shares").to_pylist())]
    return PositiveUnlabelled().fit(rows, np.array(got.column("positive").to_pylist(), bool), prior, told)


def score(docs: DataFrame, model: PositiveUnlabelled, name: str = "toxicity") -> DataFrame:
    """docs, which have text, with a new column of scores."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            scores = pa.array([model.score(t) for t in texts_of(b, "text")], pa.float64())
            yield pa.record_batch([*(b.column(c) for c in names), scores], [*names, name])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)
    return docs.mapInArrow(run, f"{kinds}, `{name}` double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), Scratch(spark, "op2"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
