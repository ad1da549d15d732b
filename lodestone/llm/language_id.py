"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One logistic classifier per bit reads hashed character
n-grams; the language whose codeword has the least logistic loss against the classifiers' margins
wins, and a small gap to the runner-up flags ambiguity.

The classifiers learn from a bounded sample: about PER_LANGUAGE documents of each language, chosen
by a hash of doc_id, and 2 * LARGEST rows in all, the first by another hash. Everything else reads every row and every whole text.

Edge cases: a text that is null or has no letter is `und` with score 0; so is every text if nothing
can be learned. Languages at the same loss go to the first by name. A very long text is counted whole, alone, in memory
that follows its length. A single learned language is always predicted, with score 1. Repeated rows get equal
results, an empty table no rows; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, slices, table, unit_hash

BUCKETS, LENGTHS = 1 << 12, (1, 2, 3)
PER_LANGUAGE, LARGEST, SEED = 1_000, 8_000, 907
EXHAUSTIVE, LONG_CODE, STEPS, RATE, DECAY, AMBIGUOUS = 5, 15, 100, 0.3, 1e-5, 1.0
LETTER = regex.compile(r"\p{L}")


def gram_features(texts: list[str]) -> np.ndarray:
    """Square roots of hashed n-gram frequencies, one row of unit length per text."""
    padded = [f" {t.lower()}  " for t in texts]
    ends = np.cumsum([len(t) for t in padded])
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.concatenate([codes, np.full(max(LENGTHS), 32, np.uint32)])
    n, grams, mixed = len(codes) - max(LENGTHS), [], np.zeros(len(codes) - max(LENGTHS), np.uint32)
    for length in range(1, max(LENGTHS) + 1):
        mixed = (mixed * np.uint32(0x01000193)) ^ (codes[length - 1 : length - 1 + n] * np.uint32(0x9E3779B1))
        if length in LENGTHS:
            h = mixed + np.uint32(length * 0x85EBCA6B & 0xFFFFFFFF)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            grams.append(((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int32))
    out, start = np.empty((len(texts), BUCKETS), np.float32), 0
    for i, end in enumerate(ends):
        last = end - max(LENGTHS) + 1  # no gram starts in the padding, whose grams would reach the next text
        out[i] = np.sqrt(sum(np.bincount(g[start:last], minlength=BUCKETS) for g in grams) / ((last - start) * len(grams)))
        start = end
    return out


def codebook(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of n classes: all splits of few classes, else the best spread of seeded draws."""
    if n <= EXHAUSTIVE:
        splits = [[1 if (s >> i) & 1 else -1 for i in range(n)] for s in range(1, 1 << (n - 1))]
        return np.array(splits, np.float32).T.reshape(n, len(splits))
    rng, bits = np.random.default_rng(SEED), max(LONG_CODE, 4 * int(np.ceil(np.log2(n))))
    best, spread = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if (least := apart.min() + 0.01 * apart.mean()) > spread and (np.abs(code.sum(0)) < n).all():
            best, spread = code, least
    return best


@dataclass
class OutputCodes:
    langs: list[str] = field(default_factory=list)
    code: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> OutputCodes:
        """Logistic loss on every bit at once, each language weighing the same; Adam over the whole sample."""
        if len(self.langs) < 2:
            return self
        self.code = codebook(len(self.langs))
        signs = self.code[y]
        share = 1.0 / (np.bincount(y, minlength=len(self.langs))[y] * len(self.langs))
        share = share.astype(np.float32)[:, None]
        w, b = np.zeros((x.shape[1], signs.shape[1]), np.float32), np.zeros(signs.shape[1], np.float32)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, b)]
        for step in range(1, STEPS + 1):
            g = -signs * share / (1 + np.exp(np.clip(signs * (x @ w + b), -30, 30)))
            for p, grad, (m, v) in zip((w, b), (x.T @ g + DECAY * w, g.sum(0)), state):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights, self.bias = w, b
        return self

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of texts that have letters."""
        if len(self.langs) < 2:
            return [*(self.langs or ["und"])] * len(texts), np.full(len(texts), float(len(self.langs))), np.zeros(len(texts), bool)
        margins = gram_features(texts) @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :].astype(np.float64) * self.code[None]).sum(2)
        two = np.partition(loss, 1, axis=1)[:, :2]
        p = np.exp(two[:, :1] - loss)
        return [self.langs[i] for i in loss.argmin(1)], 1 / p.sum(1), two[:, 1] - two[:, 0] < AMBIGUOUS


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, largest: int = LARGEST) -> OutputCodes:
    """Fit on the learning folds of docs (doc_id, text, lang): per-language counts first, then a hash-chosen sample."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    model = OutputCodes(sorted(counts))
    if len(counts) < 2:
        return model
    each = min(per_language, max(1, largest // len(counts)))
    rate = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = gram_features(b.column("text").to_pylist()).astype(np.float16)
            yield pa.record_batch([b.column("at"), b.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["at", "lang", "x"])

    picked = rows.filter(unit_hash(F.col("doc_id"), SEED) < rate[F.col("lang")]).select(F.xxhash64("doc_id", F.lit(SEED + 1), "text").alias("at"), "lang", "text")
    got = picked.mapInArrow(features, "at long, lang string, x binary").orderBy("at", "lang").limit(2 * largest).toArrow()
    if not got.num_rows:
        return OutputCodes()
    langs = got.column("lang").to_pylist()
    model.langs = sorted(set(langs))
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(len(langs), BUCKETS)
    return model.fit(x.astype(np.float32), np.array([model.langs.index(v) for v in langs]))


def identify(docs: DataFrame, model: OutputCodes) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", most_bytes=1 << 20, most_rows=256):
            texts = b.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
            langs, scores, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if known:
                found, p, doubt = model.predict([texts[i] for i in known])
                scores[known], unsure[known] = p, doubt
                for i, lang in zip(known, found):
                    langs[i] = lang
            yield pa.record_batch([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
