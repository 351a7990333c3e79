"""Language identification by error-correcting output codes.

Every language has a codeword.  One binary classifier per bit, a logistic
regression over hashed byte n-grams, predicts that bit.  A text gets the
language whose codeword has the smallest loss, each bit weighted by how well
its classifier did in training; the share of the best codeword is the score,
and a small lead over the second flags the text as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint

UNKNOWN = "und"
BUCKETS = 4096
#: Texts of each language that are learnt from, at most about; and in all, at most (beyond that many languages: one of each).
SAMPLE_PER_LANGUAGE, SAMPLE = 700, 6000
BROADCAST_LANGUAGES = 100_000
#: Distances of codewords are looked at in so many random codes, or in fewer for many languages.
CODES, MANY = 200, 64
AMBIGUOUS_LEAD = 0.1


def ngram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Unit vector of square-rooted counts of hashed byte 2- and 3-grams, digits and case folded away."""
    data = np.frombuffer((" " + re.sub(r"[\W\d_]+", " ", text.lower()) + " ").encode(), np.uint8).astype(np.uint32)
    counts = np.zeros(buckets, np.float32)
    if len(data) > 2:
        two = data[:-1] * np.uint32(257) + data[1:]
        three = two[:-1] * np.uint32(263) + data[2:]
        for grams, salt in ((two, 2654435761), (three, 2246822519)):
            counts += np.bincount((grams * np.uint32(salt)) >> np.uint32(20), minlength=buckets).astype(np.float32)[:buckets]
    counts = np.sqrt(counts)
    norm = np.linalg.norm(counts)
    return counts / norm if norm else counts


def codewords(n: int, bits: int = 31, seed: int = 5) -> np.ndarray:
    """n codewords of +-1: the exhaustive code where it is short, else the best spread of some random codes."""
    if n < 2:
        return np.ones((n, 1))
    if 2 ** (n - 1) - 1 <= bits:
        # bit j of language i > 0 follows the binary digits of j; language 0 is all ones
        columns = np.arange(2 ** (n - 1) - 1)
        rows = [np.ones(len(columns))] + [np.where((columns >> (n - 2 - i)) & 1, 1.0, -1.0) for i in range(n - 1)]
        return np.array(rows)
    rng, best, length = np.random.default_rng(seed), None, bits if n <= MANY else max(bits, 10 * int(np.ceil(np.log2(n))))
    for _ in range(CODES if n <= MANY else max(3, CODES * MANY // n)):
        code = rng.choice([-1.0, 1.0], (n, length))
        alike = code @ code.T
        np.fill_diagonal(alike, -length)
        apart = int((length - alike.max()) / 2)
        if not (np.abs(code.sum(0)) == n).any() and (best is None or apart > best[0]):
            best = (apart, code)
    if best is None or best[0] == 0:  # two languages with one word: longer words
        return codewords(n, length + 8, seed + 1)
    return best[1]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # n-gram bucket x bit
    bias: np.ndarray
    bit_weight: np.ndarray

    def score(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share, and whether the second is close."""
        margin = vectors @ self.weights + self.bias
        loss = np.stack([(self.bit_weight * np.logaddexp(0, -margin * word)).sum(1) for word in self.code], 1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        order = np.sort(share, 1)
        lead = order[:, -1] - order[:, -2] if share.shape[1] > 1 else np.ones(len(share))
        return share.argmax(1), share.max(1), lead < AMBIGUOUS_LEAD


def fit(vectors: np.ndarray, labels: list[str], bits: int = 31, steps: int = 150) -> Model | None:
    """Full-batch logistic regressions, one per bit, by Nesterov steps; None without labels."""
    languages = sorted(set(labels))
    if not languages:
        return None
    code = codewords(len(languages), bits)
    rows = np.array([languages.index(x) for x in labels])
    y = code[rows].astype(np.float32)
    weight = (1.0 / np.bincount(rows)[rows]).astype(np.float32)
    weight /= weight.sum()
    w, b = np.zeros((vectors.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    v, c, rate, l2 = w.copy(), b.copy(), 20.0, 1e-5
    for k in range(steps):
        g = -y / (1 + np.exp(np.clip(y * (vectors @ v + c), -30, 30))) * weight[:, None]
        w1, b1 = v - rate * (vectors.T @ g + l2 * v), c - rate * 0.1 * g.sum(0)
        pull = k / (k + 3)
        v, c, w, b = w1 + pull * (w1 - w), b1 + pull * (b1 - b), w1, b1
    right = ((vectors @ w + b) * y > 0).T @ weight
    return Model(languages, code, w, b, np.maximum(np.log((right + 0.01) / (1.01 - right)), 0.05))


def sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, most: int = SAMPLE) -> DataFrame:
    """A bounded sample (text, lang) with every language in it, chosen by a hash of doc_id and text.  Other columns are ignored.

    Languages share ``most`` evenly; where the draw exceeds it, the most
    frequent language gives way.
    """
    known = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = checkpoint(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64(F.lit(11), "doc_id", "text")).alias("first")))
    n_languages = sizes.count()
    share = max(1, min(per_language, most // max(1, n_languages)))
    sizes = F.broadcast(sizes) if n_languages <= BROADCAST_LANGUAGES else sizes  # else the texts would be dealt by language
    drawn = F.xxhash64(F.lit(11), "doc_id", "text")
    chance = F.pmod(drawn, F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(sizes, "lang").where((chance * F.col("n") < share) | (drawn == F.col("first")))
    return chosen.select("text", "lang", "n", (drawn != F.col("first")).alias("more")).orderBy("more", "n", F.xxhash64("text"), "lang").limit(max(most, n_languages)).select("text", "lang")


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, most: int = SAMPLE) -> Model | None:
    """Learn from the rows of ``docs`` (doc_id, text, lang) with a language.  Vectors are made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for text in batch.column(0):
                vector = ngram_counts(text.as_py())
                at = np.flatnonzero(vector).astype(np.uint16)
                packed.append(at.tobytes() + vector[at].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(packed, pa.binary())], names=["lang", "packed"])

    rows = sample(docs, per_language, most).mapInArrow(run, "lang string, packed binary").collect()
    vectors = np.zeros((len(rows), BUCKETS), np.float32)
    for i, row in enumerate(rows):
        n = len(row["packed"]) // 6
        vectors[i, np.frombuffer(row["packed"], np.uint16, n)] = np.frombuffer(row["packed"], np.float32, n, 2 * n)
    return fit(vectors, [row["lang"] for row in rows])


SCHEMA = "doc_id bigint, lang_pred string, score double, ambiguous boolean"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), over whole texts, without a shuffle.

    A null or empty text and one without a letter are ``und`` with score 0, as
    is everything under no model.  Repeated rows repeat; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                part = [texts[i].as_py() or "" for i in range(at, min(at + 256, len(ids)))]
                lang, score, doubt = [UNKNOWN] * len(part), np.zeros(len(part)), np.zeros(len(part), bool)
                some = [i for i, t in enumerate(part) if has_letter(t)] if model else []
                if some:
                    best, share, close = model.score(np.stack([ngram_counts(part[i]) for i in some]))
                    for i, k, s, c in zip(some, best, share, close, strict=True):
                        lang[i], score[i], doubt[i] = model.languages[k], s, c
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 256], pa.int64()), pa.array(lang, pa.string()), pa.array(score), pa.array(doubt)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, SCHEMA)
