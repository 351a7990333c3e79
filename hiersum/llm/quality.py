"""Quality classifier: an additive model with pairwise interactions.

score = sigmoid(intercept + sum of one lookup per feature + sum of one 2-d
lookup per chosen pair).  The lookups are learnt by cyclic boosting: each round
visits every feature in turn, fits one shallow tree of that feature alone to
the gradient, and adds it at a small rate to the feature's table.  Pairs are
ranked by how much of the residual a four-cell split of both explains, and the
best few are boosted in the same way.  Scoring is binning and addition.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows that the model is fitted on, at most.
SAMPLE = 12_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST = 32, 8, 8, 150, 60, 0.1, 3, 20

FEATURES = (
    "log_chars", "log_words", "word_length", "upper_share", "digit_share", "space_share", "other_ascii_share", "high_byte_share",
    "punctuation_share", "symbol_share", "exclaim_share", "pipe_share", "distinct_words", "distinct_lines", "line_words", "top_word_share", "top_pair_share", "odd_word_ends", "one_letter_words", "log_longest_word", "plain_word_share", "last_half_distinct",
)

_CLASS = np.full(256, 9, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\f\v", b".,;:'\"()-?", b"#$%&*@^~<>{}[]\\/=+_`", b"!", b"|")):
    _CLASS[list(_chars)] = _k
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 7
_CLASS[128:] = 8


def features(text: str | None) -> np.ndarray:
    """The numbers that a score depends on, from the whole text alone.  Null and empty: all zero."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(_CLASS[data], minlength=10) / len(data)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(len(words), 1)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs: dict[tuple[str, str], int] = {}
    for p in itertools.pairwise(words):
        pairs[p] = pairs.get(p, 0) + 1
    half = words[len(words) // 2 :]
    out[:] = (
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / n, kinds[0], kinds[1], kinds[2], kinds[9], kinds[8],
        kinds[3], kinds[4], kinds[5], kinds[6], len(counts) / n, len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), max(counts.values(), default=0) / n, max(pairs.values(), default=0) / n,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in words) / n, sum(len(w) == 1 for w in words) / n, np.log1p(max(map(len, words), default=0)), sum(w.isalpha() for w in words) / n, len(set(half)) / max(len(half), 1),
    )
    return out


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, lookup) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += lookup[np.searchsorted(edges, x[:, j], "right")]
        coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]
        for (a, b), lookup in zip(self.pairs, self.pair_tables, strict=True):
            total += lookup[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of about equally full bins."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def shallow_tree(grad: np.ndarray, hess: np.ndarray, count: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Greedy splits of one feature's bins; a Newton step for each leaf."""
    g, h, c = (np.concatenate([[0], np.cumsum(v)]) for v in (grad, hess, count))
    value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for part in parts:
            a, b = part
            at = np.arange(a + 1, b)
            at = at[(c[at] - c[a] >= LEAST) & (c[b] - c[at] >= LEAST)]
            if len(at):
                gain = value(a, at) + value(at, b) - value(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), part, int(at[gain.argmax()]))
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def four_cells(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut of both axes into four cells: what it gains, and the cells' Newton steps."""
    def corner(v: np.ndarray) -> np.ndarray:
        return np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    g, h = corner(grad), corner(hess)
    n, m = grad.shape
    best = (0.0, np.zeros_like(grad))
    for i in range(1, n):
        for j in range(1, m):
            cells = [(0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m)]
            sums = [(g[b, d] - g[a, d] - g[b, c] + g[a, c], h[b, d] - h[a, d] - h[b, c] + h[a, c]) for a, b, c, d in cells]
            gain = sum(x * x / (y + 1.0) for x, y in sums)
            if gain > best[0]:
                step = np.zeros_like(grad)
                for (a, b, c, d), (x, y) in zip(cells, sums, strict=True):
                    step[a:b, c:d] = x / (y + 1.0)
                best = (gain, step)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on a matrix of features and 0/1 labels.  No rows, or one label only: a constant."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    model = Model(float(np.log(share / (1 - share))))
    if len(y) < 2 * LEAST or len(set(y.tolist())) < 2:
        return model
    model.edges = [cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model.pair_edges = [cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    fine = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)
    residual = lambda: (y - (p := 1 / (1 + np.exp(-total))), p * (1 - p))
    for _ in range(ROUNDS):
        for j, bins in enumerate(fine):
            g, h = residual()
            n = len(model.tables[j])
            step = RATE * shallow_tree(np.bincount(bins, g, n), np.bincount(bins, h, n), np.bincount(bins, minlength=n))
            model.tables[j] += step
            total += step[bins]
    g, h = residual()

    def grid(v: np.ndarray, a: int, b: int) -> np.ndarray:
        n, m = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
        return np.bincount(coarse[a] * m + coarse[b], v, n * m).reshape(n, m)

    ranked = sorted(((four_cells(grid(g, a, b), grid(h, a, b))[0], (a, b)) for a, b in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [p for gain, p in ranked[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h = residual()
            step = RATE * four_cells(grid(g, a, b), grid(h, a, b))[1]
            model.pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return model


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["quality", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fit on at most ``most`` labelled documents, taken by a hash of doc_id.

    The sample of label rows is bounded, so it is broadcast to the documents.
    Rows without a label or doc_id do not count; a doc_id labelled more than
    once counts once, with its largest label, and one that several documents
    share counts with the smallest of their texts.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(most)
    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = held.groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"), F.min("text").alias("text")).select("quality", "text")
    got = rows.mapInArrow(_feature_batches, "quality double, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist() or np.zeros((0, len(FEATURES))))
    y = np.array(got.column("quality").to_pylist())
    order = np.lexsort([*x.T, y]) if len(y) else slice(0)
    return fit(x[order], y[order])


SCHEMA = "doc_id bigint, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the probability that quality is 1, one row per row of ``docs`` (doc_id, text).

    Whole texts, no shuffle.  Null and empty texts are scored by the all-zero
    features.  Repeated rows repeat; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    return docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)]).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(shared.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
