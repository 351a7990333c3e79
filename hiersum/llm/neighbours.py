"""Approximate nearest neighbours through learned partitions.

A bounded sample of vectors gets its exact neighbour graph.  The graph is cut
into equal parts: recursive halving along the main direction of spread, then
sweeps that swap vertices across parts where more of their neighbours are on
the other side, which keeps the balance.  A small softmax classifier learns
part from vector.  Every row is filed under its most probable part; a query
goes to its several most probable parts, and all rows filed there are ranked
by their exact distance.  It goes on to further parts while those that are left
hold more than a certain probability, which is measured for a target recall on
sampled vectors that the classifier has not seen.  Queries that find fewer than
k rows search all parts.

The number of parts follows the square root of the number of rows.  Where one
classifier would be too wide, each of its parts is cut again from a sample of
its own, on the executors.  Parts are filed in blocks of bounded size, so a part
that holds a third of all rows is many tasks, each with the queries routed to it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint

#: Vectors that a classifier is learnt from, at most (below the first level: about).
SAMPLE = 8_192
GRAPH_K, SWEEPS, STEPS = 10, 12, 150
#: Parts of one classifier, at most; one sampled vector in so many is held back to measure recall.
WIDE, HELD_BACK = 128, 5
#: Share of the sample graph's edges that the probed parts must hold.
RECALL = 0.98
#: Rows of a part in one block, about; queries in one block, about.
ROW_BLOCK, QUERY_BLOCK = 4_096, 4_096
VECTORS = "vec_id bigint, vec array<double>"


@dataclass
class Router:
    """One classifier: logarithms of the parts' probabilities."""

    weights: np.ndarray  # dimension x part
    bias: np.ndarray
    mean: np.ndarray
    scale: float

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            s = np.nan_to_num(np.nan_to_num((x - self.mean) / self.scale, posinf=1e300, neginf=-1e300) @ self.weights + self.bias)
        s = np.maximum(s - s.max(1, keepdims=True), -1e300)
        return s - np.log(np.exp(s).sum(1, keepdims=True))


@dataclass
class Partition:
    """A classifier, and those of its parts that are cut again."""

    top: Router
    below: dict[int, Router] = field(default_factory=dict)
    #: A query goes on while the parts that are left hold more than this.
    rest: float = 0.0

    @property
    def first(self) -> np.ndarray:
        """Number of the first leaf of each part; the last entry is the number of leaves."""
        return np.cumsum([0, *(len(self.below[p].bias) if p in self.below else 1 for p in range(len(self.top.bias)))])

    @property
    def size(self) -> int:
        return int(self.first[-1])

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        """Of all leaves: n x size."""
        top = self.top.log_shares(x)
        return np.concatenate([top[:, [p]] + (self.below[p].log_shares(x) if p in self.below else 0) for p in range(top.shape[1])], 1) if self.below else top

    def filed(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the most probable one of the most probable part."""
        part = self.top.log_shares(x).argmax(1)
        out = self.first[part]
        for p in np.unique(part):
            if int(p) in self.below:
                out[part == p] += self.below[int(p)].log_shares(x[part == p]).argmax(1)
        return out

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves of each vector, best first, and the probability of each and all that follow."""
        shares = self.log_shares(x)
        order = np.argsort(-shares, 1, kind="stable")
        held = np.exp(np.take_along_axis(shares, order, 1))
        return order, np.cumsum(held[:, ::-1], 1)[:, ::-1]

    def probed(self, x: np.ndarray, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a query searches: its first ``n``, or as many as ``rest`` says."""
        rows, leaves = [], []
        for at in range(0, len(x), 64):
            order, left = self.ranked(x[at : at + 64])
            go = np.arange(order.shape[1])[None] < n if n is not None else left >= self.rest
            i, j = np.nonzero(np.broadcast_to(go, order.shape))
            rows.append(i + at)
            leaves.append(order[i, j])
        return np.concatenate(rows), np.concatenate(leaves)


def graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """Exact k nearest rows of each row."""
    k = min(k, len(x) - 1)
    square, out = (x * x).sum(1), np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        d = square[None] - 2 * x[at : at + 1024] @ x.T
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out[at : at + 1024] = np.argpartition(d, k - 1, 1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, n_parts: int) -> np.ndarray:
    """Equal parts that cut few edges of the neighbour graph."""
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, n_parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            part[rows] = first
            continue
        y = x[rows] - x[rows].mean(0)
        axis = np.linalg.eigh(y.T @ y)[1][:, -1]
        order, left = np.argsort(y @ axis, kind="stable"), n // 2
        cut = len(rows) * left // n
        todo += [(rows[order[:cut]], first, left), (rows[order[cut:]], first + left, n - left)]
    pairs = np.concatenate([np.stack([np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()], 1), np.stack([near.ravel(), np.repeat(np.arange(len(x)), near.shape[1])], 1)])
    for _ in range(SWEEPS):
        votes = np.zeros((len(x), n_parts), np.float32)
        np.add.at(votes, (pairs[:, 0], part[pairs[:, 1]]), 1)
        own = votes[np.arange(len(x)), part]
        want, gain = votes.argmax(1), votes.max(1) - own
        moved = 0
        movers = np.flatnonzero(gain > 0)
        waiting: dict[tuple[int, int], list[int]] = {}
        for v in movers[np.argsort(-gain[movers], kind="stable")]:
            a, b = int(part[v]), int(want[v])
            back = waiting.get((b, a))
            if back:  # one wants to go the other way: both move, sizes stay
                u = back.pop(0)
                part[v], part[u] = b, a
                moved += 2
            else:
                waiting.setdefault((a, b), []).append(int(v))
        if not moved:
            break
    return part


def learn(x: np.ndarray, n_parts: int) -> Router:
    """Cut a sample's graph and fit the classifier."""
    dim = x.shape[1] if x.ndim == 2 else 0
    mean = x.mean(0) if len(x) else np.zeros(dim)
    scale = float(np.sqrt(((x - mean) ** 2).mean())) if len(x) else 1.0
    scale = scale if np.isfinite(scale) and scale > 0 else 1.0
    n_parts = max(1, min(n_parts, len(x) // (2 * GRAPH_K)))
    w, b = np.zeros((dim, n_parts)), np.zeros(n_parts)
    if n_parts > 1:
        z = (x - mean) / scale
        part = balanced_parts(z, graph(z), n_parts)
        hot = np.zeros((len(z), n_parts))
        hot[np.arange(len(z)), part] = 1
        mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
        for t in range(1, STEPS + 1):
            s = z @ w + b
            p = np.exp(s - s.max(1, keepdims=True))
            p = (p / p.sum(1, keepdims=True) - hot) / len(z)
            for v, m, q, g in ((w, mw, vw, z.T @ p + 1e-5 * w), (b, mb, vb, p.sum(0))):
                m += 0.1 * (g - m)
                q += 0.01 * (g * g - q)
                v -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.99**t)) + 1e-8)
    return Router(w, b, mean, scale)


def held_back(n: int) -> np.ndarray:
    """Which of n sampled rows the first classifier does not see."""
    return np.arange(n) % HELD_BACK == HELD_BACK - 1


def measured(partition: Partition, x: np.ndarray, recall: float = RECALL) -> Partition:
    """Sets ``rest`` so that held-back rows of a sample find ``recall`` of their neighbours in it."""
    asked = np.flatnonzero(held_back(len(x)))
    if partition.size > 1 and len(asked):
        scale, leaf, needed = partition.top.scale, partition.filed(x), []
        z = (x - partition.top.mean) / scale
        square = (z * z).sum(1)
        for at in range(0, len(asked), 256):
            rows = asked[at : at + 256]
            d = square[None] - 2 * z[rows] @ z.T
            d[np.arange(len(rows)), rows] = np.inf
            near = np.argpartition(d, min(GRAPH_K, len(x) - 1) - 1, 1)[:, : min(GRAPH_K, len(x) - 1)]
            order, left = partition.ranked(x[rows])
            place = np.argsort(order, 1)
            needed.append(np.take_along_axis(left, np.take_along_axis(place, leaf[near], 1), 1).ravel())
        partition.rest = float(np.quantile(np.concatenate(needed), 1 - recall, method="lower"))
    return partition


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec in double precision: rows that take part.

    Null, empty and zero vectors and those with null or non-finite components
    do not, and neither do vectors of another length than most.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vec", lambda c: c != 0)
    good = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vec")).where(F.coalesce(fine, F.lit(False)))
    length = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("vec") == (length["n"] if length else 0))


def _matrix(vec: pa.Array) -> np.ndarray:
    return np.asarray(vec.flatten()).reshape(len(vec), -1) if len(vec) else np.zeros((0, 1))


def leaves_for(n_rows: int) -> int:
    """Half the root of the number of rows."""
    return max(1, round(n_rows**0.5 / 2))


def train(rows: DataFrame, n_rows: int, most: int = SAMPLE, leaves: int | None = None, wide: int = WIDE) -> Partition:
    """Learn ``leaves`` parts from a sample taken by a hash of vec_id, in two levels if one would be wider than ``wide``."""
    leaves = leaves or leaves_for(n_rows)
    x = _matrix(rows.orderBy(F.xxhash64(F.lit(7), "vec_id"), "vec_id").limit(most).toArrow().column("vec").combine_chunks())
    n_top = leaves if leaves <= wide else min(wide, round(leaves**0.5))
    partition = Partition(learn(x[~held_back(len(x))], n_top))
    if n_top < leaves and partition.size > 1:
        top = rows.sparkSession.sparkContext.broadcast(partition)
        n_below = min(wide, -(-leaves // partition.size))

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(top.value.filed(_matrix(batch.column(1))).astype(np.int32))], names=["vec_id", "vec", "part"])

        filed = rows.mapInArrow(file, VECTORS + ", part int")
        sizes = filed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each part of the top
        sizes = F.broadcast(rows.sparkSession.createDataFrame(sizes, "part int, n bigint"))
        chance = F.pmod(F.xxhash64(F.lit(8), "vec_id"), F.lit(1 << 30)) / float(1 << 30)

        def cut(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("vec_id", kind="stable")
            return pd.DataFrame({"part": part["part"].iloc[:1], "router": [pickle.dumps(learn(np.stack(part["vec"].to_numpy()), n_below))]})

        below = filed.join(sizes, "part").where(chance * F.col("n") < most).groupBy("part").applyInPandas(cut, "part int, router binary").collect()
        partition.below = {r["part"]: pickle.loads(r["router"]) for r in below}
    return measured(partition, x)


def search(vectors: DataFrame, is_query, k: int = 10, probes: int | None = None, partition: Partition | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row, itself excluded.

    ``vectors`` has vec_id and embedding; other columns are ignored.  The
    distance is Euclidean, in double precision on the original vectors; ties
    go to the smaller vec_id.  Where rows repeat a vec_id, each is a candidate
    for others, one of them asks, and all of them are its own.  An empty table
    gives an empty result.  ``probes`` is how many parts are searched; by
    default as many as hold RECALL of the neighbours within the sample.  A
    query that finds fewer than k rows, or than there are, searches all parts.
    """
    rows = usable(vectors)
    n_rows = rows.count()
    partition = partition or train(rows, n_rows)
    asking = rows.where(is_query).dropDuplicates(["vec_id"])
    found = _probe(rows, asking, partition, k, probes)
    if partition.size > 1 and (probes or 0) < partition.size:
        found = checkpoint(found)
        counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        short = checkpoint(asking.select(F.col("vec_id").alias("query_id")).join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < min(k, n_rows - 1)).select("query_id"))
        if not short.isEmpty():
            again = asking.join(short.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi")
            found = found.join(short, "query_id", "left_anti").unionByName(_probe(rows, again, partition, k, partition.size))
    return found


def _probe(rows: DataFrame, asking: DataFrame, partition: Partition, k: int, probes: int | None) -> DataFrame:
    """The k nearest rows of those filed under the parts that each query searches."""
    shared = rows.sparkSession.sparkContext.broadcast(partition)

    def routed(ask: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                vec = batch.column(1)
                x = _matrix(vec)
                take, parts = shared.value.probed(x, probes) if ask else (np.arange(len(x)), shared.value.filed(x))
                for at in range(0, len(take), 8_192):
                    some = pa.array(take[at : at + 8_192])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(some), vec.take(some), pa.array(parts[at : at + 8_192].astype(np.int32))], names=["vec_id", "vec", "part"])

        return run

    filed = rows.mapInArrow(routed(False), VECTORS + ", part int")
    asked = asking.mapInArrow(routed(True), VECTORS + ", part int")
    # Blocks of a part: as many as its rows or queries need, dealt by hash of the whole row so that repeats spread.
    row_blocks = filed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(ROW_BLOCK)).cast("int").alias("n_row_blocks"))
    query_blocks = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).cast("int").alias("n_query_blocks"))
    blocks = [tuple(b) for b in row_blocks.join(query_blocks, "part").collect()]  # one row for each part, WIDE squared at most
    plan = lambda: F.broadcast(rows.sparkSession.createDataFrame(blocks, "part int, n_row_blocks int, n_query_blocks int"))
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.col(n)).cast("int")
    left = filed.join(plan(), "part").withColumn("row_block", deal("n_row_blocks", 1)).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("n_query_blocks") - 1)))
    right = asked.join(plan(), "part").withColumn("query_block", deal("n_query_blocks", 2)).withColumn("row_block", F.explode(F.sequence(F.lit(0), F.col("n_row_blocks") - 1)))
    key = ["part", "row_block", "query_block"]

    def rank(rows_: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(rows_) and len(queries):
            ids, x = rows_["vec_id"].to_numpy(), np.stack(rows_["vec"].to_numpy())
            for query, q in zip(queries["vec_id"], queries["vec"], strict=True):
                d = np.sqrt(((x - np.asarray(q)) ** 2).sum(1))
                d[ids == query] = np.inf
                if len(d) > k:  # everything up to the k-th distance, so that ties stay
                    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                else:
                    near = np.arange(len(d))
                near = near[ids[near] != query]
                near = near[np.lexsort((ids[near], d[near]))][:k]
                out["query_id"] += [query] * len(near)
                out["vec_id"] += ids[near].tolist()
                out["score"] += d[near].tolist()
        return pd.DataFrame({"query_id": np.array(out["query_id"], np.int64), "vec_id": np.array(out["vec_id"], np.int64), "score": np.array(out["score"], np.float64)})

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(rank, "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
