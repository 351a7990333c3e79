"""Ranked lexical search: WAND over document shards, whose heaps are merged.

One pass over the documents keeps, of every text, its length and how often it
holds each term that the queries ask for.  Corpus statistics follow from that
table by aggregation.  Then every task reads its part of the table in shards of
bounded size, turns a shard into postings by document number with each term's
largest impact, and runs WAND for every query: cursors in order of their
documents, the pivot where the sum of largest impacts could first beat the
heap's threshold, and skips of all cursors before it to the pivot.  Heaps live
on from shard to shard of a task, and their contents are merged in two steps.

Queries are a stated set and go in blocks of bounded size, each of which is
broadcast.  All scores are 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpoint, map_batches

TOP = 50
#: Queries, and their terms with repeats over queries, of a block; one query with more is a block of its own.
BLOCK_QUERIES, BLOCK_TERMS = 2_000, 500_000
#: Postings of a shard, and documents of it.
SHARD_POSTINGS, SHARD_DOCS = 1_000_000, 1 << 16
#: Tasks whose heaps meet in one group of the first merge.
MERGED = 64
#: ASCII that is no part of a term becomes a space, and A-Z lower case; the bytes of other characters stay.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

COUNTED = "doc_id bigint, n bigint, terms array<int>, tf array<int>"
FOUND = "query int, doc_id bigint, score bigint"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8; null has none."""
    return (text or "").encode().translate(BYTES).split()


@dataclass
class Block:
    """Queries (ids in order) as distinct term numbers, and the numbers of the terms."""

    ids: list
    queries: list[list[int]]
    vocabulary: dict[bytes, int]


def blocks_of(items: DataFrame) -> Iterator[Block]:
    """Blocks of bounded size, in order of item_id.  Items stream through the driver, a partition at a time."""
    block, held = Block([], [], {}), 0
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator()
    for item_id, text in rows:
        terms = list(dict.fromkeys(terms_of(text)))
        if block.ids and (held + len(terms) > BLOCK_TERMS or len(block.ids) >= BLOCK_QUERIES):
            yield block
            block, held = Block([], [], {}), 0
        held += len(terms)
        block.ids.append(item_id)
        block.queries.append([block.vocabulary.setdefault(t, len(block.vocabulary)) for t in terms])
    if block.ids:
        yield block


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers in the vocabulary), tf: a row for each row of ``docs`` that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, n, starts, terms, counts = [], [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(text.as_py())
                if not words:
                    continue
                found = [(known[w], c) for w, c in Counter(words).items() if w in known]
                ids.append(doc_id)
                n.append(len(words))
                terms += [f[0] for f in found]
                counts += [f[1] for f in found]
                starts.append(len(terms))
            offsets = pa.array(starts, pa.int32())
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *(pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (terms, counts))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tf"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, COUNTED)


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term brings a document: all arguments are int64, and divisions round down."""
    m = 50 + 50 * n * documents // length
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Heap:
    """The best ``top`` rows: higher scores first, then smaller ids, null last."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    @property
    def threshold(self) -> int:
        """What a document must reach; the id decides between equal scores."""
        return self.rows[0][0] if len(self.rows) == self.top else 1

    def offer(self, score: int, doc_id: int | None) -> None:
        row = (score, doc_id is not None, -(doc_id or 0))
        if len(self.rows) < self.top:
            heapq.heappush(self.rows, row)
        elif row > self.rows[0]:
            heapq.heapreplace(self.rows, row)

    def items(self) -> list[tuple[int, int | None]]:
        return [(score, -minus if known else None) for score, known, minus in self.rows]


class Shard:
    """Postings of a bounded number of documents, which are numbered by id."""

    def __init__(self, ids: list, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        self.ids = [ids[k] for k in order]
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))
        doc = number[doc]
        at = np.lexsort((doc, term))
        doc, term, impact = doc[at], term[at], impact[at]
        names, first = np.unique(term, return_index=True)
        ends = [*first[1:], len(term)]
        #: term -> documents, impacts, largest impact
        self.postings = {int(t): (doc[a:b].tolist(), impact[a:b].tolist(), int(impact[a:b].max())) for t, a, b in zip(names, first, ends, strict=True)}

    def search(self, terms: list[int], heap: Heap) -> int:
        """WAND.  Returns how many documents were scored in full."""
        none, scored = len(self.ids), 0
        lists = [self.postings[t] for t in terms if t in self.postings]
        docs, values, most = [p[0] for p in lists], [p[1] for p in lists], [p[2] for p in lists]
        at = [0] * len(lists)
        cursors = sorted((d[0], k) for k, d in enumerate(docs))  # (document, list)
        while cursors:
            bound, threshold, pivot = 0, heap.threshold, -1
            for p, (_, k) in enumerate(cursors):
                bound += most[k]
                if bound >= threshold:
                    pivot = p
                    break
            if pivot < 0:
                return scored
            target = cursors[pivot][0]
            moved = []
            if cursors[0][0] == target:  # all cursors up to the pivot stand on it, and maybe some behind it
                score, p = 0, 0
                while p < len(cursors) and cursors[p][0] == target:
                    k = cursors[p][1]
                    score += values[k][at[k]]
                    at[k] += 1
                    moved.append((docs[k][at[k]] if at[k] < len(docs[k]) else none, k))
                    p += 1
                scored += 1
                heap.offer(score, self.ids[target])
            else:
                p = 0
                while cursors[p][0] < target:
                    k = cursors[p][1]
                    at[k] = bisect_left(docs[k], target, at[k])
                    moved.append((docs[k][at[k]] if at[k] < len(docs[k]) else none, k))
                    p += 1
            cursors = sorted([c for c in moved if c[0] < none] + cursors[p:])
        return scored


def search_counted(counted: DataFrame, block: Block, weights: dict[int, int], documents: int, length: int, top: int) -> DataFrame:
    """query (number in the block), doc_id, score: the best of every task's documents, from ``count_terms``' table."""
    weight = np.zeros(len(block.vocabulary), np.int64)
    for t, w in weights.items():
        weight[t] = w
    shared = counted.sparkSession.sparkContext.broadcast((block.queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = shared.value
        heaps: dict[int, Heap] = {}
        ids, parts, held = [], [], 0

        def close() -> None:
            if held:
                doc, term, impact = (np.concatenate([p[k] for p in parts]) for k in range(3))
                shard = Shard(ids, doc, term, impact)
                for q, terms in enumerate(queries):
                    if any(t in shard.postings for t in terms):
                        shard.search(terms, heaps.setdefault(q, Heap(top)))

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                n = rows.column(1).to_numpy()
                terms, tf = rows.column(2), rows.column(3)
                sizes = np.diff(terms.offsets.to_numpy())
                term, count = terms.flatten().to_numpy(zero_copy_only=False), tf.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(n)), sizes)
                value = impacts(count, n[doc], weight[term], documents, length)
                keep = value > 0
                parts.append((doc[keep] + len(ids), term[keep], value[keep]))
                ids += rows.column(0).to_pylist()
                held += int(keep.sum())
                if held >= SHARD_POSTINGS or len(ids) >= SHARD_DOCS:
                    close()
                    ids, parts, held = [], [], 0
        close()
        found = [(q, doc_id, score) for q, heap in heaps.items() for score, doc_id in heap.items()]
        columns = zip(*found, strict=True) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["query", "doc_id", "score"])

    return map_batches(counted, run, FOUND)


def merged(found: DataFrame, top: int) -> DataFrame:
    """query, rank, doc_id, score: tasks' heaps meet by groups of ``MERGED`` first, and then groups."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    grouped = found.withColumn("group", F.floor(F.spark_partition_id() / MERGED))
    best = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("query", "group").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.drop("group").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("query", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` documents of each item with a score above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are
    ignored.  Null, empty and termless texts are no documents, and as items
    find nothing.  Every row is a document or an item of its own, repeated or
    not: equal documents take ranks of their own, and equal items repeat their
    lists.  Ties go to the smaller doc_id, null last.  Empty tables give an
    empty result.
    """
    out = None
    for block in blocks_of(items):
        counted = checkpoint(count_terms(docs, block.vocabulary))
        documents, length = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row for each term of the block
        weights = {r["term"]: math.floor(1000 * math.log((2 * documents + 2) / (2 * r["count"] + 1))) for r in df}
        found = merged(search_counted(counted, block, weights, documents, max(1, length), top), top)
        names = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(block.ids)), f"query int, item_id {dict(items.dtypes)['item_id']}"))
        part = found.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = dict(items.dtypes)["item_id"]
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    return out
