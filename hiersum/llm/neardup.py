"""Near-duplicate detection by a chosen-path set similarity join.

A document's set holds the 64-bit hashes of its word shingles.  Documents with
the same set form a class, and one of each class takes part in the join.  Sets
count as the same if their sizes, sums and the sums of a second, independent
hash of their shingles agree, 128 bits in all.  Rows that share a doc_id take
part one by one, under ids of their own, and are linked with each other.

Join: each of TREES independent trees branches the documents by the minwise
token of their set under the hash of the tree and level, so that a pair of
similarity s stays together with probability s a level.  The members of every
node are compared with one pivot, which links a large group of near copies at
one comparison each; what the first level links is contracted, and from then
on only pairs of different components are looked at, which loses no component.
A node of at most LEAF documents is compared exhaustively, and a larger one
branches again while it holds more than one component, down to level LEVELS.

A pair meets in a tree with probability s to the power of the level at which
its node became small, so the target recall sets the number of trees: for
links at the threshold, TREES of LEVELS levels leave a chance of MISS.  For
lower thresholds rounds of TREES more trees follow among the documents whose
nodes were deep enough to need them; rounds deal the same minwise tokens anew.

Documents of nodes that are large at the last level too share much without
being linked, a template or a passage, and no tree of this depth separates
them.  They are compared with each other exactly: linked sets share a token
among the rarest n - ceil(s n) + 1 of each, in any common order of all tokens.
Such tokens are nodes again, and the place of a token among a document's
rarest bounds the size of whom it can lead to: what comes before the first
common token is not shared.  A token leads nowhere unless it stands early
enough in the smaller set, so a template that many unlinked documents share
makes no node.  Small nodes are compared as above; in large ones documents
meet by classes of sizes that these bounds allow, and whatever is outside the
main component is compared by the full sets, in blocks; only links leave one.

A comparison first looks at 128 one-bit minwise sketches and then confirms the
link on the full sets.  The sketch alone never makes a link, and a pair at the
threshold passes it but for a chance of 1e-7.  For confirmation the partners of
a document are dealt to buckets of bounded size, and its text goes once to each.

Links are contracted to components by one task while they are few, and beyond
a checked count by alternating stars, each step cut by a checkpoint; neither
links nor components ever visit the driver.  Whatever is
joined on a key that may be very common (node, pivot, class, centre of a star)
is joined with a table that is computed before, so that both sides of the join
are plain shuffles, which adaptive execution can split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint, scratch

TREES, LEVELS, LEAF = 21, 3, 64
#: Minwise tokens that are kept for the trees.
TOKENS = 64
#: Chance to miss a link at the threshold, at most, counting trees as independent.
MISS = 1e-6
#: Bits of a sketch, and how many deviations beyond the mean of a pair at the threshold may differ.
SKETCH, DEVIATIONS = 128, 5.6
#: Ids that are broadcast to pick texts, at most.
BROADCAST_IDS = 2_000_000
#: Partners of a document that are confirmed in one place, about.
BUCKET = 64
#: Links that one task contracts, at most: some 200 MB.
LINKS_AT_ONCE = 2_000_000
#: Tokens of one side of a block of a large node, about.
BLOCK_TOKENS = 1_000_000
#: Ratio of the sizes at both ends of a size class of a large node.
SIZE_CLASS = 1.05
#: Counters of token frequencies: two rows, each of 2 to this power.
COUNTER_BITS = 18

_rng = np.random.default_rng(64)
_BYTES = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64)
_ODD = _rng.integers(0, 2**62, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors_to(n: int) -> np.ndarray:
    """Unrelated odd factors of the places of a word, for both hashes: multilinear hashing."""
    at = np.arange(1, 2 * n + 1, dtype=np.uint64).reshape(n, 2).T
    return _mix(at * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_factors = _factors_to(64)


def word_hashes(text: str) -> np.ndarray:
    """Two independent 64-bit hashes of each word (2 x words), A-Z folded, split at ASCII white space."""
    global _factors
    data = _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    solid = ~_SPACE[data]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros((2, 0), np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    size = np.diff(first, append=len(at))
    if size.max() > _factors.shape[1]:
        _factors = _factors_to(2 * int(size.max()))
    inside, held = np.arange(len(at)) - np.repeat(first, size), data[at]
    return _mix(np.stack([np.add.reduceat(b[held] * f[inside], first) for b, f in zip(_BYTES, _factors, strict=True)]) + size.astype(np.uint64))


def shingle_hashes(text: str | None, words: int = 2) -> np.ndarray:
    """Both hashes of every word shingle in order; with fewer words, the whole sequence as one; none without words."""
    h = word_hashes(text or "")
    n = min(words, h.shape[1])
    if not n:
        return h
    x = np.zeros((2, h.shape[1] - n + 1), np.uint64)
    for k in range(n):
        x = _mix(x * np.uint64(0xD6E8FEB86659FD93) + h[:, k : h.shape[1] - n + 1 + k])
    return x + np.uint64(n)


def shingle_set(text: str | None, words: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(shingle_hashes(text, words)[0])


def minwise(x: np.ndarray) -> np.ndarray:
    """The smallest 32-bit hash of the set under each of the trees' hashes."""
    out = np.full(len(_ODD), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(x), 8192):
        part = x[at : at + 8192]
        out = np.minimum(out, ((part[None] * _ODD[:, None]) >> np.uint64(32)).min(1))
    return out.astype(np.uint32)


SIGNATURE = "id bigint, n bigint, f1 bigint, f2 bigint, s1 bigint, s2 bigint, sig array<int>"


def signatures(rows: DataFrame, words: int) -> DataFrame:
    """Size, fingerprint, sketch and minwise tokens of each row's set (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                both = shingle_hashes(text.as_py(), words)
                x = np.unique(both[0])
                sig = minwise(x)
                bits = np.packbits((sig * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(bool)).view(np.int64)
                prints = np.array([x.sum(dtype=np.uint64), _mix(np.unique(both[1])).sum(dtype=np.uint64)], np.uint64).view(np.int64)
                for c, v in zip(columns, (len(x), prints[0], prints[1], bits[0], bits[1], sig[:TOKENS].view(np.int32)), strict=True):
                    c.append(v)
            types = [pa.int64()] * 5 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[f.split()[0] for f in SIGNATURE.split(", ")])

    return rows.select("id", "text").mapInArrow(run, SIGNATURE)


def differing(percent: int) -> int:
    """Sketch bits in which a linked pair may differ: half of what the sets do not share, and some deviations more."""
    p = (1 - percent / 100) / 2
    return math.ceil(SKETCH * p + DEVIATIONS * math.sqrt(SKETCH * p * (1 - p)))


def _alike(a: Column, b: Column, percent: int) -> Column:
    """What any linked pair meets: sizes close enough, and sketches that mostly agree."""
    sizes = F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * percent
    differ = F.bit_count(a["s1"].bitwiseXOR(b["s1"])) + F.bit_count(a["s2"].bitwiseXOR(b["s2"]))
    return sizes & (differ <= differing(percent))


def _open(a: Column, b: Column, percent: int) -> Column:
    """Alike, and not yet in one component."""
    return (a["c"] != b["c"]) & _alike(a, b, percent)


def merged(df: DataFrame) -> DataFrame:
    """Joined by a shuffle of both sides at every size, so that a plan at a tenth of the data is the plan at all of it."""
    return df.hint("merge")


def _nodes(rows: DataFrame, level: int) -> DataFrame:
    """Adds the node of each row (id, tree, sig) at a level: the path of its minwise tokens."""
    return rows.withColumn("node", F.xxhash64("tree", F.slice("sig", F.col("tree") % TREES * LEVELS + 1, F.lit(level)))).drop("sig")


def dealt(reps: DataFrame, turn: int) -> DataFrame:
    """The minwise tokens in the order in which a round deals them to its trees."""
    if turn == 0:
        return reps
    order = np.random.default_rng(turn).permutation(TOKENS)
    return reps.withColumn("sig", F.transform(F.array(*(F.lit(int(k)) for k in order)), lambda k: F.get("sig", k)))


def roots(reps: DataFrame, turn: int = 0) -> DataFrame:
    """First level of a round's trees: id, tree, node, and the node's size and pivot.  Rows hold ids, not sketches."""
    rows = _nodes(reps.select("id", "sig", F.explode(F.sequence(F.lit(turn * TREES), F.lit(turn * TREES + TREES - 1))).alias("tree")), 1)
    return rows.join(merged(checkpoint(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("pivot")).where("size > 1"))), "node")


def branch(first: DataFrame, reps: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Branch the large nodes of the first level on, as long as they hold more than one component.

    Returns star candidates (a, b), the members (node, id, tree) of small nodes of
    all levels, the documents (id) of nodes still large at the last level, and
    (id, depth), the level to which the large nodes of a document had to branch.
    """
    leaves, stars = [first.where(F.col("size").between(3, LEAF)).select("node", "id", "tree")], []
    large = checkpoint(first.where(F.col("size") > LEAF).select("id", "tree").join(merged(sketches.select("d.id", "d.c")), "id"))
    deeper = [large.select("id", F.lit(1).alias("depth")).limit(0)]
    for level in range(2, LEVELS + 1):
        if large.isEmpty():
            break
        deeper.append(large.select("id", F.lit(level).alias("depth")).distinct())
        rows = _nodes(large.join(merged(reps), "id"), level)
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("pivot"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").drop("low", "high")
        members = checkpoint(rows.join(merged(checkpoint(sizes)), "node"))
        stars.append(members.where("pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
        leaves.append(members.where(F.col("size").between(3, LEAF)).select("node", "id", "tree"))
        large = members.where(F.col("size") > LEAF).select("id", "tree", "c")
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    stars = union(stars) if stars else large.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    return stars, union(leaves), large.select("id").distinct(), union(deeper).groupBy("id").agg(F.max("depth").alias("depth"))


def meetings(first: DataFrame, reps: DataFrame, sketches: DataFrame, seen: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Open pairs (a, b) that meet in some tree, and the documents (id) of nodes that stayed large."""
    spark = reps.sparkSession
    turn, pairs, large, so_far = 0, None, None, reps.select("id", F.lit(1).alias("depth"))
    while True:
        # the depths at which one more round is not enough either
        wanting = [d for d in range(1, LEVELS + 1) if percent < 100 and (turn + 1) * TREES * math.log1p(-((percent / 100) ** d)) > math.log(MISS)]
        with scratch(spark):
            deep = reps if turn == 0 else checkpoint(dealt(reps.join(merged(so_far.select("id")), "id", "left_semi"), turn))
            nodes = first if turn == 0 else checkpoint(roots(deep, turn))
            stars, leaves, ends, deeper = branch(nodes, deep, sketches)
            if turn:
                stars = stars.unionByName(nodes.where("pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
            near = star_pairs(stars.distinct(), sketches, lambda x, y: _open(x, y, percent)).unionByName(leaf_pairs(leaves.join(merged(seen), "id"), percent, turn == 0))
            near, still = checkpoint(near.distinct(), outer=True), checkpoint(ends, outer=True)
            if wanting:
                reached = so_far.unionByName(deeper).groupBy("id").agg(F.max("depth").alias("depth"))
                so_far = checkpoint(reached.where(F.col("depth").isin(wanting)), outer=True)
        pairs, large = (near, still) if turn == 0 else (pairs.unionByName(near), large.unionByName(still))
        if not wanting or so_far.isEmpty():
            return pairs, large.distinct()
        turn += 1


def star_pairs(stars: DataFrame, sketches: DataFrame, test) -> DataFrame:
    """The star candidates that pass a test on both sketches."""
    with_b = stars.join(merged(sketches.select(F.col("d.id").alias("b"), F.col("d").alias("d_b"))), "b")
    with_a = with_b.join(merged(sketches.select(F.col("d.id").alias("a"), F.col("d").alias("d_a"))), "a")
    return with_a.where(test(F.col("d_a"), F.col("d_b"))).select("a", "b")


def first_level(first: DataFrame, reps: DataFrame, sketches: DataFrame) -> DataFrame:
    """id, d, small, tokens: what leaves compare, with the trees whose first level is small for a document, as bits, and its tokens there."""
    small = first.where(F.col("size") <= LEAF).groupBy("id").agg(F.expr("bit_or(shiftleft(1L, tree))").alias("small"))
    tokens = reps.select("id", F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda k: F.get("sig", k * LEVELS)).alias("tokens"))
    both = tokens.join(merged(sketches.withColumn("id", F.col("d.id"))), "id").join(merged(small), "id", "left")
    return checkpoint(both.select("id", "d", F.coalesce("small", F.lit(0).cast("bigint")).alias("small"), "tokens"))


def leaf_pairs(leaves: DataFrame, percent: int, once: bool = True) -> DataFrame:
    """Open pairs of small nodes (node, tree, and columns of ``first_level``), by exhaustive comparison of at most LEAF members.

    Rows are dealt and sorted by node and read as a stream, one node at a time.
    ``once``: a pair that has met in a small first level of an earlier tree is left out.
    """
    most = differing(percent)

    def node_pairs(x: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Rows (tree, id, n, s1, s2, c, small) of one node, and their tokens -> pairs of ids."""
        out = []
        before = (np.int64(1) << np.arange(tokens.shape[1])) * (np.arange(tokens.shape[1]) < x[0, 0]) if once else None
        for at in range(0, len(x), 256):
            a, b = x[at : at + 256, None], x[None, at:]
            near = (a[..., 5] != b[..., 5]) & (np.minimum(a[..., 2], b[..., 2]) * 100 >= np.maximum(a[..., 2], b[..., 2]) * percent)
            i, j = np.nonzero(near & ~np.tri(len(a), b.shape[1], -1, dtype=bool))
            i, j = i + at, j + at
            alike = np.bitwise_count((x[i, 3:5] ^ x[j, 3:5]).view(np.uint64)).sum(1, dtype=np.int64) <= most
            i, j = i[alike], j[alike]
            if once and len(i):
                fresh = ~((tokens[i] == tokens[j]) & ((x[i, 6:7] & before) != 0)).any(1)
                i, j = i[fresh], j[fresh]
            out.append(np.stack([x[i, 1], x[j, 1]], 1))
        return np.sort(np.concatenate(out), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_tokens, held_node = np.zeros((0, 7), np.int64), np.zeros((0, TREES), np.int32), None
        make = lambda parts: pa.RecordBatch.from_arrays([pa.array(c) for c in (np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)).T], names=["a", "b"])
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy()
            rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(1, 8)], 1)
            tokens = np.asarray(batch.column(8).flatten()).reshape(len(rows), -1)
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            out = []
            for k, (at, end) in enumerate(zip(first, [*first[1:], len(node)], strict=True)):
                part, own = rows[at:end], tokens[at:end]
                if k == 0 and node[0] == held_node:
                    part, own = np.concatenate([held, part]), np.concatenate([held_tokens, own])
                elif k == 0 and len(held) > 1:
                    out.append(node_pairs(held, held_tokens))
                if end == len(node):
                    held, held_tokens, held_node = part, own, node[at]
                elif len(part) > 1:
                    out.append(node_pairs(part, own))
            yield make(out)
        if len(held) > 1:
            yield make([node_pairs(held, held_tokens)])

    flat = leaves.select("node", "tree", "d.id", "d.n", "d.s1", "d.s2", "d.c", "small", "tokens")
    return flat.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a bigint, b bigint")


def texts_of(ids: DataFrame, rows: DataFrame, n_ids: int) -> DataFrame:
    """id, text of the rows named by ``ids`` (id)."""
    return rows.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "id", "left_semi")


def counters(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counters of tokens in both rows; the smaller count is the nearer one."""
    low = x >> np.uint64(64 - 2 * COUNTER_BITS) & np.uint64((1 << COUNTER_BITS) - 1)
    return x >> np.uint64(64 - COUNTER_BITS), low + np.uint64(1 << COUNTER_BITS)


def token_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How often tokens occur, by ``counters``: an array of fixed size, summed over all of ``texts`` (id, text)."""
    chunk = 1 << (COUNTER_BITS - 5)
    rows = lambda c: pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([v.tobytes() for v in c.reshape(64, chunk)], pa.binary())], names=["chunk", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 << COUNTER_BITS, np.int64)
        for batch in batches:
            for text in batch.column(1):
                for row in counters(shingle_set(text.as_py(), words)):
                    np.add.at(total, row, 1)
        if total.any():
            yield rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(n.as_py(), np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "n"])

    summed = texts.select("id", "text").mapInArrow(count, "chunk int, n binary").repartition("chunk").mapInArrow(add, "chunk int, n binary")
    out = np.zeros((64, chunk), np.int64)
    for r in summed.collect():  # 64 rows, 4 MB in all
        out[r["chunk"]] += np.frombuffer(r["n"], np.int64)
    return out.ravel()


def among(large: DataFrame, texts: DataFrame, seen: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The documents ``large`` (id) by their rarest tokens, of which every linked pair shares one.

    Returns the open pairs (a, b) of tokens that few share, and the members (node, d, hi) of the others.
    ``hi`` is the size of the largest set that a document can be linked with if
    the token is the first of its own that both hold; a node needs a document
    for which that is its own size or more, the smaller one of a linked pair.
    """
    spark = large.sparkSession
    some = texts_of(large, texts, large.count())
    counts = spark.sparkContext.broadcast(token_counts(some, words))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros((4, 0), np.int64)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = shingle_set(text.as_py(), words)
                n = len(x) - -(-percent * len(x) // 100) + 1
                order = np.argsort(np.minimum(*(counts.value[k] for k in counters(x))), kind="stable")[:n]
                hi = (len(x) - np.arange(len(order))) * (100 + percent) // percent - len(x)
                out.append(np.stack([x[order].view(np.int64), np.full(len(order), doc), hi, hi >= len(x)]))
            node, ids, hi, home = np.concatenate(out, 1)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(ids), pa.array(hi), pa.array(home.astype(bool))], names=["node", "id", "hi", "home"])

    rows = checkpoint(some.select("id", "text").mapInArrow(rarest, "node bigint, id bigint, hi bigint, home boolean"))
    sizes = checkpoint(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.max("home").alias("home")).where("size > 1 AND home").drop("home"))
    shared = checkpoint(rows.drop("home").join(merged(sizes), "node").join(merged(seen), "id").withColumn("tree", F.lit(TREES)))
    return leaf_pairs(shared.where(F.col("size") <= LEAF), percent), shared.where(F.col("size") > LEAF).select("node", "d", "hi")


def size_cells(members: DataFrame, percent: int) -> DataFrame:
    """Where the members (node, d, hi) of large nodes meet: node, cell, home, id, c, n, hi.

    A cell is a class of sizes.  A document is at home in the class of its own
    size, if it can be the smaller one of a linked pair, and visits the classes
    of the smaller ones that it can be linked with.  Who fits none of the
    others of a cell leaves it; a cell of one component goes.
    """
    size_class = lambda n: F.floor(F.log(n) / math.log(SIZE_CLASS)).cast("int")
    rows = members.select("node", F.col("d.id").alias("id"), F.col("d.c").alias("c"), F.col("d.n").alias("n"), "hi")
    lo, upper = F.ceil(F.col("n") * percent / 100), F.least("hi", "n")
    at_home = rows.where("hi >= n").withColumn("cell", size_class(F.col("n"))).withColumn("home", F.lit(True))
    visits = rows.withColumn("cell", F.explode(F.sequence(size_class(lo), size_class(upper)))).withColumn("home", F.lit(False))
    both = checkpoint(at_home.unionByName(visits))
    of = lambda home, value: F.when(F.col("home") == home, value)
    ends = both.groupBy("node", "cell").agg(F.max(of(True, F.col("hi"))).alias("far"), F.min(of(True, F.col("n"))).alias("low"), F.max(of(True, F.col("n"))).alias("high"), F.max(of(False, upper)).alias("reach"), F.min(of(False, lo)).alias("least"), F.min("c").alias("c1"), F.max("c").alias("c2"))
    ends = checkpoint(ends.where("low IS NOT NULL AND c1 <> c2").drop("c1", "c2"))
    fits = F.when(F.col("home"), F.col("n").between(F.col("least"), F.col("reach"))).otherwise((F.col("n") <= F.col("far")) & (upper >= F.col("low")) & (lo <= F.col("high")))
    return both.join(merged(ends), ["node", "cell"]).where(fits).select("node", "cell", "home", "id", "c", "n", "hi")


def across(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) in large nodes (node, d, hi): those at home in a cell with its visitors, but for pairs inside its main component.

    The full sets travel once to each block of a cell, not with each pair; an
    inverted index of the block counts what is common, or the sets themselves
    where sizes leave few to compare.  Only links come out, one for each
    document and component.
    """
    cells = checkpoint(size_cells(members, percent))
    cell = ["node", "cell"]
    of = lambda home: F.coalesce(F.sum(F.when(F.col("home") == home, F.col("n"))), F.lit(0))
    by_c = cells.groupBy(*cell, "c").agg(of(True).alias("h"), of(False).alias("v"))
    heaviest = F.max_by(F.struct("c", "h", "v"), F.struct(F.col("h") + F.col("v"), F.col("c"))).alias("top")
    main = by_c.groupBy(*cell).agg(heaviest, F.sum("h").alias("h"), F.sum("v").alias("v"), F.count(F.lit(1)).alias("k")).where("k > 1")
    blocks = lambda tokens: F.ceil(tokens / BLOCK_TOKENS).cast("int")
    # outside the main component at home, with all visitors; the main component at home, with visitors of others
    turns = F.array(
        F.struct(F.lit(0).alias("turn"), blocks(F.col("v")).alias("n_m"), blocks(F.col("h") - F.col("top.h")).alias("n_s")),
        F.struct(F.lit(1).alias("turn"), blocks(F.col("top.h")).alias("n_m"), blocks(F.col("v") - F.col("top.v")).alias("n_s")),
    )
    plan = main.select(*cell, F.col("top.c").alias("main"), F.explode(turns).alias("t")).select(*cell, "main", "t.*").where("n_m > 0 AND n_s > 0")
    part = cells.join(merged(checkpoint(plan)), cell).withColumn("right", F.col("home") == (F.col("turn") == 0))
    some = checkpoint(part.where(F.when(F.col("right"), F.col("c") != F.col("main")).otherwise((F.col("turn") == 0) | (F.col("c") == F.col("main")))))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), words).tobytes() for t in batch.column(1)], pa.binary())], names=["id", "tokens"])

    sets = texts_of(some.select("id").distinct(), texts, some.count()).select("id", "text").mapInArrow(to_sets, "id bigint, tokens binary")
    full = checkpoint(some.join(merged(sets), "id"))
    deal = lambda n: F.pmod(F.hash("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key, carried = [*cell, "turn", "m", "s"], ["id", "c", "n", "hi", "tokens"]
    one = full.where("NOT right").withColumn("m", deal("n_m")).withColumn("s", every("n_s")).select(*key, *carried)
    other = full.where("right").withColumn("s", deal("n_s")).withColumn("m", every("n_m")).select(*(F.col(k).alias(f"{k}2") for k in (*key, *carried)))

    def compare(m: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(m) and len(y):
            parts = [np.frombuffer(t, np.uint64) for t in m["tokens"]]
            ids, cs, sizes, hi = (m[k].to_numpy() for k in ("id", "c", "n", "hi"))
            tokens = np.concatenate(parts)
            order = np.argsort(tokens, kind="stable")
            owner, tokens = np.repeat(np.arange(len(parts)), sizes)[order], tokens[order]
            for i, c, n, far, own in zip(y["id2"], y["c2"], y["n2"], y["hi2"], y["tokens2"], strict=True):
                near = np.flatnonzero((cs != c) & (sizes <= far) & (hi >= n) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)))
                if not len(near):
                    continue
                own = np.frombuffer(own, np.uint64)
                if len(near) * 8 < len(parts):
                    theirs = np.concatenate([parts[k] for k in near])
                    held = own[np.minimum(np.searchsorted(own, theirs), n - 1)] == theirs
                    common = np.add.reduceat(held, np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
                else:
                    low, high = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
                    run = high - low
                    at = np.repeat(low - np.cumsum(run) + run, run) + np.arange(run.sum())
                    common = np.bincount(owner[at], minlength=len(parts))[near]
                hit = near[100 * common >= percent * (sizes[near] + n - common)]
                out += [(int(i), int(ids[h])) for h in hit[np.unique(cs[hit], return_index=True)[1]]]
        return pd.DataFrame({"a": np.array([p[0] for p in out], np.int64), "b": np.array([p[1] for p in out], np.int64)})

    return one.groupBy(*key).cogroup(other.groupBy(*(f"{k}2" for k in key))).applyInPandas(compare, "a bigint, b bigint")


def with_component(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Adds ``component`` to rows that have an ``id``; what has no link is its own."""
    return rows.join(merged(components.withColumnRenamed("id", "linked")), F.col("id") == F.col("linked"), "left").drop("linked").withColumn("component", F.coalesce("component", "id"))


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.  Sets are made anew from the texts of the pairs alone.

    The partners of a document go to buckets, each behind a row with the
    document's own text, and are read in that order as a stream.
    """
    pairs = checkpoint(pairs)
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), texts, pairs.count() * 2)
    buckets = checkpoint(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(BUCKET)).cast("int").alias("n")))
    several = buckets.where("n > 1")
    heads = buckets.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(F.col("a").alias("id"), "bucket").join(merged(texts), "id").select(F.col("id").alias("a"), "bucket", F.lit(None).cast("bigint").alias("b"), "text")
    tails = pairs.join(several, "a", "left").select("a", F.coalesce(F.pmod(F.hash("b"), F.col("n")), F.lit(0)).alias("bucket"), F.col("b").alias("id")).join(merged(texts), "id").select("a", "bucket", F.col("id").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for b, text in zip(batch.column(1), batch.column(2), strict=True):
                x = shingle_set(text.as_py(), words)
                if not b.is_valid:
                    head = x
                common = len(head) + len(x) - len(np.union1d(head, x)) if b.is_valid else 0
                keep.append(100 * common >= percent * (len(head) + len(x) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    dealt = heads.unionByName(tails).repartition("a", "bucket").sortWithinPartitions("a", "bucket", "b")
    return checkpoint(dealt.select("a", "b", "text").mapInArrow(run, "a bigint, b bigint"))


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all links that come (u, v), by hooking roots to smaller ones and following them."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "component"])


def components(links: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable, for every id that has a link."""
    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if edges.count() <= LINKS_AT_ONCE:
        return edges.repartition(1).mapInArrow(contract, "id bigint, component bigint")
    return alternating_stars(edges)


def alternating_stars(edges: DataFrame) -> DataFrame:
    """Components of links (u > v, distinct) by alternating stars.

    Large star: a node points its larger neighbours to its smallest.  Small
    star: it points its smaller ones and itself there.  Both only rewire
    links, and at the fixed point every component is one star.
    """
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        edges = checkpoint(both.join(merged(lowest), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = checkpoint(edges.groupBy("u").agg(F.min("v").alias("m")))
        edges = edges.join(merged(lowest), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = checkpoint(edges)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()).groupBy("id").agg(F.min("component").alias("component"))


def by_row(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (id, text) whose ids are unique, and (id, doc_id, times) of the rows that had to get another id, if any.

    New ids lie above all doc_ids.  A null doc_id stays null.
    """
    known = docs.where("doc_id IS NOT NULL")
    many = checkpoint(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if many.isEmpty():
        return docs.select(F.col("doc_id").alias("id"), "text"), None
    many = F.broadcast(many) if many.count() <= BROADCAST_IDS else many
    top = known.agg(F.max("doc_id")).first()[0]
    each = known.join(many, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("times"))
    each = checkpoint(each.withColumn("id", F.lit(top + 1) + F.monotonically_increasing_id()))
    rows = docs.join(many, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "text").unionByName(each.select("id", "text"))
    return rows, each.select("id", "doc_id", "times")


def find(docs: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * common >= percent * union on their sets
    of ``words``-word shingles; a component is what links reach.  Null, empty
    and wordless texts have an empty set and are linked with nothing.  Equal
    sets are linked.  Rows that share a doc_id are one document, which has the
    links of all its texts; each row has its own number of shingles.  A null
    doc_id has no component and is not kept.  An empty table gives an empty
    result.  Other columns are ignored.
    """
    with scratch(docs.sparkSession):
        return checkpoint(_find(docs, words, percent), outer=True)


def _find(docs: DataFrame, words: int, percent: int) -> DataFrame:
    texts, repeats = by_row(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    key = ["n", "f1", "f2"]
    signed = checkpoint(signatures(texts, words))
    full = signed.where("n > 0 AND id IS NOT NULL")
    classes = full.groupBy(*key).agg(F.min("id").alias("rep"), F.min_by("s1", "id").alias("s1"), F.min_by("s2", "id").alias("s2"), F.min_by("sig", "id").alias("sig"))
    classes = checkpoint(classes.withColumnRenamed("rep", "id"))
    reps = classes.select("id", "n", "s1", "s2", "sig")
    sure = None
    if repeats is not None:  # a document with several rows is the centre of a star of their classes
        sure = checkpoint(full.select("id", *key).join(repeats, "id").join(classes.select(*key, F.col("id").alias("b")), key).select(F.col("doc_id").alias("a"), "b").distinct())
    sketch = lambda rows, c: checkpoint(rows.select(F.struct("id", "n", "s1", "s2", c.alias("c")).alias("d")))
    first = checkpoint(roots(reps.select("id", "sig")))
    stars = first.where("pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    links = confirm(star_pairs(stars, sketch(reps, F.col("id")), lambda x, y: _alike(x, y, percent)), texts, words, percent)
    joined = checkpoint(components(links if sure is None else links.unionByName(sure)))
    sketches = sketch(with_component(reps.drop("sig"), joined), F.col("component"))
    seen = first_level(first, reps, sketches)
    pairs, large = meetings(first, reps.select("id", "sig"), sketches, seen, percent)
    more = confirm(pairs.distinct(), texts, words, percent)
    if not large.isEmpty():
        pairs, members = among(large, texts, seen, words, percent)
        more = checkpoint(more.unionByName(confirm(pairs.distinct(), texts, words, percent)).unionByName(across(members, texts, words, percent)))
    if not more.isEmpty():
        joined = checkpoint(components(more.unionByName(joined.select(F.col("id").alias("a"), F.col("component").alias("b")))))
    placed = checkpoint(with_component(classes.select(*key, "id"), joined).drop("id"))
    everyone = signed.select("id", *key).join(merged(placed), key, "left").select(F.col("id").alias("doc_id"), "n", "component", F.lit(1).cast("bigint").alias("times"))
    if repeats is not None:
        centres = joined.join(repeats.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("doc_id"), F.col("component").alias("centre"))
        renamed = repeats.select(F.col("id").alias("row_id"), F.col("doc_id").alias("own"), F.col("times").alias("n_times"))
        named = everyone.join(renamed, F.col("doc_id") == F.col("row_id"), "left").select(F.coalesce("own", "doc_id").alias("doc_id"), "n", "component", F.coalesce("n_times", "times").alias("times"))
        everyone = named.join(checkpoint(centres), "doc_id", "left").select("doc_id", "n", F.coalesce("component", "centre").alias("component"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("times"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return everyone.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
