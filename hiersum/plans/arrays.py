"""3D array expansions, on Arrow batches.

Particles are dealt once, by ranges of (leaf, pid), and kept in leaf order.
Everything after reads that table:

* up: particles in leaf order make the moments of leaves and of all ancestors,
  without a shuffle of particles; each task sends a cell once, and where tasks
  are many, what they send of the few upper cells is summed before it goes on;
* transfer: cells of a level go to every block of target boxes within their
  reach, and a block makes its locals;
* evaluate: a block of leaves meets the locals of its boxes and of those above,
  and the particles of the block and around it.  Locals are moved to the leaves
  and evaluated, and pairs of near particles are summed, in bounded shares of
  the block's targets and of what they meet.

Within one set every pair of particles is evaluated once, by the block of the
first of the two leaves, and adds to both; so a block meets the leaves of the
upper half of its neighbourhood only, and sends sums for their particles too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..config import Ops, SpatialConfig
from ..functions import index as ix
from ..functions.expansions import Expansion
from ..operators import tree
from ..staging import once
from . import pairs
from .fmm import Query
from .periodic import scale_offsets

#: Boxes per axis of a block, as bits; fewer where the tree is flat, so that there are 64 blocks or more.
BLOCK_BITS = 3
#: Targets of a block that one task evaluates, and particles that they meet.
TARGETS, SOURCES = 20_000, 100_000
#: So many parts of an upper cell are summed where they are used; more are summed in between.
PARTS = 64

BLOCK = ("bx", "by", "bz")
#: Target blocks whose shares are broadcast, at most.
BROADCAST_BLOCKS = 500_000
CELL = "level int, ix bigint, iy bigint, iz bigint, c binary"


def _rows(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows with equal keys; keys come back sorted."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(values[order], first, 0)


def _morton(b: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(b), np.int64)
    for k in range(bits):
        for axis in range(3):
            out |= ((b[:, axis] >> k) & 1) << (3 * k + 2 - axis)
    return out


def _boxes(m: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros((len(m), 3), np.int64)
    for k in range(bits):
        for axis in range(3):
            out[:, axis] |= ((m >> (3 * k + 2 - axis)) & 1) << k
    return out


class Climb:
    """Sums of rows that come in leaf order, one row for each cell of each level.  What is open is one cell a level."""

    def __init__(self, e: Expansion, top: int, leaf: int):
        self.e, self.top, self.leaf = e, top, leaf
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, level: int, keys: np.ndarray, values: np.ndarray, last: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yields (level, keys, values) of the cells that are complete."""
        if level in self.open:
            k, v = self.open.pop(level)
            keys, values = _sum_by(np.concatenate([k, keys]), np.concatenate([v, values]))
        if not last and len(keys):
            self.open[level] = keys[-1:], values[-1:]
            keys, values = keys[:-1], values[:-1]
        if len(keys):
            yield level, keys, values
        if level > self.top and (len(keys) or last):
            moved = np.empty_like(values)
            for s in range(8):
                at = (keys & 7) == s
                moved[at] = self.e.lift(s, values[at])
            sums = _sum_by(keys >> 3, moved) if len(keys) else (keys, moved)
            yield from self.add(level - 1, *sums, last)

    def end(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        yield from self.add(self.leaf, np.zeros(0, np.int64), np.zeros((0, self.e.charges * self.e.size)), True)


class NearOnly(Expansion):
    """A kernel's pairs in batches, in two or three dimensions, for plans whose far field is made elsewhere."""

    size = 0

    def __init__(self, near):
        self.near = near


@dataclass
class ArrayQuery:
    """The outputs of an expansion's kernel at ``targets``, in a 3D cube, plain or periodic.

    ``ops`` and ``data`` work as in ``Query``.
    """

    cfg: SpatialConfig
    expansion: Expansion
    targets: DataFrame
    sources: DataFrame | None = None
    ops: Ops = Ops.ALL
    data: DataFrame | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.expansion, NearOnly) and (self.cfg.dim != 3 or len(set(self.cfg.widths)) != 1):
            raise ValueError("array expansions take a 3D cube")
        self.block = BLOCK[: self.cfg.dim]
        self.query = Query(self.cfg, self.expansion.near, self.targets, self.sources, self.ops, self.data)
        self.values = list(self.expansion.near.values)
        self.bits = max(0, min(BLOCK_BITS, self.cfg.leaf_level - 2))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Particles in leaf order.  Ranges rather than hashes: a leaf with very many particles spans several tasks."""
        leaf = ix.morton([F.col(b) for b in self.cfg.boxes], self.cfg.leaf_level)
        return once(rows.withColumn("leaf", leaf).repartitionByRange("leaf", "pid").sortWithinPartitions("leaf"))

    @cached_property
    def s(self) -> DataFrame:
        return self._placed(self.query.s)

    @cached_property
    def t(self) -> DataFrame:
        return self.s if self.query.same else self._placed(self.query.t)

    @cached_property
    def source_leaves(self) -> DataFrame:
        """Boxes and n."""
        return once(self.s.groupBy(*self.cfg.boxes).agg(F.count(F.lit(1)).alias("n")))

    @cached_property
    def target_leaves(self) -> DataFrame:
        return self.source_leaves if self.query.same else once(self.t.groupBy(*self.cfg.boxes).agg(F.count(F.lit(1)).alias("n")))

    @cached_property
    def moments(self) -> DataFrame:
        """``upward``, computed once."""
        return once(self.upward())

    def upward(self) -> DataFrame:
        """Moments of all far cells (several rows of a cell add up)."""
        cfg, e, L = self.cfg, self.expansion, self.cfg.leaf_level
        rows = self.s.select("leaf", *cfg.axes, *self.values)
        corner, width, n_values = np.array(cfg.corner), cfg.leaf_widths[0], len(self.values)
        stop = L if not self.ops & Ops.M2M else 0 if cfg.periodic else cfg.stop_level
        names = ["level", "ix", "iy", "iz", "c"]

        def packed(level: int, keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 4096):
                b, part = _boxes(keys[at : at + 4096], L), values[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), level, np.int32)), *(pa.array(b[:, k]) for k in range(3)), pa.array([v.tobytes() for v in part], pa.binary())], names=names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            climb = Climb(e, stop, L)
            for batch in batches:
                if not batch.num_rows:
                    continue
                leaf = batch.column(0).to_numpy()
                x = np.stack([batch.column(k).to_numpy() for k in (1, 2, 3)], 1)
                q = np.stack([batch.column(4 + k).to_numpy() for k in range(n_values)], 1)
                scaled = (x - corner - (_boxes(leaf, L) + 0.5) * width) * (2 / width)
                parts = [_sum_by(leaf[i : i + 4096], e.p2m(scaled[i : i + 4096], q[i : i + 4096])) for i in range(0, len(leaf), 4096)]
                for cells in climb.add(L, *_sum_by(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))):
                    yield from packed(*cells)
            for cells in climb.end():
                yield from packed(*cells)

        made = rows.mapInArrow(run, CELL)
        tasks = int(self.query.t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if tasks <= PARTS:
            return made

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                keys = zip(batch.column(0).to_pylist(), _morton(np.stack([batch.column(k).to_numpy() for k in (1, 2, 3)], 1), L).tolist(), strict=True) if batch.num_rows else ()
                for key, c in zip(keys, batch.column(4), strict=True):
                    v = np.frombuffer(c.as_py(), np.float64)
                    held[key] = held[key] + v if key in held else v
                if len(held) > 16_384:  # parts may come in parts
                    for (level, key), v in held.items():
                        yield from packed(level, np.array([key]), v[None])
                    held = {}
            for (level, key), v in held.items():
                yield from packed(level, np.array([key]), v[None])

        # Few cells have parts from many tasks: those of the levels with fewer cells than tasks.  They go to a few tasks each.
        upper = F.expr(f"shiftleft(1L, 3 * level) <= {tasks}")
        salt = F.when(upper, F.pmod(F.spark_partition_id(), F.lit(PARTS))).otherwise(0)
        return made.withColumn("salt", salt).repartition("level", "ix", "iy", "iz", "salt").drop("salt").mapInArrow(summed, CELL)

    def _images(self, box: str, n: Column) -> Column:
        """Box numbers of a source and its images from -3 to n + 2."""
        first, last = F.ceil((-F.col(box) - 3) / n), F.floor((n + 2 - F.col(box)) / n)
        return F.explode(F.transform(F.sequence(first, last), lambda k: F.col(box) + k * n))

    def _above_root(self) -> np.ndarray | None:
        """Locals of the root from the images beyond the nearest, on one row of moments."""
        cfg, e = self.cfg, self.expansion
        if not cfg.periodic or cfg.extra_levels < 0 or not (self.ops & Ops.M2M and self.ops & Ops.L2L):
            return None

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(e.charges * e.size)
            for batch in batches:
                out += _rows(batch.column(0).to_pylist()).sum(0) if batch.num_rows else 0
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["c"])

        # one row of each task
        parts = self.moments.where("level = 0").select("c").mapInArrow(total, "c binary").collect()
        m, coming = _rows([r["c"] for r in parts]).sum(0)[None], []
        for scale in range(cfg.extra_levels + 1):
            if scale:
                m = sum(e.lift(slot, m) for slot in range(8))
            seen, width = e.spectrum(m), cfg.widths[0] * (1 << scale)
            # an image at offset o acts like a source o boxes away
            came = sum(e.transfer(o, seen, width) for o in scale_offsets(cfg, scale))
            coming.append(e.unspectrum(came) * e.scale(width))
        local = coming[-1]
        for lower in reversed(coming[:-1]):
            local = e.lower(0, local) + lower
        return local

    def transfer(self) -> DataFrame:
        """Locals of the target cells from their interaction lists."""
        cfg, e, bits, size, width = self.cfg, self.expansion, self.bits, 1 << self.bits, self.cfg.widths[0]
        boxes = [F.col(b) for b in cfg.boxes]
        moments = self.moments if cfg.periodic and cfg.extra_levels >= 0 else self.upward()
        sent = moments.where(f"level >= {cfg.stop_level}")  # one row of a cell, or a few
        if cfg.periodic:  # the images that reach into the box, under the numbers that their boxes would have
            n = F.call_function("shiftleft", ix.long(1), F.col("level"))
            for b in cfg.boxes:
                sent = sent.withColumn(b, self._images(b, n))
        # Every block that a source may act on: those of the boxes at its reach.
        reach = [F.sequence(F.greatest(F.shiftright(b - 3, bits), F.lit(0)), F.shiftright(F.least(b + 3, F.call_function("shiftleft", ix.long(1), F.col("level")) - 1), bits)) for b in boxes]
        for n, r in zip(BLOCK, reach, strict=True):
            sent = sent.withColumn(n, F.explode(r))
        cells = tree.roll_up(self.target_leaves, cfg, cfg.far_levels, {"n": F.col("n")})
        targets = cells.select("level", *cfg.boxes, *(F.shiftright(b, bits).alias(n) for b, n in zip(boxes, BLOCK, strict=True)))
        offsets = [o for o in ix.far_offsets(3)]
        key = ["level", *BLOCK]

        def run(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
            if not len(t) or not len(s):
                return pd.DataFrame({k: [] for k in ("level", "ix", "iy", "iz", "c")})
            level = int(t["level"].iloc[0])
            tb, sb = t[["ix", "iy", "iz"]].to_numpy(), s[["ix", "iy", "iz"]].to_numpy()
            base = (tb.min(0) >> bits << bits) - 3
            side = size + 6
            flat = lambda b: ((b[:, 0] - base[0]) * side + b[:, 1] - base[1]) * side + b[:, 2] - base[2]
            cells, moments = _sum_by(flat(sb), _rows(s["c"].tolist()))
            where = np.full(side**3, -1)
            where[cells] = np.arange(len(cells))
            spectrum = e.spectrum(moments)
            total = np.zeros((len(tb), e.fields, *spectrum.shape[2:]), spectrum.dtype)
            for o in offsets:
                other = tb + np.array(o)
                fits = (np.abs((other >> 1) - (tb >> 1)).max(1) <= 1) & (other >= base).all(1) & (other < base + side).all(1)
                at = np.flatnonzero(fits)
                if not len(at):
                    continue
                found = where[flat(other[at])]
                at, found = at[found >= 0], found[found >= 0]
                if len(at):
                    total[at] += e.transfer(o, spectrum[found], width / (1 << level))
            local = e.unspectrum(total) * e.scale(width / (1 << level))
            return pd.DataFrame({"level": np.int32(level), "ix": tb[:, 0], "iy": tb[:, 1], "iz": tb[:, 2], "c": [v.tobytes() for v in local]})

        return targets.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(run, CELL)

    def _around(self, sources: DataFrame) -> DataFrame:
        """Sources (or their leaves, with boxes) with every block that meets them, images included: ``BLOCK``, and ``home`` for no image."""
        cfg, n, mutual = self.cfg, self.cfg.boxes_at(self.cfg.leaf_level), self.query.same
        rows = sources.withColumn("home", F.lit(True))
        for k, (b, a, name) in enumerate(zip(cfg.boxes, cfg.axes, self.block, strict=True)):
            if cfg.periodic:  # the images that touch the box
                rows = rows.withColumn("image", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).where((F.col(b) + F.col("image") * n).between(-1, n))
                moved = {a: F.col(a) + F.col("image") * cfg.widths[k]} if a in rows.columns else {}
                rows = rows.withColumns(moved | {b: F.col(b) + F.col("image") * n, "home": F.col("home") & (F.col("image") == 0)}).drop("image")
            # the upper half of a neighbourhood never goes back along the first axis
            low, high = F.greatest(F.col(b) - 1, F.lit(0)), F.least(F.col(b) + (0 if mutual and k == 0 else 1), F.lit(n - 1))
            rows = rows.withColumn(name, F.explode(F.sequence(F.shiftright(low, self.bits), F.shiftright(high, self.bits))))
        return rows

    def _shares(self) -> DataFrame:
        """BLOCK, n_t, n_s: shares of each target block and of what it meets, from the leaves' counts."""
        block = [F.shiftright(F.col(b), self.bits).alias(n) for b, n in zip(self.cfg.boxes, self.block, strict=True)]
        share = lambda most, name: F.ceil(F.sum("n") / F.lit(most)).cast("int").alias(name)
        # without locals to move, more shares cost little, and tasks come out even
        finer = 4 if isinstance(self.expansion, NearOnly) else 1
        t = self.target_leaves.groupBy(*block).agg(share(TARGETS / finer, "n_t"))
        s = self._around(self.source_leaves).groupBy(*self.block).agg(share(SOURCES / finer, "n_s"))
        return once(t.join(s, list(self.block), "left").select(*self.block, "n_t", F.coalesce("n_s", F.lit(1)).alias("n_s")))

    def _small(self, shares: DataFrame) -> DataFrame:
        """Broadcast where the checked number of blocks allows it."""
        return F.broadcast(shares) if shares.count() <= BROADCAST_BLOCKS else shares

    def _below(self, shares: DataFrame) -> DataFrame:
        """Locals with the target blocks below them, for the first share of what these meet."""
        cfg, L = self.cfg, self.cfg.leaf_level
        below = self.transfer().where(f"level >= {cfg.stop_level if self.ops & Ops.L2L else L}")
        for b, n in zip(cfg.boxes, BLOCK, strict=True):
            first = F.expr(f"shiftright(shiftleft({b}, {L} - level), {self.bits})")
            last = F.expr(f"shiftright(shiftleft({b} + 1L, {L} - level) - 1L, {self.bits})")
            below = below.withColumn(n, F.explode(F.sequence(first, last)))
        return below.join(shares, list(self.block)).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n_t") - 1))).withColumn("s", F.lit(0))

    def evaluate(self, far: bool, near: bool) -> DataFrame:
        """pid and the outputs: several rows of a particle add up, and every target has one."""
        cfg, e, L, bits = self.cfg, self.expansion, self.cfg.leaf_level, self.bits
        kernel, mutual, values, width, corner = e.near, self.query.same, self.values, cfg.leaf_widths[0], np.array(cfg.corner)
        stop, boxes, axes = cfg.stop_level if self.ops & Ops.L2L else L, list(cfg.boxes), cfg.axes
        shares = self._shares()
        small = self._small(shares)
        root = self._above_root() if far else None
        deal = lambda c: F.pmod(F.hash("pid"), F.col(c))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        key, columns = [*self.block, "t", "s"], ["pid", *cfg.axes, *values, *cfg.boxes]
        block = {n: F.shiftright(F.col(b), bits) for b, n in zip(cfg.boxes, self.block, strict=True)}
        left = self.t.withColumns(block).join(small, list(self.block)).withColumn("t", deal("n_t")).withColumn("s", every("n_s") if near else F.lit(0)).select(*key, *columns)
        kinds = {"level": "int", "pid": "bigint", **dict.fromkeys((*cfg.axes, *values), "double"), **dict.fromkeys(cfg.boxes, "bigint"), "home": "boolean", "c": "binary"}
        whole = lambda df: df.select(*(F.col(k).alias(f"of_{k}") for k in key), *((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(f"of_{c}") for c, kind in kinds.items()))
        right = []
        if near:
            right.append(whole(self._around(self.s).join(small, list(self.block)).withColumn("s", deal("n_s")).withColumn("t", every("n_t")).select(*key, *columns, "home")))
        if far:
            right.append(whole(self._below(small).select(*key, "level", *cfg.boxes, "c")))
        if not right:
            right.append(whole(left.limit(0)))

        def lowered(box: np.ndarray, c: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            """Locals of the leaves that ``box`` names, and each particle's place in them."""
            leaf = _morton(box, L)
            keys = np.unique(leaf)
            levels, where, coefs = c["level"].to_numpy(), _morton(c[["ix", "iy", "iz"]].to_numpy().astype(np.int64), L), _rows(c["c"].tolist()) if len(c) else np.zeros((0, e.fields * e.size))
            above_keys, above = (None, None) if root is None else (np.zeros(1, np.int64), root)
            for level in range(stop, L + 1):
                wanted = np.unique(keys >> (3 * (L - level)))
                total = np.zeros((len(wanted), e.fields * e.size))
                own = levels == level
                if own.any():
                    k, v = _sum_by(where[own], coefs[own])
                    at = np.searchsorted(wanted, k)
                    hit = (at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == k)
                    total[at[hit]] += v[hit]
                if above is not None:
                    parent = np.searchsorted(above_keys, wanted >> 3)
                    for slot in range(8):
                        at = np.flatnonzero((wanted & 7) == slot)
                        if len(at):
                            total[at] += e.lower(slot, above[parent[at]])
                above_keys, above = wanted, total
            return above, np.searchsorted(above_keys, leaf)

        def far_of(p: pd.DataFrame, c: pd.DataFrame, pot: np.ndarray, grad: np.ndarray) -> None:
            box = p[["ix", "iy", "iz"]].to_numpy()
            x = (p[["x", "y", "z"]].to_numpy() - corner - (box + 0.5) * width) * (2 / width)
            local, at = lowered(box, c)
            for i in range(0, len(p), 2048):
                value, slope = e.l2p(x[i : i + 2048], local, at[i : i + 2048])
                pot[i : i + 2048] += value
                grad[i : i + 2048] += slope * (2 / width)

        def near_of(p: pd.DataFrame, o: pd.DataFrame, pot: np.ndarray, grad: np.ndarray) -> pd.DataFrame | None:
            """Adds to the targets' sums; returns those of the others, if pairs count for both."""
            base = (p[boxes].to_numpy().min(0) >> bits << bits) - 1
            side = (1 << bits) + 2
            strides = side ** np.arange(len(boxes) - 1, -1, -1)
            flat = lambda f: (f[boxes].to_numpy().astype(np.int64) - base) @ strides
            cell = flat(o)
            order = np.argsort(cell, kind="stable")
            start = np.searchsorted(cell[order], np.arange(side ** len(boxes) + 1))
            sx, ids = [o[c].to_numpy()[order] for c in axes], o["pid"].to_numpy()[order].astype(np.int64)
            sq = o[values].to_numpy().astype(float)[order]
            own, pid = flat(p), p["pid"].to_numpy()
            at, q, x = np.argsort(own, kind="stable"), p[values].to_numpy().astype(float), [p[c].to_numpy() for c in axes]
            back_pot, back_grad = np.zeros((len(ids), pot.shape[1])), np.zeros((len(ids), *grad.shape[1:]))
            touched = np.zeros(len(ids), bool)
            leaves, first = np.unique(own[at], return_index=True)
            # leaves in a row along the last axis are one run of sources; if pairs count for both, the first run begins at the leaf itself
            middle = (0,) * (len(boxes) - 1)
            ahead = [o for o in product((-1, 0, 1), repeat=len(middle)) if not mutual or o >= middle]
            runs = [(int(np.dot(o, strides[:-1])), 0 if mutual and o == middle else -1) for o in ahead]
            for leaf, a, b in zip(leaves, first, [*first[1:], len(at)], strict=True):
                found = np.concatenate([np.arange(start[leaf + away + first_], start[leaf + away + 2]) for away, first_ in runs])
                if not len(found):
                    continue
                n_own = start[leaf + 1] - start[leaf] if mutual else 0
                fx, fq = [v[found] for v in sx], sq[found]
                rows = at[a:b]
                part, other = pairs.nothing(kernel, len(rows), len(boxes)), pairs.nothing(kernel, len(found), len(boxes)) if mutual else None

                def skip(r: slice, c: slice) -> np.ndarray | None:
                    """Of two particles of one leaf, the one with the smaller pid sees the other."""
                    if c.start >= n_own:
                        return None
                    off = np.zeros((r.stop - r.start, c.stop - c.start), bool)
                    near = found[c.start : min(c.stop, n_own)]
                    off[:, : len(near)] = ids[near][None] <= pid[rows[r]][:, None]
                    return off

                pairs.add(kernel, [v[rows] for v in x], q[rows], [v[found] for v in sx], sq[found], part, other, skip)
                for total, v in zip((pot, grad), part, strict=True):
                    total[rows] += v
                for total, v in zip((back_pot, back_grad), other or (), strict=False):
                    total[found] += v
                if mutual:
                    touched[found] = True
            if not touched.any():
                return None
            return pd.DataFrame({"pid": ids[touched], **kernel.results(back_pot[touched], back_grad[touched], sq[touched])})

        def run(p: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
            pot, grad, more = np.zeros((len(p), e.fields)), np.zeros((len(p), e.fields, len(boxes) if kernel.gradients else 0)), None
            if not len(p):
                return pd.DataFrame({"pid": np.array([], np.int64), **{c: [] for c in kernel.outputs}})
            o = o.rename(columns=lambda c: c.removeprefix("of_"))
            local = o["level"].notna()
            if far and p["s"].iloc[0] == 0 and (local.any() or root is not None):
                far_of(p, o[local], pot, grad)
            if near and not local.all():
                more = near_of(p, o[~local], pot, grad)
            out = pd.DataFrame({"pid": p["pid"], **kernel.results(pot, grad, p[values].to_numpy().astype(float))})
            return out if more is None else pd.concat([out, more])

        met = right[0] if len(right) == 1 else right[0].unionByName(right[1])
        return left.groupBy(*key).cogroup(met.groupBy(*(f"of_{k}" for k in key))).applyInPandas(run, ", ".join(["pid bigint", *(f"{c} double" for c in kernel.outputs)]))

    def execute(self) -> DataFrame:
        """pid and the outputs of every target; zero where nothing acts on it."""
        rows = self.evaluate(self.query.far_wanted(), bool(self.ops & Ops.P2P))
        return rows.groupBy("pid").agg(*(F.sum(o).alias(o) for o in self.expansion.near.outputs))
