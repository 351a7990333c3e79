"""Pairs of particles on arrays: tiles of a core's cache, and direct sums of whole sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations_with_replacement, product
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..config import SpatialConfig
from ..functions import index as ix
from ..functions.kernels import Kernel, Many, Pairwise
from ..staging import staged

#: Pairs of a tile, and sources of it at most.
TILE, COLUMNS = 1 << 16, 1024
#: Close pairs that are kept until their sums are added.
CLOSE = 1 << 17
#: Particles of a chunk at most; below that, so many particles a chunk until there are ``CHUNKS``.
CHUNK, FEW, CHUNKS = 32_768, 2_048, 32
#: Sources of a direct sum by columns, at most.
DIRECT_SOURCES = 500_000

Sums = tuple[np.ndarray, np.ndarray]


def add(kernel: Kernel, x: Sequence[np.ndarray], q: np.ndarray, sx: Sequence[np.ndarray], sq: np.ndarray, into: Sums, back: Sums | None = None, skip: Callable[[slice, slice], np.ndarray | None] | None = None) -> None:
    """Adds to the fields and gradients of the targets what the sources do to them, and with ``back`` to those of the sources.

    ``skip`` marks the pairs of a tile that do not count.  Under a singular kernel neither do points that coincide.
    """
    if (_radial(kernel) or _tensor(kernel)) and len(q) * len(sq) >= TILE and _add_on_grid(kernel, x, q, sx, sq, into, back, skip):
        return
    _add_apart(kernel, x, q, sx, sq, into, back, skip)


def _add_apart(kernel: Kernel, x: Sequence[np.ndarray], q: np.ndarray, sx: Sequence[np.ndarray], sq: np.ndarray, into: Sums, back: Sums | None, skip: Callable[[slice, slice], np.ndarray | None] | None) -> None:
    """``add`` by the distance of each pair, on any positions."""
    if _radial(kernel):
        return _add_radial(kernel, x, q, sx, sq, into, back, skip)
    n, m = len(q), len(sq)
    columns = min(m, COLUMNS)
    step = max(1, TILE // max(columns, 1))

    def parts(d: list[np.ndarray], off: np.ndarray | None) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        if off is None:
            return kernel.parts(d)
        found = kernel.parts([np.where(off, 1.0, v) for v in d])
        for k, slopes in found:
            for v in (k, *slopes):
                v[off] = 0.0
        return found

    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for a in range(0, n, step):
            rows = slice(a, min(a + step, n))
            tx = [v[rows][:, None] for v in x]
            for b in range(0, m, columns):
                cols = slice(b, min(b + columns, m))
                d = [sv[cols][None] - tv for sv, tv in zip(sx, tx, strict=True)]
                off = skip(rows, cols) if skip else None
                found = parts(d, off)
                if kernel.singular and not all(np.isfinite(k.sum()) for k, _ in found):
                    same = np.logical_and.reduce([v == 0 for v in d])
                    found = parts(d, same if off is None else same | off)
                for value, component, field in kernel.channels:
                    k, slopes = found[component]
                    fq, tq = sq[cols, value], q[rows, value]
                    into[0][rows, field] += k @ fq
                    if back is not None:
                        back[0][cols, field] += tq @ k
                    for axis, v in enumerate(slopes if kernel.gradients else ()):
                        into[1][rows, field, axis] += v @ fq
                        if back is not None:
                            back[1][cols, field, axis] -= tq @ v


def _radial(kernel: Kernel) -> bool:
    """Whether the kernel gives its numbers by the squared distance; a subclass that changes ``field`` or ``parts`` goes by those."""
    if tuple(kernel.channels) != tuple((v, 0, v) for v in range(len(kernel.values))):
        return False
    while isinstance(kernel, Many):
        kernel = kernel.kernel
    own = next((c for c in type(kernel).__mro__ if c.__dict__.keys() & {"radial", "field", "parts"}), None)
    return own is not None and own is not Pairwise and "radial" in own.__dict__


def _add_radial(kernel: Kernel, x: Sequence[np.ndarray], q: np.ndarray, sx: Sequence[np.ndarray], sq: np.ndarray, into: Sums, back: Sums | None, skip: Callable[[slice, slice], np.ndarray | None] | None) -> None:
    """``add`` for radial kernels: every tile is worked out in the same few buffers, and all axes and values are summed at once."""
    n, m, dim, slopes = len(q), len(sq), len(x), kernel.gradients
    if not n or not m:
        return
    stretch = np.array(kernel.stretch or (1.0,) * dim)
    plain = bool((stretch == 1).all())
    columns = min(m, COLUMNS)
    step = min(n, max(1, TILE // columns))
    room, flat = np.empty((dim, step * columns)), [np.empty(step * columns) for _ in range(3)]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for a in range(0, n, step):
            rows = slice(a, min(a + step, n))
            tx, tq = [v[rows][:, None] for v in x], q[rows]
            for b in range(0, m, columns):
                cols = slice(b, min(b + columns, m))
                shape = rows.stop - rows.start, cols.stop - cols.start
                size = shape[0] * shape[1]
                d = room.reshape(-1)[: dim * size].reshape(dim, *shape)
                r2, k, pull = (v[:size].reshape(shape) for v in flat)
                for axis in range(dim):
                    np.subtract(sx[axis][cols][None], tx[axis], out=d[axis])
                    if not plain:
                        np.multiply(d[axis], stretch[axis], out=d[axis])
                    np.multiply(d[axis], d[axis], out=k if axis else r2)
                    if axis:
                        np.add(r2, k, out=r2)
                off = skip(rows, cols) if skip else None
                if off is not None:
                    r2[off] = 1.0
                kernel.radial(r2, k, pull if slopes else None)
                if kernel.singular and not np.isfinite(k.sum()):
                    same = (d == 0).all(0)
                    off = same if off is None else same | off
                    r2[off] = 1.0
                    kernel.radial(r2, k, pull if slopes else None)
                if off is not None:
                    k[off] = 0.0
                into[0][rows] += k @ sq[cols]
                if back is not None:
                    back[0][cols] += (tq.T @ k).T
                if not slopes:
                    continue
                if off is not None:
                    pull[off] = 0.0
                np.multiply(d, pull, out=d)
                into[1][rows] += np.moveaxis((d.reshape(-1, shape[1]) @ sq[cols]).reshape(dim, shape[0], -1), 0, 2) * stretch
                if back is not None:
                    back[1][cols] -= np.moveaxis(np.matmul(tq.T, d), (0, 1, 2), (2, 1, 0)) * stretch


def _tensor(kernel: Kernel) -> bool:
    """Whether the kernel is delta_ij k(r) - r_i r_j pull(r), both given by the squared distance."""
    own = next((c for c in type(kernel).__mro__ if c.__dict__.keys() & {"radial", "field", "parts"}), None)
    return bool(getattr(kernel, "tensor", False)) and own is not None and "radial" in own.__dict__


def _moments(x: np.ndarray, q: np.ndarray, degree: int) -> np.ndarray:
    """Charges times the powers of the position up to ``degree``: a column for each power and value."""
    powers = [np.ones(len(x)), *(x.T if degree else ()), *((x[:, a] * x[:, b] for a, b in combinations_with_replacement(range(x.shape[1]), 2)) if degree > 1 else ())]
    return np.concatenate([p[:, None] * q for p in powers], 1)


def _log_sums(r2: np.ndarray, axis: int, most: int, rooms: Sequence[np.ndarray]) -> np.ndarray:
    """Sums over an axis of ln(r2), as logarithms of products of ``most`` numbers at most, worked out in two buffers in turn."""
    taken, at = 1, lambda first, last: (slice(first, last), slice(None)) if axis == 0 else (slice(None), slice(first, last))
    while (n := r2.shape[axis]) > 1 and 2 * taken + n % 2 <= most:
        half, odd = divmod(n, 2)
        taken, rooms, last = 2 * taken + odd, rooms[::-1], r2[at(n - 1, n)]
        shape = (half, r2.shape[1]) if axis == 0 else (r2.shape[0], half)
        r2 = np.multiply(r2[at(0, half)], r2[at(half, 2 * half)], out=rooms[0][: shape[0] * shape[1]].reshape(shape))
        if odd:
            r2[at(0, 1)] *= last
    return np.log(r2).sum(axis)


def _add_on_grid(kernel: Kernel, x: Sequence[np.ndarray], q: np.ndarray, sx: Sequence[np.ndarray], sq: np.ndarray, into: Sums, back: Sums | None, skip: Callable[[slice, slice], np.ndarray | None] | None) -> bool:
    """``add`` by products of matrices, for positions on a grid of 2**24 steps (stretched); False: they are not, and nothing is done.

    On a grid the squared distances come from one product of matrices without
    any rounding.  What is linear (forces) or quadratic (tensors) in the
    distance is summed as moments of the sources and put together afterwards;
    pairs that are close against the extent, where that would cancel, are taken
    out of the moments and summed by their distances.
    """
    n, m, dim = len(q), len(sq), len(x)
    tensor = _tensor(kernel)
    degree = 2 if tensor else 1 if kernel.gradients else 0
    stretch = np.array(kernel.stretch or (1.0,) * dim)
    t, s = (np.stack([np.asarray(v, float) * w for v, w in zip(p, stretch, strict=True)], 1) for p in (x, sx))
    low, high = np.minimum(t.min(0), s.min(0)), np.maximum(t.max(0), s.max(0))
    exponent = int(np.frexp(np.maximum(np.abs(low), np.abs(high)).max())[1])
    grid = 2.0 ** (exponent - 24)
    if not all(np.isfinite(v).all() and (v / grid == np.rint(v / grid)).all() for v in (t, s)):
        return False
    centre = np.rint((low + high) / 2 / grid) * grid
    t, s = t - centre, s - centre
    left, right = np.column_stack([t, (t * t).sum(1), np.ones(n)]), np.ascontiguousarray(np.column_stack([-2 * s, np.ones(m), (s * s).sum(1)]).T)
    limit = (max(np.abs(t).max(), np.abs(s).max()) / 8) ** 2 if degree else 0.0
    # numbers that a product can take before it could leave the range of doubles
    factor, most = getattr(kernel, "logarithmic", None), 1000 // (2 * max(24 - exponent, exponent) + 6)
    by_products = factor is not None and not degree and most > 1 and all((v == v[0]).all() for v in (q, sq))
    w_t, w_s = (np.ascontiguousarray(_moments(p, v, degree).T) for p, v in ((t, q), (s, sq)))
    sums_t, sums_s = np.zeros((n, len(w_s) if degree else 0)), np.zeros((len(w_t) if degree else 0, m))
    pot_t, pot_s = np.zeros((n, q.shape[1])), np.zeros((q.shape[1], m))
    close: list[tuple[np.ndarray, ...]] = []
    kept = 0

    def settle() -> None:
        """Adds what close pairs do to each other."""
        i, j, pull = (np.concatenate(v) for v in zip(*close, strict=True))
        close.clear()
        d = s[j] - t[i]
        for (mine, theirs, sign), at, size in zip(((into, sq[j], 1.0), (back, q[i], -1.0)), (i, j), (n, m), strict=True):
            if mine is None:
                continue
            if tensor:
                for value, component, field in kernel.channels:
                    a, b = kernel.PAIRS[component]
                    mine[0][:, field] -= np.bincount(at, pull * d[:, a] * d[:, b] * theirs[:, value], size)
            else:
                for value in range(q.shape[1]):
                    for axis in range(dim):
                        mine[1][:, value, axis] += np.bincount(at, pull * d[:, axis] * theirs[:, value], size) * (sign * stretch[axis])

    columns = min(m, COLUMNS // 4)
    step = max(1, min(n, TILE // columns))
    room = [np.empty(step * columns) for _ in range(3)]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for a in range(0, n, step):
            rows = slice(a, min(a + step, n))
            for b in range(0, m, columns):
                cols = slice(b, min(b + columns, m))
                shape = rows.stop - rows.start, cols.stop - cols.start
                r2, k, pull = (v[: shape[0] * shape[1]].reshape(shape) for v in room)
                np.matmul(left[rows], right[:, cols], out=r2)
                off = skip(rows, cols) if skip else None
                near = np.flatnonzero(r2.reshape(-1) < limit) if degree else np.zeros(0, int)
                if len(near) * 16 > r2.size:
                    away = None if off is None else lambda r, c, off=off: off[r, c] if off[r, c].any() else None
                    part = lambda of, at: None if of is None else (of[0][at], of[1][at])
                    _add_apart(kernel, [v[rows] for v in x], q[rows], [v[cols] for v in sx], sq[cols], part(into, rows), part(back, cols), away)
                    continue
                if kernel.singular and (r2.reshape(-1)[near] if degree else r2).min(initial=1.0) == 0:
                    off = r2 == 0 if off is None else off | (r2 == 0)
                if off is not None:
                    r2[off] = 1.0
                if by_products:
                    pot_t[rows] += _log_sums(r2, 1, most, room[1:])[:, None] * (factor * sq[0])
                    if back is not None:
                        pot_s[:, cols] += _log_sums(r2, 0, most, room[1:]) * (factor * q[0])[:, None]
                    continue
                kernel.radial(r2, k, pull if degree else None)
                if off is not None:
                    k[off] = 0.0
                pot_t[rows] += k @ sq[cols]
                if back is not None:
                    pot_s[:, cols] += q[rows].T @ k
                if not degree:
                    continue
                if off is not None:
                    pull[off] = 0.0
                if len(near):
                    i, j = np.divmod(near, shape[1])
                    close.append((i + rows.start, j + cols.start, pull.reshape(-1)[near]))
                    pull.reshape(-1)[near] = 0.0
                    kept += len(near)
                    if kept > CLOSE:
                        settle()
                        kept = 0
                sums_t[rows] += pull @ w_s[:, cols].T
                if back is not None:
                    sums_s[:, cols] += w_t[:, rows] @ pull
        if close:
            settle()
    for mine, pot, sums, at in ((into, pot_t, sums_t, t), (back, pot_s.T, sums_s.T, s)):
        if mine is None:
            continue
        if not tensor:
            mine[0][:] += pot
        moments = sums.reshape(len(at), -1, q.shape[1])
        if tensor:
            order = list(combinations_with_replacement(range(dim), 2))
            for value, component, field in kernel.channels:
                a, b = kernel.PAIRS[component]
                one = moments[:, :, value]
                second = one[:, 1 + dim + order.index((a, b))] - at[:, a] * one[:, 1 + b] - at[:, b] * one[:, 1 + a] + at[:, a] * at[:, b] * one[:, 0]
                mine[0][:, field] += (pot[:, value] if a == b else 0.0) - second
        elif degree:
            mine[1][:] += np.stack([moments[:, 1 + axis] - at[:, [axis]] * moments[:, 0] for axis in range(dim)], 2) * stretch
    return True


def nothing(kernel: Kernel, n: int, dim: int) -> Sums:
    return np.zeros((n, kernel.fields)), np.zeros((n, kernel.fields, dim if kernel.gradients else 0))


def _equal(ids: np.ndarray, others: np.ndarray) -> Callable[[slice, slice], np.ndarray | None] | None:
    """What marks pairs of equal ids in a tile."""
    order = np.argsort(others, kind="stable")
    low, high = (np.searchsorted(others[order], ids, side) for side in ("left", "right"))
    i = np.repeat(np.arange(len(ids)), high - low)
    if not len(i):
        return None
    j = order[np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True) if b > a])]

    def skip(rows: slice, cols: slice) -> np.ndarray | None:
        at = slice(*np.searchsorted(i, (rows.start, rows.stop)))
        r, c = i[at], j[at]
        inside = (c >= cols.start) & (c < cols.stop)
        if not inside.any():
            return None
        off = np.zeros((rows.stop - rows.start, cols.stop - cols.start), bool)
        off[r[inside] - rows.start, c[inside] - cols.start] = True
        return off

    return skip


def direct(targets: DataFrame, sources: DataFrame, cfg: SpatialConfig, kernel: Kernel, same: bool, far: bool = False, fine: bool = False) -> DataFrame:
    """All pairs (``far``: only those of leaves that are no neighbours), images included: what expansions are held against.

    Quadratic by definition.  Particles are dealt into chunks, and every two
    chunks meet in one group, whose memory does not depend on the sets' sizes.
    If targets and sources are one table, each pair is evaluated once and adds
    to both.  Null positions take no part; a target without sources has zeros.
    ``fine``: the sums of the groups add up without rounding, down to 2**-16, and what is finer by itself.
    """
    if not getattr(kernel, "batched", False):
        return _by_columns(targets, sources, cfg, kernel, same, far)
    axes, values, dim = list(cfg.axes), list(kernel.values), cfg.dim
    low, high = cfg.image_interval
    mutual = same and targets is sources and low == -high
    images = list(product(range(low, high + 1), repeat=dim))

    def slim(df: DataFrame) -> DataFrame:
        here = F.lit(True)
        for a in axes:
            here = here & F.col(a).isNotNull()
        return df.where(here).select(F.col("pid").cast("bigint").alias("pid"), *(F.col(c).cast("double").alias(c) for c in (*axes, *values)))

    def chunks(df: DataFrame) -> tuple[int, DataFrame]:
        n = df.count()
        return max(1, ceil(n / CHUNK), min(CHUNKS, ceil(n * sqrt(len(images)) / FEW))), df

    n_t, t = chunks(slim(targets))
    n_s, s = (n_t, t) if targets is sources else chunks(slim(sources))

    def chunk(n: int) -> Column:
        """By pid; for far pairs by leaf first, whose particles meet the same ones, in shares of a leaf that is a set by itself."""
        return F.pmod(F.hash(*ix.boxes_of(cfg), F.pmod(F.hash("pid"), F.lit(n // CHUNKS + 1))) if far else F.hash("pid"), F.lit(n))

    every = lambda first, last: F.explode(F.sequence(first, last))
    zero = F.lit(0)
    left = t.withColumn("_a", chunk(n_t)).withColumn("_b", every(F.col("_a") if mutual else zero, F.lit(n_s - 1))).withColumn("_source", F.lit(False))
    right = s.withColumn("_b", chunk(n_s)).withColumn("_a", every(zero, F.col("_b") if mutual else F.lit(n_t - 1))).withColumn("_source", F.lit(True))
    # Pairs are the work, not the rows: a fixed number keeps the groups from being merged into a few tasks.  Few groups
    # a task keep tasks even.
    tasks = min(4 * int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_t * (n_t + 1) // 2 if mutual else n_t * n_s)
    rows = left.unionByName(right).repartition(tasks, "_a", "_b")
    corner, widths, side = np.array(cfg.corner), np.array(cfg.leaf_widths), cfg.boxes_at(cfg.leaf_level)

    def boxes(x: Sequence[np.ndarray]) -> np.ndarray:
        return np.stack([np.minimum(np.floor((v - c) / w), side - 1).astype(np.int64) for v, c, w in zip(x, corner, widths, strict=True)], 1)

    def meetings(box: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the targets of a leaf, and of the sources of all leaves that are not around it; so no particle meets itself."""
        leaves, at = np.unique(box, axis=0, return_inverse=True)
        theirs, of = np.unique(other, axis=0, return_inverse=True)
        order, of = np.argsort(at.reshape(-1), kind="stable"), of.reshape(-1)
        bounds = np.searchsorted(at.reshape(-1)[order], np.arange(len(leaves) + 1))
        for k, leaf in enumerate(leaves):
            away = np.abs(theirs - leaf).max(1) > 1
            yield order[bounds[k] : bounds[k + 1]], np.flatnonzero(away[of])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        source = group["_source"].to_numpy(bool)
        p, o = group[~source], group[source]
        if not len(p):
            return pd.DataFrame({"pid": np.array([], np.int64), **{c: [] for c in kernel.outputs}})
        both = mutual and p["_a"].iloc[0] != p["_b"].iloc[0]
        x, q, ids = [p[a].to_numpy() for a in axes], p[values].to_numpy().astype(float), p["pid"].to_numpy()
        sx, sq, others = [o[a].to_numpy() for a in axes], o[values].to_numpy().astype(float), o["pid"].to_numpy()
        into, back = nothing(kernel, len(p), dim), nothing(kernel, len(o), dim) if both else None
        for image in images:
            moved = [v + k * w for v, k, w in zip(sx, image, cfg.widths, strict=True)] if any(image) else sx
            if not far:
                add(kernel, x, q, moved, sq, into, back, _equal(ids, others) if same and not any(image) else None)
                continue
            for mine, theirs in meetings(boxes(x), boxes(sx) + np.array(image) * side):
                part, other = nothing(kernel, len(mine), dim), nothing(kernel, len(theirs), dim) if both else None
                add(kernel, [v[mine] for v in x], q[mine], [v[theirs] for v in moved], sq[theirs], part, other)
                for total, v in zip(into, part, strict=True):
                    total[mine] += v
                for total, v in zip(back or (), other or (), strict=True):
                    total[theirs] += v
        out = pd.DataFrame({"pid": ids, **kernel.results(*into, q)})
        return out if back is None else pd.concat([out, pd.DataFrame({"pid": others, **kernel.results(*back, sq)})])

    parts = rows.groupBy("_a", "_b").applyInPandas(run, ", ".join(["pid bigint", *(f"{c} double" for c in kernel.outputs)]))
    coarse = lambda c: F.rint(F.col(c) * 65536) / 65536
    total = lambda c: F.sum(coarse(c)) + F.sum(F.col(c) - coarse(c)) if fine else F.sum(c)
    return parts.groupBy("pid").agg(*(total(c).alias(c) for c in kernel.outputs))


def _by_columns(targets: DataFrame, sources: DataFrame, cfg: SpatialConfig, kernel: Kernel, same: bool, far: bool) -> DataFrame:
    """The same for kernels that give their pairs as columns only; refused beyond ``DIRECT_SOURCES``."""
    if sources.count() > DIRECT_SOURCES:
        raise ValueError(f"direct sums by columns are for at most {DIRECT_SOURCES} sources")
    columns = ("pid", *cfg.axes, *kernel.values)
    rows = targets.select(*columns).crossJoin(F.broadcast(sources.select(*(F.col(c).alias(f"s_{c}") for c in columns))))
    here = F.lit(True)
    if cfg.periodic:
        low, high = cfg.image_interval
        for a, w in zip(cfg.axes, cfg.widths, strict=True):
            rows = rows.withColumn(f"w_{a}", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(f"s_{a}", F.col(f"s_{a}") + F.col(f"w_{a}") * w)
            here = here & (F.col(f"w_{a}") == 0)
    if same:
        rows = rows.where(~((F.col("pid") == F.col("s_pid")) & here))
    if far:
        near = F.lit(True)
        for b, s in zip(ix.boxes_of(cfg), ix.boxes_of(cfg, [F.col(f"s_{a}") for a in cfg.axes]), strict=True):
            near = near & (F.abs(b - s) <= 1)
        rows = rows.where(~near)
    rows, d = staged(rows, kernel, "p2p", [F.col(f"s_{a}") - F.col(a) for a in cfg.axes])
    q = [F.col(f"{p}q") if kernel.values == ("q",) else {v: F.col(f"{p}{v}") for v in kernel.values} for p in ("", "s_")]
    return rows.groupBy("pid").agg(*(F.sum(e).alias(k) for k, e in kernel.p2p(d, *q).items()))
