"""Query plans: upward, transfer, downward and near field as joins and sums.

The kernels re-centre exactly, so no plan loops over levels: all moments come
from one roll-up of the leaves, and each leaf gathers the locals of all its
ancestors at once.  Particles are read twice, to make the leaves and to take
the results; in between are tables of cells, each computed once, and a number
of shuffles that does not depend on the height.

A query on one set is a query of the set against itself in which a particle
does not meet itself; sources and targets are always two tables here.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..config import Ops, SpatialConfig
from ..functions import index as ix
from ..functions.kernels import Kernel
from ..operators import interactions, tree
from . import periodic
from .pairs import direct
from ..staging import once, staged

__all__ = ["Query", "direct"]

#: Source particles that a near field broadcasts, at most, and source cells: some tens of MB.
BROADCAST_SOURCES, BROADCAST_CELLS = 500_000, 100_000


def _cols(names, prefix: str = "") -> dict[str, Column]:
    return {n: F.col(f"{prefix}{n}") for n in names}


@dataclass
class Query:
    """A query over ``targets`` and ``sources`` (pid, axes and the kernel's values; other columns are ignored).

    A ``q`` that is missing is 1.  ``data`` is a table of the user's own, keyed
    by pid, that brings the kernel's values instead of the particles, which
    then are positions with an id; a particle without a row there is an error.

    ``sources=None`` makes it a query of one set.  pid is a key.  Null positions have no box
    and take no part; a position outside the box fails the query.  Points that
    coincide do nothing to each other under singular kernels.

    ``ops`` names the stages that run, and what they would hand on to others is
    lost: without M2M only leaves have moments, without L2L only the locals of
    the leaves themselves reach particles.
    """

    cfg: SpatialConfig
    kernel: Kernel
    targets: DataFrame
    sources: DataFrame | None = None
    ops: Ops = Ops.ALL
    data: DataFrame | None = None

    def __post_init__(self) -> None:
        self.same = self.sources is None
        self.t = self._encoded(self.targets)
        self.s = self.t if self.same else self._encoded(self.sources)

    def _encoded(self, df: DataFrame) -> DataFrame:
        """With leaf boxes; a position outside the box is an error."""
        rows, n = tree.encode(self._slim(df), self.cfg), self.cfg.boxes_at(self.cfg.leaf_level)
        outside = F.raise_error(F.concat_ws(" ", F.lit("outside the box: particle"), F.col("pid").cast("string"))).cast("bigint")
        return rows.withColumns({b: F.when(F.col(b).between(0, n - 1), F.col(b)).otherwise(outside) for b in self.cfg.boxes})

    def _slim(self, df: DataFrame) -> DataFrame:
        inside, values = F.lit(True), self.kernel.values
        for a in self.cfg.axes:
            inside = inside & F.col(a).isNotNull()
        if self.data is not None:
            own = self.data.select(F.col("pid").alias("of"), *values, F.lit(True).alias("known"))
            rows = df.select("pid", *self.cfg.axes).where(inside).join(own, F.col("pid") == F.col("of"), "left")
            known = F.when(F.col("known"), F.col("pid")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no data of particle"), F.col("pid").cast("string"))).cast("bigint"))
            return rows.select(known.alias("pid"), *self.cfg.axes, *values)
        if values == ("q",) and "q" not in df.columns:
            df = df.withColumn("q", F.lit(1.0))
        return df.select("pid", *self.cfg.axes, *values).where(inside)

    def _values(self, prefix: str = "") -> Column | dict[str, Column]:
        """What the kernel's methods get of a particle."""
        return F.col(f"{prefix}q") if self.kernel.values == ("q",) else {v: F.col(f"{prefix}{v}") for v in self.kernel.values}

    def _centres(self, boxes: list[Column], level: Column) -> list[Column]:
        return [ix.centre_of(b, k, self.cfg, level) for k, b in enumerate(boxes)]

    def _boxes(self, prefix: str = "") -> list[Column]:
        return [F.col(f"{prefix}{b}") for b in self.cfg.boxes]

    def _level_width(self, axis: int) -> Column:
        return F.lit(self.cfg.widths[axis]) / F.expr("shiftleft(1L, CAST(level AS int))").cast("double")

    # Tables of cells that several stages read

    @cached_property
    def leaves(self) -> DataFrame:
        """Moments of the sources' leaves."""
        return self.kernel.finish("p2m", self.p2m, True)

    @cached_property
    def target_leaves(self) -> DataFrame:
        """Boxes of the targets' leaves."""
        if self.same and self.kernel.moments:
            return self.leaves.select(*self.cfg.boxes)
        return once(self.t.select(*self.cfg.boxes).distinct())

    @cached_property
    def cells(self) -> DataFrame:
        """Moments of the cells of all far levels."""
        return self.kernel.finish("m2m", self.m2m, True)

    @cached_property
    def locals_(self) -> DataFrame:
        """Locals of the target cells from their lists."""
        return self.kernel.finish("m2l", self.m2l, True)

    @cached_property
    def leaf_locals(self) -> DataFrame:
        """Locals of the target leaves with all that comes down to them."""
        return self.kernel.finish("l2l", self._leaf_locals, True)

    def _leaf_locals(self) -> DataFrame:
        return self.kernel.watch("l2p", self._gather([self.cfg.leaf_level]), l2p=F.count(F.lit(1)))

    def _kept(self, name: str, plan) -> DataFrame:
        """A table that has been computed already, or the plan of it."""
        return self.__dict__[name] if name in self.__dict__ else plan()

    def _all_cells(self, leaves: DataFrame, levels) -> DataFrame:
        return tree.roll_up(leaves, self.cfg, levels, {"n": F.lit(1)}).drop("n")

    # Stages

    def p2m(self) -> DataFrame:
        """Moments of the leaves."""
        c = self._centres(self._boxes(), F.lit(self.cfg.leaf_level))
        d = [F.col(a) - m for a, m in zip(self.cfg.axes, c, strict=True)]
        rows, d = staged(self.s, self.kernel, "p2m", d)
        leaves = rows.groupBy(*self.cfg.boxes).agg(*(F.sum(e).alias(k) for k, e in self.kernel.p2m(d, self._values()).items()))
        return self.kernel.watch("p2m", leaves, p2m=F.count(F.lit(1)))

    def m2m(self, levels=None) -> DataFrame:
        """Moments of the cells of ``levels`` (all far levels, or more)."""
        if levels is None:
            levels = self.cfg.far_levels if self.ops & Ops.M2M else [self.cfg.leaf_level]
        leaf, up = self._centres(self._boxes(), F.lit(self.cfg.leaf_level)), self._centres(self._boxes("p_"), F.col("level"))
        rows, d = staged(tree.raised(self.leaves, self.cfg, list(levels)), self.kernel, "m2m", [a - b for a, b in zip(leaf, up, strict=True)])
        cells = tree.summed_up(rows, self.cfg, self.kernel.m2m(d, _cols(self.kernel.moments)))
        return self.kernel.watch("m2m", cells, m2m=F.count_if(F.col("level") > self.cfg.stop_level))

    def target_cells(self) -> DataFrame:
        return self._all_cells(self.target_leaves, self.cfg.far_levels)

    def m2l(self) -> DataFrame:
        """Locals of the cells, from their own interaction lists."""
        moments = self.cells
        cells = moments.select("level", *self.cfg.boxes) if self.same else self.target_cells()
        cells = self.kernel.watch("l2l", cells, l2l=F.count_if(F.col("level") > self.cfg.stop_level))
        pairs = interactions.m2l_list(cells, moments, self.cfg, moments.count() <= BROADCAST_CELLS)
        pairs = self.kernel.watch("m2l", pairs, m2l=F.count(F.lit(1)))
        d = [-F.col(x).cast("double") * self._level_width(k) for k, x in enumerate(interactions.DELTAS[: self.cfg.dim])]
        pairs, d = staged(pairs, self.kernel, "m2l", d)
        out = self.kernel.m2l(d, _cols(self.kernel.moments, "s_"))
        return pairs.groupBy("level", *self.cfg.boxes).agg(*(F.sum(e).alias(k) for k, e in out.items()))

    def _all_locals(self) -> DataFrame:
        out = self._kept("locals_", lambda: self.kernel.finish("m2l", self.m2l, False))
        if self.cfg.periodic and self.cfg.extra_levels >= 0 and self.ops & Ops.M2M and self.ops & Ops.L2L:
            out = out.unionByName(periodic.root_locals(self.m2m([0]), self.cfg, self.kernel))
        return out

    def _gather(self, levels: list[int]) -> DataFrame:
        """Sum of a cell's own and its ancestors' locals, for the cells of ``levels``."""
        start = 0 if self.cfg.periodic else self.cfg.stop_level
        cells = self._all_cells(self.target_leaves, levels)
        above = cells.withColumn("up", F.explode(F.sequence(F.lit(start) if self.ops & Ops.L2L else F.col("level"), F.col("level"))))
        for b in self.cfg.boxes:
            above = above.withColumn(f"p_{b}", F.expr(f"shiftright({b}, level - up)"))
        found = self._all_locals().select(F.col("level").alias("up"), *(F.col(b).alias(f"p_{b}") for b in self.cfg.boxes), *self.kernel.locals_)
        rows = above.join(found, ["up", *(f"p_{b}" for b in self.cfg.boxes)])
        low, high = self._centres(self._boxes(), F.col("level")), self._centres(self._boxes("p_"), F.col("up"))
        rows, d = staged(rows, self.kernel, "l2l", [a - b for a, b in zip(low, high, strict=True)])
        moved = self.kernel.l2l(d, _cols(self.kernel.locals_))
        return rows.groupBy("level", *self.cfg.boxes).agg(*(F.sum(e).alias(k) for k, e in moved.items()))

    def l2l(self) -> DataFrame:
        """Locals of all cells with what comes down to them."""
        return self._gather(list(self.cfg.far_levels))

    def l2p(self, all_targets: bool = False) -> DataFrame:
        """Far field of the particles; ``all_targets``: null where there is none, with the boxes."""
        leaves = self._kept("leaf_locals", lambda: self.kernel.finish("l2l", self._leaf_locals, False)).drop("level")
        rows = self.t.join(leaves, list(self.cfg.boxes), "left" if all_targets else "inner")
        c = self._centres(self._boxes(), F.lit(self.cfg.leaf_level))
        d = [F.col(a) - m for a, m in zip(self.cfg.axes, c, strict=True)]
        rows, d = staged(rows, self.kernel, "l2p", d)
        return rows.select("pid", *(self.cfg.boxes if all_targets else ()), *(e.alias(k) for k, e in self.kernel.l2p(d, _cols(self.kernel.locals_), self._values()).items()))

    def p2p(self) -> DataFrame:
        """Near field of the particles."""
        if self.kernel.by_count:
            return self._p2p_by_count()
        n_sources = self.s.count()
        if self.kernel.batched and n_sources >= self.kernel.batched_from:
            self._watch_batches()
            if self.cfg.leaf_level < 2 and not self.cfg.periodic:
                # all leaves are neighbours: two chunks of particles meet once, where blocks of leaves would copy them for each share
                placed = [df.where(" AND ".join(f"{b} IS NOT NULL" for b in self.cfg.boxes)) for df in ((self.t,) if self.same else (self.t, self.s))]
                return direct(placed[0], placed[-1], self.cfg, self.kernel, self.same)
            from .arrays import ArrayQuery, NearOnly  # which is made of this class

            return ArrayQuery(self.cfg, NearOnly(self.kernel), self.targets, self.sources, Ops.NEAR, self.data).execute()
        # Pairs are the work, not the rows: targets are dealt evenly, whatever files or leaves they come from.
        # A fixed number keeps small tables from being merged into one task, and pid is what the sum groups by.
        n = int(self.t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        small = n_sources <= BROADCAST_SOURCES
        pairs = interactions.particle_pairs(self.t.repartition(n, "pid"), self.s, self.cfg, self.same, small)
        d = [F.col(f"s_{a}") - F.col(a) for a in self.cfg.axes]
        own = F.greatest(F.lit(0), *(F.abs(x) for x in interactions.DELTAS[: self.cfg.dim])) == 0
        pairs = self.kernel.watch("p2p", pairs, p2p=F.floor(F.count_if(~own) / (2 if self.same else 1)), p2p_inner=F.count_if(own))
        pairs, d = staged(pairs, self.kernel, "p2p", d)
        out = self.kernel.p2p(d, self._values(), self._values("s_"))
        return pairs.groupBy("pid").agg(*(F.sum(e).alias(k) for k, e in out.items()))

    def _watch_batches(self) -> None:
        """Pairs that go in batches are counted from the leaves' lists, if anyone looks on."""
        counted = lambda rows, name: rows.groupBy(*self.cfg.boxes).agg(F.count(F.lit(1)).alias(name))
        pairs = interactions.neighbour_list(counted(self.t, "t_n"), counted(self.s, "n"), self.cfg)
        own, n = F.greatest(F.lit(0), *(F.abs(x) for x in interactions.DELTAS[: self.cfg.dim])) == 0, F.col("t_n") * F.col("s_n")
        count = lambda which, v: F.coalesce(F.sum(F.when(which, v)), F.lit(0)).cast("bigint")
        watched = self.kernel.watch("p2p", pairs, p2p=F.floor(count(~own, n) / (2 if self.same else 1)), p2p_inner=count(own, n - F.col("t_n") if self.same else n))
        if watched is not pairs:
            watched.write.format("noop").mode("overwrite").save()

    def _near_counts(self) -> DataFrame:
        """Counts need the leaves only: boxes and n, no pair of particles is made."""
        sources = self.leaves.withColumnRenamed(self.kernel.moments[0], "n")
        targets = self.leaves.withColumnRenamed(self.kernel.moments[0], "t_n") if self.same else self.target_leaves.withColumn("t_n", F.lit(None).cast("bigint"))
        pairs = interactions.neighbour_list(targets, sources, self.cfg, small=self.leaves.count() <= BROADCAST_CELLS)
        middle, n = (3**self.cfg.dim) // 2, F.col("t_n") * F.col("s_n")
        count = lambda which, v: F.coalesce(F.sum(F.when(which, v)), F.lit(0)).cast("bigint")
        near = self.kernel.watch("p2p", pairs, p2p=count(F.col("code") > middle, n), p2p_inner=count(F.col("code") == middle, n - F.col("t_n"))).groupBy(*self.cfg.boxes)
        return near.agg((F.sum("s_n") - (1 if self.same else 0)).alias("n"))

    def _p2p_by_count(self) -> DataFrame:
        return self.t.join(self._near_counts(), list(self.cfg.boxes)).select("pid", F.col("n").alias(self.kernel.outputs[0]))

    def far_wanted(self) -> bool:
        """Whether the stages of ``ops`` bring anything from afar to particles."""
        if not self.ops & (Ops.P2P | Ops.L2P):
            raise ValueError("these stages end in cells: see moments and locals")
        chain = Ops.P2M | Ops.M2L | Ops.L2P
        return self.ops & chain == chain and len(self.cfg.far_levels) > 0

    def execute(self) -> DataFrame:
        """pid and outputs of every target; zero where nothing acts on it."""
        outputs, far = self.kernel.outputs, self.far_wanted() and self.kernel.moments
        zero = F.lit(0).cast("bigint" if self.kernel.by_count else "double")
        rows = self.kernel.finish("l2p", lambda: self.l2p(all_targets=True), False) if far else self.t.select("pid", *self.cfg.boxes, *(zero.alias(o) for o in outputs))
        rows = rows.select("pid", *self.cfg.boxes, *(F.coalesce(o, zero).alias(o) for o in outputs))
        if self.ops & Ops.P2P and self.kernel.by_count:
            rows = rows.join(self.kernel.finish("p2p", self._near_counts, False), list(self.cfg.boxes), "left").withColumn(outputs[0], F.col(outputs[0]) + F.coalesce("n", zero))
        rows = rows.select("pid", *outputs)
        if self.ops & Ops.P2P and not self.kernel.by_count:
            rows = rows.unionByName(self.kernel.finish("p2p", self.p2p, False)).groupBy("pid").agg(*(F.sum(o).alias(o) for o in outputs))
        return rows
