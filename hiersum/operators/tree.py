"""Tree tables: particles with leaf boxes, cells of all levels, blocks, look-ups and rebuilds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import SpatialConfig
from ..functions import index as ix
from ..staging import once


def encode(particles: DataFrame, cfg: SpatialConfig) -> DataFrame:
    """Adds the leaf box of each particle, one column per axis."""
    return particles.withColumns(dict(zip(cfg.boxes, ix.boxes_of(cfg), strict=True)))


def leaf_index(particles: DataFrame, cfg: SpatialConfig, name: str = "leaf") -> DataFrame:
    """Adds the Morton index of the leaf box."""
    return encode(particles, cfg).withColumn(name, ix.morton([F.col(b) for b in cfg.boxes], cfg.leaf_level))


def raised(leaves: DataFrame, cfg: SpatialConfig, levels: Sequence[int]) -> DataFrame:
    """Each leaf row once per level, with ``level`` and the boxes of the ancestor there (``p_``)."""
    at = leaves.withColumn("level", F.explode(F.array(*(F.lit(v) for v in levels))))
    return at.withColumns({f"p_{b}": F.expr(f"shiftright({b}, {cfg.leaf_level} - level)") for b in cfg.boxes})


def summed_up(rows: DataFrame, cfg: SpatialConfig, sums: dict[str, Column]) -> DataFrame:
    """Raised rows, aggregated by cell."""
    return rows.groupBy("level", *(F.col(f"p_{b}").alias(b) for b in cfg.boxes)).agg(*(F.sum(e).alias(k) for k, e in sums.items()))


def roll_up(leaves: DataFrame, cfg: SpatialConfig, levels: Sequence[int], sums: dict[str, Column]) -> DataFrame:
    """Aggregate leaf rows into the cells of all ``levels`` at once: one shuffle whatever the height."""
    return summed_up(raised(leaves, cfg, levels), cfg, sums)


def leaf_counts(particles: DataFrame, cfg: SpatialConfig) -> DataFrame:
    """One row per leaf with a particle: boxes and n."""
    return encode(particles, cfg).groupBy(*cfg.boxes).agg(F.count(F.lit(1)).alias("n"))


def cells(particles: DataFrame, cfg: SpatialConfig, levels: Sequence[int] | None = None) -> DataFrame:
    """level, boxes, n of every cell that holds a particle."""
    return roll_up(leaf_counts(particles, cfg), cfg, levels if levels is not None else range(cfg.height), {"n": F.col("n")})


def with_index(rows: DataFrame, cfg: SpatialConfig, name: str = "cell") -> DataFrame:
    """Adds the Morton index; the bits above a level's are zero, so one width fits all levels."""
    return rows.withColumn(name, ix.morton([F.col(b) for b in cfg.boxes], max(cfg.leaf_level, 1)))


def leaf_histogram(particles: DataFrame, cfg: SpatialConfig) -> DataFrame:
    """leaf, n, and the offset of its first particle in leaf order."""
    leaves = with_index(leaf_counts(particles, cfg), cfg, "leaf").select("leaf", "n")
    return running(leaves, ["leaf"], "n", "offset").select("leaf", "n", "offset")


def running(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before, in the order of ``keys``.

    Rows are dealt to ranges; the sum of each range (one row) goes to the
    driver and comes back as the range's start, and windows run within ranges.
    """
    ranged = once(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    start, starts = 0, []
    for part, total in sorted(map(tuple, ranged.groupBy("_range").agg(F.sum(value)).collect())):
        starts.append((part, start))
        start += total
    begins = F.broadcast(rows.sparkSession.createDataFrame(starts, "_range int, _start bigint"))
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(*keys)) - F.col(value)
    return ranged.join(begins, "_range").withColumn(name, F.col("_start") + inside).drop("_range", "_start")


def blocks(particles: DataFrame, cfg: SpatialConfig, size: int) -> DataFrame:
    """leaf, n, block, rank in block, offset in block: ``size`` consecutive leaves make a block."""
    leaves = with_index(leaf_counts(particles, cfg), cfg, "leaf").select("leaf", "n")
    placed = running(leaves.withColumn("one", F.lit(1)), ["leaf"], "one", "at").withColumn("block", F.floor(F.col("at") / size)).withColumn("in_block", F.col("at") % size)
    return placed.withColumn("offset", F.sum("n").over(Window.partitionBy("block").orderBy("leaf")) - F.col("n")).select("leaf", "n", "block", "in_block", "offset")


def ordered_blocks(leaves: DataFrame, key: Column, size: int) -> DataFrame:
    """Leaves with ``key``, ``block`` and ``in_block``: ``size`` consecutive leaves in the order of the key make a block."""
    placed = running(leaves.withColumns({"key": key, "one": F.lit(1)}), ["key"], "one", "at")
    return placed.withColumns({"block": F.floor(F.col("at") / size), "in_block": F.col("at") % size}).drop("one", "at")


def level_blocks(particles: DataFrame, cfg: SpatialConfig, size: int) -> DataFrame:
    """level, cell, block, in_block: ``size`` consecutive cells of a level make a block, at every level."""
    existing = with_index(cells(particles, cfg), cfg).select("level", "cell", F.lit(1).alias("one"))
    ranked = running(existing, ["level", "cell"], "one", "at")
    begins = F.broadcast(ranked.groupBy("level").agg(F.min("at").alias("first")))  # one row a level
    placed = ranked.join(begins, "level").withColumn("k", F.col("at") - F.col("first"))
    return placed.select("level", "cell", F.floor(F.col("k") / size).alias("block"), (F.col("k") % size).alias("in_block"))


def parent_blocks(leaf_blocks: DataFrame, dim: int) -> DataFrame:
    """parent, block: one group of parents for each group of children; a shared parent goes to the first."""
    return leaf_blocks.groupBy(ix.parent(F.col("leaf"), dim).alias("parent")).agg(F.min("block").alias("block"))


def ancestor_blocks(leaf_blocks: DataFrame, cfg: SpatialConfig) -> DataFrame:
    """level, cell, block: one group of parents for each group of children, from the leaves up to the root.

    A cell goes where its first child goes, and so to the block of its first leaf.
    """
    at = leaf_blocks.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(cfg.leaf_level))))
    return at.groupBy("level", F.expr(f"shiftright(leaf, {cfg.dim} * ({cfg.leaf_level} - level))").alias("cell")).agg(F.min("block").alias("block"))


def block_summary(leaf_blocks: DataFrame) -> DataFrame:
    """Header of each block."""
    return leaf_blocks.groupBy("block").agg(F.min("leaf").alias("first_leaf"), F.max("leaf").alias("last_leaf"), F.count(F.lit(1)).alias("n_leaves"), F.sum("n").alias("n_particles"))


def block_size_estimate(particles: DataFrame, cfg: SpatialConfig, threads: int, targets: DataFrame | None = None) -> DataFrame:
    """Leaves (of both sets, if there are two) over twice the threads, at least 1; cfg.block_size overrides."""
    leaves = leaf_counts(particles, cfg).select(*cfg.boxes)
    if targets is not None:
        leaves = leaves.unionByName(leaf_counts(targets, cfg).select(*cfg.boxes)).distinct()
    found = leaves.agg(F.count(F.lit(1)).alias("n_leaves"))
    size = F.lit(cfg.block_size) if cfg.block_size else F.greatest(F.lit(1), F.floor(F.col("n_leaves") / (2 * threads)))
    return found.select("n_leaves", size.cast("bigint").alias("block_size"))


def find_in_blocks(wanted: DataFrame, leveled: DataFrame) -> DataFrame:
    """Adds block and in_block of rows (level, cell) from ``level_blocks``; null where there is no such cell."""
    return wanted.join(leveled.select("level", "cell", "block", "in_block"), ["level", "cell"], "left")


def children_in_blocks(leveled: DataFrame, dim: int) -> DataFrame:
    """level, parent, block, first, n: where in each block of the level below the children of a parent stand, one after another."""
    low = leveled.where("level > 0").withColumn("level", F.col("level") - 1)
    return low.groupBy("level", ix.parent(F.col("cell"), dim).alias("parent"), "block").agg(F.min("in_block").alias("first"), F.count(F.lit(1)).alias("n"))


def find_cells(wanted: DataFrame, existing: DataFrame, cfg: SpatialConfig) -> DataFrame:
    """Adds ``found`` to rows (level, cell): whether that cell exists."""
    have = with_index(existing, cfg).select("level", "cell", F.lit(True).alias("found"))
    return wanted.join(have, ["level", "cell"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def parent_child(existing: DataFrame, cfg: SpatialConfig) -> DataFrame:
    """level, parent, child, slot: a row for each cell below the root."""
    low = with_index(existing.where("level > 0"), cfg, "child")
    return low.select((F.col("level") - 1).alias("level"), ix.parent(F.col("child"), cfg.dim).alias("parent"), "child", ix.child_slot(F.col("child"), cfg.dim).alias("slot"))


def rebuild(particles: DataFrame, results: DataFrame, cfg: SpatialConfig, moved: dict[str, Column]) -> DataFrame:
    """Particles at new positions, with new leaves and the values that they had."""
    return leaf_index(particles.withColumns(moved), cfg).join(results, "pid", "left")


def extended(rows: DataFrame, cfg: SpatialConfig, level: int) -> DataFrame:
    """Adds where a cell (boxes) of the box lies in the plain tree of ``cfg.extended``: ``big_level`` and ``big_`` boxes."""
    margin = -cfg.image_interval[0] << level
    return rows.withColumns({"big_level": F.lit(cfg.levels_above + level)} | {f"big_{b}": F.col(b) + margin for b in cfg.boxes})


def images(particles: DataFrame, cfg: SpatialConfig) -> DataFrame:
    """Every particle once for each image of the box, with its position there and ``image`` (false: the box itself)."""
    low, high = cfg.image_interval
    rows = particles.withColumn("image", F.lit(False))
    for a, w in zip(cfg.axes, cfg.widths, strict=True):
        rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumns({a: F.col(a) + F.col("_k") * w, "image": F.col("image") | (F.col("_k") != 0)}).drop("_k")
    return rows


def input_order(results: DataFrame, key: str = "pid") -> DataFrame:
    """Results in the order in which their particles were numbered, by a distributed sort."""
    return results.orderBy(key)
