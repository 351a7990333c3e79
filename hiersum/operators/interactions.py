"""Interaction and neighbour lists as offset expansions with equi-joins.

A predicate such as ``abs(a.ix - b.ix) <= 1`` would force a nested-loop join.
Expanding each target by a fixed list of offsets turns it into a hash or
sort-merge join on box numbers.  Boxes outside the domain or without particles
simply find no partner.  Rows are one per offset and never made distinct: in a
periodic box the same source may be reached through several offsets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from ..config import SpatialConfig
from ..functions import index as ix

DELTAS = ("dx", "dy", "dz")


def _structs(offsets: Sequence[tuple[int, ...]]) -> str:
    return ", ".join("struct(" + ", ".join(f"{v}L AS {n}" for v, n in zip(o, DELTAS, strict=False)) + ")" for o in offsets)


@cache
def _far_by_slot(dim: int) -> str:
    """SQL array of arrays: the far offsets of a box, by its slot in the parent."""
    rows = []
    for slot in range(1 << dim):
        odd = [(slot >> (dim - 1 - a)) & 1 for a in range(dim)]
        fits = [o for o in ix.far_offsets(dim) if all(abs((bit + v) // 2) <= 1 for bit, v in zip(odd, o, strict=True))]
        rows.append(f"array({_structs(fits)})")
    return f"array({', '.join(rows)})"


def _reach(cfg: SpatialConfig, level: Column, boxes: Sequence[Column], deltas: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    """Source boxes at an offset, wrapped if periodic, and the image that they lie in."""
    at = [b + d for b, d in zip(boxes, deltas, strict=True)]
    if not cfg.periodic:
        return at, []
    n = F.expr("shiftleft(1L, CAST(level AS int))") if level is None else level
    return [F.pmod(a, n) for a in at], [F.floor(a / n) for a in at]


def _expand(targets: DataFrame, cfg: SpatialConfig, offsets: Column) -> DataFrame:
    """One row per target and offset, with the source box (s_), the offset and the image (w_)."""
    rows = targets.withColumn("o", F.explode(offsets))
    deltas = [F.col(f"o.{d}") for d in DELTAS[: cfg.dim]]
    at, images = _reach(cfg, None, [F.col(b) for b in cfg.boxes], deltas)
    rows = rows.withColumns({f"s_{b}": a for b, a in zip(cfg.boxes, at, strict=True)} | {f"w_{b}": w for b, w in zip(cfg.boxes, images, strict=False)})
    return rows.withColumns(dict(zip(DELTAS, deltas, strict=False))).drop("o")


def expand_far(targets: DataFrame, cfg: SpatialConfig) -> DataFrame:
    """Targets (level, boxes) against every box of their interaction lists, existing or not."""
    slot = ix.long(0)
    for b in cfg.boxes:
        slot = slot * 2 + F.col(b).bitwiseAND(ix.long(1))
    inside = targets.where(f"level >= {cfg.stop_level}")
    return _expand(inside, cfg, F.element_at(F.expr(_far_by_slot(cfg.dim)), (slot + 1).cast("int")))


def expand_near(targets: DataFrame, cfg: SpatialConfig, own: bool = True, upper: bool = False) -> DataFrame:
    """Leaf targets (boxes) against their neighbours; ``upper`` keeps each unordered pair once."""
    middle = tuple([0] * cfg.dim)
    offsets = [o for o in ix.near_offsets(cfg.dim) if (o != middle or own) and not (upper and o < middle)]
    return _expand(targets.withColumn("level", F.lit(cfg.leaf_level)), cfg, F.expr(f"array({_structs(offsets)})"))


def _join(expanded: DataFrame, sources: DataFrame, cfg: SpatialConfig, keys: Sequence[str], how: str) -> DataFrame:
    """``how`` names the strategy by the source side: broadcast, if its size was checked, or merge.

    It is always given: Spark does not see that the expanded side grew by the
    number of offsets, and might broadcast that one.
    """
    renamed = sources.withColumnsRenamed({c: f"s_{c}" for c in sources.columns if c not in keys or c in cfg.boxes})
    on = [*(k for k in keys if k not in cfg.boxes), *(f"s_{b}" for b in cfg.boxes)]
    return expanded.join(renamed.hint(how), on)


def m2l_list(targets: DataFrame, sources: DataFrame, cfg: SpatialConfig, small: bool = False) -> DataFrame:
    """Far pairs of existing cells: target columns, source columns as ``s_``, dx.. and ``code``."""
    rows = _join(expand_far(targets, cfg), sources, cfg, ["level", *cfg.boxes], "broadcast" if small else "merge")
    return rows.withColumn("code", ix.interaction_code([F.col(d) for d in DELTAS[: cfg.dim]]))


def neighbour_list(targets: DataFrame, sources: DataFrame, cfg: SpatialConfig, own: bool = True, upper: bool = False, small: bool = False) -> DataFrame:
    """Near pairs of existing leaves: target columns, source columns as ``s_``, dx.. and ``code``."""
    rows = _join(expand_near(targets, cfg, own, upper), sources, cfg, cfg.boxes, "broadcast" if small else "merge")
    return rows.withColumn("code", ix.neighbour_code([F.col(d) for d in DELTAS[: cfg.dim]]))


def particle_pairs(targets: DataFrame, sources: DataFrame, cfg: SpatialConfig, same: bool, small: bool = False) -> DataFrame:
    """Near pairs of encoded particles, both directions; source columns as ``s_``.

    ``small`` says that the sources' size was checked and may be broadcast;
    else both sides are sorted, which AQE can split at a crowded leaf.

    Source positions are those of the image that the target sees.  With one set
    (``same``) a particle does not meet itself, but does meet its own images.
    """
    rows = _join(expand_near(targets, cfg), sources, cfg, cfg.boxes, "broadcast" if small else "merge")
    if cfg.periodic:
        rows = rows.withColumns({f"s_{a}": F.col(f"s_{a}") + F.col(f"w_{b}") * w for a, b, w in zip(cfg.axes, cfg.boxes, cfg.widths, strict=True)})
    if not same:
        return rows
    self_pair = F.col("pid") == F.col("s_pid")
    if cfg.periodic:
        for b in cfg.boxes:
            self_pair = self_pair & (F.col(f"w_{b}") == 0)
    return rows.where(~self_pair)


def block_pairs(pairs: DataFrame, leaf_blocks: DataFrame, cfg: SpatialConfig) -> DataFrame:
    """target_block, source_block, n: near pairs of leaves by block, the unit of a task."""
    bits = max(cfg.leaf_level, 1)
    coded = pairs.select(ix.morton([F.col(b) for b in cfg.boxes], bits).alias("leaf"), ix.morton([F.col(f"s_{b}") for b in cfg.boxes], bits).alias("source"))
    t = leaf_blocks.select("leaf", F.col("block").alias("target_block"))
    s = leaf_blocks.select(F.col("leaf").alias("source"), F.col("block").alias("source_block"))
    return coded.join(t, "leaf").join(s, "source").groupBy("target_block", "source_block").agg(F.count(F.lit(1)).alias("n"))


def block_interactions(pairs: DataFrame, leveled: DataFrame, cfg: SpatialConfig) -> DataFrame:
    """level, target_block, source_block, inside, n: far pairs of cells by block of ``tree.level_blocks``; ``inside``: of one block."""
    bits = max(cfg.leaf_level, 1)
    coded = pairs.select("level", ix.morton([F.col(b) for b in cfg.boxes], bits).alias("cell"), ix.morton([F.col(f"s_{b}") for b in cfg.boxes], bits).alias("source"))
    t = leveled.select("level", "cell", F.col("block").alias("target_block"))
    s = leveled.select("level", F.col("cell").alias("source"), F.col("block").alias("source_block"))
    placed = coded.join(t, ["level", "cell"]).join(s, ["level", "source"])
    return placed.groupBy("level", "target_block", "source_block", (F.col("target_block") == F.col("source_block")).alias("inside")).agg(F.count(F.lit(1)).alias("n"))


def pairs_by_block(pairs: DataFrame, blocks: DataFrame, cfg: SpatialConfig) -> DataFrame:
    """target_block, source_block, n of pairs of leaves, for blocks of leaves (boxes, block) in any order."""
    t = blocks.select(*cfg.boxes, F.col("block").alias("target_block"))
    s = blocks.select(*(F.col(b).alias(f"s_{b}") for b in cfg.boxes), F.col("block").alias("source_block"))
    return pairs.join(t, list(cfg.boxes)).join(s, [f"s_{b}" for b in cfg.boxes]).groupBy("target_block", "source_block").agg(F.count(F.lit(1)).alias("n"))


def needs_shift(cfg: SpatialConfig) -> Column:
    """Whether an expanded row reaches through a face of the box."""
    out = F.lit(False)
    if cfg.periodic:
        for b in cfg.boxes:
            out = out | (F.col(f"w_{b}") != 0)
    return out
