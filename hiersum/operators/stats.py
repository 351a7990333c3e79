"""Statistics of a query: interaction counters and accuracy."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from ..config import SpatialConfig
from ..functions import index as ix
from ..staging import once
from . import interactions, tree

#: Leaves whose table, and that of their cells, is broadcast, at most.
SMALL = 50_000


def interaction_counters(particles: DataFrame, cfg: SpatialConfig) -> DataFrame:
    """One row with the number of calls or pairs of each operator."""
    leaves = once(tree.leaf_counts(particles, cfg))
    cells = once(tree.roll_up(leaves, cfg, cfg.far_levels, {"n": F.col("n")}))
    far = len(cfg.far_levels) > 0
    small = leaves.count() <= SMALL
    zero = lambda df: df if far else df.limit(0)
    n_leaves = leaves.agg(F.count(F.lit(1)).alias("leaves"), F.coalesce(F.sum(F.col("n") * F.col("n") - F.col("n")), F.lit(0)).alias("p2p_inner"))
    n_cells = zero(cells.where(f"level > {cfg.stop_level}")).agg(F.count(F.lit(1)).alias("m2m"))
    m2l = zero(interactions.m2l_list(cells.select("level", *cfg.boxes), cells, cfg, small)).agg(F.count(F.lit(1)).alias("m2l"))
    near = interactions.neighbour_list(leaves, leaves, cfg, own=False, upper=True, small=small).agg(F.coalesce(F.sum(F.col("n") * F.col("s_n")), F.lit(0)).alias("p2p"))
    row = n_leaves.crossJoin(n_cells).crossJoin(m2l).crossJoin(near)  # one row each
    outer = F.col("leaves") if far else F.lit(0).cast("bigint")
    return row.select(outer.alias("p2m"), "m2m", "m2l", F.col("m2m").alias("l2l"), outer.alias("l2p"), "p2p", "p2p_inner")


def accuracy(tested: DataFrame, reference: DataFrame, value: str, key: str = "pid") -> DataFrame:
    """l2, rms, inf, rel_l2, rel_inf, max_rel, n: how far ``tested`` is from ``reference``.

    rel_inf is over the largest reference value with its sign; where a
    reference is zero, the tested value itself stands for the relative error.
    """
    rows = tested.select(key, F.col(value).alias("t")).join(reference.select(key, F.col(value).alias("r")), key)
    diff = F.abs(F.col("t") - F.col("r"))
    relative = F.when(F.col("r") == 0, F.col("t")).otherwise(diff / F.abs("r"))
    sums = rows.agg(F.max(diff).alias("inf"), F.max("r").alias("top"), F.sum(diff * diff).alias("sd"), F.sum(F.col("r") * F.col("r")).alias("sr"), F.max(relative).alias("max_rel"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.sqrt("sd").alias("l2"), F.sqrt(F.col("sd") / F.col("n")).alias("rms"), "inf", F.sqrt(F.col("sd") / F.col("sr")).alias("rel_l2"), (F.col("inf") / F.col("top")).alias("rel_inf"), "max_rel", "n")


def interaction_log(particles: DataFrame, cfg: SpatialConfig) -> DataFrame:
    """Every call of every operator: stage, level, target, source (cells), code, n_target, n_source, shifted.

    ``code`` is the slot of a child, or the relative position of far and near
    cells.  Stages on one cell name no source (-1), and pairs of leaves come once.
    """
    leaves = tree.with_index(tree.leaf_counts(particles, cfg), cfg, "target")
    cells = tree.cells(particles, cfg, cfg.far_levels)
    far = len(cfg.far_levels) > 0
    none, nothing = F.lit(-1).cast("bigint"), F.lit(0).cast("bigint")

    def rows(df: DataFrame, stage: str, level, target, source=none, code=none, n_target=nothing, n_source=nothing, shifted=F.lit(False)) -> DataFrame:
        return df.select(F.lit(stage).alias("stage"), level.cast("int").alias("level"), target.alias("target"), source.alias("source"), code.alias("code"), n_target.alias("n_target"), n_source.alias("n_source"), shifted.alias("shifted"))

    leaf, at = F.lit(cfg.leaf_level), F.col("target")
    log = rows(leaves, "p2p_inner", leaf, at, at, n_target=F.col("n"), n_source=F.col("n"))
    near = tree.with_index(interactions.neighbour_list(leaves.drop("target"), leaves.drop("target"), cfg, own=False, upper=True), cfg, "target")
    source = ix.morton([F.col(f"s_{b}") for b in cfg.boxes], max(cfg.leaf_level, 1))
    log = log.unionByName(rows(near, "p2p", leaf, at, source, F.col("code"), F.col("n"), F.col("s_n"), interactions.needs_shift(cfg)))
    if far:
        pairs = tree.parent_child(cells.where(f"level > {cfg.stop_level}"), cfg)
        up = rows(pairs, "m2m", F.col("level"), F.col("parent"), F.col("child"), F.col("slot"))
        down = rows(pairs, "l2l", F.col("level"), F.col("child"), F.col("parent"), F.col("slot"))
        across = tree.with_index(interactions.m2l_list(cells.select("level", *cfg.boxes), cells, cfg), cfg, "target")
        across = rows(across, "m2l", F.col("level"), at, source, F.col("code"), shifted=interactions.needs_shift(cfg))
        ends = [rows(leaves, stage, leaf, at, n_target=F.col("n")) for stage in ("p2m", "l2p")]
        for part in (*ends, up, down, across):
            log = log.unionByName(part)
    return log


def stage_times(query) -> DataFrame:
    """stage, seconds: each stage of a query, run from the kept results of the one before."""
    taken = []

    def run(stage: str, work) -> None:
        began = time.perf_counter()
        work()
        taken.append((stage, time.perf_counter() - began))

    def dropped(df: DataFrame):
        return lambda: df.write.format("noop").mode("overwrite").save()

    run("p2m", lambda: query.leaves)
    run("m2m", lambda: query.cells)
    run("m2l", lambda: query.locals_)
    run("l2l", lambda: query.leaf_locals)
    run("l2p", dropped(query.l2p()))
    run("p2p", dropped(query.p2p()))
    return query.t.sparkSession.createDataFrame(taken, "stage string, seconds double")


def accuracy_record(spark, cfg: SpatialConfig, order: int, distribution: str, run, exact, value: str = "pot") -> DataFrame:
    """One row: height, order, distribution, n, error (relative, largest), seconds_tree, seconds_direct.

    ``run`` and ``exact`` make the tested and the reference table; each is timed to its end.
    """
    taken, tables = [], []
    for make in (run, exact):
        began = time.perf_counter()
        tables.append(once(make()))
        taken.append(time.perf_counter() - began)
    row = accuracy(*tables, value).select("n", F.col("rel_inf").alias("error"))
    return row.select(F.lit(cfg.height).alias("height"), F.lit(order).alias("order"), F.lit(distribution).alias("distribution"), "n", "error", *(F.lit(t).alias(f"seconds_{k}") for k, t in zip(("tree", "direct"), taken, strict=True)))
