"""Trees as tables: written once, opened by later queries without building.

A stored tree is a folder of three tables.  ``header`` is one row with the
configuration.  ``cells`` is partitioned by level, ``particles`` by block of
consecutive leaves, with leaves in order inside; a reader of a level, or of a
range of blocks, opens the files of those alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import SpatialConfig
from ..functions import index as ix
from ..operators import tree
from ..staging import once

#: Folders of particles, at most; a folder holds a range of blocks.
FOLDERS = 1_000


@dataclass
class StoredTree:
    """A tree that ``write`` has stored."""

    spark: SparkSession
    path: str

    @cached_property
    def header(self) -> dict:
        """Parameters, and the numbers of particles, leaves and blocks."""
        return self.spark.read.parquet(f"{self.path}/header").first().asDict(recursive=True)

    @cached_property
    def cfg(self) -> SpatialConfig:
        h = self.header
        return SpatialConfig(h["dim"], h["height"], tuple(h["centre"]), tuple(h["widths"]), h["periodic"], h["extra_levels"], h["block_size"])

    def cells(self, level: int | None = None) -> DataFrame:
        """level, cell, boxes, n, block of all cells, or of a level."""
        rows = self.spark.read.parquet(f"{self.path}/cells")
        return rows if level is None else rows.where(F.col("level") == level)

    def particles(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """Particles with leaf and block, of all blocks or of those from first to last."""
        rows = self.spark.read.parquet(f"{self.path}/particles")
        if first is not None and last is not None:
            per = self.header["blocks_per_folder"]
            rows = rows.where(F.col("folder").between(first // per, last // per) & F.col("block").between(first, last))
        return rows.drop("folder")


def write(particles: DataFrame, cfg: SpatialConfig, path: str, block_size: int | None = None) -> StoredTree:
    """Build the tree of ``particles`` (pid, axes and further columns) and store it.

    A block is ``block_size`` consecutive leaves in Morton order (else
    ``cfg.block_size``, else 128).  An existing folder is an error.
    """
    spark, size = particles.sparkSession, block_size or cfg.block_size or 128
    placed = once(tree.leaf_index(particles, cfg).drop(*cfg.boxes))
    leaves = tree.running(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1)), ["leaf"], "one", "at")
    leaves = once(leaves.select("leaf", "n", F.floor(F.col("at") / size).alias("block")))
    n_leaves, n = leaves.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_blocks = -(-n_leaves // size)
    per_folder = max(1, -(-n_blocks // FOLDERS))
    header = (cfg.dim, cfg.height, list(cfg.centre), list(cfg.widths), cfg.periodic, cfg.extra_levels, size, n, n_leaves, n_blocks, per_folder)
    schema = "dim int, height int, centre array<double>, widths array<double>, periodic boolean, extra_levels int, block_size int, particles bigint, leaves bigint, blocks bigint, blocks_per_folder bigint"
    spark.createDataFrame([header], schema).coalesce(1).write.parquet(f"{path}/header")
    at = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(cfg.leaf_level))))
    cell = F.expr(f"shiftright(leaf, {cfg.dim} * ({cfg.leaf_level} - level))")
    cells = at.groupBy("level", cell.alias("cell")).agg(F.sum("n").alias("n"), F.min("block").alias("block"))
    boxes = ix.morton_boxes(F.col("cell"), cfg.dim, max(cfg.leaf_level, 1))
    cells = cells.select("level", "cell", *(b.alias(name) for b, name in zip(boxes, cfg.boxes, strict=True)), "n", "block")
    cells.repartitionByRange("level", "cell").sortWithinPartitions("level", "cell").write.partitionBy("level").parquet(f"{path}/cells")
    rows = placed.join(leaves.select("leaf", "block"), "leaf").withColumn("folder", F.floor(F.col("block") / per_folder))
    rows.repartitionByRange("folder", "leaf", "pid").sortWithinPartitions("folder", "leaf").write.partitionBy("folder").parquet(f"{path}/particles")
    return StoredTree(spark, path)
