"""Particle tables: views over the test tables, generators, and the FMA text format."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import AXES

#: Odd multipliers and the grid of the keyed positions: fixed values of the fixtures.
GRID = 1 << 20
KEYED = {"x": "({k} * 2654435761L)", "y": "({k} * 81006L + {k})", "z": "({k} * 1540483477L)"}


def keyed(table: DataFrame, key: str, dim: int = 3, shift: int = 0, charge: float = 1.0) -> DataFrame:
    """pid, x, y[, z], q: positions on a dyadic grid that follow from the key alone."""
    k = f"(CAST({key} AS bigint) + {shift}L)"
    positions = (f"CAST({KEYED[a].format(k=k)} % {GRID}L AS double) / {GRID}.0D AS {a}" for a in AXES[:dim])
    return table.selectExpr(f"CAST({key} AS bigint) AS pid", *positions, f"CAST({charge} AS double) AS q")


def uniform(spark: SparkSession, n: int, dim: int = 3, seed: int = 0, charge: float = 1.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pid"), *(F.rand(seed * 31 + k).alias(a) for k, a in enumerate(AXES[:dim])), F.lit(charge).alias("q"))


def normal(spark: SparkSession, n: int, dim: int = 2, seed: int = 42, mean: float = 0.5, sigma: float = 0.15) -> DataFrame:
    """Normal around the middle, clamped into the box."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return spark.range(n).select(F.col("id").alias("pid"), *(clamp(F.randn(seed * 31 + k) * sigma + mean).alias(a) for k, a in enumerate(AXES[:dim])), F.lit(1.0).alias("q"))


def clustered(spark: SparkSession, n: int, dim: int = 2, seed: int = 42, sigma: float = 0.05) -> DataFrame:
    """Around four centres in turn, clamped into the box."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    centres = {"x": (0.25, 0.75, 0.25, 0.75), "y": (0.25, 0.25, 0.75, 0.75), "z": (0.25, 0.75, 0.75, 0.25)}
    middle = lambda a: F.element_at(F.array(*map(F.lit, centres[a])), (F.col("id") % 4 + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("pid"), *(clamp(F.randn(seed * 31 + k) * sigma + middle(a)).alias(a) for k, a in enumerate(AXES[:dim])), F.lit(1.0).alias("q"))


def parse_fma(lines: DataFrame, values: int = 1) -> DataFrame:
    """pid, x, y, z, v0.. from the lines (line bigint, value string) of an FMA file.

    Three header lines: an ignored number and the number of data values of a
    row; the number of rows; half the width and the centre of the box.  Rows
    beyond that number are not read; data values beyond ``values`` are dropped,
    and missing ones are null, as is what is no number.  Without a number of
    rows there are none.
    """
    fields = F.split(F.trim("value"), r"\s+")
    header = lines.where("line = 1").select(F.get(fields, F.lit(0)).try_cast("bigint").alias("n"))
    rows = lines.where("line >= 3").select((F.col("line") - 3).alias("pid"), fields.alias("f"))
    number = lambda k: F.get("f", F.lit(k)).try_cast("double")
    return rows.join(F.broadcast(header), F.col("pid") < F.col("n")).select("pid", *(number(k).alias(a) for k, a in enumerate(AXES)), *(number(3 + k).alias(f"v{k}") for k in range(values)))


def parse_fma_box(lines: DataFrame) -> DataFrame:
    """width, cx, cy, cz, n, n_values: the header."""
    f = F.split(F.trim("value"), r"\s+")
    at = lambda line, k, kind: F.max(F.when(F.col("line") == line, F.get(f, F.lit(k - 1)).try_cast(kind)))
    return lines.where("line < 3").agg((at(2, 1, "double") * 2).alias("width"), at(2, 2, "double").alias("cx"), at(2, 3, "double").alias("cy"), at(2, 4, "double").alias("cz"), at(1, 1, "bigint").alias("n"), at(0, 2, "bigint").alias("n_values"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, value: the lines of a file from 0, whatever splits it is read in.  A folder of files is one file, by path.

    The lines of a split stay together and in order in the partition that reads
    it, so a line's number is that of the split's first line plus its distance
    from there.  One row a split, its number of lines, goes through the driver.
    """
    split = ("path", "start")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    found = lines.groupBy(*split).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low")).collect()
    first, rows = 0, []
    for r in sorted(found, key=lambda r: (r["path"], r["start"])):
        rows.append((r["path"], r["start"], first - r["low"]))
        first += r["n"]
    shifts = F.broadcast(spark.createDataFrame(rows, "path string, start bigint, shift bigint"))
    return lines.join(shifts, list(split)).select((F.col("at") + F.col("shift")).alias("line"), "value")


def read_fma(spark: SparkSession, path: str, values: int = 1) -> tuple[DataFrame, DataFrame]:
    """Particles and header of an FMA file, in as many splits as it has.

    Line ends are those that Spark's text reader knows; a blank line is a row without numbers.
    """
    lines = numbered_lines(spark, path)
    return parse_fma(lines, values), parse_fma_box(lines)


def write_fma(particles: DataFrame, path: str, half_width: float, centre: tuple[float, float, float], values: Sequence[str] = ("q",)) -> None:
    """An FMA folder: a header and rows in order of pid, one part file for each range of it.

    Part files go by name, and the header's sorts before all others.
    """
    n = particles.count()
    numbers = lambda *v: " ".join(map(repr, v))
    head = [f"8 {len(values)}", str(n), numbers(float(half_width), *map(float, centre))]
    order = F.col("pid")
    body = particles.select(order, F.concat_ws(" ", *(F.col(c).cast("double").cast("string") for c in (*AXES, *values))).alias("value"))
    spark = particles.sparkSession
    header = spark.createDataFrame([(k, line) for k, line in enumerate(head)], "pid bigint, value string").coalesce(1).sortWithinPartitions("pid")
    header.select("value").write.text(f"{path}/part=0")
    body.repartitionByRange("pid").sortWithinPartitions("pid").select("value").write.text(f"{path}/part=1")
