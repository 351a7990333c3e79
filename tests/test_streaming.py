"""Micro-batches of targets against fixed sources."""

from pyspark.sql import functions as F

from hiersum.config import SpatialConfig
from hiersum.functions import kernels
from hiersum.sources import particles
from hiersum.streaming import simulation


def test_every_batch_is_evaluated(spark, tmp_path):
    sources = particles.uniform(spark, 60, seed=3)
    for k in range(2):
        particles.uniform(spark, 10, seed=10 + k).withColumn("pid", F.col("pid") + 100 * k).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pid bigint, x double, y double, z double, q double").option("maxFilesPerTrigger", 8).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    job = simulation.attach(stream, sources, SpatialConfig(), kernels.Count(), lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "state"))
    job.awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert {r["rhs"] for r in rows} == {60} and len(rows) == 20
