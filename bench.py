"""Headline queries, timed.  Prints one JSON line.

Each query is run once to warm up at the smallest size and then timed at
$BENCH_SF_DIR; results go to the noop sink, so everything is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
HEADLINE = (
    "leaf_index", "cells_per_level", "m2l_list_sizes", "fmm_count_full", "fmm_count_near", "fmm_count_far", "tsm_count", "periodic_count_1",
    "interaction_counters", "p2p_near_invr", "fmm_log_full", "harmonic_full", "lagrange_full", "block_assignment",
)


def main() -> None:
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from hiersum.queries import QUERIES, SOLVES

    queries = QUERIES | SOLVES

    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    taken: dict[str, float] = {}
    for name in HEADLINE:
        if os.path.isdir(small):
            queries[name](spark, small).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - began, 3)
        print(name, taken[name], file=sys.stderr, flush=True)
    n = spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    scaling = {n: round(n / taken["harmonic_full"])}
    if os.environ.get("BENCH_SCALING", "1") != "0":  # the gap to compiled code closes with size
        from hiersum.functions.expansions import Harmonic
        from hiersum.plans.arrays import ArrayQuery
        from hiersum.queries import CUBE
        from hiersum.sources.particles import keyed

        many = 1_000_000
        points = keyed(spark.range(many), "id")
        began = time.perf_counter()
        ArrayQuery(CUBE.for_count(many), Harmonic(8), points).execute().write.format("noop").mode("overwrite").save()
        scaling[many] = round(many / (time.perf_counter() - began))
    print(json.dumps({"metric": "headline queries", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "particles_per_sec": {q: round(n / taken[q]) for q in ("fmm_count_full", "harmonic_full", "lagrange_full")}, "harmonics_particles_per_sec_by_size": scaling}))


if __name__ == "__main__":
    main()
