"""Counters and timers around kernels, and near fields in batches."""

import pytest
from pyspark.sql import functions as F

from hiersum.config import Ops, SpatialConfig
from hiersum.functions import kernels
from hiersum.functions.watching import Counter, Timer
from hiersum.operators import stats
from hiersum.plans.fmm import Query, direct
from hiersum.sources import particles


def _set(spark, n, dim=3, **more):
    points = particles.uniform(spark, n, dim, **more)
    return spark.createDataFrame(points.collect(), points.schema)


@pytest.mark.parametrize("wrap", [lambda k: Counter(Timer(k)), lambda k: Timer(Counter(k))])
@pytest.mark.parametrize("dim", [2, 3])
def test_counters_of_a_run_are_those_of_the_lists(spark, wrap, dim):
    points, cfg = _set(spark, 400, dim), SpatialConfig(dim=dim, height=4)
    kernel = wrap(kernels.Count())
    field = Query(cfg, kernel, points).execute().collect()
    assert {r["rhs"] for r in field} == {399} and len(field) == 400
    counter, timer = (kernel, kernel.kernel) if isinstance(kernel, Counter) else (kernel.kernel, kernel)
    want = stats.interaction_counters(points, cfg).first().asDict()
    assert counter.counts() == want
    assert set(timer.seconds) == {"p2m", "m2m", "m2l", "l2l", "l2p", "p2p"} and all(v > 0 for v in timer.seconds.values())


def test_counters_of_pairs_of_columns(spark):
    points, cfg = _set(spark, 200), SpatialConfig(height=3)
    kernel = Counter(kernels.InverseR())
    got = Query(cfg, kernel, points, ops=Ops.NEAR).execute()
    want = Query(cfg, kernels.InverseR(), points, ops=Ops.NEAR).execute()
    assert stats.accuracy(got, want, "pot").first()["inf"] == 0
    lists = stats.interaction_counters(points, cfg).first()
    assert kernel.counts() == {"p2p": lists["p2p"], "p2p_inner": lists["p2p_inner"]}


class ByColumns(kernels.Log2D):
    batched = False


@pytest.mark.parametrize("cfg", [SpatialConfig(dim=2, height=4), SpatialConfig(dim=2, height=3, periodic=True), SpatialConfig(dim=2, height=3, widths=(1.0, 2.0), centre=(0.5, 1.0))])
def test_near_field_in_batches_is_that_of_columns(spark, cfg):
    points = _set(spark, 300, 2).withColumn("q", F.col("pid") % 3 - 1.0)
    others = _set(spark, 100, 2, seed=7)
    for sets in ((points,), (others, points)):
        got, want = (Query(cfg, k, *sets, ops=Ops.NEAR).execute() for k in (kernels.Log2D(4), ByColumns(4)))
        row = stats.accuracy(got, want, "pot").first()
        assert row["rel_l2"] < 1e-12 and row["n"] == (300 if len(sets) == 1 else 100)


def test_both_kinds_of_stages_in_one_plan(spark):
    points, cfg = _set(spark, 300, 2), SpatialConfig(dim=2, height=5)
    got, want = Query(cfg, kernels.Log2D(8), points).execute(), direct(points, points, cfg, kernels.Log2D(8), True)
    assert stats.accuracy(got, want, "pot").first()["rel_l2"] < 1e-6
