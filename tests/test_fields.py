"""Fields: exact counts over grids of parameters, and expansions against direct sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiersum.config import Ops, SpatialConfig
from hiersum.functions import kernels
from hiersum.functions.expansions import Harmonic, Lagrange
from hiersum.operators import stats, tree
from hiersum.plans.arrays import ArrayQuery
from hiersum.plans.fmm import Query, direct
from hiersum.sources import particles


def counts(df):
    return {r[0] for r in df.select("rhs").distinct().collect()}


@pytest.mark.parametrize("n", [1, 10, 300])
@pytest.mark.parametrize("height", [1, 2, 3, 4])
def test_count(spark, n, height):
    points = particles.uniform(spark, n)
    assert counts(Query(SpatialConfig(height=height), kernels.Count(), points).execute()) == {n - 1}


def test_empty_set(spark):
    assert Query(SpatialConfig(), kernels.Count(), particles.uniform(spark, 0)).execute().count() == 0


def test_all_in_one_leaf(spark):
    points = particles.uniform(spark, 50).withColumns({a: F.col(a) / 16 for a in "xyz"})
    assert counts(Query(SpatialConfig(), kernels.Count(), points).execute()) == {49}


def test_null_positions_take_no_part(spark):
    points = particles.uniform(spark, 20).withColumn("x", F.when(F.col("pid") < 15, F.col("x")))
    assert counts(Query(SpatialConfig(), kernels.Count(), points).execute()) == {14}


@pytest.mark.parametrize("height", [1, 3])
def test_two_sets(spark, height):
    out = Query(SpatialConfig(height=height), kernels.Count(), particles.uniform(spark, 40, seed=1), particles.uniform(spark, 70, seed=2)).execute()
    assert counts(out) == {70} and out.count() == 40


@pytest.mark.parametrize("n", [-1, 0, 1, 2, 3, 4])
def test_periodic(spark, n):
    cfg = SpatialConfig(dim=2, height=3, periodic=True, extra_levels=n)
    assert counts(Query(cfg, kernels.Count(), particles.uniform(spark, 30, 2)).execute()) == {30 * cfg.repetitions**2 - 1}


def test_stages_add_up(spark):
    points, cfg = particles.uniform(spark, 200), SpatialConfig()
    parts = [Query(cfg, kernels.Count(), points, ops=o).execute() for o in (Ops.NEAR, Ops.FAR)]
    total = parts[0].unionByName(parts[1]).groupBy("pid").agg(F.sum("rhs").alias("rhs"))
    assert counts(total) == {199}


@pytest.mark.parametrize("ops", [Ops.P2M, Ops.UPWARD, Ops.P2M | Ops.M2M | Ops.M2L, Ops.DOWNWARD & ~Ops.L2P])
def test_masks_that_end_in_cells(spark, ops):
    points = particles.uniform(spark, 20)
    with pytest.raises(ValueError):
        Query(SpatialConfig(), kernels.Count(), points, ops=ops).execute()
    with pytest.raises(ValueError):
        ArrayQuery(SpatialConfig(), Harmonic(2), points, ops=ops).execute()


def test_masks_of_array_expansions(spark):
    """Without a way up or down only the leaves' own lists count; two levels of far field tell them apart."""
    points = particles.uniform(spark, 200)
    points, cfg = spark.createDataFrame(points.collect(), points.schema), SpatialConfig(height=4)
    run = lambda ops: {r["pid"]: r["pot"] for r in ArrayQuery(cfg, Lagrange(5), points, ops=ops).execute().collect()}
    whole, far, near = run(Ops.ALL), run(Ops.FAR), run(Ops.NEAR)
    own = run(Ops.FAR & ~Ops.L2L)
    assert own == pytest.approx(run(Ops.P2M | Ops.M2L | Ops.L2P)) and own == pytest.approx(run(Ops.FAR & ~Ops.M2M))
    assert all(abs(whole[k] - far[k] - near[k]) < 1e-9 and own[k] < far[k] for k in whole)
    assert set(run(Ops.FAR & ~Ops.M2L).values()) == {0.0}


def test_positions_outside_the_box_fail(spark):
    points = particles.uniform(spark, 20).withColumn("x", F.when(F.col("pid") < 15, F.col("x")).otherwise(F.col("x") + 1.5))
    with pytest.raises(Exception, match="outside the box"):
        Query(SpatialConfig(), kernels.Count(), points).execute().collect()


def test_a_task_sends_each_cell_once(spark):
    """However many batches a task reads; and where tasks are many, upper cells are summed in between."""
    points = particles.uniform(spark, 2000, charge=0.5)
    points, cfg = spark.createDataFrame(points.collect(), points.schema), SpatialConfig(height=4)
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
        e = Harmonic(2)
        for tasks, most in ((4, 4), (100, 64)):
            spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(tasks == 4).lower())
            rows = ArrayQuery(cfg, e, points).upward().groupBy("level", "ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"), F.collect_list("c").alias("c")).collect()
            assert max(r["n"] for r in rows) <= most
            for level in (2, 3):
                assert sum(np.frombuffer(c, np.float64)[0] for r in rows if r["level"] == level for c in r["c"]) == pytest.approx(1000)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("kernel", [kernels.LennardJones(), kernels.OneOverAPlusR2(0.3), kernels.AnisotropicInverseR((1.0, 2.0, 0.5)), kernels.InverseR2(), kernels.InverseR(), kernels.Polynomial()])
def test_fields_agree_with_column_kernels(spark, kernel):
    """The numbers of the array plans against the column expressions, near field alone, with a crowded leaf in shares."""
    points = particles.uniform(spark, 120)
    points = points.withColumns({a: F.when(F.col("pid") < 60, F.col(a) / 8).otherwise(F.col(a)) for a in "xyz"})
    points, cfg = spark.createDataFrame(points.collect(), points.schema), SpatialConfig(height=3)
    got = ArrayQuery(cfg, Lagrange(3, kernel), points, ops=Ops.NEAR).execute()
    want = Query(cfg, kernel, points, ops=Ops.NEAR).execute()
    for field in ("pot", "fx", "fy", "fz"):
        assert stats.accuracy(got, want, field).first()["rel_l2"] < 1e-10


@pytest.mark.parametrize(("order", "bound"), [(4, 1e-4), (8, 1e-6)])
def test_log(spark, order, bound):
    points, cfg = particles.uniform(spark, 300, 2), SpatialConfig(dim=2)
    points = spark.createDataFrame(points.collect(), points.schema)
    row = stats.accuracy(Query(cfg, kernels.Log2D(order), points).execute(), direct(points, points, cfg, kernels.Log2D(order), True), "pot").first()
    assert row["rel_l2"] < bound and row["n"] == 300


@pytest.mark.parametrize(("expansion", "bound"), [(Harmonic(6), 1e-3), (Lagrange(6), 1e-3), (Lagrange(4), 9e-3)])
@pytest.mark.parametrize("height", [3, 4])
def test_inverse_r(spark, expansion, bound, height):
    points = particles.uniform(spark, 300, charge=0.01)
    points, cfg = spark.createDataFrame(points.collect(), points.schema), SpatialConfig(height=height)
    got, want = ArrayQuery(cfg, expansion, points).execute(), direct(points, points, cfg, kernels.InverseR(), True)
    for field in ("pot", "fx", "fy", "fz"):
        assert stats.accuracy(got, want, field).first()["rel_l2"] < bound


def test_inverse_r_two_sets(spark):
    made = [particles.uniform(spark, n, seed=s, charge=0.01) for n, s in ((150, 1), (200, 2))]
    t, s = (spark.createDataFrame(m.collect(), m.schema) for m in made)
    cfg = SpatialConfig(height=4)
    got, want = ArrayQuery(cfg, Harmonic(6), t, s).execute(), direct(t, s, cfg, kernels.InverseR(), False)
    assert stats.accuracy(got, want, "pot").first()["rel_l2"] < 1e-4


def test_inverse_r2_lagrange(spark):
    points = particles.uniform(spark, 200)
    points, cfg = spark.createDataFrame(points.collect(), points.schema), SpatialConfig(height=4)
    got, want = ArrayQuery(cfg, Lagrange(6, "1/r2"), points).execute(), direct(points, points, cfg, kernels.InverseR2(), True)
    assert stats.accuracy(got, want, "pot").first()["rel_l2"] < 1e-3


def test_accuracy_of_equal_sets(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, -4.0)], "pid bigint, v double")
    row = stats.accuracy(rows, rows.withColumn("v", F.col("v") + 1), "v").first()
    assert row["inf"] == 1.0 and row["n"] == 2 and row["rms"] == 1.0


def test_rebuild_keeps_values(spark):
    points, cfg = particles.uniform(spark, 50), SpatialConfig()
    points = spark.createDataFrame(points.collect(), points.schema)
    values = Query(cfg, kernels.Count(), points).execute()
    again = tree.rebuild(points, values, cfg, {"x": 1 - F.col("x")})
    assert again.count() == 50 and counts(again) == {49}
    assert counts(Query(cfg, kernels.Count(), again).execute()) == {49}


def test_fma_file(spark, tmp_path):
    path = tmp_path / "points.fma"
    path.write_text("8 2\n3\n0.5 0.5 0.5 0.5\n0.1 0.2 0.3 7 9\n0.4 0.5 0.6 8 9\n0.7 0.8 0.9 9 9\n")
    rows, box = particles.read_fma(spark, str(path))
    assert [tuple(r) for r in rows.orderBy("pid").collect()] == [(0, 0.1, 0.2, 0.3, 7.0), (1, 0.4, 0.5, 0.6, 8.0), (2, 0.7, 0.8, 0.9, 9.0)]
    assert tuple(box.first()) == (1.0, 0.5, 0.5, 0.5, 3, 2)


@pytest.mark.parametrize(("text", "rows"), [("", 0), ("8 2\n", 0), ("8 2\n3\n0.5 0.5 0.5 0.5\n0.1 0.2 0.3 7 9\n", 1), ("8 2\n0\n0.5 0.5 0.5 0.5\n0.1 0.2 0.3 7 9\n", 0), ("8 2\n2\n0.5 0.5 0.5 0.5\n0.1 0.2 word 7 9\n0.4\n", 2)])
def test_awkward_fma_files(spark, tmp_path, text, rows):
    """Short and empty files have fewer rows; what is no number is null."""
    path = tmp_path / "points.fma"
    path.write_text(text)
    got, _ = particles.read_fma(spark, str(path))
    assert got.count() == rows
    if rows == 2:
        assert [tuple(r) for r in got.orderBy("pid").collect()] == [(0, 0.1, 0.2, None, 7.0), (1, 0.4, None, None, None)]


@pytest.mark.parametrize(("height", "n"), [(2, -1), (3, 0), (2, 1)])
@pytest.mark.parametrize("expansion", [Harmonic(6), Lagrange(6)])
def test_periodic_expansions(spark, expansion, height, n):
    points = particles.uniform(spark, 40, charge=0.01)
    points, cfg = spark.createDataFrame(points.collect(), points.schema), SpatialConfig(height=height, periodic=True, extra_levels=n)
    got, want = ArrayQuery(cfg, expansion, points).execute(), direct(points, points, cfg, kernels.InverseR(), True)
    assert stats.accuracy(got, want, "pot").first()["rel_l2"] < 1e-4
    assert stats.accuracy(got, want, "fy").first()["rel_l2"] < 9e-3


def test_periodic_log(spark):
    points = particles.uniform(spark, 40, 2)
    points, cfg = spark.createDataFrame(points.collect(), points.schema), SpatialConfig(dim=2, height=3, periodic=True, extra_levels=1)
    got, want = Query(cfg, kernels.Log2D(8), points).execute(), direct(points, points, cfg, kernels.Log2D(8), True)
    assert stats.accuracy(got, want, "pot").first()["rel_l2"] < 1e-6
