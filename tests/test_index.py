"""Indexes: bijections, hierarchies and list geometry."""

import pytest
from pyspark.sql import functions as F

from hiersum.config import SpatialConfig
from hiersum.functions import index as ix
from hiersum.operators import interactions, tree


def grid(spark, dim, level):
    n, out = 1 << level, spark.range(1).select(F.lit(level).alias("level"))
    for b in ("ix", "iy", "iz")[:dim]:
        out = out.crossJoin(spark.range(n).select(F.col("id").alias(b)))
    return out


@pytest.mark.parametrize("dim", [2, 3])
def test_morton_is_a_bijection(spark, dim):
    cfg = SpatialConfig(dim=dim, height=5)
    boxes = [F.col(b) for b in cfg.boxes]
    rows = grid(spark, dim, 3).withColumn("m", ix.morton(boxes, 3))
    back = ix.morton_boxes(F.col("m"), dim, 3)
    wrong = F.lit(False)
    for a, b in zip(boxes, back, strict=True):
        wrong = wrong | (a != b)
    assert rows.where(wrong).count() == 0
    assert rows.select("m").distinct().count() == cfg.cells_at(3)
    assert rows.agg(F.max("m")).first()[0] == cfg.cells_at(3) - 1


def test_axis_0_is_most_significant(spark):
    row = spark.range(1).select(ix.morton([F.lit(1).cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")], 2).alias("m")).first()
    assert row["m"] == 4


def test_parent_and_child(spark):
    rows = spark.range(512).select(F.col("id").alias("c"), ix.child(ix.parent(F.col("id"), 3), ix.child_slot(F.col("id"), 3), 3).alias("again"))
    assert rows.where("c <> again").count() == 0


@pytest.mark.parametrize("dim", [2, 3])
def test_codes_round_trip(spark, dim):
    for offsets, code, back in ((ix.far_offsets(dim), ix.interaction_code, ix.interaction_offsets), (ix.near_offsets(dim), ix.neighbour_code, ix.neighbour_offsets)):
        names = [f"o{k}" for k in range(dim)]
        rows = spark.createDataFrame(offsets, names).withColumn("code", code([F.col(n) for n in names]))
        again = rows.select(*names, *(b.alias(f"b{k}") for k, b in enumerate(back(F.col("code"), dim))))
        assert again.where(" OR ".join(f"o{k} <> b{k}" for k in range(dim))).count() == 0
        assert rows.select("code").distinct().count() == len(offsets)


def test_hilbert_is_a_bijection_along_neighbours(spark):
    rows = grid(spark, 3, 3).withColumn("h", ix.hilbert([F.col("ix"), F.col("iy"), F.col("iz")], 3)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(512))
    for a, b in zip(rows, rows[1:]):
        assert abs(a["ix"] - b["ix"]) + abs(a["iy"] - b["iy"]) + abs(a["iz"] - b["iz"]) == 1


@pytest.mark.parametrize(("dim", "bits"), [(2, 4), (3, 1), (3, 2), (3, 3)])
def test_hilbert_decodes(spark, dim, bits):
    rows = spark.range(1 << (dim * bits)).select(F.col("id"), ix.hilbert_boxes(F.col("id"), dim, bits).alias("b"))
    again = rows.select("id", ix.hilbert([F.col("b")[k] for k in range(dim)], bits).alias("h"))
    assert again.where("id <> h").count() == 0


@pytest.mark.parametrize(("dim", "periodic"), [(2, False), (3, False), (3, True)])
def test_far_lists_of_a_full_grid(spark, dim, periodic):
    cfg = SpatialConfig(dim=dim, height=4, periodic=periodic)
    cells = grid(spark, dim, 3).withColumn("n", F.lit(1))
    pairs = interactions.m2l_list(cells.select("level", *cfg.boxes), cells, cfg)
    sizes = pairs.groupBy(*cfg.boxes).count().agg(F.min("count"), F.max("count")).first()
    assert sizes[1] == cfg.max_m2l
    if periodic:
        assert sizes[0] == cfg.max_m2l
    assert pairs.where(F.greatest(*(F.abs(d) for d in ("dx", "dy", "dz")[:dim])) <= 1).count() == 0


def test_near_lists_of_a_full_grid(spark):
    cfg = SpatialConfig(height=3)
    leaves = grid(spark, 3, 2).drop("level").withColumn("n", F.lit(1))
    sizes = {r["count"] for r in interactions.neighbour_list(leaves, leaves, cfg, own=False).groupBy(*cfg.boxes).count().collect()}
    assert max(sizes) == cfg.max_neighbours and min(sizes) == 7
    both = interactions.neighbour_list(leaves, leaves, cfg, own=False).count()
    assert interactions.neighbour_list(leaves, leaves, cfg, own=False, upper=True).count() * 2 == both


def test_upper_face_is_in_the_last_box(spark):
    cfg = SpatialConfig(height=4)
    rows = spark.createDataFrame([(0, 1.0, 0.0, 0.5)], "pid bigint, x double, y double, z double")
    assert tree.encode(rows, cfg).select(*cfg.boxes).first() == (7, 0, 4)


@pytest.mark.parametrize("far", [False, True])
def test_lists_are_equi_joins(spark, far):
    """No nested loops: partners are found by key, in the plan that ran."""
    cfg = SpatialConfig(height=4)
    made = grid(spark, 3, 3).withColumn("n", F.lit(1))
    cells = spark.createDataFrame(made.collect(), made.schema)
    pairs = interactions.m2l_list(cells.select("level", *cfg.boxes), cells, cfg) if far else interactions.neighbour_list(cells.drop("level"), cells.drop("level"), cfg)
    assert pairs.count() > 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Join" in plan


def test_running_sums_by_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 5).alias("n"))
    got = [tuple(r) for r in tree.running(rows, ["k"], "n", "before").orderBy("k").select("n", "before").collect()]
    total = 0
    for n, before in got:
        assert before == total
        total += n
    assert tree.running(rows.limit(0), ["k"], "n", "before").count() == 0


def test_extended_box_holds_all_images():
    for n in (-1, 0, 1, 2):
        cfg = SpatialConfig(periodic=True, extra_levels=n, centre=(1.0, 2.0, 3.0))
        low, high = cfg.image_interval
        for c, w, big, big_w in zip(cfg.corner, cfg.widths, cfg.extended.corner, cfg.extended.widths, strict=True):
            assert big == c + low * w and big + big_w >= c + (high + 1) * w
        assert cfg.extended.leaf_widths == cfg.leaf_widths


def test_bad_config():
    with pytest.raises(ValueError):
        SpatialConfig(dim=4)
    with pytest.raises(ValueError):
        SpatialConfig(height=1, periodic=True, extra_levels=0)


def test_image_intervals():
    for n, (low, high) in {-1: (-1, 1), 0: (-3, 3), 1: (-6, 5), 2: (-12, 11)}.items():
        cfg = SpatialConfig(periodic=True, extra_levels=n)
        assert cfg.image_interval == (low, high) and cfg.repetitions == high - low + 1
