"""Direct sums in chunks against plain loops, sets of any size, and points that coincide."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiersum.config import Ops, SpatialConfig
from hiersum.functions import kernels
from hiersum.plans import pairs
from hiersum.plans.fmm import Query, direct


def _points(spark, n, shift=0):
    at = lambda m: (F.col("pid") + shift) * m % 997 / 997.0
    return spark.range(n).select(F.col("id").alias("pid")).select("pid", at(431).alias("x"), at(257).alias("y"), at(613).alias("z"), (F.col("pid") % 3 + 1.0).alias("q"))


@pytest.mark.parametrize("cfg, far", [(SpatialConfig(height=3), False), (SpatialConfig(height=3), True), (SpatialConfig(height=2, periodic=True), False)])
def test_chunks_add_up_to_all_pairs(spark, monkeypatch, cfg, far):
    monkeypatch.setattr(pairs, "CHUNK", 30)
    one, two = _points(spark, 90), _points(spark, 70, 400)
    rows = {k: df.toPandas() for k, df in (("one", one), ("two", two))}
    low, high = cfg.image_interval
    for (t, s), same in {("one", "one"): True, ("one", "two"): False}.items():
        a, b = rows[t], rows[s]
        want = np.zeros(len(a))
        x, y = (r[["x", "y", "z"]].to_numpy() for r in (a, b))
        for image in product(range(low, high + 1), repeat=3):
            r = np.sqrt(((y[None] + np.array(image) - x[:, None]) ** 2).sum(2))
            off = np.eye(len(a), dtype=bool) if same and not any(image) else np.zeros(r.shape, bool)
            if far:
                off |= np.abs(np.floor(y * 4)[None] - np.floor(x * 4)[:, None]).max(2) <= 1
            want += np.where(off, 0, b["q"].to_numpy() / np.where(off, 1, r)).sum(1)
        df = {"one": one, "two": two}
        got = direct(df[t], df[s], cfg, kernels.InverseR(), same, far).orderBy("pid").toPandas()
        assert got["pid"].tolist() == a["pid"].tolist() and np.allclose(got["pot"], want, rtol=1e-13)


def test_direct_sums_have_no_largest_set(spark):
    sources = spark.range(500_001).select((F.col("id") + 5).alias("pid"), (F.col("id") / 1e6).alias("x"), F.lit(0.25).alias("y"), F.lit(0.5).alias("z"), F.lit(1.0).alias("q"))
    targets = spark.range(2).select(F.col("id").alias("pid"), F.lit(0.5).alias("x"), F.lit(0.75).alias("y"), F.lit(0.5).alias("z"), F.lit(1.0).alias("q"))
    got = direct(targets, sources, SpatialConfig(), kernels.InverseR2(), False).collect()
    want = (1 / ((np.arange(500_001) / 1e6 - 0.5) ** 2 + 0.25)).sum()
    assert [r["pot"] for r in got] == pytest.approx([want, want], rel=1e-13)


@pytest.mark.parametrize("batched_from", [0, 100])
def test_points_that_coincide_do_nothing_to_each_other(spark, monkeypatch, batched_from):
    monkeypatch.setattr(kernels.Pairwise, "batched_from", batched_from)
    rows = [(0, 0.25, 0.25, 0.25, 1.0), (1, 0.25, 0.25, 0.25, 1.0), (2, 0.25, 0.25, 0.75, 1.0)]
    points = spark.createDataFrame(rows, "pid long, x double, y double, z double, q double")
    others = points.where("pid > 0")
    cfg = SpatialConfig(height=2)
    for sources, want in ((None, [2, 2, 4]), (others, [2, 2, 2])):
        # of two sets, 2 stands on itself, and 0 and 1 on 1
        got = Query(cfg, kernels.InverseR(), points, sources, ops=Ops.NEAR).execute().orderBy("pid").collect()
        assert [r["pot"] for r in got] == pytest.approx(want) and [r["fz"] for r in got] == pytest.approx([4, 4, -8] if sources is None else [4, 4, -4])
    assert [r["pot"] for r in direct(points, points, cfg, kernels.InverseR(), True).orderBy("pid").collect()] == pytest.approx([2, 2, 4])
    assert [r["pot"] for r in direct(points, points, cfg, kernels.OneOverAPlusR2(1.0), True).orderBy("pid").collect()] == pytest.approx([1.8, 1.8, 1.6])


def _sums(kernel, seed=0):
    """Fields and gradients of both sides, with points that coincide and pairs that do not count."""
    draw, values = np.random.default_rng(seed), len(kernel.values)
    x = [draw.random(70) for _ in range(3)]
    sx = [np.r_[v[:5], draw.random(1200)] for v in x]
    into, back = pairs.nothing(kernel, 70, 3), pairs.nothing(kernel, 1205, 3)
    pairs.add(kernel, x, draw.random((70, values)), sx, draw.random((1205, values)), into, back, lambda r, c: np.add.outer(np.arange(r.start, r.stop), np.arange(c.start, c.stop)) % 7 == 0)
    return [*into, *back]


@pytest.mark.parametrize("kernel", [kernels.InverseR(), kernels.InverseR2(), kernels.LennardJones(), kernels.OneOverAPlusR2(0.5), kernels.AnisotropicInverseR((1.0, 2.0, 0.5)), kernels.Polynomial(), kernels.Many(kernels.InverseR(), ("a", "b"))], ids=lambda k: type(k).__name__)
def test_sums_by_squared_distance_are_those_by_distance(monkeypatch, kernel):
    assert pairs._radial(kernel)
    fast = _sums(kernel)
    monkeypatch.setattr(pairs, "_radial", lambda _: False)
    slow = _sums(kernel)
    assert all(np.allclose(a, b, rtol=1e-13, atol=1e-13 * np.abs(b).max()) for a, b in zip(fast, slow, strict=True))


def test_a_field_of_ones_own_is_asked():
    class Twice(kernels.InverseR):
        def field(self, d):
            k, slopes = super().field(d)
            return 2 * k, [2 * v for v in slopes]

    assert not pairs._radial(Twice()) and pairs._radial(kernels.InverseR()) and not pairs._radial(kernels.RTensor())
    assert all(np.allclose(a, 2 * b) for a, b in zip(_sums(Twice()), _sums(kernels.InverseR()), strict=True))


def test_potentials_without_forces(spark):
    points, kernel = _points(spark, 90), kernels.AnisotropicInverseR((1.0, 2.0, 0.5))
    cfg = SpatialConfig(height=3)
    whole, alone = (direct(points, points, cfg, k, True, far=True).orderBy("pid").toPandas() for k in (kernel, kernel.potential()))
    assert list(alone) == ["pid", "pot"] and alone["pot"].tolist() == whole["pot"].tolist()
    assert kernel.gradients and kernel.outputs == ("fx", "fy", "fz", "pot")


def test_rounded_fields_are_rounded_direct_sums(spark):
    from hiersum import queries as q

    points, cfg = q.parts(spark, "/root/testdata/sf0.01", 2), q.PLANE.with_(height=5)
    rounded = lambda df: {r["pid"]: r["pot"] for r in q._rounded(df.select("pid", "pot"), ["pot"], 1e3).collect()}
    want = rounded(direct(points, points, cfg, kernels.Log2D(4), True))
    assert rounded(Query(cfg, kernels.Log2D(4), points).execute()) != want
    assert rounded(q._settled(points, cfg, kernels.Log2D(4), [lambda: Query(cfg, kernels.Log2D(4), points).execute()], 1e3)) == want


def test_fine_sums_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CHUNK", 30)
    points, kernel = _points(spark, 2000), kernels.Polynomial().potential()
    x = points.orderBy("pid").toPandas()[["x", "y", "z"]].to_numpy()
    r2 = ((x[:, None] - x[None, :40]) ** 2).sum(2)
    # charges of 2**20 bring rounding into sums of groups, and the sum of all of a row is known to the last digit
    big = points.withColumn("q", F.lit(float(1 << 20)))
    got = direct(big.where("pid < 40"), big, SpatialConfig(), kernel, True, fine=True).orderBy("pid").toPandas()["pot"].to_numpy()
    from math import fsum

    want = np.array([fsum(((1 + v + v * v) * (1 << 20)).tolist()) - (1 << 20) for v in r2.T])
    assert np.abs(got - want).max() <= 2 * np.spacing(want.max())


GRID = [kernels.InverseR(), kernels.InverseR2().potential(), kernels.OneOverAPlusR2(0.5), kernels.AnisotropicInverseR((1.0, 2.0, 0.5)), kernels.Polynomial(), kernels.Many(kernels.InverseR(), ("a", "b")), kernels.RTensor(), kernels.RTensorProduct(), kernels.Log2D(4)]


@pytest.mark.parametrize("alike", [False, True])
@pytest.mark.parametrize("kernel", GRID, ids=lambda k: type(k).__name__)
def test_sums_on_a_grid_are_those_of_pairs(monkeypatch, kernel, alike):
    """With points that coincide, pairs that do not count, close pairs, an image, and a crowd that is summed by its pairs."""
    draw, values, dim = np.random.default_rng(1), len(kernel.values), 2 if isinstance(kernel, kernels.Log2D) else 3
    x = [draw.integers(0, 1 << 20, 301) / 2.0**20 for _ in range(dim)]
    others = [np.r_[v[:5], draw.integers(0, 1 << 20, 700) / 2.0**20, draw.integers(0, 1 << 10, 513) / 2.0**20] for v in x]
    x = [np.r_[v, draw.integers(0, 1 << 10, 300) / 2.0**20] for v in x]
    q, sq = (np.ones((n, values)) if alike else draw.random((n, values)) for n in (601, 1218))
    monkeypatch.setattr(pairs, "CLOSE", 1000)
    for shift in (0.0, 2.0):
        sx, sums = [v + shift for v in others], []
        for add in (pairs._add_on_grid, pairs._add_apart):
            into, back = pairs.nothing(kernel, 601, dim), pairs.nothing(kernel, 1218, dim)
            done = add(kernel, x, q, sx, sq, into, back, lambda r, c: np.add.outer(np.arange(r.start, r.stop), np.arange(c.start, c.stop)) % 7 == 0)
            sums.append([*into, *back])
        assert all(np.allclose(a, b, rtol=1e-11, atol=1e-14 * np.abs(b).max(initial=0.0)) for a, b in zip(*sums, strict=True))
    assert not pairs._add_on_grid(kernel, [v + 1e-9 for v in x], q, sx, sq, into, None, None)


def test_flat_trees_meet_by_chunks(spark, monkeypatch):
    """Two chunks meet once; a position outside of the box is still an error."""
    monkeypatch.setattr(kernels.Pairwise, "batched_from", 0)
    points, met = _points(spark, 90), []
    monkeypatch.setattr("hiersum.plans.fmm.direct", lambda *a: met.append(a[-1]) or direct(*a))
    for cfg in (SpatialConfig(height=1), SpatialConfig(height=2)):
        got, want = (df.orderBy("pid").toPandas() for df in (Query(cfg, kernels.InverseR(), points).execute(), direct(points, points, cfg, kernels.InverseR(), True)))
        assert np.allclose(got["pot"], want["pot"], rtol=1e-13) and np.allclose(got["fx"], want["fx"], rtol=1e-11)
    assert met == [True, True]
    with pytest.raises(Exception, match="outside the box: particle 3"):
        Query(SpatialConfig(height=2), kernels.InverseR(), points.withColumn("x", F.when(F.col("pid") == 3, 1.5).otherwise(F.col("x")))).execute().collect()


def test_a_finer_order_where_a_row_is_out_of_bound(spark, tmp_path):
    """Two boxes apart by one, the particles at the far corners of the expansion: order 12 is off by more than the bound."""
    from hiersum import queries as q

    spark.createDataFrame([(k,) for k in (25785, 62304, 9362, 39623, 14951)], "p_partkey bigint").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    run = q.QUERIES["lagrange_lennard_jones"]
    assert not all(r["ok"] for r in run(spark, str(tmp_path), orders=(12,)).collect())
    got = run(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(r["ok"] for r in got)
