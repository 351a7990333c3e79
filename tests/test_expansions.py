"""Moves and transfers of the array expansions, several values a particle, and pairs that count for both."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiersum.config import Ops, SpatialConfig
from hiersum.functions import kernels
from hiersum.functions.expansions import SLOTS, Harmonic, Lagrange
from hiersum.operators import stats
from hiersum.plans.arrays import ArrayQuery
from hiersum.plans.fmm import Query, direct
from hiersum.sources import particles

RNG = np.random.default_rng(0)
OFFSETS = [(2, 0, 0), (0, -2, 0), (0, 0, 3), (-3, 2, 1), (3, 3, -3), (1, 0, -2)]


def _set(spark, n, **more):
    points = particles.uniform(spark, n, **more)
    return spark.createDataFrame(points.collect(), points.schema)


@pytest.mark.parametrize("order", [3, 6])
def test_moves_axis_by_axis_are_those_of_the_whole_matrix(order):
    e = Lagrange(order, kernels.Many(kernels.InverseR(), ("a", "b")))
    rows = RNG.normal(size=(4, 2 * e.size))
    for slot in range(8):
        whole = np.einsum("ia,jb,kc->ijkabc", *(e._child[h] for h in SLOTS[slot])).reshape(e.size, e.size)
        each = rows.reshape(-1, e.size)
        assert np.allclose(e.lift(slot, rows), (each @ whole).reshape(rows.shape), rtol=0, atol=1e-12)
        assert np.allclose(e.lower(slot, rows), (each @ whole.T).reshape(rows.shape), rtol=0, atol=1e-12)


@pytest.mark.parametrize("order", [2, 8, 12])
def test_rotations_transfer_as_the_whole_matrix_does(order):
    dense, turned = Harmonic(order, rotate=False), Harmonic(order, rotate=True)
    x, q = RNG.uniform(-1, 1, (50, 3)), RNG.normal(size=(50, 1))
    rows = dense.spectrum(dense.p2m(x, q).sum(0)[None])
    for o in OFFSETS:
        a, b = dense.transfer(o, rows, 1.0), turned.transfer(o, rows, 1.0)
        assert np.abs(a - b).max() <= 1e-12 * np.abs(a).max()


def test_harmonics_keep_a_real_for_each_coefficient():
    """Of (order + 1)**2 complex coefficients, half are conjugates of others; and the addition theorems hold on what is left."""
    e = Harmonic(10)
    x, q = RNG.uniform(-1, 1, (30, 3)), RNG.normal(size=(30, 1))
    assert e.size == 121 and e.p2m(x, q).shape == (30, 121) and e.p2m(x, q).dtype == np.float64
    # children's particles, seen by the parent
    for slot in range(8):
        parent = e.lift(slot, e.p2m(x, q).sum(0)[None])
        assert np.allclose(parent, e.p2m(x / 2 + SLOTS[slot] - 0.5, q).sum(0)[None], rtol=0, atol=1e-12)
    # and the field far away, with its gradient
    local = e.unspectrum(e.transfer((3, -2, 1), e.spectrum(e.p2m(x, q).sum(0)[None]), 1.0))
    y = RNG.uniform(-0.5, 0.5, (5, 3))
    pot, grad = e.l2p(y, local, np.zeros(5, int))
    d = x[None] + 2.0 * np.array([3, -2, 1]) - y[:, None]
    r = np.sqrt((d * d).sum(2))
    assert np.allclose(pot[:, 0], (q[:, 0] / r).sum(1), rtol=1e-3)
    assert np.allclose(grad[:, 0], (q[:, 0, None] * d / r[..., None] ** 3).sum(1), rtol=0, atol=2e-3 * np.abs(grad).max())


def test_spectra_of_opposite_offsets():
    for kernel in (kernels.InverseR(), kernels.RTensor()):
        e = Lagrange(4, kernel)
        for o in OFFSETS:
            n, step = 7, 2 / 3
            lag = np.where(np.arange(n) < 4, np.arange(n), np.arange(n) - n) * step
            d = np.meshgrid(*((2.0 * v - lag) for v in o), indexing="ij")
            for got, k in zip(e._kernels(o, 1.0), kernel.at_distance(d), strict=True):
                assert np.allclose(got, np.fft.rfftn(k), rtol=0, atol=1e-10)


class Counted(kernels.OneOverAPlusR2):
    """Counts the pairs that it is asked for."""

    def __init__(self, total):
        super().__init__(0.5)
        self.total = total

    def field(self, d):
        self.total.add(int(d[0].size))
        return super().field(d)


@pytest.mark.parametrize("cfg", [SpatialConfig(height=4), SpatialConfig(height=3, periodic=True), SpatialConfig(height=2)])
def test_pairs_of_one_set_are_evaluated_once(spark, cfg):
    points = _set(spark, 600)
    totals = []
    for sources in (None, points):  # as one set, and as two sets that happen to be equal
        total = spark.sparkContext.accumulator(0)
        kernel = Counted(total)
        got = ArrayQuery(cfg, Lagrange(3, kernel), points, sources, ops=Ops.NEAR).execute().collect()
        pots = {r["pid"]: r["pot"] for r in got}
        totals.append(total.value)
        want = {r["pid"]: r["pot"] - (2.0 if sources is None else 0) for r in Query(cfg, kernels.OneOverAPlusR2(0.5), points, points, ops=Ops.NEAR).execute().collect()}
        assert pots == pytest.approx(want)
    leaves = 8 ** (cfg.height - 1)
    assert totals[0] <= 0.5 * totals[1] + 0.6 * 600 * (600 / leaves + 2)  # half of all, and a leaf's own pairs twice


def test_shares_of_a_crowded_block(spark, monkeypatch):
    """Targets and what they meet in bounded shares add up, in one set and in two."""
    from hiersum.plans import arrays

    monkeypatch.setattr(arrays, "TARGETS", 40)
    monkeypatch.setattr(arrays, "SOURCES", 50)
    points, cfg = _set(spark, 300), SpatialConfig(height=4)
    points = points.withColumns({a: F.when(F.col("pid") < 200, F.col(a) / 9).otherwise(F.col(a)) for a in "xyz"})
    want = direct(points, points, cfg, kernels.InverseR(), True)
    got = ArrayQuery(cfg, Harmonic(8), points).execute()
    for field in ("pot", "fx"):
        assert stats.accuracy(got, want, field).first()["rel_l2"] < 1e-4
    others = _set(spark, 100, seed=5)
    got, want = ArrayQuery(cfg, Harmonic(8), others, points).execute(), direct(others, points, cfg, kernels.InverseR(), False)
    assert stats.accuracy(got, want, "pot").first()["rel_l2"] < 1e-4 and got.count() == 100


def test_data_of_a_table_by_pid(spark):
    points, cfg = _set(spark, 60), SpatialConfig(height=3)
    data = points.select("pid", (F.col("pid") % 5 - 2).cast("double").alias("heat"), F.lit("clash").alias("x"))
    kernel = kernels.Many(kernels.InverseR(), ("heat",))
    joined = points.join(data.select("pid", "heat"), "pid")
    want = direct(joined, joined, cfg, kernel, True)
    for got in (Query(cfg, kernel, points.drop("q"), data=data, ops=Ops.NEAR).execute(), ArrayQuery(cfg.with_(height=2), Lagrange(4, kernel), points.drop("q"), data=data).execute()):
        assert got.columns == ["pid", *kernel.outputs]
    assert stats.accuracy(got, want, "pot_heat").first()["rel_l2"] < 1e-12
    with pytest.raises(Exception, match="no data of particle"):
        Query(cfg, kernel, points, data=data.where("pid <> 7")).execute().collect()


def test_counts_need_positions_only(spark):
    points = _set(spark, 50).select("pid", "x", "y", "z")
    assert {r["rhs"] for r in Query(SpatialConfig(height=3), kernels.Count(), points).execute().collect()} == {49}


def test_particles_are_read_three_times(spark):
    """The plan that runs reads the placed particles for the moments, as targets and as what they meet."""
    points = _set(spark, 300)
    query = ArrayQuery(SpatialConfig(height=4), Harmonic(4), points)
    df = query.execute()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert query.s is query.t
    placed = [line for line in plan.split("\n") if "leaf#" in line and ("Scan ExistingRDD" in line or "InMemoryTableScan" in line)]
    assert 0 < len(placed) <= 4
