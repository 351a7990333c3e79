"""Files read in splits, stored trees, and the state machine's Hilbert order."""

import pytest
from pyspark.sql import functions as F

from hiersum.config import SpatialConfig
from hiersum.functions import index as ix
from hiersum.operators import interactions, tree
from hiersum.sources import particles, stored


@pytest.mark.parametrize("split", ["40b", "300b", "128m"])
def test_lines_keep_their_numbers_in_any_split(spark, tmp_path, split):
    path = tmp_path / "points.fma"
    path.write_text("8 2\n200\n0.5 0.5 0.5 0.5\n" + "".join(f"{k / 256} 0.5 0.25 {k} 9\n" for k in range(250)))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "10b")
        rows, box = particles.read_fma(spark, str(path))
        n_splits = spark.read.text(str(path)).rdd.getNumPartitions()
        got = [tuple(r) for r in rows.orderBy("pid").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert got == [(k, k / 256, 0.5, 0.25, float(k)) for k in range(200)]
    assert tuple(box.first()) == (1.0, 0.5, 0.5, 0.5, 200, 2)
    assert n_splits > 20 or split != "40b"


def test_fma_folder_there_and_back(spark, tmp_path):
    points = particles.uniform(spark, 500, charge=0.25)
    points = spark.createDataFrame(points.collect(), points.schema).repartition(7)
    particles.write_fma(points, str(tmp_path / "set"), 0.5, (0.5, 0.5, 0.5))
    rows, box = particles.read_fma(spark, str(tmp_path / "set"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, points.collect())) and box.first()["n"] == 500
    empty = points.limit(0)
    particles.write_fma(empty, str(tmp_path / "none"), 0.5, (0.5, 0.5, 0.5))
    assert particles.read_fma(spark, str(tmp_path / "none"))[0].count() == 0


def test_stored_tree_reads_what_is_asked_for(spark, tmp_path, monkeypatch):
    cfg = SpatialConfig(height=4, centre=(0.5, 0.5, 0.5), periodic=True, extra_levels=1)
    points = particles.uniform(spark, 300).withColumn("name", F.concat(F.lit("p"), F.col("pid")))
    points = spark.createDataFrame(points.collect(), points.schema)
    monkeypatch.setattr(stored, "FOLDERS", 5)
    kept = stored.StoredTree(spark, stored.write(points, cfg, str(tmp_path / "tree"), 10).path)
    assert kept.cfg == cfg.with_(block_size=10)
    assert kept.header["particles"] == 300 and kept.header["blocks"] == -(-kept.header["leaves"] // 10)
    plain = tree.cells(points, cfg)
    columns = ["level", *cfg.boxes, "n"]
    assert sorted(map(tuple, kept.cells().select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))
    # a level's cells come from its folder alone, and blocks from theirs
    assert {f.split("level=")[1][0] for f in kept.cells(2).select("*", F.input_file_name().alias("f")).toPandas()["f"]} == {"2"}
    some = kept.particles(3, 7).select("*", F.input_file_name().alias("f"))
    per = kept.header["blocks_per_folder"]
    assert {int(f.split("folder=")[1].split("/")[0]) for f in some.toPandas()["f"]} <= set(range(3 // per, 7 // per + 1))
    assert {r["block"] for r in some.collect()} == set(range(3, 8))
    assert sorted(map(tuple, kept.particles().select(points.columns).collect())) == sorted(map(tuple, points.collect()))
    with pytest.raises(Exception, match="(?i)already exists"):
        stored.write(points, cfg, str(tmp_path / "tree"))


@pytest.mark.parametrize("level", [0, 1, 2, 3])
def test_state_machine_of_a_level(spark, level):
    """A bijection with its inverse at every level, whose steps along the curve are faces."""
    height = 5
    boxes = spark.range(8**level).select(F.col("id").alias("place"), *(b.alias(n) for b, n in zip(ix.hilbert_states_boxes(F.col("id"), level, height), ("ix", "iy", "iz"), strict=True)))
    rows = boxes.withColumn("again", ix.hilbert_states([F.col(b) for b in ("ix", "iy", "iz")], level, height)).orderBy("place").collect()
    assert all(r["again"] == r["place"] for r in rows) and len({(r["ix"], r["iy"], r["iz"]) for r in rows}) == 8**level
    assert all(0 <= v < 2**level for r in rows for v in (r["ix"], r["iy"], r["iz"]))
    assert all(sum(abs(a[b] - c[b]) for b in ("ix", "iy", "iz")) == 1 for a, c in zip(rows, rows[1:], strict=False))


def test_lists_of_the_state_machine(spark):
    """Children of a place lie in its box, up to the turn between two levels, and lists have the distances that they must have."""
    cfg = SpatialConfig(height=4)
    leaves = spark.range(512).select(*(b.alias(n) for b, n in zip(ix.morton_boxes(F.col("id"), 3, 3), cfg.boxes, strict=True)))
    at = lambda p: ix.hilbert_states([F.col(f"{p}{b}") for b in cfg.boxes], 3, 4)
    near = interactions.neighbour_list(leaves, leaves, cfg, own=False).select(at("").alias("t"), at("s_").alias("s"))
    back = lambda c: F.array(*ix.hilbert_states_boxes(F.col(c), 3, 4))
    far = F.array_max(F.zip_with(back("t"), back("s"), lambda a, b: F.abs(a - b)))
    assert near.select(far.alias("d")).agg(F.min("d"), F.max("d")).first()[:] == (1, 1)
    parents = leaves.select((F.shiftright(at(""), 3)).alias("parent"), *(F.shiftright(F.col(b), 1).alias(b) for b in cfg.boxes)).distinct()
    assert parents.count() == 64  # eight children of a place are the eight boxes of one parent box


def test_blocks_in_any_order(spark):
    cfg = SpatialConfig(height=3)
    leaves = tree.leaf_counts(particles.uniform(spark, 400), cfg)
    leaves = spark.createDataFrame(leaves.collect(), leaves.schema)
    rows = tree.ordered_blocks(leaves, -F.col("ix") * 100 + F.col("iy") * 10 + F.col("iz"), 7).orderBy("key").collect()
    assert [(r["block"], r["in_block"]) for r in rows] == [(k // 7, k % 7) for k in range(len(rows))]
