"""What the findings of the fourth round were about, on small inputs."""

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import color
from tessera.operators import geometry, packets
from tessera.plans.registry import QUERIES
from tessera.sources import segments, streams


def test_colour_on_a_half(spark):
    """(16, 110, 54) gives 0.3 of 255 by the narrow BT.601 matrix, which is a half above 76."""
    df = spark.createDataFrame([(16, 110, 54)], "r int, g int, b int")
    out = color.ycbcr_rgb(F.col("r"), F.col("g"), F.col("b"), "BT601", "narrow", 8)
    assert tuple(df.select(*out).first()) == (0, 77, 0)


def _small_grid(spark):
    images = spark.range(3).selectExpr(
        "id AS image_id", "200L AS xsiz", "130L AS ysiz", "0L AS xosiz", "0L AS yosiz", "100L AS xtsiz", "130L AS ytsiz", "0L AS xtosiz", "0L AS ytosiz", "2 AS levels",
        "true AS reversible", "array(named_struct('xr', 1, 'yr', 1)) AS comps", "array_repeat(named_struct('ppx', 5, 'ppy', 5), 3) AS precincts",
    )
    return geometry.resolutions(geometry.tiles(images)), geometry.tiles(images).selectExpr("image_id", "t AS tile", "2 AS layers", "cast(image_id AS int) AS progression")


def test_packets_are_not_shuffled(spark):
    """Tiles are dealt before they have a row a packet: both explosions come after the last exchange."""
    found = packets.sequence(*_small_grid(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Exchange hash")]
    assert above.count("Generate explode") == 2
    assert found.groupBy("image_id", "tile").agg(F.countDistinct("number").alias("n"), F.max("number").alias("m")).filter("n <> m + 1").count() == 0


def test_lists_of_lengths(spark):
    """Several segments, a null among the lengths, no lengths, no list."""
    df = spark.createDataFrame([(1, [1, None, 128, 16384]), (2, []), (3, None)], "i int, v array<long>")
    got = {r[0]: r[1:] for r in df.select("i", segments.plt(F.col("v"), 3), segments.plm(7, F.array("v", "v"))).collect()}
    assert got[1] == ("ff58000600018100" + "ff58000601818000", "ff570011070601810081800006018100818000")
    assert got[2] == ("", "ff570005070000") and got[3] == ("", "ff57000307")


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Broadcast")


def test_no_table_of_images_is_broadcast(spark):
    """By the size of their files, these would fit into a broadcast at any number of images."""
    assert _broadcasts(QUERIES["tile_overrides"](spark, "/root/testdata/sf0.001")) == 0


def test_markers_of_many_parts_pass_together(spark):
    """One batch of markers for a batch of tile-parts, not one a part."""
    rows = [(f"f{i}", -1, 0, 0, 0, b"\xff\x4f\xff\x64\x00\x03a") for i in range(50)] + [(f"f{i}", 0, 9, 21, 30, b"\xff\x64\x00\x04ab") for i in range(50)]
    names = ["path", "part", "at", "begin", "end", "header"]
    batch = pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))
    assert [b.num_rows for b in streams._marker_batches(iter([batch, batch.slice(0, 0)]))] == [150]
    parts = spark.createDataFrame(rows, "path string, part int, at long, begin long, end long, header binary")
    got = {tuple(r) for r in streams.part_markers(parts).filter("path = 'f7'").collect()}
    assert got == {("f7", 0, -1, 0xFF64, 2, 6, 7, b"a"), ("f7", 0, 0, 0xFF64, 9, 13, 15, b"ab"), ("f7", 1, 0, 0xFF93, 19, 21, 30, None)}
