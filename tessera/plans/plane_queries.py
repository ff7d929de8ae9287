"""Queries over planes, ranges and headers, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import quant
from tessera.operators import windows
from tessera.plans import sample_queries
from tessera.plans.common import order_requests, part_images, table
from tessera.sources.codestream import effective_coding


def column_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = order_requests(spark, sf_dir).selectExpr("req_id", "ox", "ox + sx AS right")
    found = windows.clip(windows.level_ranges(asked, "ox", "right", 5), "1920 div shiftleft(1, level)")
    return found.select("req_id", F.col("level").cast("bigint").alias("level"), "lo", "hi")


def row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 6 of each vector's plane, columns vec_id % 4 to 7, and their sums."""
    plane = sample_queries._planes(spark, sf_dir)
    cut = windows.cut_rows(plane, F.lit(2), F.lit(7), F.col("vec_id") % 4, F.lit(8))
    return cut.select("vec_id", F.col("y").cast("bigint").alias("y"), F.size("row").cast("bigint").alias("n"), F.aggregate("row", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


def tile_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes cut into tiles of three columns and put together again."""
    plane = sample_queries._planes(spark, sf_dir)
    pieces = plane.select("vec_id", "y", F.explode(F.sequence(F.lit(0), F.lit(6), F.lit(3))).alias("x0"), "row")
    pieces = pieces.withColumn("row", F.expr("slice(row, x0 + 1, 3)"))
    whole = windows.mosaic(pieces, ["vec_id"], "y", "x0", "row")
    return whole.select("vec_id", F.col("y").cast("bigint").alias("y"), F.posexplode("row").alias("x", "v")).select(
        "vec_id", "y", F.col("x").cast("bigint").alias("x"), F.col("v").cast("bigint").alias("v")
    )


def gaze_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = part_images(spark, sf_dir).select("image_id", "xsiz", "ysiz")
    return windows.gaze_grid(sizes, 5, "xsiz", "ysiz").select("image_id", "gx", "gy")


def magb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "cast(l_orderkey % 3 AS int) AS style", "l_partkey % 32 AS eps")
    return windows.magb(rows, ["l_orderkey"], "style", "eps")


def min_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    comps = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS image_id", "l_partkey % 7 AS levels")
    return windows.safe_reduction(comps, ["image_id"])


def coding_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_partkey % 2 = 0 AS tile_has_coc", "if(p_partkey % 4 = 0, 'tile component', null) AS tile_coc",
        "if(p_partkey % 3 = 0, 'main component', null) AS main_coc", "if(p_partkey % 5 = 0, 'tile', null) AS tile_cod", "'main' AS main_cod",
    )
    return effective_coding(rows).select("p_partkey", "coding")


def quantiser_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of factor p_partkey % 100 + 1 for each part, as a line of text."""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "1 + p_partkey % 100 AS q")
    made = quant.steps(parts.join(F.broadcast(quant.bands(spark, 5))), "q", "Y", 8)
    words = made.groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("band", "word"))).alias("w"))
    return words.select("p_partkey", windows.quantiser_line(F.lit("QCD"), F.transform("w", lambda x: x["word"])).alias("line"))


QUERIES = {f.__name__: f for f in (column_ranges, row_range, tile_mosaic, gaze_grid, magb, min_levels, coding_precedence, quantiser_dump)}

_VEC = sample_queries._VEC
ORACLE_SQL = {
    "column_ranges": """WITH RECURSIVE w AS (
  SELECT o_orderkey AS req_id, 0 AS level, o_custkey % (1 + o_orderkey % 1920) AS lo, o_custkey % (1 + o_orderkey % 1920) + 1 + o_orderkey % 400 AS hi FROM orders
  UNION ALL SELECT req_id, level + 1, (lo >> 1) - 4, ((hi + 1) >> 1) + 4 FROM w WHERE level < 4
), c AS (SELECT req_id, level::BIGINT AS level, lo, greatest(least(hi, 1920 // (1 << level)), 0)::BIGINT AS hi FROM w)
SELECT req_id, level, least(greatest(lo, 0), hi)::BIGINT AS lo, hi FROM c""",
    "row_range": f"""WITH {_VEC} SELECT vec_id, x // 8 AS y, count(*) AS n, sum(v)::BIGINT AS total FROM s
WHERE x // 8 >= 2 AND x // 8 < 7 AND x % 8 >= vec_id % 4 GROUP BY ALL""",
    "tile_mosaic": f"WITH {_VEC} SELECT vec_id, x // 8 AS y, x % 8 AS x, v FROM s",
    "gaze_grid": """SELECT p_partkey AS image_id, (x.range * (255 + 64 * p_size)) // 4 AS gx, (y.range * (255 + 48 * (p_partkey % 32))) // 4 AS gy FROM part, range(5) x, range(5) y""",
    "magb": "SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN max(l_partkey % 32) ELSE min(l_partkey % 32) END AS magb FROM lineitem GROUP BY l_orderkey",
    "min_levels": "SELECT l_orderkey AS image_id, min(l_partkey % 7) AS most FROM lineitem GROUP BY l_orderkey",
    "coding_precedence": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'tile component' WHEN p_partkey % 2 = 1 AND p_partkey % 3 = 0 THEN 'main component'
  WHEN p_partkey % 5 = 0 THEN 'tile' ELSE 'main' END AS coding FROM part""",
    "quantiser_dump": f"""{sample_queries._WORDS_SQL}, l AS (SELECT q, string_agg(lower(printf('%04x', eps * 2048 + mu)), ' ' ORDER BY band) AS words FROM pk WHERE component = 'Y' GROUP BY q)
SELECT p_partkey, 'QCD     : ' || words AS line FROM part JOIN l ON l.q = 1 + p_partkey % 100""",
}
