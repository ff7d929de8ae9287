"""Tables and fixed geometries that the registered queries share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

GEOMETRY = "image_id bigint, xsiz bigint, ysiz bigint, xosiz bigint, yosiz bigint, xtsiz bigint, ytsiz bigint, xtosiz bigint, ytosiz bigint, levels int, reversible boolean, comps array<struct<xr: int, yr: int>>, precincts array<struct<ppx: int, ppy: int>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one if they are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tessera-")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder: what a query reads several times is not worked out again each time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def canvas(spark: SparkSession, tile: int = 1920) -> DataFrame:
    """One image of 1920 x 1920 samples, three components, five levels, precincts of 64 x 64, 9/7 filters."""
    return spark.range(1).selectExpr(
        "0L AS image_id", "1920L AS xsiz", "1920L AS ysiz", "0L AS xosiz", "0L AS yosiz", f"{tile}L AS xtsiz", f"{tile}L AS ytsiz",
        "0L AS xtosiz", "0L AS ytosiz", "5 AS levels", "false AS reversible",
        "array_repeat(named_struct('xr', 1, 'yr', 1), 3) AS comps", "array_repeat(named_struct('ppx', 6, 'ppy', 6), 6) AS precincts",
    )


def part_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image per part: its size and number of levels follow from the part's size and key."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS image_id", "256L + 64L * p_size AS xsiz", "256L + 48L * (p_partkey % 32) AS ysiz", "0L AS xosiz", "0L AS yosiz",
        "256L + 64L * p_size AS xtsiz", "256L + 48L * (p_partkey % 32) AS ytsiz", "0L AS xtosiz", "0L AS ytosiz",
        "cast(p_partkey % 6 AS int) AS levels", "p_partkey % 2 = 1 AS reversible",
        "array_repeat(named_struct('xr', 1, 'yr', 1), 3) AS comps", "array_repeat(named_struct('ppx', 6, 'ppy', 6), 6) AS precincts",
    )


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One view-window request per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS req_id", "0L AS image_id", "1 + o_orderkey % 1920 AS fx", "1 + o_orderkey % 1920 AS fy",
        "o_custkey % (1 + o_orderkey % 1920) AS ox", "(o_custkey * 7) % (1 + o_orderkey % 1920) AS oy",
        "1 + o_orderkey % 400 AS sx", "1 + o_orderkey % 400 AS sy", "cast(null AS array<int>) AS comps",
        "CASE o_orderkey % 3 WHEN 0 THEN 'down' WHEN 1 THEN 'up' ELSE 'closest' END AS round",
    )


#: The same requests in SQL, with their discard level k.
REQUESTS_SQL = """
rq AS (
  SELECT o_orderkey AS req_id, 1 + o_orderkey % 1920 AS fx, o_custkey % (1 + o_orderkey % 1920) AS ox,
    (o_custkey * 7) % (1 + o_orderkey % 1920) AS oy, 1 + o_orderkey % 400 AS sx, o_orderkey % 3 AS rnd FROM orders
), lv AS (
  SELECT rq.*, q.range AS q, (1920 + (1 << q.range) - 1) // (1 << q.range) AS w FROM rq, range(6) q
), kk AS (
  SELECT req_id, any_value(fx) AS fx, any_value(ox) AS ox, any_value(oy) AS oy, any_value(sx) AS sx, any_value(rnd) AS rnd,
    CASE any_value(rnd) WHEN 0 THEN coalesce(min(q) FILTER (w <= fx), 5) WHEN 1 THEN coalesce(max(q) FILTER (w >= fx), 0)
      ELSE arg_min(q, abs(w * w - fx * fx) * 10 + q) END AS k
  FROM lv GROUP BY req_id
)"""

#: Per request and resolution, the precinct span on each axis of the canvas of one tile.
SPANS_SQL = (
    REQUESTS_SQL
    + """, bx AS (
  SELECT req_id, k, ox * (1 << k) AS ax, oy * (1 << k) AS ay, least((ox + sx) * (1 << k), 1920) AS bx, least((oy + sx) * (1 << k), 1920) AS b2 FROM kk
), ok AS (SELECT * FROM bx WHERE ax < bx AND ay < b2),
rs AS (
  SELECT ok.*, r.range AS r, 1 << (5 - r.range) AS sc, CASE WHEN r.range = 5 THEN 0 ELSE 8 END AS m FROM ok, range(6) r WHERE r.range <= greatest(5 - k, 0)
), sp AS (
  SELECT req_id, r, greatest(ax // sc - m, 0) // 64 AS x0, greatest(ay // sc - m, 0) // 64 AS y0,
    least(((bx + sc - 1) // sc + m + 63) // 64, (1920 // sc + 63) // 64) AS x1,
    least(((b2 + sc - 1) // sc + m + 63) // 64, (1920 // sc + 63) // 64) AS y1
  FROM rs
)"""
)
