"""Queries over byte layouts, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import layout
from tessera.plans.common import table


def offset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets into tiles of seven tile-parts each, by supplier, as places in a file; some lie past the end."""
    parts = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS tile", "explode(sequence(0L, 6L)) AS part").selectExpr(
        "tile", "part", "tile * 100000 + part * 9000 + 90 AS begin", "tile * 100000 + part * 9000 + 90 + (tile * 31 + part * 17) % 400 AS end"
    )
    offsets = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS tile", "(l_orderkey * 7 + l_partkey) % 1500 AS offset").distinct()
    return layout.absolute_offsets(offsets, parts, ["tile"]).withColumn("absolute", F.coalesce("absolute", F.lit(-1)))


def reassembled_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of 64 packets per part, in layer order, of which the lines hold some; as hashes of their bytes."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS tile", "l_orderkey % 4 AS layer", "l_suppkey % 16 AS p", "cast(l_quantity AS int) AS q")
    bins = lines.groupBy("tile", "layer", "p").agg(F.max("q").alias("q"))
    bins = bins.withColumn("payload", F.encode(F.concat(F.lit("<"), F.col("q").cast("string"), F.lit(">")), "UTF-8"))
    grid = table(spark, sf_dir, "part").selectExpr("p_partkey AS tile", "explode(sequence(0L, 3L)) AS layer").selectExpr("*", "explode(sequence(0L, 15L)) AS p")
    body = layout.reassemble(grid, bins, ["tile", "layer", "p"], ["tile"], ["layer", "p"])
    return body.select("tile", F.octet_length("body").cast("bigint").alias("bytes"), F.md5("body").alias("md5"))


QUERIES = {f.__name__: f for f in (offset_lookup, reassembled_body)}

ORACLE_SQL = {
    "offset_lookup": """WITH p AS (SELECT s_suppkey AS tile, k.range AS part, s_suppkey * 100000 + k.range * 9000 + 90 AS b, (s_suppkey * 31 + k.range * 17) % 400 AS n FROM supplier, range(7) k),
f AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY tile ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM p),
o AS (SELECT DISTINCT l_suppkey AS tile, (l_orderkey * 7 + l_partkey) % 1500 AS "offset" FROM lineitem)
SELECT o.tile, o."offset", coalesce(f.b + o."offset" - f.first, -1)::BIGINT AS absolute FROM o LEFT JOIN f ON f.tile = o.tile AND o."offset" >= f.first AND o."offset" < f.first + f.n""",
    "reassembled_body": """WITH b AS (SELECT l_partkey AS tile, l_orderkey % 4 AS layer, l_suppkey % 16 AS p, '<' || max(l_quantity::INT) || '>' AS s FROM lineitem GROUP BY ALL),
g AS (SELECT p_partkey AS tile, l.range AS layer, p.range AS p FROM part, range(4) l, range(16) p),
j AS (SELECT g.tile, string_agg(coalesce(b.s, chr(0)), '' ORDER BY g.layer, g.p) AS body FROM g LEFT JOIN b ON b.tile = g.tile AND b.layer = g.layer AND b.p = g.p GROUP BY g.tile)
SELECT tile, strlen(body) AS bytes, md5(body) AS md5 FROM j""",
}
