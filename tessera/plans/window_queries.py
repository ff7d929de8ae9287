"""Queries over geometry and view windows, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import geometry as geo
from tessera.operators import viewport as view
from tessera.plans.common import REQUESTS_SQL, SPANS_SQL, canvas, order_requests, part_images, table


def precinct_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = geo.resolutions(geo.tiles(part_images(spark, sf_dir)))
    return grid.groupBy("image_id", F.col("r").cast("bigint").alias("r")).agg(F.sum("npw").alias("npw"), F.sum("nph").alias("nph"), F.sum(F.expr("npw * nph")).alias("n"))


def precinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = geo.precincts(geo.resolutions(geo.tiles(part_images(spark, sf_dir))))
    return all_.groupBy("image_id", F.col("r").cast("bigint").alias("r")).agg(F.count("*").alias("n"), F.min("I").alias("first_id"), F.max("I").alias("last_id"), F.sum("I").alias("sum_ids"))


def precinct_id_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return geo.id_to_key(ids, "id", "4L", "3L").withColumn("again", F.expr("t + (c + s * 3) * 4"))


def resolution_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = geo.resolutions(geo.tiles(part_images(spark, sf_dir)))
    return grid.select("image_id", F.col("c").cast("bigint").alias("c"), F.col("r").cast("bigint").alias("r"), "s_offset")


def _levels(round_: str | None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = view.with_defaults(order_requests(spark, sf_dir))
        if round_:
            asked = asked.withColumn("round", F.lit(round_))
        found = view.discard_levels(asked.join(F.broadcast(canvas(spark)).drop("comps"), "image_id"))
        return found.select("req_id", F.col("k").cast("bigint").alias("k"))

    return query


def viewport_precincts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view.resolve_classes(order_requests(spark, sf_dir), canvas(spark))
    n = F.sum(F.col("n_each") * F.size("cs")).alias("n")
    return found.groupBy("req_id").agg(n, F.max("r").cast("bigint").alias("top"))


def viewport_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = order_requests(spark, sf_dir).withColumn("comps", F.expr("array(cast(req_id % 3 AS int), 7)"))
    found = view.resolve(asked, canvas(spark))
    return found.groupBy("req_id", F.col("c").cast("bigint").alias("c")).agg(F.sum("n_precincts").alias("n"))


def viewport_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = view.with_defaults(order_requests(spark, sf_dir)).join(F.broadcast(canvas(spark, 500)).drop("comps"), "image_id")
    found = view.window_tiles(view.canvas_boxes(view.discard_levels(asked)))
    return found.groupBy("req_id").agg(F.count("*").alias("n_tiles"), F.min("t").alias("first_tile"), F.max("t").alias("last_tile"))


def _gazes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS req_id", "0L AS image_id", "(event_id * 37) % 1920 AS gx", "(event_id * 53) % 1920 AS gy")


def _cones(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = view.foveated_requests(_gazes(spark, sf_dir), 1920, 1920, 128, 240)
    asked = asked.withColumn("req_id", F.struct("req_id", "cone")).drop("cone")
    found = view.resolve_classes(asked, canvas(spark))
    return found.withColumns({"cone": F.col("req_id.cone"), "req_id": F.col("req_id.req_id")})


def foveated_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct precincts of the three cones per gaze. Cones overlap in rectangles of one resolution, so the union is
    counted from the rectangles, without listing precincts."""
    found = view.union_counts(_cones(spark, sf_dir), ["req_id", "t", "cs", "r"], "cone", 3)
    return found.groupBy("req_id").agg(F.sum(F.col("n") * F.size("cs")).alias("n"))


def foveation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cones = _cones(spark, sf_dir).groupBy("req_id", "cone").agg(F.sum(F.col("n_each") * F.size("cs")).alias("n"))
    return cones.groupBy("cone").agg(
        F.count("*").alias("gazes"), F.sum("n").alias("precincts"), F.expr("sum(n) div count(*)").alias("mean_precincts"),
        F.max("n").alias("most"), F.round(F.sum("n") * 100.0 / (F.count("*") * 3630), 6).alias("percent_of_all"),
    )


_CONES_SQL = """
g AS (SELECT event_id AS req_id, (event_id * 37) % 1920 AS gx, (event_id * 53) % 1920 AS gy FROM events),
w AS (
  SELECT req_id, 0 AS cone, 0 AS k, greatest(gx - 128, 0) AS ox, greatest(gy - 128, 0) AS oy, 256 AS sx FROM g
  UNION ALL SELECT req_id, 1, 1, greatest(gx * 960 // 1920 - 120, 0), greatest(gy * 960 // 1920 - 120, 0), 240 FROM g
  UNION ALL SELECT req_id, 2, 3, 0, 0, 240 FROM g
), ok AS (
  SELECT *, ox * (1 << k) AS ax, oy * (1 << k) AS ay, least((ox + sx) * (1 << k), 1920) AS bx, least((oy + sx) * (1 << k), 1920) AS b2 FROM w
), rs AS (
  SELECT ok.*, r.range AS r, 1 << (5 - r.range) AS sc, CASE WHEN r.range = 5 THEN 0 ELSE 8 END AS m FROM ok, range(6) r WHERE r.range <= 5 - k AND ax < bx AND ay < b2
), sp AS (
  SELECT req_id, cone, r, greatest(ax // sc - m, 0) // 64 AS x0, greatest(ay // sc - m, 0) // 64 AS y0,
    least(((bx + sc - 1) // sc + m + 63) // 64, (1920 // sc + 63) // 64) AS x1,
    least(((b2 + sc - 1) // sc + m + 63) // 64, (1920 // sc + 63) // 64) AS y1 FROM rs
)"""

_GRID_SQL = """
im AS (SELECT p_partkey AS image_id, 256 + 64 * p_size AS w, 256 + 48 * (p_partkey % 32) AS h, p_partkey % 6 AS nl FROM part),
gr AS (
  SELECT image_id, r.range AS r, nl,
    (((w + (1 << (nl - r.range)) - 1) // (1 << (nl - r.range))) + 63) // 64 AS npw,
    (((h + (1 << (nl - r.range)) - 1) // (1 << (nl - r.range))) + 63) // 64 AS nph
  FROM im, range(6) r WHERE r.range <= nl
)"""


def _level_sql(rnd: int | None) -> str:
    sql = REQUESTS_SQL if rnd is None else REQUESTS_SQL.replace("o_orderkey % 3 AS rnd", f"{rnd} AS rnd")
    return f"WITH {sql} SELECT req_id, k FROM kk"


QUERIES = {
    "precinct_grid": precinct_grid,
    "precinct_ids": precinct_ids,
    "precinct_id_inverse": precinct_id_inverse,
    "resolution_prefix_sum": resolution_prefix_sum,
    "discard_level_down": _levels("down"),
    "discard_level_up": _levels("up"),
    "discard_level_closest": _levels("closest"),
    "viewport_precincts": viewport_precincts,
    "viewport_components": viewport_components,
    "viewport_tiles": viewport_tiles,
    "foveated_union": foveated_union,
    "foveation_summary": foveation_summary,
}

ORACLE_SQL = {
    "precinct_grid": f"WITH {_GRID_SQL} SELECT image_id, r, 3 * npw AS npw, 3 * nph AS nph, 3 * npw * nph AS n FROM gr",
    "precinct_ids": f"""WITH {_GRID_SQL}, of AS (
  SELECT image_id, r, npw * nph AS n, coalesce(sum(npw * nph) OVER (PARTITION BY image_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM gr
), ids AS (SELECT image_id, r, c.range + (s0 + p.p) * 3 AS i FROM of, LATERAL (SELECT unnest(range(n)) AS p) p, range(3) c)
SELECT image_id, r, count(*) AS n, min(i)::BIGINT AS first_id, max(i)::BIGINT AS last_id, sum(i)::BIGINT AS sum_ids FROM ids GROUP BY ALL""",
    "precinct_id_inverse": "SELECT p_partkey AS id, p_partkey % 4 AS t, (p_partkey // 4) % 3 AS c, p_partkey // 12 AS s, p_partkey AS again FROM part",
    "resolution_prefix_sum": f"""WITH {_GRID_SQL} SELECT image_id, c.range AS c, r,
  coalesce(sum(npw * nph) OVER (PARTITION BY image_id, c.range ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s_offset FROM gr, range(3) c""",
    "discard_level_down": _level_sql(0),
    "discard_level_up": _level_sql(1),
    "discard_level_closest": _level_sql(2),
    "viewport_precincts": f"WITH {SPANS_SQL} SELECT req_id, sum(3 * (x1 - x0) * (y1 - y0))::BIGINT AS n, max(r) AS top FROM sp WHERE x1 > x0 AND y1 > y0 GROUP BY req_id",
    "viewport_components": f"WITH {SPANS_SQL} SELECT req_id, req_id % 3 AS c, sum((x1 - x0) * (y1 - y0))::BIGINT AS n FROM sp WHERE x1 > x0 AND y1 > y0 GROUP BY req_id",
    "viewport_tiles": f"""WITH {SPANS_SQL}, tl AS (
  SELECT req_id, tx.range + 4 * ty.range AS t FROM ok, range(4) tx, range(4) ty
  WHERE tx.range * 500 < bx AND (tx.range + 1) * 500 > ax AND ty.range * 500 < b2 AND (ty.range + 1) * 500 > ay
) SELECT req_id, count(*) AS n_tiles, min(t) AS first_tile, max(t) AS last_tile FROM tl GROUP BY req_id""",
    "foveated_union": f"""WITH {_CONES_SQL}, cells AS (
  SELECT DISTINCT req_id, r, x.x, y.y FROM sp, LATERAL (SELECT unnest(range(x0, x1)) AS x) x, LATERAL (SELECT unnest(range(y0, y1)) AS y) y
) SELECT req_id, 3 * count(*) AS n FROM cells GROUP BY req_id""",
    "foveation_summary": f"""WITH {_CONES_SQL}, n AS (SELECT req_id, cone, sum(3 * (x1 - x0) * (y1 - y0))::BIGINT AS n FROM sp WHERE x1 > x0 AND y1 > y0 GROUP BY ALL)
SELECT cone::BIGINT AS cone, count(*) AS gazes, sum(n)::BIGINT AS precincts, sum(n)::BIGINT // count(*) AS mean_precincts, max(n) AS most,
  round(sum(n) * 100.0::DOUBLE / (count(*) * 3630), 6) AS percent_of_all FROM n GROUP BY cone""",
}
