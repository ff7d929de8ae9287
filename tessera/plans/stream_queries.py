"""Queries over packet streams and measurements, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import frames, quality
from tessera.plans.common import table


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet stream per user: five packets a frame, with losses and with frames that have lost their main packet."""
    number = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").withColumn("rn", number)
    kept = rows.filter("event_id % 17 <> 0")
    return kept.selectExpr(
        "user_id AS ssrc", "event_id AS arrival", "rn & 16777215 AS ext", "rn div 5 AS ts", "rn % 5 = 4 AS marker",
        "rn % 5 = 0 AND event_type <> 'error' AS main", "event_type = 'view' AS r", "1 + event_id % 1400 AS length",
    )


def frame_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.marked(event_packets(spark, sf_dir)).filter("gap").select("ssrc", "arrival", F.col("frame").alias("frame"))


def frame_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.assemble(event_packets(spark, sf_dir)).withColumn("meta_arrival", F.coalesce("meta_arrival", F.lit(-1)))


def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.stream_stats(frames.assemble(event_packets(spark, sf_dir)))


def tail_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.assemble(event_packets(spark, sf_dir)).filter("status = 'tail_loss'").select("ssrc", "frame", "ts", "packets")


def _triggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = frames.assemble(event_packets(spark, sf_dir)).filter("status = 'emitted'")
    return done.withColumn("slot", F.expr("ts div 4"))


def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.latest_wins(_triggered(spark, sf_dir), ["ssrc", "slot"], "ts", "frame")


def drop_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.drop_oldest(_triggered(spark, sf_dir), ["ssrc", "slot"], "ts", 2).select("ssrc", "slot", "frame", "ts", "bytes")


def pacer_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _triggered(spark, sf_dir).withColumn("ticks", F.expr("(4294967296 - 3000000 + ts * 1502) % 4294967296"))
    return frames.pacing(ticks, ["ssrc"], "frame", "ticks").select("ssrc", "frame", F.round("due", 9).alias("due"))


def bench_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "events").select("event_type", "value")
    at = {"p50": "floor(0.5 * (n - 1))", "p95": "floor(0.95 * (n - 1))", "median": "n div 2"}
    some = quality.order_statistics(values, ["event_type"], "value", at)
    ends = values.groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))
    return some.join(ends, "event_type")


def pae_mse_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    pixel = rows.selectExpr("vec_id", "label", "posexplode(embedding) AS (x, v)").selectExpr(
        "vec_id AS image", "label AS c", "x", "cast(1024 * cast(v AS double) AS int) AS v"
    )
    shifted = pixel.withColumn("v", F.expr("v + cast((image * 7 + x) % 5 AS int) - 2"))
    found = quality.compare(pixel, shifted, ["image", "c", "x"], ["c"], "v", 12)
    return found.select(F.col("c").cast("bigint").alias("c"), "n", F.col("pae").cast("bigint").alias("pae"), F.round("mse", 6).alias("mse"), F.round("psnr", 6).alias("psnr"))


_FRAMES = """
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events),
p AS (
  SELECT user_id AS ssrc, event_id AS arrival, rn AS ext, rn // 5 AS ts, rn % 5 = 4 AS marker, rn % 5 = 0 AND event_type <> 'error' AS main,
    event_type = 'view' AS r, 1 + event_id % 1400 AS len FROM e WHERE event_id % 17 <> 0
), a AS (
  SELECT *, coalesce(ext <> (lag(ext) OVER w + 1) & 16777215, false) AS gap,
    CASE WHEN coalesce(lag(marker) OVER w OR lag(ts) OVER w <> ts, true) THEN 1 ELSE 0 END AS new,
    CASE WHEN main AND r AND len > 0 THEN arrival END AS keep FROM p WINDOW w AS (PARTITION BY ssrc ORDER BY arrival)
), b AS (
  SELECT *, sum(new) OVER (PARTITION BY ssrc ORDER BY arrival ROWS UNBOUNDED PRECEDING)::BIGINT AS frame,
    max(keep) OVER (PARTITION BY ssrc ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM a
), f AS (
  SELECT ssrc, frame, min(ts) AS ts, count(*) AS packets, sum(len)::BIGINT AS own, count(*) FILTER (gap) AS gaps, arg_max(marker, arrival) AS ended,
    arg_min(main, arrival) AS first_main, min(arrival) AS first_at, max(CASE WHEN main THEN arrival END) AS meta_arrival,
    max(frame) OVER (PARTITION BY ssrc) AS last_frame FROM b GROUP BY ssrc, frame
), g AS (
  SELECT f.*, CASE WHEN first_main THEN 0 ELSE coalesce(1 + b.kept % 1400, 0) END AS prefix, b.kept IS NOT NULL AS any_kept
  FROM f JOIN b ON b.ssrc = f.ssrc AND b.arrival = f.first_at
), fr AS (
  SELECT ssrc, frame, ts, packets, own + prefix AS bytes, gaps,
    CASE WHEN NOT ended AND frame = last_frame THEN 'open' WHEN gaps > 0 THEN 'lossy' WHEN NOT ended THEN 'tail_loss'
      WHEN NOT first_main AND NOT any_kept THEN 'no_header' WHEN own + prefix = 0 THEN 'empty' ELSE 'emitted' END AS status, meta_arrival FROM g
)"""

QUERIES = {
    "frame_gaps": frame_gaps,
    "frame_assembly": frame_assembly,
    "frame_stats": frame_stats,
    "tail_loss": tail_loss,
    "latest_wins": latest_wins,
    "drop_oldest": drop_oldest,
    "pacer_targets": pacer_targets,
    "bench_quantiles": bench_quantiles,
    "pae_mse_psnr": pae_mse_psnr,
}

ORACLE_SQL = {
    "frame_gaps": f"WITH {_FRAMES} SELECT ssrc, arrival, frame FROM b WHERE gap",
    "frame_assembly": f"WITH {_FRAMES} SELECT * REPLACE (coalesce(meta_arrival, -1) AS meta_arrival) FROM fr",
    "frame_stats": f"""WITH {_FRAMES} SELECT ssrc, count(*) FILTER (status = 'emitted') AS emitted, count(*) FILTER (status NOT IN ('emitted', 'open')) AS dropped,
  sum(gaps)::BIGINT AS gaps, count(*) FILTER (status = 'tail_loss') AS tail_loss, coalesce(sum(CASE WHEN status = 'emitted' THEN bytes END), 0)::BIGINT AS bytes FROM fr GROUP BY ssrc""",
    "tail_loss": f"WITH {_FRAMES} SELECT ssrc, frame, ts, packets FROM fr WHERE status = 'tail_loss'",
    "latest_wins": f"WITH {_FRAMES} SELECT ssrc, ts // 4 AS slot, arg_max(frame, ts) AS kept, count(*) - 1 AS evicted FROM fr WHERE status = 'emitted' GROUP BY ALL",
    "drop_oldest": f"""WITH {_FRAMES}, n AS (SELECT ssrc, ts // 4 AS slot, frame, ts, bytes, row_number() OVER (PARTITION BY ssrc, ts // 4 ORDER BY ts DESC) AS n FROM fr WHERE status = 'emitted')
SELECT ssrc, slot, frame, ts, bytes FROM n WHERE n <= 2""",
    "pacer_targets": f"""WITH {_FRAMES}, t AS (SELECT ssrc, frame, ts, min(ts) OVER (PARTITION BY ssrc) AS first FROM fr WHERE status = 'emitted')
SELECT ssrc, frame, round((ts - first) * 1502 / 90000.0::DOUBLE, 9) AS due FROM t""",
    "bench_quantiles": """WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, any_value(n) AS n, max(value) FILTER (i = floor(0.5 * (n - 1))) AS p50, max(value) FILTER (i = floor(0.95 * (n - 1))) AS p95,
  max(value) FILTER (i = n // 2) AS median, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM v GROUP BY event_type""",
    "pae_mse_psnr": """WITH d AS (SELECT label AS c, (vec_id * 7 + x.range) % 5 - 2 AS d FROM embeddings, range(64) x)
SELECT c::BIGINT AS c, count(*) AS n, max(abs(d)) AS pae, round(avg((d * d)::DOUBLE), 6) AS mse, round(10 * log10(4095.0::DOUBLE * 4095 / avg((d * d)::DOUBLE)), 6) AS psnr FROM d GROUP BY ALL""",
}
