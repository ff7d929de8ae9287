"""Queries that write binary formats from tables and read them again, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.viewport import discard_levels, with_defaults
from tessera.plans import stream_queries
from tessera.plans.common import REQUESTS_SQL, canvas, order_requests, part_images, shared_dir, table
from tessera.sources import codestream, jpp, requests, rtp
from tessera.streaming.frames import assemble_stream, message_stream
from tessera.streaming.sessions import serve_stream


def rtp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets, some broken, parsed again."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    raw = rtp.packet_bytes(
        i % 65536, i * 1500 % (1 << 32), F.col("user_id"), i % 5 == 4, i % 5 == 0, F.col("event_type") == "view", i % 256, F.unhex(F.repeat(F.lit("00"), (i % 50).cast("int")))
    )
    packets = e.select("event_id", F.when(i % 19 == 0, F.substring(raw, 1, 18)).otherwise(raw).alias("packet"))
    found = rtp.parse_packets(packets)
    return found.select(
        "event_id", F.coalesce("reject", F.lit("")).alias("reject"), "seq", "ts", "ssrc", "marker", F.coalesce("main", F.lit(False)).alias("main"),
        F.coalesce("r", F.lit(False)).alias("r"), F.coalesce("eseq", F.lit(-1)).alias("eseq"), F.col("length").cast("bigint").alias("length"),
    )


def jpp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream per document's text as a bin; its messages read again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("class"), F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("payload"))
    found = jpp.messages(jpp.emit(docs, ["doc_id"], "id"))
    return found.groupBy("doc_id").agg(
        F.count_if(F.col("eor").isNull()).alias("messages"), F.sum(F.when(F.col("eor").isNull(), F.col("msg_length"))).alias("bytes"),
        F.max("eor").cast("bigint").alias("eor"), F.count_if(F.col("is_last") & F.col("eor").isNull()).alias("last"),
    )


def marker_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A main header per part, written as bytes, and the image table read from it."""
    made = part_images(spark, sf_dir)
    raw = codestream.main_header_bytes(F.col("xsiz"), F.col("ysiz"), F.col("levels"), F.col("reversible"))
    found = codestream.images(codestream.markers(made.select("image_id", raw.alias("content"))), "image_id")
    return found.select(
        "image_id", "xsiz", "ysiz", F.col("levels").cast("bigint").alias("levels"), "reversible", F.size("comps").cast("bigint").alias("comps"),
        F.size("precincts").cast("bigint").alias("resolutions"), F.col("precincts")[0]["ppx"].cast("bigint").alias("ppx"),
    )


def request_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests written as query strings and read again; their discard levels follow as from the table."""
    asked = order_requests(spark, sf_dir)
    text = requests.format_request(*[F.col(c) for c in ("fx", "fy", "ox", "oy", "sx", "sy", "round", "comps")])
    read = requests.parse_requests(asked.select("req_id", "image_id", F.concat(F.lit("target=a&"), text).alias("query")))
    read = with_defaults(read.filter("error is null").drop("comps"))
    found = discard_levels(read.join(F.broadcast(canvas(spark)).drop("comps"), "image_id"))
    return found.select("req_id", "ox", "oy", "sx", F.col("k").cast("bigint").alias("k"))


def frame_assembly_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of frame_assembly, by a streaming query over the packets in files; open frames are not closed by it."""
    packets = stream_queries.event_packets(spark, sf_dir)
    found = in_steps(packets, assemble_stream, "arrival", "frames")
    return found.withColumn("meta_arrival", F.coalesce("meta_arrival", F.lit(-1)))


def in_steps(rows: DataFrame, stream, order: str, name: str, steps: int = 4) -> DataFrame:
    """What a streaming query gives for rows that come in so many steps, one after the other: it is started again for each, reads the
    files that have come by then, and goes on with its state. The rows are worked out once and written by many tasks, into
    the folder that driver and executors share."""
    spark = rows.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    width = ((hi or 0) - (lo or 0)) // steps + 1
    rows.withColumn("_step", F.expr(f"({order} - {lo or 0}) div {width}")).write.partitionBy("_step").parquet(f"{at}/staged")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path(f"{at}/in"))
    own = spark.newSession()  # so that the caller's settings stay as they are
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for k in range(steps):
        if store.exists(path(f"{at}/staged/_step={k}")):
            store.rename(path(f"{at}/staged/_step={k}"), path(f"{at}/in/{k}"))
        else:
            spark.createDataFrame([], rows.schema).write.parquet(f"{at}/in/{k}")
        source = own.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        query = stream(source).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
        query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


def session_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests of their customers' sessions: five bins each, of which only those are sent that no request before has had."""
    bins = "transform(sequence(0L, 4L), k -> named_struct('id', (o_orderkey + k * k * 3) % 40, 'size', 50 + (o_orderkey + k * k * 3) % 40 * 7))"
    asked = table(spark, sf_dir, "orders").selectExpr(
        "cast(o_custkey % 200 AS string) AS session", "o_orderkey AS request", f"array_distinct({bins}) AS bins", "cast(null AS bigint) AS budget",
        "cast(null AS array<struct<id: bigint, kind: string, bytes: bigint>>) AS model",
    )
    found = in_steps(asked, serve_stream, "request", "sessions")
    whole = F.col("id").isNull()
    return found.groupBy("session", "request").agg(
        F.count("id").alias("bins"), F.max(F.when(whole, F.col("sent"))).alias("bytes"), F.coalesce(F.sum("id"), F.lit(0)).alias("ids"), F.max("reason").cast("bigint").alias("reason")
    )


def jpp_resumed_streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams of jpp_parse in pieces of 700 bytes, which come in four micro-batches and cut messages anywhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("class"), F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("payload"))
    whole = jpp.emit(docs, ["doc_id"], "id").withColumn("k", F.explode(F.expr("sequence(0, (octet_length(bytes) - 1) div 700)")))
    cut = F.substring("bytes", F.col("k") * 700 + 1, F.lit(700)).alias("bytes")
    pieces = whole.select(F.col("doc_id").alias("stream_id"), F.col("k").cast("bigint").alias("arrival"), cut)
    found = in_steps(pieces, message_stream, "arrival", "messages")
    return found.groupBy(F.col("stream_id").alias("doc_id")).agg(
        F.count_if(F.col("eor").isNull()).alias("messages"), F.sum(F.when(F.col("eor").isNull(), F.col("msg_length"))).alias("bytes"),
        F.max("eor").cast("bigint").alias("eor"), F.count_if("is_last").alias("last"),
    )


QUERIES = {f.__name__: f for f in (rtp_parse, jpp_parse, marker_parse, request_parse, frame_assembly_streaming, jpp_resumed_streaming, session_responses)}

ORACLE_SQL = {
    "session_responses": """WITH q AS (SELECT (o_custkey % 200)::VARCHAR AS session, o_orderkey AS request, (o_orderkey + k.range * k.range * 3) % 40 AS id FROM orders, range(5) k),
f AS (SELECT session, id, min(request) AS request FROM q GROUP BY session, id),
s AS (SELECT session, request, count(*) AS bins, sum(50 + id * 7)::BIGINT AS bytes, sum(id)::BIGINT AS ids FROM f GROUP BY session, request)
SELECT o.session, o.request, coalesce(bins, 0) AS bins, coalesce(bytes, 0) AS bytes, coalesce(ids, 0) AS ids, 2::BIGINT AS reason
FROM (SELECT DISTINCT session, request FROM q) o LEFT JOIN s ON s.session = o.session AND s.request = o.request""",
    "rtp_parse": """WITH e AS (SELECT *, event_id % 19 = 0 AS cut FROM events)
SELECT event_id, CASE WHEN cut THEN 'overrun' ELSE '' END AS reject, event_id % 65536 AS seq, event_id * 1500 % 4294967296 AS ts, user_id AS ssrc, event_id % 5 = 4 AS marker,
  event_id % 5 = 0 AS main, event_id % 5 = 0 AND event_type = 'view' AS r, event_id % 256 AS eseq, CASE WHEN cut THEN 0 ELSE event_id % 50 END AS length FROM e""",
    "jpp_parse": """WITH d AS (SELECT doc_id, strlen(text) AS n FROM documents)
SELECT doc_id, greatest(1, (n + 986) // 987) AS messages, n AS bytes, 2::BIGINT AS eor, 1::BIGINT AS last FROM d""",
    "jpp_resumed_streaming": """WITH d AS (SELECT doc_id, strlen(text) AS n FROM documents)
SELECT doc_id, greatest(1, (n + 986) // 987) AS messages, n AS bytes, 2::BIGINT AS eor, 2::BIGINT AS last FROM d""",
    "marker_parse": """SELECT p_partkey AS image_id, 256 + 64 * p_size::BIGINT AS xsiz, 256 + 48 * (p_partkey % 32) AS ysiz, p_partkey % 6 AS levels, p_partkey % 2 = 1 AS reversible,
  3::BIGINT AS comps, p_partkey % 6 + 1 AS resolutions, 6::BIGINT AS ppx FROM part""",
    "request_parse": f"WITH {REQUESTS_SQL} SELECT req_id, ox, oy, sx, k FROM kk",
    "frame_assembly_streaming": stream_queries.ORACLE_SQL["frame_assembly"] + " WHERE status <> 'open'",
}
