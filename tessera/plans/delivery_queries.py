"""Queries over caches, byte limits and message framing, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cache
from tessera.operators.progression import ORDERS, in_progressions, ordered
from tessera.plans.common import table

BUDGET = 200_000
LRU_BUDGET = 20_000


def _holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS client", "l_partkey % 3630 AS id", "cast(20 * l_quantity AS bigint) AS bytes", "l_linestatus = 'F' AS complete"
    )
    return cache.merge_bins(rows, ["client", "id"])


def _needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_custkey % 100 AS client", "o_orderkey % 3630 AS id").distinct()


def cache_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.not_held(_needed(spark, sf_dir), _holdings(spark, sf_dir), ["client", "id"])


def cache_resume_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.resume_offsets(_needed(spark, sf_dir), _holdings(spark, sf_dir), ["client", "id"])


def cache_merge_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holdings(spark, sf_dir)


def cache_model_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = table(spark, sf_dir, "events").selectExpr(
        "user_id AS client", "event_id % 50 AS id", "event_id",
        "CASE event_type WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'complete' ELSE 'partial' END AS kind", "1 + event_id % 1400 AS bytes",
    )
    return cache.fold_model(statements, ["client", "id"], "event_id")


def cache_model_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _holdings(spark, sf_dir).filter("complete")
    return cache.model_text(cache.id_ranges(held, ["client"], "id"), ["client"], "P")


def byte_limited_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    sent = cache.deliver(bins, ["source"], "doc_id", "doc_id", "n_chars", BUDGET)
    return sent.groupBy("source").agg(
        F.count_if(F.col("is_last") & F.col("whole")).alias("whole_bins"), F.sum("sent").alias("payload"), F.count("*").alias("messages"),
        F.max("doc_id").alias("last_bin"),
    )


def message_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cache.messages(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars")
    return found.select("doc_id", F.col("message").cast("bigint").alias("message"), "msg_offset", "msg_length", "is_last")


def vbas_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"cast({cache.vbas_bytes('n_chars')} AS bigint) AS length_bytes", f"cast({cache.bin_id_bytes('doc_id')} AS bigint) AS id_bytes"
    )


def _touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_type", "user_id", "event_id", "event_id % 97 AS item", "1 + event_id % 1400 AS bytes")


def lru_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.lru_victims(_touches(spark, sf_dir), ["event_type"], "user_id", "event_id")


def lru_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.lru_kept(_touches(spark, sf_dir), ["user_id"], "item", "event_id", "bytes", LRU_BUDGET)


def zero_fill_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS client", "explode(sequence(0L, 3629L)) AS id")
    full = cache.zero_filled(clients, _holdings(spark, sf_dir), ["client", "id"])
    return full.groupBy("client").agg(F.count("*").alias("packets"), F.count_if("present").alias("present"), F.sum("bytes").alias("bytes"))


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS tile", "cast(l_linenumber AS bigint) AS layer", "l_suppkey % 6 AS r", "l_orderkey % 3 AS c", "l_orderkey % 64 AS p"
    )
    placed = rows.distinct()
    return placed.selectExpr("*", "(p div 8) * 64 * shiftleft(1L, cast(5 - r AS int)) AS y", "(p % 8) * 64 * shiftleft(1L, cast(5 - r AS int)) AS x")


def _progression(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = ordered(_packets(spark, sf_dir), name, ["tile"])
        return out.select("tile", "layer", "r", "c", "p", F.col("pos").cast("bigint").alias("pos"))

    return query


def progression_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = spark.createDataFrame(
        [(0, 0, 3, 0, 3, 4, "RLCP"), (1, 0, 6, 0, 1, 9, "CPRL"), (2, 0, 6, 0, 3, 9, "LRCP")],
        "change bigint, r_from int, r_to int, c_from int, c_to int, layer_to int, order string",
    )
    out = in_progressions(_packets(spark, sf_dir), changes, ["tile"])
    return out.select("tile", "layer", "r", "c", "p", "change", F.col("pos").cast("bigint").alias("pos"))


_HELD = """
h AS (SELECT l_suppkey AS client, l_partkey % 3630 AS id, max((20 * l_quantity)::BIGINT) AS bytes, bool_or(l_linestatus = 'F') AS complete FROM lineitem GROUP BY ALL),
n AS (SELECT DISTINCT o_custkey % 100 AS client, o_orderkey % 3630 AS id FROM orders)"""

_VBAS = "greatest(1, CASE WHEN {v} = 0 THEN 1 ELSE (floor(log2({v}))::BIGINT + 1 + 6) // 7 END)"
_BIN_ID = "CASE WHEN {v} = 0 THEN 1 ELSE (floor(log2({v}))::BIGINT + 1 + 3 + 6) // 7 END"

_MESSAGES = """
m AS (
  SELECT source, doc_id, n_chars, k.k AS message, k.k * 987 AS msg_offset, least(n_chars - k.k * 987, 987) AS msg_length,
    k.k = greatest(1, (n_chars + 986) // 987) - 1 AS is_last
  FROM documents, LATERAL (SELECT unnest(range(greatest(1, (n_chars + 986) // 987))) AS k) k
)"""

_PACKETS = """
raw AS (SELECT DISTINCT l_partkey AS tile, l_linenumber::BIGINT AS layer, l_suppkey % 6 AS r, l_orderkey % 3 AS c, l_orderkey % 64 AS p FROM lineitem),
pk AS (SELECT *, (p // 8) * 64 * (1 << (5 - r)) AS y, (p % 8) * 64 * (1 << (5 - r)) AS x FROM raw)"""

QUERIES = {
    "cache_anti_join": cache_anti_join,
    "cache_resume_offset": cache_resume_offset,
    "cache_merge_longest": cache_merge_longest,
    "cache_model_fold": cache_model_fold,
    "cache_model_ranges": cache_model_ranges,
    "byte_limited_delivery": byte_limited_delivery,
    "message_chunks": message_chunks,
    "vbas_length": vbas_length,
    "lru_victims": lru_victims,
    "lru_budget": lru_budget,
    "zero_fill_reassembly": zero_fill_reassembly,
    "progression_changes": progression_changes,
} | {f"progression_{k.lower()}": _progression(k) for k in ORDERS}

ORACLE_SQL = {
    "cache_anti_join": f"WITH {_HELD} SELECT n.* FROM n LEFT JOIN h ON h.client = n.client AND h.id = n.id AND h.complete WHERE h.client IS NULL",
    "cache_resume_offset": f"WITH {_HELD} SELECT n.*, coalesce(h.bytes, 0) AS skip FROM n LEFT JOIN h ON h.client = n.client AND h.id = n.id",
    "cache_merge_longest": f"WITH {_HELD} SELECT * FROM h",
    "cache_model_fold": """WITH e AS (SELECT user_id AS client, event_id % 50 AS id, event_id, event_type, 1 + event_id % 1400 AS bytes,
  max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id, event_id % 50) AS gone FROM events)
SELECT client, id, bool_or(event_type = 'purchase') AS complete, coalesce(max(CASE WHEN event_type <> 'purchase' THEN bytes END), 0) AS bytes
FROM e WHERE gone IS NULL OR event_id > gone GROUP BY ALL""",
    "cache_model_ranges": f"""WITH {_HELD}, k AS (SELECT client, id, id - row_number() OVER (PARTITION BY client ORDER BY id) AS g FROM h WHERE complete),
r AS (SELECT client, min(id) AS a, max(id) AS b FROM k GROUP BY client, g)
SELECT client, string_agg('P' || a || CASE WHEN b > a THEN '-' || b ELSE '' END, ',' ORDER BY a) AS model FROM r GROUP BY client""",
    "byte_limited_delivery": f"""WITH {_MESSAGES}, c AS (
  SELECT *, msg_length + {_BIN_ID.format(v="doc_id")} + {_VBAS.format(v="msg_offset")} + {_VBAS.format(v="msg_length")} AS cost FROM m
), s AS (
  SELECT *, {BUDGET} - coalesce(1 + sum(cost) OVER (PARTITION BY source ORDER BY doc_id, message ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM c
), o AS (SELECT *, least(msg_length, room - 60) AS sent FROM s WHERE room > 60)
SELECT source, count(*) FILTER (is_last AND sent = msg_length) AS whole_bins, sum(sent)::BIGINT AS payload, count(*) AS messages, max(doc_id) AS last_bin FROM o GROUP BY source""",
    "message_chunks": f"WITH {_MESSAGES} SELECT doc_id, message, msg_offset, msg_length, is_last FROM m",
    "vbas_length": f"SELECT doc_id, {_VBAS.format(v='n_chars')}::BIGINT AS length_bytes, ({_BIN_ID.format(v='doc_id')})::BIGINT AS id_bytes FROM documents",
    "lru_victims": """WITH u AS (SELECT event_type, user_id, max(event_id) AS seen FROM events GROUP BY ALL)
SELECT event_type, arg_min(user_id, seen) AS victim FROM u GROUP BY event_type""",
    "lru_budget": f"""WITH RECURSIVE e AS (
  SELECT user_id, event_id, event_id % 97 AS item, 1 + event_id % 1400 AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events
), f AS (
  SELECT user_id, 0::BIGINT AS n, []::STRUCT(item BIGINT, bytes BIGINT, seen BIGINT)[] AS held FROM e WHERE n = 1
  UNION ALL
  SELECT g.user_id, g.n, list_filter(g.held, lambda x, i: list_sum(list_transform(g.held[i:], lambda y: y.bytes)) <= {LRU_BUDGET}) FROM (
    SELECT e.user_id, e.n, list_append(list_filter(f.held, lambda x: x.item <> e.item), {{'item': e.item, 'bytes': e.bytes, 'seen': e.event_id}}) AS held
    FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) g
), last AS (SELECT user_id, max(n) AS n FROM e GROUP BY user_id)
SELECT user_id, h.item, h.seen AS last_touch, h.bytes FROM (SELECT f.user_id, unnest(f.held) AS h FROM f JOIN last ON last.user_id = f.user_id AND last.n = f.n)""",
    "zero_fill_reassembly": f"""WITH {_HELD}, g AS (SELECT s_suppkey AS client, i.range AS id FROM supplier, range(3630) i)
SELECT g.client, count(*) AS packets, count(h.client) AS present, sum(coalesce(h.bytes, 1))::BIGINT AS bytes
FROM g LEFT JOIN h ON h.client = g.client AND h.id = g.id GROUP BY g.client""",
    "progression_changes": f"""WITH {_PACKETS}, f AS (
  SELECT *, CASE WHEN r < 3 AND layer < 4 THEN 0 WHEN c < 1 AND layer < 9 THEN 1 WHEN layer < 9 THEN 2 END AS change FROM pk
)
SELECT tile, layer, r, c, p, change::BIGINT AS change, row_number() OVER (PARTITION BY tile ORDER BY change,
  CASE change WHEN 0 THEN [r, layer, c, p] WHEN 1 THEN [c, y, x, r, p, layer] ELSE [layer, r, c, p] END) - 1 AS pos
FROM f WHERE change IS NOT NULL""",
} | {
    f"progression_{k.lower()}": f"WITH {_PACKETS} SELECT tile, layer, r, c, p, row_number() OVER (PARTITION BY tile ORDER BY {', '.join(v)}) - 1 AS pos FROM pk"
    for k, v in ORDERS.items()
}
