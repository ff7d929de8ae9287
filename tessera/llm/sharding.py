"""Balanced shards by sampled splitters, with DataFrame functions only.

Records are ordered by a key (hash of the text, then hash of the id) and cut into key ranges. The range
boundaries are quantiles of a sample in which a record is drawn with a chance proportional to its size.
The exact bytes of each range are then summed, ranges that came out overfull are subdivided by sampling
again inside them, and a record's shard follows from the exact number of bytes before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Sampled keys per range: the error of a quantile falls with its root.
DRAWS_PER_RANGE = 16
#: A range over so many times its fair share of rows or bytes is subdivided.
OVERFULL = 4
#: Rows of one range, about; the number of ranges grows with the rows up to MAX_RANGES.
ROWS_PER_RANGE = 200
MAX_RANGES = 1 << 14
#: Rounds of subdivision; keys are practically distinct, so one is nearly always enough.
MAX_ROUNDS = 4


def utf8_size(text: Column) -> Column:
    """Bytes of the text plus 8 for its header; a null text has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)


def _hex(h: Column) -> Column:
    return F.lpad(F.hex(h), 16, "0")


def _upper_bound(key: Column, splitters: list[str]) -> Column:
    """Number of splitters <= key, by halving steps over the sorted splitters."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    held = F.split(F.lit(",".join(splitters)), ",")
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(held, at + step - 1) <= key), at + step).otherwise(at),
    )


def _draw(slim: DataFrame, per_unit: float, seed: int) -> list[str]:
    """Keys drawn with chance min(1, size * per_unit); a key drawn from a large record stands for its size."""
    u = (F.xxhash64("_key", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))
    times = F.floor(F.col("_size") * F.lit(per_unit) + u).cast("int")
    rows = slim.select("_key", times.alias("_t")).filter("_t > 0").collect()
    return [k for k, t in sorted((r[0], r[1]) for r in rows) for _ in range(min(t, MAX_RANGES))]


def _quantiles(drawn: list[str], n: int) -> list[str]:
    if not drawn or n < 2:
        return []
    return sorted({drawn[len(drawn) * i // n] for i in range(1, n)})


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, size, text_crc32, law, shard, slot, grown_shard.

    Sizes of shards are near equal (law `bytes`): shard = the bytes before the record's middle, as a share
    of all bytes, times the number of shards; so shards differ by a record at most. Slots number a shard's
    records from 0 in key order. grown_shard is null under this law.
    Nulls: a null text counts 8 bytes and has a null text_crc32; a null id is kept. Repeated rows each get a slot of
    their own. An empty table gives no rows. Other columns of docs are not read.
    What reaches the driver: the sampled keys and one total per range, at most MAX_RANGES * DRAWS_PER_RANGE
    each, however large docs is.
    """
    text = F.col(text_col)
    # identical rows share a key but for the salt, which the written table makes permanent
    salted = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_n", F.monotonically_increasing_id())
    slim = materialize(
        salted.select(
            "_id",
            utf8_size(F.col("_text")).alias("_size"),
            F.crc32(F.encode("_text", "UTF-8")).alias("_crc"),
            F.concat(_hex(F.xxhash64("_text")), _hex(F.xxhash64("_id")), _hex(F.xxhash64("_n"))).alias("_key"),
        ),
        "shard-keys",
    )
    total, rows = slim.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    ranges = int(max(shards, min(MAX_RANGES, rows // ROWS_PER_RANGE)))
    splitters = _quantiles(_draw(slim, ranges * DRAWS_PER_RANGE / max(total, 1), 1), ranges)
    for round_no in range(MAX_ROUNDS):
        placed = slim.withColumn("_range", _upper_bound(F.col("_key"), splitters))
        sums = {r[0]: (r[1], r[2]) for r in placed.groupBy("_range").agg(F.sum("_size"), F.count("*")).collect()}
        full = [
            b for b, (s, n) in sums.items()
            if n > 1 and (s > OVERFULL * total / ranges or n > OVERFULL * max(rows / ranges, ROWS_PER_RANGE))
        ]
        if not full or round_no == MAX_ROUNDS - 1 or len(splitters) > 4 * MAX_RANGES:
            break
        # drawn half by size and half evenly, so that a range of one huge record and many small ones is cut, too
        held, held_bytes = sum(sums[b][1] for b in full), sum(sums[b][0] for b in full)
        inside = placed.filter(F.col("_range").isin(full)).withColumn("_size", F.col("_size") + held_bytes // max(held, 1))
        more = max(2 * len(full), 4 * held * ranges // max(rows, 1))
        splitters = sorted({*splitters, *_quantiles(_draw(inside, more * DRAWS_PER_RANGE / max(2 * held_bytes, 1), 2 + round_no), more)})
    before, start = {}, 0
    for b in sorted(sums):
        before[b] = start
        start += sums[b][0]
    n_ranges = len(splitters) + 1
    offsets = F.split(F.lit(",".join(str(before.get(b, 0)) for b in range(n_ranges))), ",")
    in_range = Window.partitionBy("_range").orderBy("_key")
    running = F.sum("_size").over(in_range.rowsBetween(Window.unboundedPreceding, 0))
    middle = F.get(offsets, F.col("_range")).cast("long") + running - F.col("_size") / 2
    ordered = placed.select(
        "*",
        F.least(F.floor(middle * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int").alias("_shard"),
        (F.row_number().over(in_range) - 1).alias("_at"),
    )
    ordered = materialize(ordered.drop("_key"), "shard-ranges")
    # a range spans few shards, so this table has about as many rows as there are ranges
    earlier = Window.partitionBy("_shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("_range", "_shard").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    table = parts.select(
        "_range", "_shard", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return ordered.join(F.broadcast(table), ["_range", "_shard"]).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_at") + F.col("_shift")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs as Parquet folders shard=0.. ; rows and shards are joined by id, so a null or repeated id is an error."""
    if docs.groupBy(id_col).count().filter(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1).count():
        raise ValueError(f"{id_col} has null or repeated values")
    placed = assign_shards(docs, shards, id_col, text_col).select(F.col(id_col).alias("_sid"), "shard", "slot")
    joined = docs.join(placed, F.col(id_col).eqNullSafe(F.col("_sid"))).drop("_sid")
    joined.repartitionByRange("shard", "slot").write.partitionBy("shard").parquet(path)
