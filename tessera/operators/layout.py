"""Where packets are in a codestream's bytes, and codestreams put together from the bins at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def body_starts(tile_parts: DataFrame, by: list[str]) -> DataFrame:
    """Adds first: how many body bytes of the tile come before a tile-part. tile_parts: by..., part, begin, end."""
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return tile_parts.withColumn("first", F.coalesce(F.sum(F.col("end") - F.col("begin")).over(earlier), F.lit(0)))


def absolute_offsets(offsets: DataFrame, tile_parts: DataFrame, by: list[str], offset: str = "offset") -> DataFrame:
    """Adds absolute: the place in the file of an offset into a tile's bodies, taken as one; null past their end."""
    starts = body_starts(tile_parts, by)
    span = (F.col(offset) >= F.col("_first")) & (F.col(offset) < F.col("_first") + F.col("_size"))
    placed = starts.select(*by, F.col("first").alias("_first"), (F.col("end") - F.col("begin")).alias("_size"), F.col("begin").alias("_begin"))
    on = span
    for c in by:
        placed = placed.withColumnRenamed(c, f"_{c}")
        on = on & (F.col(c) == F.col(f"_{c}"))
    joined = offsets.join(placed, on, "left")
    return joined.select(*offsets.columns, (F.col("_begin") + F.col(offset) - F.col("_first")).alias("absolute"))


def precinct_payload(packets: DataFrame, keys: list[str], order: str = "layer", payload: str = "payload") -> DataFrame:
    """Each precinct's packets, one after the other: keys..., ranges [(offset, length)], payload."""
    listed = F.array_sort(F.collect_list(F.struct(order, "offset", "length")))
    joined = F.expr(f"listagg({payload}, x'') WITHIN GROUP (ORDER BY {order}, offset, length)")
    held = packets.groupBy(*keys).agg(listed.alias("_l"), F.coalesce(joined, F.lit(b"")).alias("payload"))
    ranges = F.transform("_l", lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length")))
    return held.select(*keys, ranges.alias("ranges"), "payload")


def reassemble(grid: DataFrame, bins: DataFrame, keys: list[str], by: list[str], order: list[str], payload: str = "payload") -> DataFrame:
    """by..., body: the tile's packets in order, a zero byte (an empty packet) for each one that is not at hand."""
    present = bins.select(*keys, F.col(payload).alias("_p"))
    filled = grid.join(present, keys, "left").withColumn("_p", F.coalesce("_p", F.lit(b"\x00")))
    return filled.groupBy(*by).agg(F.expr(f"listagg(_p, x'') WITHIN GROUP (ORDER BY {', '.join(order)})").alias("body"))


def bytes_by(packets: DataFrame, by: list[str], length: str = "length") -> DataFrame:
    """by..., packets, bytes: what a tile, or a codestream, takes."""
    return packets.groupBy(*by).agg(F.count("*").alias("packets"), F.sum(length).alias("bytes"))


def pass_starts(passes: DataFrame, by: list[str], layer: str, count: str) -> DataFrame:
    """Adds start: how many coding passes of a block (by) the layers before this one hold."""
    earlier = Window.partitionBy(*by).orderBy(layer).rowsBetween(Window.unboundedPreceding, -1)
    return passes.withColumn("start", F.coalesce(F.sum(count).over(earlier), F.lit(0)))


def wanted_packets(packets: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """All packets, those of precincts that are not wanted without a body, so that headers stay in step: length 0, dropped."""
    flag = wanted.select(*keys).distinct().withColumn("_w", F.lit(True))
    joined = packets.join(flag, keys, "left").withColumn("dropped", F.col("_w").isNull())
    return joined.withColumn("length", F.when(F.col("dropped"), F.lit(0)).otherwise(F.col("length"))).drop("_w")
