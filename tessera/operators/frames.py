"""Frames from packet streams, declared over windows in arrival order.

A packets table has the columns ssrc, arrival, ext (24-bit extended sequence number), ts (32-bit ticks of 90 kHz), marker, main,
r (the main packet may be kept as a header) and length (payload bytes). Malformed packets are left out before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WRAP = 0xFFFFFF


def extended(eseq: Column, seq: Column) -> Column:
    return (eseq.cast("bigint") * 65536 + seq).bitwiseAND(F.lit(WRAP))


def tick_difference(a: Column, b: Column) -> Column:
    """a - b of 32-bit ticks that wrap, as a signed number."""
    return F.pmod(a - b + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def marked(packets: DataFrame) -> DataFrame:
    """Adds gap (a number is missing before this packet), new (it begins a frame) and frame (numbered from 1)."""
    w = Window.partitionBy("ssrc").orderBy("arrival")
    before = F.lag("ext").over(w)
    out = packets.withColumns(
        {
            "gap": F.coalesce(F.col("ext") != (before + 1).bitwiseAND(F.lit(WRAP)), F.lit(False)),
            "new": F.coalesce(F.lag("marker").over(w) | (F.lag("ts").over(w) != F.col("ts")), F.lit(True)),
        }
    )
    kept = F.when(F.col("main") & F.col("r") & (F.col("length") > 0), F.col("length"))
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumns(
        {
            "frame": F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "kept_main": F.last(kept, ignorenulls=True).over(earlier),
        }
    )


def assemble(packets: DataFrame) -> DataFrame:
    """One row per frame: ssrc, frame, ts, packets, bytes (with the kept main header that a frame without its own begins
    with), gaps, status, meta_arrival (its last main packet).

    status: emitted; lossy (a gap); tail_loss (whole so far, but its last packet has no marker); no_header (begins with a
    body packet before any main packet was kept); empty; or open (the stream ends within it).
    """
    rows = marked(packets)
    frames = rows.groupBy("ssrc", "frame").agg(
        F.min("ts").alias("ts"),
        F.count("*").alias("packets"),
        F.sum("length").alias("own"),
        F.count_if("gap").alias("gaps"),
        F.max_by("marker", "arrival").alias("ended"),
        F.min_by("main", "arrival").alias("first_main"),
        F.min_by("kept_main", "arrival").alias("kept"),
        F.max(F.when(F.col("main"), F.col("arrival"))).alias("meta_arrival"),
    )
    last = F.max("frame").over(Window.partitionBy("ssrc"))
    prefix = F.when(F.col("first_main"), 0).otherwise(F.coalesce("kept", F.lit(0)))
    total = F.col("own") + prefix
    status = (
        F.when(~F.col("ended") & (F.col("frame") == last), "open")
        .when(F.col("gaps") > 0, "lossy")
        .when(~F.col("ended"), "tail_loss")
        .when(~F.col("first_main") & F.col("kept").isNull(), "no_header")
        .when(total == 0, "empty")
        .otherwise("emitted")
    )
    return frames.select("ssrc", "frame", "ts", "packets", total.alias("bytes"), "gaps", status.alias("status"), "meta_arrival")


def stream_stats(frames: DataFrame) -> DataFrame:
    """Counters per stream: emitted, dropped, gaps, tail_loss, bytes of emitted frames."""
    is_ = lambda s: F.col("status") == s
    return frames.groupBy("ssrc").agg(
        F.count_if(is_("emitted")).alias("emitted"),
        F.count_if(~F.col("status").isin("emitted", "open")).alias("dropped"),
        F.sum("gaps").alias("gaps"),
        F.count_if(is_("tail_loss")).alias("tail_loss"),
        F.coalesce(F.sum(F.when(is_("emitted"), F.col("bytes"))), F.lit(0)).alias("bytes"),
    )


def latest_wins(frames: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Per slot, the newest value and how many it pushed out."""
    return frames.groupBy(*by).agg(F.max_by(value, at).alias("kept"), (F.count("*") - 1).alias("evicted"))


def drop_oldest(items: DataFrame, by: list[str], at: str, depth: int) -> DataFrame:
    """What a queue of `depth` holds that drops its oldest item when full."""
    return items.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at)))).filter(F.col("_n") <= depth).drop("_n")


def pacing(frames: DataFrame, by: list[str], at: str, ts: str) -> DataFrame:
    """Adds due: seconds after its stream's first frame at which a frame is to be shown."""
    w = Window.partitionBy(*by).orderBy(at)
    return frames.withColumn("due", tick_difference(F.col(ts), F.first(ts).over(w)) / 90000.0)


def first_frames(frames: DataFrame, by: list[str], at: str, most: int) -> DataFrame:
    """The first `most` frames of each stream: where a receiver stops."""
    return frames.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(at))).filter(F.col("_n") <= most).drop("_n")
