"""Slots and queues between a stream and a consumer that takes from them once a trigger.

What a trigger leaves in a queue is a table that the next one goes on from. Each trigger writes under its own number and
replaces what a broken run of the same number has left, so a trigger that is run again gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def _written(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def latest_slots(items: DataFrame, by: list[str], at: str, value: str, path: str) -> DataStreamWriter:
    """Slots that hold one item each: of those that a trigger brings, the newest by `at` is taken, and the others are pushed out.

    Under path, the rows by..., kept (its value), evicted, and trigger as a partition. The caller gives the writer a
    checkpoint and starts it.
    """

    def take(batch: DataFrame, trigger: int) -> None:
        newest = batch.groupBy(*by).agg(F.max_by(value, at).alias("kept"), (F.count("*") - 1).alias("evicted"))
        _written(newest, f"{path}/trigger={trigger}")

    return items.writeStream.foreachBatch(take)


def bounded_queues(items: DataFrame, by: list[str], at: str, depth: int, most: int, path: str) -> DataStreamWriter:
    """Queues of `depth` items that drop their oldest when they are full, and from which a consumer takes the oldest `most` after each
    trigger's items have come.

    Under path, /taken has the rows that were taken, /counts by..., came, dropped, left of each queue, both with trigger as
    a partition; /queue has what a trigger left. Items are put in order by `at`, which is to differ within a queue.
    """

    def turn(batch: DataFrame, trigger: int) -> None:
        spark = batch.sparkSession
        now = batch.withColumn("_new", F.lit(True))
        if trigger > 0:
            now = spark.read.schema(batch.schema).parquet(f"{path}/queue/{trigger - 1}").withColumn("_new", F.lit(False)).unionByName(now)
        newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at)))
        count = F.count("*").over(Window.partitionBy(*by))
        # the place in the queue, once what is dropped has gone
        placed = now.withColumns({"_back": newest, "_all": count}).withColumn("_place", F.least("_all", F.lit(depth)) - F.col("_back"))
        placed = placed.persist()
        held = F.col("_back") <= depth
        _written(placed.filter(held & (F.col("_place") >= most)).select(batch.columns), f"{path}/queue/{trigger}")
        _written(placed.filter(held & (F.col("_place") < most)).select(batch.columns), f"{path}/taken/trigger={trigger}")
        counts = placed.groupBy(*by).agg(F.count_if("_new").alias("came"), F.count_if(~held).alias("dropped"), F.count_if(held & (F.col("_place") >= most)).alias("left"))
        _written(counts, f"{path}/counts/trigger={trigger}")
        placed.unpersist()

    return items.writeStream.foreachBatch(turn)


def read_triggers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all triggers of a folder, with trigger; schema: of the rows without it."""
    return spark.read.schema(f"{schema}, trigger bigint").option("basePath", path).parquet(path)
