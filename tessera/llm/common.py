"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder is set if driver and
    executors are one process (as in tests); on a cluster a machine's own folder would lose rows, so an error is raised."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later passes start from files any executor can read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """materialize() in as many buckets by the key as there are shuffle partitions, so that joins on it read the table as it
    lies. df should be dealt by the key already, else every task writes to every bucket."""
    spark = df.sparkSession
    table = f"tessera_{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/tessera/{table}"
    df.write.format("parquet").bucketBy(parts, key).sortBy(key).option("compression", "zstd").option("path", path).saveAsTable(table)
    return spark.table(table)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() wrote."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tessera/" in path:
            at = hadoop.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def crc32_of_id(id_col: str) -> Column:
    """crc32 of the id written as text; null stays null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
