"""How far two images differ, and order statistics of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Even bins into which values are counted before any are sorted.
BINS = 1024


def compare(a: DataFrame, b: DataFrame, keys: list[str], by: list[str], value: str, depth: int) -> DataFrame:
    """Per group: n, pae (largest difference), mse, psnr in decibels against 2**depth - 1; infinite for equal images."""
    other = b.select(*keys, F.col(value).alias("_b"))
    d = F.col(value) - F.col("_b")
    found = a.join(other, keys).groupBy(*by).agg(F.count("*").alias("n"), F.max(F.abs(d)).alias("pae"), F.avg(d * d).alias("mse"))
    peak = float((1 << depth) - 1)
    psnr = F.when(F.col("mse") < 2.220446049250313e-16, F.lit(float("inf"))).otherwise(10 * F.log10(peak * peak / F.col("mse")))
    return found.withColumn("psnr", psnr)


def order_statistics(values: DataFrame, by: list[str], value: str, at: dict[str, str]) -> DataFrame:
    """by..., n and, for each name in `at`, the value at an index (from 0) that SQL over n gives.

    Values are first counted in even bins; only the bins that hold a wanted index are sorted, so that a group with a
    great part of all rows is not sorted in one task. Null values are left out.
    """
    rows = values.select(*by, F.col(value).alias("_v")).filter("_v is not null")
    spread = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("n"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / BINS)
    binned = rows.join(spread, by).withColumn(
        "_bin", F.coalesce(F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(BINS - 1)), F.lit(0))
    )
    counts = binned.groupBy(*by, "n", "_bin").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), F.expr(f"cast({e} as bigint)").alias("i")) for k, e in at.items()])
    placed = counts.withColumn("_before", F.coalesce(upto, F.lit(0))).withColumn("_want", F.explode(wanted))
    placed = placed.filter("_want.i >= _before and _want.i < _before + _c")
    needed = placed.select(*by, "n", "_bin", "_before", "_want.name", "_want.i")
    inside = binned.join(needed.select(*by, "_bin").distinct(), [*by, "_bin"])
    inside = inside.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_bin").orderBy("_v")) - 1)
    found = inside.select(*by, "_bin", "_k", "_v").join(needed, [*by, "_bin"]).filter("_before + _k = i")
    return found.groupBy(*by, "n").pivot("name", list(at)).agg(F.first("_v"))
