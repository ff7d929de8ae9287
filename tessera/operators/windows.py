"""Rows and columns of planes: ranges with what the filters reach, mosaics of tiles, header facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples that a coarser level's range is widened by at either end.
HALO = 4


def level_ranges(windows: DataFrame, low: str, high: str, levels: int) -> DataFrame:
    """One row per window and level (0 the finest): the range of samples that the window depends on, not yet clipped."""
    start = F.struct(F.col(low).cast("bigint").alias("lo"), F.col(high).cast("bigint").alias("hi"))
    ranges = [start]
    step = lambda r: F.struct((F.shiftright(r["lo"], 1) - HALO).alias("lo"), (F.shiftright(r["hi"] + 1, 1) + HALO).alias("hi"))
    out = windows.withColumn("_r0", start)
    for level in range(1, levels):
        out = out.withColumn(f"_r{level}", step(F.col(f"_r{level - 1}")))
    each = out.withColumn("_all", F.array(*[f"_r{i}" for i in range(max(levels, len(ranges)))]))
    return each.select(*windows.columns, F.posexplode("_all").alias("level", "_r")).select(*windows.columns, "level", "_r.lo", "_r.hi")


def clip(ranges: DataFrame, size: str) -> DataFrame:
    """Ranges within 0 .. size (SQL over the row); empty ones have lo = hi."""
    hi = F.least(F.col("hi"), F.expr(size))
    return ranges.withColumn("hi", F.greatest(hi, F.lit(0))).withColumn("lo", F.least(F.greatest("lo", F.lit(0)), F.col("hi")))


def cut_rows(rows: DataFrame, y_from: Column, y_to: Column, x_from: Column, x_to: Column, y: str = "y", row: str = "row") -> DataFrame:
    """The lines y_from .. y_to - 1 of a plane, each cut to the columns x_from .. x_to - 1."""
    inside = rows.filter((F.col(y) >= y_from) & (F.col(y) < y_to))
    return inside.withColumn(row, F.slice(row, (x_from + 1).cast("int"), F.greatest(x_to - x_from, F.lit(0)).cast("int")))


def mosaic(pieces: DataFrame, by: list[str], y: str, x: str, row: str) -> DataFrame:
    """Lines of whole images from tiles' lines: the pieces of a line side by side by their first column."""
    parts = F.array_sort(F.collect_list(F.struct(x, row)))
    return pieces.groupBy(*by, y).agg(F.flatten(F.transform(parts, lambda p: p[row])).alias(row))


def gaze_grid(sizes: DataFrame, n: int, width: str, height: str) -> DataFrame:
    """n x n gaze points over each image, to its edges; a single one is in the middle."""
    if n == 1:
        return sizes.selectExpr("*", f"{width} div 2 AS gx", f"{height} div 2 AS gy")
    each = sizes.selectExpr("*", f"explode(sequence(0L, {n - 1}L)) AS _y").selectExpr("*", f"explode(sequence(0L, {n - 1}L)) AS _x")
    return each.selectExpr(*sizes.columns, f"_x * ({width} - 1) div {n - 1} AS gx", f"_y * ({height} - 1) div {n - 1} AS gy")


def magb(steps: DataFrame, by: list[str], style: str, eps: str) -> DataFrame:
    """Greatest exponent of a header's bands if they are not quantised (style 0), least if they are."""
    return steps.groupBy(*by).agg(F.when(F.first(style) == 0, F.max(eps)).otherwise(F.min(eps)).alias("magb"))


def safe_reduction(components: DataFrame, by: list[str], levels: str = "levels") -> DataFrame:
    """How many resolutions can be left out of every component: the least number of levels."""
    return components.groupBy(*by).agg(F.min(levels).alias("most"))


def header_fingerprint(*segments: Column) -> Column:
    """A hash of whole header segments, by which geometry tables can be kept and found again."""
    return F.xxhash64(*segments)


def quantiser_line(name: Column, words: Column) -> Column:
    """A marker's words in hexadecimal after its name, as a text dump lists them."""
    hexed = F.transform(words, lambda w: F.lower(F.lpad(F.hex(w.cast("bigint")), 4, "0")))
    return F.concat(F.rpad(name, 8, " "), F.lit(": "), F.array_join(hexed, " "))
