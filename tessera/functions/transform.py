"""Wavelet lifting on arrays (a row of samples per Spark row) and on planes (a row array per image line).

A lifting step adds to every other sample a function of its two neighbours; beyond an end, the signal is mirrored. One
expression does each step, so a row's transform is one projection; only the vertical pass of a plane moves rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lifting factors of the 9/7 filter.
A97, B97, C97, D97 = -1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971

Add = Callable[[Column, Column], Column]

#: (parity of the samples changed, what is added) of each filter's forward steps.
STEPS: dict[str, list[tuple[int, Add]]] = {
    "5/3": [(1, lambda a, b: -F.shiftright(a + b, 1)), (0, lambda a, b: F.shiftright(a + b + 2, 2))],
    "9/7": [(1, lambda a, b: A97 * (a + b)), (0, lambda a, b: B97 * (a + b)), (1, lambda a, b: C97 * (a + b)), (0, lambda a, b: D97 * (a + b))],
    "5/3-real": [(1, lambda a, b: -0.5 * (a + b)), (0, lambda a, b: 0.25 * (a + b))],
}
#: Neighbouring lines that a line's vertical transform can depend on.
REACH = {"5/3": 2, "9/7": 4, "5/3-real": 2}
#: Lines of a plane that one task transforms together.
STRIP = 64


def mirrored(i: Column, n: Column) -> Column:
    """Index of a sample beyond an end of n (> 1) samples, mirrored about the end samples."""
    period = 2 * (n - 1)
    j = F.pmod(i, period)
    return F.when(j < n, j).otherwise(period - j)


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _step(x: Column, parity: int, add: Add, origin: int) -> Column:
    def lifted(v: Column) -> Column:
        n = F.size(v)
        at = lambda i: F.get(v, mirrored(i, n).cast("int"))
        return F.transform(v, lambda e, k: F.when((k + origin) % 2 == parity, e + add(at(k - 1), at(k + 1))).otherwise(e))

    return _bound(x, lifted)


def forward(x: Column, filter_: str, origin: int = 0) -> Column:
    """Lifted samples in place: low-pass at even positions, high-pass at odd ones. A single sample is left as it is."""

    def lifted(v: Column) -> Column:
        out = v
        for parity, add in STEPS[filter_]:
            out = _step(out, parity, add, origin)
        return F.when(F.size(v) > 1, out).otherwise(v)

    return _bound(x, lifted)


def inverse(x: Column, filter_: str, origin: int = 0) -> Column:
    def lifted(v: Column) -> Column:
        out = v
        for parity, add in reversed(STEPS[filter_]):
            out = _step(out, parity, lambda a, b, add=add: -add(a, b), origin)
        return F.when(F.size(v) > 1, out).otherwise(v)

    return _bound(x, lifted)


def low(x: Column, origin: int = 0) -> Column:
    return F.filter(x, lambda v, k: (k + origin) % 2 == 0)


def high(x: Column, origin: int = 0) -> Column:
    return F.filter(x, lambda v, k: (k + origin) % 2 == 1)


def interleave(l: Column, h: Column, origin: int = 0) -> Column:  # noqa: E741
    """low() and high() put back together."""
    return _bound(F.struct(l.alias("l"), h.alias("h")), lambda both: _interleaved(both["l"], both["h"], origin))


def _interleaved(l: Column, h: Column, origin: int) -> Column:  # noqa: E741
    n = F.size(l) + F.size(h)
    each = F.sequence(F.lit(0), n - 1)
    half = lambda k: F.floor(k / 2).cast("int")
    take = lambda k: F.when((k + origin) % 2 == 0, F.get(l, half(k))).otherwise(F.get(h, half(k)))
    return F.when(n > 0, F.transform(each, take)).otherwise(l)


def _vertical(rows: DataFrame, filter_: str, by: list[str], y: str, row: str, undo: bool) -> DataFrame:
    """Lifts along y. Lines are dealt into strips with as many neighbouring lines as the filter reaches, so that a task
    holds a strip, whatever the height of the plane."""
    reach = REACH[filter_]
    bounds = rows.groupBy(*by).agg(F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    held = rows.join(bounds, by)
    strips = F.sequence(F.floor((F.col(y) - reach) / STRIP), F.floor((F.col(y) + reach) / STRIP))
    held = held.withColumn("_strip", F.explode(strips))
    w = Window.partitionBy(*by, "_strip").orderBy(y)
    steps = STEPS[filter_]
    for parity, add in reversed(steps) if undo else steps:
        before, after = F.lag(row).over(w), F.lead(row).over(w)
        held = held.withColumns({"_a": F.coalesce(before, after), "_b": F.coalesce(after, before)})
        sign = -1 if undo else 1
        moved = F.zip_with(F.col(row), F.zip_with("_a", "_b", add), lambda v, d: v + sign * d)
        held = held.withColumn(row, F.when((F.col(y) % 2 == parity) & (F.col("_y1") > F.col("_y0")), moved).otherwise(F.col(row)))
    own = held.filter(F.floor(F.col(y) / STRIP) == F.col("_strip"))
    return own.select(*rows.columns)


def forward_2d(rows: DataFrame, filter_: str, by: list[str], y: str = "y", row: str = "row") -> DataFrame:
    """One level over a plane: lines first down, then along. rows: by..., y (from 0), row (array of samples).

    Returns by..., band (LL, HL, LH, HH), y, row, each band's lines numbered from 0.
    """
    down = _vertical(rows, filter_, by, y, row, False).withColumn(row, forward(F.col(row), filter_))
    low_line = F.col(y) % 2 == 0
    bands = F.array(
        F.struct(F.when(low_line, "LL").otherwise("LH").alias("band"), low(F.col(row)).alias("v")),
        F.struct(F.when(low_line, "HL").otherwise("HH").alias("band"), high(F.col(row)).alias("v")),
    )
    each = down.select(*by, F.floor(F.col(y) / 2).alias(y), F.explode(bands).alias("_b"))
    return each.select(*by, "_b.band", y, F.col("_b.v").alias(row)).filter(F.size(row) > 0)


def inverse_2d(bands: DataFrame, filter_: str, by: list[str], y: str = "y", row: str = "row") -> DataFrame:
    """Lines of the plane that forward_2d() took apart; absent bands' lines are taken as they come only if all are there."""
    top = F.col("band").isin("LL", "HL")
    lines = bands.withColumn("_y", 2 * F.col(y) + F.when(top, 0).otherwise(1))
    pick = lambda names: F.coalesce(F.max(F.when(F.col("band").isin(*names), F.col(row))), F.slice(F.max(row), 1, 0))
    both = lines.groupBy(*by, "_y").agg(pick(("LL", "LH")).alias("_l"), pick(("HL", "HH")).alias("_h"))
    flat = both.select(*by, F.col("_y").alias(y), inverse(interleave(F.col("_l"), F.col("_h")), filter_).alias(row))
    return _vertical(flat, filter_, by, y, row, True)


def decompose(rows: DataFrame, filter_: str, levels: int, by: list[str], y: str = "y", row: str = "row") -> DataFrame:
    """All bands of a decomposition: by..., level (1 the finest), band, y, row; LL only at the last level."""
    out, now = None, rows
    for level in range(1, levels + 1):
        found = forward_2d(now, filter_, by, y, row).withColumn("level", F.lit(level))
        detail = found if level == levels else found.filter("band <> 'LL'")
        out = detail if out is None else out.unionByName(detail)
        now = found.filter("band = 'LL'").select(*by, y, row)
    return out


def tag_tree(leaves: DataFrame, by: list[str], x: str, y: str, value: str, levels: int) -> DataFrame:
    """Minima over squares of 2**k leaves a side, k = 0 .. levels: by..., k, x, y, value. Every level is made from the
    one below, which is a quarter as large in rows from the second on."""
    out = now = leaves.groupBy(*by, x, y).agg(F.min(value).alias(value)).withColumn("k", F.lit(0))
    for k in range(1, levels + 1):
        now = now.groupBy(*by, F.floor(F.col(x) / 2).alias(x), F.floor(F.col(y) / 2).alias(y)).agg(F.min(value).alias(value)).withColumn("k", F.lit(k))
        out = out.unionByName(now)
    return out


def all_zero(row: Column) -> Column:
    """Whether all samples of a row are 0; a plane of such rows needs no synthesis."""
    return F.forall(row, lambda v: v == 0)
