"""Wavelet decomposition and synthesis over several levels, for planes with any origin, of whole planes or of regions.

What differs by image is data: the lifting steps (a kernel, as a header may define it), the direction of each level, and the
planes' rectangles. So images of different kinds are one job, and a level is two exchanges whatever its kernel.

A plane's lines are rows: by..., y, x0, row. y and x0 (of the row's first sample) are coordinates, not counts from 0. Bands have
coordinates of their own: low-pass sample n lies at 2 n of the plane, high-pass sample n at 2 n + 1.

A levels table has one row per plane and level k (0 the plane itself, k its lowest parts after k splits): by..., level, direction
(that leads from level - 1 to it), steps, reversible, and the rectangle [u0, u1) x [v0, v1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.transform import A97, B97, C97, D97

#: How a level splits a plane.
NEITHER, BOTH, ALONG, DOWN = 0, 1, 2, 3
#: Lines of a plane that are lifted together.
STRIP = 64

#: Steps of an analysis: samples of the parity change by a * (their neighbours' sum), or, with a shift (reversible), by sign *
#: floor((a * sum + add) / 2**shift).
STEP = "struct<parity: int, a: double, sign: int, add: int, shift: int>"
KERNELS = {
    "5/3": [(1, 1.0, -1, 0, 1), (0, 1.0, 1, 2, 2)],
    "9/7": [(1, A97, 1, 0, 0), (0, B97, 1, 0, 0), (1, C97, 1, 0, 0), (0, D97, 1, 0, 0)],
    "5/3-real": [(1, -0.5, 1, 0, 0), (0, 0.25, 1, 0, 0)],
}


def kernel(name: str) -> Column:
    """The steps of a kernel by name, as a column."""
    names = ("parity", "a", "sign", "add", "shift")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, step, strict=True)]) for step in KERNELS[name]])


def planes(tile_components: DataFrame, by: list[str]) -> DataFrame:
    """The levels table. tile_components: by..., x0, x1, y0, y1 (rectangles), directions (array, the finest level first), steps,
    reversible. A level halves the axes that it splits, rounded up."""
    each = tile_components.select("*", F.explode(F.sequence(F.lit(0), F.size("directions"))).alias("level"))
    depth = lambda d: F.size(F.filter(F.slice("directions", F.lit(1), F.col("level")), lambda x: x.isin(BOTH, d)))
    cut = lambda end, d: F.floor((F.col(end) + F.call_function("shiftleft", F.lit(1).cast("bigint"), depth(d)) - 1) / F.call_function("shiftleft", F.lit(1).cast("bigint"), depth(d)))
    return each.select(
        *by, "level", F.when(F.col("level") > 0, F.get("directions", F.col("level") - 1)).alias("direction"), "steps", "reversible",
        cut("x0", ALONG).alias("u0"), cut("x1", ALONG).alias("u1"), cut("y0", DOWN).alias("v0"), cut("y1", DOWN).alias("v1"),
    )


def safe_reduction(directions: Column) -> Column:
    """How many of the finest levels can be left out so that both axes shrink alike: those before the first that splits one only."""
    odd = F.array_position(F.transform(directions, lambda d: d == BOTH), False)
    return F.when(odd > 0, odd - 1).otherwise(F.size(directions)).cast("int")


def band_ranges(levels: DataFrame, by: list[str], k: str = "k") -> DataFrame:
    """by..., level, band, range, number: the nominal range of each band's samples, with which its quantiser's step is scaled, and the
    band's place among the steps that a header lists (the lowest band's is 0, then from the last level to the first).

    levels: the levels table with a column of the kernel's low-pass gain. A split multiplies the range of what is low by the gain
    and that of what is high by 2 / gain; an axis of one sample is not split. Levels of empty planes have no bands.
    """
    wide, tall = F.col("direction").isin(BOTH, ALONG), F.col("direction").isin(BOTH, DOWN)
    names = F.when(wide & tall, F.array(F.lit("HL"), F.lit("LH"), F.lit("HH"))).when(wide, F.array(F.lit("HL"))).when(tall, F.array(F.lit("LH")))
    one = F.struct("level", "direction", "u0", "u1", "v0", "v1", F.coalesce(names, F.array().cast("array<string>")).alias("names"))
    all_ = levels.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("_l"), F.first(k).alias("_k"))

    def step(acc: Column, i: Column) -> Column:
        """A level: what it splits is the plane of the level before, of a range that is carried along."""
        last, before, now = F.element_at(acc, -1), F.get("_l", i - 1), F.get("_l", i)
        across = now["direction"].isin(BOTH, ALONG) & (before["u1"] - before["u0"] > 1)
        down = now["direction"].isin(BOTH, DOWN) & (before["v1"] - before["v0"] > 1)
        low = lambda c: F.when(c, F.col("_k")).otherwise(1.0)
        high = lambda c: F.when(c, 2.0 / F.col("_k")).otherwise(1.0)
        n = last["low"]
        return F.concat(acc, F.array(F.struct(
            (n * low(across) * low(down)).alias("low"), (n * high(across) * low(down)).alias("HL"), (n * low(across) * high(down)).alias("LH"), (n * high(across) * high(down)).alias("HH"),
        )))

    start = F.array(F.struct(*[F.lit(1.0).alias(c) for c in ("low", "HL", "LH", "HH")]))
    order = F.when(F.size("_l") > 1, F.sequence(F.lit(1), F.size("_l") - 1)).otherwise(F.array().cast("array<int>"))
    held = all_.withColumn("_r", F.aggregate(order, start, step))
    each = held.select(*by, "_l", F.size("_l").alias("_n"), F.posexplode("_r").alias("level", "_r"))
    here, plane = F.get("_l", F.col("level")), F.get("_l", F.greatest(F.col("level") - 1, F.lit(0)))
    later = F.aggregate(F.slice("_l", F.col("level") + 2, F.col("_n")), F.lit(1), lambda a, x: a + F.size(x["names"]))
    deepest = F.when(F.col("level") == F.col("_n") - 1, F.array(F.struct(F.lit("LL").alias("band"), F.col("_r.low").alias("range"), F.lit(0).alias("number"))))
    value = lambda b: F.when(b == "HL", F.col("_r.HL")).when(b == "LH", F.col("_r.LH")).otherwise(F.col("_r.HH"))
    details = F.transform(here["names"], lambda b, i: F.struct(b.alias("band"), value(b).alias("range"), (later + i).alias("number")))
    bands = F.concat(F.coalesce(deepest, F.slice(details, 1, 0)), F.when(F.col("level") > 0, details).otherwise(F.slice(details, 1, 0)))
    some = each.filter((plane["u1"] > plane["u0"]) & (plane["v1"] > plane["v0"]))
    return some.select(*by, "level", F.inline(bands))


def _bound(x: Column, f) -> Column:
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _amount(s: Column, total: Column, reversible: Column) -> Column:
    whole = s["sign"] * F.floor((s["a"] * total + s["add"]) / F.pow(F.lit(2.0), s["shift"]))
    return F.when(reversible, whole.cast("double")).otherwise(s["a"] * total)


def lifted(v: Column, first: Column, steps: Column, reversible: Column, undo: bool) -> Column:
    """A line's samples, lifted in place by steps, or the steps undone; first: coordinate of the first sample. Beyond its ends, a
    line is mirrored. A single sample at an odd coordinate is doubled by reversible kernels, and halved again."""
    order = F.reverse(steps) if undo else steps

    def one(v: Column, s: Column) -> Column:
        n = F.size(v)

        def change(e: Column, k: Column) -> Column:
            left, right = F.get(v, F.when(k > 0, k - 1).otherwise(k + 1)), F.get(v, F.when(k < n - 1, k + 1).otherwise(k - 1))
            d = _amount(s, left + right, reversible)
            return F.when(F.pmod(k + first, F.lit(2)) == s["parity"], e - d if undo else e + d).otherwise(e)

        return F.transform(v, change)

    factor = F.when(reversible & (F.pmod(first, F.lit(2)) == 1), 0.5 if undo else 2.0).otherwise(1.0)
    return _bound(v, lambda v: F.when(F.size(v) > 1, F.aggregate(order, v, one)).otherwise(F.transform(v, lambda e: e * factor)))


def _down_columns(lines: DataFrame, by: list[str], undo: bool) -> DataFrame:
    """Lifts along y where the direction says so. lines: by..., y, x0, row, direction, steps, reversible, v0, v1. Lines are dealt
    into strips with as many neighbours as the kernel has steps, each of which reaches one line further."""
    reach = F.size("steps")
    split = F.col("direction").isin(BOTH, DOWN)
    strips = F.when(split, F.sequence(F.floor((F.col("y") - reach) / STRIP), F.floor((F.col("y") + reach) / STRIP))).otherwise(F.array(F.floor(F.col("y") / STRIP)))
    held = lines.withColumn("_strip", F.explode(strips))
    same = ["direction", "steps", "reversible", "v0", "v1"]
    grouped = held.groupBy(*by, "_strip").agg(F.array_sort(F.collect_list(F.struct("y", "x0", "row"))).alias("_l"), *[F.first(c).alias(c) for c in same])

    def one(ls: Column, s: Column) -> Column:
        n = F.size(ls)

        def change(line: Column, k: Column) -> Column:
            before, after = F.get(ls, F.when(k > 0, k - 1).otherwise(k + 1))["row"], F.get(ls, F.when(k < n - 1, k + 1).otherwise(k - 1))["row"]
            moved = F.zip_with(line["row"], F.zip_with(before, after, lambda a, b: _amount(s, a + b, F.col("reversible"))), lambda v, d: v - d if undo else v + d)
            row = F.when(F.pmod(line["y"], F.lit(2)) == s["parity"], moved).otherwise(line["row"])
            return F.struct(line["y"].alias("y"), line["x0"].alias("x0"), row.alias("row"))

        return F.transform(ls, change)

    order = F.reverse("steps") if undo else F.col("steps")
    factor = F.when(F.col("reversible") & (F.pmod("v0", F.lit(2)) == 1), 0.5 if undo else 2.0).otherwise(1.0)
    alone = F.transform("_l", lambda x: F.struct(x["y"].alias("y"), x["x0"].alias("x0"), F.transform(x["row"], lambda e: e * factor).alias("row")))
    done = F.when(~F.col("direction").isin(BOTH, DOWN), F.col("_l")).when(F.col("v1") - F.col("v0") > 1, F.aggregate(order, F.col("_l"), one)).otherwise(alone)
    each = grouped.select(*by, "_strip", *same, F.explode(done).alias("_x")).select(*by, "_strip", *same, "_x.*")
    return each.filter(F.floor(F.col("y") / STRIP) == F.col("_strip")).drop("_strip")


def _halves(v: Column, first: Column) -> tuple[Column, Column]:
    pick = lambda parity: F.filter(v, lambda e, k: F.pmod(k + first, F.lit(2)) == parity)
    return pick(0), pick(1)


def analyse(lines: DataFrame, levels: DataFrame, by: list[str], most: int) -> DataFrame:
    """All bands of planes: by..., level (1 the finest), band (LL, HL, LH, HH), y, x0, row of doubles. LL only at a plane's last
    level, and level 0 for a plane that is not split. lines: by..., y, x0, row (whole lines); most: levels of any plane."""
    now = lines.select(*by, "y", "x0", F.col("row").cast("array<double>").alias("row"))
    last = levels.groupBy(*by).agg(F.max("level").alias("_last"))
    out = now.join(last.filter("_last = 0").select(*by), by, "left_semi").select(*by, F.lit(0).alias("level"), F.lit("LL").alias("band"), "y", "x0", "row")
    for k in range(1, most + 1):
        kinds = levels.filter(F.col("level") == k).select(*by, "direction", "steps", "reversible")
        rect = levels.filter(F.col("level") == k - 1).select(*by, "v0", "v1")
        down = _down_columns(now.join(kinds.join(rect, by), by), by, False)
        along = F.when(F.col("direction").isin(BOTH, ALONG), lifted(F.col("row"), F.col("x0"), F.col("steps"), F.col("reversible"), False)).otherwise(F.col("row"))
        done = down.withColumn("row", along)
        low, high = _halves(F.col("row"), F.col("x0"))
        wide, tall = F.col("direction").isin(BOTH, ALONG), F.col("direction").isin(BOTH, DOWN)
        upper = tall & (F.pmod("y", F.lit(2)) == 1)
        first = F.floor((F.col("x0") + 1) / 2)
        parts = F.when(wide, F.array(
            F.struct(F.when(upper, "LH").otherwise("LL").alias("band"), first.alias("x0"), low.alias("row")),
            F.struct(F.when(upper, "HH").otherwise("HL").alias("band"), F.floor(F.col("x0") / 2).alias("x0"), high.alias("row")),
        )).otherwise(F.array(F.struct(F.when(upper, "LH").otherwise("LL").alias("band"), F.col("x0").alias("x0"), F.col("row").alias("row"))))
        y = F.when(tall, F.floor(F.col("y") / 2)).otherwise(F.col("y"))
        bands = done.select(*by, y.alias("y"), F.explode(parts).alias("_b")).select(*by, F.lit(k).alias("level"), "_b.band", "y", "_b.x0", "_b.row").filter(F.size("row") > 0)
        deepest = bands.join(last, by)
        out = out.unionByName(deepest.filter((F.col("band") != "LL") | (F.col("_last") == k)).drop("_last"))
        now = deepest.filter((F.col("band") == "LL") & (F.col("_last") > k)).select(*by, "y", "x0", "row")
    return out


def wanted(levels: DataFrame, regions: DataFrame, by: list[str], most: int) -> DataFrame:
    """levels with xa, xb, ya, yb: which part of each level's plane a region of level 0 depends on. regions: by..., x_from, x_to,
    y_from, y_to. A level needs what the finer one needs, halved on the axes that are split, and as many samples more at either
    end as the kernel has steps. Planes without a region are left out."""
    ends = (("xa", "x_from"), ("xb", "x_to"), ("ya", "y_from"), ("yb", "y_to"))
    one = levels.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("level", "direction", F.size("steps").alias("n"), "u0", "u1", "v0", "v1"))).alias("_all"))
    held = one.join(regions.select(*by, *[F.col(b).cast("bigint").alias(a) for a, b in ends]), by)

    def coarser(acc: Column, s: Column) -> Column:
        now = F.element_at(acc, -1)
        wide, tall = s["direction"].isin(BOTH, ALONG), s["direction"].isin(BOTH, DOWN)
        low = lambda v: F.floor((v - s["n"]) / 2)
        high = lambda v: F.floor((v + s["n"] + 1) / 2) + 1
        range_ = F.struct(
            F.when(wide, low(now["xa"])).otherwise(now["xa"]).alias("xa"), F.when(wide, high(now["xb"])).otherwise(now["xb"]).alias("xb"),
            F.when(tall, low(now["ya"])).otherwise(now["ya"]).alias("ya"), F.when(tall, high(now["yb"])).otherwise(now["yb"]).alias("yb"),
        )
        return F.concat(acc, F.array(range_))

    start = F.array(F.struct("xa", "xb", "ya", "yb"))
    ranges = F.aggregate(F.slice("_all", 2, max(most, 1)), start, coarser)
    zipped = held.select(*by, F.inline(F.arrays_zip(F.col("_all").alias("s"), ranges.alias("r"))))
    clip = lambda a, lo, hi: F.least(F.greatest(F.col(f"r.{a}"), F.col(f"s.{lo}")), F.col(f"s.{hi}")).alias(a)
    found = zipped.select(*by, "s.level", clip("xa", "u0", "u1"), clip("xb", "u0", "u1"), clip("ya", "v0", "v1"), clip("yb", "v0", "v1"))
    return levels.join(found, [*by, "level"])


def synthesise(bands: DataFrame, levels: DataFrame, by: list[str], most: int, regions: DataFrame | None = None) -> DataFrame:
    """The lines that analyse() took apart: by..., y, x0, row of doubles; with regions, the regions of them only.

    Lines of bands that no region depends on are left out by a join, and the others are cut to the columns that are needed, before
    any exchange of samples; so are the lines of the planes in between. Bands must be whole where they are needed; a band that
    is absent altogether has no samples there.
    """
    parts = levels if regions is None else wanted(levels, regions, by, most)
    if regions is None:
        parts = parts.withColumns({"xa": F.col("u0"), "xb": F.col("u1"), "ya": F.col("v0"), "yb": F.col("v1")})
    coded = bands.select(*by, "level", "band", "y", "x0", F.col("row").cast("array<double>").alias("row"))
    now = None
    for k in range(most, -1, -1):
        here = coded.filter((F.col("level") == k) & (F.col("band") == "LL")).select(*by, "y", "x0", "row")
        now = here if now is None else now.unionByName(here)
        rect = parts.filter(F.col("level") == k).select(*by, "xa", "xb", "ya", "yb")
        inside = now.join(rect, by).filter((F.col("y") >= F.col("ya")) & (F.col("y") < F.col("yb")))
        now = _columns(inside, "xa", "xb").select(*by, "y", "x0", "row")
        if k == 0:
            return now
        detail = coded.filter((F.col("level") == k) & (F.col("band") != "LL"))
        now = _up(now, detail, parts, by, k)


def _columns(lines: DataFrame, xa: str, xb: str) -> DataFrame:
    """Lines cut to columns xa .. xb - 1; the bounds are columns."""
    start = F.greatest(F.col(xa) - F.col("x0"), F.lit(0))
    size = F.greatest(F.least(F.col(xb), F.col("x0") + F.size("row")) - F.greatest(F.col(xa), F.col("x0")), F.lit(0))
    return lines.withColumns({"row": F.slice("row", (start + 1).cast("int"), size.cast("int")), "x0": F.greatest(F.col(xa), F.col("x0"))})


def _up(low: DataFrame, detail: DataFrame, parts: DataFrame, by: list[str], k: int) -> DataFrame:
    """Level k - 1 from level k's low part and details."""
    kinds = parts.filter(F.col("level") == k).select(*by, "direction", "steps", "reversible")
    finer = parts.filter(F.col("level") == k - 1).select(*by, "u0", "u1", "v0", "v1", "xa", "xb", "ya", "yb")
    n = F.size("steps")
    wide, tall = F.col("direction").isin(BOTH, ALONG), F.col("direction").isin(BOTH, DOWN)
    # what the finer plane's part depends on, with the reach of the steps, in its own coordinates
    span = kinds.join(finer, by).withColumns({
        "_xa": F.when(wide, F.greatest("u0", F.col("xa") - n)).otherwise(F.col("xa")), "_xb": F.when(wide, F.least("u1", F.col("xb") + n)).otherwise(F.col("xb")),
        "_ya": F.when(tall, F.greatest("v0", F.col("ya") - n)).otherwise(F.col("ya")), "_yb": F.when(tall, F.least("v1", F.col("yb") + n)).otherwise(F.col("yb")),
    })
    lines = low.withColumn("band", F.lit("LL")).unionByName(detail.drop("level")).join(span, by)
    right, upper = F.col("band").isin("HL", "HH"), F.col("band").isin("LH", "HH")
    lines = lines.withColumns({"_y": F.when(tall, 2 * F.col("y") + F.when(upper, 1).otherwise(0)).otherwise(F.col("y"))})
    lines = lines.filter((F.col("_y") >= F.col("_ya")) & (F.col("_y") < F.col("_yb")))
    half = lambda c, odd: F.floor((F.col(c) + (0 if odd else 1)) / 2)
    cut_a = F.when(~wide, F.col("_xa")).when(right, half("_xa", True)).otherwise(half("_xa", False))
    cut_b = F.when(~wide, F.col("_xb")).when(right, half("_xb", True)).otherwise(half("_xb", False))
    lines = _columns(lines.withColumns({"_ca": cut_a, "_cb": cut_b}), "_ca", "_cb")
    keep = ["direction", "steps", "reversible", "v0", "v1", "_xa", "xa", "xb", "ya", "yb"]
    pick = lambda test: F.max(F.when(test, F.col("row")))
    # the two halves of a line meet; an axis that is not split has one of them
    both = lines.groupBy(*by, "_y").agg(pick(~right).alias("_l"), pick(right).alias("_h"), *[F.first(c).alias(c) for c in keep])

    def woven(x: Column) -> Column:
        total = F.coalesce(F.size(x["l"]), F.lit(0)) + F.coalesce(F.size(x["h"]), F.lit(0))
        at = lambda i, odd: F.floor(i / 2) - (half("_xa", True) if odd else half("_xa", False))
        value = lambda i: F.when(F.pmod(i, F.lit(2)) == 0, F.get(x["l"], at(i, False).cast("int"))).otherwise(F.get(x["h"], at(i, True).cast("int")))
        none = F.array().cast("array<double>")
        return F.when(total > 0, F.transform(F.sequence(F.col("_xa"), F.col("_xa") + total - 1), value)).otherwise(none)

    row = _bound(F.struct(F.col("_l").alias("l"), F.col("_h").alias("h")), woven)
    along = lifted(row, F.col("_xa"), F.col("steps"), F.col("reversible"), True)
    flat = both.select(*by, F.col("_y").alias("y"), F.col("_xa").alias("x0"), F.when(wide, along).otherwise(F.col("_l")).alias("row"), *[c for c in keep if c != "_xa"])
    done = _down_columns(_columns(flat, "xa", "xb").select(*by, "y", "x0", "row", "direction", "steps", "reversible", "v0", "v1"), by, True)
    return done.select(*by, "y", "x0", "row")

