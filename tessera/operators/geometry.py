"""Index tables of a codestream's geometry: tiles, tile-component resolutions, precincts.

An images table has one row per codestream:
image_id, xsiz, ysiz, xosiz, yosiz, xtsiz, ytsiz, xtosiz, ytosiz (bigint), levels (int), reversible (boolean),
comps array<struct<xr: int, yr: int>>, precincts array<struct<ppx: int, ppy: int>> from the lowest resolution up.
A component coded otherwise than the image has levels, reversible and precincts in its comps struct, which are null, or
left out, where the image's hold. A tile's component coded otherwise than that is a row of a table of tile codings:
image_id, t, c, levels, reversible, precincts; it lists exceptions only.
Every table below has as many rows as the image has such parts; only tile codings are joined to make them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cdiv(a: str, b: str) -> str:
    """SQL for the quotient of non-negative integers, rounded up."""
    return f"((({a}) + ({b}) - 1) div ({b}))"


def sat(a: str, b: str) -> str:
    """SQL for a - b, or 0 where that is negative."""
    return f"greatest(({a}) - ({b}), 0)"


def tiles(images: DataFrame) -> DataFrame:
    """images' columns, tiles_x, tiles_y, t and the tile's rectangle on the reference grid [tx0, tx1) x [ty0, ty1)."""
    counted = images.selectExpr(
        "*", f"{cdiv('xsiz - xtosiz', 'xtsiz')} AS tiles_x", f"{cdiv('ysiz - ytosiz', 'ytsiz')} AS tiles_y"
    ).filter("tiles_x > 0 AND tiles_y > 0")
    each = counted.selectExpr("*", "explode(sequence(0L, tiles_x * tiles_y - 1)) AS t")
    return each.selectExpr(
        "*",
        "greatest(xtosiz + (t % tiles_x) * xtsiz, xosiz) AS tx0",
        "greatest(ytosiz + (t div tiles_x) * ytsiz, yosiz) AS ty0",
        "least(xtosiz + (t % tiles_x + 1) * xtsiz, xsiz) AS tx1",
        "least(ytosiz + (t div tiles_x + 1) * ytsiz, ysiz) AS ty1",
    )


#: What a component may have of its own.
CODING = ("levels", "reversible", "precincts")


def with_codings(images: DataFrame) -> DataFrame:
    """images with all of CODING in each component's struct."""
    given = images.schema["comps"].dataType.elementType.names
    own = ", ".join(f"'{f}', " + (f"coalesce(x.{f}, {f})" if f in given else f) for f in CODING)
    return images.withColumn("comps", F.expr(f"transform(comps, x -> named_struct('xr', x.xr, 'yr', x.yr, {own}))"))


def most_levels(images: DataFrame, tile_codings: DataFrame | None = None) -> DataFrame:
    """image_id, levels: the most that any component of any tile has. An image whose tiles all have codings of their own for
    a component counts that component's own levels, too."""
    found = with_codings(images).selectExpr("image_id", "coalesce(array_max(transform(comps, x -> x.levels)), levels) AS levels")
    if tile_codings is None:
        return found
    return found.unionByName(tile_codings.select("image_id", "levels")).groupBy("image_id").agg(F.max("levels").alias("levels"))


def resolutions(of_tiles: DataFrame, tile_codings: DataFrame | None = None) -> DataFrame:
    """One row per tile, component c and resolution r: its rectangle, its precinct grid npw x nph, and how many precincts of
    the tile-component come before (s_offset). levels, reversible and precincts are those of the tile's component."""
    by_comp = with_codings(of_tiles).selectExpr("*", "posexplode(comps) AS (c, comp)")
    holds = {f: F.col(f"comp.{f}") for f in CODING}
    if tile_codings is not None:
        own = tile_codings.select("image_id", "t", "c", F.struct(*CODING).alias("_own"))
        by_comp = by_comp.join(own, ["image_id", "t", "c"], "left")
        holds = {f: F.when(F.col("_own").isNotNull(), F.col(f"_own.{f}")).otherwise(c) for f, c in holds.items()}
    by_comp = by_comp.withColumns(holds).drop("_own")
    by_res = by_comp.selectExpr("*", "explode(sequence(0, levels)) AS r").selectExpr(
        "*", "shiftleft(1L, levels - r) AS scale", "shiftleft(1L, precincts[r].ppx) AS pw", "shiftleft(1L, precincts[r].ppy) AS ph"
    )
    for axis, sub in (("x", "comp.xr"), ("y", "comp.yr")):
        for end in "01":
            by_res = by_res.withColumn(f"tr{axis}{end}", F.expr(cdiv(cdiv(f"t{axis}{end}", sub), "scale")))
    grid = by_res.selectExpr(
        "*",
        f"if(trx1 > trx0, {cdiv('trx1', 'pw')} - trx0 div pw, 0) AS npw",
        f"if(try1 > try0, {cdiv('try1', 'ph')} - try0 div ph, 0) AS nph",
    )
    lower = Window.partitionBy("image_id", "t", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    return grid.withColumn("s_offset", F.coalesce(F.sum(F.expr("npw * nph")).over(lower), F.lit(0)))


def subbands(of_resolutions: DataFrame) -> DataFrame:
    """One row per subband of each resolution: band (LL, or HL LH HH above the lowest), its rectangle [bx0, bx1) x
    [by0, by1), and the exponents of precincts and, given columns cbw and cbh, code-blocks in it."""
    xo = "if(band IN ('HL', 'HH'), 1, 0)"
    yo = "if(band IN ('LH', 'HH'), 1, 0)"
    each = of_resolutions.selectExpr("*", "explode(if(r = 0, array('LL'), array('HL', 'LH', 'HH'))) AS band")
    each = each.selectExpr("*", "if(r = 0, levels, levels - r + 1) AS nb", f"{xo} AS xob", f"{yo} AS yob", "if(r = 0, 0, 1) AS half")
    ends = []
    for axis, sub in (("x", "comp.xr"), ("y", "comp.yr")):
        for end in "01":
            inner = f"({cdiv(f't{axis}{end}', sub)} - if(nb > 0, shiftleft(1L, nb - 1) * {axis}ob, 0L))"
            ends.append(f"greatest({inner} + shiftleft(1L, nb) - 1, 0) div shiftleft(1L, nb) AS b{axis}{end}")
    return each.selectExpr("*", *ends, "precincts[r].ppx - half AS bpx", "precincts[r].ppy - half AS bpy")


def code_blocks(of_subbands: DataFrame) -> DataFrame:
    """One row per subband and precinct (p): its code-blocks' grid ncbw x ncbh. A code-block is no larger than the
    precinct's part of the band. of_subbands: subbands() with columns cbw and cbh, exponents."""
    some = of_subbands.filter("npw * nph > 0").selectExpr("*", "explode(sequence(0L, npw * nph - 1)) AS p")
    ends = []
    for axis, at, n in (("x", "p % npw", "w"), ("y", "p div npw", "h")):
        first = f"(tr{axis}0 div p{n}) + {at}"
        ends += [f"greatest(b{axis}0, ({first}) * shiftleft(1L, bp{axis})) AS c{axis}0", f"least(b{axis}1, ({first} + 1) * shiftleft(1L, bp{axis})) AS c{axis}1"]
    cut = some.selectExpr("*", *ends, "least(cbw, bpx) AS ecw", "least(cbh, bpy) AS ech")
    count = lambda a, e: f"if(c{a}1 > c{a}0, ((c{a}1 + shiftleft(1L, {e}) - 1) div shiftleft(1L, {e})) - c{a}0 div shiftleft(1L, {e}), 0)"
    grid = cut.selectExpr("*", f"{count('x', 'ecw')} AS ncbw", f"{count('y', 'ech')} AS ncbh")
    return grid.withColumns({c: F.expr(f"if(ncbw * ncbh = 0, 0, {c})") for c in ("ncbw", "ncbh")})


def smallest_precinct(images: DataFrame) -> DataFrame:
    """image_id, ppx, ppy: the least exponents over all components and resolutions."""
    each = with_codings(images).selectExpr("image_id", "flatten(transform(comps, x -> slice(x.precincts, 1, x.levels + 1))) AS p")
    return each.selectExpr("image_id", "array_min(transform(p, p -> p.ppx)) AS ppx", "array_min(transform(p, p -> p.ppy)) AS ppy")


def precincts(of_resolutions: DataFrame) -> DataFrame:
    """One row per precinct: p (row-major), px, py, its sequence number s in the tile-component, and its id
    I = t + (c + s * components) * tiles."""
    some = of_resolutions.filter("npw * nph > 0").selectExpr("*", "explode(sequence(0L, npw * nph - 1)) AS p")
    return some.selectExpr(
        "*", "p % npw AS px", "p div npw AS py", "s_offset + p AS s",
        "t + (c + (s_offset + p) * size(comps)) * (tiles_x * tiles_y) AS I",
    )


def id_to_key(ids: DataFrame, id_col: str, tiles_n: str, comps_n: str) -> DataFrame:
    """Adds t, c and s, from which an id was made; tiles_n and comps_n are SQL for the numbers of tiles and components."""
    return ids.selectExpr(
        "*",
        f"{id_col} % ({tiles_n}) AS t",
        f"({id_col} div ({tiles_n})) % ({comps_n}) AS c",
        f"({id_col} div ({tiles_n})) div ({comps_n}) AS s",
    )


def reduced_size(size: str, origin: str, level: str) -> str:
    """SQL for an image's width or height after `level` halvings."""
    step = f"shiftleft(1L, {level})"
    return f"({cdiv(size, step)} - {cdiv(origin, step)})"
