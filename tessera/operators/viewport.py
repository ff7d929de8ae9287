"""View-window queries: which precincts a window on a scaled canvas needs.

A requests table has one row per query: req_id, fx, fy (canvas size wanted), ox, oy (offset), sx, sy (window size; both
0 means the rest of the canvas), comps (component numbers; null or empty means all), round ('down', 'up', 'closest'),
and image_id. Many queries over many images are one job: requests join images on image_id and everything else follows
by arithmetic on the row, so no table of precincts is scanned. Components that are sampled and coded alike need the same
precincts of their own, so ranges are worked out once for each way of sampling and coding (a class).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.geometry import CODING, cdiv, most_levels, reduced_size, sat, with_codings


def let(rows: DataFrame, **columns: str) -> DataFrame:
    """Adds columns that later ones read many times. They come from a generator of one row, which Catalyst does not
    inline, so each is worked out once and not wherever it is named."""
    fields = ", ".join(f"'{name}', {sql}" for name, sql in columns.items())
    return rows.selectExpr("*", f"inline(array(named_struct({fields})))")


def with_defaults(requests: DataFrame) -> DataFrame:
    """A missing canvas size means the full canvas (0), a missing window the whole of it, a missing rounding 'down'."""
    filled = requests
    for c in ("fx", "fy", "ox", "oy"):
        filled = filled.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("bigint"))
    return filled.withColumns(
        {
            "sx": F.coalesce("sx", "fx").cast("bigint"),
            "sy": F.coalesce("sy", "fy").cast("bigint"),
            "round": F.coalesce("round", F.lit("down")),
        }
    )


def discard_levels(asked: DataFrame) -> DataFrame:
    """Adds k, the number of resolutions left out. asked: requests joined with images, levels being the most of any component."""
    w = lambda q: reduced_size("xsiz", "xosiz", q)
    h = lambda q: reduced_size("ysiz", "yosiz", q)
    full = asked.selectExpr("*", f"if(fx = 0, {w('0')}, fx) AS _fx", f"if(fy = 0, {h('0')}, fy) AS _fy", "sequence(0, levels) AS _q")
    k = f"""CASE round
          WHEN 'up' THEN coalesce(array_max(filter(_q, q -> {w('q')} >= _fx AND {h('q')} >= _fy)), 0)
          WHEN 'closest' THEN array_min(transform(_q, q -> struct(abs({w('q')} * {h('q')} - _fx * _fy) AS d, q AS q))).q
          ELSE coalesce(array_min(filter(_q, q -> {w('q')} <= _fx AND {h('q')} <= _fy)), levels) END"""
    return let(full, k=k).drop("_fx", "_fy", "_q")


def canvas_boxes(asked: DataFrame) -> DataFrame:
    """Adds the window [ax, bx) x [ay, by) on the reference grid; windows that are empty there go."""
    ends = {}
    for axis, o, s in (("x", "ox", "sx"), ("y", "oy", "sy")):
        ends[f"a{axis}"] = f"{o} * shiftleft(1L, k) + {axis}osiz"
        ends[f"b{axis}"] = f"if(sx = 0 AND sy = 0, {axis}siz, least(({o} + {s}) * shiftleft(1L, k) + {axis}osiz, {axis}siz))"
    return let(asked, **ends).filter("ax < bx AND ay < by")


def window_tiles(boxes: DataFrame) -> DataFrame:
    """One row per request and tile that its window meets, in tile order: t and the window clipped to it."""
    span = let(boxes, tiles_x=cdiv("xsiz - xtosiz", "xtsiz"), tiles_y=cdiv("ysiz - ytosiz", "ytsiz"))
    ends = {}
    for axis in "xy":
        ends[f"t{axis}lo"] = f"{sat(f'a{axis}', f'{axis}tosiz')} div {axis}tsiz"
        ends[f"t{axis}hi"] = f"least(tiles_{axis}, {cdiv(sat(f'b{axis}', f'{axis}tosiz'), f'{axis}tsiz')})"
    some = let(span, **ends).filter("txhi > txlo AND tyhi > tylo")
    each = some.selectExpr("*", "explode(sequence(tylo, tyhi - 1)) AS ty").selectExpr("*", "explode(sequence(txlo, txhi - 1)) AS tx")
    rect = {}
    for axis in "xy":
        rect[f"t{axis}0"] = f"greatest({axis}tosiz + t{axis} * {axis}tsiz, {axis}osiz)"
        rect[f"t{axis}1"] = f"least({axis}tosiz + (t{axis} + 1) * {axis}tsiz, {axis}siz)"
    each = let(each, **rect)
    clipped = {f"ca{axis}": f"greatest(a{axis}, t{axis}0)" for axis in "xy"} | {f"cb{axis}": f"least(b{axis}, t{axis}1)" for axis in "xy"}
    return let(each, t="ty * tiles_x + tx", **clipped).filter("cax < cbx AND cay < cby")


def component_classes(images: DataFrame, tile_codings: DataFrame | None = None) -> DataFrame:
    """Images with comps replaced by comps_n and classes: each way of sampling and coding, with the components cs that have
    it. levels is the most of any component of any tile."""
    cs = "filter(sequence(0, size(comps) - 1), c -> comps[c] = s)"
    fields = ", ".join(f"'{f}', s.{f}" for f in ("xr", "yr", *CODING))
    each = f"transform(array_distinct(comps), s -> named_struct({fields}, 'cs', {cs}))"
    most = "coalesce(array_max(transform(comps, x -> x.levels)), levels)"
    found = with_codings(images).selectExpr("*", "size(comps) AS comps_n", f"{each} AS classes", f"{most} AS _most").drop("comps", *CODING)
    if tile_codings is not None:
        found = found.drop("_most").join(most_levels(images, tile_codings).withColumnRenamed("levels", "_most"), "image_id")
    return found.withColumnRenamed("_most", "levels")


def tile_classes(of_tiles: DataFrame, tile_codings: DataFrame) -> DataFrame:
    """Rows of window_tiles() with the classes of those tiles that have codings of their own."""
    own = tile_codings.groupBy("image_id", "t").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct(*CODING)))).alias("_own"))
    holds = ", ".join(f"'{f}', if(_own[c] IS NOT NULL, _own[c].{f}, k.{f})" for f in CODING)
    flat = f"flatten(transform(classes, k -> transform(k.cs, c -> named_struct('c', c, 'k', named_struct('xr', k.xr, 'yr', k.yr, {holds})))))"
    fields = ", ".join(f"'{f}', k.{f}" for f in ("xr", "yr", *CODING))
    again = f"transform(array_distinct(transform(_flat, f -> f.k)), k -> named_struct({fields}, 'cs', array_sort(transform(filter(_flat, f -> f.k = k), f -> f.c))))"
    joined = let(of_tiles.join(own, ["image_id", "t"], "left"), _flat=f"if(_own IS NULL, NULL, {flat})")
    return joined.withColumn("classes", F.expr(f"if(_own IS NULL, classes, {again})")).drop("_own", "_flat")


def class_ranges(of_tiles: DataFrame) -> DataFrame:
    """One row per request, tile, class and resolution with the range of precinct columns and rows that each of the components
    cs needs, and their number n_each.

    A window is widened on each resolution but the top one by what the class's synthesis filters reach: 8 samples, or 4 if
    reversible. A class with fewer levels than are left out keeps its lowest resolution.
    """
    by_class = of_tiles.drop(*CODING).selectExpr("*", "inline(classes)")
    wanted = "if(comps IS NULL OR size(comps) = 0, cs, array_intersect(cs, comps))"
    on_grid = {f"tc{end}{axis}": cdiv(f"c{end}{axis}", f"{axis}r") for axis in "xy" for end in "ab"}
    on_grid |= {f"tt{end}{axis}": cdiv(f"t{axis}{end}", f"{axis}r") for axis in "xy" for end in "01"}
    by_class = let(by_class, wanted=wanted, **on_grid).filter("size(wanted) > 0 AND tcax < tcbx AND tcay < tcby")
    by_res = by_class.selectExpr("*", "explode(sequence(0, if(k >= levels, 0, levels - k))) AS r")
    by_res = let(
        by_res,
        scale="shiftleft(1L, levels - r)",
        margin="CASE WHEN r = levels THEN 0 WHEN reversible THEN 4 ELSE 8 END",
        psx="shiftleft(1L, precincts[r].ppx)",
        psy="shiftleft(1L, precincts[r].ppy)",
    )
    by_res = let(by_res, **{f"r{end}{axis}": cdiv(f"tt{end}{axis}", "scale") for axis in "xy" for end in "01"})
    grid = {}
    for axis in "xy":
        grid[f"off{axis}"] = f"r0{axis} div ps{axis}"
        grid[f"np{axis}"] = f"if(r1{axis} > r0{axis}, {cdiv(f'r1{axis}', f'ps{axis}')} - r0{axis} div ps{axis}, 0)"
        grid[f"lo{axis}"] = sat(f"tca{axis} div scale", "margin")
        grid[f"hi{axis}"] = f"{cdiv(f'tcb{axis}', 'scale')} + margin"
    ends = {}
    for axis in "xy":
        ends[f"p{axis}_lo"] = f"greatest(lo{axis} div ps{axis} - off{axis}, 0)"
        ends[f"p{axis}_hi"] = f"least(np{axis}, {cdiv(f'hi{axis}', f'ps{axis}')} - off{axis})"
    found = let(let(by_res, **grid), **ends).filter("px_hi > px_lo AND py_hi > py_lo")
    return found.selectExpr(
        "req_id", "image_id", "t", "wanted AS cs", "r", "npx AS npw", "npy AS nph", "px_lo", "px_hi", "py_lo", "py_hi",
        "(px_hi - px_lo) * (py_hi - py_lo) AS n_each", "tiles_x * tiles_y AS tiles_n", "comps_n",
    )


def resolve_classes(requests: DataFrame, images: DataFrame, tile_codings: DataFrame | None = None) -> DataFrame:
    """class_ranges of every request; requests that need nothing have no rows. Counting needs no more: sum n_each times
    size(cs). The side that is joined is one row per image, and tiles' own codings, if there are any, one row per such tile.
    Rows are dealt by request first: a request is small and what follows from it is not, and sums by request then need no
    further exchange."""
    asked = with_defaults(requests).repartition("req_id").join(component_classes(images, tile_codings), "image_id")
    of_tiles = window_tiles(canvas_boxes(discard_levels(asked)))
    return class_ranges(of_tiles if tile_codings is None else tile_classes(of_tiles, tile_codings))


def resolve(requests: DataFrame, images: DataFrame, tile_codings: DataFrame | None = None) -> DataFrame:
    """The ranges of every request, one row per tile, component c and resolution, with their number n_precincts."""
    found = resolve_classes(requests, images, tile_codings).selectExpr("*", "explode(cs) AS c", "n_each AS n_precincts")
    return found.drop("cs", "n_each")


def union_counts(ranges: DataFrame, by: list[str], part: str, parts: int) -> DataFrame:
    """by..., n: how many precincts are in any of the ranges of `parts` parts (numbered from 0, one range each at most) of a
    tile, component and resolution, by inclusion and exclusion of their rectangles; no precinct is listed."""
    sides = ("px_lo", "px_hi", "py_lo", "py_hi")
    wide = ranges.groupBy(*by).agg(*[F.max(F.when(F.col(part) == i, F.col(s))).alias(f"{s}{i}") for i in range(parts) for s in sides])
    total = F.lit(0).cast("bigint")
    for size in range(1, parts + 1):
        for some in combinations(range(parts), size):
            pick = lambda s: [F.col(f"{s}{i}") for i in some]  # noqa: E731, B023
            hi, lo = (F.least, F.greatest) if size > 1 else (lambda x: x, lambda x: x)
            wide_x = hi(*pick("px_hi")) - lo(*pick("px_lo"))
            wide_y = hi(*pick("py_hi")) - lo(*pick("py_lo"))
            there = F.lit(True)
            for c in pick("px_lo"):
                there = there & c.isNotNull()
            area = F.when(there & (wide_x > 0) & (wide_y > 0), wide_x * wide_y).otherwise(0)
            total = total + area if size % 2 else total - area
    return wide.select(*by, total.alias("n"))


def precinct_keys(ranges: DataFrame, of_resolutions: DataFrame) -> DataFrame:
    """(req_id, image_id, t, c, r, p, I) of each precinct in the ranges, sorted within a request by I when written in order.

    of_resolutions: geometry.resolutions() of the same images and tile codings, for the numbers of precincts before a resolution.
    """
    rows = ranges.selectExpr("*", "explode(sequence(py_lo, py_hi - 1)) AS py").selectExpr("*", "explode(sequence(px_lo, px_hi - 1)) AS px")
    before = of_resolutions.select("image_id", "t", "c", "r", "s_offset")
    return rows.join(before, ["image_id", "t", "c", "r"]).selectExpr(
        "req_id", "image_id", "t", "c", "r", "py * npw + px AS p", "t + (c + (s_offset + py * npw + px) * comps_n) * tiles_n AS I"
    )


def in_order(keys: DataFrame) -> DataFrame:
    """Adds place: the precincts of each request from the least id (I) up, as they are sent."""
    return keys.withColumn("place", F.row_number().over(Window.partitionBy("req_id").orderBy("I")) - 1)


def tiles_in_order(keys: DataFrame) -> DataFrame:
    """(req_id, t, place): each request's tiles, once each, in the order in which its precincts first name them."""
    first = keys.groupBy("req_id", "t").agg(F.min("I").alias("_i"))
    return first.select("req_id", "t", (F.row_number().over(Window.partitionBy("req_id").orderBy("_i")) - 1).alias("place"))


def foveated_requests(gazes: DataFrame, width: int, height: int, fovea: int, parafovea: int, ratios=(1.0, 0.5, 0.125)) -> DataFrame:
    """Three windows per gaze (req_id, gx, gy): the fovea at full size, the parafovea at a smaller one, and the whole image
    at the smallest."""
    parts = []
    for cone, (radius, ratio) in enumerate(((fovea, ratios[0]), (parafovea, ratios[1]), (None, ratios[2]))):
        fx, fy = max(1, int(width * ratio)), max(1, int(height * ratio))
        if radius is None:
            box = ["0L AS ox", "0L AS oy", f"{fx}L AS sx", f"{fy}L AS sy"]
        else:
            r = radius * fx // width
            box = [
                f"{sat(f'gx * {fx} div {width}', str(r))} AS ox", f"{sat(f'gy * {fy} div {height}', str(r))} AS oy",
                f"{2 * r}L AS sx", f"{2 * r}L AS sy",
            ]
        parts.append(f"named_struct('cone', {cone}, 'fx', {fx}L, 'fy', {fy}L, " + ", ".join(f"'{x.split(' AS ')[1]}', cast({x.split(' AS ')[0]} as bigint)" for x in box) + ")")
    each = gazes.selectExpr("*", f"explode(array({', '.join(parts)})) AS w")
    return each.select(*gazes.columns, "w.*").withColumns({"comps": F.lit(None).cast("array<int>"), "round": F.lit("down")})
