"""Queries over decompositions with origins, directions and kernels from headers, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import synthesis
from tessera.plans.common import table, written
from tessera.plans.sample_queries import _D53, _S53, _VEC, _lift
from tessera.sources import codestream, segments

#: Vectors make planes of so many lines.
_LINES = 20


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of twenty vectors, at odd and even origins: image, y, x0, row."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "transform(embedding, e -> cast(cast(cast(e as double) * 1024 as bigint) as double)) AS row")
    return rows.selectExpr(f"vec_id div {_LINES} AS image", f"vec_id % {_LINES} + (vec_id div {_LINES}) % 3 AS y", f"(vec_id div {_LINES}) % 2 AS x0", "row")


def _levels(spark: SparkSession, sf_dir: str, directions: str, steps, reversible: bool) -> DataFrame:
    sizes = _lines(spark, sf_dir).groupBy("image").agg(F.min("x0").alias("x0"), (F.min("x0") + 64).alias("x1"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    return written(synthesis.planes(sizes.withColumns({"directions": F.expr(directions), "steps": steps, "reversible": F.lit(reversible)}), ["image"]), "levels")


def bands_with_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands of one level, in both directions, of planes at odd and even origins."""
    levels = _levels(spark, sf_dir, "array(1)", synthesis.kernel("5/3"), True)
    found = synthesis.analyse(_lines(spark, sf_dir), levels, ["image"], 1).select("image", "band", "y", "x0", F.posexplode("row").alias("k", "v"))
    return found.select("image", "band", "y", (F.col("x0") + F.col("k")).alias("x"), F.col("v").cast("bigint").alias("v"))


def region_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows on planes of three levels, split both ways, then along lines, then both ways, from the parts of bands that they need."""
    levels = _levels(spark, sf_dir, "array(1, 2, 1)", synthesis.kernel("5/3"), True)
    bands = written(synthesis.analyse(_lines(spark, sf_dir), levels, ["image"], 3), "bands")
    regions = levels.filter("level = 0").selectExpr("image", "u0 + image % 40 AS x_from", "u0 + image % 40 + 9 AS x_to", "v0 + image % 11 AS y_from", "v0 + image % 11 + 6 AS y_to")
    found = synthesis.synthesise(bands, levels, ["image"], 3, regions).select("image", "y", "x0", F.posexplode("row").alias("k", "v"))
    return found.select("image", "y", (F.col("x0") + F.col("k")).alias("x"), F.col("v").cast("bigint").alias("v"))


def region_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part of each level the windows depend on."""
    levels = _levels(spark, sf_dir, "array(1, 2, 1)", synthesis.kernel("9/7"), False)
    regions = levels.filter("level = 0").selectExpr("image", "u0 + image % 40 AS x_from", "u0 + image % 40 + 9 AS x_to", "v0 + image % 11 AS y_from", "v0 + image % 11 + 6 AS y_to")
    found = synthesis.wanted(levels, regions, ["image"], 3)
    return found.select("image", F.col("level").cast("bigint").alias("level"), "xa", "xb", "ya", "yb")


def header_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that define a kernel and a decomposition style, and name them for some components; vectors lifted by what holds."""
    i = F.col("p_partkey")
    size = {n: F.lit(64 if n in ("xsiz", "ysiz", "xtsiz", "ytsiz") else 0) for n in ("xsiz", "ysiz", "xosiz", "yosiz", "xtsiz", "ytsiz", "xtosiz", "ytosiz")}
    own = segments.segment(0xFF53, F.concat(F.lit("0100"), F.when(i % 2 == 0, "82").otherwise("03"), F.lit("040440"), F.when(i % 3 == 0, "05").otherwise("00")))
    head = F.concat(
        F.lit("ff4f"), segments.siz(size, F.expr("array_repeat(named_struct('xr', 1, 'yr', 1), 2)")), segments.cod(F.lit(2), F.lit(True)), own,
        segments.dfs(2, F.when(i % 4 == 0, F.expr("array(1, 2, 3, 0, 1)")).otherwise(F.expr("array(2)"))), segments.atk(5, 1.25, [0.25, -0.5]),
        segments.sot(F.lit(0), F.lit(0), F.lit(0), F.lit(1)), F.lit("ff93"),
    )
    files = table(spark, sf_dir, "part").select("p_partkey", F.unhex(head).alias("content"))
    found = codestream.component_transforms(codestream.markers(files), "p_partkey")
    line = F.expr("transform(sequence(0, 8), k -> cast((image_id * 7 + k * k * 5) % 101 as double))")
    out = synthesis.lifted(line, F.col("image_id") % 2, F.col("steps"), F.col("reversible"), False)
    total = F.aggregate(F.transform(out, lambda v, k: v * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    return found.withColumn("_total", total).select(
        "image_id", F.col("c").cast("bigint").alias("c"), F.array_join(F.col("directions").cast("array<string>"), ",").alias("directions"), F.size("steps").cast("bigint").alias("steps"),
        "reversible", F.round("k", 6).alias("k"), synthesis.safe_reduction(F.col("directions")).cast("bigint").alias("safe"), F.round("_total", 4).alias("total"),
    )


def nominal_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of the bands of images of one to six levels in different directions, some of them one sample wide."""
    sizes = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS image", "p_partkey % 3 AS x0", "p_partkey % 3 + if(p_partkey % 7 = 0, 1, 40) AS x1", "0L AS y0", "1 + p_partkey % 5 * 9 AS y1",
        "transform(sequence(1, 1 + cast(p_partkey % 6 AS int)), k -> cast((p_partkey + k * k) % 4 AS int)) AS directions", "true AS reversible",
    )
    levels = synthesis.planes(sizes.withColumn("steps", synthesis.kernel("9/7")), ["image"])
    found = synthesis.band_ranges(levels.withColumn("k", 1.0 + F.col("image") % 8 / 16), ["image"])
    return found.select("image", F.col("level").cast("bigint").alias("level"), "band", F.round("range", 6).alias("range"), F.col("number").cast("bigint").alias("number"))


QUERIES = {f.__name__: f for f in (nominal_ranges, bands_with_origins, region_synthesis, region_needs, header_kernels)}

_PLANES = f"{_VEC}, p AS (SELECT vec_id // {_LINES} AS image, vec_id % {_LINES} + (vec_id // {_LINES}) % 3 AS y, x + (vec_id // {_LINES}) % 2 AS x, v FROM s)"


def _lifts(steps: list[tuple[int, str]]) -> str:
    """A line of nine samples as columns v0 .. v8, lifted step by step; par is the parity of the first."""
    out, source = [], "ln"
    for n, (parity, rule) in enumerate(steps):
        at = []
        for k in range(9):
            a, b = f"v{k - 1 if k else 1}", f"v{k + 1 if k < 8 else 7}"
            at.append(f"CASE WHEN ({k} + par) % 2 = {parity} THEN v{k} + ({rule.format(a=a, b=b)}) ELSE v{k} END AS v{k}")
        out.append(f"k{n} AS (SELECT image_id, c, kind, par, {', '.join(at)} FROM {source})")
        source = f"k{n}"
    return ", ".join(out)


_BY_KIND = {
    (1, 0): ("-floor(({a} + {b}) / 2)", "{A} * ({a} + {b})", "-0.5::DOUBLE * ({a} + {b})"), (0, 1): ("floor(({a} + {b} + 2) / 4)", "{B} * ({a} + {b})", "0.25::DOUBLE * ({a} + {b})"),
    (1, 2): ("0", "{C} * ({a} + {b})", "0"), (0, 3): ("0", "{D} * ({a} + {b})", "0"),
}
_COEFFICIENTS = {"A": f"{synthesis.A97!r}::DOUBLE", "B": f"{synthesis.B97!r}::DOUBLE", "C": f"{synthesis.C97!r}::DOUBLE", "D": f"{synthesis.D97!r}::DOUBLE"}


def _rule(whole: str, long: str, short: str) -> str:
    for name, value in _COEFFICIENTS.items():
        long = long.replace("{" + name + "}", value)
    return f"CASE kind WHEN 1 THEN {whole} WHEN 0 THEN {long} ELSE {short} END"


ORACLE_SQL = {
    "nominal_ranges": """WITH RECURSIVE im AS (
  SELECT p_partkey AS image, p_partkey % 3 AS u0, p_partkey % 3 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 40 END AS u1, 0::BIGINT AS v0, 1 + p_partkey % 5 * 9 AS v1,
    1 + p_partkey % 6 AS n, 1.0::DOUBLE + p_partkey % 8 / 16.0::DOUBLE AS k FROM part
), r AS (
  SELECT image, 0 AS level, u0, u1, v0, v1, n, k, 1.0::DOUBLE AS low, 0 AS d, 1.0::DOUBLE AS hl, 1.0::DOUBLE AS lh, 1.0::DOUBLE AS hh, true AS ok FROM im
  UNION ALL SELECT image, level, CASE WHEN d IN (1, 2) THEN (u0 + 1) // 2 ELSE u0 END, CASE WHEN d IN (1, 2) THEN (u1 + 1) // 2 ELSE u1 END,
    CASE WHEN d IN (1, 3) THEN (v0 + 1) // 2 ELSE v0 END, CASE WHEN d IN (1, 3) THEN (v1 + 1) // 2 ELSE v1 END, n, k,
    low * CASE WHEN a THEN k ELSE 1 END * CASE WHEN b THEN k ELSE 1 END, d, low * CASE WHEN a THEN 2 / k ELSE 1 END * CASE WHEN b THEN k ELSE 1 END,
    low * CASE WHEN a THEN k ELSE 1 END * CASE WHEN b THEN 2 / k ELSE 1 END, low * CASE WHEN a THEN 2 / k ELSE 1 END * CASE WHEN b THEN 2 / k ELSE 1 END, u1 > u0 AND v1 > v0
  FROM (
    SELECT *, d IN (1, 2) AND u1 - u0 > 1 AS a, d IN (1, 3) AND v1 - v0 > 1 AS b
    FROM (SELECT image, level + 1 AS level, u0, u1, v0, v1, n, k, low, ((image + (level + 1) * (level + 1)) % 4)::INT AS d FROM r WHERE level < n)
  )
), s AS (SELECT *, CASE d WHEN 1 THEN 3 WHEN 0 THEN 0 ELSE 1 END AS bands FROM r WHERE level > 0),
o AS (SELECT *, 1 + coalesce(sum(bands) OVER (PARTITION BY image ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM s),
b AS (
  SELECT image, level, 'LL' AS band, low AS range, 0 AS number, ok FROM o WHERE level = n
  UNION ALL SELECT image, level, 'HL', hl, first, ok FROM o WHERE d IN (1, 2) UNION ALL SELECT image, level, 'LH', lh, first + CASE d WHEN 1 THEN 1 ELSE 0 END, ok FROM o WHERE d IN (1, 3)
  UNION ALL SELECT image, level, 'HH', hh, first + 2, ok FROM o WHERE d = 1
) SELECT image, level::BIGINT AS level, band, round(range, 6) AS range, number::BIGINT AS number FROM b WHERE ok""",
    "bands_with_origins": f"""WITH {_PLANES}, a AS ({_lift('p', 1, _D53, 'image, x', 'y')}), b AS ({_lift('a', 0, _S53, 'image, x', 'y')}),
c AS ({_lift('b', 1, _D53, 'image, y', 'x')}), d AS ({_lift('c', 0, _S53, 'image, y', 'x')})
SELECT image, (CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN 'LL' WHEN y % 2 = 0 THEN 'HL' WHEN x % 2 = 0 THEN 'LH' ELSE 'HH' END) AS band, y // 2 AS y, x // 2 AS x, v FROM d""",
    "region_synthesis": f"""WITH {_PLANES}, f AS (SELECT image, min(x) AS u0, min(y) AS v0 FROM p GROUP BY image)
SELECT p.image, y, x, v FROM p JOIN f ON f.image = p.image WHERE x BETWEEN u0 + p.image % 40 AND u0 + p.image % 40 + 8 AND y BETWEEN v0 + p.image % 11 AND v0 + p.image % 11 + 5""",
    "region_needs": f"""WITH RECURSIVE {_PLANES}, f AS (SELECT image, min(x) AS u0, max(x) + 1 AS u1, min(y) AS v0, max(y) + 1 AS v1 FROM p GROUP BY image),
r AS (
  SELECT image, 0 AS level, u0 + image % 40 AS xa, u0 + image % 40 + 9 AS xb, v0 + image % 11 AS ya, v0 + image % 11 + 6 AS yb, u0, u1, v0, v1 FROM f
  UNION ALL SELECT image, level + 1, (xa - 4) >> 1, ((xb + 5) >> 1) + 1, CASE level WHEN 1 THEN ya ELSE (ya - 4) >> 1 END, CASE level WHEN 1 THEN yb ELSE ((yb + 5) >> 1) + 1 END,
    (u0 + 1) // 2, (u1 + 1) // 2, CASE level WHEN 1 THEN v0 ELSE (v0 + 1) // 2 END, CASE level WHEN 1 THEN v1 ELSE (v1 + 1) // 2 END FROM r WHERE level < 3
)
SELECT image, level::BIGINT AS level, least(greatest(xa, u0), u1) AS xa, least(greatest(xb, u0), u1) AS xb, least(greatest(ya, v0), v1) AS ya, least(greatest(yb, v0), v1) AS yb FROM r""",
    "header_kernels": f"""WITH pc AS (
  SELECT p_partkey AS image_id, c.range AS c, CASE WHEN c.range = 0 THEN 1 WHEN p_partkey % 3 = 0 THEN 5 ELSE 0 END AS kind, p_partkey % 2 AS par FROM part, range(2) c
), ln AS (SELECT *, {', '.join(f'((image_id * 7 + {k * k * 5}) % 101)::DOUBLE AS v{k}' for k in range(9))} FROM pc),
{_lifts([(parity, _rule(*rules)) for (parity, _), rules in _BY_KIND.items()])}
SELECT image_id, c, CASE WHEN c = 0 THEN '1,1' WHEN image_id % 2 = 1 THEN '1,1,1' WHEN image_id % 4 = 0 THEN '1,2,3,0,1' ELSE '2' END AS directions, CASE kind WHEN 0 THEN 4 ELSE 2 END::BIGINT AS steps,
  kind = 1 AS reversible, round(CASE kind WHEN 0 THEN 1.230174104914001 WHEN 1 THEN 1.0 ELSE 1.25 END::DOUBLE, 6) AS k,
  CASE WHEN c = 0 THEN 2 WHEN image_id % 2 = 1 THEN 3 WHEN image_id % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS safe,
  round({' + '.join(f'{k + 1} * v{k}' for k in range(9))}, 4) AS total FROM k3""",
}
