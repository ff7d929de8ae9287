"""Queries over samples: colour, wavelets, quantisation, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import color, quant, transform
from tessera.plans.common import table


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct colours of the lines' keys, 8 bits each."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_orderkey % 256 AS int) AS r", "cast(l_partkey % 256 AS int) AS g", "cast(l_suppkey % 256 AS int) AS b"
    ).distinct()


def _named(values, names) -> list:
    return [v.cast("bigint").alias(n) for v, n in zip(values, names, strict=True)]



def rct_forward_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = _pixels(spark, sf_dir).select("r", "g", "b", *_named(color.rct_forward(F.col("r"), F.col("g"), F.col("b")), ("y", "cb", "cr")))
    return there.select("*", *_named(color.rct_inverse(F.col("y"), F.col("cb"), F.col("cr")), ("r2", "g2", "b2")))


def ict_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = _pixels(spark, sf_dir).select("r", "g", "b", *_named(color.ict_forward(F.col("r"), F.col("g"), F.col("b")), ("y", "cb", "cr")))
    return there.select("*", *_named(color.ict_inverse(F.col("y"), F.col("cb"), F.col("cr")), ("r2", "g2", "b2")))


def finalize_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _pixels(spark, sf_dir).select("r", "g", "b", ((F.col("r") - 128) * 37.25 - F.col("g") * 1.5).alias("x"))
    return wide.select(
        "r", "g", "b", *_named((color.finalize(F.col("x"), 5, 128, 0, 255), color.finalize(F.col("x"), -2, 2048, 0, 4095),
        color.to_bytes(F.col("g") * 40, 4), color.dc_shift(F.col("b"), 8, False)), ("down", "up", "byte", "centred")),
    )


def ycbcr_fixed_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, cb, cr = F.col("r"), F.col("g"), F.col("b")
    return _pixels(spark, sf_dir).select(
        "r", "g", "b", *_named(color.ycbcr_fixed_rgb(y, cb, cr, "BT709", 8), ("r7", "g7", "b7")),
        *_named(color.ycbcr_fixed_rgb(y, cb, cr, "BT601", 8), ("r6", "g6", "b6")),
    )


def matrix_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, cb, cr, mat = F.col("r"), F.col("g"), F.col("b"), F.col("r") % 11
    rows = _pixels(spark, sf_dir).withColumn("matrix", color.matrix_of(mat))
    out = {}
    for i in range(3):
        chosen = F.when(F.col("matrix") == "RGB", (y, cb, cr)[i])
        for name in ("BT601", "BT709", "BT2020"):
            chosen = chosen.when(F.col("matrix") == name, color.ycbcr_rgb(y, cb, cr, name, "narrow", 8)[i])
        out["xyz"[i]] = F.coalesce(chosen, F.lit(-1)).cast("bigint")
    return rows.select("r", "g", "b", F.coalesce("matrix", F.lit("none")).alias("matrix"), *[v.alias(k) for k, v in out.items()])


def chroma_upsample_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every luma sample with the chroma sample that stands for it: 64 luma samples a row, 32 chroma samples."""
    chroma = color.upsampled(F.slice("v", 1, 32), F.size("v"))
    each = _samples(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip("v", chroma.alias("c"))).alias("x", "s"))
    return each.select("vec_id", F.col("x").cast("bigint").alias("x"), *_named((F.col("s.v"), F.col("s.c")), ("luma", "chroma")))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of 64 whole numbers per vector."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") * 1024).cast("int")).alias("v"))


def _long(rows: DataFrame, column: str, digits: int | None = None) -> DataFrame:
    value = F.col("v").cast("bigint") if digits is None else F.round("v", digits)
    return rows.select("vec_id", F.posexplode(column).alias("x", "v")).select("vec_id", F.col("x").cast("bigint").alias("x"), value.alias("v"))


def dwt53_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(_samples(spark, sf_dir).select("vec_id", transform.forward(F.col("v"), "5/3").alias("w")), "w")


def dwt97_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    return _long(rows.select("vec_id", transform.forward(F.col("v"), "9/7").alias("w")), "w", 6)


def dwt53_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows cut to 64 - vec_id % 20 samples, taken apart and put together again at either parity of the first sample."""
    rows = _samples(spark, sf_dir).withColumn("v", F.expr("slice(v, 1, 64 - cast(vec_id % 20 AS int))"))
    out = rows
    for o in (0, 1):
        w = transform.forward(F.col("v"), "5/3", o)
        again = transform.interleave(transform.low(F.col(f"w{o}"), o), transform.high(F.col(f"w{o}"), o), o)
        out = out.withColumn(f"w{o}", w).withColumn(f"r{o}", again).withColumn(f"r{o}", transform.inverse(F.col(f"r{o}"), "5/3", o))
    same = (F.col("r0") == F.col("v")) & (F.col("r1") == F.col("v"))
    return out.select("vec_id", F.size("v").cast("bigint").alias("n"), same.alias("same"))


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight lines of eight samples per vector."""
    lines = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(i.alias("y"), F.slice("v", i * 8 + 1, 8).alias("row")))
    return _samples(spark, sf_dir).select("vec_id", F.explode(lines).alias("l")).select("vec_id", "l.y", "l.row")


def dwt53_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transform.forward_2d(_planes(spark, sf_dir), "5/3", ["vec_id"])
    flat = found.select("vec_id", "band", F.col("y").cast("bigint").alias("y"), F.posexplode("row").alias("x", "v"))
    return flat.select("vec_id", "band", "y", F.col("x").cast("bigint").alias("x"), F.col("v").cast("bigint").alias("v"))


def dwt53_2d_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = _planes(spark, sf_dir)
    again = transform.inverse_2d(transform.forward_2d(plane, "5/3", ["vec_id"]), "5/3", ["vec_id"]).withColumnRenamed("row", "again")
    both = plane.join(again.withColumn("y", F.col("y").cast("int")), ["vec_id", "y"])
    return both.groupBy("vec_id").agg(F.count("*").alias("lines"), F.bool_and(F.col("row") == F.col("again")).alias("same"))


def tagtree_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _planes(spark, sf_dir).select("vec_id", "y", F.posexplode("row").alias("x", "v"))
    found = transform.tag_tree(leaves, ["vec_id"], "x", "y", "v", 3)
    return found.select("vec_id", *[F.col(c).cast("bigint").alias(c) for c in ("k", "x", "y", "v")])


def quantize_deadzone(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("r") * 3.75 - F.col("g") * 2.5
    q = quant.quantize(x, 0.5 + F.col("b") % 16 * 0.25)
    rows = _pixels(spark, sf_dir).select("r", "g", "b", q.cast("bigint").alias("q"))
    return rows.select("*", quant.sign_magnitude(F.col("q")).alias("coded"))


def dequantize_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = 0.5 + F.col("b") % 16 * 0.25
    q = quant.quantize(F.col("r") * 3.75 - F.col("g") * 2.5, step)
    return _pixels(spark, sf_dir).select("r", "g", "b", F.round(quant.dequantize(q, step), 6).alias("x"))


def magnitude_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR of a block's magnitudes and the bits it needs, over blocks by part size."""
    rows = table(spark, sf_dir, "part").selectExpr("p_size", "cast(p_partkey * 37 % 4093 AS bigint) AS m")
    found = rows.groupBy("p_size").agg(F.bit_or("m").alias("any_bit"))
    return found.select("p_size", "any_bit", F.expr("cast(if(any_bit = 0, 0, length(bin(any_bit))) AS bigint)").alias("bits"))


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 1024 AS a", "l_partkey % 64 AS b").distinct().selectExpr(
        "a", "b", "a / 1023.0D AS e", "(a * 3 + b * 11) % 1024 / 1023.0D AS f"
    )


def pq_hlg_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    shown = color.display_pipeline(e, F.col("f"), F.lit(0.25), "hlg", True, False)
    return _curves(spark, sf_dir).select(
        "a", "b", F.round(color.pq_to_linear(e), 9).alias("pq"), F.round(color.linear_to_pq(e), 9).alias("to_pq"),
        F.round(color.hlg_to_linear(e), 9).alias("hlg"), *[F.round(v, 7).alias(n) for v, n in zip(shown, "rgz", strict=True)],
    )


def tonemap_bt2390(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = color.display_pipeline(F.col("e"), F.col("f"), F.lit(0.5), "pq", False, True)
    return _curves(spark, sf_dir).select("a", "b", *[F.round(v, 7).alias(n) for v, n in zip(shown, "rgz", strict=True)])


def quant_step_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "pow(0.97D, p_partkey % 700) * 0.999D AS step")
    packed = rows.withColumn("p", quant.pack_step(F.col("step")))
    return packed.select("p_partkey", *_named((F.col("p.eps"), F.col("p.mu")), ("eps", "mu")), F.round(quant.unpack_step(F.col("p.eps"), F.col("p.mu")), 12).alias("back"))


def qfactor_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale, power = quant.q_scale(F.col("q"), 8)
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "1 + p_partkey % 100 AS q").select("p_partkey", "q", F.round(scale, 9).alias("scale"), F.round(power, 9).alias("power"))


def qfactor_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step words of each part's factor, for luma and both chroma components at 8 bits and five levels."""
    out = None
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "1 + p_partkey % 100 AS q")
    for name in ("Y", "Cb", "Cr"):
        rows = parts.join(F.broadcast(quant.bands(spark, 5, name)))
        found = quant.steps(rows, "q", name, 8).select("p_partkey", F.lit(name).alias("component"), *_named((F.col("band"), F.col("word")), ("band", "word")))
        out = found if out is None else out.unionByName(found)
    return out


def qfactor_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header per part, made with a factor of its own and, for some, moved steps; the factor is to be found again."""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "1 + p_partkey % 99 AS q")
    made = quant.steps(parts.join(F.broadcast(quant.bands(spark, 5))), "q", "Y", 8)
    moved = made.withColumn("mu", F.expr("if(p_partkey % 4 = 3, pmod(mu + 300 * (band % 3), 2048), mu)"))
    found = quant.estimate_q(moved.withColumnRenamed("q", "made_with"), ["p_partkey", "made_with"], "Y", 8, 5)
    return found.select("p_partkey", "made_with", F.col("q").cast("bigint").alias("q"), F.round("residual", 6).alias("residual"), "verdict")


_PIX = "px AS (SELECT DISTINCT (l_orderkey % 256)::INT AS r, (l_partkey % 256)::INT AS g, (l_suppkey % 256)::INT AS b FROM lineitem)"
_VEC = "s AS (SELECT vec_id, x.range AS x, trunc(embedding[x.range + 1]::DOUBLE * 1024)::BIGINT AS v FROM embeddings, range(64) x)"
_ICT = (0.299, 1 - 0.299 - 0.114, 0.114)


def _clamp(e: str, top: int = 255) -> str:
    return f"least(greatest({e}, 0), {top})"


def _fixed(m: str, suffix: str) -> str:
    a, b, c, d = color.FIXED_MATRICES[m]
    return (
        f"{_clamp(f'r + (({a} * (b - 128) + 8192) >> 14)')}::BIGINT AS r{suffix}, "
        f"{_clamp(f'r - (({b} * (g - 128) + {c} * (b - 128) + 8192) >> 14)')}::BIGINT AS g{suffix}, "
        f"{_clamp(f'r + (({d} * (g - 128) + 8192) >> 14)')}::BIGINT AS b{suffix}"
    )


def _narrow(i: int) -> str:
    cases = ""
    for name in ("BT601", "BT709", "BT2020"):
        a, b, c, d = color.MATRICES[name, "narrow"]
        y, u, v = "((r - 16) / 219.0::DOUBLE)", "((g - 128) / 224.0::DOUBLE)", "((b - 128) / 224.0::DOUBLE)"
        e = (f"{y} + {a}::DOUBLE * {v}", f"{y} - {b}::DOUBLE * {u} - {c}::DOUBLE * {v}", f"{y} + {d}::DOUBLE * {u}")[i]
        cases += f" WHEN matrix = '{name}' THEN floor(least(greatest({e}, 0), 1) * 255 + 0.5)::BIGINT"
    return f"CASE WHEN matrix = 'RGB' THEN {'rgb'[i]}{cases} ELSE -1 END::BIGINT AS {'xyz'[i]}"


#: One lifting step over rows (vec_id, x, v) of n samples: odd or even samples take the mirrored neighbours.
def _lift(src: str, parity: int, expr: str, by: str = "vec_id", at: str = "x") -> str:
    w = f"(PARTITION BY {by} ORDER BY {at})"
    a, b = f"coalesce(lag(v) OVER {w}, lead(v) OVER {w})", f"coalesce(lead(v) OVER {w}, lag(v) OVER {w})"
    return f"SELECT * REPLACE (CASE WHEN {at} % 2 = {parity} THEN v + ({expr.format(a=a, b=b)}) ELSE v END AS v) FROM {src}"


_D53, _S53 = "-(({a} + {b}) >> 1)", "({a} + {b} + 2) >> 2"
_PQ = "CASE WHEN 18.8515625 - 18.6875 * pow({e}, 1 / 78.84375) <= 0 THEN 1 ELSE pow(greatest(pow({e}, 1 / 78.84375) - 0.8359375, 0) / (18.8515625 - 18.6875 * pow({e}, 1 / 78.84375)), 1 / 0.1593017578125) END"
_TO_PQ = "pow((0.8359375 + 18.8515625 * pow({e}, 0.1593017578125)) / (1 + 18.6875 * pow({e}, 0.1593017578125)), 78.84375)"
_HLG = "CASE WHEN {e} <= 0.5 THEN {e} * {e} / 3 ELSE (exp(({e} - 0.55991073) / 0.17883277) + 0.28466892) / 12 END"
_SRGB = "CASE WHEN {e} <= 0.0031308 THEN 12.92 * {e} ELSE 1.055 * pow({e}, 1 / 2.4) - 0.055 END"
_CRV = """c0 AS (SELECT DISTINCT l_orderkey % 1024 AS a, l_partkey % 64 AS b FROM lineitem),
cv AS (SELECT a, b, a / 1023.0::DOUBLE AS e, (a * 3 + b * 11) % 1024 / 1023.0::DOUBLE AS f FROM c0)"""


def _shown(e: str) -> str:
    return f"round({_SRGB.format(e=f'least(greatest({e}, 0), 1)')}, 7)"


def _mapped(e: str) -> str:
    return _SRGB.format(e=e)


_BANDS_SQL = "bd AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {15 - i}, {g!r}::DOUBLE, {(quant.WEIGHTS[n, '444'][i] if i < 15 else 1.0)!r}::DOUBLE, {quant.GAINS[n]!r}::DOUBLE)"
    for n in ("Y", "Cb", "Cr") for i, g in enumerate(quant.band_gains(5, False))
) + ") t(component, band, gain, weight, cgain))"
_Q_SQL = """
CASE WHEN q < 50 THEN 50.0::DOUBLE / q ELSE 2 * (1 - q / 100.0::DOUBLE) END AS m,
CASE WHEN q >= 97 THEN 0 WHEN q > 65 THEN (ln(2 * (1 - 0.97::DOUBLE)) - ln(2 * (1 - q / 100.0::DOUBLE))) / (ln(2 * (1 - 0.97::DOUBLE)) - ln(2 * (1 - 0.65::DOUBLE))) ELSE 1 END::DOUBLE AS power"""
_SCALE = "CASE WHEN q >= 97 THEN 0.1 WHEN q > 65 THEN 0.1 * pow(0.4::DOUBLE, power) ELSE 0.04 END::DOUBLE * m + sqrt(0.5::DOUBLE) / 256"


def _packed(src: str) -> str:
    return f"""k AS (SELECT *, (SELECT min(i) FROM range(60) t(i) WHERE step * pow(2::DOUBLE, i) >= 1) AS e FROM {src}),
k2 AS (SELECT *, floor((step * pow(2::DOUBLE, e) - 1) * 2048 + 0.5)::BIGINT AS m0 FROM k),
k3 AS (SELECT *, CASE WHEN m0 >= 2048 THEN e - 1 ELSE e END AS e1, CASE WHEN m0 >= 2048 THEN 0 ELSE m0 END AS m1 FROM k2),
pk AS (SELECT *, least(greatest(e1, 0), 31)::BIGINT AS eps, CASE WHEN e1 > 31 THEN 0 WHEN e1 < 0 THEN 2047 ELSE m1 END::BIGINT AS mu FROM k3)"""


_STEPS_SQL = "step AS (SELECT *, ({s}) * 1.7321::DOUBLE / (sqrt(gain) * pow(weight, power) * cgain) AS step FROM qb)"

QUERIES = {
    f.__name__: f
    for f in (
        rct_forward_inverse, ict_forward, finalize_clamp, ycbcr_fixed_rgb, matrix_select, chroma_upsample_nn, dwt53_forward, dwt97_forward,
        dwt53_roundtrip, dwt53_2d, dwt53_2d_roundtrip, tagtree_min, quantize_deadzone, dequantize_midpoint, magnitude_bits, pq_hlg_pipeline,
        tonemap_bt2390, quant_step_pack, qfactor_curve, qfactor_bands, qfactor_estimate,
    )
}

_TM_SOURCE = color._pq(0.1)
_TM_TOP = color._pq(color.DISPLAY_PEAK) / _TM_SOURCE
_TM_KNEE = 1.5 * _TM_TOP - 0.5


def _tone_sql(e: str, name: str) -> str:
    return f"""{name}1 AS (SELECT *, least(({_TO_PQ.format(e=f'({_PQ.format(e=e)})')}) / {_TM_SOURCE!r}::DOUBLE, 1) AS u FROM {{src}}),
{name}2 AS (SELECT *, (u - {_TM_KNEE!r}::DOUBLE) / (1 - {_TM_KNEE!r}::DOUBLE) AS t FROM {name}1),
{name}3 AS (SELECT * EXCLUDE (u, t), {_TM_SOURCE!r}::DOUBLE * CASE WHEN u >= {_TM_KNEE!r}::DOUBLE THEN (2 * t * t * t - 3 * t * t + 1) * {_TM_KNEE!r}::DOUBLE + (t * t * t - 2 * t * t + t) * (1 - {_TM_KNEE!r}::DOUBLE)
  + (3 * t * t - 2 * t * t * t) * {_TM_TOP!r}::DOUBLE ELSE u END AS w FROM {name}2),
{name} AS (SELECT * EXCLUDE (w), least(greatest(({_PQ.format(e='w')}) / {color.DISPLAY_PEAK!r}::DOUBLE, 0), 1) AS {name}_v FROM {name}3)"""


#: The step words of all factors (pk).
_WORDS_SQL = f"""WITH {_BANDS_SQL}, qs AS (SELECT i AS q FROM range(1, 101) t(i)), s AS (SELECT *, {_Q_SQL} FROM qs), qb AS (SELECT * FROM s, bd),
{_STEPS_SQL.format(s=_SCALE)}, {_packed('step')}"""

ORACLE_SQL = {
    "rct_forward_inverse": f"""WITH {_PIX}, f AS (SELECT *, ((r + 2 * g + b) >> 2)::BIGINT AS y, (b - g)::BIGINT AS cb, (r - g)::BIGINT AS cr FROM px)
SELECT *, cr + y - ((cb + cr) >> 2) AS r2, y - ((cb + cr) >> 2) AS g2, cb + y - ((cb + cr) >> 2) AS b2 FROM f""",
    "ict_forward": f"""WITH {_PIX}, f AS (SELECT *, {_ICT[0]!r}::DOUBLE * r + {_ICT[1]!r}::DOUBLE * g + {_ICT[2]!r}::DOUBLE * b AS y0 FROM px),
h AS (SELECT r, g, b, round(y0)::BIGINT AS y, round((b - y0) / (2 * (1 - 0.114::DOUBLE)))::BIGINT AS cb, round((r - y0) / (2 * (1 - 0.299::DOUBLE)))::BIGINT AS cr FROM f)
SELECT *, round(y + 2 * (1 - 0.299::DOUBLE) * cr)::BIGINT AS r2,
  round(y - 2 * 0.299::DOUBLE * (1 - 0.299::DOUBLE) / {_ICT[1]!r}::DOUBLE * cr - 2 * 0.114::DOUBLE * (1 - 0.114::DOUBLE) / {_ICT[1]!r}::DOUBLE * cb)::BIGINT AS g2,
  round(y + 2 * (1 - 0.114::DOUBLE) * cb)::BIGINT AS b2 FROM h""",
    "finalize_clamp": f"""WITH {_PIX}, f AS (SELECT *, trunc((r - 128) * 37.25::DOUBLE - g * 1.5::DOUBLE)::BIGINT AS x FROM px)
SELECT r, g, b, {_clamp('((x + 16) >> 5) + 128')}::BIGINT AS down, {_clamp('x * 4 + 2048', 4095)}::BIGINT AS up, {_clamp('(g * 40) >> 4')}::BIGINT AS byte, ((b - 128) * 32)::BIGINT AS centred FROM f""",
    "ycbcr_fixed_rgb": f"WITH {_PIX} SELECT r, g, b, {_fixed('BT709', '7')}, {_fixed('BT601', '6')} FROM px",
    "matrix_select": f"""WITH {_PIX}, m AS (SELECT *, CASE r % 11 WHEN 0 THEN 'RGB' WHEN 1 THEN 'BT709' WHEN 5 THEN 'BT601' WHEN 6 THEN 'BT601' WHEN 9 THEN 'BT2020' ELSE 'none' END AS matrix FROM px)
SELECT r, g, b, matrix, {_narrow(0)}, {_narrow(1)}, {_narrow(2)} FROM m""",
    "chroma_upsample_nn": "SELECT vec_id, x.range AS x, trunc(embedding[x.range + 1]::DOUBLE * 1024)::BIGINT AS luma, trunc(embedding[x.range * 32 // 64 + 1]::DOUBLE * 1024)::BIGINT AS chroma FROM embeddings, range(64) x",
    "dwt53_forward": f"WITH {_VEC}, d AS ({_lift('s', 1, _D53)}) {_lift('d', 0, _S53)}",
    "dwt97_forward": f"""WITH {_VEC}, s0 AS (SELECT vec_id, x, v::DOUBLE AS v FROM s), a AS ({_lift('s0', 1, f'{transform.A97!r}::DOUBLE * ({{a}} + {{b}})')}),
b AS ({_lift('a', 0, f'{transform.B97!r}::DOUBLE * ({{a}} + {{b}})')}), c AS ({_lift('b', 1, f'{transform.C97!r}::DOUBLE * ({{a}} + {{b}})')}),
d AS ({_lift('c', 0, f'{transform.D97!r}::DOUBLE * ({{a}} + {{b}})')}) SELECT vec_id, x, round(v, 6) AS v FROM d""",
    "dwt53_roundtrip": "SELECT vec_id, 64 - vec_id % 20 AS n, true AS same FROM embeddings",
    "dwt53_2d": f"""WITH {_VEC}, p AS (SELECT vec_id, x // 8 AS y, x % 8 AS x, v FROM s), a AS ({_lift('p', 1, _D53, 'vec_id, x', 'y')}), b AS ({_lift('a', 0, _S53, 'vec_id, x', 'y')}),
c AS ({_lift('b', 1, _D53, 'vec_id, y', 'x')}), d AS ({_lift('c', 0, _S53, 'vec_id, y', 'x')})
SELECT vec_id, CASE WHEN y % 2 = 0 THEN 'L' ELSE 'H' END AS vert, * FROM d""".replace(
        "SELECT vec_id, CASE WHEN y % 2 = 0 THEN 'L' ELSE 'H' END AS vert, * FROM d",
        "SELECT vec_id, (CASE WHEN x % 2 = 0 THEN 'L' ELSE 'H' END) || (CASE WHEN y % 2 = 0 THEN 'L' ELSE 'H' END) AS band, y // 2 AS y, x // 2 AS x, v FROM d",
    ),
    "dwt53_2d_roundtrip": "SELECT vec_id, 8::BIGINT AS lines, true AS same FROM embeddings",
    "tagtree_min": f"""WITH {_VEC}, p AS (SELECT vec_id, x // 8 AS y, x % 8 AS x, v FROM s)
SELECT vec_id, k.range AS k, x >> k.range AS x, y >> k.range AS y, min(v) AS v FROM p, range(4) k GROUP BY vec_id, k.range, x >> k.range, y >> k.range""",
    "quantize_deadzone": f"""WITH {_PIX}, f AS (SELECT r, g, b, trunc((r * 3.75::DOUBLE - g * 2.5::DOUBLE) / (0.5 + b % 16 * 0.25::DOUBLE))::BIGINT AS q FROM px)
SELECT *, CASE WHEN q = 0 THEN 0 ELSE (abs(q) - 1) * 2 + (q < 0)::INT - 2147483648 END::BIGINT AS coded FROM f""",
    "dequantize_midpoint": f"""WITH {_PIX}, f AS (SELECT r, g, b, 0.5 + b % 16 * 0.25::DOUBLE AS st, trunc((r * 3.75::DOUBLE - g * 2.5::DOUBLE) / (0.5 + b % 16 * 0.25::DOUBLE)) AS q FROM px)
SELECT r, g, b, round(CASE WHEN q > 0 THEN (q + 0.5) * st WHEN q < 0 THEN (q - 0.5) * st ELSE 0 END, 6) AS x FROM f""",
    "magnitude_bits": """WITH o AS (SELECT p_size, bit_or(p_partkey * 37 % 4093) AS any_bit FROM part GROUP BY p_size)
SELECT p_size, any_bit, CASE WHEN any_bit = 0 THEN 0 ELSE floor(log2(any_bit))::BIGINT + 1 END AS bits FROM o""",
    "pq_hlg_pipeline": f"""WITH {_CRV}, l AS (SELECT *, {_HLG.format(e='e')} AS lr, {_HLG.format(e='f')} AS lg, {_HLG.format(e='0.25::DOUBLE')} AS lb FROM cv)
SELECT a, b, round({_PQ.format(e='e')}, 9) AS pq, round({_TO_PQ.format(e='e')}, 9) AS to_pq, round(lr, 9) AS hlg, {_shown('(1.660491::DOUBLE * lr - 0.587641::DOUBLE * lg - 0.072850::DOUBLE * lb)')} AS r,
  {_shown('(-0.124550::DOUBLE * lr + 1.132900::DOUBLE * lg - 0.008350::DOUBLE * lb)')} AS g, {_shown('(-0.018151::DOUBLE * lr - 0.100579::DOUBLE * lg + 1.118730::DOUBLE * lb)')} AS z FROM l""",
    "tonemap_bt2390": f"""WITH {_CRV}, {_tone_sql('e', 'tr').format(src='cv')}, {_tone_sql('f', 'tg').format(src='tr')}, {_tone_sql('0.5::DOUBLE', 'tz').format(src='tg')}
SELECT a, b, round({_SRGB.format(e='tr_v')}, 7) AS r, round({_SRGB.format(e='tg_v')}, 7) AS g, round({_SRGB.format(e='tz_v')}, 7) AS z FROM tz""",
    "quant_step_pack": f"""WITH st AS (SELECT p_partkey, pow(0.97::DOUBLE, p_partkey % 700) * 0.999::DOUBLE AS step FROM part), {_packed('st')}
SELECT p_partkey, eps, mu, round(pow(2::DOUBLE, -eps) * (1 + mu / 2048.0::DOUBLE), 12) AS back FROM pk""",
    "qfactor_curve": f"""WITH p AS (SELECT p_partkey, 1 + p_partkey % 100 AS q FROM part), s AS (SELECT *, {_Q_SQL} FROM p)
SELECT p_partkey, q, round({_SCALE}, 9) AS scale, round(power, 9) AS power FROM s""",
    "qfactor_bands": f"""{_WORDS_SQL}, w AS (SELECT q, component, band::BIGINT AS band, eps * 2048 + mu AS word FROM pk)
SELECT p_partkey, component, band, word FROM part JOIN w ON w.q = 1 + p_partkey % 100""",
    "qfactor_estimate": f"""WITH {_BANDS_SQL}, qs AS (SELECT i AS q FROM range(1, 101) t(i)), s AS (SELECT *, {_Q_SQL} FROM qs), qb AS (SELECT * FROM s, bd WHERE component = 'Y'),
{_STEPS_SQL.format(s=_SCALE)}, {_packed('step')}, w AS (SELECT q, band, eps, mu FROM pk),
o AS (SELECT p_partkey, 1 + p_partkey % 99 AS made_with, band, eps, CASE WHEN p_partkey % 4 = 3 THEN (mu + 300 * (band % 3)) % 2048 ELSE mu END AS mu FROM part JOIN w ON w.q = 1 + p_partkey % 99),
d AS (SELECT p_partkey, made_with, w.q, round(sum(pow(log2(pow(2::DOUBLE, -o.eps) * (1 + o.mu / 2048.0::DOUBLE)) - log2(pow(2::DOUBLE, -w.eps) * (1 + w.mu / 2048.0::DOUBLE)), 2)), 9) AS residual
  FROM o JOIN w ON w.band = o.band GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY residual, q) AS n FROM d)
SELECT p_partkey, made_with, q, round(residual, 6) AS residual, CASE WHEN sqrt(residual / 16) <= 0.05 THEN 'exact' WHEN sqrt(residual / 16) <= 0.25 THEN 'near' ELSE 'other' END AS verdict FROM r WHERE n = 1""",
}
