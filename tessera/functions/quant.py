"""Quantiser steps: packing, visual weights, steps per subband, and the quality factor that explains given steps."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Synthesis filters of the 5/3 and 9/7 transforms.
L53 = [-0.125, 0.25, 0.75, 0.25, -0.125]
H53 = [-0.5, 1.0, -0.5]
L97 = [-0.091271763114250, -0.057543526228500, 0.591271763114250, 1.115087052457000, 0.5912717631142500, -0.05754352622850, -0.091271763114250]
H97 = [0.053497514821622, 0.033728236885750, -0.156446533057980, -0.533728236885750, 1.205898036472720, -0.533728236885750, -0.156446533057980, 0.033728236885750, 0.053497514821622]

# Visual weights of the tabled model, finest level first, HH LH HL a level; Y, then Cb and Cr by chroma format.
WEIGHTS = {
    ("Y", "444"): [0.0901, 0.2758, 0.2758, 0.7018, 0.8378, 0.8378, 1, 1, 1, 1, 1, 1, 1, 1, 1],
    ("Cb", "444"): [0.0263, 0.0863, 0.0863, 0.1362, 0.2564, 0.2564, 0.3346, 0.4691, 0.4691, 0.5444, 0.6523, 0.6523, 0.7078, 0.7797, 0.7797],
    ("Cr", "444"): [0.0773, 0.1835, 0.1835, 0.2598, 0.4130, 0.4130, 0.5040, 0.6464, 0.6464, 0.7220, 0.8254, 0.8254, 0.8769, 0.9424, 0.9424],
    ("Cb", "420"): [0.1362, 0.2564, 0.2564, 0.3346, 0.4691, 0.4691, 0.5444, 0.6523, 0.6523, 0.7078, 0.7797, 0.7797, 1, 1, 1],
    ("Cr", "420"): [0.2598, 0.4130, 0.4130, 0.5040, 0.6464, 0.6464, 0.7220, 0.8254, 0.8254, 0.8769, 0.9424, 0.9424, 1, 1, 1],
    ("Cb", "422"): [0.0863, 0.0863, 0.2564, 0.2564, 0.2564, 0.4691, 0.4691, 0.4691, 0.6523, 0.6523, 0.6523, 0.7797, 0.7797, 0.7797, 1],
    ("Cr", "422"): [0.1835, 0.1835, 0.4130, 0.4130, 0.4130, 0.6464, 0.6464, 0.6464, 0.8254, 0.8254, 0.8254, 0.9424, 0.9424, 0.9424, 1],
}
# Gains of the colour transform's components.
GAINS = {"Y": 1.7321, "Cb": 1.8051, "Cr": 1.5734}
# Roll-off of the chroma sensitivity curves.
CHROMA_CURVE = {"Cb": (0.1173, 0.840), "Cr": (0.0699, 1.050)}
# Quality factors between which visual weights fade out, and the scale at either.
T0, T1, ALPHA_T0, ALPHA_T1 = 65, 97, 0.04, 0.10


def pack_step(step: Column) -> Column:
    """struct<eps, mu>: step = 2**-eps * (1 + mu / 2048), rounded, within 5 and 11 bits."""
    e = F.greatest(F.ceil(-F.log2(step) - 1e-12), F.lit(0)).cast("int")
    # the logarithm may be off by one next to a power of two
    e = F.when(step * F.pow(F.lit(2.0), e) < 1.0, e + 1).when((e > 0) & (step * F.pow(F.lit(2.0), e - 1) >= 1.0), e - 1).otherwise(e)
    m = F.floor((step * F.pow(F.lit(2.0), e) - 1.0) * 2048 + 0.5).cast("int")
    eps = F.when(m >= 2048, e - 1).otherwise(e)
    mu = F.when(m >= 2048, 0).otherwise(m)
    return F.struct(
        F.when(eps > 31, 31).when(eps < 0, 0).otherwise(eps).alias("eps"),
        F.when(eps > 31, 0).when(eps < 0, 2047).otherwise(mu).alias("mu"),
    )


def unpack_step(eps: Column, mu: Column) -> Column:
    return F.pow(F.lit(2.0), -eps) * (1 + mu / 2048.0)


def q_scale(q: Column, depth: int) -> tuple[Column, Column]:
    """Reference step and exponent of the visual weights for a quality factor of 1 to 100; null for others."""
    m_q = F.when(q < 50, 50.0 / q).otherwise(2.0 * (1.0 - q / 100.0))
    m0, m1 = 2.0 * (1.0 - T0 / 100.0), 2.0 * (1.0 - T1 / 100.0)
    fade = (math.log(m1) - F.log(m_q)) / (math.log(m1) - math.log(m0))
    power = F.when(q >= T1, 0.0).when(q > T0, fade).otherwise(1.0)
    alpha = F.when(q >= T1, ALPHA_T1).when(q > T0, ALPHA_T1 * F.pow(F.lit(ALPHA_T0 / ALPHA_T1), power)).otherwise(ALPHA_T0)
    ok = (q >= 1) & (q <= 100)
    return F.when(ok, alpha * m_q + math.sqrt(0.5) * 2.0**-depth), F.when(ok, power)


def mannos_sakrison(f: Column) -> Column:
    return 2.6 * (0.0192 + 0.114 * f) * F.exp(-F.pow(0.114 * f, F.lit(1.1)))


def daly(f: Column, luminance: float = 100.0, eps: float = 0.9) -> Column:
    a, b = 0.801 * (1 + 0.7 / luminance) ** -0.2, 0.3 * (1 + 100 / luminance) ** 0.15
    x = b * eps * f
    return a * eps * f * F.exp(-x) * F.sqrt(1 + 0.06 * F.exp(x))


def _peak(curve) -> tuple[float, float]:
    """Where a curve of one peak between 0 and 100 is highest, and how high: golden-section search on plain numbers."""
    lo, hi, g = 0.0, 100.0, (math.sqrt(5) - 1) / 2
    while hi - lo > 1e-9:
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if curve(a) > curve(b) else (a, hi)
    return lo, curve(lo)


def _plain(model: str, f: float) -> float:
    if model == "mannos":
        return 2.6 * (0.0192 + 0.114 * f) * math.exp(-((0.114 * f) ** 1.1))
    a, b = 0.801 * (1 + 0.7 / 100.0) ** -0.2, 0.3 * (1 + 100 / 100.0) ** 0.15
    x = b * 0.9 * f
    return a * 0.9 * f * math.exp(-x) * math.sqrt(1 + 0.06 * math.exp(x))


def luma_weight(f: Column, model: str) -> Column:
    """Sensitivity at a frequency as a part of the model's greatest, 1 up to where that is; null where it is too small for
    a number."""
    peak, top = _peak(lambda x: _plain(model, x))
    w = {"mannos": mannos_sakrison, "daly": daly}[model](f) / top
    return F.when(f <= peak, 1.0).when(w > 0, w)


def band_frequencies(level: Column, sx: float = 1.0, sy: float = 1.0, per_degree: float = 72.0, zoom: float = 1.0) -> dict[str, Column]:
    """Cycles a degree in the middle of each band of a level (1: finest) of a component sampled every sx by sy: half the
    samples a degree, halved with each level, at the octave's geometric mean."""
    middle = F.pow(F.lit(2.0), 0.5 - level) * (per_degree / zoom / 2)
    x, y = middle / sx, middle / sy
    return {"HH": F.sqrt(x * x + y * y), "LH": y, "HL": x}


def chroma_weight(f: Column, component: str) -> Column:
    a, b = CHROMA_CURVE[component]
    return F.greatest(F.exp(-F.pow(a * f, F.lit(b))), F.lit(1e-300))


def band_gains(levels: int, reversible: bool) -> list[float]:
    """Gains of the bands HH LH HL a level, finest first, then LL: energy of the synthesis filters, or their largest
    output if reversible. The filters of a level are those of the one before, spread and convolved with the low-pass one."""
    low, high = (L53, H53) if reversible else (L97, H97)
    norm = (lambda v: float(np.abs(v).sum())) if reversible else (lambda v: float((v * v).sum()))
    now_low, now_high, out, g = np.array(low), np.array(high), [], 1.0
    for _ in range(levels):
        g, h = norm(now_low), norm(now_high)
        out += [h * h, g * h, h * g]
        spread = lambda v: np.ravel(np.column_stack([v, np.zeros(len(v))]))
        now_low, now_high = np.convolve(low, spread(now_low)), np.convolve(low, spread(now_high))
    return [*out, g * g] if levels else [1.0]


def bands(spark: SparkSession, levels: int, component: str = "Y", chroma_format: str = "444", reversible: bool = False) -> DataFrame:
    """One row per band in marker order (LL first): band, gain, weight. 3 * levels + 1 rows."""
    gain = band_gains(levels, reversible)
    weight = WEIGHTS[component, "444" if component == "Y" else chroma_format]
    rows = [(len(gain) - 1 - i, g, float(weight[i]) if i < min(len(weight), len(gain) - 1) else 1.0) for i, g in enumerate(gain)]
    return spark.createDataFrame(rows, "band int, gain double, weight double")


def steps(rows: DataFrame, q: str, component: str, depth: int) -> DataFrame:
    """Adds step, eps, mu and word to rows of (quality factor, gain, weight)."""
    scale, power = q_scale(F.col(q), depth)
    delta = scale * GAINS["Y"] / (F.sqrt("gain") * F.pow("weight", power) * GAINS[component])
    packed = rows.withColumn("step", delta).withColumn("_p", pack_step(F.col("step")))
    return packed.select(*rows.columns, "step", "_p.eps", "_p.mu", (F.col("_p.eps") * 2048 + F.col("_p.mu")).alias("word"))


def reversible_exponents(rows: DataFrame, depth: int, guard_bits: int, colour: bool) -> DataFrame:
    """Adds eps of a lossless band: bits of the samples less the guard bits, and one for every halving of the gain to 0.9."""
    more = F.greatest(F.ceil(F.log2(F.col("gain") / 0.9)), F.lit(0)).cast("int")
    return rows.withColumn("eps", F.lit(depth - guard_bits + int(colour)) + more)


def estimate_q(observed: DataFrame, by: list[str], component: str, depth: int, levels: int, chroma_format: str = "444") -> DataFrame:
    """by..., q, residual, per_band, verdict: the factor from 1 to 100 whose steps are nearest, by squared log ratios.

    observed: by..., band, eps, mu. The least factor wins a tie. verdict: exact up to 0.05 per band, near up to 0.25, else other.
    """
    spark = observed.sparkSession
    # 100 factors a band at most, 97 bands: a table of fixed size, which goes into the plan as a constant
    model = steps(bands(spark, levels, component, chroma_format).withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(100)))), "q", component, depth)
    rows = model.select("q", "band", F.log2(unpack_step(F.col("eps"), F.col("mu"))).alias("want")).orderBy("q", "band").collect()
    count = len(rows) // 100
    table = json.dumps([[r["want"] for r in rows[i * count : (i + 1) * count]] for i in range(100)])
    want = F.from_json(F.lit(table), "array<array<double>>")
    have = F.struct("band", F.log2(unpack_step(F.col("eps"), F.col("mu"))).alias("have"))
    seen = observed.filter((F.col("band") >= 0) & (F.col("band") < count)).groupBy(*by).agg(F.sort_array(F.collect_list(have)).alias("_b"))

    def residual(w: Column) -> Column:
        return F.round(F.aggregate("_b", F.lit(0.0), lambda s, x: s + F.pow(x["have"] - F.get(w, x["band"]), F.lit(2))), 9)

    each = F.transform(want, lambda w, i: F.struct(residual(w).alias("residual"), (i + 1).alias("q")))
    best = seen.select(*by, F.array_min(each).alias("b"), F.size("_b").alias("n")).select(*by, "b.q", "b.residual", "n")
    per_band = F.sqrt(F.col("residual") / F.col("n"))
    verdict = F.when(per_band <= 0.05, "exact").when(per_band <= 0.25, "near").otherwise("other")
    return best.select(*by, "q", "residual", per_band.alias("per_band"), verdict.alias("verdict"))


def quantize(x: Column, step: Column) -> Column:
    """Truncated quotient: the dead zone about zero is two steps wide."""
    return (x / step).cast("int")


def sign_magnitude(v: Column) -> Column:
    """A coefficient as the block coder takes it: (|v| - 1) * 2 + sign with a set top bit, 0 for 0."""
    return F.when(v == 0, 0).otherwise(((F.abs(v) - 1) * 2 + F.when(v < 0, 1).otherwise(0)).bitwiseOR(F.lit(-(1 << 31))))


def dequantize(v: Column, step: Column, reconstruct: float = 0.5) -> Column:
    """Middle of a coefficient's interval; 0 stays 0."""
    return F.when(v > 0, (v + reconstruct) * step).when(v < 0, (v - reconstruct) * step).otherwise(0.0)


def block_coefficient(bits31: Column, negative: Column, missing: Column, magnitude_bits: int, roi: int, reversible: bool, step: Column | None = None) -> Column:
    """A coefficient from the 31 bits of a decoded block, whose upper magnitude_bits are the band's.

    Of a region-of-interest shift `roi`, what lies below the band's bits is background and is shifted up again; no planes
    count as missing then. A value other than 0 with missing planes gets the middle of what they could hold. Reversible: the
    whole part. Else: the middle of the interval in any case, rounded to 16 bits, times the step with 13 fraction bits.
    """
    below = 31 - magnitude_bits
    v = bits31.cast("bigint")
    if roi:
        v = F.when(v < 1 << below, F.shiftleft(v, roi)).otherwise(v)
        missing = F.lit(0)
    one = F.lit(1).cast("bigint")
    if reversible:
        middle = F.when(missing > 0, one * F.pow(F.lit(2.0), F.lit(below - 1) + missing).cast("bigint")).otherwise(0)
        whole = F.shiftright(F.when(v != 0, v.bitwiseOR(middle)).otherwise(v), below)
    else:
        middle = F.pow(F.lit(2.0), F.lit(below - 1) + F.greatest(missing, F.lit(0))).cast("bigint")
        v = F.when(v != 0, v.bitwiseOR(middle)).otherwise(v)
        scale = F.floor(step * F.pow(F.lit(2.0), F.lit(13 - below + 31)) + 0.5).cast("bigint")
        whole = F.shiftright(F.shiftright(v + (1 << 15), 16) * scale + (1 << 14), 15)
    return F.when(negative, -whole).otherwise(whole)


def block_coefficient_ht(bits31: Column, negative: Column, magnitude_bits: int, reversible: bool, step: Column | None = None, roi: int = 0) -> Column:
    """The same for a high-throughput block: no middle is added. Lossy values are a real product of the bits, the step and 13
    fraction bits; with a region of interest, they are rounded to 16 bits first, and so is the product, as a whole number."""
    below = 31 - magnitude_bits
    v = bits31.cast("bigint")
    if roi:
        v = F.when(v < 1 << below, F.shiftleft(v, roi)).otherwise(v)
    if reversible:
        out = F.shiftright(v, below)
    elif roi:
        scale = F.floor(step * F.pow(F.lit(2.0), F.lit(13 - below + 31)) + 0.5).cast("bigint")
        out = F.shiftright(F.shiftright(v + (1 << 15), 16) * scale + (1 << 14), 15)
    else:
        out = v * step * 2.0 ** (13 - below)
    return F.when(negative, -out).otherwise(out)


def roi_unshift(v: Column, shift: Column, magnitude_bits: Column) -> Column:
    """Undoes the max-shift of a region of interest: magnitudes over the band's bits were shifted up."""
    big = F.abs(v) >= F.pow(F.lit(2.0), magnitude_bits)
    down = F.floor(F.abs(v) / F.pow(F.lit(2.0), shift)) * F.signum(v)
    return F.when(big, down.cast("bigint")).otherwise(v)
