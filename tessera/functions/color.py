"""Colour and sample arithmetic as column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the irreversible colour transform.
ALPHA_R, ALPHA_B = 0.299, 0.114
ALPHA_G = 1 - ALPHA_R - ALPHA_B

# YCbCr to RGB factors times 2**14, for full range: cr_to_r, cb_to_g, cr_to_g, cb_to_b.
FIXED_MATRICES = {"BT601": (22970, 5639, 11701, 29032), "BT709": (25802, 3069, 7668, 30394)}

# The same factors as real numbers, by matrix and range.
MATRICES = {
    ("BT601", "full"): (1.402, 0.344136, 0.714136, 1.772),
    ("BT709", "full"): (1.5748, 0.1873, 0.4681, 1.8556),
    ("BT601", "narrow"): (1.596, 0.391, 0.813, 2.017),
    ("BT709", "narrow"): (1.793, 0.213, 0.533, 2.112),
    ("BT2020", "full"): (1.4746, 0.16455313, 0.57135314, 1.8814),
    ("BT2020", "narrow"): (1.67861, 0.18732, 0.65026, 2.14179),
}

# Constants of the PQ curve, the HLG curve and the BT.2020 to BT.709 matrix by rows.
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 0.1593017578125, 78.84375, 0.8359375, 18.8515625, 18.6875
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073
BT2020_TO_BT709 = ((1.660491, -0.587641, -0.072850), (-0.124550, 1.132900, -0.008350), (-0.018151, -0.100579, 1.118730))
#: Peak of the display that tone mapping aims at, as a part of 10 000 nits.
DISPLAY_PEAK = 203.0 / 10000.0


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rct_forward(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(r + 2 * g + b, 2), b - g, r - g


def rct_inverse(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    g = y - F.shiftright(cb + cr, 2)
    return cr + g, g, cb + g


def ict_forward(r: Column, g: Column, b: Column, rounded: bool = True) -> tuple[Column, Column, Column]:
    y = ALPHA_R * r + ALPHA_G * g + ALPHA_B * b
    out = y, (b - y) / (2 * (1 - ALPHA_B)), (r - y) / (2 * (1 - ALPHA_R))
    return tuple(F.round(x).cast("int") for x in out) if rounded else out


def ict_inverse(y: Column, cb: Column, cr: Column, rounded: bool = True) -> tuple[Column, Column, Column]:
    r = y + 2 * (1 - ALPHA_R) * cr
    g = y - 2 * ALPHA_R * (1 - ALPHA_R) / ALPHA_G * cr - 2 * ALPHA_B * (1 - ALPHA_B) / ALPHA_G * cb
    b = y + 2 * (1 - ALPHA_B) * cb
    return tuple(F.round(x).cast("int") for x in (r, g, b)) if rounded else (r, g, b)


def finalize(x: Column, down_shift: int, dc: int, low: int, high: int) -> Column:
    """Truncated, shifted down with rounding (or up), moved by the DC level and clamped."""
    whole = x.cast("int")
    if down_shift > 0:
        whole = F.shiftright(whole + (1 << (down_shift - 1)), down_shift)
    elif down_shift < 0:
        whole = F.shiftleft(whole, -down_shift)
    return clamp(whole + dc, low, high)


def dc_shift(x: Column, depth: int, signed: bool, fraction_bits: int = 13) -> Column:
    """Moves unsigned samples about zero and up to the pipeline's fraction bits."""
    moved = x if signed else x - (1 << (depth - 1))
    return F.shiftleft(moved, fraction_bits - depth) if fraction_bits >= depth else F.shiftright(moved, depth - fraction_bits)


def to_bytes(x: Column, down_shift: int) -> Column:
    """Plane samples to 8 bits: shifted down and clamped."""
    return clamp(F.shiftright(x, down_shift), 0, 255)


def to_words(x: Column) -> Column:
    return clamp(x, 0, 65535)


def ycbcr_fixed_rgb(y: Column, cb: Column, cr: Column, matrix: str, depth: int) -> tuple[Column, Column, Column]:
    """Integer conversion of full-range samples, with chroma about the middle of its range."""
    cr_r, cb_g, cr_g, cb_b = FIXED_MATRICES[matrix]
    b0, r0 = cb - (1 << (depth - 1)), cr - (1 << (depth - 1))
    top = (1 << depth) - 1
    return (
        clamp(y + F.shiftright(cr_r * r0 + 8192, 14), 0, top),
        clamp(y - F.shiftright(cb_g * b0 + cr_g * r0 + 8192, 14), 0, top),
        clamp(y + F.shiftright(cb_b * b0 + 8192, 14), 0, top),
    )


def ycbcr_rgb(y: Column, cb: Column, cr: Column, matrix: str, range_: str, depth: int) -> tuple[Column, Column, Column]:
    """Real conversion to 8 bits. Narrow range takes off the black level and stretches before its own factors apply. Samples
    are divided by their range, as the twin does: times its inverse, a value that lies on a half may come out below it."""
    cr_r, cb_g, cr_g, cb_b = MATRICES[matrix, range_]
    top, shift = float((1 << depth) - 1), depth - 8
    if range_ == "narrow":
        y0, ys, cs = float(16 << shift), float(219 << shift), float(224 << shift)
    else:
        y0, ys, cs = 0.0, top, top
    yn, bn, rn = (y - y0) / ys, (cb - float(1 << (depth - 1))) / cs, (cr - float(1 << (depth - 1))) / cs
    out = yn + cr_r * rn, yn - cb_g * bn - cr_g * rn, yn + cb_b * bn
    return tuple(F.floor(clamp(x, 0.0, 1.0) * 255.0 + 0.5).cast("int") for x in out)


def matrix_of(mat: Column) -> Column:
    """Name of the matrix with a code point; null for one that is not supported, RGB for 0."""
    return F.when(mat == 0, "RGB").when(mat == 1, "BT709").when(mat.isin(5, 6), "BT601").when(mat == 9, "BT2020")


def chroma_index(x: Column, chroma_width: Column, width: Column) -> Column:
    """The chroma sample that stands for a luma position: nearest, rounded down."""
    return F.floor(x * chroma_width / width).cast("bigint")


def upsampled(chroma: Column, width: Column) -> Column:
    """A row of chroma samples drawn out to a row's width: each luma position gets the one that stands for it."""
    at = lambda i: F.get(chroma, chroma_index(i, F.size(chroma), width).cast("int"))
    return F.transform(F.sequence(F.lit(0), width - 1), at)


def chroma_format(xr: Column, yr: Column) -> Column:
    return F.when((xr == 1) & (yr == 1), "444").when((xr == 2) & (yr == 1), "422").when((xr == 2) & (yr == 2), "420")


def pq_to_linear(e: Column) -> Column:
    v = F.pow(F.greatest(e, F.lit(0.0)), F.lit(1.0 / PQ_M2))
    den = PQ_C2 - PQ_C3 * v
    return F.when(den <= 0, F.lit(1.0)).otherwise(F.pow(F.greatest(v - PQ_C1, F.lit(0.0)) / den, F.lit(1.0 / PQ_M1)))


def linear_to_pq(x: Column) -> Column:
    v = F.pow(F.greatest(x, F.lit(0.0)), F.lit(PQ_M1))
    return F.pow((PQ_C1 + PQ_C2 * v) / (1.0 + PQ_C3 * v), F.lit(PQ_M2))


def hlg_to_linear(e: Column) -> Column:
    return F.when(e <= 0.5, e * e / 3.0).otherwise((F.exp((e - HLG_C) / HLG_A) + HLG_B) / 12.0)


def gamma22_to_linear(e: Column) -> Column:
    return F.pow(F.greatest(e, F.lit(0.0)), F.lit(2.2))


def linear_to_srgb(x: Column) -> Column:
    x = clamp(x, 0.0, 1.0)
    return F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1.0 / 2.4)) - 0.055)


def linear_to_gamma22(x: Column) -> Column:
    return F.pow(F.greatest(x, F.lit(0.0)), F.lit(1.0 / 2.2))


def gamut_2020_to_709(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    return tuple(row[0] * r + row[1] * g + row[2] * b for row in BT2020_TO_BT709)


def _pq(x: float) -> float:
    v = max(x, 0.0) ** PQ_M1
    return ((PQ_C1 + PQ_C2 * v) / (1 + PQ_C3 * v)) ** PQ_M2


def tone_map(x: Column, source_nits: float = 1000.0) -> Column:
    """Tone mapping of linear light (1 is 10 000 nits) to the display's range: below a knee the curve is the identity
    in PQ terms, above it a cubic that ends at the display's peak."""
    source = _pq(min(10000.0, max(250.0, source_nits)) / 10000.0)
    top = _pq(DISPLAY_PEAK) / source
    knee = 1.5 * top - 0.5
    e = F.least(linear_to_pq(x) / source, F.lit(1.0))
    t = (e - knee) / (1.0 - knee)
    cubic = (2 * t * t * t - 3 * t * t + 1) * knee + (t * t * t - 2 * t * t + t) * (1.0 - knee) + (3 * t * t - 2 * t * t * t) * top
    mapped = F.when(e >= knee, cubic).otherwise(e)
    return clamp(pq_to_linear(mapped * source) / DISPLAY_PEAK, 0.0, 1.0)


TO_LINEAR = {"pq": pq_to_linear, "hlg": hlg_to_linear, "gamma22": gamma22_to_linear}
TO_DISPLAY = {"srgb": linear_to_srgb, "gamma22": linear_to_gamma22, "linear": lambda x: x}


def display_pipeline(
    r: Column, g: Column, b: Column, transfer: str, wide_gamut: bool, bt2390: bool, display: str = "srgb", source_nits: float = 1000.0
) -> tuple[Column, ...]:
    """Non-linear R'G'B' in 0..1 to display values: to linear light, gamut, tone mapping or clamping, display curve."""
    light = tuple(TO_LINEAR[transfer](x) for x in (r, g, b))
    if wide_gamut:
        light = gamut_2020_to_709(*light)
    light = tuple(tone_map(x, source_nits) if bt2390 else clamp(x, 0.0, 1.0) for x in light)
    return tuple(TO_DISPLAY[display](x) for x in light)


def transfer_of(trans: Column) -> Column:
    """Curve by transfer code point: 16 is PQ, 18 is HLG, all else a plain gamma."""
    return F.when(trans == 16, "pq").when(trans == 18, "hlg").otherwise("gamma22")


def colour_choice(
    described: Column, trans: Column, prims: Column, transfer: str = "auto", fallback: str = "gamma22", wide_fallback: bool = False, wide_display: bool = False,
    display: str = "srgb", tonemap: str = "auto",
) -> Column:
    """What display_pipeline() is to do with a frame: transfer, wide_gamut, bt2390 and display.

    described: whether the frame describes its colours; trans and prims: its code points. Unless a transfer is asked for, a
    described frame's code point decides, and the fallback where that is unknown or the frame describes nothing. Primaries of
    code point 9 are wide, and are turned to those of a display that is not. Tone mapping is for absolute light only, so for PQ
    and unless clipping is asked for.
    """
    known = F.when(trans.isin(1, 6, 14, 15), "gamma22").when(trans == 16, "pq").when(trans == 18, "hlg")
    by_frame = F.coalesce(F.when(described, known), F.lit(fallback))
    curve = by_frame if transfer == "auto" else F.lit(transfer)
    wide = F.coalesce(F.when(described, F.coalesce(prims == 9, F.lit(False))), F.lit(wide_fallback))
    return F.struct(
        curve.alias("transfer"), (wide & F.lit(not wide_display)).alias("wide_gamut"), ((curve == "pq") & F.lit(tonemap != "clip")).alias("bt2390"), F.lit(display).alias("display")
    )
