"""Decomposition over several levels with origins, directions and kernels from headers, against sample by sample versions."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import synthesis as S
from tessera.sources import codestream, segments
from tests.test_codestreams import cdiv


def lift(values, first, steps, reversible):
    """Lifts a list of samples whose first is at `first`."""
    v = [float(x) for x in values]
    if len(v) == 1:
        return [v[0] * 2] if reversible and first % 2 else v
    for parity, a, sign, add, shift in steps:
        old = list(v)
        for k in range(len(v)):
            if (k + first) % 2 == parity:
                total = old[k - 1 if k > 0 else k + 1] + old[k + 1 if k < len(v) - 1 else k - 1]
                v[k] = old[k] + (sign * ((a * total + add) // 2**shift) if reversible else a * total)
    return v


def decompose(plane, x0, y0, directions, steps, reversible):
    """{(level, band): {y: (x0, row)}} of a plane (an array) at an origin."""
    out, now, level = {}, {y0 + i: (x0, list(map(float, r))) for i, r in enumerate(plane)}, 0
    for d in directions:
        level += 1
        ys = sorted(now)
        if d in (S.BOTH, S.DOWN):
            columns = [lift(c, ys[0], steps, reversible) for c in zip(*(now[y][1] for y in ys))]
            now = {y: (now[y][0], list(r)) for y, r in zip(ys, zip(*columns))}
        if d in (S.BOTH, S.ALONG):
            now = {y: (x, lift(r, x, steps, reversible)) for y, (x, r) in now.items()}
        split = {}
        for y, (x, r) in now.items():
            vertical = y % 2 if d in (S.BOTH, S.DOWN) else 0
            to = y // 2 if d in (S.BOTH, S.DOWN) else y
            for odd in (0, 1) if d in (S.BOTH, S.ALONG) else (None,):
                band = ("HH" if odd else "LH") if vertical else ("HL" if odd else "LL")
                picked = r if odd is None else [e for k, e in enumerate(r) if (k + x) % 2 == odd]
                if picked:
                    split.setdefault(band, {})[to] = (x if odd is None else (x // 2 if odd else cdiv(x, 2)), picked)
        for band, lines in split.items():
            if band != "LL":
                out[level, band] = lines
        now = split.get("LL", {})
        if not now:
            return out
    out[level, "LL"] = now
    return out


CASES = [  # name, directions, origin, size
    ("5/3", [1, 1, 1], (0, 0), (23, 17)), ("9/7", [1, 1], (3, 5), (16, 150)), ("5/3-real", [1, 2, 2], (7, 1), (30, 9)), ("5/3", [1, 2, 3, 0], (5, 2), (41, 37)),
    ("9/7", [3, 2], (1, 1), (8, 9)), ("5/3", [1], (3, 3), (1, 1)), ("5/3", [1, 1, 1, 1], (9, 6), (5, 3)), ("9/7", [], (2, 2), (4, 4)), ("5/3", [2, 2], (1, 0), (12, 1)), ("5/3", [1, 1], (4, 64), (11, 131)),
]


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(4)
    arrays = [rng.integers(-500, 500, (h, w)) for _, _, _, (w, h) in CASES]
    lines = [(i, y0 + k, x0, [float(v) for v in r]) for i, (_, _, (x0, y0), _) in enumerate(CASES) for k, r in enumerate(arrays[i])]
    table = spark.createDataFrame(lines, "image long, y long, x0 long, row array<double>").repartition(4)
    comps = [(i, x0, x0 + w, y0, y0 + h, d, name == "5/3", [S_ for S_ in S.KERNELS[name]]) for i, (name, d, (x0, y0), (w, h)) in enumerate(CASES)]
    of = spark.createDataFrame(comps, f"image long, x0 long, x1 long, y0 long, y1 long, directions array<int>, reversible boolean, steps array<{S.STEP}>")
    levels = S.planes(of, ["image"]).persist()
    bands = S.analyse(table, levels, ["image"], 4).persist()
    return arrays, table, levels, bands


def test_levels_and_bands(world):
    arrays, _, levels, bands = world
    got = {}
    for r in bands.collect():
        got.setdefault(r["image"], {}).setdefault((r["level"], r["band"]), {})[r["y"]] = (r["x0"], r["row"])
    rects = {(r["image"], r["level"]): (r["u0"], r["u1"], r["v0"], r["v1"]) for r in levels.collect()}
    for i, (name, directions, (x0, y0), (w, h)) in enumerate(CASES):
        want = decompose(arrays[i], x0, y0, directions, S.KERNELS[name], name == "5/3")
        assert set(got[i]) == set(want), i
        for key, lines in want.items():
            assert {y: x for y, (x, _) in got[i][key].items()} == {y: x for y, (x, _) in lines.items()}, (i, key)
            for y, (_, row) in lines.items():
                assert np.allclose(got[i][key][y][1], row, rtol=1e-12, atol=1e-9), (i, key, y)
        for k in range(len(directions) + 1):
            across, down = (sum(d in (S.BOTH, one) for d in directions[:k]) for one in (S.ALONG, S.DOWN))
            assert rects[i, k] == (cdiv(x0, 1 << across), cdiv(x0 + w, 1 << across), cdiv(y0, 1 << down), cdiv(y0 + h, 1 << down))


def test_whole_planes_come_back(world):
    arrays, _, levels, bands = world
    got = {(r["image"], r["y"]): (r["x0"], r["row"]) for r in S.synthesise(bands, levels, ["image"], 4).collect()}
    assert len(got) == sum(len(a) for a in arrays)
    for i, (name, _, (x0, y0), _) in enumerate(CASES):
        for k, r in enumerate(arrays[i]):
            assert got[i, y0 + k][0] == x0 and np.allclose(got[i, y0 + k][1], r, atol=0 if name == "5/3" else 1e-8), (i, k)


def test_regions(spark, world):
    """Windows at edges, inside and empty: byte for byte what the whole plane has there."""
    arrays, _, levels, bands = world
    rng = random.Random(3)
    asked = []
    for i, (_, _, (x0, y0), (w, h)) in enumerate(CASES[:-1]):
        xs, ys = (sorted(rng.sample(range(a - 2, a + n + 3), 2)) for a, n in ((x0, w), (y0, h)))
        asked.append((i, *xs, *ys))
    asked[1] = (1, 7, 9, 61, 77)
    regions = spark.createDataFrame(asked, "image long, x_from long, x_to long, y_from long, y_to long")
    got = {(r["image"], r["y"]): (r["x0"], r["row"]) for r in S.synthesise(bands, levels, ["image"], 4, regions).filter(F.size("row") > 0).collect()}
    want = {}
    for i, xa, xb, ya, yb in asked:
        name, _, (x0, y0), (w, h) = CASES[i]
        for y in range(max(ya, y0), min(yb, y0 + h)):
            if max(xa, x0) < min(xb, x0 + w):
                want[i, y] = (max(xa, x0), arrays[i][y - y0][max(xa, x0) - x0 : min(xb, x0 + w) - x0])
    assert set(got) == set(want)
    for key, (x, row) in want.items():
        assert got[key][0] == x and np.allclose(got[key][1], row, atol=0 if CASES[key[0]][0] == "5/3" else 1e-8), key


def test_regions_need_few_lines(spark, world):
    _, _, levels, _ = world
    regions = spark.createDataFrame([(9, 4, 6, 100, 102)], "image long, x_from long, x_to long, y_from long, y_to long")
    got = {r["level"]: (r["xa"], r["xb"], r["ya"], r["yb"]) for r in S.wanted(levels, regions, ["image"], 4).collect()}
    assert got == {0: (4, 6, 100, 102), 1: (2, 5, 49, 53), 2: (1, 4, 23, 29)}


def test_safe_reduction(spark):
    rows = [([1, 1, 2, 1],), ([1, 1],), ([2],), ([],), ([0, 1],)]
    got = spark.createDataFrame(rows, "d array<int>").select(S.safe_reduction(F.col("d"))).collect()
    assert [r[0] for r in got] == [2, 2, 0, 0, 0]


def test_kernels_and_styles_from_headers(spark):
    """Single-precision numbers bit by bit, steps turned from synthesis to analysis order, styles of up to 32 levels."""
    values = [0.0, -0.0, 1.0, -1.586134342, 3.4e38, 1.2e-40, 0.443506852, 1 / 3, -65504.5]
    raw = b"".join(struct.pack(">f", v) for v in values)
    at = spark.createDataFrame([(raw,)], "p binary").select(*[codestream.float32(F.col("p"), 4 * i).alias(f"v{i}") for i in range(len(values))]).first()
    assert list(at) == [struct.unpack(">f", struct.pack(">f", v))[0] for v in values]
    odd = spark.createDataFrame([(struct.pack(">f", float("inf")),)], "p binary").select(codestream.float32(F.col("p"), 0)).first()[0]
    assert odd is None
    kernel = b"\x00\x03" + struct.pack(">f", 1.5) + b"\x03" + b"".join(b"\x01" + struct.pack(">f", v) for v in (0.5, -0.25, 2.0))
    whole = b"\x10\x04\x02" + b"\x00" * 10
    rows = spark.createDataFrame([(0, kernel), (1, whole)], "i int, p binary").select("i", codestream.atk(F.col("p")).alias("k")).orderBy("i").collect()
    assert [(s["parity"], s["a"]) for s in rows[0]["k"]["steps"]] == [(1, 2.0), (0, -0.25), (1, 0.5)]
    assert (rows[0]["k"]["index"], rows[0]["k"]["k"], rows[0]["k"]["reversible"]) == (3, 1.5, False)
    assert (rows[1]["k"]["index"], rows[1]["k"]["k"], rows[1]["k"]["reversible"], rows[1]["k"]["steps"]) == (4, None, True, None)
    rng = random.Random(2)
    for n in (0, 1, 4, 5, 32, 33):
        want = [rng.randrange(4) for _ in range(n)]
        packed = bytes(sum(v << 6 - 2 * k for k, v in enumerate(want[a : a + 4])) for a in range(0, n, 4))
        got = spark.createDataFrame([(b"\x00\x07" + bytes([n]) + packed,)], "p binary").select(codestream.dfs(F.col("p")).alias("d")).first()["d"]
        assert got["index"] == 7 and got["directions"] == (want if n <= 32 else None)
        if n:
            written = spark.createDataFrame([(want,)], "d array<int>").select(F.unhex(segments.dfs(7, F.col("d")))).first()[0]
            assert bytes(written) == b"\xff\x72" + (5 + len(packed)).to_bytes(2, "big") + b"\x00\x07" + bytes([n]) + packed
