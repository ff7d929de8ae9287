"""Codings by tile and component: which segment holds, the geometry that follows, and view windows over it, step by step."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry, viewport
from tessera.plans.common import GEOMETRY
from tessera.sources import codestream
from tests.test_round_two import cdiv

OWN = "image_id long, t long, c int, levels int, reversible boolean, precincts array<struct<ppx:int,ppy:int>>"
REQUESTS = "req_id long, image_id long, fx long, fy long, ox long, oy long, sx long, sy long, comps array<int>, round string"
MIXED = GEOMETRY.replace("struct<xr: int, yr: int>", "struct<xr: int, yr: int, levels: int, reversible: boolean, precincts: array<struct<ppx: int, ppy: int>>>")


def coding(rng):
    levels = rng.randint(0, 4)
    return {"levels": levels, "reversible": rng.random() < 0.5, "precincts": [{"ppx": rng.randint(3, 7), "ppy": rng.randint(3, 7)} for _ in range(levels + 1)]}


def random_images(rng, n):
    """Images with origins and tiles; some components, and some components of tiles, with codings of their own."""
    ims, own = [], {}
    for i in range(n):
        x0, y0, tx, ty = rng.randint(0, 90), rng.randint(0, 90), rng.randint(60, 300), rng.randint(60, 300)
        im = {
            "image_id": i, "xsiz": x0 + rng.randint(100, 500), "ysiz": y0 + rng.randint(100, 500), "xosiz": x0, "yosiz": y0, "xtsiz": tx, "ytsiz": ty,
            "xtosiz": rng.randint(max(0, x0 - tx + 1), x0), "ytosiz": rng.randint(max(0, y0 - ty + 1), y0), **coding(rng),
            "comps": [{"xr": 1, "yr": 1}, {"xr": 2, "yr": rng.choice([1, 2])}, {"xr": 1, "yr": 1}],
        }
        im = {k: im[k] for k in ("image_id", "xsiz", "ysiz", "xosiz", "yosiz", "xtsiz", "ytsiz", "xtosiz", "ytosiz", "levels", "reversible", "comps", "precincts")}
        for c in im["comps"]:
            c |= coding(rng) if rng.random() < 0.5 else {"levels": None, "reversible": None, "precincts": None}
        ims.append(im)
        tiles = cdiv(im["xsiz"] - im["xtosiz"], tx) * cdiv(im["ysiz"] - im["ytosiz"], ty)
        own |= {(i, t, c): coding(rng) for t in range(tiles) for c in range(3) if i % 3 and rng.random() < 0.3}
    return ims, own


def holds(im, own, t, c):
    if (im["image_id"], t, c) in own:
        return own[im["image_id"], t, c]
    comp = im["comps"][c]
    return comp if comp["levels"] is not None else im


def brute_cells(im, own):
    """Every precinct of every tile's component: its key, and what it covers of the resolution."""
    tiles = {a: cdiv(im[f"{a}siz"] - im[f"{a}tosiz"], im[f"{a}tsiz"]) for a in "xy"}
    for t in range(tiles["x"] * tiles["y"]):
        rect = {}
        for a, n in (("x", t % tiles["x"]), ("y", t // tiles["x"])):
            rect[a] = max(im[f"{a}tosiz"] + n * im[f"{a}tsiz"], im[f"{a}osiz"]), min(im[f"{a}tosiz"] + (n + 1) * im[f"{a}tsiz"], im[f"{a}siz"])
        for c, sub in enumerate(im["comps"]):
            k, s = holds(im, own, t, c), 0
            for r in range(k["levels"] + 1):
                cells = {}
                for a in "xy":
                    r0, r1 = (cdiv(cdiv(e, sub[f"{a}r"]), 1 << k["levels"] - r) for e in rect[a])
                    size = 1 << k["precincts"][r][f"pp{a}"]
                    cells[a] = [(j * size, (j + 1) * size) for j in range(r0 // size, cdiv(r1, size))] if r1 > r0 else []
                for p, (y, x) in enumerate((y, x) for y in cells["y"] for x in cells["x"]):
                    yield t, c, r, p, s + p, rect, k, x, y
                s += len(cells["x"]) * len(cells["y"])


def brute_window(im, own, rq):
    cells = list(brute_cells(im, own))
    most = max([k["levels"] if k["levels"] is not None else im["levels"] for k in im["comps"]] + [v["levels"] for (i, _, _), v in own.items() if i == im["image_id"]])
    w = {q: [cdiv(im[f"{a}siz"], 1 << q) - cdiv(im[f"{a}osiz"], 1 << q) for a in "xy"] for q in range(most + 1)}
    if rq["round"] == "up":
        k = max([q for q in w if w[q][0] >= rq["fx"] and w[q][1] >= rq["fy"]], default=0)
    elif rq["round"] == "down":
        k = min([q for q in w if w[q][0] <= rq["fx"] and w[q][1] <= rq["fy"]], default=most)
    else:
        k = min(w, key=lambda q: (abs(w[q][0] * w[q][1] - rq["fx"] * rq["fy"]), q))
    found = set()
    for t, c, r, p, _, rect, held, x, y in cells:
        if rq["comps"] and c not in rq["comps"] or r > max(0, held["levels"] - k):
            continue
        margin, scale, inside = 0 if r == held["levels"] else 4 if held["reversible"] else 8, 1 << held["levels"] - r, True
        for a, (lo, hi) in (("x", x), ("y", y)):
            b0 = max((rq[f"o{a}"] << k) + im[f"{a}osiz"], rect[a][0])
            b1 = min(((rq[f"o{a}"] + rq[f"s{a}"]) << k) + im[f"{a}osiz"], rect[a][1])
            c0, c1 = (cdiv(b, im["comps"][c][f"{a}r"]) for b in (b0, b1))
            inside = inside and b0 < b1 and c0 < c1 and lo < cdiv(c1, scale) + margin and hi > max(0, c0 // scale - margin)
        if inside:
            found.add((t, c, r, p))
    return found


@pytest.fixture(scope="module")
def mixed(spark):
    ims, own = random_images(random.Random(5), 12)
    table = spark.createDataFrame([tuple(m.values()) for m in ims], MIXED)
    codings = spark.createDataFrame([(*key, *v.values()) for key, v in own.items()], OWN)
    return ims, own, table, codings


def test_precincts_of_mixed_codings(mixed):
    ims, own, table, codings = mixed
    rows = geometry.precincts(geometry.resolutions(geometry.tiles(table), codings)).select("image_id", "t", "c", "r", "p", "s", "I").collect()
    want = set()
    for im in ims:
        tiles = cdiv(im["xsiz"] - im["xtosiz"], im["xtsiz"]) * cdiv(im["ysiz"] - im["ytosiz"], im["ytsiz"])
        want |= {(im["image_id"], t, c, r, p, s, t + (c + s * 3) * tiles) for t, c, r, p, s, *_ in brute_cells(im, own)}
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    least = {r["image_id"]: (r["ppx"], r["ppy"]) for r in geometry.smallest_precinct(table).collect()}
    for im in ims:
        all_ = [p for c in range(3) for k in [holds(im, {}, 0, c)] for p in k["precincts"][: k["levels"] + 1]]
        assert least[im["image_id"]] == (min(p["ppx"] for p in all_), min(p["ppy"] for p in all_))


def test_windows_over_mixed_codings(spark, mixed):
    ims, own, table, codings = mixed
    rng, asked = random.Random(6), []
    for im in ims:
        for _ in range(8):
            asked.append({"req_id": len(asked), "image_id": im["image_id"], "fx": rng.randint(20, 500), "fy": rng.randint(20, 500), "ox": rng.randint(0, 200), "oy": rng.randint(0, 200), "sx": rng.randint(1, 200), "sy": rng.randint(1, 200), "comps": rng.choice([None, [], [1], [0, 2, 9]]), "round": rng.choice(["down", "up", "closest"])})
    requests = spark.createDataFrame([tuple(a.values()) for a in asked], REQUESTS)
    for codings_, own_ in ((codings, own), (None, {})):
        keys = viewport.precinct_keys(viewport.resolve(requests, table, codings_), geometry.resolutions(geometry.tiles(table), codings_))
        got = {}
        for r in keys.collect():
            got.setdefault(r["req_id"], set()).add((r["t"], r["c"], r["r"], r["p"]))
        want = {a["req_id"]: brute_window(ims[a["image_id"]], own_, a) for a in asked}
        assert got == {k: v for k, v in want.items() if v} and len(got) > 40


def test_segments_in_force(spark):
    """A tile's segment for a component, else the main header's if the tile names none, else the tile's, else the main one."""
    rng = random.Random(7)
    wide_image = {1}  # more than 256 components, so numbers of two bytes
    files, want = [], {}
    for i in range(40):
        n = 300 if i in wide_image else 4
        number = lambda c: c.to_bytes(2 if n > 256 else 1, "big")  # noqa: E731, B023
        seg = lambda code, body: code.to_bytes(2, "big") + (len(body) + 2).to_bytes(2, "big") + body
        head = b"\xff\x4f" + seg(0xFF51, bytes(2) + b"".join(v.to_bytes(4, "big") for v in (100, 100, 0, 0, 50, 100, 0, 0)) + n.to_bytes(2, "big") + b"\x07\x01\x01" * n)
        some = lambda: {c: rng.randint(0, 5) for c in rng.sample(range(n), rng.randint(0, 3))} if rng.random() < 0.6 else {}  # noqa: E731, B023
        shape = {}
        for where in ("main", 0, 1):
            shape[where] = (rng.randint(0, 5) if where == "main" or rng.random() < 0.4 else None, some(), some())
            default, own, shifts = shape[where]
            part = seg(0xFF52, bytes([0, 2, 0, 1, 0, default, 4, 4, 0, 1])) if default is not None else b""
            for c, v in own.items():
                part += seg(0xFF53, number(c) + bytes([0, v, 4, 4, 0, 0])) + (seg(0xFF53, number(c) + bytes([0, 9, 4, 4, 0, 0])) if v == 3 else b"")
            part += b"".join(seg(0xFF5E, number(c) + bytes([0, v])) for c, v in shifts.items())
            if where == "main":
                head += part
            else:
                head += b"\xff\x90\x00\x0a" + where.to_bytes(2, "big") + (14 + len(part)).to_bytes(4, "big") + b"\x00\x01" + part + b"\xff\x93"
        files.append((i, head))
        for t in (0, 1):
            (main, main_own, main_shift), (tile, tile_own, tile_shift) = shape["main"], shape[t]
            for c in range(n):
                held = tile_own.get(c) if tile_own else main_own.get(c)
                source = "tile component" if tile_own and c in tile_own else "main component" if not tile_own and c in main_own else "tile" if tile is not None else "main"
                level = held if held is not None else tile if tile is not None else main
                want[i, t, c] = (level, source, (tile_shift or main_shift).get(c, 0), level != main_own.get(c, main) or source.endswith("component") != (c in main_own))
    marks = codestream.markers(spark.createDataFrame(files, "i long, content binary")).persist()
    codings = {(r["image_id"], r["tile"], r["c"]): r for r in codestream.component_codings(marks, "i").collect()}
    shifts = {(r["image_id"], r["tile"], r["c"]): r["shift"] for r in codestream.component_shifts(marks, "i").collect()}
    exceptions = {(r["image_id"], r["t"], r["c"]) for r in codestream.tile_codings(marks, "i").collect()}
    assert {k: (r["levels"], r["from"], shifts[k], k in exceptions) for k, r in codings.items()} == want
    comps = {r["image_id"]: r["comps"] for r in codestream.images(marks, "i").collect()}
    assert len(comps[1]) == 300 and all((x["levels"] is None) == (x["precincts"] is None) for x in comps[1])
    marks.unpersist()


def test_progression_changes(spark):
    seg = lambda code, body: code.to_bytes(2, "big") + (len(body) + 2).to_bytes(2, "big") + body
    change = lambda r, p: bytes([r, 0, 0, 5, 4, 3, p])
    size = seg(0xFF51, bytes(2) + b"".join(v.to_bytes(4, "big") for v in (100, 100, 0, 0, 50, 100, 0, 0)) + b"\x00\x03" + b"\x07\x01\x01" * 3)
    part = lambda t, n, body: b"\xff\x90\x00\x0a" + t.to_bytes(2, "big") + (14 + len(body)).to_bytes(4, "big") + bytes([n, 0]) + body + b"\xff\x93"
    raw = b"\xff\x4f" + size + seg(0xFF5F, change(0, 1) + change(1, 2)) + part(0, 0, seg(0xFF5F, change(2, 3))) + part(1, 0, b"") + part(0, 1, seg(0xFF5F, change(3, 4) + change(4, 0)))
    marks = codestream.markers(spark.createDataFrame([(1, raw), (2, raw[:2] + size + part(0, 0, b""))], "i long, content binary"))
    got = codestream.progression_changes(marks, "i").orderBy("image_id", "tile", "number").select("image_id", "tile", "number", "r_from", "layer_to", "progression").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 2, 5, 3), (1, 0, 1, 3, 5, 4), (1, 0, 2, 4, 5, 0), (1, 1, 0, 0, 5, 1), (1, 1, 1, 1, 5, 2)]
    assert codestream.component_quantisations(marks, "i").filter(F.col("style").isNotNull()).count() == 0
