"""View windows on images with origins, caches whose items change size, broken inputs, and state over several micro-batches."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tessera.operators import cache, frames, viewport
from tessera.plans.common import GEOMETRY
from tessera.sources import codestream, images, jpp, rtp
from tessera.streaming.frames import assemble_stream, message_stream
from tessera.streaming.pacer import pace, pace_stream
from tests.test_live import packet
from tests.test_pacer import FRAMES


def cdiv(a, b):
    return -(-a // b)


def brute_window(im, rq):
    """The precincts of a request by looking at every one of them."""
    w = lambda q: cdiv(im["xsiz"], 1 << q) - cdiv(im["xosiz"], 1 << q)
    h = lambda q: cdiv(im["ysiz"], 1 << q) - cdiv(im["yosiz"], 1 << q)
    k = next((q for q in range(im["levels"] + 1) if w(q) <= rq["fx"] and h(q) <= rq["fy"]), im["levels"])
    box = {}
    for a in "xy":
        o, s = rq[f"o{a}"], rq[f"s{a}"]
        box[a] = (o << k) + im[f"{a}osiz"], min(((o + s) << k) + im[f"{a}osiz"], im[f"{a}siz"])
    found = set()
    tiles = {a: cdiv(im[f"{a}siz"] - im[f"{a}tosiz"], im[f"{a}tsiz"]) for a in "xy"}
    for t in range(tiles["x"] * tiles["y"]):
        for c, sub in enumerate(im["comps"]):
            for r in range(max(0, im["levels"] - k) + 1):
                scale = 1 << im["levels"] - r
                margin = 0 if r == im["levels"] else 4 if im["reversible"] else 8
                hit, count = {}, {}
                for a, n in (("x", t % tiles["x"]), ("y", t // tiles["x"])):
                    t0, t1 = max(im[f"{a}tosiz"] + n * im[f"{a}tsiz"], im[f"{a}osiz"]), min(im[f"{a}tosiz"] + (n + 1) * im[f"{a}tsiz"], im[f"{a}siz"])
                    b0, b1 = max(box[a][0], t0), min(box[a][1], t1)
                    c0, c1 = cdiv(b0, sub[f"{a}r"]), cdiv(b1, sub[f"{a}r"])
                    r0, r1 = (cdiv(cdiv(e, sub[f"{a}r"]), scale) for e in (t0, t1))
                    size = 1 << im["precincts"][r][f"pp{a}"]
                    lo, hi = max(0, c0 // scale - margin), cdiv(c1, scale) + margin
                    cells = range(r0 // size, cdiv(r1, size)) if r1 > r0 else range(0)
                    count[a] = len(cells)
                    hit[a] = [j for j, cell in enumerate(cells) if b0 < b1 and c0 < c1 and cell * size < hi and (cell + 1) * size > lo]
                found |= {(t, c, r, y * count["x"] + x) for x in hit["x"] for y in hit["y"]}
    return found


def test_windows_on_images_with_origins(spark):
    rng = random.Random(21)
    ims, asked = [], []
    for i in range(12):
        levels = rng.randint(0, 4)
        x0, y0, tx, ty = rng.randint(0, 90), rng.randint(0, 90), rng.randint(60, 300), rng.randint(60, 300)
        ims.append({
            "image_id": i, "xsiz": x0 + rng.randint(100, 500), "ysiz": y0 + rng.randint(100, 500), "xosiz": x0, "yosiz": y0, "xtsiz": tx, "ytsiz": ty,
            "xtosiz": rng.randint(max(0, x0 - tx + 1), x0), "ytosiz": rng.randint(max(0, y0 - ty + 1), y0), "levels": levels, "reversible": i % 2 == 0,
            "comps": [{"xr": 1, "yr": 1}, {"xr": 2, "yr": rng.choice([1, 2])}, {"xr": 1, "yr": 1}],
            "precincts": [{"ppx": rng.randint(3, 7), "ppy": rng.randint(3, 7)} for _ in range(levels + 1)],
        })
        for _ in range(6):
            asked.append({"req_id": len(asked), "image_id": i, "fx": rng.randint(20, 500), "fy": rng.randint(20, 500), "ox": rng.randint(0, 200), "oy": rng.randint(0, 200), "sx": rng.randint(1, 200), "sy": rng.randint(1, 200), "comps": None, "round": "down"})
    requests = spark.createDataFrame([tuple(a.values()) for a in asked], "req_id long, image_id long, fx long, fy long, ox long, oy long, sx long, sy long, comps array<int>, round string")
    table = spark.createDataFrame([tuple(m.values()) for m in ims], GEOMETRY)
    ranges = viewport.resolve(requests, table)
    cells = ranges.selectExpr("req_id", "t", "c", "r", "npw", "px_lo", "px_hi", "explode(sequence(py_lo, py_hi - 1)) AS y").selectExpr("req_id", "t", "c", "r", "npw", "y", "explode(sequence(px_lo, px_hi - 1)) AS x")
    got = {}
    for r in cells.collect():
        got.setdefault(r["req_id"], set()).add((r["t"], r["c"], r["r"], r["y"] * r["npw"] + r["x"]))
    want = {a["req_id"]: brute_window(ims[a["image_id"]], a) for a in asked}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 30
    sums = viewport.resolve_classes(requests, table).groupBy("req_id").agg(F.sum(F.col("n_each") * F.size("cs")).alias("n")).collect()
    assert {r["req_id"]: r["n"] for r in sums} == {k: len(v) for k, v in got.items()}


def test_union_of_ranges(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(60):
        cells = set()
        for part in range(3):
            if rng.random() < 0.8:
                x, y, w, h = (rng.randint(0, 6) for _ in range(4))
                rows.append((i, part, x, x + w + 1, y, y + h + 1))
                cells |= {(a, b) for a in range(x, x + w + 1) for b in range(y, y + h + 1)}
        if cells:
            want[i] = len(cells)
    df = spark.createDataFrame(rows, "req_id long, part int, px_lo long, px_hi long, py_lo long, py_hi long")
    assert {r["req_id"]: r["n"] for r in viewport.union_counts(df, ["req_id"], "part", 3).collect()} == want


def test_lru_step_by_step(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.randint(0, 6), rng.randint(0, 9)) for c in range(5) for t in range(60)] + [(9, 0, 1, 6), (9, 1, 2, 6), (9, 2, 2, 2), (8, 0, 1, 50)]
    want = set()
    for c in {r[0] for r in rows}:
        held = OrderedDict()
        for _, t, item, n in sorted(r for r in rows if r[0] == c):
            held.pop(item, None)
            held[item] = (n, t)
            while held and sum(x for x, _ in held.values()) > 10:
                held.popitem(last=False)
        want |= {(c, i, n, t) for i, (n, t) in held.items()}
    df = spark.createDataFrame(rows, "client long, at long, item long, size long")
    got = cache.lru_kept(df, ["client"], "item", "at", "size", 10)
    assert {tuple(r) for r in got.select("client", "item", "bytes", "last_touch").collect()} == want
    assert {r[1] for r in want if r[0] == 9} == {2}


def test_broken_inputs_are_rows(spark):
    good = jpp.message_header(6, 0, 0, 3, True) + b"abc"
    streams = spark.createDataFrame([(1, good + b"\x05rest"), (2, good + b"\x00\x02\x00"), (3, None), (4, good + b"\x30" + b"\xff" * 12)], "k long, bytes binary")
    found = jpp.messages(streams).groupBy("k").agg(F.count("class").alias("n"), F.count("error").alias("errors"), F.count("eor").alias("ends")).collect()
    assert {tuple(r) for r in found} == {(1, 1, 1, 0), (2, 1, 0, 1), (4, 1, 1, 0)}
    assert jpp.bins(jpp.messages(streams), ["k"]).count() == 3
    record = b"\xff\xff\x00\x02ab"
    files = spark.createDataFrame([("a", record * 2), ("b", record + b"\xff\xfe\x00\x00"), ("c", record + b"\xff"), ("d", b""), ("e", None)], "path string, content binary")
    got = rtp.captured_packets(files).groupBy("path").agg(F.count("packet").alias("n"), F.count("error").alias("errors")).collect()
    assert {tuple(r) for r in got} == {("a", 2, 0), ("b", 1, 1), ("c", 1, 1)}
    pictures = spark.createDataFrame([("a", b"P5\n2 1\n255\n\x01\x02"), ("b", b"no image"), ("c", b"P5\n9 9\n255\n\x01")], "path string, content binary")
    got = {r["path"]: (r["row"], r["error"] is None) for r in images.image_lines(pictures, "pnm").collect()}
    assert got["a"] == ([1, 2], True) and not got["b"][1] and not got["c"][1]


def test_an_image_in_two_partitions_is_an_error(spark, tmp_path):
    images.register(spark)
    rows = [(f"{n}.pgm", 0, y, [n, y]) for n in range(3) for y in range(4)]
    df = spark.createDataFrame(rows, images.SCHEMA)
    df.repartition("path").sortWithinPartitions("path").write.format("pnm").mode("append").save(str(tmp_path / "ok"))
    assert sorted(p.name for p in (tmp_path / "ok").iterdir()) == ["0.pgm", "1.pgm", "2.pgm"]
    with pytest.raises(Exception, match="several partitions"):
        df.repartitionByRange(4, "y").write.format("pnm").mode("append").save(str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("[0-9]*"))


def test_segments_of_components(spark):
    def one(expr, raw, wide):
        return spark.createDataFrame([(bytes.fromhex(raw),)], "p binary").select(expr(F.col("p"), F.lit(wide)).alias("x")).first()["x"]

    own = one(codestream.coc, "0101" + "0103024000" + "7788", False)
    assert (own["component"], own["levels"], own["cbw"], own["cbh"], own["cmodes"], own["reversible"]) == (1, 1, 5, 4, 64, False)
    assert [(p["ppx"], p["ppy"]) for p in own["precincts"]] == [(7, 7), (8, 8)]
    assert one(codestream.coc, "010100" + "0004044001", True)["component"] == 257
    q = one(codestream.qcc, "02" + "22" + "7a5b" * 2, False)
    assert q["component"] == 2 and q["quantisation"]["guard"] == 1 and q["quantisation"]["steps"][1]["eps"] == 15
    changes = one(codestream.poc, "0000000403" + "0102" + "0101000a06" + "0300", False)
    assert [tuple(c) for c in changes] == [(0, 0, 4, 3, 1, 2), (1, 1, 10, 6, 3, 0)]
    assert [tuple(c) for c in one(codestream.poc, "000100000403010204", True)] == [(0, 256, 4, 3, 258, 4)]


def _run(spark, stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp"))
    run = q.trigger(availableNow=True).start()
    run.awaitTermination()
    return len([p for p in run.recentProgress if p["numInputRows"]])


def test_frames_over_micro_batches(spark, tmp_path):
    sent = [(65534 + 4 * f + i, f, i == 3, i == 0, f == 0) for f in range(6) for i in range(4)]
    lost = [p for p in sent if p[0] % 9 != 4]
    rows = [(5, k, packet(s, t, 5, m, a, r, b"x" * (s % 7))) for k, (s, t, m, a, r) in enumerate(lost)]
    whole = spark.createDataFrame(rows, "path string, arrival long, packet binary")
    want = {tuple(r) for r in frames.assemble(rtp.frame_input(rtp.parse_packets(whole))).filter("status <> 'open'").collect()}
    parsed = rtp.frame_input(rtp.parse_packets(whole))
    for k in range(5):  # frames of four packets, files of five
        parsed.filter(F.expr(f"arrival div 5 = {k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(parsed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert _run(spark, assemble_stream(source), "frames_cut", tmp_path) == 5
    columns = ["ssrc", "frame", "ts", "packets", "bytes", "gaps", "status", "meta_arrival"]
    assert {tuple(r) for r in spark.table("frames_cut").select(columns).collect()} == want


def test_pacer_and_messages_over_micro_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, *f) for f in FRAMES], "ssrc long, frame long, ticks long, ready double")
    raw = b"".join(jpp.message_header(6 if i == 0 else None, i, 0, 40, True) + bytes(40) for i in range(6)) + b"\x05"
    chunks = spark.createDataFrame([(1, k, raw[k * 70 : k * 70 + 70]) for k in range(4)] + [(1, 4, b"more")], "stream_id long, arrival long, bytes binary")
    for k in range(4):
        df.filter(F.expr(f"frame div 2 = {k}")).coalesce(1).write.mode("append").parquet(str(tmp_path / "pace"))
    for k in range(5):
        chunks.filter(f"arrival = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "chunks"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pace"))
    assert _run(spark, pace_stream(source, 60), "paced_cut", tmp_path) == 4
    got = spark.table("paced_cut").orderBy("frame").collect()
    assert [(r["frame"], r["shown"], r["rebased"]) for r in got] == pace(FRAMES, None, 1 / 60)[0]
    source = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "chunks"))
    assert _run(spark, message_stream(source), "messages_cut", tmp_path) == 5
    got = spark.table("messages_cut").orderBy("number").collect()
    assert [r["id"] for r in got] == [0, 1, 2, 3, 4, 5, None] and got[-1]["error"]
