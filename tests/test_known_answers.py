"""Inputs whose answers are known beforehand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import color, quant, transform
from tessera.operators import cache, frames, geometry, viewport
from tessera.plans.common import canvas
from tessera.sources import codestream, images, jpp, requests, rtp
from tessera.streaming.frames import message_stream

WINDOWS = [
    ((1920, 1920, 0, 0, 1920, 1920, "down"), None, 3630),
    ((1920, 1920, 0, 0, 0, 0, "down"), None, 3630),
    ((960, 960, 0, 0, 960, 960, "down"), None, 930),
    ((800, 800, 0, 0, 800, 800, "down"), None, 255),
    ((800, 800, 0, 0, 800, 800, "up"), None, 717),
    ((1920, 1920, 860, 860, 200, 200, "down"), None, 114),
    ((1920, 1920, 860, 860, 200, 200, "down"), [0], 38),
    ((1920, 1920, 0, 0, 960, 960, "down"), None, 942),
]


def test_view_windows(spark):
    rows = [(i, 0, *w, comps) for i, (w, comps, _) in enumerate(WINDOWS)]
    asked = spark.createDataFrame(rows, "req_id long, image_id long, fx long, fy long, ox long, oy long, sx long, sy long, round string, comps array<int>")
    found = viewport.resolve(asked, canvas(spark))
    assert {r["req_id"]: r["n"] for r in found.groupBy("req_id").agg(F.sum("n_precincts").alias("n")).collect()} == {
        i: n for i, (_, _, n) in enumerate(WINDOWS)
    }
    grid = geometry.resolutions(geometry.tiles(canvas(spark)))
    keys = viewport.precinct_keys(found, grid).groupBy("req_id").agg(F.countDistinct("I").alias("n"), F.max("I").alias("m")).collect()
    assert {r["req_id"]: r["n"] for r in keys} == {i: n for i, (_, _, n) in enumerate(WINDOWS)}
    per_resolution = grid.filter("c = 0").orderBy("r").select(F.expr("npw * nph")).collect()
    assert [r[0] for r in per_resolution] == [1, 4, 16, 64, 225, 900]


def test_identifiers(spark):
    row = geometry.id_to_key(spark.createDataFrame([(66,)], "I long"), "I", "4", "3").first()
    assert (row["t"], row["c"], row["s"]) == (2, 1, 5)


def test_numbers_in_groups():
    for value, want in ((0, "00"), (127, "7f"), (128, "8100"), (16383, "ff7f"), (16384, "818000")):
        assert jpp.to_vbas(value).hex() == want
        assert jpp.vbas(bytes.fromhex(want), 0) == (value, len(want) // 2)
    assert jpp.vbas(b"\x81", 0) is None
    with pytest.raises(ValueError):
        jpp.vbas(b"\x81" * 11, 0)


def test_message_sizes(spark):
    sizes = [0, 987, 988, 1974, 1975]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id long, n long")
    got = cache.messages(df, "n").groupBy("id").count().orderBy("id").collect()
    assert [r["count"] for r in got] == [1, 1, 2, 2, 3]
    lengths = spark.sql(f"SELECT {cache.bin_id_bytes('id')} AS n FROM VALUES (0L), (15L), (16L), (2047L), (2048L) AS t(id)").collect()
    assert [r["n"] for r in lengths] == [1, 1, 2, 2, 3]
    for i in (0, 15, 16, 2047, 2048):
        assert len(jpp.message_header(None, i, 0, 0, True)) - 2 == 1 + (i > 15) + (i > 2047)


def test_model_text(spark):
    held = spark.createDataFrame([(1, i) for i in (0, 1, 2, 3, 5, 7, 8, 9, 10)], "c int, id long")
    assert cache.model_text(cache.id_ranges(held, ["c"], "id"), ["c"], "P").first()["model"] == "P0-3,P5,P7-10"
    tokens = cache.parse_model(spark.createDataFrame([("Hm,H1-5,P7:987,-P5,Ht2,bad!",)], "model string")).collect()
    got = {(r["kind"], r["class"], r["first"], r["last"], r["bytes"]) for r in tokens}
    assert got == {("complete", "Hm", 0, 0, None), ("complete", "H", 1, 5, None), ("partial", "P", 7, 7, 987), ("remove", "P", 5, 5, None), ("complete", "H", 2, 2, None)}


def test_reversible_colour(spark):
    df = spark.createDataFrame([(10, 20, 30), (1, 0, 0)], "r int, g int, b int")
    there = df.select(*[v.alias(n) for v, n in zip(color.rct_forward(*map(F.col, "rgb")), ("y", "u", "v"))])
    assert [tuple(r) for r in there.collect()] == [(20, 10, -10), (0, 0, 1)]


def test_lifting(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([7],), ([],)], "x array<int>")
    got = [r[0] for r in df.select(transform.forward(F.col("x"), "5/3")).collect()]
    assert got == [[1, 0, 3, 1], [7], []]
    rng = np.random.default_rng(1)
    plane = rng.integers(-500, 500, (150, 37))
    rows = spark.createDataFrame([(0, y, [int(v) for v in r]) for y, r in enumerate(plane)], "i int, y int, row array<int>")
    for filter_ in ("5/3", "9/7", "5/3-real"):
        source = rows if filter_ == "5/3" else rows.withColumn("row", F.col("row").cast("array<double>"))
        again = transform.inverse_2d(transform.forward_2d(source, filter_, ["i"]), filter_, ["i"]).orderBy("y").collect()
        assert np.abs(np.array([r["row"] for r in again]) - plane).max() < (1 if filter_ == "5/3" else 1e-6)
    levels = transform.decompose(rows, "5/3", 3, ["i"]).groupBy("level", "band").agg(F.sum(F.size("row")).alias("n")).collect()
    assert sum(r["n"] for r in levels) == plane.size and len(levels) == 10


def test_quantiser_words(spark):
    # Step words for factor 90 at 8 bits and five levels.
    want = {
        "Y": "66ff 66d2 66d2 66a5 5ee8 5ee8 5eca 5734 5734 574b 40af 40af 41c7 3ec7 3ec7 346d",
        "Cb": "6664 5808 5808 5852 50d1 50d1 518f 4a92 4a92 4c8c 46e3 46e3 3a7a 3488 3488 2ae7",
        "Cr": "5841 5866 5866 5898 5103 5103 518d 4a5d 4a5d 4bc7 4585 4585 38c2 31ef 31ef 36bf",
    }
    for name, words in want.items():
        rows = quant.bands(spark, 5, name).withColumn("q", F.lit(90))
        got = quant.steps(rows, "q", name, 8).orderBy("band").collect()
        assert " ".join(f"{r['word']:04x}" for r in got) == words
        found = quant.estimate_q(quant.steps(rows, "q", name, 8).select("q", "band", "eps", "mu").withColumnRenamed("q", "of"), ["of"], name, 8, 5).first()
        assert (found["q"], found["verdict"]) == (90, "exact")


def test_frames(spark):
    def run(packets):
        rows = [(1, i, seq, ts, m, main, r, 10) for i, (main, ts, seq, m, r) in enumerate(packets)]
        df = spark.createDataFrame(rows, "ssrc long, arrival long, ext int, ts long, marker boolean, main boolean, r boolean, length int")
        return [r["status"] for r in frames.assemble(df).orderBy("frame").collect()]

    assert run([(True, 1, 0, False, False), (False, 1, 1, True, False)]) == ["emitted"]
    assert run([(True, 2, 2, False, False), (False, 3, 3, True, False)]) == ["tail_loss", "no_header"]
    assert run([(True, 2, 2, False, True), (False, 3, 3, True, False)]) == ["tail_loss", "emitted"]
    assert run([(True, 1, 0, False, False), (False, 1, 1, True, False), (True, 2, 3, True, False)]) == ["emitted", "lossy"]
    assert run([(True, 1, 0xFFFFFF, False, False), (False, 1, 0, True, False), (True, 2, 1, False, False)]) == ["emitted", "open"]


def test_streams_cut_anywhere(spark, tmp_path):
    rows = [(1, 0, 5, b"abc"), (1, 6, 0, b"x" * 2500), (1, 0, 7, b"")]
    bins = spark.createDataFrame(rows, "s long, class int, id long, payload binary").withColumn("o", F.monotonically_increasing_id())
    whole = bytes(jpp.emit(bins, ["s"], "o").first()["bytes"])
    one = [m[:8] for m in jpp.read_messages(whole)[0]]
    assert [m[4] for m in one] == [3, 987, 987, 526, 0, 0] and one[-1][7] == 2
    back = jpp.bins(jpp.messages(spark.createDataFrame([(1, whole)], "s long, bytes binary")), ["s"]).collect()
    assert {(r["class"], r["id"], bytes(r["payload"]), r["complete"]) for r in back} == {(0, 5, b"abc", True), (6, 0, b"x" * 2500, True), (0, 7, b"", True)}
    for cut in range(len(whole)):
        found, end, c, s = jpp.read_messages(whole[:cut])
        rest = jpp.read_messages(whole[end:], c, s)[0]
        assert [m[:8] for m in found + rest] == one
    pieces = [(k, i, whole[i * (k + 1) : (i + 1) * (k + 1)]) for k in (0, 6, 999) for i in range(-(-len(whole) // (k + 1)))]
    spark.createDataFrame(pieces, "stream_id long, arrival long, bytes binary").repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("stream_id long, arrival long, bytes binary").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = message_stream(source).writeStream.format("memory").queryName("msgs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
    q.trigger(availableNow=True).start().awaitTermination()
    for k in (0, 6, 999):
        got = spark.table("msgs").filter(F.col("stream_id") == k).orderBy("number").collect()
        assert [(r["class"], r["id"], r["msg_offset"], r["msg_length"], r["eor"]) for r in got] == [(m[0], m[2], m[3], m[4], m[7]) for m in one]


def test_image_files(spark, tmp_path):
    images.register(spark)
    rng = np.random.default_rng(3)
    planes = [rng.integers(0, 4096, (5, 7)) for _ in range(3)]
    (tmp_path / "a.ppm").write_bytes(images.write_pnm(planes, 12))
    (tmp_path / "b.pgm").write_bytes(b"P5 # comment\n3 2 255\n" + bytes(range(6)))
    (tmp_path / "c.pgx").write_bytes(images.write_pgx(planes[0] - 2048, 12, True))
    rows = spark.read.format("pnm").load(str(tmp_path)).orderBy("path", "c", "y").collect()
    assert np.array([r["row"] for r in rows if r["path"].endswith("ppm")]).reshape(3, 5, 7).tolist() == [p.tolist() for p in planes]
    assert [r["row"] for r in rows if r["path"].endswith("pgm")] == [[0, 1, 2], [3, 4, 5]]
    pgx = spark.read.format("pgx").load(str(tmp_path / "c.pgx"))
    assert [r["row"] for r in pgx.orderBy("y").collect()] == (planes[0] - 2048).tolist()
    out = tmp_path / "out"
    spark.read.format("pnm").load(str(tmp_path / "a.ppm")).coalesce(1).write.format("pnm").option("path", str(out)).option("depth", 12).mode("append").save()
    assert (out / "a.ppm").read_bytes() == images.write_pnm(planes, 12)


def test_boxes_and_markers(spark):
    box = lambda kind, body: (8 + len(body)).to_bytes(4, "big") + kind + body
    raw = spark.range(1).select(codestream.main_header_bytes(F.lit(640), F.lit(480), F.lit(3), F.lit(True)).alias("b")).first()["b"]
    stream = bytes(raw) + b"tile data"
    file = box(b"jP  ", b"\r\n\x87\n") + box(b"jp2h", box(b"ihdr", b"12345678901234")) + b"\0\0\0\1jp2c" + (16 + len(stream)).to_bytes(8, "big") + stream
    found = codestream.boxes(spark.createDataFrame([("f", file)], "path string, content binary")).collect()
    assert [(r["depth"], r["type"]) for r in found] == [(0, "jP  "), (0, "jp2h"), (1, "ihdr"), (0, "jp2c")]
    df = spark.createDataFrame([("f", bytes(found[-1]["payload"])), ("cut", stream[:30]), ("bad", b"no"), ("none", None)], "path string, content binary")
    marks = codestream.markers(df)
    part = codestream.tile_parts(marks, ["path"]).collect()
    assert [(r["path"], r["tile"], r["end"] - r["begin"]) for r in part] == [("f", 0, 9)]
    image = codestream.images(marks, "path").first()
    assert (image["xsiz"], image["ysiz"], image["levels"], image["reversible"], len(image["comps"]), len(image["precincts"])) == (640, 480, 3, True, 3, 4)


def test_captures_and_rejects(spark, tmp_path):
    packet = bytes([0x80, 0x60, 0, 1, 0, 0, 0, 2, 0, 0, 0, 3]) + bytes([0x40, 0, 0, 9, 0x80, 0, 0, 0]) + b"data"
    bad = {
        "short": packet[:8], "version": b"\0" + packet[1:], "overrun": packet[:15], "future revision": packet[:13] + b"\x10" + packet[14:],
        "reserved bits": packet[:16] + b"\x82" + packet[17:], "colour without flag": packet[:17] + b"\1" + packet[18:],
        "caching without reuse": packet[:16] + b"\x20" + packet[17:], "place without flag": packet[:12] + b"\0" + packet[13:],
    }
    records = [packet, *bad.values()]
    (tmp_path / "x.rtp").write_bytes(b"".join(b"\xff\xff" + len(p).to_bytes(2, "big") + p for p in records))
    got = rtp.parse_packets(rtp.read_captures(spark, str(tmp_path))).orderBy("arrival").collect()
    assert [r["reject"] for r in got] == [None, *bad]
    assert (got[0]["seq"], got[0]["ts"], got[0]["ssrc"], got[0]["eseq"], got[0]["r"], got[0]["length"]) == (1, 2, 3, 9, True, 4)


def test_request_strings(spark):
    texts = {
        "?fsiz=640,480,closest&roff=1,2&rsiz=3,4&comps=0,2-4&len=9&x=1": ("closest", 640, [0, 2, 3, 4], 9, None),
        "": (None, None, None, None, "empty"), "fsiz=12": (None, None, None, None, "malformed"), "fsiz=1,2,sideways": (None, None, None, None, "malformed"),
        "comps=3-1": (None, None, None, None, "malformed"), "comps=0-99999": (None, None, None, None, "malformed"), "len=-1": (None, None, None, None, "malformed"),
        "type=text/html": (None, None, None, None, "type"), "type=a, jpp-stream;x=1&fsiz=5,6": (None, 5, None, None, None),
    }
    got = requests.parse_requests(spark.createDataFrame([(t,) for t in texts], "query string")).collect()
    for r in got:
        length = None if r["error"] else r["len"]
        assert (r["round"], r["fx"], r["comps"], length, r["error"]) == texts[r["query"]], r
