"""Table functions in SQL, against the functions on whole columns; nulls, broken bytes and boxes within boxes."""

from pyspark.sql import functions as F

from tessera.sources import codestream, jpp, table_functions


def box(kind, body, long=False):
    head = (1).to_bytes(4, "big") + kind + (len(body) + 16).to_bytes(8, "big") if long else (len(body) + 8).to_bytes(4, "big") + kind
    return head + body


def test_boxes_by_hand():
    inner = box(b"ihdr", b"abc") + box(b"asoc", box(b"uinf", b"") + box(b"colr", b"xy"))
    data = box(b"jP  ", b"1234") + box(b"jp2h", inner, long=True) + box(b"free", b"") + b"\x00\x00\x00\x00jp2crest"
    got = [(b["depth"], b["type"], data[b["begin"] : b["end"]]) for b in codestream.each_box(data)]
    assert got[0] == (0, "jP  ", b"1234") and got[1] == (0, "jp2h", inner) and got[-1] == (0, "jp2c", b"rest")
    assert [(d, t) for d, t, _ in got[2:-1]] == [(1, "ihdr"), (1, "asoc"), (2, "uinf"), (2, "colr"), (0, "free")]
    deep = b"end"
    for _ in range(40):
        deep = box(b"asoc", deep)
    assert max(b["depth"] for b in codestream.each_box(deep)) == codestream.MOST_DEPTH - 1
    assert list(codestream.each_box(b"\x00\x00\x00\x07abcd" + data)) == [] and list(codestream.each_box(b"")) == []
    assert [b["end"] for b in codestream.each_box(box(b"jp2c", b"abcdef")[:-2])] == [12]


def test_functions_in_sql(spark):
    table_functions.register(spark)
    segment = lambda code, body: code.to_bytes(2, "big") + (len(body) + 2).to_bytes(2, "big") + body
    part = lambda tile, body: b"\xff\x90\x00\x0a" + tile.to_bytes(2, "big") + (14 + len(body)).to_bytes(4, "big") + b"\x00\x01\xff\x93" + body
    stream = b"\xff\x4f" + segment(0xFF64, b"\x00\x01hi") + part(0, b"one") + part(3, b"three") + b"\xff\xd9"
    rows = [(0, stream), (1, None), (2, b""), (3, stream[:20]), (4, box(b"jp2h", box(b"ihdr", b"")) + box(b"jp2c", stream)), (5, b"noise" * 9)]
    files = spark.createDataFrame(rows, "i int, content binary")
    files.createOrReplaceTempView("some_files")
    run = lambda f: spark.sql(f"SELECT s.i, x.* FROM some_files s, LATERAL {f}(s.content) x")
    for name, of in (("boxes", codestream.boxes), ("markers", codestream.markers)):
        want = of(files)
        if name == "markers":
            want = want.withColumn("payload", F.when(F.col("code") != codestream.SOD, F.col("payload")))
        assert sorted(map(str, run(name).select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert [tuple(r)[:3] for r in run("tile_parts").orderBy("part").collect() if r["i"] == 0] == [(0, 0, 0), (0, 1, 3)]
    docs = spark.createDataFrame([(1, 0, 1, b"x" * 2500), (2, 4, 7, b"")], "s int, class int, id long, payload binary")
    sent = jpp.emit(docs, ["s"], "id").union(spark.createDataFrame([(3, b"\x80"), (4, None)], "s int, bytes binary"))
    sent.createOrReplaceTempView("sent")
    got = spark.sql("SELECT s.s, m.* FROM sent s, LATERAL jpp_messages(s.bytes) m")
    want = jpp.messages(sent)
    columns = [c for c in want.columns if c not in ("bytes", "payload")]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    spark.catalog.dropTempView("some_files")
    spark.catalog.dropTempView("sent")
