from pyspark.sql import functions as F

from tessera.streaming.pacer import pace, pace_stream

FRAMES = [(0, 4294966000, 0.0), (1, 204, 0.01), (2, 1704, 0.02), (3, 1704, 0.03), (4, 3204, 9.0), (5, 4704, 9.001), (6, 6204, 9.002)]


def test_due_times():
    out, _ = pace(FRAMES, None, 1 / 60)
    shown = [round(s, 6) for _, s, _ in out]
    assert shown[:4] == [0.0, round(1500 / 90000, 6), round(3000 / 90000, 6), round(3000 / 90000, 6)]
    assert [r for _, _, r in out] == [False] * 4 + [True, False, False]
    assert shown[4:] == [9.0, round(9 + 1500 / 90000, 6), round(9 + 3000 / 90000, 6)]


def test_stream(spark, tmp_path):
    rows = [(s, *f) for s in (1, 2) for f in FRAMES]
    spark.createDataFrame(rows, "ssrc long, frame long, ticks long, ready double").repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ssrc long, frame long, ticks long, ready double").parquet(str(tmp_path / "in"))
    q = pace_stream(source, 60).writeStream.format("memory").queryName("paced").outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
    q.trigger(availableNow=True).start().awaitTermination()
    got = spark.table("paced").filter(F.col("ssrc") == 2).orderBy("frame").collect()
    assert [(r["frame"], r["shown"], r["rebased"]) for r in got] == pace(FRAMES, None, 1 / 60)[0]
