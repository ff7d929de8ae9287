import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm.sharding import assign_shards, write_shards


def check(rows, shards):
    by = {}
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        by.setdefault(r["shard"], []).append(r)
    for held in by.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    return [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]


def test_balance_and_columns(spark):
    rng = random.Random(4)
    docs = [(i, "é" * rng.randint(0, 40) + "x" * rng.choice([0, 5, 300, 900])) for i in range(3000)]
    docs += [(i, "the same text") for i in range(3000, 4500)]  # a hot group of copies
    docs += [(7, "row") for _ in range(700)] + [(None, None), (None, "a"), (9999, None), (9998, "")]
    df = spark.createDataFrame([(a, b, 1, "s") for a, b in docs], "doc_id long, text string, size int, shard string").repartition(5)
    got = assign_shards(df).collect()
    assert len(got) == len(docs)
    want = sorted(((d, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for d, t in docs), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    totals = check(got, 24)
    assert max(totals) - min(totals) <= 2 * max(r["size"] for r in got)


def test_one_huge_and_few_rows(spark):
    df = spark.createDataFrame([(0, "x" * 1_000_000)] + [(i, "y" * 10) for i in range(1, 50)], "doc_id long, text string")
    assert sum(check(assign_shards(df, 4).collect(), 4)) == 1_000_008 + 49 * 18
    assert len(assign_shards(df.limit(1)).collect()) == 1
    assert assign_shards(df.limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    write_shards(df, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    with pytest.raises(ValueError):
        write_shards(df.unionByName(df.limit(1)), str(tmp_path / "other"), 5)
    assert back.count() == 100 and back.select("shard").distinct().count() == 5
    assert back.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok")).filter("not ok").count() == 0


def test_assignment_against_brute_force(spark):
    """Records in the order of their texts' and ids' hashes; each goes where its middle byte lies."""
    rng = random.Random(8)
    docs = [(i, rng.choice(["hot text", None]) if i % 3 == 0 else "x" * rng.choice([0, 3, 40, 900, 20_000 if i == 50 else 7])) for i in range(1200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    keys = df.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64("doc_id").alias("b")).collect()
    order = sorted(keys, key=lambda r: (r["a"] % 2**64, r["b"] % 2**64))
    texts, before, slots, want = dict(docs), 0, {}, {}
    total = sum(len(t or "") + 8 for t in texts.values())
    for r in order:
        size = len(texts[r["doc_id"]] or "") + 8
        shard = min(6, int((before + size / 2) * 7 // total))
        want[r["doc_id"]] = (shard, slots.get(shard, 0))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in assign_shards(df, 7).collect()}
    assert got == want
