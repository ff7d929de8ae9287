"""Queues and growing capture files over several triggers, one after the other."""

import random
from collections import defaultdict, deque

from tessera.sources import captures
from tessera.streaming import queues


def steps(spark, tmp_path, rows, schema, start):
    """Runs a query once for each list of rows, with one checkpoint."""
    for batch in rows:
        spark.createDataFrame(batch, schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        items = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        start(items).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def batches(rng):
    at, out = 0, []
    for n in (9, 1, 14, 6):
        out.append([(rng.randrange(3), at + k, f"v{at + k}") for k in range(n)])
        at += n
    return out


def test_latest_slots(spark, tmp_path):
    rows = batches(random.Random(3))
    steps(spark, tmp_path, rows, "s int, at long, v string", lambda items: queues.latest_slots(items, ["s"], "at", "v", f"{tmp_path}/out"))
    got = {(r["trigger"], r["s"]): (r["kept"], r["evicted"]) for r in queues.read_triggers(spark, f"{tmp_path}/out", "s int, kept string, evicted bigint").collect()}
    want = {}
    for t, batch in enumerate(rows):
        for s in {r[0] for r in batch}:
            mine = [r for r in batch if r[0] == s]
            want[t, s] = (max(mine, key=lambda r: r[1])[2], len(mine) - 1)
    assert got == want


def test_bounded_queues(spark, tmp_path):
    rows = batches(random.Random(4))
    start = lambda items: queues.bounded_queues(items, ["s"], "at", 4, 2, f"{tmp_path}/out")
    steps(spark, tmp_path, rows, "s int, at long, v string", start)
    held, taken, counts = defaultdict(deque), set(), {}
    for t, batch in enumerate(rows):
        came, dropped = defaultdict(int), defaultdict(int)
        for s, at, v in batch:
            held[s].append((at, v))
            came[s] += 1
            if len(held[s]) > 4:
                held[s].popleft()
                dropped[s] += 1
        for s in [s for s in held if held[s]]:
            taken |= {(t, s, *held[s].popleft()) for _ in range(min(2, len(held[s])))}
            counts[t, s] = (came[s], dropped[s], len(held[s]))
    got = {(r["trigger"], r["s"], r["at"], r["v"]) for r in queues.read_triggers(spark, f"{tmp_path}/out/taken", "s int, at long, v string").collect()}
    found = {(r["trigger"], r["s"]): (r["came"], r["dropped"], r["left"]) for r in queues.read_triggers(spark, f"{tmp_path}/out/counts", "s int, came long, dropped long, left long").collect()}
    assert got == taken and found == counts


def test_a_trigger_run_again_gives_the_same(spark, tmp_path):
    rows = batches(random.Random(5))
    start = lambda items: queues.bounded_queues(items, ["s"], "at", 4, 2, f"{tmp_path}/out")
    steps(spark, tmp_path, rows, "s int, at long, v string", start)
    schema = "s int, came long, dropped long, left long"
    first = sorted(queues.read_triggers(spark, f"{tmp_path}/out/counts", schema).collect())
    for name in ("3", ".3.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    items = spark.readStream.schema("s int, at long, v string").parquet(f"{tmp_path}/in")
    start(items).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert sorted(queues.read_triggers(spark, f"{tmp_path}/out/counts", schema).collect()) == first


def record(body, marker=b"\xff\xff"):
    return marker + len(body).to_bytes(2, "big") + body


def test_captures_that_grow(spark, tmp_path):
    """Files get longer between triggers, also by half records; a new one comes; one breaks and is not read on."""
    rng = random.Random(6)
    folder = tmp_path / "captures"
    folder.mkdir()
    captures.register(spark)
    packets = {f: [rng.randbytes(rng.randint(0, 300)) for _ in range(60)] for f in ("a", "b", "c")}
    raw = {f: b"".join(map(record, p)) for f, p in packets.items()}
    raw["b"] = b"".join(map(record, packets["b"][:30])) + b"noise" + b"".join(map(record, packets["b"][30:]))
    seen = []
    for cuts in ({"a": 0.2, "b": 0.3}, {"a": 0.5, "b": 0.3, "c": 0.1}, {"a": 0.5, "b": 0.9, "c": 1}, {"a": 1, "b": 1, "c": 1}, {"a": 1, "b": 1, "c": 1}):
        for f, part in cuts.items():
            (folder / f"{f}.rtp").write_bytes(raw[f][: int(len(raw[f]) * part)])
        source = spark.readStream.format("captures").option("path", str(folder)).option("split", "2000").load()
        query = source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint")
        query.trigger(once=True).start().awaitTermination()
        rows = spark.read.schema(source.schema).parquet(f"{tmp_path}/out").collect()
        got = defaultdict(dict)
        for r in rows:
            assert r["arrival"] not in got[r["path"]]
            got[r["path"]][r["arrival"]] = None if r["packet"] is None else bytes(r["packet"])
        seen.append(len(rows))
    want = {f: dict(enumerate(p)) for f, p in packets.items()}
    want["b"] = {**dict(enumerate(packets["b"][:30])), 30: None}
    assert {p.rsplit("/", 1)[1][0]: v for p, v in got.items()} == want
    assert seen == sorted(seen) and seen[0] > 0 and seen[-1] == seen[-2] == 151
