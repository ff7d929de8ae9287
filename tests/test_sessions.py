"""Sessions over several micro-batches, against a server that keeps everything in dictionaries."""

import random

from tessera.plans.format_queries import in_steps
from tessera.streaming.sessions import serve_stream

SCHEMA = "session string, request long, bins array<struct<id: long, size: long>>, budget long, model array<struct<id: long, kind: string, bytes: long>>"


def literal(rows):
    held, out = {}, []
    for session, request, bins, budget, model in sorted(rows, key=lambda r: r[1]):
        mine = held.setdefault(session, {})
        for i, kind, size in model or []:
            if kind == "remove":
                mine.pop(i, None)
            elif kind == "complete":
                mine[i] = (mine.get(i, (0, False))[0], True)
            elif not mine.get(i, (0, False))[1]:
                mine[i] = (max(mine.get(i, (0, False))[0], size or 0), False)
        total, reason = 0, 2
        for i, size in bins or []:
            had, whole = mine.get(i, (0, False))
            if whole:
                continue
            room = 10**18 if budget is None else budget - total
            if room <= 0:
                reason = 4
                break
            n = min(max(0, size - had), room)
            out.append((session, request, i, had, n, had + n >= size, None))
            mine[i] = (had + n, had + n >= size)
            total += n
            if had + n < size:
                reason = 4
                break
        out.append((session, request, None, None, total, None, reason))
    return out


def test_sessions_step_by_step(spark):
    rng = random.Random(8)
    sizes = {i: rng.choice([0, 1, 90, 500, 5000]) for i in range(20)}
    rows = []
    for request in range(160):
        bins = [(i, sizes[i]) for i in rng.sample(range(20), rng.randint(0, 6))]
        model = [(rng.randrange(20), kind, rng.choice([None, 40, 600])) for kind in rng.sample(["partial", "complete", "remove"], rng.randint(0, 2))]
        rows.append((f"s{rng.randrange(6)}", request, bins or None, rng.choice([None, 0, 100, 700, 5000]), model or None))
    found = in_steps(spark.createDataFrame(rows, SCHEMA), serve_stream, "request", "sessions")
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted(literal(rows), key=str)


def test_no_requests(spark):
    assert in_steps(spark.createDataFrame([], SCHEMA), serve_stream, "request", "sessions").count() == 0
