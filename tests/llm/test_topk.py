import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tessera.llm.topk import Grid, QueryBlock, _sort_key, _tiles, exact_top_k


def brute(rows, k, every):
    seen = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        seen[i] = min(seen.get(i, q), q)
    out = []
    for i, q in seen.items():
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in seen.items() if j != i and len(w) == len(q))[:k]
            out += [(i, r + 1, j, -s if -(1 << 63) <= -s < 1 << 63 else None) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vec = lambda d=8: [rng.uniform(-1, 1) for _ in range(d)]
    rows = [(i, vec()) for i in range(300)]
    common = vec()
    rows += [(i, common) for i in range(300, 420)]
    rows += [(420, None), (421, []), (422, [None] * 8), (423, [math.nan] + vec(7)), (424, [math.inf] + vec(7)), (None, vec()), (10, rows[10][1]), (20, vec())]
    rows += [(i, vec(3)) for i in (430, 431, 432)] + [(440, [0.0] * 8)]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "vec_id long, embedding array<double>, score int")
    want = brute(rows, 5, 10)
    assert sorted(map(tuple, exact_top_k(df, 5, 10).collect())) == want
    assert sorted(map(tuple, exact_top_k(df, 5, 10, block_numbers=60).collect())) == want


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [0.5]), (1, [0.1])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in exact_top_k(df).collect()] == [(0, 1, 1, 128 * 25)]
    assert exact_top_k(df.limit(0)).count() == 0


def test_scales_clusters_and_outliers(spark):
    """At any scale, with crowded values, single far ones and queries that tie with all."""
    rng = random.Random(5)
    for scale in (1.0, 1e3, 1e6):
        centres = [[rng.gauss(0, scale) for _ in range(6)] for _ in range(4)]
        rows = [(i, [x + rng.gauss(0, scale / 50) for x in centres[i % 4]]) for i in range(400)]
        rows += [(i, [0.0] * 6) for i in range(400, 500)] + [(500, [min(scale * 1e3, 3e6)] * 6), (501, [-min(scale * 1e3, 3e6)] * 6)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert sorted(map(tuple, exact_top_k(df, 5, 10).collect())) == brute(rows, 5, 10)


def test_huge_components(spark):
    """No finite vector is left out; scores beyond a long are null, but ranked."""
    rows = [(i, [float(i), 1.0]) for i in range(0, 40)] + [(40, [1e300, 1.0]), (41, [-1e300, 1e300]), (42, [1e17, 0.0]), (44, [1e17, 1e3]), (60, [-1e17, 5.0]), (70, [1e300, -1e300])]
    rows += [(101, [0.5, 0.5]), (102, [1e7, 0.0]), (50, [2e7, 1.0]), (103, [1e9, -1e9]), (104, [1e9, 1e9]), (105, [2.0**53, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for some in (rows, rows[:40] + rows[46:], rows[:40]):
        df = spark.createDataFrame(some, "vec_id long, embedding array<double>")
        assert sorted(map(tuple, exact_top_k(df, 5, 10).collect())) == brute(some, 5, 10)


def test_order_of_scores_of_any_size():
    values = [0, 1, -1, 2**63 - 1, 2**63, -(2**63), -(2**63) - 1, 10**30, 10**30 + 1, -(10**30), -(10**30) - 1, 10**400, 10**401, -(10**400), -(10**401), 99 * 10**30]
    assert sorted(values) == sorted(values, key=lambda v: (*_sort_key(v)[:2], v))


def test_a_task_holds_tiles_only():
    """8192 queries of 64 numbers against 6144 vectors: one tile's bounds at a time."""
    gen = np.random.default_rng(1)
    v = gen.integers(-256, 256, (6144, 64))
    grid = Grid(np.arange(-255, 0), np.full((64, 256), -256), np.full((64, 256), 256))
    grid.edges = np.tile(np.linspace(-255, 255, 255).astype(np.int64), (64, 1))
    cells = pa.array([c.tobytes() for c in grid.cells(v)], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6144)), cells], names=["id", "cells"])
    block = QueryBlock(np.arange(8192), gen.integers(-256, 256, (8192, 64)).astype(float))
    tracemalloc.start()
    assert sum(low.size for _, _, _, low, _ in _tiles(iter([batch]), {64: grid}, {64: block})) == 6144 * 8192
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_large_components(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-5000, 5000) if i % 3 else rng.uniform(-1, 1) for _ in range(4)]) for i in range(200)]
    rows += [(200, [40_000.0, -40_000.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, exact_top_k(df, 5, 10).collect())) == brute(rows, 5, 10)
