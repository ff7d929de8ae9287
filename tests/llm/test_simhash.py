import random
import re

import numpy as np
import xxhash

from tessera.llm.common import materialize
from tessera.llm.components import connected_components
from tessera.llm.simhash import allocate, link_fingerprints, parts_for, probe_fingerprints, simhash_components


def brute_print(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(items):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, f"{fp:016x}", least.get(find(i))) for i, (d, fp) in enumerate(items)]


def test_documents(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(4))
    docs = []
    for g in range(40):
        base = [word() for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = word()
            docs.append((rng.randint(0, 10**6), rng.choice([" ", "\t", "\n ", "\x0b"]).join(copy).upper()))
    docs += [(1, None), (2, ""), (3, " \x1c "), (5, "one"), (5, "one"), (None, "one"), (None, None), (6, "x" * 50_000), (7, "a b " * 9000)]
    df = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in simhash_components(df).collect()), key=str)
    want = sorted(brute_components([(d, brute_print(t)) for d, t in docs]), key=str)
    assert got == want
    assert simhash_components(df.limit(0)).count() == 0


def test_dense_and_sparse_links(spark):
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(3):  # dense clusters, chains and near misses
        base = rng.getrandbits(64)
        for _ in range(150):
            fp = base
            for _ in range(rng.randint(0, 6)):
                fp ^= 1 << rng.randrange(64)
            prints.add(fp)
    items = [(fp, fp) for fp in sorted(prints)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = materialize(spark.createDataFrame([(signed(fp),) for fp in prints], "fp long"), "t")
    want = {}
    for fp, _, c in brute_components(items):
        want.setdefault(c, set()).add(fp)
    for most in (1, 20, 10**6):
        roots = {r["node"] % 2**64: r["root"] for r in connected_components(link_fingerprints(df, most=most)).collect()}
        got = {}
        for fp in prints:
            got.setdefault(roots.get(fp, signed(fp)), set()).add(fp)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_many_fingerprints_still_go_through_probes(spark):
    """20 000 values of 28 bits crowd a part of a third of them as 1.3e8 values would one of 21 bits: two parts take over."""
    assert [parts_for(np.full(64, 0.5), n, 2) for n in (10**4, 10**7, 1.3e8, 10**12)] == [3, 3, 2, 1]
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 1 << 28, 20_000))
    df = materialize(spark.createDataFrame([(int(v),) for v in values], "fp long"), "t")
    edges, dense = probe_fingerprints(df)
    assert dense.count() == 0
    want = set()
    for i, v in enumerate(values):
        near = values[i + 1 :][np.bitwise_count(values[i + 1 :] ^ v) <= 2]
        want |= {(int(v), int(x)) for x in near}
    assert {tuple(r) for r in edges.distinct().collect()} == want and want
    few = materialize(df.limit(40), "few")
    one, _ = probe_fingerprints(few, parts=1)
    three, _ = probe_fingerprints(few, parts=3)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in three.collect()}


def test_allocation_adds_up():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 2000, (500, 3)).astype(float)
    plan = allocate(counts, [22, 21, 21], 10_000, 2)
    assert (plan.sum(axis=1) == 0).all() and plan.min() == -1
    assert (allocate(np.ones((1, 3)), [22, 21, 21], 10_000, 2) == 0).all()
    assert allocate(np.array([[1.0, 1.0, 9000.0]]), [22, 21, 21], 10_000, 2)[0, 2] == -1


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 1999), (1999, 2001), (2001, 2000)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1999: 1999, 2000: 1999, 2001: 1999}
