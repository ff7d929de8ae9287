import hashlib
import random
import re
import time

import numpy as np

from tessera.llm.decontaminate import contamination, drop_contaminated
from tessera.llm.fm_index import FMIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = WORD.findall(lower(text or ""))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if name is None else str(name))
    out = []
    for d, text in docs:
        w = WORD.findall(lower(text or ""))
        hit, names = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    names |= windows[x]
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(names), sha, bool(hit)))
    return out


def test_suffix_array_and_index():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60, 300):
        text = np.r_[rng.integers(0, 4, n), 0]
        order = suffix_array(text)
        assert sorted(range(len(text)), key=lambda i: list(text[i:])) == order.tolist()
        index = FMIndex(text, 4)
        for k in (1, 2, 3):
            patterns = rng.integers(1, 4, (20, k))
            lo, hi = index.search(patterns)
            for p, a, b in zip(patterns, lo, hi):
                want = [i for i in range(len(text) - k + 1) if (text[i : i + k] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = ["the", "of", "Maße", "x1", "b2", "Ünder", "and", "to"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(10, 30))) for i in range(12)] + [(100, "of"), (101, None), (102, "..."), (None, text(12)), (7, text(11))]
    for short in (False, True):
        its = items if short else [x for x in items if x[0] != 100]
        docs = [(i, f"{text(rng.randint(0, 40))}, {rng.choice(its)[1]}! {text(rng.randint(0, 9))}") for i in range(60)]
        docs += [(60, None), (61, ""), (62, "... !"), (3, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (63, text(5000))]
        d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, n_words string")
        b = spark.createDataFrame(its, "item_id long, text string")
        key = lambda r: tuple(map(str, r))
        want = sorted(brute(docs, its), key=key)
        for options in ({}, {"shard_words": 50}, {"block_bytes": 200}):
            got = [tuple(r)[:6] for r in contamination(d, b, **options).collect()]
            assert sorted(got, key=key) == want
        clean = drop_contaminated(d, b)
        assert clean.columns == d.columns and clean.count() == sum(not x[5] for x in want)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert contamination(d, b).count() == 0
    assert contamination(one, b).first()[:4] == (1, 3, 0, 0)


def test_repeated_windows_and_texts(spark):
    """Items that repeat a passage, and a long text of few words, over many shards: as by hand, and no slower for the repeats."""
    quote = " ".join(f"word{i}" for i in range(12))
    items = [(1, " x ".join([quote] * 400)), (2, "same " * 400), (3, quote + " x " + quote), (1, "same " * 12)]
    docs = [(0, " and ".join([quote] * 50)), (1, "same " * 3000 + "end " + "same " * 9), (2, ("a b c " * 40 + quote + " ") * 30), (3, "same " * 9), (4, quote)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items))
    for options in ({}, {"shard_words": 700}):
        found = contamination(d, b, **options).collect()
        assert sorted(tuple(r)[:6] for r in found) == want
        assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found}[1] == [(0, 3000)]
    began = time.monotonic()
    big = spark.createDataFrame([(0, " and ".join([quote] * 20_000) + " same" * 300_000)], "doc_id long, text string")
    assert contamination(big, b).first()["n_items"] == 3
    assert time.monotonic() - began < 60
