import random
from collections import Counter

import numpy as np

from tessera.llm.importance import BUCKETS, kth_greatest, ngram_buckets, resample


def test_selection(spark):
    rng = random.Random(1)
    good, bad = ["alpha", "beta", "gamma", "delta"], ["spam!!", "WIN", "$$$", "click"]
    docs = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randint(20, 60)))) for i in range(400)]
    extra = [(500, None), (501, ""), (None, "alpha beta"), (7, docs[7][1])]
    df = spark.createDataFrame([(a, b, "x") for a, b in docs + extra], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)] + [(None, 1), (7, None)], "doc_id long, quality int")
    rows = resample(df, labels, keep=0.4).collect()
    assert len(rows) == len(docs) + 4
    keys = sorted((r["sample_key"] for r in rows if r["sample_key"] is not None), reverse=True)
    k = int(np.ceil(0.4 * len(keys)))
    assert {r["sample_key"] for r in rows if r["selected"]} == set(keys[:k])
    assert not any(r["selected"] for r in rows if r["doc_id"] in (500, 501))
    assert np.mean([r["doc_id"] % 2 for r in rows if r["selected"] and r["doc_id"] is not None]) > 0.95

    # weights by brute force
    target = {i for i in range(0, 400, 3) if i % 2}
    raw, wanted = Counter(), Counter()
    for d, t in docs + extra:
        b = Counter(ngram_buckets(t).tolist())
        raw += b
        if d in target:
            wanted += b
    p = lambda c, b: (c[b] + 1) / (sum(c.values()) + BUCKETS)
    for r in rows[:50]:
        text = dict(docs + extra)[r["doc_id"]]
        want = sum(np.log(p(wanted, b)) - np.log(p(raw, b)) for b in ngram_buckets(text).tolist())
        assert abs(want - r["log_weight"]) < 1e-6
    assert resample(df.limit(0), labels).count() == 0


def test_kth(spark):
    rng = random.Random(2)
    values = [rng.choice([0.0, 1.0, rng.random() * 1e-9, rng.gauss(0, 100), 1e12]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 250, 499, 500):
        assert kth_greatest(df, "x", k) == sorted(values, reverse=True)[k - 1]
