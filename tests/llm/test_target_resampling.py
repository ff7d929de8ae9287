import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import target_resampling as R


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return ws, [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute(docs, target, percent):
    raw = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    want = Counter(bucket(f) for t in target for f in features(t)[1])
    s, t = sum(raw.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = []
    for i, text in docs:
        ws, fs = features(text)
        w = sum(gain[bucket(f)] for f in fs)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(fs), w, score, len(ws)))
    may = [r for r in out if r[4] >= 20 and r[0] is not None]
    best = sorted(may, key=lambda r: (-r[3], r[0]))[: percent * len(may) // 100]
    ranks = {}
    for n, r in enumerate(best, 1):
        ranks.setdefault(r[0], []).append(n)
    return [(*r[:4], ranks[r[0]].pop(0) if r[4] >= 20 and ranks.get(r[0]) else None) for r in out]


def rows():
    rng = random.Random(8)
    words = ["the", "The", "ÉTÉ", "été", "straße", "GROẞ", "x9", "日本", "😀", "K", "İ", "don't", "a-b", "\x7f", "…", "OK"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 60]))) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(900, texts[5])] * 4 + [(None, texts[9]), (-1, None), (-2, ""), (-5, "word " * 30000)]
    return docs, texts[:10] + [None, "", "the OK été"]


def frames(spark, docs, target):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("s"), "buckets": F.lit(1), "_id": F.lit(2)})
    return d.repartition(4), spark.createDataFrame([(t,) for t in target], "text string")


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_against_brute_force(spark, percent):
    docs, target = rows()
    got = R.target_resample(*frames(spark, docs, target), percent=percent)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs, target, percent), key=str)


def test_words(spark):
    texts = [t for _, t in rows()[0]] + ["Kelvin K sign", "A" * 50 + "É", "\x00a\x00", " a  b "]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", R.words(F.col("text")).alias("w")).collect()
    assert all(r.w == features(r.text)[0] for r in got)


def test_ranks_over_many_ranges(spark):
    """Ties, and one id with a third of all rows, over ranges that no task sees whole."""
    rng = random.Random(1)
    data = [(rng.randrange(300) if i % 3 else 7, rng.randrange(-20, 20) if i % 3 else 11, i % 7 != 0, i) for i in range(6000)]
    df = spark.createDataFrame(data, "_id long, score long, _may boolean, _row long").repartition(5)
    for k in (1, 100, 2500):
        best = sorted((r for r in data if r[2]), key=lambda r: (-r[1], r[0], r[3]))[:k]
        got = R.draw(df, k).collect()
        assert len(got) == len(data)
        assert [(r["_id"], r["score"], r["_may"], r["_row"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == best
        assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, k + 1))


def test_empty(spark):
    docs, target = frames(spark, *rows())
    assert R.target_resample(docs.limit(0), target).count() == 0
    none = R.target_resample(docs, target.limit(0))
    assert sorted(map(tuple, none.collect()), key=str) == sorted(brute(rows()[0], [], 5), key=str)
    few = R.target_resample(docs.filter("doc_id < 15"), target)
    assert few.filter("rank is not null").count() == 0
