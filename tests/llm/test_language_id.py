import math
import random
import zlib
from collections import Counter

import numpy as np

from tessera.llm.language_id import _MULTIPLIERS, LEAST_COUNT, SHARE, fit, identify, keep_identified, positions, trigrams

WORDS = {"aa": ["the", "and", "with", "that", "thing"], "bb": ["der", "und", "nicht", "ist", "über"], "cc": ["ñino", "que", "los", "para"]}


def make(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 30))), lang, 1.5))
    rows += [(n, None, "aa", 0.0), (n + 1, "", "aa", 0.0), (n + 2, "12 34!", "bb", 0.0), (None, "the and that", None, 0.0), (5, rows[5][1], rows[5][2], 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_held_out_accuracy_and_edges(spark):
    docs = make(spark)
    got = identify(docs).collect()
    truth = {r["doc_id"]: r for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        text = truth[r["doc_id"]]["text"]
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] == truth[r["doc_id"]]["lang"]
    assert next(r for r in got if r["doc_id"] is None)["lang_pred"] == "aa"
    assert keep_identified(docs.limit(0)).count() == 0
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    assert identify(docs).first()["lang_pred"] == "und"
    assert identify(docs.limit(0)).count() == 0


def test_filter_has_no_false_negatives(spark):
    model = fit(make(spark))
    keys, _ = trigrams(["the and with that thing"])
    mask = np.uint64(0xFFFFFFFFFFFFFFFF)
    for p in positions(keys, model.hashes, model.log2):
        mask = mask & model.words[0][p]
    inner = [k for k in range(len(keys)) if (int(mask[k]) >> model.languages.index("aa")) & 1]
    assert len(inner) > len(keys) / 2


def test_trigrams_respect_text_bounds():
    keys, start = trigrams(["ab", None, "", "é1x"])
    assert start.tolist() == [0, 2, 2, 2] and len(keys) == 4


def plain_trigrams(text):
    line = [" ", *text.lower(), " "]
    line = [c if c.isalpha() else " " for c in line]
    return [tuple(line[i - 1 : i + 2]) for i in range(1, len(line) - 1) if line[i] != " "]


def test_against_brute_force(spark):
    """The filter as a dictionary of sets, looked up gram by gram; shared words make languages share trigrams."""
    rng = random.Random(3)
    words = {k: v + ["una", "solo", "the"] for k, v in WORDS.items()}
    rows = []
    for i in range(250):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang] + ["Zug7", "x"]) for _ in range(rng.randint(1, 25))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    log2, hashes = 9, 2  # so small a filter that false positives are many
    counts = {k: Counter() for k in words}
    for _, text, lang in rows:
        counts[lang].update(plain_trigrams(text))
    names = sorted(words)
    total = {k: sum(c.values()) for k, c in counts.items()}
    share = lambda k, g: counts[k][g] / total[k]
    key = lambda g: sum((ord(c) if c != " " else 0) << s for c, s in zip(g, (42, 21, 0)))

    def places(g):
        mixed = key(g) ^ (key(g) >> 29)
        return [((mixed * m) % 2**64) >> (64 - log2) for m in _MULTIPLIERS[:hashes]]

    slots = {}
    for k in names:
        for g, n in counts[k].items():
            if n >= LEAST_COUNT and share(k, g) >= SHARE * max(share(x, g) for x in names):
                for p in places(g):
                    slots.setdefault(p, set()).add(k)
    rate = {k: (sum(k in s for s in slots.values()) / 2**log2) ** hashes for k in names}
    model = fit(docs, hashes=hashes, log2=log2)
    texts = [r[1] for r in rows] + ["", None, "12", "the una zzzz", "qqqq"]
    got = model.predict(texts)
    for text, lang, score in zip(texts, got["lang_pred"], got["score"], strict=True):
        grams = plain_trigrams(text or "")
        hits = {k: sum(all(k in slots.get(p, ()) for p in places(g)) for g in grams) for k in names}
        left = {k: max(0.0, (hits[k] - len(grams) * rate[k]) / (1 - rate[k])) for k in names}
        best = max(names, key=lambda k: (left[k], -names.index(k)))
        if not grams:
            assert (lang, score) == ("und", 0)
        elif left[best] > 0:
            others = sorted(left.values())[-2]
            assert math.isclose(score, left[best] / sum(left.values()), rel_tol=1e-9)
            assert lang == best or math.isclose(left[best], others, rel_tol=1e-9)
