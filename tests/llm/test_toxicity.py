import math
import random
import re
import string
import zlib
from itertools import groupby

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.toxicity import CALIBRATION_PART, FEATURES, NEAR, SECOND_PERSON, _score_trees, _with_features, features_of, fit, score, toxicity


def make(spark, n=600):
    rng = random.Random(2)
    clean = ["stone", "river", "cloud", "green", "paper", "window", "you", "the"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zlurp", "grommit"]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    docs += [(n, None, "x"), (n + 1, "", "x"), (None, "you zlurp grommit", "x"), (3, docs[3][1], "x")]
    labels += [(3, 0), (n + 5, 1), (None, 1), (4, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_and_edges(spark):
    docs, labels = make(spark)
    got = toxicity(docs, labels).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.orderBy("toxic").collect()}
    assert len(got) == docs.count()
    right = held = 0
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        i = r["doc_id"]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        if r["held_out"] and truth.get(i) is not None:
            held += 1
            right += r["predicted"] == truth[i]
    assert held > 100 and right / held > 0.95
    assert next(r for r in got if r["doc_id"] is None)["predicted"] == 1


def test_without_labels(spark):
    docs, labels = make(spark, 20)
    assert {r["score"] for r in toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity(docs.limit(0), labels).count() == 0


def test_features():
    assert features_of(None, {}) == features_of("", {}) == [0.0] * len(FEATURES)
    f = dict(zip(FEATURES, features_of("You are an id10t, IDIOT!!! a.b", {"idiot": 2.0})))
    assert f["lexicon_kinds"] == 1 and f["hidden_hits"] > 0 and f["near_second_person"] > 0 and f["exclamations"] > 0
    assert f["repeated_letters"] == 0 and f["capital_words"] > 0


def brute_features(text, lexicon):
    """The features one by one from their names, by other means."""
    if not text:
        return [0.0] * len(FEATURES)
    letters = lambda c: c.isalpha()
    words = ["".join(g) for k, g in groupby(text, letters) if k]
    n = max(1, len(words))
    raw = text.encode()
    low = [w.lower() for w in words]
    hidden = []
    for token in re.split(r"[^A-Za-z0-9@$*!._-]+", text):
        for m in re.findall(r"(?<![a-zA-Z])[a-zA-Z]+(?:[0-9@$*!._-]+[a-zA-Z]+)+", token):
            plain = "".join({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}.get(c, c) for c in m.lower() if c not in "*.-_")
            hidden.append(plain)
    hits = [w for w in low if w in lexicon] + [w for w in hidden if w in lexicon]
    you = [i for i, w in enumerate(low) if w in SECOND_PERSON]
    near = sum(any(abs(i - j) <= NEAR for j in you) for i, w in enumerate(low) if w in lexicon)
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    marks = sum(chr(b) in string.punctuation for b in raw)
    repeated = sum(raw[i] == raw[i - 1] == raw[i - 2] and raw[i] >= 65 for i in range(2, len(raw)))
    return [
        len(hits) / n, sum(lexicon[w] for w in hits) / n, math.log1p(len(hits)), len(set(hits)), max([lexicon[w] for w in hits], default=0.0),
        math.log1p(sum(w in lexicon for w in hidden)), near / n, len(you) / n, upper / max(1, upper + lower), sum(w == w.upper() for w in words) / n,
        raw.count(b"!") / len(raw), marks / len(raw), sum(48 <= b <= 57 for b in raw) / len(raw), len(hidden) / n, repeated / len(raw), math.log1p(len(words)),
    ]


def test_features_against_brute_force():
    rng = random.Random(6)
    lexicon = {"zlurp": 2.5, "idiot": 1.25, "grommit": 3.0}
    pieces = ["You", "zlurp", "ZLURP", "z1urp", "gr0mm1t", "id10t", "your", "hello", "WORLD", "!!!", "aaa", "a.b", "x@y", "12", "é", "du", "-", "(ok)", "I-d-i-o-t", "\n"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) + rng.choice([" ", "  ", ", "]) for _ in range(rng.randint(0, 40)))
        assert np.allclose(features_of(text, lexicon), brute_features(text, lexicon), rtol=1e-12), text


def test_lexicon_and_calibration_against_brute_force(spark):
    docs, labels = make(spark)
    model = fit(docs, labels, "text", "doc_id", "toxic")
    truth = {r["doc_id"]: r["toxic"] for r in labels.filter("doc_id is not null and toxic is not null").orderBy("toxic").collect()}
    rows = [r for r in docs.filter("doc_id is not null").collect() if r["doc_id"] in truth]
    held = {r["doc_id"] for r in docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(CALIBRATION_PART)) == 0).collect()}
    taught = [(set((r["text"] or "").lower().split()), truth[r["doc_id"]]) for r in rows if r["doc_id"] not in held]
    toxic = sum(y for _, y in taught)
    want = {}
    for w in set().union(*(ws for ws, _ in taught)):
        p, n = sum(y for ws, y in taught if w in ws), sum(1 - y for ws, y in taught if w in ws)
        odds = math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (len(taught) - toxic + 1))
        if p >= max(3, 0.03 * toxic) and odds >= math.log(6):
            want[w] = odds
    assert {w: round(o, 9) for w, o in model.lexicon.items()} == {w: round(o, 9) for w, o in want.items()} and {"zlurp", "grommit"} <= set(want)

    # isotonic regression by pooling neighbours that go down, on the rows kept for it
    table = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] in held], "_id long, _text string")
    shown = _score_trees(model.trees, _with_features(table, model.lexicon, "_text")).select("_id", "_raw").collect()
    by_raw = {}
    for r in shown:
        by_raw.setdefault(r["_raw"], []).append(truth[r["_id"]])
    blocks = []
    for raw in sorted(by_raw):
        blocks.append([sum(by_raw[raw]), len(by_raw[raw]), [raw]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y, n, x = blocks.pop()
            blocks[-1][0] += y
            blocks[-1][1] += n
            blocks[-1][2] += x
    expected = {x: y / n for y, n, xs in blocks for x in xs}
    got = {r["_id"]: r["_score"] for r in score(table, model, "_text").collect()}
    for r in shown:
        assert math.isclose(got[r["_id"]], expected[r["_raw"]], abs_tol=1e-9)
