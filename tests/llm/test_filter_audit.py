import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from tessera.llm import filter_audit as A


def brute(docs, labels):
    """Each order applied to each document, step by step."""
    quality = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = []
    for i, text, part in docs:
        t = text or ""
        ws = re.findall("[^\x20\x09-\x0d]+", t)
        f = "A" * (len(ws) < 100) + "B" * (100 * len(set(ws)) < 80 * len(ws)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t))
        f += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in docs)
        failed.append((part or "", f, i in quality, i in toxic))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        alive = failed
        for step, x in enumerate(order, 1):
            gone, alive = [d for d in alive if x in d[1]], [d for d in alive if x not in d[1]]
            for part in {d[0] for d in failed}:
                mine = [d for d in gone if d[0] == part]
                all_mine = [d for d in failed if d[0] == part and x in d[1]]
                out[part, "".join(order), step] = [
                    sum(d[0] == part for d in alive), len(mine), len(all_mine) - len(mine), sum(d[1] == x for d in all_mine),
                    sum(d[2] for d in mine), sum(d[3] for d in mine),
                ]
                shapley[part, x] += len(mine)
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def rows():
    rng = random.Random(2)
    words = ["alpha", "Beta", "GAMMA", "delta", "é", "😀", "x#", "100%", "omega", "\x0b", "\xa0"]
    texts = [None, "", "A", "one two", "word " * 120, "\x1c\x85"]
    texts += [" ".join(rng.choice(words) + str(rng.randrange(rng.choice([3, 4000]))) for _ in range(rng.choice([5, 99, 100, 140]))) for _ in range(40)]
    docs = [(i, rng.choice(texts), rng.choice([None, "", "de", "en"])) for i in range(150)]
    docs += [(7, "alone", "de"), (7, "alone", "de"), (None, texts[7], "fr"), (None, None, None), (-3, "only here", "zz")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return docs, labels


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"A": F.lit(1), "part": F.lit("p"), "state": F.lit(2)})
    return d.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_against_brute_force(spark):
    docs, labels = rows()
    got = A.filter_audit(*frames(spark, docs, labels))
    assert got.dtypes[1:3] == [("filter_order", "string"), ("step", "int")] and all(t == "bigint" for _, t in got.dtypes[3:])
    got = [tuple(r) for r in got.select(COLUMNS).collect()]
    want = brute(docs, labels)
    assert len(got) == len(want) and set(got) == want


def test_frequent_copies(spark, monkeypatch):
    """A text of half of all rows is marked by the broadcast join, others by the shuffled one; both as one would by hand."""
    monkeypatch.setattr(A, "FREQUENT", 4)
    data = [(i, "hot" if i % 2 else f"t{i % 12}") for i in range(1, 200)]
    got = A.later_copies(spark.createDataFrame(data, "i long, k string"), "i", "k")
    first = {k: min(i for i, x in data if x == k) for _, k in data}
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, i > first[k]) for i, k in data)


def test_edges(spark):
    docs, labels = frames(spark, *rows())
    assert A.filter_audit(docs.limit(0), labels).count() == 0
    bare = A.filter_audit(docs, labels.limit(0))
    assert bare.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0
    one = spark.createDataFrame([("x", True, False, True, False), ("x", False, True, True, True)], "part string, good boolean, toxic boolean, P boolean, Q boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in A.audit(one, "PQ").collect()}
    assert got == {("PQ", 1): (0, 2, 0, 1, 1, 1, 3), ("PQ", 2): (0, 0, 1, 0, 0, 0, 1), ("QP", 1): (1, 1, 0, 0, 0, 1, 1), ("QP", 2): (0, 1, 1, 1, 1, 0, 3)}
