import random

import numpy as np

from tessera.llm import near_dup
from tessera.llm.near_dup import SHINGLE, drop_near_duplicates
from tessera.llm.simhash import fingerprints, shingle_hashes


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def brute_groups(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union == 0 or len(sets[i] & sets[j]) >= 0.8 * union:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_groups(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(60):
        base = [word() for _ in range(rng.randint(30, 200))]
        for _ in range(1 if g % 3 else 40 if g == 0 else 6):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(9000, None), (9001, ""), (None, rows[-1][1]), (5, rows[5][1]), (9002, "one two"), (9003, "one  TWO")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, md5 int")
    out = drop_near_duplicates(df)
    kept = [r["doc_id"] for r in out.collect()]
    groups = {}
    for (d, _), g in zip(rows, brute_groups(rows)):
        groups.setdefault(g, []).append(d)
    want = sorted(min(x for x in ids if x is not None) for ids in groups.values())
    assert out.columns == df.columns
    assert sorted(kept) == want
    assert drop_near_duplicates(df.limit(0)).count() == 0


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def kept_ids(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in drop_near_duplicates(df, **more).collect())


def test_pairs_at_the_bound_are_all_found(spark):
    rng = random.Random(5)
    for similarity in (0.5, 0.8):
        texts = []
        for _ in range(80):
            a = words(rng, 154)
            lack = 50 if similarity == 0.5 else 16  # 100 of 200 shingles, or 134 of 166, are in both
            texts += [" ".join(a), " ".join(a[lack:] + words(rng, lack))]
        assert kept_ids(spark, texts, similarity=similarity) == list(range(0, 160, 2))


def test_clusters_that_share_hot_shingles(spark):
    """Neighbours of a chain are alike, others are not; all shingles are shared by many, also by a second cluster."""
    rng = random.Random(9)
    long = words(rng, 1000)
    chain = [" ".join(long[i : i + 200]) for i in range(0, 801, 20)]
    shared, own = long[:150], words(rng, 50)
    other = [" ".join(shared + own[:48] + words(rng, 2)) for _ in range(30)]
    texts = [t for pair in zip(chain, other + [""] * 11, strict=True) for t in pair]
    rows = list(enumerate(texts))
    groups = {}
    for (d, _), g in zip(rows, brute_groups(rows)):
        groups.setdefault(g, []).append(d)
    assert len(groups) < 6
    assert kept_ids(spark, texts) == sorted(map(min, groups.values()))


def test_pairs_within_a_crowd_that_is_almost_alike(spark):
    """300 texts share a long passage at 0.78; every two of them are alike at 0.81."""
    rng = random.Random(10)
    passage, texts = words(rng, 204), []
    for _ in range(150):
        twin = words(rng, 4)
        texts += [" ".join(passage + twin + words(rng, 24)) for _ in range(2)]
    assert kept_ids(spark, texts) == list(range(0, 300, 2))


def test_repeats_do_not_count(spark):
    rng = random.Random(12)
    a, b = " ".join(words(rng, 200)), " ".join(words(rng, 60))
    assert kept_ids(spark, [a, a + " " + a, b, " ".join([b] * 5), " ".join(words(rng, 200))]) == [0, 2, 4]


def test_crowds_of_one_template(spark):
    """Texts that fill a template in, where a few lie at 0.8 and above: as all pairs say."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for i in range(240):
        words = list(base)
        for k in rng.sample(range(90), rng.choice([1, 2, 2, 3, 3, 4])):
            words[k] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(86)} for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in drop_near_duplicates(d).collect()}
    assert got == set(group) and 20 < len(got) < 230


def nearly_the_same(rng):
    """Crowds of long texts, each with the last of its words changed, and texts by themselves."""
    texts = []
    for size in (1, 2, 5, 90) * 4:
        base = words(rng, 600)
        texts += [" ".join(base[:-1] + words(rng, 1)) for _ in range(size)]
    return texts


def test_pairs_of_like_fingerprints(spark):
    """Operator 4's links between texts: none over two bits, and groups as all pairs within two bits give."""
    texts = nearly_the_same(random.Random(6)) + ["", " "]
    fp = fingerprints([np.unique(shingle_hashes(t, SHINGLE)) for t in texts])[:, 0].tolist()
    rows = [(i, np.uint64(f).view(np.int64).item()) for i, f in enumerate(fp)]
    prints = spark.createDataFrame(rows, f"cid long, {near_dup.PRINT[0]} long")
    got = [(r["a"], r["b"]) for r in near_dup._simhash_pairs(prints).collect()]
    assert len(set(got)) == len(got) and all(a < b and (fp[a] ^ fp[b]).bit_count() <= 2 for a, b in got)

    def groups(pairs):
        group = list(range(len(texts)))
        for a, b in pairs:
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
        return group

    assert groups(got) == groups((a, b) for b in range(len(fp)) for a in range(b) if (fp[a] ^ fp[b]).bit_count() <= 2)


def test_like_fingerprints_propose_links_themselves(spark, monkeypatch):
    """Texts that are nearly the same are found without any pair of shingles; what operator 4 does not link, then is not."""
    texts = nearly_the_same(random.Random(6))
    propose = near_dup._propose
    monkeypatch.setattr(near_dup, "_propose", lambda *a: tuple(found.limit(0) for found in propose(*a)))
    groups = {}
    for d, g in enumerate(brute_groups(list(enumerate(texts)))):
        groups.setdefault(g, []).append(d)
    kept = kept_ids(spark, texts)
    assert set(map(min, groups.values())) <= set(kept) and len(kept) < len(groups) + 20


def test_code_of_the_late_join_is_small(spark, monkeypatch):
    """What Spark compiles for the join of a crowd: with a column for each of 48 words of both sides, compiling took hundreds of MB."""
    rng, late, sizes = random.Random(4), near_dup._late, []
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")

    def measured(*args):
        found = late(*args)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
            code = debug.codegenStringSeq(found.select("*")._jdf.queryExecution().executedPlan())
            sizes.extend(len(code.apply(i)._2()) for i in range(code.size()))
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        return found

    monkeypatch.setattr(near_dup, "_late", measured)
    base = words(rng, 80)
    kept_ids(spark, [" ".join(base[:70] + words(rng, 10)) for _ in range(12)])
    assert sizes and max(sizes) < 45_000
