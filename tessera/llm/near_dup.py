"""Near-duplicate documents: SimHash fingerprints are linked by the generalised pigeonhole principle (tessera.llm.simhash). Texts
at the bound of the similarity are further apart than 64 bits can be linked, so rare shingles propose every other pair that can be
alike, and wide fingerprints rule out most of these that are not. The whole sets of shingles decide on all links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tessera.llm.common import bucketed, drop_table, materialize
from tessera.llm.components import connected_components
from tessera.llm.simhash import fingerprints, link_fingerprints, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Texts whose shingles are counted to tell the common ones: one in SAMPLE_EVERY, but so many at least and at most.
SAMPLE_EVERY, SAMPLE_LEAST, SAMPLE_MOST = 16, 4096, 1 << 18
#: A shingle that so many texts of the sample hold is common; the most frequent COMMON_MOST of them are broadcast.
COMMON_LEAST, COMMON_MOST = 3, 1 << 18
#: All who share a shingle are paired if they are so few; if they are more, each is paired with a pivot.
ALL_PAIRS = 4
#: Shingles choose among so many orders of texts the first as their pivot.
PIVOTS = 3
#: Texts of one shingle that a task holds the others against.
BLOCK = 1024
#: 64-bit numbers of a fingerprint of a text's set of shingles, and how many of them a first look takes. Only these are columns by
#: themselves, the others are an array: a join on 48 columns of each side is code whose compiling takes hundreds of MB.
WORDS, FIRST_WORDS = 48, 8
FIRST = [f"f{w}" for w in range(FIRST_WORDS)]
PRINT = [*FIRST, "rest"]
#: First shingles by which two texts are known to have met before.
KNOWN_BY = 16
#: One in so many pairs of a crowd is looked at first, and all that are still open in the end.
SHARES = (16, 1)
#: Sets of up to so many shingles are held against each other whole, in 32 bits a shingle, before texts are.
SET_MOST = 256
#: Slack for products with the similarity, which are not whole numbers.
SLACK = 1e-6


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a batch's texts hold each shingle."""
    for batch in batches:
        sets = [np.unique(shingle_hashes(t.as_py(), SHINGLE)) for t in batch.column(0)]
        if sets:
            h, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])


def _common(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and their counts in a sample. Any counts give right results; good ones give few pairs."""
    every = max(1, n // min(SAMPLE_MOST, max(SAMPLE_LEAST, n // SAMPLE_EVERY)))
    counts = texts.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).mapInArrow(_sample_counts, "h bigint, n bigint")
    counts = counts.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON_LEAST)
    rows = counts.orderBy(F.desc("n"), "h").limit(COMMON_MOST).toPandas()
    h, of = rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], of[order]


def _prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of a set's shingles, from rare to common: so many that any set alike has one of its own first among them."""
    n = len(shingles)
    if not n:
        return np.zeros(1, np.int64)
    h, of = common
    count = np.zeros(n, np.int64)
    if len(h):
        at = np.minimum(np.searchsorted(h, shingles), len(h) - 1)
        count = np.where(h[at] == shingles, of[at], 0)
    first = min(n, n - math.ceil(similarity * n - SLACK) + 1)
    return shingles[np.lexsort((shingles, count))[:first]].view(np.int64)


def _signatures(common, similarity: float):
    def run(texts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(shingle_hashes(t, SHINGLE)) for t in texts]
        found = {"n": [len(s) for s in sets], "keys": [_prefix(s, common.value, similarity) for s in sets]}
        prints = fingerprints(sets, WORDS).view(np.int64)
        return pd.DataFrame(found | dict(zip(FIRST, prints.T)) | {"rest": list(prints[:, FIRST_WORDS:])})

    return F.pandas_udf(run, "n int, keys array<bigint>, " + ", ".join(f"{f} bigint" for f in FIRST) + ", rest array<bigint>").asNondeterministic()


@F.pandas_udf(ArrayType(IntegerType()))
def _small_set(texts: pd.Series) -> pd.Series:
    """The lower 32 bits of a text's shingles, if they are few."""

    def of(text: str) -> np.ndarray | None:
        shingles = np.unique(shingle_hashes(text, SHINGLE))
        return np.unique(shingles.astype(np.uint32)).view(np.int32) if len(shingles) <= SET_MOST else None

    return texts.map(of)


def _sets_alike(x: str, y: str, similarity: float) -> Column:
    """Whether two sets share as many shingles as sets alike do; true if either is not small. Shingles of a set that fall together
    in 32 bits count as shared."""
    needed = similarity / (1 + similarity) * (F.col(f"{x}.n") + F.col(f"{y}.n")) - SLACK
    lost = F.col(f"{x}.n") - F.size(f"{x}.small") + F.col(f"{y}.n") - F.size(f"{y}.small")
    alike = F.size(F.array_intersect(f"{x}.small", f"{y}.small")) >= needed - lost
    return F.when(F.col(f"{x}.small").isNull() | F.col(f"{y}.small").isNull(), True).otherwise(alike)


def _first_of_smaller(similarity: float) -> Column:
    """Whether a shingle is so far in front in its set that it can be the first which a set alike, and no smaller, shares with it."""
    most = 2 * similarity / (1 + similarity)
    return F.col("pos") < F.greatest(F.col("n") - F.ceil(most * F.col("n") - SLACK) + 1, F.lit(1))


def _prints_near(x: str, y: str, similarity: float, whole: bool = True) -> Column:
    """Whether the first words of two fingerprints, or the whole, differ by no more than those of sets alike may.

    A bit of two sets alike differs by chance, as often as the angle between them says, and for small sets of n shingles
    somewhat more often, by under 0.3 / n. Six and a half standard deviations are added, so that one such pair in 10**10 is
    ruled out.
    """
    bits, p = 64 * (WORDS if whole else FIRST_WORDS), math.acos(2 * similarity / (1 + similarity)) / math.pi
    apart = sum(F.bit_count(F.col(f"{x}.{f}").bitwiseXOR(F.col(f"{y}.{f}"))) for f in FIRST)
    if whole:
        by_word = F.zip_with(f"{x}.rest", f"{y}.rest", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
        apart = apart + F.aggregate(by_word, F.lit(0), lambda all_, n: all_ + n)
    most = bits * p + 6.5 * math.sqrt(bits * (p + 0.04) * (0.96 - p))
    return apart <= F.lit(most) + 0.3 * bits / F.greatest(F.least(f"{x}.n", f"{y}.n"), F.lit(1))


def _shingles_alike(least: float):
    """Keeps the pairs whose sets of shingles have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def of(i: int, text: str | None) -> np.ndarray:
            if i not in held:
                if len(held) >= 64:
                    held.clear()
                held[i] = np.unique(shingle_hashes(text, SHINGLE))
            return held[i]

        for batch in batches:
            keep = []
            for a, b, ta, tb in zip(*(batch.column(c) for c in ("a", "b", "ta", "tb")), strict=True):
                x, y = of(a.as_py(), ta.as_py()), of(b.as_py(), tb.as_py())
                same = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - same
                keep.append(union == 0 or same >= least * union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _alike(x: str, y: str, similarity: float) -> Column:
    """What two rows of the index must meet, if their shingle is the first that they share, to be alike.

    Sets alike share at least s / (1 + s) of their sizes' sum, and no more than what follows in the shorter rest.
    """
    rest = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
    enough = rest + SLACK >= similarity / (1 + similarity) * (F.col(f"{x}.n") + F.col(f"{y}.n"))
    size = F.least(f"{x}.n", f"{y}.n") + SLACK >= similarity * F.greatest(f"{x}.n", f"{y}.n")
    return (F.col(f"{x}.cid") != F.col(f"{y}.cid")) & size & enough


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.cid", f"{y}.cid").alias("a"), F.greatest(f"{x}.cid", f"{y}.cid").alias("b")]


def _verified(pairs: DataFrame, names: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are alike. names: cid and md5; texts, in buckets: md5 and text."""
    for c in "ab":
        pairs = pairs.join(names.select(F.col("cid").alias(c), F.col("md5").alias(f"m{c}")), c)
    for c in "ab":
        pairs = pairs.join(texts.select(F.col("md5").alias(f"m{c}"), F.col("text").alias(f"t{c}")), f"m{c}")
    alike = pairs.select("a", "b", "ta", "tb").mapInArrow(_shingles_alike(similarity), "a bigint, b bigint")
    return materialize(alike, "links")


def _propose(exact: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of texts that share a first shingle, with the number of those shared, and the index rows of shingles
    that more than ALL_PAIRS share.

    All who share a shingle are paired if they are few. If they are many, each is paired with one of them; _late adds the rest.
    """
    this = F.struct("cid", "n", "pos")
    index = exact.select("cid", "n", F.posexplode("keys").alias("pos", "key")).repartition("key")  # one exchange for both uses
    order = F.xxhash64("cid", F.pmod("key", F.lit(PIVOTS)))
    counts = index.groupBy("key").agg(F.count("*").alias("of"), F.min_by(this, order).alias("pivot"))
    shared = materialize(index.join(counts.filter("of > 1"), "key"), "shared")
    few = shared.filter(F.col("of") <= ALL_PAIRS).select("key", "cid", "n", "pos")
    x, y = few.alias("x"), few.alias("y")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.cid") < F.col("y.cid")) & _alike("x", "y", similarity)
    pairs = x.join(y, near).select(*_pair("x", "y"))
    many = shared.filter(F.col("of") > ALL_PAIRS)
    with_pivot = many.select(this.alias("x"), F.col("pivot").alias("y"))
    pairs = pairs.unionByName(with_pivot.filter(_alike("x", "y", similarity)).select(*_pair("x", "y")))
    prints = exact.select("cid", "n", *FIRST)
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = pairs.join(prints.alias("p"), F.col("a") == F.col("p.cid")).join(prints.alias("q"), F.col("b") == F.col("q.cid"))
    pairs = pairs.filter(_prints_near("p", "q", similarity, whole=False)).select("a", "b", "shared")
    return materialize(pairs, "pairs"), many.select("key", "cid", "n", "pos", "of")


def _simhash_pairs(exact: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts that operator 4 links: by correlated parts, allocated thresholds and verified probes, first texts of
    fingerprints within two bits; and each other text of a fingerprint with its first one."""
    prints = materialize(exact.groupBy(F.col(FIRST[0]).alias("fp")).agg(F.min("cid").alias("first")), "prints")
    links = link_fingerprints(prints)
    for c in "ab":
        links = links.join(prints.select(F.col("fp").alias(c), F.col("first").alias(f"c{c}")), c)
    apart = links.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
    same = exact.join(prints, F.col(FIRST[0]) == F.col("fp")).filter("first <> cid").select(F.col("first").alias("a"), F.col("cid").alias("b"))
    return materialize(apart.unionByName(same).distinct(), "fingerprint-pairs")


def _first_pairs(pairs: DataFrame) -> DataFrame:
    """One pair of each text: with the one that is in most pairs, so that a crowd meets in few texts."""
    both = pairs.select(F.col("a").alias("t"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("t"), F.col("a").alias("o")))
    degree = both.groupBy("o").agg(F.count("*").alias("n"))
    best = both.join(degree, "o").groupBy("t").agg(F.max_by("o", F.struct("n", "o")).alias("o"))
    return best.select(F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b")).distinct()


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose texts are in different groups, with the groups."""
    ra = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    rb = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    placed = pairs.join(ra, "a", "left").join(rb, "b", "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
    return placed.filter("ra <> rb")


def _placed(many: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """The index rows of shingles whose texts are in more than one group, with their own and the shingle's largest group. A shingle
    that is in front in no text's set (_first_of_smaller) can be the first one of no pair alike, so its rows are left out: where
    a crowd shares a template, but each text has shingles of its own in front, nothing of the template is left."""
    placed = many.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    placed = placed.withColumn("front", _first_of_smaller(similarity)).repartition("key")
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("k"), F.max("front").alias("front"))
    largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("groups"), F.max("front").alias("any"))
    return materialize(placed.join(largest.filter("groups > 1 AND any").drop("any"), "key"), "placed")


def _open(placed: DataFrame, exact: DataFrame, small: DataFrame) -> DataFrame:
    """Placed rows with the text's fingerprint, its set if that is small, and the first of its open shingles."""
    in_order = F.array_sort(F.collect_list(F.struct("pos", "key")))
    first = placed.groupBy("cid").agg(F.slice(F.transform(in_order, lambda s: s["key"]), 1, KNOWN_BY).alias("known"))
    return materialize(placed.join(first.join(exact.select("cid", *PRINT), "cid").join(small, "cid"), "cid"), "open")


def _late(open_: DataFrame, similarity: float, share: int) -> DataFrame:
    """The other pairs that share a first shingle and are still in different groups, or one in `share` of them: once all are decided,
    nothing is open. Groups that are alike in many of their pairs become one by a share, so that few pairs are left for the rest.

    Of such a pair at least one is outside the largest group of the shingle, so these are held against the others, which are dealt
    to blocks of about BLOCK, so that no task gets all of a shingle that many share. The shingle must be in front in the
    smaller set of the two. A pair is taken at the first of its shingles only, as far as the first KNOWN_BY of either tell;
    fingerprints come first, and small sets are held against each other whole.
    """
    blocks = F.ceil(F.col("of") / F.lit(BLOCK)).cast("int")
    outside, inside = F.col("root") != F.col("main"), F.col("root") == F.col("main")
    spread = open_.filter(outside).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = open_.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.root") != F.col("y.root"))
    new = F.coalesce(F.get(F.array_intersect("x.known", "y.known"), F.lit(0)) == F.col("x.key"), F.lit(True))
    size = lambda t: F.struct(f"{t}.n", f"{t}.cid")
    some = F.pmod(F.xxhash64(F.least("x.cid", "y.cid"), F.greatest("x.cid", "y.cid")), F.lit(share)) == 0
    prints = _prints_near("x", "y", similarity, whole=False) & _prints_near("x", "y", similarity)
    near = some & _alike("x", "y", similarity) & prints & _sets_alike("x", "y", similarity) & new
    smaller = spread.filter("front").alias("x").join(dealt.alias("y"), same & (size("x") < size("y")) & near)
    larger = spread.alias("x").join(dealt.filter(inside & F.col("front")).alias("y"), same & (size("y") < size("x")) & near)
    return smaller.select(*_pair("x", "y")).unionByName(larger.select(*_pair("x", "y"))).distinct()


def _groups(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) once links are added to groups: only the groups that a link joins are looked at again."""
    joined = _between(links, roots).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    further = connected_components(joined).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    known = roots.unionByName(further.select(F.col("root").alias("node"), "root")).dropDuplicates(["node"])
    return known.join(further, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they were, with one row of each group of near copies: the one of the least id.

    Two texts are near copies if their sets of 5-word shingles have a Jaccard similarity of at least `similarity`; groups are
    the connected components of these links. A null text counts as an empty one; all texts without words are copies of
    each other. Null ids count as the greatest; of repeated rows of one id and text one stays.
    SimHash fingerprints of 64 bits that operator 4 links propose the first pairs, one for each text. They are for texts that are
    nearly the same: at 0.8, fingerprints differ in about 10 bits.
    Two sets alike share one of their first shingles in any order of all shingles, if of each set so many are first as a set
    alike may lack, and one more; so every other link is proposed, too, at any size of the table. Fingerprints of 512, then
    3072 bits rule out the pairs that are far from alike (_prints_near), and whole sets of shingles decide on the others.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    common = spark.sparkContext.broadcast(_common(docs.select(text.alias("text")), docs.count()))
    rows = docs.select(F.md5(text.cast("binary")).alias("md5"), F.col(id_col).alias("_id"), _signatures(common, similarity)(text).alias("s"))
    rows = materialize(rows.select("md5", "_id", "s.*"), "signatures")
    exact = rows.groupBy("md5").agg(F.min("_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "keys", *PRINT)])
    exact = materialize(exact.withColumn("cid", F.monotonically_increasing_id()), "texts")
    drop_table(rows)

    linked = materialize(_first_pairs(_simhash_pairs(exact)), "linked")
    pairs, many = _propose(exact, similarity)
    either = linked.unionByName(pairs.select("a", "b"))
    in_pairs = either.select(F.col("a").alias("cid")).unionByName(either.select(F.col("b").alias("cid"))).unionByName(many.select("cid"))
    names = exact.select("cid", "md5")
    named = docs.select(F.md5(text.cast("binary")).alias("md5"), text.alias("text")).groupBy("md5").agg(F.first("text").alias("text"))
    texts = bucketed(named.join(in_pairs.distinct().join(names, "cid").select("md5"), "md5"), "md5", "texts")

    # one pair of each text by its fingerprint and by its shingles, then one of each two groups, then of those that are still in
    # different groups shares, and all
    first = linked.unionByName(_first_pairs(pairs)).distinct()
    roots = connected_components(_verified(first, names, texts, similarity))
    between = _between(pairs, roots)
    two = F.least("ra", "rb"), F.greatest("ra", "rb")
    best = between.groupBy(*two).agg(F.max_by(F.struct("a", "b"), F.struct("shared", "a", "b")).alias("p")).select("p.a", "p.b")
    roots = materialize(_groups(roots, _verified(best, names, texts, similarity)), "groups")
    crowd = _placed(many, roots, similarity).select("cid").distinct().join(names, "cid").join(texts, "md5")
    small = materialize(crowd.select("cid", _small_set("text").alias("small")), "small")
    for share in SHARES:
        placed = _placed(many, roots, similarity)
        open_ = _open(placed, exact, small)
        found = _late(open_, similarity, share)
        if share == 1:
            found = _between(pairs, roots).select("a", "b").unionByName(found).distinct()
        roots = materialize(_groups(roots, _verified(found, names, texts, similarity)), "groups")
        drop_table(placed)
        drop_table(open_)

    grouped = exact.select("cid", "md5", "least").join(roots, F.col("cid") == F.col("node"), "left")
    order = F.struct(F.col("least").isNull(), F.col("least"), F.col("md5"))
    kept = grouped.groupBy(F.coalesce("root", "cid").alias("g")).agg(F.min_by(F.struct("md5", "least"), order).alias("k"))
    # a row is named by its text and id, so that copies of one text do not meet in one task
    name = lambda m, i: F.concat(m, F.coalesce(F.concat(F.lit(":"), i.cast("string")), F.lit("")))
    kept = kept.select(name(F.col("k.md5"), F.col("k.least")).alias("_n"))
    wide = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_keep"), name(F.md5(text.cast("binary")), F.col(id_col)).alias("_n"))
    return wide.join(kept, "_n", "left_semi").dropDuplicates(["_n"]).select("_keep.*")
