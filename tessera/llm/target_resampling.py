"""Importance resampling towards a target text, scored without exploding: each document's n-grams become an array of hash
buckets by higher-order functions, and its weight is a fold of that array over the buckets' gains, which are a literal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.importance import kth_greatest

#: Hash buckets: as many counts, and gains, whatever the corpus.
BUCKETS = 10_000
#: Words of a feature, at most.
LONGEST = 3
#: A document needs so many words to be drawn.
LEAST_WORDS = 20
#: Fixed value: what a hash's first 8 hexadecimal digits stay below.
_HASHES = 4294967296


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case: runs of ASCII letters and digits and of all other characters beyond ASCII. A
    word beyond ASCII is changed letter by letter, for its other capitals stay; null has no words."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), F.lit(0))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = lambda w: F.octet_length(w) == F.char_length(w)
    return F.transform(found, lambda w: F.when(plain(w), F.lower(w)).otherwise(F.translate(w, capitals, capitals.lower())))


def buckets(ws: Column) -> Column:
    """The bucket of each run of one to LONGEST words. The words are bound once, so that no run finds them anew."""

    def runs(ws: Column, n: int) -> Column:
        starts = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(0)))
        joined = lambda w, i: F.concat_ws(" ", w, *[F.get(ws, i + k) for k in range(1, n)])
        return F.transform(starts, lambda w, i: (F.crc32(joined(w, i).cast("binary")) % BUCKETS).cast("smallint"))

    return F.get(F.transform(F.array(ws), lambda x: F.concat(*[runs(x, n) for n in range(1, LONGEST + 1)])), F.lit(0))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's features in each bucket that has any."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        flat = batch.column("buckets").flatten()
        total += np.bincount(flat.to_numpy(zero_copy_only=False).astype(np.int64), minlength=BUCKETS)
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["bucket", "n"])


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """Features in each bucket; rows: buckets. What tasks have counted is shuffled, and BUCKETS rows reach the driver."""
    counted = rows.select("buckets").mapInArrow(_tally, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS, np.int64)
    total[counted["bucket"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for each bucket of s of the raw text's S features and t of the target's T."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weight(found: Column, gain: np.ndarray) -> Column:
    """The sum of the gains of an array of buckets."""
    table = F.split(F.lit(",".join(map(str, gain.tolist()))), ",").cast("array<bigint>")
    return F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, b: acc + F.element_at(table, b.cast("int") + 1))


def noise(id_col: str, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), u of the first 8 hexadecimal digits of the sha256 of seed:id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("bigint").cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(float(_HASHES)))))


def draw(scored: DataFrame, k: int) -> DataFrame:
    """scored with a column rank: 1 to k by falling score, then rising _id, of the rows that may be drawn; null for others.

    The kth score is found by counting; only rows that reach it are sorted, by ranges, so that no task holds them all. Their
    places within a range, and the sizes of the ranges before, make the rank. scored: a written table with _id, score,
    _may and _row, a number of its own for each row, which puts equal rows in order.
    """
    none = F.lit(None).cast("bigint")
    if not k:
        return scored.withColumn("rank", none)
    least = kth_greatest(scored.filter("_may"), "score", k)
    reaches = F.col("_may") & (F.col("score") >= least)
    order = [F.desc("score"), F.asc("_id"), F.asc("_row")]
    best = scored.filter(reaches).repartitionByRange(*order).sortWithinPartitions(*order)
    best = materialize(best.withColumn("_place", F.monotonically_increasing_id()), "draw")
    # the upper bits are the number of the range, the lower 33 the place in it
    part, place = F.shiftright("_place", 33).cast("int"), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = dict(best.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes) + 1))])
    starts = F.split(F.lit(",".join(map(str, before.tolist()))), ",").cast("array<bigint>")
    rank = F.element_at(starts, part + 1) + place + 1
    drawn = best.withColumn("rank", F.when(rank <= k, rank)).drop("_place")
    return drawn.unionByName(scored.filter(~reaches).withColumn("rank", none))


def target_resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, n_features, weight, score, rank.

    Features are all runs of 1 to LONGEST words, with repeats. weight is the sum of their buckets' gains, which compare the
    counts of all of docs with those of all target texts; score is weight plus Gumbel noise of the id and the seed. Of the
    N rows with LEAST_WORDS words or more, the floor(percent * N / 100) of greatest score, the smaller id first among
    equals, have ranks from 1; the others have a null rank.

    Null or empty texts have no features and weight 0. Rows without an id have a null score, count as features, and are not
    among the N. Repeated rows are rows of their own. An empty target has no counts; an empty table gives no rows. Other
    columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_words"))
    rows = materialize(slim.select("_id", F.size("_words").alias("n_words"), buckets(F.col("_words")).alias("buckets")), "buckets")
    gain = gains(bucket_counts(rows), bucket_counts(target.select(buckets(words(F.col(target_col))).alias("buckets"))))
    scored = rows.select(
        "_id", F.size("buckets").cast("bigint").alias("n_features"), weight(F.col("buckets"), gain).alias("weight"), "n_words"
    ).withColumn("score", F.col("weight") + noise("_id", seed))
    may = F.col("_id").isNotNull() & (F.col("n_words") >= LEAST_WORDS)
    scored = materialize(scored.select("*", may.alias("_may"), F.monotonically_increasing_id().alias("_row")), "scores")
    k = percent * scored.filter("_may").count() // 100
    return draw(scored, k).select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank")
