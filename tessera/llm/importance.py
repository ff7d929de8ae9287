"""Quality selection by importance resampling with hashed n-gram models.

Two bags of hashed word unigrams and bigrams are counted, one over target texts and one over all texts. A text's weight
is the log ratio of its probability under the two; Gumbel noise added to it turns a top-k into a sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Hash buckets of the n-gram models; a model is a vector of so many counts, whatever the corpus.
BUCKETS = 10_000
#: Added to every count.
SMOOTHING = 1.0
#: Bins into which keys are counted at once while the kth is looked for.
BINS = 4096
#: Labelled target rows that the target model reads at most, in expectation; their ids are broadcast.
TARGET_ROWS = 200_000


@lru_cache(maxsize=1 << 18)
def _word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def ngram_buckets(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of a text's lower-cased words and pairs of neighbouring words; words are what white space separates."""
    words = text.lower().split() if text else []
    h = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's bucket counts, for all texts and for target texts."""
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, target in zip(batch.column("text"), batch.column("target"), strict=True):
            seen = np.bincount(ngram_buckets(text.as_py()), minlength=BUCKETS)
            total[0] += seen
            if target.as_py():
                total[1] += seen
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], names=["bucket", "raw", "target"]
    )


def log_ratios(rows: DataFrame) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | all) for each bucket. rows: text, target. BUCKETS rows reach the driver."""
    counts = rows.mapInArrow(_count, "bucket bigint, raw bigint, target bigint")
    counts = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    p = np.full((2, BUCKETS), SMOOTHING)
    if len(counts):
        at = counts["bucket"].to_numpy()
        p[0, at] += counts["raw"].to_numpy()
        p[1, at] += counts["target"].to_numpy()
    p /= p.sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def kth_greatest(rows: DataFrame, key: str, k: int) -> float:
    """The kth greatest value of a column.

    Counts rows in BINS even bins between the bounds, then in the bin that holds the kth, until that bin has one value.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    left = k
    while low < high:
        width = (high - low) / BINS
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col(key) - low) / width)) if width > 0 else F.lit(0)
        inside = rows.filter(F.col(key).between(low, high)).groupBy(bin_.alias("bin"))
        bins = inside.agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if r["n"] >= left:
                low, high = r["a"], r["b"]
                break
            left -= r["n"]
    return low


def resample(
    docs: DataFrame,
    labels: DataFrame,
    keep: float | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """One row per row of docs: id, n_grams, log_weight (of all its n-grams), score, sample_key, selected.

    The target is the texts whose label is 1; of more than TARGET_ROWS, a sample by hash of the id. score is the mean log
    ratio of a text's n-grams. sample_key is log_weight plus Gumbel noise that depends on the id, the text and the seed
    alone. The greatest ceil(keep * texts with words) keys are selected (keep: by default, the labelled ids' share of label
    1, or all without labels), and with the last of them all rows of exactly its key, which are repeated rows. Texts that
    are null or without words have a null key and are never selected. Rows without an id or a label belong to the raw
    texts only. An empty table gives no rows. Other columns are not read.
    """
    if keep is None:
        labelled, target = labels.filter(F.col(label_col).isin(0, 1)).agg(F.count("*"), F.coalesce(F.sum(label_col), F.lit(0))).first()
        keep = target / labelled if labelled else 1.0
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("_lid")).filter("_lid is not null").distinct()
    total = good.count()
    if total > TARGET_ROWS:
        good = good.filter(F.pmod(F.xxhash64("_lid", F.lit(31)), F.lit(1_000_000)) < int(1_000_000 * TARGET_ROWS / total))
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    marked = slim.join(F.broadcast(good), F.col("_id") == F.col("_lid"), "left").select("_id", "text", F.col("_lid").isNotNull().alias("target"))
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(marked.select("text", "target")))

    def weigh(texts: pd.Series) -> pd.DataFrame:
        rows = [ngram_buckets(t) for t in texts]
        return pd.DataFrame({"n": [len(r) for r in rows], "w": [float(ratios.value[r].sum()) for r in rows]})

    weight = F.pandas_udf(weigh, "n bigint, w double").asNondeterministic()
    noise = (F.pmod(F.xxhash64("_id", "text", F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    scored = slim.select("_id", (-F.log(-F.log(noise))).alias("g"), weight(F.col("text")).alias("_w")).select("_id", "g", "_w.*")
    words = F.col("n") > 0
    scored = scored.select(
        "_id", "n", "w",
        F.when(words, F.col("w") / F.col("n")).alias("score"),
        F.when(words, F.col("w") + F.col("g")).alias("key"),
    )
    scored = materialize(scored, "weights")
    with_key = scored.filter("key is not null")
    k = math.ceil(keep * with_key.count())
    if not k:
        return _result(scored, F.lit(False), id_col)
    least = kth_greatest(with_key, "key", k)
    return _result(scored, F.col("key") >= least, id_col)


def _result(scored: DataFrame, selected, id_col: str) -> DataFrame:
    return scored.select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_grams"),
        F.col("w").alias("log_weight"),
        "score",
        F.col("key").alias("sample_key"),
        F.coalesce(selected, F.lit(False)).alias("selected"),
    )
