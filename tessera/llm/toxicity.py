"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc32_of_id, materialize

#: Labelled rows that a fit reads at most, in expectation (a bounded sample, drawn by the hash of the id).
FIT_ROWS = 20_000
#: Words of the learned lexicon at most; a word needs this share of the toxic texts, and these odds over the others.
LEXICON_SIZE = 256
LEAST_SUPPORT = 0.03
LEAST_ODDS = 6.0
#: Words between a lexicon word and a second-person word that count as near.
NEAR = 6
#: Every so many fit rows, one is kept from the trees for calibration.
CALIBRATION_PART = 4
TREES, DEPTH, STEP = 20, 4, 0.2

# Second-person words of several languages, and look-alikes of letters.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer ti tus usted ustedes vosotros".split()
)
LOOKALIKES = str.maketrans("013457@$!", "oieastasi", "*.-_")

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?:[0-9@$*!._-]+[^\W\d_]+)+")
FEATURES = (
    "lexicon_density", "lexicon_weight", "lexicon_hits", "lexicon_kinds", "lexicon_strongest", "hidden_hits",
    "near_second_person", "second_person", "capitals", "capital_words", "exclamations", "punctuation", "digits",
    "mixed_words", "repeated_letters", "length",
)


def features_of(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """One number per name in FEATURES; all zero for a text without words."""
    if not text:
        return [0.0] * len(FEATURES)
    words = _WORD.findall(text)
    low = [w.lower() for w in words]
    n = max(1, len(low))
    hits = [i for i, w in enumerate(low) if w in lexicon]
    you = [i for i, w in enumerate(low) if w in SECOND_PERSON]
    mixed = _MIXED.findall(text)
    hidden = [w for w in (m.lower().translate(LOOKALIKES) for m in mixed) if w in lexicon]
    found = [low[i] for i in hits] + hidden
    near = 0
    if hits and you:
        at = np.searchsorted(you, hits)
        ends = np.array([-(10**9), *you, 10**9])
        near = int((np.minimum(np.array(hits) - ends[at], ends[at + 1] - np.array(hits)) <= NEAR).sum())
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(raw, minlength=256)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    punctuation = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    repeated = int(((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] >= 65)).sum())
    weights = [lexicon[w] for w in found]
    return [
        len(found) / n,
        sum(weights) / n,
        math.log1p(len(found)),
        float(len(set(found))),
        max(weights, default=0.0),
        math.log1p(len(hidden)),
        near / n,
        len(you) / n,
        upper / max(1, upper + lower),
        sum(map(str.isupper, words)) / n,
        float(count[33]) / len(raw),
        punctuation / len(raw),
        float(count[48:58].sum()) / len(raw),
        len(mixed) / n,
        repeated / len(raw),
        math.log1p(len(low)),
    ]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base_rate: float


def _with_features(rows: DataFrame, lexicon: dict[str, float], text_col: str) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(lexicon)

    def extract(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features_of(t, held.value))

    found = F.pandas_udf(extract, "array<double>").asNondeterministic()
    wide = rows.withColumn("_f", found(F.col(text_col)))
    wide = wide.select("*", *[F.get("_f", F.lit(i)).alias(f"_f{i}") for i in range(len(FEATURES))]).drop("_f", text_col)
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(FEATURES))], outputCol="_features").transform(wide).drop(
        *[f"_f{i}" for i in range(len(FEATURES))]
    )


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Log odds of the words that toxic texts have far more often. rows: _text, _label (0/1)."""
    toxic, clean = rows.agg(F.coalesce(F.sum("_label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("_label")), F.lit(0))).first()
    words = rows.select("_label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(r"(\p{L}+)"), 1))).alias("w"))
    counts = words.groupBy("w").agg(F.sum("_label").alias("p"), F.sum(1 - F.col("_label")).alias("n"))
    odds = F.log((F.col("p") + 0.5) / (toxic + 1.0)) - F.log((F.col("n") + 0.5) / (clean + 1.0))
    found = counts.filter(F.col("p") >= max(3, LEAST_SUPPORT * toxic)).select("w", "p", odds.alias("odds"))
    best = found.filter(F.col("odds") >= math.log(LEAST_ODDS)).orderBy(F.desc(F.col("odds") * F.col("p")), "w").limit(LEXICON_SIZE)
    return {r["w"]: float(r["odds"]) for r in best.collect()}


def _score_trees(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("_raw", F.get(vector_to_array("probability"), F.lit(1)))


def fit(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learns from the labelled rows given; of more than fit_rows, from a sample by hash of the id.

    An id with several labels counts as its largest; null labels and ids are left out.
    """
    spark: SparkSession = docs.sparkSession
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    known = known.filter("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.max("_label").alias("_label"))
    total = known.count()
    if total > fit_rows:
        known = known.filter(F.pmod(F.xxhash64("_id", F.lit(23)), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total))
    # at most fit_rows rows, in expectation: small enough to be sent to the texts
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")
    rows = materialize(rows, "labelled")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    if toxic in (0, n):
        return ToxicityModel({}, None, None, toxic / n if n else 0.0)
    # rows kept for calibration teach neither the trees nor the lexicon, so their scores are as those of unseen texts
    part = F.pmod(F.xxhash64("_id", F.lit(29)), F.lit(CALIBRATION_PART)) == 0
    lexicon = learn_lexicon(rows.filter(~part))
    ready = materialize(_with_features(rows, lexicon, "_text").withColumn("_held", part), "toxicity-features").repartition(
        spark.sparkContext.defaultParallelism
    )
    grown = ready.filter("not _held")
    if len({r[0] for r in grown.select("_label").distinct().collect()}) < 2:
        grown = ready
    trees = GBTClassifier(
        featuresCol="_features", labelCol="_label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, subsamplingRate=1.0, seed=7
    ).fit(grown)
    shown = _score_trees(trees, ready).select(F.col("_raw"), F.col("_label").cast("double").alias("_label"), "_held")
    held = shown.filter("_held")
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="_label", predictionCol="_score").fit(
        held if held.limit(1).count() else shown
    )
    return ToxicityModel(lexicon, trees, calibration, toxic / n)


def score(rows: DataFrame, model: ToxicityModel, text_col: str) -> DataFrame:
    """rows without the text, with a column _score from 0 to 1."""
    if model.trees is None:
        return rows.drop(text_col).withColumn("_score", F.lit(float(model.base_rate)))
    wide = _score_trees(model.trees, _with_features(rows, model.lexicon, text_col))
    scored = model.calibration.transform(wide)
    return scored.select(*[c for c in rows.columns if c != text_col], F.least(F.greatest("_score", F.lit(0.0)), F.lit(1.0)).alias("_score"))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    folds: int = 4,
    held_out_fold: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    Learns from labels whose crc32(id) mod folds is not held_out_fold. Null and empty texts get the score of a text
    without words; a row whose id is null is scored and not held out. With labels of one value, or none, every score
    is their mean, or 0. Repeated rows are scored alike; an empty table gives no rows; other columns are not read.
    """
    fold = F.pmod(crc32_of_id(id_col), F.lit(folds))
    model = fit(docs, labels.filter(fold != held_out_fold), text_col, id_col, label_col, fit_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(fold == held_out_fold, F.lit(False)).alias("_out"), F.col(text_col).alias("_text"))
    done = score(rows, model, "_text")
    return done.select(
        F.col("_id").alias(id_col),
        F.col("_out").alias("held_out"),
        F.col("_score").alias("score"),
        F.when(F.col("_score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
