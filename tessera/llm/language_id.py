"""Language identification with a bit-sliced Bloom filter over letter trigrams.

Position i of the filter holds one bit per language. A trigram is looked up at HASHES positions; the AND of what
they hold is the set of all languages whose filter has the trigram. A text's hits are counted per language,
the share that false positives explain is taken off, and the language with most hits left wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc32_of_id

#: Labelled rows that a fit reads at most, in expectation (a bounded sample, drawn by the hash of the id).
FIT_ROWS = 20_000
#: log2 of the positions of the filter, and positions looked up for a trigram.
LOG2_POSITIONS = 20
HASHES = 3
#: A trigram that is rarer in a language than this fraction of where it is most frequent is a stray there: a name, a word of
#: another language, a label that is wrong. All other languages that have it are in the filter.
SHARE = 0.02
#: Trigrams seen less often than this in a language are noise there.
LEAST_COUNT = 3
#: Languages whose bits fit one word of the filter; more languages take more words.
WORD_BITS = 64
#: Characters whose trigrams are held at once; a longer text is held by itself.
CHUNK_CHARS = 1 << 20

# Odd multipliers of the multiply-shift hashes.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


@cache
def _letters() -> np.ndarray:
    """For each code point, itself if a letter, else 0."""
    out = np.zeros(0x110000, np.uint64)
    points = [c for c in range(0x110000) if chr(c).isalpha()]
    out[points] = points
    return out


def pieces(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of about CHUNK_CHARS, so that the arrays over them stay small."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t) if t else 0
        if n >= CHUNK_CHARS:
            yield held
            held, n = [], 0
    if held:
        yield held


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the letter trigrams of all texts one after the other, and where each text's begin.

    Text is lower-cased; all but letters counts as a space; a trigram's middle is a letter. A key is the three code
    points side by side, so different trigrams have different keys.
    """
    joined = [" " + t.lower() + " " if t else "  " for t in texts]
    sizes = np.fromiter(map(len, joined), np.int64, len(joined))
    points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters()[points]
    middle = np.flatnonzero(letters[1:-1]) + 1
    keys = (letters[middle - 1] << np.uint64(42)) | (letters[middle] << np.uint64(21)) | letters[middle + 1]
    return keys, np.searchsorted(middle, np.cumsum(sizes) - sizes)


def positions(keys: np.ndarray, hashes: int, log2: int) -> Iterator[np.ndarray]:
    mixed = keys ^ (keys >> np.uint64(29))
    for m in _MULTIPLIERS[:hashes]:
        yield (mixed * np.uint64(m)) >> np.uint64(64 - log2)


@dataclass
class LanguageModel:
    languages: list[str]
    words: list[np.ndarray]
    false_rate: np.ndarray
    default: int
    hashes: int = HASHES
    log2: int = LOG2_POSITIONS

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: its trigrams, and per language the hits that false positives do not explain."""
        keys, start = trigrams(texts)
        total = np.diff(np.append(start, len(keys)))
        hits = np.zeros((len(texts), len(self.languages)))
        full = total > 0
        at = list(positions(keys, self.hashes, self.log2)) if len(keys) else []
        for w, word in enumerate(self.words):
            if not at:
                break
            mask = word[at[0]]
            for p in at[1:]:
                mask = mask & word[p]
            for b in range(min(WORD_BITS, len(self.languages) - w * WORD_BITS)):
                bit = ((mask >> np.uint64(b)) & np.uint64(1)).astype(np.int64)
                hits[full, w * WORD_BITS + b] = np.add.reduceat(bit, start[full])
        rate = self.false_rate
        return total, np.maximum(0, (hits - total[:, None] * rate) / (1 - rate))

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        found = [self._predict(part) for part in pieces(texts)]
        return pd.concat(found, ignore_index=True) if found else self._predict([])

    def _predict(self, texts: list[str | None]) -> pd.DataFrame:
        total, hits = self.counts(texts)
        if not self.languages:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)})
        best = hits.argmax(axis=1)
        top = hits[np.arange(len(texts)), best]
        best = np.where(top > 0, best, self.default)
        names = np.array([*self.languages, "und"], object)
        score = np.divide(top, hits.sum(axis=1), out=np.zeros(len(texts)), where=top > 0)
        return pd.DataFrame({"lang_pred": names[np.where(total > 0, best, -1)], "score": np.clip(score, 0, 1)})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of a task's rows, per language."""
    seen: dict[str, pd.Series] = {}
    for batch in batches:
        rows = batch.to_pandas()
        for lang, texts in rows.groupby("lang")["text"]:
            for part in pieces(texts.tolist()):
                keys, n = np.unique(trigrams(part)[0], return_counts=True)
                new = pd.Series(n, index=keys)
                seen[lang] = new if lang not in seen else seen[lang].add(new, fill_value=0)
    for lang, counts in seen.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(counts)), pa.array(counts.index.to_numpy(np.uint64).view(np.int64)), pa.array(counts.to_numpy(np.int64))],
            names=["lang", "key", "n"],
        )


def _set_bits(hashes: int, log2: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            lang = batch.column("l").to_numpy()
            at = [p.astype(np.int64) for p in positions(keys, hashes, log2)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(at) if at else np.empty(0, np.int64)),
                    pa.array(np.tile(lang // WORD_BITS, len(at)).astype(np.int64)),
                    pa.array(np.tile(np.left_shift(np.uint64(1), (lang % WORD_BITS).astype(np.uint64)), len(at)).view(np.int64)),
                ],
                names=["at", "word", "bits"],
            )

    return run


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    fit_rows: int = FIT_ROWS,
    hashes: int = HASHES,
    log2: int = LOG2_POSITIONS,
) -> LanguageModel:
    """Learns the filter from rows whose language is not null; of more than fit_rows, a sample by hash of the id.

    What reaches the driver: one row per language, and the set positions of the filter, 2**log2 at most a word.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"))
    rows = rows.filter("lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], [], np.zeros(0), 0, hashes, log2)
    # each language gets an equal part of the bound, so that rare ones are learned too
    keep = {x: min(1.0, fit_rows / len(languages) / n) for x, n in sizes.items()}
    part = F.create_map(*[F.lit(v) for x in languages for v in (x, keep[x])])
    u = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) / 1_000_000.0
    counts = (
        rows.filter(u < F.element_at(part, F.col("lang")))
        .select("text", "lang")
        .mapInArrow(_count, "lang string, key bigint, n bigint")
        .groupBy("lang", "key")
        .agg(F.sum("n").alias("n"))
    )
    number = F.create_map(*[F.lit(v) for i, x in enumerate(languages) for v in (x, i)])
    totals = counts.groupBy("lang").agg(F.sum("n").alias("of"))
    share = counts.join(F.broadcast(totals), "lang").select("lang", "key", "n", (F.col("n") / F.col("of")).alias("p"))
    top = share.groupBy("key").agg(F.max("p").alias("most"))
    member = share.filter(F.col("n") >= LEAST_COUNT).join(top, "key").filter(F.col("p") >= SHARE * F.col("most"))
    bits = (
        member.select("key", F.element_at(number, F.col("lang")).cast("bigint").alias("l"))
        .mapInArrow(_set_bits(hashes, log2), "at bigint, word bigint, bits bigint")
        .groupBy("at", "word")
        .agg(F.bit_or("bits").alias("bits"))
        .toPandas()
    )
    words = []
    fill = []
    for w in range(math.ceil(len(languages) / WORD_BITS)):
        word = np.zeros(1 << log2, np.uint64)
        mine = bits[bits["word"] == w]
        word[mine["at"].to_numpy()] = mine["bits"].to_numpy(np.int64).view(np.uint64)
        words.append(word)
        for b in range(min(WORD_BITS, len(languages) - w * WORD_BITS)):
            fill.append(((word >> np.uint64(b)) & np.uint64(1)).mean())
    default = max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i))
    return LanguageModel(languages, words, np.minimum(np.array(fill) ** hashes, 0.999), default, hashes, log2)


def language_of(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """struct<lang_pred: string, score: double>; `und` with score 0 where the text is null or has no letter.

    score: the winner's part of all hits left after correction; 0 if no trigram is known, where the most frequent
    language of the fit stands in. Ties go to the language that sorts first.
    """
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return held.value.predict(texts.tolist())

    return predict.asNondeterministic()(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score.

    Learns from the rows whose crc32(id) mod folds is not 0 and whose language is not null; a row whose id is null
    is neither learned from nor held out. Repeated rows are predicted alike; an empty table gives no rows. A null text or one
    without letters is `und`; one of unknown letters gets the most frequent language with score 0; without any label
    there is no language to give, so every text is `und`. Long texts are looked at as a whole. Other columns are not read.
    """
    fold = F.pmod(crc32_of_id(id_col), F.lit(folds))
    model = fit(docs.filter(fold != 0), text_col, lang_col, id_col)
    out = docs.select(
        F.col(id_col),
        F.coalesce(fold == 0, F.lit(False)).alias("held_out"),
        language_of(docs.sparkSession, model, F.col(text_col)).alias("_p"),
    )
    return out.select(id_col, "held_out", "_p.lang_pred", "_p.score")


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns as they were, whose text has a language: not `und`, and some trigram known."""
    model = fit(docs, text_col, lang_col, id_col)
    found = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_keep"), F.col(text_col).alias("_t"))
    found = found.select("_keep", language_of(docs.sparkSession, model, F.col("_t")).alias("_p"))
    return found.filter((F.col("_p.lang_pred") != "und") & (F.col("_p.score") > 0)).select("_keep.*")
