import hashlib
import random
from functools import cache

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm.bpe import _UNIT, bpe_digests, decoded, encode, encode_word, load_ranks, splitter

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks(spark):
    return load_ranks(spark, PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(4)
    alphabet = ["a", "the", "don't", " ", "  ", "\n", "\r\n", "\t", "é", "ß", "日本", "123", "٣", "!?", "\x1c", "\x85", "　", "​", "😀", "'s", "'ll", "_", "\x00", "Ⅷ", "²", "﻿", "é"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return out + ["x" * 3000, " " * 500 + "end", "end" + " " * 500, "abc def " * 2000, "ab" * 700 + "日" * 300, "<|endoftext|>"]


def test_words_as_the_library(ranks, library):
    split = splitter(public_tokenizers.PATTERN).compiled()
    for t in texts():
        assert [i for w in split(t) for i in encode_word(w.encode(), ranks)] == library.encode_ordinary(t), t


def test_every_code_point_as_the_library(ranks, library):
    """Between letters, digits, signs and spaces, all characters fall into the classes that the library has them in."""
    split, word = splitter(public_tokenizers.PATTERN).compiled(), cache(lambda w: encode_word(w.encode(), ranks))
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    for at in range(0, len(points), 20_000):
        for c in ("a{0}1{0}! {0}a",):
            text = " ".join(c.format(chr(p)) for p in points[at : at + 20_000])
            got = [i for unit in _UNIT.findall(text) for w in split(unit) for i in word(w)]
            assert got == library.encode_ordinary(text), hex(points[at])


def test_other_patterns_are_refused():
    for pattern in (r"\p{L}+|\s+", r"\w+", r" ?\p{Lu}+|\s+", r"a b|\s+"):
        with pytest.raises(ValueError):
            splitter(pattern)


def test_documents(spark, ranks, library):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(-1, None, "x"), (-2, "", "x"), (None, "hi there", "x"), (3, texts()[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    got = [tuple(r) for r in bpe_digests(df, PATH, public_tokenizers.PATTERN).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    small = encode(df, ranks, public_tokenizers.PATTERN, df.columns, chunk_words=50)
    back = small.select("_keep.*", decoded(spark, ranks, F.col("_tokens")).alias("b")).collect()
    assert len(back) == len(rows) and all(bytes(r["b"]) == (r["text"] or "").encode() for r in back)
    assert bpe_digests(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
