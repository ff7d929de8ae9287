import base64
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from tessera.llm.bpe import load_ranks

WORDS = {"en": ["the", "and", "with", "that", "thing", "there"], "de": ["der", "und", "nicht", "ist", "über", "oder"]}


def test_whole_pipeline(spark, tmp_path):
    rng = random.Random(12)

    def text(lang, n=60):
        return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "er", "in", "an"]) for _ in range(n))

    docs = {i: (text(lang := rng.choice(list(WORDS))), lang) for i in range(120)}
    passage = " ".join(f"item{k} word" for k in range(8))
    near = docs[3][0].split()
    near[30] = "changed"
    docs[200] = (docs[3][0], docs[3][1])
    docs[201] = (" ".join(near), docs[3][1])
    docs[202] = (text("en") + " " + passage.upper() + ". " + text("en"), "en")
    secret = "token=abcdefgh12345678"
    docs[203] = (text("en") + " " + secret + " " + base64.b64encode(b"my password: hunter2hunter2").decode(), "en")
    docs[204], docs[205], docs[206] = ("1234 5678 !!", "en"), (None, "en"), ("", None)
    rows = [(i, t, lang, "src0", len(t or "")) for i, (t, lang) in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = now.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        assert name == "tokens" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert kept[0] == set(docs) - {204, 205, 206}
    assert kept[1] == kept[0] - {200, 201}
    assert kept[2] == kept[1] - {202}
    assert kept[3] == kept[4] == kept[2]

    clean = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/secret_scan").collect()}
    assert secret not in clean[203] and clean[203].count("[SECRET]") == 2
    assert all(clean[i] == docs[i][0] for i in clean if i != 203)
    ranks = load_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    once = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["tokens"] for r in once} == {i: library.encode_ordinary(t) for i, t in clean.items()}
    assert all(r["n_tokens"] == len(r["tokens"]) for r in once)


def test_empty_repeated_and_null_rows(spark, tmp_path):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(WORDS["en"]) + rng.choice(["", "er", "in"]) for _ in range(40))
    one, two = text(), text()
    rows = [(1, one, "en"), (1, one, "en"), (1, two, "en"), (None, text(), "en"), (None, one, None), (2, None, None), (3, "", "en"), (4, "!!", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    full = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], schema)
    full.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1), (False, 1), (True, 0)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, full.limit(0), str(tmp_path)).count() == 0
