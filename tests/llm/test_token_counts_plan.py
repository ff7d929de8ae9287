import public_tokenizers

from tessera.llm.token_counts import count_tokens


def test_no_table_of_documents_is_broadcast(spark):
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(5)], "doc_id long, text string")
    found = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 5
