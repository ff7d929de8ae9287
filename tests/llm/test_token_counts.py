import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tessera.llm.bpe import load_ranks
from tessera.llm.token_counts import count_tokens, document_lengths, file_sizes, read_blocks, token_files

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
END = 9


def brute(ids):
    out, n = [], 0
    for x in ids:
        if x == END:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + [(n, False)] * (n > 0)


def test_against_brute_force(spark):
    rng = random.Random(6)
    files = {f: [rng.choice([1, 2, 3, 4, 5, END]) if f % 2 else rng.choice([1] * 40 + [END]) for _ in range(rng.choice([0, 1, 8, 64, 9000]))] for f in range(12)}
    rows = []
    for f, ids in files.items():
        for b in range(0, len(ids), 8):
            rows.append((f, b // 8, bytearray(np.array(ids[b : b + 8], "<i4").tobytes()), "x"))
    rng.shuffle(rows)
    blocks = spark.createDataFrame([*rows, (99, 0, None, "x")], "file long, block long, ids binary, size string")
    got = sorted(map(tuple, document_lengths(blocks, END, 8).collect()))
    assert got == sorted((f, i, n, e) for f, ids in files.items() for i, (n, e) in enumerate(brute(ids)))
    assert document_lengths(blocks.limit(0), END, 8).count() == 0


def test_raw_files(spark, tmp_path):
    """Files of any length, whatever the block: also no multiple of it, shorter than one, cut within an id, or empty."""
    rng = random.Random(7)
    for kind in ("<u2", "<u4"):
        all_, sizes = {}, []
        for size in (4096, 10, 8, 5, 1, 0, 4097, 63, 64, 65):
            all_[size] = [rng.choice([1, 2, 3, END]) for _ in range(size)]
            path = tmp_path / f"t{size}{kind[1:]}.bin"
            path.write_bytes(np.array(all_[size], kind).tobytes() + (b"\x09" if size == 10 else b""))
            sizes.append((f"file://{path}",))
        files = file_sizes(spark.createDataFrame(sizes, "file string"))
        assert {r["file"]: r["size"] for r in files.collect()} == {f: (tmp_path / f.rsplit("/", 1)[1]).stat().st_size for (f,) in sizes}
        for block in (4, 64, 1 << 16):
            got = document_lengths(read_blocks(files, kind, block), END, block, kind).collect()
            found = sorted((int(r["file"].rsplit("/", 1)[1][1:-6]), r["number"], r["n_tokens"], r["ended"]) for r in got)
            assert found == sorted((size, i, n, e) for size, ids in all_.items() for i, (n, e) in enumerate(brute(ids)))


def test_files_hold_the_ids_and_nothing_else(spark):
    """What is written, read back as bytes; wide ids where the end id needs them."""
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(spark, PATH), special_tokens={})
    texts = ["hello world", "", None, "word " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for end, kind in ((50256, "<u2"), (70_000, "<u4")):
        files, order, found = token_files(df, PATH, public_tokenizers.PATTERN, end, ["doc_id"])
        assert found == kind
        for r in files.collect():
            ids = np.fromfile(r["file"].removeprefix("file://"), kind).tolist()
            docs = [texts[x["_keep"]["doc_id"]] for x in order.filter(F.col("file") == r["file"]).orderBy("number").collect()]
            assert ids == [i for t in docs for i in (*library.encode_ordinary(t or ""), end)] and r["size"] == len(ids) * int(kind[2])


def test_documents(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(spark, PATH), special_tokens={})
    docs = [(1, "hello world"), (2, None), (3, ""), (None, "a b c"), (1, "hello world"), (4, "word " * 5000), (5, "<|endoftext|>")]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n_tokens int").repartition(3)
    got = [tuple(r) for r in count_tokens(df, PATH, public_tokenizers.PATTERN, 50256, block_tokens=64).collect()]
    assert sorted(got, key=str) == sorted(((d, len(library.encode_ordinary(t or ""))) for d, t in docs), key=str)
    assert count_tokens(df.limit(0), PATH, public_tokenizers.PATTERN, 50256).count() == 0
