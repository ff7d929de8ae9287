"""Token counts of documents in flat, unindexed token files, by a scan for the end-of-document id.

A token file is the concatenation of its documents' ids, each ended by the end-of-document id, and nothing else. Files are read
in numbered blocks of equally many ids, by byte range, which cut documents anywhere; the last block of a file is as long as what is left.
Each block is searched by itself, in one vector comparison; a prefix scan over the blocks of a file then says how many
documents ended before a block and how long the one it continues is.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shared_dir

#: Ids of a block.
BLOCK_TOKENS = 1 << 16
#: Blocks whose ends are scanned by one task, and blocks of a file that one task reads.
SPAN_BLOCKS, STRETCH = 1024, 64
#: Ids that a writing task gathers before it writes them.
FLUSH_TOKENS = 1 << 19


def id_type(end_id: int, ranks: dict[bytes, int]) -> str:
    """How ids are written: in two bytes, if all fit, else in four."""
    return "<u2" if max(end_id, *ranks.values()) < 1 << 16 else "<u4"


def _to_files(held, end_id: int, folder: str, kind: str):
    """One flat file a task, written as documents come. A task that is run again writes a file of another name; only files that
    rows name are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, pattern = held.value
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        out, number = None, 0
        waiting: list[int] = []
        for batch in batches:
            out = out or store.open_output_stream(inner)
            for text in batch.column("_text"):
                waiting += encode(text.as_py() or "")
                waiting.append(end_id)
                if len(waiting) >= FLUSH_TOKENS:
                    out.write(np.array(waiting, kind).tobytes())
                    waiting = []
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * n, pa.string()), pa.array(range(number, number + n), pa.int64()), batch.column("_keep")], names=["file", "number", "_keep"]
            )
            number += n
        if out:
            out.write(np.array(waiting, kind).tobytes())
            out.close()

    return run


def token_files(docs: DataFrame, path: str, pattern: str, end_id: int, keep: list[str], text_col: str = "text") -> tuple[DataFrame, DataFrame, str]:
    """Flat token files of the texts in the shared folder, without special tokens: their (file, size in bytes), which document is where in
    them: (file, number, _keep), where _keep is a struct of the `keep` columns, and the type of their ids."""
    spark = docs.sparkSession
    with open(path, encoding="ascii") as f:
        lines = [x.split() for x in f.read().splitlines() if x]
    ranks = {base64.b64decode(a): int(b) for a, b in lines}
    kind = id_type(end_id, ranks)
    held = spark.sparkContext.broadcast((ranks, pattern))
    slim = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_keep"), F.col(text_col).alias("_text"))
    kept = slim.schema["_keep"].dataType.simpleString()
    folder = f"{shared_dir(spark)}/tessera/tokens-{uuid.uuid4().hex}"
    order = materialize(slim.mapInArrow(_to_files(held, end_id, folder, kind), f"file string, number bigint, _keep {kept}"), "token-order")
    return file_sizes(order.select("file").distinct()), order, kind


def file_sizes(files: DataFrame) -> DataFrame:
    """(file, size in bytes) of files that are named; a file is not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stores = [fs.FileSystem.from_uri(f) for f in batch.column("file").to_pylist()]
            sizes = [store.get_file_info(inner).size for store, inner in stores]
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(sizes, pa.int64())], names=["file", "size"])

    return files.select("file").mapInArrow(run, "file string, size bigint")


def read_blocks(files: DataFrame, kind: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, ids) of flat files of ids of a type (little-endian, of two or four bytes). files: file (a URI) and size; the
    bytes after a file's last whole id are no id. Blocks are read by their byte ranges, a stretch of a file by one task."""
    width = np.dtype(kind).itemsize
    size = width * block_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            for f, block, n in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "n")), strict=True):
                if f != name:
                    store, inner = fs.FileSystem.from_uri(f)
                    name, file = f, store.open_input_file(inner)
                raw = file.read_at(n, block * size)
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.string()), pa.array([block], pa.int64()), pa.array([raw], pa.binary())], names=["file", "block", "ids"])

    whole = F.expr(f"size - size % {width}")
    blocks = files.filter(f"size >= {width}").select("file", whole.alias("size"))
    each = blocks.select("file", "size", F.explode(F.expr(f"sequence(0L, (size - 1) div {size})")).alias("block"))
    each = each.withColumn("n", F.least(F.lit(size), F.col("size") - F.col("block") * size))
    dealt = each.repartition("file", F.expr(f"block div {STRETCH}")).sortWithinPartitions("file", "block")
    return dealt.select("file", "block", "n").mapInArrow(run, "file string, block bigint, ids binary")


def _scan(end_id: int, block_tokens: int, kind: str):
    """Blocks to: their ids, and the places in the file at which documents end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for ids, block in zip(batch.column("ids"), batch.column("block"), strict=True):
                flat = np.frombuffer(ids.as_buffer(), kind)
                sizes.append(len(flat))
                ends.append(np.flatnonzero(flat == end_id) + block.as_py() * block_tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                names=["file", "block", "size", "ends"],
            )

    return run


def document_lengths(blocks: DataFrame, end_id: int, block_tokens: int = BLOCK_TOKENS, kind: str = "<u4") -> DataFrame:
    """(file, number, n_tokens, ended) for each document of each file, numbered from 0; the end ids are not counted.

    Ids after a file's last end are one more document, which has not ended. Two ends side by side hold a document
    without tokens. Files may have any number of blocks, each but a file's last of block_tokens ids. The scan over
    blocks is done within spans of SPAN_BLOCKS blocks, over the spans' sums, and put together, so that no
    task holds a whole file. Blocks whose ids are null are left out; no blocks, no rows.
    """
    of = blocks.schema["file"].dataType.simpleString()
    found = materialize(
        blocks.filter("ids is not null").select("file", "block", "ids").mapInArrow(_scan(end_id, block_tokens, kind), f"file {of}, block bigint, size bigint, ends array<bigint>"),
        "block-ends",
    )
    found = found.withColumn("span", F.expr(f"block div {SPAN_BLOCKS}"))
    n, last = F.size("ends"), F.array_max("ends")
    before = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = found.select(
        "file", "span", "ends", F.sum(n).over(before).alias("n0"), F.max(last).over(before).alias("last0")
    ).filter(F.size("ends") > 0)
    spans = found.groupBy("file", "span").agg(F.sum(n).alias("n"), F.max(last).alias("last"), F.sum("size").alias("size"))
    earlier = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("file", "span", F.sum("n").over(earlier).alias("n1"), F.max("last").over(earlier).alias("last1"))
    placed = inside.join(carried.hint("merge"), ["file", "span"]).select(
        "file",
        "ends",
        (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("first"),
        F.coalesce("last0", "last1", F.lit(-1)).alias("previous"),
    )
    ended = placed.select("file", "first", "previous", "ends", F.posexplode("ends").alias("i", "end")).select(
        "file",
        (F.col("first") + F.col("i")).cast("bigint").alias("number"),
        (F.col("end") - F.when(F.col("i") == 0, F.col("previous")).otherwise(F.get("ends", F.col("i") - 1)) - 1).alias("n_tokens"),
        F.lit(True).alias("ended"),
    )
    rest = spans.groupBy("file").agg(F.sum("n").alias("number"), (F.sum("size") - F.coalesce(F.max("last"), F.lit(-1)) - 1).alias("n_tokens"))
    return ended.unionByName(rest.filter("n_tokens > 0").withColumn("ended", F.lit(False)))


def count_tokens(
    docs: DataFrame, path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """One row per row of docs: id, n_tokens. The texts are tokenized and written as flat token files; the counts come
    from those files alone, and the files' order of documents gives them their ids.

    Ids are written in two bytes, if the vocabulary allows. A null or empty text has no tokens. Null ids and repeated rows are rows of their own; an empty table gives no rows; other
    columns are not read. A text is encoded as a whole, and may fill any number of blocks.

    The last join is a sorted one at any size: files of places and ids are compressed to a byte or so a row, and Spark, which goes
    by their size, would send all rows to the driver, with their files' names.
    """
    files, order, kind = token_files(docs, path, pattern, end_id, [id_col], text_col)
    counts = document_lengths(read_blocks(files, kind, block_tokens), end_id, block_tokens, kind)
    return order.join(counts.hint("merge"), ["file", "number"]).select(F.col(f"_keep.{id_col}").alias(id_col), "n_tokens")
