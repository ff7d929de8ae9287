"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens, chunk by chunk. A chunk keeps, for each document, its pre-tokens in order of position as
numbers into the chunk's list of distinct words; the words themselves are dealt out by hash, so that all
chunks' copies of a word meet in one place and the word is encoded once. The ids come back to the chunks, where the
documents are put together by position.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pre-tokens of a chunk, about; a longer document is a chunk of its own.
CHUNK_WORDS = 1_200_000
#: Words up to so many bytes are merged by scanning, longer ones with a heap.
SCAN_BYTES = 64
#: Tokens of one batch of documents, about.
BATCH_TOKENS = 500_000

#: Distinct words of a bucket whose ids are held at once; beyond, a word may be encoded again.
HELD_WORDS = 1 << 20

# The characters with the Unicode property White_Space.
_SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: What a splitting pattern may be made of: endings after an apostrophe, runs of one class behind at most one space, and
#: white space. In such a pattern white space and what follows it splits alike wherever it stands.
_ALTERNATIVE = re.compile(r"'[a-z]+| \?(?:\\p\{[LN]\}|\[\^\\s\\p\{L\}\\p\{N\}\])\+|\\s\+(?:\(\?!\\S\))?")


@cache
def _library_class(name: str) -> str:
    """The characters that the tokenizer library takes as letters (L) or numbers (N), as ranges for a character set. The
    Unicode version of the library at hand decides, not that of the regular expressions used here."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    probe = tiktoken.Encoding("probe", pat_str=rf"\p{{{name}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return _ranges([ord(c) for c in bytes(probe.encode_ordinary(every)).decode()])


def _ranges(points: list[int]) -> str:
    at = np.array(points)
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    last = np.append(first[1:], len(at)) - 1
    return "".join(rf"\U{at[a]:08x}-\U{at[b]:08x}" for a, b in zip(first.tolist(), last.tolist(), strict=True))


@dataclass
class Splitter:
    """Cuts texts into pre-tokens as the tokenizer library does.

    quick: the pattern with white space spelled out; exact: with letters and numbers, too, which is slower and used where a
    character occurs on which libraries differ (odd).
    """

    quick: str
    exact: str
    odd: str

    def compiled(self) -> Callable[[str], list[str]]:
        quick, exact = regex.compile(self.quick).findall, regex.compile(self.exact).findall
        odd = re.compile(f"[{self.odd}]").search if self.odd else lambda text: None
        return lambda text: exact(text) if odd(text) else quick(text)


def splitter(pattern: str) -> Splitter:
    """The splitter of a pattern; an error if it has other parts than those in _ALTERNATIVE."""
    for part in pattern.split("|"):
        if not _ALTERNATIVE.fullmatch(part):
            raise ValueError(f"this splitting pattern is not supported: {part}")
    quick = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
    exact, odd = quick, set()
    for name in "LN":
        known = _library_class(name)
        exact = exact.replace(rf"\p{{{name}}}", "\0")
        inside = re.sub(r"\[\^[^\]]*\]", lambda m: m[0].replace("\0", known), exact)
        exact = inside.replace("\0", f"[{known}]")
        ours, theirs = regex.compile(rf"\p{{{name}}}"), re.compile(f"[{known}]")
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        odd |= set(ours.findall(every)) ^ set(theirs.findall(every))
    return Splitter(quick, exact, _ranges(sorted(map(ord, odd))) if odd else "")


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file; a URL is read by Spark, a plain path by the driver."""
    if "://" in path:
        lines = [r[0] for r in spark.read.text(path).collect()]
    else:
        with open(path, encoding="ascii") as f:
            lines = f.read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in map(str.split, filter(None, lines))}


def encode_word(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the pair of lowest rank, the leftmost of equal ones, until no pair of neighbours is a token."""
    if raw in ranks:
        return [ranks[raw]]
    if len(raw) > SCAN_BYTES:
        return _encode_long(raw, ranks)
    parts = [raw[i : i + 1] for i in range(len(raw))]
    none = len(ranks) + 256
    costs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while costs and (least := min(costs)) < none:
        i = costs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            costs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _encode_long(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs and links between neighbours: n log n steps."""
    n = len(raw)
    end = list(range(1, n + 1))  # a part starts at i and ends at end[i]
    before = list(range(-1, n - 1))
    alive = bytearray([1]) * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(raw[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, to = heapq.heappop(heap)
        if not alive[i] or end[i] != j or not alive[j] or end[j] != to:
            continue
        alive[j] = 0
        end[i] = to
        if to < n:
            before[to] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[raw[i : end[i]]])
        i = end[i]
    return out


def _pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


_BUCKET = pa.struct([("codes", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary())])


def _build(split_as: Splitter, buckets: int, chunk_words: int):
    """Documents to chunks: one row a chunk, with its words dealt into buckets by hash."""

    def chunk(number: int, keep: list[pa.Array], sizes: list[int], codes: list[int], words: dict[str, int]) -> pa.RecordBatch:
        # frequent words get small numbers, so that the planes compress
        old = np.array(codes, np.int64)
        order = np.argsort(-np.bincount(old, minlength=len(words)), kind="stable")
        new = np.empty(len(words), np.int64)
        new[order] = np.arange(len(words))
        raw = [w.encode() for w in words]
        of = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
        parts = []
        for mine in _by_bucket(of, buckets):
            parts.append(
                {
                    "codes": _pack(new[mine]),
                    "sizes": _pack(np.array([len(raw[i]) for i in mine], np.int64)),
                    "words": zstandard.ZstdCompressor(level=3).compress(b"".join(raw[i] for i in mine)),
                }
            )
        kept = pa.concat_arrays(keep)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.StructArray.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept),
                        pa.array([_pack(np.array(sizes, np.int64))], pa.binary()),
                        pa.array([_pack(new[old])], pa.binary()),
                        pa.array([parts], pa.list_(_BUCKET)),
                    ],
                    names=["keep", "sizes", "codes", "buckets"],
                ),
            ],
            names=["chunk", "data"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = split_as.compiled()
        number = TaskContext.get().partitionId() << 32
        words: dict[str, int] = {}
        units: dict[str, tuple[int, ...]] = {}
        keep: list[pa.Array] = []
        sizes: list[int] = []
        codes: list[int] = []
        for batch in batches:
            begun = 0
            for i, text in enumerate(batch.column("text")):
                at = len(codes)
                # each unit of white space and what follows it is split once
                for unit in _UNIT.findall(text.as_py() or ""):
                    found = units.get(unit)
                    if found is None:
                        found = units[unit] = tuple([words.setdefault(w, len(words)) for w in split(unit)])
                    codes += found
                sizes.append(len(codes) - at)
                if len(codes) >= chunk_words:
                    keep.append(batch.column("keep").slice(begun, i + 1 - begun))
                    yield chunk(number, keep, sizes, codes, words)
                    number, begun = number + 1, i + 1
                    words, units, keep, sizes, codes = {}, {}, [], [], []
            if begun < batch.num_rows:
                keep.append(batch.column("keep").slice(begun))
        if sizes:
            yield chunk(number, keep, sizes, codes, words)

    return run


def _by_bucket(of: np.ndarray, buckets: int) -> list[np.ndarray]:
    order = np.argsort(of, kind="stable")
    return np.split(order, np.searchsorted(of[order], np.arange(1, buckets)))


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk and bucket that has words."""
    for batch in batches:
        for number, data in zip(batch.column("chunk"), batch.column("data"), strict=True):
            full = [(b, x["sizes"], x["words"]) for b, x in enumerate(data["buckets"].as_py()) if len(_unpack(x["sizes"]))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number.as_py()] * len(full), pa.int64()),
                    pa.array([b for b, _, _ in full], pa.int32()),
                    pa.array([s for _, s, _ in full], pa.binary()),
                    pa.array([w for _, _, w in full], pa.binary()),
                ],
                names=["chunk", "bucket", "sizes", "words"],
            )


def _encode(ranks):
    """Encodes each distinct word of a bucket once; rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        known: dict[bytes, list[int]] = {}
        last = None
        for batch in batches:
            out = []
            for bucket, sizes, words in zip(*(batch.column(c) for c in ("bucket", "sizes", "words")), strict=True):
                if bucket.as_py() != last:
                    known, last = {}, bucket.as_py()
                raw = zstandard.ZstdDecompressor().decompress(words.as_py())
                at, counts, ids = 0, [], []
                for n in _unpack(sizes.as_py()).tolist():
                    word = raw[at : at + n]
                    at += n
                    found = known.get(word)
                    if found is None:
                        if len(known) >= HELD_WORDS:
                            known.clear()
                        found = known[word] = encode_word(word, table)
                    counts.append(len(found))
                    ids += found
                out.append((_pack(np.array(counts, np.int64)), _pack(np.array(ids, np.int64))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("chunk"),
                    batch.column("bucket"),
                    pa.array([c for c, _ in out], pa.binary()),
                    pa.array([i for _, i in out], pa.binary()),
                ],
                names=["chunk", "bucket", "counts", "ids"],
            )

    return run


def _assemble(table):
    """Chunks and the ids of their words to documents' ids and, with a token-byte table, the bytes these decode to."""

    def documents(keep: pa.Array, ends: list[int], tokens: list[np.ndarray]) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens)))
        if table is None:
            return pa.RecordBatch.from_arrays([keep, lists], names=["_keep", "_tokens"])
        raw = pa.array([decode_tokens(x, table.value) for x in tokens], pa.binary())
        return pa.RecordBatch.from_arrays([keep, lists, raw], names=["_keep", "_tokens", "_bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, found in zip(batch.column("data"), batch.column("found"), strict=True):
                buckets = data["buckets"]
                codes, counts, flat = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for row in found.as_py() or []:
                    codes.append(_unpack(buckets[row["bucket"]]["codes"].as_py()))
                    counts.append(_unpack(row["counts"]))
                    flat.append(_unpack(row["ids"]))
                code, count, ids = (np.concatenate(x).astype(np.int64) for x in (codes, counts, flat))
                start = np.zeros(len(code), np.int64)
                length = np.zeros(len(code), np.int64)
                start[code] = np.cumsum(count) - count
                length[code] = count
                position = _unpack(data["codes"].as_py())
                keep = data["keep"].values
                at, done, tokens, ends = 0, 0, [], [0]
                for i, n in enumerate(_unpack(data["sizes"].as_py()).tolist()):
                    words = position[at : at + n]
                    at += n
                    k = length[words]
                    index = np.arange(k.sum()) + np.repeat(start[words] - np.cumsum(k) + k, k)
                    tokens.append(ids[index].astype(np.int32))
                    ends.append(ends[-1] + len(index))
                    if ends[-1] >= BATCH_TOKENS:
                        yield documents(keep.slice(done, i + 1 - done), ends, tokens)
                        done, tokens, ends = i + 1, [], [0]
                if tokens:
                    yield documents(keep.slice(done, len(tokens)), ends, tokens)

    return run


def decode_tokens(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table: as long as the vocabulary."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for raw, i in ranks.items():
        table[i] = raw
    return table


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    keep: list[str],
    text_col: str = "text",
    chunk_words: int = CHUNK_WORDS,
    decode: bool = False,
) -> DataFrame:
    """Columns _keep (a struct of the `keep` columns) and _tokens (array<int>) for each row of docs; with decode, also
    _bytes, to which the ids decode by the token-byte table.

    Each match of the pattern is encoded separately, without special tokens. A null or empty text has no tokens. Repeated
    rows are rows of their own; an empty table gives no rows. Words are dealt into as many buckets as there are
    shuffle partitions; a chunk, and up to HELD_WORDS distinct words, are what a task holds. Only patterns that
    splitter() knows are taken.
    """
    spark = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("keep"), F.col(text_col).alias("text"))
    kept = rows.schema["keep"].dataType.simpleString()
    bucket = "struct<codes: binary, sizes: binary, words: binary>"
    data = f"struct<keep: array<{kept}>, sizes: binary, codes: binary, buckets: array<{bucket}>>"
    # both uses below read this one exchange
    chunks = rows.mapInArrow(_build(splitter(pattern), parts, chunk_words), f"chunk bigint, data {data}").repartition(parts, "chunk")
    words = chunks.mapInArrow(_deal, "chunk bigint, bucket int, sizes binary, words binary")
    encoded = (
        words.repartition(parts, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_encode(spark.sparkContext.broadcast(ranks)), "chunk bigint, bucket int, counts binary, ids binary")
    )
    back = encoded.repartition(parts, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts", "ids")).alias("found"))
    joined = chunks.hint("shuffle_hash").join(back, "chunk", "left").select("data", "found")
    table = spark.sparkContext.broadcast(token_bytes(ranks)) if decode else None
    return joined.mapInArrow(_assemble(table), f"_keep {kept}, _tokens array<int>" + ", _bytes binary" * decode)


def decoded(spark: SparkSession, ranks: dict[bytes, int], tokens: Column) -> Column:
    """The bytes of the tokens, looked up in the token-byte table, which is as long as the vocabulary."""
    held = spark.sparkContext.broadcast(token_bytes(ranks))

    def decode(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: decode_tokens(x, held.value), na_action="ignore")

    return F.pandas_udf(decode, "binary").asNondeterministic()(tokens)


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256.

    A null or empty text has no tokens and decodes to no bytes. Null and repeated ids are rows of their own; an empty table
    gives no rows; other columns are not read. Decoding looks ids up in the token-byte table, which every task holds.
    """
    ranks = load_ranks(docs.sparkSession, path)
    out = encode(docs, ranks, pattern, [id_col], text_col, decode=True)
    return out.select(
        F.col(f"_keep.{id_col}").alias(id_col),
        F.size("_tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("_tokens").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("_bytes", 256).alias("decoded_sha256"),
    )
