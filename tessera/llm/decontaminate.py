"""Benchmark decontamination: an FM-index per training shard, searched for the windows of the test items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.fm_index import FMIndex

#: Words of a window.
WINDOW = 10
#: Words of one shard; a longer document is cut into several, which share the words that a window may bridge.
SHARD_WORDS = 1 << 18
#: Bytes of a text that are cut into words at once, and words of a piece of an item.
RUN_BYTES, PIECE_WORDS = 1 << 20, 1 << 15
#: Bytes of test text that one pass holds; more test text is searched in further passes over the documents.
BLOCK_BYTES = 32 << 20
#: Windows that are searched at once.
SEARCHED = 1 << 15

# Bytes that end a word are 00-2F, 3A-60 and 7B-7F once A-Z are lower-cased; they become spaces.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and returns the runs of ASCII letters, digits and all non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def _word_runs(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in runs of about RUN_BYTES, so that a very long text is no list of all its words."""
    raw = text.encode("utf-8", "surrogatepass").translate(_TO_WORDS) if text else b""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + RUN_BYTES) if at + RUN_BYTES < len(raw) else -1
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _item_pieces(window: int):
    """Items to pieces of bounded size: each holds the windows that begin in it. k: words of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("i"), batch.column("t"), strict=True):
                words = words_of(text.as_py())
                k = min(window, len(words))
                first = range(0, len(words) - k + 1, PIECE_WORDS) if k else ()
                pieces = [b" ".join(words[at : at + PIECE_WORDS + k - 1]) for at in first]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * n, pa.string()), pa.array(list(first), pa.int64()), pa.array(pieces, pa.binary()), pa.array([k] * n, pa.int64())],
                    names=["i", "at", "words", "k"],
                )

    return run


def _pattern_block(pieces: Iterator) -> dict:
    """Distinct windows by length, as places in an array of word numbers, and the items that have each.

    pieces: (item, words, words of a window).
    """
    vocab: dict[bytes, int] = {}
    names: dict[str, int] = {}
    parts: dict[int, list[tuple[int, np.ndarray]]] = {}
    for name, words, k in pieces:
        ids = np.fromiter((vocab.setdefault(w, len(vocab)) for w in bytes(words).split()), np.int32)
        parts.setdefault(k, []).append((names.setdefault(name, len(names)), ids))
    lengths = []
    for k, held in sorted(parts.items()):
        ids = np.concatenate([x for _, x in held])
        size = np.array([len(x) for _, x in held])
        begin = np.cumsum(size) - size
        n = size - k + 1
        start = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        item = np.repeat(np.array([i for i, _ in held], np.int32), n)
        mixed = np.zeros(len(start), np.uint64)
        for j in range(k):
            mixed = (mixed ^ ids[start + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        order = np.lexsort((item, mixed))
        start, item, mixed = start[order], item[order], mixed[order]
        same = mixed[1:] == mixed[:-1]
        for j in range(k):  # windows of one hash that differ stay apart
            same &= ids[start[1:] + j] == ids[start[:-1] + j]
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        # an item that has a window many times is named once for it
        once = np.concatenate(([True], ~(same & (item[1:] == item[:-1]))))
        of = np.append(np.cumsum(once)[first] - 1, once.sum())
        lengths.append((k, ids, start[first].astype(np.int32), of.astype(np.int32), item[once]))
    return {"vocab": b" ".join(vocab), "names": list(names), "lengths": lengths}


class _Row:
    """What is known of one document: its words so far, the words hit, and the items."""

    def __init__(self, spans, items):
        self.n, self.spans, self.items, self.tail = 0, [(s["first"], s["end"]) for s in spans or []], set(items or []), []


class _Shard:
    """Words of documents, or of parts of long ones, one after the other with a separator between them."""

    def __init__(self):
        self.local: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.rows: list[_Row] = []
        self.first: list[int] = []
        self.start: list[int] = []
        self.size = 0

    def begin(self, row: _Row) -> None:
        self._put(np.zeros(1, np.int32))
        self.rows.append(row)
        self.first.append(row.n - len(row.tail))
        self.start.append(self.size)
        self.add(row.tail)

    def add(self, words: list[bytes]) -> None:
        local = self.local
        self._put(np.fromiter((local.setdefault(w, len(local) + 1) for w in words), np.int32, len(words)))

    def _put(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.size += len(ids)

    def search(self, block: dict, known: list[bytes]) -> None:
        """Adds every occurrence of the block's windows to the documents."""
        if not block["lengths"] or not self.local:
            return
        index = FMIndex(np.concatenate(self.parts), len(self.local) + 1)
        start = np.array(self.start)
        number = np.fromiter((self.local.get(w, 0) for w in known), np.int32, len(known))
        for k, ids, at, of, items in block["lengths"]:
            mine = number[ids]
            absent = np.concatenate(([0], np.cumsum(mine == 0)))
            can = np.flatnonzero(absent[at + k] == absent[at])
            for some in np.array_split(can, max(1, -(-len(can) // SEARCHED))):
                lo, hi = index.search(mine[at[some][:, None] + np.arange(k)])
                hit = np.flatnonzero(hi > lo)
                count = hi[hit] - lo[hit]
                which = np.repeat(some[hit], count)
                where = index.locate(np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - lo[hit], count))
                self._note_spans(np.sort(where), start, k)
                self._note_items(np.searchsorted(start, where, side="right") - 1, which, of, items, block["names"])
        for row in self.rows:
            if len(row.spans) > 1:
                row.spans = _merge(row.spans)

    def _note_spans(self, where: np.ndarray, start: np.ndarray, k: int) -> None:
        """Words hit, from places in rising order; occurrences that overlap or touch are one span."""
        if not len(where):
            return
        piece = np.searchsorted(start, where, side="right") - 1
        begins = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (where[1:] > where[:-1] + k))))
        ends = where[np.append(begins[1:] - 1, len(where) - 1)] + k
        for p, a, b in zip(piece[begins].tolist(), where[begins].tolist(), ends.tolist(), strict=True):
            at = self.first[p] - self.start[p]
            self.rows[p].spans.append((at + a, at + b))

    def _note_items(self, piece: np.ndarray, which: np.ndarray, of: np.ndarray, items: np.ndarray, names: list[str]) -> None:
        """The items of each piece's windows, each once."""
        pairs = np.unique(piece * np.int64(len(of)) + which)
        piece, which = pairs // len(of), pairs % len(of)
        count = of[which + 1] - of[which]
        item = items[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - of[which], count)]
        found = np.unique(np.repeat(piece, count) * np.int64(len(names)) + item)
        for p, i in zip((found // len(names)).tolist(), (found % len(names)).tolist(), strict=True):
            self.rows[p].items.add(names[i])


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


_SPANS_ARROW = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_SPANS = "array<struct<first: bigint, end: bigint>>"


def _pass(block: Broadcast, window: int, shard_words: int, more: bool):
    """One pass over the documents: adds a block's occurrences to the spans and items found so far."""

    def done(rows: list[_Row], held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in held:
            mine, rows = rows[: part.num_rows], rows[part.num_rows :]
            spans = [[{"first": a, "end": b} for a, b in _merge(r.spans)] for r in mine]
            out = [part.column("_keep"), pa.array([r.n for r in mine], pa.int64()), pa.array(spans, _SPANS_ARROW)]
            out.append(pa.array([sorted(r.items) for r in mine], pa.list_(pa.string())))
            names = ["_keep", "_n_words", "_spans", "_items"]
            if more:
                out, names = [*out, part.column("_text")], [*names, "_text"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value["vocab"].split()
        shard, rows, held = _Shard(), [], []
        for batch in batches:
            begun = 0
            for i, (text, spans, items) in enumerate(zip(batch.column("_text"), batch.column("_spans"), batch.column("_items"), strict=True)):
                row = _Row(spans.as_py(), items.as_py())
                rows.append(row)
                shard.begin(row)
                for words in _word_runs(text.as_py()):
                    shard.add(words)
                    row.n += len(words)
                    row.tail = (row.tail + words)[-(window - 1) :] if window > 1 else []
                    if shard.size >= shard_words:
                        shard.search(block.value, known)
                        shard = _Shard()
                        shard.begin(row)
                        if rows[:-1]:
                            yield from done(rows[:-1], [*held, *([batch.slice(begun, i - begun)] if i > begun else [])])
                            rows, held, begun = [row], [], i
            if begun < batch.num_rows:
                held.append(batch.slice(begun))
        shard.search(block.value, known)
        yield from done(rows, held)

    return run


def find_windows(
    docs: DataFrame,
    bench: DataFrame,
    keep: list[str],
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Columns _keep (a struct of the `keep` columns), _n_words, _spans (merged hit words [first, end)), _items (sorted).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.
    Nulls: a null text has no words; an item whose id is null is named by the empty string. Repeated rows of docs are
    rows of their own; rows of bench with one id are one item. Either table may be empty. Only the columns named are read.
    All words of a shard are indexed, once for a block; the test text is cut into pieces, broadcast in blocks of about
    block_bytes whatever its rows and ids, one pass over docs each.
    """
    spark = docs.sparkSession
    items = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(item_text_col).alias("t"))
    pieces = materialize(items.mapInArrow(_item_pieces(window), "i string, at bigint, words binary, k bigint"), "test-pieces")
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    now = docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("_keep"),
        F.col(text_col).alias("_text"),
        F.lit(None).cast(_SPANS).alias("_spans"),
        F.lit(None).cast("array<string>").alias("_items"),
    )
    kept = now.schema["_keep"].dataType.simpleString()
    for b in range(blocks):
        mine = pieces.filter(F.pmod(F.xxhash64("i", "at", "words"), F.lit(blocks)) == b).select("i", "words", "k")
        block = spark.sparkContext.broadcast(_pattern_block(mine.toLocalIterator(prefetchPartitions=True)))
        more = b < blocks - 1
        schema = f"_keep {kept}, _n_words bigint, _spans {_SPANS}, _items array<string>" + ", _text string" * more
        now = now.mapInArrow(_pass(block, window, shard_words, more), schema)
    return now


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items_sha256, contaminated, spans (merged, in words)."""
    found = find_windows(docs, bench, [id_col], **options)
    return found.select(
        F.col(f"_keep.{id_col}").alias(id_col),
        F.col("_n_words").alias("n_words"),
        F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"]).alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"),
        F.col("_spans").alias("spans"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, all columns as they were."""
    found = find_windows(docs, bench, docs.columns, **options)
    return found.filter(F.size("_spans") == 0).select("_keep.*")
