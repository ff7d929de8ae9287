"""SentencePiece encoding and decoding for vocabularies of merges, by a score-ordered agenda of adjacent symbol pairs.

A text starts as its characters. The agenda holds the pairs of neighbours that are pieces of the vocabulary; the pair of
the greatest score, the leftmost of equal ones, is merged until none is left. Two characters that stand side by side in no
piece can never come to lie in one, so a text falls into words before spaces, and words into runs, that are merged by
themselves; a word that a worker has met before has its ids already. The new short words of a batch of texts are merged side
by side, each with an agenda of its own. In each batch, the library encodes the new words and decodes all ids, too; a
difference is an error.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache, partial
from itertools import groupby
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

#: The character that stands for a space within pieces. Fixed value of the file format.
SPACE = "▁"
#: What the unknown id decodes to. Fixed value of the file format.
UNKNOWN = " ⁇ "
#: Words whose ids a worker holds; beyond, it starts anew with the next batch.
HELD = 400_000
#: Longer words are not held.
HELD_CHARS = 64
#: The agenda of a run of up to so many characters is a list in the order of the text, of longer ones a heap. Words of up to so
#: many are merged side by side.
SHORT = 24
#: Words are merged side by side with those of about their length: up to so many characters.
LENGTHS = (8, 12, 16, SHORT)
#: Characters of the texts that are checked, and put out, at once, about.
BATCH_CHARS = 1_000_000
#: Words that the library encodes as one text in a check.
CHECKED = 32

#: In an agenda of words side by side, the place of a pair is in the low bits of its key, and this is no pair.
_PLACE_BITS = 5
_NONE = np.iinfo(np.int32).max
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """A vocabulary of merges. rank: scores with the sign turned, of the pieces that merging may make; bytes_: ids of the 256 byte pieces, or none;
    surface: each id's text, empty for a control id, or its byte; beside: the pairs of characters that stand side by side in a
    piece."""

    ids: dict[str, int]
    rank: dict[str, float]
    bytes_: list[int]
    unknown: int
    end: int
    surface: list[str | int]
    beside: set[str] = field(default_factory=set)

    def kinds(self) -> np.ndarray:
        """What cuts texts into words, by code point: 0 is a space. A word is spaces and what follows of one kind: letters, or
        other characters, if no piece has a letter beside another character but a space; else all are of one kind."""
        kinds = np.ones(0x110000, np.uint8)
        kinds[ord(SPACE)] = 0
        odd = "".join(sorted({c for piece in self.ids for c in piece if c.isalnum() and not c.isalpha() and not c.isdecimal()}))
        letter = re.compile(rf"[^\W\d_{odd}]")
        if not any(pair[0] != SPACE and bool(letter.match(pair[0])) != bool(letter.match(pair[1])) for pair in self.beside):
            for run in re.finditer(f"{letter.pattern}+", "".join(map(chr, range(0x110000)))):
                kinds[slice(*run.span())] = 2
        return kinds

    @cached_property
    def stranger(self) -> str:
        """A character that no piece holds."""
        known = {c for piece in self.ids for c in piece}
        return next(c for c in map(chr, range(0xE000, 0xF900)) if c not in known)

    @classmethod
    def of(cls, model: bytes) -> Pieces:
        """The vocabulary of a model file. ValueError for a model that is not one of merges, that changes texts other than
        by a space in front, or whose pieces hold a space behind another character or are given by the user."""
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        kind, norm, trained = type(spec.pieces.add()), spec.normalizer_spec, spec.trainer_spec
        del spec.pieces[-1]
        if trained.model_type != trained.BPE or trained.treat_whitespace_as_suffix:
            raise ValueError("not a vocabulary of merges")
        if trained.unk_surface != UNKNOWN:
            raise ValueError("this text of unknown pieces is not supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("this model's normalisation is not supported")
        made = cls({}, {}, [], trained.unk_id, trained.eos_id, [])
        for i, p in enumerate(spec.pieces):
            made.surface.append("")
            if p.type == kind.NORMAL:
                if re.search(f"[^{SPACE}]{SPACE}", p.piece):
                    raise ValueError(f"a piece with a space inside: {p.piece}")
                made.ids[p.piece], made.rank[p.piece] = i, -p.score
                made.beside.update(map("".join, zip(p.piece, p.piece[1:])))
                made.surface[i] = p.piece.replace(SPACE, " ")
            elif p.type == kind.BYTE:
                made.surface[i] = len(made.bytes_)
                made.bytes_.append(i)
            elif p.type == kind.UNKNOWN:
                made.surface[i] = UNKNOWN
            elif p.type != kind.CONTROL:
                raise ValueError(f"pieces of this type are not supported: {p.piece}")
        return made


def load_model(spark: SparkSession, path: str) -> bytes:
    """A model file's bytes; a URL is read by Spark, a plain path by the driver."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


def merge(run: str, pieces: Pieces) -> list[int]:
    """Ids of a run: pairs leave the agenda by falling score, of equal ones the leftmost first; a pair whose symbols have been
    merged otherwise meanwhile is passed over. Characters outside the vocabulary become bytes, or the unknown id."""
    if len(run) <= SHORT:
        return _ids(_merge_short(run, pieces.rank.get), pieces)
    n, rank = len(run), pieces.rank.get
    end = list(range(1, n + 1))  # the symbol that starts at i ends at end[i]; 0 once it is part of another
    before = list(range(-1, n - 1))
    agenda = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(run[i : i + 2])) is not None]
    heapq.heapify(agenda)
    while agenda:
        _, i, j, to = heapq.heappop(agenda)
        if end[i] != j or end[j] != to:
            continue
        end[i], end[j] = to, 0
        if to < n:
            before[to] = i
            if (r := rank(run[i : end[to]])) is not None:
                heapq.heappush(agenda, (r, i, to, end[to]))
        if (h := before[i]) >= 0 and (r := rank(run[h:to])) is not None:
            heapq.heappush(agenda, (r, h, i, to))
    symbols, i = [], 0
    while i < n:
        symbols.append(run[i : end[i]])
        i = end[i]
    return _ids(symbols, pieces)


def _merge_short(run: str, rank) -> list[str]:
    """Symbols of a short run. The agenda is one rank for each pair of neighbours, so its least is the leftmost of equal ones."""
    symbols = list(run)
    agenda = [rank(pair, math.inf) for pair in map(add, run, run[1:])]
    while agenda and (least := min(agenda)) != math.inf:
        i = agenda.index(least)
        del agenda[i]
        symbols[i] = symbol = symbols[i] + symbols.pop(i + 1)
        if i < len(agenda):
            agenda[i] = rank(symbol + symbols[i + 1], math.inf)
        if i:
            agenda[i - 1] = rank(symbols[i - 1] + symbol, math.inf)
    return symbols


def _ids(symbols: list[str], pieces: Pieces) -> list[int]:
    out = list(map(pieces.ids.get, symbols))
    if None not in out:
        return out
    out = []
    for symbol in symbols:
        found = pieces.ids.get(symbol)
        if found is not None:
            out.append(found)
        elif pieces.bytes_:
            out += [pieces.bytes_[b] for b in symbol.encode()]
        else:
            out.append(pieces.unknown)
    return out


class Merger:
    """Merges many short words side by side. A symbol is a piece's id and 1, a character without a piece its code point and
    `outside`, 0 is none. A word is a column, and its agenda a key for each place at which a pair begins: the pair's rank,
    then the place, so the least is the next pair, of equal ones the leftmost."""

    def __init__(self, pieces: Pieces):
        self.pieces, ids = pieces, pieces.ids
        self.outside = len(pieces.surface) + 1
        self.symbol = np.arange(self.outside, self.outside + 0x110000, dtype=np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i + 1
        number = {piece: i + 1 for piece, i in ids.items()}
        number |= {c: int(self.symbol[ord(c)]) for piece in ids for c in piece}
        order = {rank: n << _PLACE_BITS for n, rank in enumerate(sorted(set(pieces.rank.values())))}
        rows = [
            (left << 32 | right, order[rank], number[piece])
            for piece, rank in pieces.rank.items()
            for k in range(1, len(piece))
            if (left := number.get(piece[:k])) and (right := number.get(piece[k:]))
        ]
        self._table(*np.array(rows, np.uint64).reshape(-1, 3).T)

    def _table(self, pairs: np.ndarray, order: np.ndarray, merged: np.ndarray) -> None:
        """Pairs in slots by hash, or the next free one; a free slot's pair is 0."""
        bits = max(4, int(2 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pairs = np.zeros(1 << bits, np.uint64)
        self.order, self.merged = np.full(1 << bits, _NONE, np.int32), np.zeros(1 << bits, np.int32)
        at, left = self._slot(pairs), np.arange(len(pairs))
        while left.size:
            free = left[self.pairs[at[left]] == 0]
            self.pairs[at[free]] = pairs[free]
            left = left[self.pairs[at[left]] != pairs[left]]
            at[left] = (at[left] + 1) & self.mask
        self.order[at], self.merged[at] = order, merged

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs * _SPREAD) >> self.shift).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank, shifted, and symbol of pairs; _NONE for those that are not to be merged."""
        pairs = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._slot(pairs)
        found = self.pairs[at]
        others = np.flatnonzero((found != pairs) & (found != 0))
        while others.size:
            at[others] = on = (at[others] + 1) & self.mask
            found = self.pairs[on]
            others = others[(found != pairs[others]) & (found != 0)]
        return self.order[at], self.merged[at]

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids, as 32-bit integers, of words of up to SHORT characters."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        by_size, out = np.argsort(sizes, kind="stable"), [b""] * len(words)
        for some in np.split(by_size, np.searchsorted(sizes[by_size], LENGTHS[:-1], "right")):
            if some.size:
                some = some.tolist()
                flat, counts = self._merge([words[i] for i in some])
                raw, ends = flat.tobytes(), (4 * np.cumsum(counts)).tolist()
                for i, a, b in zip(some, [0, *ends], ends):
                    out[i] = raw[a:b]
        return out

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many are of each."""
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        most = int(sizes.max())
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        # flat tables of `most` + 1 rows: the place behind a word, and the last one, which stands before the first, have no symbol
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbols = np.zeros((most + 1) * n, np.int32)
        symbols[place * n + np.repeat(np.arange(n), sizes)] = self.symbol[codes]
        after = np.repeat(np.arange(1, most + 2), n)
        before = np.repeat(np.arange(-1, most), n)
        before[:n] = most
        agenda, merged = np.full(len(symbols), _NONE, np.int32), np.zeros(len(symbols), np.int32)
        first = np.flatnonzero(symbols[n:])
        order, merged[first] = self._find(symbols[first], symbols[first + n])
        agenda[first] = order | first // n
        while True:
            least = agenda.reshape(-1, n).min(axis=0)
            col = np.flatnonzero(least != _NONE)
            if not col.size:
                break
            i = least[col].astype(np.int64) & ((1 << _PLACE_BITS) - 1)
            at = i * n + col
            gone = after[at] * n + col
            to = after[gone]
            next_, last = to * n + col, before[at] * n + col
            symbols[at] = symbol = merged[at]
            symbols[gone], agenda[gone] = 0, _NONE
            after[at], before[next_] = to, i
            order, merged[at] = self._find(symbol, symbols[next_])
            agenda[at] = order | i
            order, merged[last] = self._find(symbols[last], symbol)
            agenda[last] = order | last // n
        by_word = symbols.reshape(-1, n).T
        left = by_word != 0
        return self._out(by_word[left], left.sum(axis=1))

    def _out(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols: characters without a piece become bytes, or the unknown id."""
        strange = symbols >= self.outside
        ids = symbols - 1
        if not strange.any():
            return ids, counts
        if not self.pieces.bytes_:
            ids[strange] = self.pieces.unknown
            return ids, counts
        codes = symbols - self.outside
        each = np.where(strange, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), 1)
        word = np.repeat(np.repeat(np.arange(len(counts)), counts), each)
        ids, split = np.repeat(ids, each), np.repeat(strange, each)
        raw = np.frombuffer("".join(map(chr, codes[strange].tolist())).encode(), np.uint8)
        ids[split] = np.array(self.pieces.bytes_, np.int32)[raw]
        return ids, np.bincount(word, minlength=len(counts))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ranges one behind the other, and where each ends among them."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes), ends


class Encoder:
    """Encodes texts. Words are merged once while they are held, and each new one is checked against the library."""

    def __init__(self, model: bytes, checked: bool = True):
        self.pieces = Pieces.of(model)
        self.kinds = self.pieces.kinds()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model) if checked else None
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, tuple[int, ...]] = {}

    @cached_property
    def merger(self) -> Merger:
        return Merger(self.pieces)

    @cached_property
    def _surface(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all ids' texts, where each begins, how many it has, and whether it loses a space in front of a text."""
        surface = self.pieces.surface
        raw = [s.encode() if type(s) is str else bytes([s]) for s in surface]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        spaced = np.array([type(s) is str and s[:1] == " " and s != UNKNOWN for s in surface])
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes, spaced

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts, each with the end id. An empty text has the end id only."""
        ids, ends = self.encode_all(texts)
        return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one behind the other, and where each text's end."""
        for held in (self.words, self.runs):
            if len(held) >= HELD:
                held.clear()
        words, which, each = self._cut(texts)
        found = list(map(self.words.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            for i, ids in zip(new, self._merged([words[i] for i in new]), strict=True):
                found[i] = ids
            if self.library:
                self._check([words[i] for i in new], [found[i] for i in new])
            self.words.update((words[i], found[i]) for i in new if len(words[i]) <= HELD_CHARS)
        found.append(np.int32(self.pieces.end).tobytes())  # the end id as a word behind each text
        table = np.frombuffer(b"".join(found), np.int32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = np.insert(which, np.cumsum(each), len(words))
        at, ends = _ranges((np.cumsum(sizes) - sizes)[which], sizes[which])
        return table[at], ends[np.cumsum(each + 1) - 1]

    def _cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different words of texts, which one stands at each place, and how many places each text has."""
        spaced = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        joined = "".join(spaced)
        if not joined:
            return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        ends = np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced)))
        kind = self.kinds[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        begins = np.empty(len(kind), bool)
        begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
        begins[0] = begins[ends[ends < len(kind)]] = True
        raw = joined.encode()
        of_character = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        offsets = np.append(of_character[begins], len(raw))
        places = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        behind = np.searchsorted(np.flatnonzero(begins), ends)
        return places.dictionary.to_numpy(zero_copy_only=False).tolist(), places.indices.to_numpy(), np.diff(behind, prepend=0)

    def _merged(self, words: list[str]) -> list[bytes]:
        short = iter(self.merger.ids([w for w in words if len(w) <= SHORT]))
        return [next(short) if len(w) <= SHORT else np.array(self._word(w), np.int32).tobytes() for w in words]

    def _word(self, word: str) -> list[int]:
        beside = self.pieces.beside
        if beside.issuperset(map(add, word, word[1:])):
            return merge(word, self.pieces)
        cuts = [i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair not in beside]
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(word)]):
            run = word[a:b]
            found = self.runs.get(run)
            if found is None:
                found = tuple(merge(run, self.pieces))
                if len(run) <= HELD_CHARS:
                    self.runs[run] = found
            out += found
        return out

    def _check(self, words: list[str], ids: list[bytes]) -> None:
        """Behind a character that no piece holds, a word stands by itself for the library, too. Many are encoded as one text,
        and one by one if that differs: a model without byte pieces makes strange characters that stand together one id."""
        front, encode = self.pieces.stranger, partial(self.library.encode, num_threads=1)
        first = np.array(encode(front), np.int32).tobytes()
        between = first[len(self.merger.ids([SPACE])[0]) :]
        some = [slice(at, at + CHECKED) for at in range(0, len(words), CHECKED)]
        for x, together in zip(some, encode([front + front.join(words[x]) for x in some]), strict=True):
            if first + between.join(ids[x]) != np.array(together, np.int32).tobytes():
                for w, ours, theirs in zip(words[x], ids[x], encode([front + w for w in words[x]]), strict=True):
                    if first + ours != np.array(theirs, np.int32).tobytes():
                        raise ValueError(f"differs from the library: {ascii(w[:200])}")

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of what encode_all() gave, as decode_ids() has them."""
        raw, begins, sizes, spaced = self._surface
        at, behind = _ranges(begins[ids], sizes[ids])
        behind, starts = behind[ends - 1], np.append(0, ends[:-1])
        dropped = (behind - np.diff(behind, prepend=0))[spaced[ids[starts]]]  # each text has one id at least
        offsets = np.append(0, behind - np.cumsum(spaced[ids[starts]])).astype(np.int32)
        back = np.delete(raw[at], dropped)
        made = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(back)])
        made.validate(full=True)
        return made


def decode_ids(ids: list[int], surface: list[str | int]) -> str:
    """The text of ids: byte pieces are put together and read as UTF-8, each wrong byte as U+FFFD; control ids have no text;
    a space that the first piece begins with, as encoding puts it there, is taken away."""
    parts = list(map(surface.__getitem__, ids))
    first = next((s for s in parts if s != ""), "")
    try:
        text = "".join(parts)
    except TypeError:  # there are bytes
        out: list[str] = []
        for is_byte, group in groupby(parts, key=lambda s: type(s) is int):
            out += [_utf8(bytes(group))] if is_byte else group
        text = "".join(out)
    return text[1:] if type(first) is str and first[:1] == " " and first != UNKNOWN else text


def _utf8(raw: bytes) -> str:
    """Bytes as UTF-8; of what is not UTF-8, one U+FFFD a byte."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]", "�", raw.decode(errors="surrogateescape"))


@lru_cache(maxsize=2)
def _encoder(model: bytes, checked: bool) -> Encoder:
    """Kept between the tasks of a worker, so that they share the words met so far."""
    return Encoder(model, checked)


def _encode(model, checked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value, checked)
        library = encoder.library

        def out(keep: pa.Array, texts: list[str]) -> pa.RecordBatch:
            ids, ends = encoder.encode_all(texts)
            back = encoder.decode_all(ids, ends)
            if library:
                theirs = library.decode([ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)])
                if not pa.array(theirs, pa.string()).equals(back):
                    raise ValueError("decoding differs from the library")
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))
            return pa.RecordBatch.from_arrays([keep, lists, back], names=["_keep", "_tokens", "_text"])

        for batch in batches:
            begun, size, texts = 0, 0, []
            for i, text in enumerate(batch.column("text")):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= BATCH_CHARS or i + 1 == batch.num_rows:
                    yield out(batch.column("keep").slice(begun, i + 1 - begun), texts)
                    begun, size, texts = i + 1, 0, []

    return run


def encode(docs: DataFrame, model: bytes, keep: list[str], text_col: str = "text", checked: bool = True) -> DataFrame:
    """Columns _keep (a struct of the `keep` columns), _tokens (array<int>, with an end id) and _text, to which the ids decode,
    for each row of docs.

    No shuffle; a task holds one batch, about HELD words, and one run's agenda. A null or empty text has the end id only.
    Repeated rows are rows of their own; an empty table gives no rows. checked: a batch's new words are encoded and
    its ids decoded by the library, too, and a difference ends the job.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("keep"), F.col(text_col).alias("text"))
    Pieces.of(model)  # a model that is not supported is an error here already
    held = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_encode(held, checked), f"_keep {rows.schema['keep'].dataType.simpleString()}, _tokens array<int>, _text string")


def digests(tokens: Column, text: Column) -> list[Column]:
    joined = F.array_join(tokens.cast("array<string>"), " ")
    return [
        F.size(tokens).cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(text.cast("binary"), 256).alias("decoded_sha256"),
    ]


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens (with the end id), ids_sha256 (of the decimal ids joined by spaces), decoded_sha256.

    A null or empty text has the end id only and decodes to the empty text. Null and repeated ids are rows of their own; an
    empty table gives no rows; other columns are not read.
    """
    out = encode(docs, load_model(docs.sparkSession, path), [id_col], text_col)
    return out.select(F.col(f"_keep.{id_col}").alias(id_col), *digests(F.col("_tokens"), F.col("_text")))
