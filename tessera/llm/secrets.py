"""Secret scanning through nested encodings.

A worklist holds the layers of a text: the text itself, then what URL escapes, Unicode escapes, base64 runs and
compressed runs in it unwrap to, and so on until nothing unwraps any more. Every layer is scanned with the same
patterns; a layer knows where its characters come from in the layer it was unwrapped from, as runs and not one by one.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three kinds, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs of 32 and more
KEYWORDS = ("password", "passwd", "secret", "token", "api")
VALUE_LEAST, ACCESS_LEAST = 8, 16

#: A run of base64 characters is tried from this length on.
BASE64_LEAST = 16
#: What a compressed layer unpacks to is scanned in windows of so many bytes, each with the end of the one before it.
WINDOW, OVERLAP = 8 << 20, 1 << 16
#: Compressed bytes that are unpacked at once, fewer of zstd, and what the others may give at once.
PACKED_STEP, ZSTD_STEP, UNPACKED_STEP = 1 << 16, 256, 1 << 20
#: Bytes of a readable stretch; the least span, token=12345678, has 14. Bytes without one hold no secret.
STRETCH_LEAST = 12

_CLUSTER = re.compile(r"[%\\&][%\\&#;0-9A-Fa-fuxX]*")
_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
_ENTITY = re.compile(r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
# Escapes whose mark is itself escaped, any number of times over: %252541, \u005cx41, \x5cx5cx41.
_NESTED = re.compile(r"(%)(?:25)+(?=[0-9A-Fa-f]{2})|(\\)(?:u005[cC]|x5[cC])+(?=x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4})")
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{BASE64_LEAST},}}")
_LINE_END = re.compile(r"(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*")
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]+(?:{_LINE_END.pattern}[A-Za-z0-9+/_-]+)+")
_STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{%d}" % STRETCH_LEAST)
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd", re.DOTALL)
_MAGIC_TEXT = re.compile(_MAGIC.pattern.decode("latin-1"), re.DOTALL)
# A text without one of these, escaped or not, holds no escaped magic.
_ESCAPED_MAGIC = re.compile(r"[%x]1f[%\\]x?8b|[%x]78|[%x]9c|[%x]01|[%x]da|x\^|x[%\\]x?5e|BZh|[%x]42|[%x]5a|[%x]68|[%x]fd|[%x]b5", re.IGNORECASE)
# Escaped bytes and the plain characters between them; a run begins with at most 16 plain ones, a magic's.
_PERCENT_BYTES = re.compile(r"[\w.~+!*'()-]{0,16}%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2}|[\w.~+!*'()-])*", re.ASCII)
_X_BYTES = re.compile(r"[ -\[\]-~]{0,16}\\x[0-9A-Fa-f]{2}(?:\\x[0-9A-Fa-f]{2}|\\[abfnrtv0\\'\"]|[ -\[\]-~])*")
_BYTE = re.compile(rb"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\(.)", re.DOTALL)
_SHORT = dict(zip(b"abfnrtv0", b"\a\b\f\n\r\t\v\0", strict=True))
_HEX = frozenset(map(ord, "0123456789abcdefABCDEF"))


class Layer:
    """A text and where it comes from: locate turns a span of it into one of the parent, which is None for a whole text."""

    __slots__ = ("text", "parent", "locate")

    def __init__(self, text: str, parent: Layer | None = None, locate: Callable[[int, int], tuple[int, int]] | None = None):
        self.text, self.parent, self.locate = text, parent, locate

    def origin(self, a: int, b: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            a, b = layer.locate(a, b)
            layer = layer.parent
        return a, b


def matches(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' spans in one layer, per kind leftmost and non-overlapping."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= VALUE_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


class _Runs:
    """Places of a new text in an old one, as runs: a copied run keeps its characters apart, any other is one place."""

    def __init__(self):
        self.at, self.start, self.end, self.size = array("q"), array("q"), array("q"), 0

    def copy(self, start: int, end: int) -> None:
        if end > start:
            self._add(start, -1, end - start)

    def whole(self, start: int, end: int, size: int) -> None:
        if size:
            self._add(start, end, size)

    def _add(self, start: int, end: int, size: int) -> None:
        self.at.append(self.size)
        self.start.append(start)
        self.end.append(end)
        self.size += size

    def locate(self, a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        first = self.start[i] + (a - self.at[i] if self.end[i] < 0 else 0)
        last = self.start[j] + b - self.at[j] if self.end[j] < 0 else self.end[j]
        return first, last


def _reduce(run: str) -> tuple[list[str], list[int], list[int]]:
    """A run with its escapes decoded, and those that decoded characters are part of, until none is left: each character
    is put on a stack, and an escape that it completes is replaced there. Characters, and the span of each."""
    codes, first, last = [], [], []
    for i, c in enumerate(map(ord, run)):
        at = i
        while True:
            n = 0
            if c in _HEX:
                k = len(codes)
                if k >= 2 and codes[k - 2] == 37 and codes[k - 1] in _HEX:
                    n = 2
                elif k >= 3 and codes[k - 3] == 92 and codes[k - 2] == 120 and codes[k - 1] in _HEX:
                    n = 3
                elif k >= 5 and codes[k - 5] == 92 and codes[k - 4] == 117 and all(x in _HEX for x in codes[k - 3 :]):
                    n = 5
                if n:
                    digits = "".join(map(chr, codes[k - n + 2 - (n == 2) :])) + chr(c)
                    new = int(digits, 16)
                    if n < 5 and new > 127 or 0xD800 <= new < 0xE000:  # half a character
                        new = 0xFFFD
            elif c == 59:
                tail = "".join(map(chr, codes[-9:])) + ";"
                found = _ENTITY.fullmatch(tail, max(0, tail.rfind("&")))
                if found:
                    n = len(found[0]) - 1
                    new = ord((html.unescape(found[0]) or "\ufffd")[0])
                    if 0xD800 <= new < 0xE000:
                        new = 0xFFFD
            if not n:
                break
            at = first[-n]
            del codes[-n:], first[-n:], last[-n:]
            c = new
        codes.append(c)
        first.append(at)
        last.append(i + 1)
    return list(map(chr, codes)), first, last


def _unescaped(layer: Layer) -> Layer | None:
    """The layer with all escapes decoded, to the last; what is not ASCII is not told apart."""
    text, runs, parts, at = layer.text, _Runs(), [], 0
    for m in _CLUSTER.finditer(text):
        if not _ESCAPE.search(text, m.start(), m.end()):
            continue
        runs.copy(at, m.start())
        parts.append(text[at : m.start()])
        chars, first, last = _reduce(m[0])
        base, i, n = m.start(), 0, len(chars)
        while i < n:
            j = i
            while j < n and last[j] - first[j] == 1:
                j += 1
            if j > i:
                runs.copy(base + first[i], base + last[j - 1])
            if j < n:
                runs.whole(base + first[j], base + last[j], 1)
            i = j + 1
        parts.append("".join(chars))
        at = m.end()
    return _rest(layer, runs, parts, at)


def _unnested(layer: Layer) -> Layer | None:
    """The layer with every escaped mark of an escape replaced by the mark."""
    text, runs, parts, at = layer.text, _Runs(), [], 0
    for m in _NESTED.finditer(text):
        runs.copy(at, m.start())
        runs.whole(m.start(), m.end(), 1)
        parts += [text[at : m.start()], m[1] or m[2]]
        at = m.end()
    return _rest(layer, runs, parts, at)


def _rest(layer: Layer, runs: _Runs, parts: list[str], at: int) -> Layer | None:
    if not parts:
        return None
    runs.copy(at, len(layer.text))
    return Layer("".join(parts) + layer.text[at:], layer, runs.locate)


class _Unpacked:
    """The chunks of all members of a compressed layer that begins at a byte, and the byte at which the last one ends."""

    def __init__(self, raw: bytes, at: int):
        self.raw, self.end = raw, at

    def _unpacker(self):
        head = self.raw[self.end : self.end + 6]
        if head[:2] == b"\x1f\x8b":
            return zlib.decompressobj(31)
        if head[:1] == b"\x78" and len(head) > 1 and int.from_bytes(head[:2], "big") % 31 == 0:
            return zlib.decompressobj()
        if head[:3] == b"BZh":
            return bz2.BZ2Decompressor()
        if head == b"\xfd7zXZ\x00":
            return lzma.LZMADecompressor()
        if head[:4] == b"\x28\xb5\x2f\xfd":
            return zstandard.ZstdDecompressor().decompressobj()
        return None

    def __iter__(self) -> Iterator[bytes]:
        while (unpacker := self._unpacker()) is not None:
            start, some = self.end, False
            zstd = self.raw[start] == 0x28
            step = ZSTD_STEP if zstd else PACKED_STEP
            try:
                while not unpacker.eof and self.end < len(self.raw):
                    given = self.raw[self.end : self.end + step]
                    self.end += len(given)
                    for out in (unpacker.decompress(given),) if zstd else _given(unpacker, given):
                        some = some or bool(out)
                        yield out
            except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
                self.end = self.end if some else start
                return
            if not unpacker.eof:
                return
            self.end -= len(unpacker.unused_data)


def _given(unpacker, given: bytes) -> Iterator[bytes]:
    """What a piece of compressed bytes gives, in parts of bounded size."""
    while True:
        out = unpacker.decompress(given, UNPACKED_STEP)
        yield out
        given = getattr(unpacker, "unconsumed_tail", b"")  # zlib hands back what it has not read, the others keep it
        if unpacker.eof or (not given and len(out) < UNPACKED_STEP):
            return


def _windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of the chunks in windows; each begins with the end of the one before it."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while len(held) >= WINDOW:
            yield bytes(held[:WINDOW])
            del held[: WINDOW - OVERLAP]
    if held:
        yield bytes(held)


def _unpacked_layers(raw: bytes, parent: Layer, locate: Callable[[int, int], tuple[int, int]]) -> Iterator[Layer]:
    """What the compressed layers in the bytes hold, wherever they begin; all of a layer comes from its whole run."""
    at = 0
    while m := _MAGIC.search(raw, at):
        packed = _Unpacked(raw, m.start())
        for window in _windows(iter(packed)):
            span = locate(m.start(), packed.end)
            yield Layer(window.decode("latin-1"), parent, lambda a, b, span=span: span)
        at = max(packed.end, m.start() + 1)


def _decoded(layer: Layer, start: int, end: int) -> Iterator[Layer]:
    """What a run of base64 characters holds, at each of the four alignments, and what is compressed in it."""
    run = layer.text[start:end].translate({45: 43, 95: 47})
    for first in range(min(4, len(run) - 1)):
        part = run[first : len(run) - ((len(run) - first) % 4 == 1)]
        raw = binascii.a2b_base64(part + "=" * (-len(part) % 4))

        def locate(a: int, b: int, first: int = first) -> tuple[int, int]:  # three bytes come from four characters
            return start + first + a // 3 * 4, min(end, start + first + (b - 1) // 3 * 4 + 4)

        if _MAGIC.search(raw):
            yield from _unpacked_layers(raw, layer, locate)
        if _STRETCH.search(raw):
            yield Layer(raw.decode("latin-1"), layer, locate)


def _inner(layer: Layer) -> Iterator[Layer]:
    """What the base64 runs of a layer hold. A run is tried line by line and joined over line ends."""
    for m in _BASE64.finditer(layer.text):
        yield from _decoded(layer, *m.span())
    for m in _WRAPPED.finditer(layer.text):
        runs, parts, last = _Runs(), [], m.start()
        for line_end in _LINE_END.finditer(layer.text, m.start(), m.end()):
            runs.copy(last, line_end.start())
            parts.append(layer.text[last : line_end.start()])
            last = line_end.end()
        runs.copy(last, m.end())
        if runs.size >= BASE64_LEAST:
            joined = Layer("".join(parts) + layer.text[last : m.end()], layer, runs.locate)
            yield from _decoded(joined, 0, runs.size)


def _escaped_bytes(layer: Layer, pattern: re.Pattern) -> Iterator[Layer]:
    """What is compressed in runs of escaped bytes; as a text those bytes would be lost."""
    if not _ESCAPED_MAGIC.search(layer.text):
        return
    for m in pattern.finditer(layer.text):
        run = m[0].encode()
        if pattern is _PERCENT_BYTES:
            raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda e: bytes.fromhex(e[1].decode()), run.replace(b"+", b" "))
        else:
            raw = _BYTE.sub(lambda e: bytes.fromhex(e[2].decode()) if e[2] else bytes([_SHORT.get(e[3][0], e[3][0])]) if e[3] else e[0], run)
        if _MAGIC.search(raw):
            yield from _unpacked_layers(raw, layer, lambda a, b, span=m.span(): span)


def _packed_bytes(layer: Layer) -> Iterator[Layer]:
    """What is compressed in a layer of bytes; in one that is a text of its own, characters stand for no bytes."""
    if layer.parent is not None and _MAGIC_TEXT.search(layer.text):
        yield from _unpacked_layers(layer.text.encode("latin-1", "replace"), layer, lambda a, b: (a, b))


def layers(text: str) -> Iterator[Layer]:
    """The text and all layers in it, each once: a layer met before at the same place ends that branch.

    The worklist holds iterators, so that of a layer that is unpacked in windows only one is held.
    """
    seen: set[tuple[bytes, int]] = set()
    worklist: list[Iterator[Layer]] = [iter((Layer(text),))]
    while worklist:
        layer = next(worklist[-1], None)
        if layer is None:
            worklist.pop()
            continue
        now = layer.text
        if not now:
            continue
        key = (hashlib.sha256(now.encode("utf-8", "surrogatepass")).digest(), layer.origin(0, 1)[0])
        if key in seen:
            continue
        seen.add(key)
        yield layer
        worklist.append(_inner(layer))
        worklist.append(_packed_bytes(layer))
        if "%" in now or "\\" in now or "&#" in now:
            worklist.append(iter([x for x in (_unescaped(layer), _unnested(layer)) if x is not None]))
        if "%" in now:
            worklist.append(_escaped_bytes(layer, _PERCENT_BYTES))
        if "\\x" in now:
            worklist.append(_escaped_bytes(layer, _X_BYTES))


def secrets_of(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text, in code points, by start, then kind as listed, then end."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    if not text:
        return [], []
    base: list[tuple[str, int, int]] = []
    spans: set[tuple[str, int, int]] = set()
    for layer in layers(text):
        found = matches(layer.text)
        if layer.parent is None:
            base = sorted(found, key=order)
            spans.update(found)
        else:
            spans.update((k, *layer.origin(a, b)) for k, a, b in found)
    return base, sorted(spans, key=order)


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base, spans = secrets_of(text)
        kinds = [k for k, _, _ in base]
        rows.append((*map(kinds.count, KINDS), hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _redact(texts: pd.Series) -> pd.Series:
    return texts.map(redact, na_action="ignore")


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    spans = secrets_of(text)[1]
    if not spans:
        return text
    parts, at = [], 0
    for _, a, b in spans:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join(parts) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans.

    The counts and the hash are of the patterns' matches in the text itself; spans are those and what layers add.
    A null or empty text has none. Null ids and repeated rows are scanned alike; an empty table gives no rows; other columns
    are not read. Any depth of nesting is followed, in time in proportion to the text's escapes; what a compressed layer
    unpacks to is scanned in windows of WINDOW bytes, so it may be of any size; a text is held as a whole.
    """
    fields = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    scan = F.pandas_udf(_scan, fields).asNondeterministic()
    return docs.select(F.col(id_col), scan(F.col(text_col)).alias("_s")).select(id_col, "_s.*")


def redacted(text: Column) -> Column:
    """The text without its secrets; null stays null."""
    return F.pandas_udf(_redact, "string").asNondeterministic()(text)
