"""Table functions for SQL: what is in a file's bytes, as rows that are put out one by one.

    register(spark)
    spark.sql("SELECT f.path, b.* FROM files f, LATERAL boxes(f.content) b WHERE b.type = 'jp2c'")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessera.sources.codestream import SOD, SOT, each_box, each_marker
from tessera.sources.jpp import Malformed, read_messages


class Boxes:
    """Boxes of a container; null bytes have none."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        data = bytes(content) if content is not None else b""
        for number, b in enumerate(each_box(data)):
            yield number, b["depth"], b["type"], b["begin"], b["end"], data[b["begin"] : b["end"]]


class Markers:
    """Marker segments and tile-parts' bodies of a codestream; a body's bytes are not in payload."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        data = bytes(content) if content is not None else b""
        for number, m in enumerate(each_marker(data)):
            payload = None if m["code"] == SOD else data[m["begin"] : m["end"]]
            yield number, m["part"], m["code"], m["at"], m["begin"], m["end"], payload


class TileParts:
    """Tile-parts of a codestream: where each header and body is."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        data, at, tile = bytes(content) if content is not None else b"", 0, 0
        for m in each_marker(data):
            if m["code"] == SOT:
                at, tile = m["at"], int.from_bytes(data[m["begin"] : m["begin"] + 2], "big")
            elif m["code"] == SOD:
                yield m["part"], tile, at, m["begin"], m["end"]


class JppMessages:
    """Messages of a stream; after what is no message, a last row with the error."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        data, error = bytes(content) if content is not None else b"", None
        try:
            found = read_messages(data)[0]
        except Malformed as e:
            found, error = e.found, str(e)
        for number, m in enumerate(found):
            yield (number, *m[:8], data[m[8] : m[9]], None)
        if error is not None:
            yield (len(found), *[None] * 8, None, error)


FUNCTIONS = {
    "boxes": (Boxes, "number int, depth int, type string, begin bigint, end bigint, payload binary"),
    "markers": (Markers, "number int, part int, code int, at bigint, begin bigint, end bigint, payload binary"),
    "tile_parts": (TileParts, "part int, tile int, at bigint, begin bigint, end bigint"),
    "jpp_messages": (JppMessages, "number int, class int, stream int, id bigint, msg_offset bigint, msg_length bigint, aux bigint, is_last boolean, eor int, payload binary, error string"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL, by the names in FUNCTIONS."""
    for name, (function, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function, returnType=schema))
