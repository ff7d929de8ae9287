"""JPP streams: messages that carry parts of data-bins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of the message classes, those that carry an auxiliary number, and the reasons that end a response.
CLASSES = {0: "precinct", 1: "extended precinct", 2: "tile header", 4: "tile", 5: "extended tile", 6: "main header", 8: "metadata"}
WITH_AUX = (1, 5)
REASONS = {1: "image done", 2: "window done", 3: "window change", 4: "byte limit", 5: "quality limit", 6: "session limit", 7: "response limit", 255: "other"}

MESSAGE = "struct<class: int, stream: int, id: bigint, msg_offset: bigint, msg_length: bigint, aux: bigint, is_last: boolean, eor: int, begin: bigint, end: bigint, error: string>"


class Malformed(ValueError):
    """Bytes that begin no message; found: the messages before them."""

    found: list[tuple] = []


def vbas(data: bytes, at: int) -> tuple[int, int] | None:
    """A number in groups of seven bits (of ten bytes at most) and where it ends; None if it is cut off."""
    value = 0
    for i in range(at, min(len(data), at + 10)):
        value = value << 7 | data[i] & 127
        if data[i] < 128:
            return value, i + 1
    if len(data) - at >= 10:
        raise Malformed("a number takes more than ten bytes")
    return None


def to_vbas(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127 | 128)
    return bytes(reversed(out))


def message_header(class_: int | None, id_: int, offset: int, length: int, last: bool) -> bytes:
    """A message's header; class_ None means the class of the message before it."""
    groups = [id_ & 127]
    while (id_ := id_ >> 7) :
        groups.append(id_ & 127)
    if groups[-1] > 15:
        groups.append(0)
    groups.reverse()
    first = (1 if class_ is None else 2) << 5 | last << 4 | groups[0] | (128 if len(groups) > 1 else 0)
    rest = [g | 128 for g in groups[1:-1]] + groups[1:][-1:]
    return bytes([first, *rest]) + (b"" if class_ is None else to_vbas(class_)) + to_vbas(offset) + to_vbas(length)


def read_messages(data: bytes, class_: int = 0, stream: int = 0) -> tuple[list[tuple], int, int, int]:
    """Whole messages from the start of data; where the first incomplete one begins, and the class and stream in force there.

    A message's class and stream are those of the one before unless it names its own. Ends of responses are rows with `eor`.
    """
    out: list[tuple] = []
    try:
        return _read(data, class_, stream, out)
    except Malformed as e:
        e.found = out
        raise


def _read(data: bytes, class_: int, stream: int, out: list[tuple]) -> tuple[list[tuple], int, int, int]:
    at = 0
    while at < len(data):
        if data[at] == 0:
            found = vbas(data, at + 2) if at + 2 <= len(data) else None
            if not found or found[0] > len(data) - found[1]:
                break
            out.append((None, None, None, None, found[0], None, True, data[at + 1], found[1], found[1] + found[0]))
            at = found[1] + found[0]
            continue
        lead, pos = data[at], at + 1
        form, last, id_ = lead >> 5 & 3, bool(lead & 16), lead & 15
        if form == 0:
            raise Malformed(f"byte {at} begins no message")
        more = lead >> 7
        while more and pos < len(data):
            id_, more, pos = id_ << 7 | data[pos] & 127, data[pos] >> 7, pos + 1
        if more:
            break
        c, s = class_, stream
        fields = []
        for wanted in (form >= 2, form == 3, True, True):
            if wanted:
                found = vbas(data, pos)
                if not found:
                    break
                fields.append(found[0])
                pos = found[1]
            else:
                fields.append(None)
        if len(fields) < 4:
            break
        c = c if fields[0] is None else fields[0]
        s = s if fields[1] is None else fields[1]
        aux = None
        if c in WITH_AUX:
            found = vbas(data, pos)
            if not found:
                break
            aux, pos = found
        if fields[3] > len(data) - pos:
            break
        out.append((c, s, id_, fields[2], fields[3], aux, last, None, pos, pos + fields[3]))
        class_, stream, at = c, s, pos + fields[3]
    return out, at, class_, stream


def messages(streams: DataFrame, raw: str = "bytes") -> DataFrame:
    """One row per message of each stream: streams' columns, number, the message's fields and its payload. A stream that
    goes on with something else has a last row with nothing but `error`."""
    names = [x.split(":")[0].strip() for x in MESSAGE[7:-1].split(",")]

    def read(data: bytes) -> list[dict]:
        try:
            found, error = read_messages(data)[0], []
        except Malformed as e:
            found, error = e.found, [{"error": str(e)}]
        return [dict(zip(names, m, strict=False)) for m in found] + error

    def parse(data: pd.Series) -> pd.Series:
        return data.map(lambda d: read(bytes(d)) if d is not None else [])

    rows = streams.withColumn("_m", F.pandas_udf(parse, f"array<{MESSAGE}>").asNondeterministic()(F.col(raw)))
    each = rows.select("*", F.posexplode("_m").alias("number", "_x")).select(*streams.columns, "number", "_x.*")
    cut = F.substring(F.col(raw), F.col("begin").cast("int") + 1, (F.col("end") - F.col("begin")).cast("int"))
    return each.withColumn("payload", cut).drop("begin", "end")


def bins(of_messages: DataFrame, by: list[str], order: str = "number") -> DataFrame:
    """Data-bins put together: by..., class, id, bytes, complete, payload. A message must begin where the bin so far ends;
    messages that do not, and what follows them, are left out."""
    keys = [*by, "class", "id"]
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.coalesce(F.sum("msg_length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = of_messages.filter("eor is null and error is null").withColumn("_ok", F.col("msg_offset") == before)
    rows = rows.withColumn("_good", F.min(F.col("_ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).filter("_good")
    joined = F.coalesce(F.expr("listagg(payload, x'') WITHIN GROUP (ORDER BY msg_offset)"), F.lit(b""))
    return rows.groupBy(*keys).agg(F.sum("msg_length").alias("bytes"), F.bool_or("is_last").alias("complete"), joined.alias("payload"))


def emit(bins_: DataFrame, by: list[str], order: str, class_: str = "class", id_: str = "id", payload: str = "payload", most: int = 987) -> DataFrame:
    """One stream per group: the messages of its bins in order, ended by `window done`. A group's bins are one response,
    the only thing that is held; bins pass in order."""
    names = [*by, class_, id_, payload]
    rows = bins_.repartition(*by).sortWithinPartitions(*by, order).select(*names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, out = None, None, []

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(now, kinds, strict=True)), pa.array([b"".join(out) + b"\x00\x02\x00"])], names=[*by, "bytes"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in by]
            for *key, c, i, p in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                if key != now:
                    if now is not None:
                        yield whole()
                    now, last, out = key, None, []
                p = p or b""
                for at in range(0, max(1, len(p)), most):
                    part = p[at : at + most]
                    out.append(message_header(None if c == last else int(c), int(i), at, len(part), at + most >= len(p)) + part)
                    last = c
        if now is not None:
            yield whole()

    kinds_ = ", ".join(f"`{k}` {bins_.schema[k].dataType.simpleString()}" for k in by)
    return rows.mapInArrow(write, f"{kinds_}, bytes binary")


def reason_name(eor: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in REASONS.items() for v in kv])[eor]
