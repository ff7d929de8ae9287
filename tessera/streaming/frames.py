"""Frames and data-bins from streams, with state per stream kept by Structured Streaming.

Packets of a micro-batch come in no order, so each key's are put in order of arrival before they are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.frames import WRAP
from tessera.sources.jpp import Malformed, read_messages

STATE = "ext int, marker boolean, ts bigint, frame bigint, first_ts bigint, packets bigint, own bigint, gaps bigint, first_main boolean, kept_first bigint, kept bigint, meta bigint"
OUTPUT = "ssrc bigint, frame bigint, ts bigint, packets bigint, bytes bigint, gaps bigint, status string, meta_arrival bigint"
_FIELDS = [x.split()[0] for x in STATE.split(", ")]


def _closed(ssrc: int, s: dict) -> tuple:
    total = s["own"] + (0 if s["first_main"] else s["kept_first"] if s["kept_first"] >= 0 else 0)
    if s["gaps"]:
        status = "lossy"
    elif not s["marker"]:
        status = "tail_loss"
    elif not s["first_main"] and s["kept_first"] < 0:
        status = "no_header"
    else:
        status = "emitted" if total else "empty"
    return ssrc, s["frame"], s["first_ts"], s["packets"], total, s["gaps"], status, s["meta"] if s["meta"] >= 0 else None


class FrameAssembler(StatefulProcessor):
    """Keeps the open frame of each stream; a frame goes out when a marker or a new time stamp ends it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packets = pd.concat(list(rows)).sort_values("arrival")
        s = dict(zip(_FIELDS, self.state.get(), strict=True)) if self.state.exists() else None
        out = []
        for p in packets.itertuples(index=False):
            new = s is None or s["marker"] or s["ts"] != p.ts
            if new:
                if s is not None and not s["marker"]:
                    out.append(_closed(key[0], s))
                kept = s["kept"] if s else -1
                gap = s is not None and p.ext != (s["ext"] + 1) & WRAP
                s = {
                    "ts": int(p.ts), "frame": (s["frame"] if s else 0) + 1, "first_ts": int(p.ts), "packets": 0, "own": 0, "gaps": int(gap),
                    "first_main": bool(p.main), "kept_first": kept, "kept": kept, "meta": -1,
                }
            else:
                s["gaps"] += int(p.ext != (s["ext"] + 1) & WRAP)
            s.update(ext=int(p.ext), marker=bool(p.marker), packets=s["packets"] + 1, own=s["own"] + int(p.length))
            if p.main:
                s["meta"] = int(p.arrival)
                if p.r and p.length > 0:
                    s["kept"] = int(p.length)
            if s["marker"]:
                out.append(_closed(key[0], s))
        self.state.update(tuple(s[f] for f in _FIELDS))
        columns = [x.split()[0] for x in OUTPUT.split(", ")]
        frame = pd.DataFrame(out, columns=columns)
        frame["meta_arrival"] = frame["meta_arrival"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def assemble_stream(packets: DataFrame) -> DataFrame:
    """Closed frames of a streaming packets table (see operators.frames); an open frame stays in the state."""
    return packets.groupBy("ssrc").transformWithStateInPandas(FrameAssembler(), OUTPUT, "Append", "none")


MESSAGES = "stream_id bigint, number bigint, class int, stream int, id bigint, msg_offset bigint, msg_length bigint, aux bigint, is_last boolean, eor int, payload binary, error string"
_MESSAGE = Row(*[x.split()[0] for x in MESSAGES.split(", ")])


class BinAssembler(StatefulProcessor):
    """Keeps what of a stream's bytes did not make a whole message yet, and the class and stream in force. Rows, not frames of
    pandas: most streams have a few chunks a micro-batch, for which making a frame takes longer than reading them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "data binary, class int, stream int, number bigint, broken boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        data, class_, stream, number, broken = self.tail.get() or (b"", 0, 0, 0, False)
        if broken:
            return
        chunks = sorted(((r["arrival"], r["bytes"]) for r in rows), key=lambda x: x[0])
        data, error = bytes(data) + b"".join(bytes(x) for _, x in chunks), None
        try:
            found, end, class_, stream = read_messages(data, class_, stream)
        except Malformed as e:
            found, end, error = e.found, len(data), str(e)
        count = len(found) + (error is not None)
        self.tail.update((data[end:], class_, stream, number + count, error is not None))
        for i, m in enumerate(found):
            yield _MESSAGE(key[0], number + i, *m[:8], data[m[8] : m[9]], None)
        if error is not None:
            yield _MESSAGE(key[0], number + len(found), *[None] * 9, error)

    def close(self) -> None:
        pass


def message_stream(chunks: DataFrame) -> DataFrame:
    """Messages of streams that arrive cut anywhere: chunks has stream_id, arrival, bytes. What follows an error is ignored."""
    return chunks.groupBy("stream_id").transformWithState(BinAssembler(), MESSAGES, "Append", "none")
