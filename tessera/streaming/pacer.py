"""When frames of a stream are to be shown, with a reference that moves when a frame comes far too late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Periods by which a frame may be late before the reference moves.
MOST_LATE = 4
OUTPUT = "ssrc bigint, frame bigint, shown double, rebased boolean"


def pace(frames: list[tuple[int, int, float]], state: tuple | None, period: float) -> tuple[list[tuple], tuple | None]:
    """frames: (number, ticks, ready at second). State: reference ticks and second, second of the last one shown."""
    out = []
    for number, ticks, ready in frames:
        if state is None:
            out.append((number, ready, False))
            state = (ticks, ready, ready)
            continue
        ref_ticks, ref_at, last = state
        target = last + period
        if ticks != ref_ticks:
            target = ref_at + ((ticks - ref_ticks + 2**31) % 2**32 - 2**31) / 90000.0
        late = ready - target > MOST_LATE * period
        if late:
            ref_ticks, ref_at = ticks, ready
        shown = max(target, ready)
        out.append((number, shown, late))
        state = (ref_ticks, ref_at, shown)
    return out, state


def pacer(period: float) -> StatefulProcessor:
    class Pacer(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("reference", "ticks bigint, at double, last double")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            frames = pd.concat(list(rows)).sort_values("frame")
            before = tuple(self.state.get()) if self.state.exists() else None
            out, after = pace(list(zip(frames["frame"], frames["ticks"], frames["ready"], strict=True)), before, period)
            if after is not None:
                self.state.update((int(after[0]), float(after[1]), float(after[2])))
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["ssrc", "frame", "shown", "rebased"])

        def close(self) -> None:
            pass

    return Pacer()


def pace_stream(frames: DataFrame, fps: float) -> DataFrame:
    """frames: ssrc, frame, ticks (90 kHz, 32 bits), ready (seconds). A frame is shown when due, or at once if late."""
    return frames.groupBy("ssrc").transformWithStateInPandas(pacer(1.0 / fps), OUTPUT, "Append", "none")
