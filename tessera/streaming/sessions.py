"""Sessions: what a client holds is kept from request to request, so that each response sends only what is missing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session string, request bigint, id bigint, skip bigint, sent bigint, complete boolean, reason int"
#: Why a response ends. Fixed values of the format.
WINDOW_DONE, BYTE_LIMIT = 2, 4


class Session(StatefulProcessor):
    """Holdings of one session by bin. A response is made from the holdings as they are when its request's turn comes, and is
    committed to them before the next request's turn; so is what a client says that it holds, or no longer holds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "id bigint", "bytes bigint, complete boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        self.now: dict[int, tuple[int, bool] | None] = {}  # bins that this call has met; each is read from the state once
        self.kept: dict[int, tuple[int, bool] | None] = {}  # as the state has them
        for r in pd.concat(list(rows)).sort_values("request", kind="stable").itertuples(index=False):
            for said in [] if r.model is None else r.model:
                self._say(int(said["id"]), said["kind"], said["bytes"])
            out += self._answer(key[0], int(r.request), [] if r.bins is None else r.bins, None if pd.isna(r.budget) else int(r.budget))
        for i, value in self.now.items():
            if value is None and self.kept[i] is not None:
                self.held.removeKey((i,))
            elif value != self.kept[i]:
                self.held.updateValue((i,), value)
        columns = [x.split()[0] for x in OUTPUT.split(", ")]
        yield pd.DataFrame(out, columns=columns).astype({"id": "Int64", "skip": "Int64", "sent": "Int64", "complete": "boolean", "reason": "Int32"})

    def _have(self, i: int) -> tuple[int, bool]:
        if i not in self.now:
            self.now[i] = self.kept[i] = tuple(self.held.getValue((i,))) if self.held.containsKey((i,)) else None
        return self.now[i] or (0, False)

    def _say(self, i: int, kind: str, size) -> None:
        bytes_, complete = self._have(i)
        if kind == "remove":
            self.now[i] = None
        elif kind == "complete":
            self.now[i] = (bytes_, True)
        elif not complete:
            self.now[i] = (max(bytes_, 0 if pd.isna(size) else int(size)), False)

    def _answer(self, session: str, request: int, bins, budget: int | None) -> list[tuple]:
        out, reason = [], WINDOW_DONE
        left = budget
        sent: list[tuple[int, int, bool]] = []
        for b in bins:
            i, size = int(b["id"]), int(b["size"])
            skip, complete = self._have(i)
            if complete:
                continue
            wanted = max(0, size - skip)
            n = wanted if left is None else min(wanted, left)
            if left is not None and left <= 0:
                reason = BYTE_LIMIT
                break
            done = n == wanted
            out.append((session, request, i, skip, n, done, None))
            sent.append((i, skip + n, done))
            if left is not None:
                left -= n
            if not done:
                reason = BYTE_LIMIT
                break
        for i, bytes_, done in sent:
            self.now[i] = (bytes_, done)
        return [*out, (session, request, None, None, sum(x[4] for x in out), None, reason)]

    def close(self) -> None:
        pass


def serve_stream(requests: DataFrame) -> DataFrame:
    """A streaming table of requests to what their responses send: session, request, id, skip (bytes held before), sent, complete for
    each bin that is sent, in the order asked for, and a row without id that ends a response, with all its bytes and the reason.

    requests: session (string), request (a number that orders a session's requests), bins (array of id and size, each bin once),
    budget (most bytes of the response, null for all; 0 gives the end only), model (array of id, kind and bytes: what the client says
    first, kind being 'partial', 'complete' or 'remove'). A bin that is held in full is not sent; one that is held in
    part goes on there; one that the budget cuts goes on with the next request. A session's requests come in order of their
    numbers, also from one micro-batch to the next. State grows with the bins that a session was sent.
    """
    return requests.groupBy("session").transformWithStateInPandas(Session(), OUTPUT, "Append", "none")
