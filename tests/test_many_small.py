"""Many small files, requests and streams: what each costs."""

import numpy as np
import pandas as pd
from pyspark.sql import Row

from tessera.sources import images, jpp
from tessera.streaming.frames import BinAssembler
from tessera.streaming.sessions import Session


def test_small_images_are_read_together(spark, tmp_path):
    images.register(spark)
    planes = {f"i{k:02d}": [np.arange(k, k + 6 * c).reshape(c, 6)[i::c] % 256 for i in range(c)] for k in range(20) for c in ((1, 3)[k % 2],)}
    for name, p in planes.items():
        (tmp_path / f"{name}.{'pgm' if len(p) == 1 else 'ppm'}").write_bytes(images.write_pnm(p))
    df = spark.read.format("pnm").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 1
    got = {(r["path"].rsplit("/", 1)[1][:-4], r["c"], r["y"]): r["row"] for r in df.collect()}
    assert got == {(name, c, y): row.tolist() for name, p in planes.items() for c, plane in enumerate(p) for y, row in enumerate(plane)}
    assert images._Reader(str(tmp_path / "none"), "*.pgx", images.read_pgx).partitions()[0].paths == []


class Held:
    def __init__(self):
        self.values, self.calls = {}, 0

    def _call(self):
        self.calls += 1

    def containsKey(self, k):
        self._call()
        return k in self.values

    def getValue(self, k):
        self._call()
        return self.values[k]

    def updateValue(self, k, v):
        self._call()
        self.values[k] = v

    def removeKey(self, k):
        self._call()
        self.values.pop(k, None)


def test_a_bin_is_read_from_the_state_once():
    """A thousand requests for the same three bins; what a client takes back is asked for again."""
    s = Session()
    s.held = Held()
    rows = [{"request": i, "bins": [{"id": b, "size": 10 + b} for b in range(3)], "budget": None, "model": None} for i in range(1000)]
    rows[500]["model"] = [{"id": 1, "kind": "remove", "bytes": None}]
    rows[999]["model"] = [{"id": 2, "kind": "remove", "bytes": None}, {"id": 7, "kind": "partial", "bytes": 4}]
    rows[999]["bins"] = None
    (out,) = s.handleInputRows(("a",), iter([pd.DataFrame(rows)]), None)
    sent = out[out["id"].notna()]
    assert sent[["request", "id", "sent"]].values.tolist() == [[0, 0, 10], [0, 1, 11], [0, 2, 12], [500, 1, 11]]
    assert s.held.values == {(0,): (10, True), (1,): (11, True), (7,): (4, False)} and s.held.calls <= 12


class Value:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_messages_without_frames_of_pandas():
    """Chunks in no order, over two calls, and an error at the end."""
    whole = jpp.message_header(0, 3, 0, 4, True) + b"abcd" + b"\x00\x02\x00"
    b = BinAssembler()
    b.tail = Value()
    row = Row("stream_id", "arrival", "bytes")
    first = list(b.handleInputRows((9,), iter([row(9, 1, bytearray(whole[2:5])), row(9, 0, bytearray(whole[:2]))]), None))
    rest = list(b.handleInputRows((9,), iter([row(9, 2, bytearray(whole[5:] + b"\x05\x05"))]), None))
    assert first == [] and [(r["number"], r["id"], r["payload"], r["eor"]) for r in rest[:2]] == [(0, 3, b"abcd", None), (1, None, b"", 2)]
    assert rest[2]["error"] and list(b.handleInputRows((9,), iter([row(9, 3, b"x")]), None)) == []
