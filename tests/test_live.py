"""Capture files to frames, as they come."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import frames
from tessera.sources import jpp, rtp
from tessera.streaming.frames import assemble_stream


def packet(seq, ts, ssrc, marker, main, r, body):
    head = bytes([0x80, 0x60 | marker << 7]) + (seq & 0xFFFF).to_bytes(2, "big") + ts.to_bytes(4, "big") + ssrc.to_bytes(4, "big")
    return head + bytes([0x40 * main, 0, 0, seq >> 16 & 255, 0x80 * (main and r), 0, 0, 0]) + body


def test_captures_to_frames(spark, tmp_path):
    folder = tmp_path / "captures"
    folder.mkdir()
    for ssrc in (5, 6):
        sent = [(65534 + 4 * f + i, f, i == 3, i == 0, f == 0) for f in range(6) for i in range(4)]
        lost = [p for p in sent if ssrc == 5 or p[0] % 9 != 4]
        raw = b"".join(b"\xff\xff" + len(p).to_bytes(2, "big") + p for p in (packet(s, t, ssrc, m, a, r, b"x" * (s % 7)) for s, t, m, a, r in lost))
        (folder / f"{ssrc}.rtp").write_bytes(raw)
    batch = frames.assemble(rtp.frame_input(rtp.parse_packets(rtp.read_captures(spark, str(folder)))))
    want = {tuple(r) for r in batch.filter("status <> 'open'").collect()}
    assert {r[6] for r in want} == {"emitted", "lossy"}
    live = assemble_stream(rtp.frame_input(rtp.parse_packets(rtp.stream_captures(spark, str(folder)))))
    q = live.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
    q.trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("live").select(batch.columns).collect()} == want
    assert spark.table("live").filter(F.col("ssrc") == 5).filter("status = 'emitted'").count() == 6


@given(st.integers(0, 2**56 - 1))
def test_numbers_round_trip(value):
    raw = jpp.to_vbas(value)
    assert jpp.vbas(raw, 0) == (value, len(raw)) and len(raw) == max(1, -(-value.bit_length() // 7))


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 2, 6, 8]), st.integers(0, 2**40), st.integers(0, 10**6), st.binary(max_size=40), st.booleans()), max_size=8), st.data())
def test_messages_split_anywhere(items, data):
    raw, last, want = b"", None, []
    for c, i, offset, body, end in items:
        raw += jpp.message_header(None if c == last else c, i, offset, len(body), end) + body
        want.append((c, i, offset, len(body), end))
        last = c
    cut = data.draw(st.integers(0, len(raw)))
    found, at, c, s = jpp.read_messages(raw[:cut])
    more = jpp.read_messages(raw[at:], c, s)[0]
    assert [(m[0], m[2], m[3], m[4], m[6]) for m in found + more] == want
