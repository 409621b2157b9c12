import json
import struct

from tickloom.sources import ctf

METADATA = """/* CTF 1.8 */
typealias integer { size = 8; align = 8; signed = false; } := uint8_t;
typealias integer { size = 32; align = 8; signed = false; } := uint32_t;
typealias integer { size = 64; align = 8; signed = false; } := unsigned long;
trace { major = 1; minor = 8; byte_order = le; packet.header := struct { uint32_t magic; uint32_t stream_id; }; };
env { hostname = "h1"; };
clock { name = mono; freq = 1000000000; offset_s = 1; offset = 5; };
struct header { enum : integer { size = 5; align = 1; signed = false; } { compact = 0 ... 30, extended = 31 } id;
  variant <id> { struct { integer { size = 27; align = 1; signed = false; map = clock.mono.value; } timestamp; } compact;
    struct { uint32_t id; integer { size = 64; align = 8; map = clock.mono.value; } timestamp; } extended; } v; } align(8);
stream { id = 0; event.header := struct header; packet.context := struct { unsigned long timestamp_begin; uint32_t content_size; uint32_t packet_size; uint32_t events_discarded; uint32_t cpu_id; }; };
event { name = "first"; id = 2; stream_id = 0; fields := struct { string _name; uint8_t n; uint8_t _data[n]; enum : uint8_t { A, B = 7 ... 9 } _e; }; };
event { name = "big"; id = 40; stream_id = 0; fields := struct { integer { size = 16; signed = true; align = 8; byte_order = be; } _x; floating_point { exp_dig = 8; mant_dig = 24; align = 8; byte_order = le; } _f; }; };
"""


def _stream():
    def compact(i, ts):
        return struct.pack("<I", i | (ts & ((1 << 27) - 1)) << 5)

    begin = (3 << 27) - 10
    body = compact(2, begin + 4) + b"hi\0" + bytes([2, 8, 9]) + bytes([8])
    body += compact(2, begin + 20) + b"\0" + bytes([0]) + bytes([0])  # the 27 bits have run over
    body += struct.pack("<B", 31) + struct.pack("<IQ", 40, begin + 99) + struct.pack(">h", -5) + struct.pack("<f", 1.5)
    head = 4 + 4 + 8 + 16
    size = head + len(body) + 8
    return begin, struct.pack("<IIQIIII", ctf.MAGIC, 0, begin, 8 * (head + len(body)), 8 * size, 3, 6) + body + b"\0" * 8


def test_trace(spark, tmp_path):
    begin, data = _stream()
    (tmp_path / "metadata").write_text(METADATA)
    (tmp_path / "channel_0").write_bytes(data + data[:20])
    rows = ctf.read(spark, str(tmp_path)).orderBy("rank").collect()
    base = 10**9 + 5
    assert [(r.type, r.ts, r.cpu) for r in rows] == [("lost", base + begin, 6), ("first", base + begin + 4, 6), ("first", base + begin + 20, 6), ("big", base + begin + 99, 6)]
    assert json.loads(rows[1].fields) == {"name": "hi", "n": 2, "data": [8, 9], "e": "B"}
    assert json.loads(rows[2].fields) == {"name": "", "n": 0, "data": [], "e": "A"}
    assert json.loads(rows[3].fields) == {"x": -5, "f": 1.5} and json.loads(rows[0].fields)["count"] == 3


def test_packeted_metadata():
    body = METADATA.encode()
    head = struct.pack("<I16sIIIBBBBB", ctf.METADATA_MAGIC, b"\0" * 16, 0, 8 * (37 + len(body)), 8 * (37 + len(body)), 0, 0, 0, 1, 8)
    meta = ctf.Parser(ctf.metadata_text(head + body)).parse()
    assert meta.env == {"hostname": "h1"} and set(meta.events) == {(0, 2), (0, 40)}
