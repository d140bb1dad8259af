import hashlib
import struct

from fernweave.sources.containers import frames_of, gif_frames, read_frames, tail_delays


def gif(delays, extra=b""):
    """A GIF of 2 x 1 pixels with a global table of two colours."""
    out = b"GIF89a" + struct.pack("<HHBBB", 2, 1, 0x80, 0, 0) + bytes(6)
    out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x05\x00\x00"
    for d in delays:
        out += b"\x21\xf9\x04\x00" + struct.pack("<H", d) + b"\x00\x00"
        out += b"\x2c" + struct.pack("<4HB", 0, 0, 2, 1, 0) + b"\x02\x02\x44\x01\x00"
    return out + b"\x3b" + extra


def webp(delays):
    body = b"VP8X" + struct.pack("<I", 10) + bytes([2, 0, 0, 0]) + (15).to_bytes(3, "little") + (7).to_bytes(3, "little")
    body += b"ANIM" + struct.pack("<I", 6) + bytes(4) + struct.pack("<H", 3)
    for d in delays:
        frame = bytes(6) + (15).to_bytes(3, "little") + (7).to_bytes(3, "little") + d.to_bytes(3, "little") + b"\0" + b"xyz"
        body += b"ANMF" + struct.pack("<I", len(frame)) + frame + b"\0" * (len(frame) % 2)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def test_containers(spark, tmp_path):
    files = {"a.gif": gif([3, 7, 10]), "b.webp": webp([40, 80]), "c.gif": gif([5], b"x"), "d.gif": gif([5])[:-9], "f.webp": webp([40])[:-1], "g.gif": gif([])}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = sorted(read_frames(spark, f"file://{tmp_path}").collect(), key=lambda r: (r.path, r.frame or 0))
    by = {}
    for r in rows:
        by.setdefault(r.path[-6:].lstrip("/"), []).append(r)
    a = by["a.gif"]
    assert [(r.frame, r.delay_ms, r.width, r.height, r.loop, r.error) for r in a] == [(0, 30, 2, 1, 5, None), (1, 70, 2, 1, 5, None), (2, 100, 2, 1, 5, None)]
    assert [(r.delay_ms, r.width, r.height, r.loop) for r in by["b.webp"]] == [(40, 16, 8, 3), (80, 16, 8, 3)]
    assert all(len(by[n]) == 1 and by[n][0].error for n in ("c.gif", "d.gif", "f.webp", "g.gif"))
    data = bytearray(files["a.gif"])
    for r in a:
        assert struct.unpack_from("<H", data, r.at)[0] * 10 == r.delay_ms
        data[r.at : r.at + 2] = b"\0\0"
    assert a[0].rest_sha256 == hashlib.sha256(data).hexdigest() == gif_frames(gif([1, 2, 3]))[0]["rest_sha256"]
    fixed = tail_delays(read_frames(spark, f"file://{tmp_path}/a.gif").selectExpr("*", "251 AS total"), "total")
    assert [r.fixed_ms for r in sorted(fixed.collect(), key=lambda r: r.frame)] == [30, 70, 150]


def test_rows_without_content(spark):
    got = frames_of(spark.createDataFrame([("a", None), ("b", b"")], "path string, content binary")).collect()
    assert [(r.path, r.error, r.bytes) for r in got] == [("a", "no GIF header", 0), ("b", "no GIF header", 0)]
