"""Animation containers as tables: the frames of GIF and WebP files, without decoding pixels.

Files come through Spark's binaryFile reader, one row each; a small walk over the blocks of a
file emits a row for each frame. A malformed file gives one row with its error.
"""

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

_ROW = "path string, kind string, frame int, at long, delay_ms long, width int, height int, loop int, rest_sha256 string, bytes long, error string"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _sub_blocks(data: bytes, at: int) -> int:
    """The place after a chain of length-prefixed blocks."""
    while data[at]:
        at += data[at] + 1
    return at + 1


def gif_frames(data: bytes) -> list[dict]:
    """Frames with the place and value of their delay; rest_sha256 covers all bytes but delays.
    Every frame needs a control block of its own, and nothing may follow the trailer."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0
    at, control, loop, frames = 13 + table(data[10]), None, None, []
    while data[at] != 0x3B:
        if data[at] == 0x21 and data[at + 1] == 0xF9:
            if control is not None or data[at + 2] != 4 or data[at + 7]:
                raise ValueError("bad control block")
            control, at = at + 4, at + 8
        elif data[at] == 0x21:
            if data[at + 1] == 0xFF and data[at + 3 : at + 14] == b"NETSCAPE2.0":
                loop = struct.unpack_from("<H", data, at + 16)[0]
            at = _sub_blocks(data, at + 2)
        elif data[at] == 0x2C:
            if control is None:
                raise ValueError("frame without a control block")
            _, _, width, height, flags = struct.unpack_from("<4HB", data, at + 1)
            frames.append({"at": control, "delay_ms": struct.unpack_from("<H", data, control)[0] * 10, "width": width, "height": height})
            at, control = _sub_blocks(data, at + 11 + table(flags)), None
        else:
            raise ValueError(f"unknown block at {at}")
    if not frames or control is not None or at + 1 != len(data):
        raise ValueError("incomplete, or data after the trailer")
    rest = bytearray(data)
    for f in frames:
        rest[f["at"] : f["at"] + 2] = b"\0\0"
    return [f | {"loop": loop, "rest_sha256": hashlib.sha256(rest).hexdigest()} for f in frames]


def webp_frames(data: bytes) -> list[dict]:
    """Frames of the ANMF chunks of a RIFF file; a still image is one frame without a delay."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP header")
    if struct.unpack_from("<I", data, 4)[0] + 8 != len(data):
        raise ValueError("size differs")
    u24 = lambda i: int.from_bytes(data[i : i + 3], "little")
    at, loop, canvas, frames = 12, None, (None, None), []
    while at < len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > len(data):
            raise ValueError("chunk too long")
        if name == b"VP8X":
            canvas = u24(at + 12) + 1, u24(at + 15) + 1
        elif name == b"ANIM":
            loop = struct.unpack_from("<H", data, at + 12)[0]
        elif name == b"ANMF":
            frames.append({"at": at, "delay_ms": u24(at + 20), "width": u24(at + 14) + 1, "height": u24(at + 17) + 1})
        at += 8 + size + size % 2
    still = [{"at": 12, "delay_ms": None, "width": canvas[0], "height": canvas[1]}]
    return [f | {"loop": loop, "rest_sha256": None} for f in frames or still]


def frames_of(files: DataFrame) -> DataFrame:
    """One row a frame of GIF and WebP files (path, content): path, kind, frame (from 0), at (the
    byte of its delay or chunk), delay_ms, width, height, loop (null: not said), rest_sha256
    (GIF), bytes of the file. A file that is neither, null, empty or malformed has one row with
    its error."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                data = data or b""
                kind = "webp" if data[:4] == b"RIFF" else "gif"
                base = {"path": name, "kind": kind, "bytes": len(data)}
                try:
                    found = (webp_frames if kind == "webp" else gif_frames)(data)
                    rows += [base | {"frame": i} | f for i, f in enumerate(found)]
                except (ValueError, IndexError, struct.error) as e:
                    rows.append(base | {"error": str(e) if isinstance(e, ValueError) else "ends too early"})
            kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[c.split()[1]]) for n, c in zip(_NAMES, _ROW.split(", "), strict=True)], _NAMES)

    return files.select("path", "content").mapInArrow(walk, _ROW)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """frames_of all files of a path; the reader leaves files without any byte out."""
    return frames_of(spark.read.format("binaryFile").load(path))


def tail_delays(frames: DataFrame, total_ms: str) -> DataFrame:
    """frames of GIFs with `fixed_ms`: the delays, but the last one of a file such that they sum
    to its total (a column), 10 ms at least."""
    own = W.partitionBy("path")
    rest = F.round(F.col(total_ms) / 10) * 10 - (F.sum("delay_ms").over(own) - F.col("delay_ms"))
    is_last = F.col("frame") == F.max("frame").over(own)
    return frames.withColumn("fixed_ms", F.when(is_last, F.greatest(F.lit(10), rest)).otherwise(F.col("delay_ms")).cast("long"))
