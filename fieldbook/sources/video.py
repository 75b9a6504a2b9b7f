"""What the containers of videos say about them: frame rate, number of frames, duration and size, without decoding.

MP4 files are boxes within boxes, AVI files chunks within lists; only headers are
read, and the media between them is stepped over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_SCHEMA = "path string, container string, width int, height int, fps double, frame_count long, seconds double, error string"


def _boxes(data: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    """Kind and content of the boxes in ``data``; a box that claims more than there is ends the walk with an error."""
    at = 0
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1:
            (size,), head = struct.unpack(">Q", data[at + 8 : at + 16]), 16
        elif size == 0:
            size = len(data) - at
        if size < head or at + size > len(data):
            raise ValueError(f"box {kind.decode('latin-1')} is cut off")
        yield kind, data[at + head : at + size]
        at += size


def _inside(data: memoryview, *way: bytes) -> Iterator[memoryview]:
    """The boxes at the end of a way of kinds."""
    for kind, content in _boxes(data):
        if kind == way[0]:
            if len(way) == 1:
                yield content
            else:
                yield from _inside(content, *way[1:])


def _mp4(data: memoryview) -> dict:
    for track in _inside(data, b"moov", b"trak"):
        if bytes(next(_inside(track, b"mdia", b"hdlr"))[8:12]) != b"vide":
            continue
        head = next(_inside(track, b"mdia", b"mdhd"))
        scale, length = struct.unpack(">IQ", head[20:32]) if head[0] == 1 else struct.unpack(">II", head[12:20])
        times = next(_inside(track, b"mdia", b"minf", b"stbl", b"stts"))
        (n,) = struct.unpack(">I", times[4:8])
        runs = list(struct.iter_unpack(">II", times[8 : 8 + 8 * n]))
        frames, ticks = sum(k for k, _ in runs), sum(k * t for k, t in runs)
        size = next(_inside(track, b"tkhd"), None)
        width, height = (v >> 16 for v in struct.unpack(">II", size[-8:])) if size is not None else (None, None)
        seconds = (length or ticks) / scale if scale else None
        return {"width": width, "height": height, "fps": frames * scale / ticks if ticks else None, "frame_count": frames, "seconds": seconds}
    raise ValueError("no video track")


def _chunks(data: memoryview) -> Iterator[tuple[bytes, memoryview]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack("<4sI", data[at : at + 8])
        if at + 8 + size > len(data):
            raise ValueError(f"chunk {kind.decode('latin-1')} is cut off")
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def _avi(data: memoryview) -> dict:
    found: dict = {}
    for kind, content in _chunks(data[12:]):
        if kind != b"LIST" or bytes(content[:4]) != b"hdrl":
            continue
        for name, part in _chunks(content[4:]):
            if name == b"avih":
                micros, frames = struct.unpack("<I", part[:4])[0], struct.unpack("<I", part[16:20])[0]
                width, height = struct.unpack("<II", part[32:40])
                found |= {"width": width, "height": height, "fps": 1e6 / micros if micros else None, "frame_count": frames}
            elif name == b"LIST" and bytes(part[:4]) == b"strl":
                head = next((p for k, p in _chunks(part[4:]) if k == b"strh"), b"")
                if bytes(head[:4]) == b"vids":  # the stream's own rate is exact, the file's is in whole microseconds
                    scale, rate, _, length = struct.unpack("<IIII", head[20:36])
                    found |= {"fps": rate / scale if scale and rate else found.get("fps"), "frame_count": length or found.get("frame_count")}
        if "fps" not in found:
            raise ValueError("no main header")
        return found | {"seconds": found["frame_count"] / found["fps"] if found["fps"] else None}
    raise ValueError("no header list")


def video_header(content: bytes | None) -> dict:
    """container, width, height, fps, frame_count, seconds and error of a file's bytes."""
    told: dict = dict.fromkeys(("container", "width", "height", "fps", "frame_count", "seconds", "error"))
    try:
        data = memoryview(content or b"")
        if bytes(data[:4]) == b"RIFF" and bytes(data[8:12]) == b"AVI ":
            told["container"] = "avi"
            told |= _avi(data)
        elif bytes(data[4:8]) in (b"ftyp", b"moov", b"mdat", b"free", b"wide", b"skip"):
            told["container"] = "mp4"
            told |= _mp4(data)
        else:
            told["error"] = "neither MP4 nor AVI"
    except (ValueError, struct.error, IndexError, StopIteration) as error:
        told["error"] = str(error) or "a header is missing"
    return told


def video_headers(media: DataFrame) -> DataFrame:
    """(path, container, width, height, fps, frame_count, seconds, error) of (path, content): what sampling frames needs.

    A file that is empty, null, cut off or of another kind is a row with an
    error. A video's bytes are one value, of 2 GB at most.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([{"path": p} | video_header(c) for p, c in zip(batch["path"], batch["content"], strict=True)], columns=["path", "container", "width", "height", "fps", "frame_count", "seconds", "error"])
            yield rows.astype({"width": "Int32", "height": "Int32", "frame_count": "Int64", "fps": "Float64", "seconds": "Float64"})

    return media.select("path", "content").mapInPandas(read, _SCHEMA)


def video_folder(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`video_headers` of the videos below ``folder``; Spark passes over files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return video_headers(files.where("lower(path) RLIKE '[.](mp4|mov|m4v|avi)$'"))
