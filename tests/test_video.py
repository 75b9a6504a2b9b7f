"""Video headers of awkward files."""

import struct

import pytest

from fieldbook.sources import video


def box(kind, *content):
    body = b"".join(content)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def movie(version=0, scale=1000, length=4000, runs=((100, 40),)):
    head = struct.pack(">B3xQQIQ4x", 1, 0, 0, scale, length) if version else struct.pack(">B3xIIII4x", 0, 0, 0, scale, length)
    times = box(b"stts", struct.pack(">II", 0, len(runs)), *[struct.pack(">II", *r) for r in runs])
    media = box(b"mdia", box(b"mdhd", head), box(b"hdlr", bytes(8), b"vide", bytes(13)), box(b"minf", box(b"stbl", times)))
    return box(b"ftyp", b"isom") + box(b"moov", box(b"trak", media))


def test_movies():
    told = video.video_header(movie())
    assert (told["fps"], told["frame_count"], told["seconds"], told["error"]) == (25.0, 100, 4.0, None)
    assert video.video_header(movie(1, 90_000, 90_000 * 3, ((60, 3000), (30, 3000))))["fps"] == 30.0
    whole = struct.pack(">I4sQ", 1, b"mdat", 20) + bytes(4)  # a 64-bit size, and a last box without one
    assert video.video_header(movie()[:12] + whole + movie()[12:] + struct.pack(">I4s", 0, b"free") + bytes(9))["frame_count"] == 100
    assert video.video_header(movie(scale=0, runs=()))["fps"] is None


@pytest.mark.parametrize("content", [None, b"", b"x", b"RIFF", b"RIFF\0\0\0\0AVI ", movie()[:-5], movie()[:40], b"\0\0\0\x08free", struct.pack(">I4s", 4, b"moov") + bytes(30), box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", b"\0\0\0")))])
def test_broken_files_are_errors(content):
    told = video.video_header(content)
    assert told["error"] and told["fps"] is None and told["frame_count"] is None


def test_a_folder_of_videos(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.MP4").write_bytes(movie())
    (tmp_path / "a/y.avi").write_bytes(b"no video")
    (tmp_path / "z.txt").write_bytes(b"no video")
    got = {r.path.rsplit("/", 1)[-1]: (r.container, r.frame_count, r.error is None) for r in video.video_folder(spark, str(tmp_path)).collect()}
    assert got == {"x.MP4": ("mp4", 100, True), "y.avi": (None, None, False)}
