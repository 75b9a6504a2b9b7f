"""Listings of media files, image folders, and media integrity. Paths are any that Spark reads."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions.text import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, extension


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """(path, size) of all files below ``folder``, paths relative to it; contents are never read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.split("://", 1)[-1].rstrip("/")
    rows = rows.select(F.regexp_replace("path", f"^.*?\\Q{base}\\E/", "").alias("path"), F.col("length").alias("size"))
    return rows.where(extension(F.col("path")).isin(*[e.lower().lstrip(".") for e in extensions])) if extensions else rows


def list_media(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder, (*VIDEO_EXTENSIONS, *IMAGE_EXTENSIONS))


def image_rows(listing: DataFrame) -> DataFrame:
    """(path, split, label) of the images in a listing (path) of a ``split/class/file`` tree."""
    parts = F.split("path", "/")
    images = listing.where(extension(F.col("path")).isin("jpg", "jpeg", "png") & (F.size(parts) >= 3))
    return images.select("path", F.element_at(parts, -3).alias("split"), F.element_at(parts, -2).alias("label"))


def image_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, split, label) of a ``split/class/file`` tree of images."""
    return image_rows(list_files(spark, folder, ("jpg", "jpeg", "png")))


def image_header(data: bytes | None) -> tuple[int | None, int | None, bool]:
    """Width, height, and whether a PNG or JPEG file is whole: its chunks or segments follow on each other up to the end mark."""
    try:
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data and data[:2] == b"\xff\xd8":
            return _jpeg(data)
    except (struct.error, IndexError):
        pass
    return None, None, False


def _png(data: bytes) -> tuple[int | None, int | None, bool]:
    at, size = 8, (None, None)
    while at < len(data):
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + length]
        size = struct.unpack(">II", body[:8]) if kind == b"IHDR" else size
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + length : at + 12 + length])[0]:
            return *size, False
        if kind == b"IEND":
            return *size, size[0] is not None
        at += 12 + length
    return *size, False


def _jpeg(data: bytes) -> tuple[int | None, int | None, bool]:
    at, size = 2, (None, None)
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        length = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            size = (width, height)
        if mark == 0xDA:
            return *size, size[0] is not None and data.rstrip(b"\0")[-2:] == b"\xff\xd9"
        at += 2 + length
    return *size, False


_HEADER = "struct<width:int,height:int,whole:boolean>"


def integrity_of(media: DataFrame) -> DataFrame:
    """(path, size_bytes, sha256, width, height, readable) of (path, content): PNG and JPEG files are verified, others are readable unless empty."""

    @F.pandas_udf(_HEADER)
    def header(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_header(c) for c in contents], columns=["width", "height", "whole"]).astype({"width": "Int32", "height": "Int32"})

    rows = media.withColumn("__header", header("content"))
    readable = F.when(extension(F.col("path")).isin(*IMAGE_EXTENSIONS), F.col("__header.whole")).otherwise(F.octet_length("content") > 0)
    return rows.select("path", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "__header.width", "__header.height", F.coalesce(readable, F.lit(False)).alias("readable"))


def integrity(spark: SparkSession, folder: str) -> DataFrame:
    """:func:`integrity_of` all files below ``folder``."""
    return integrity_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content"))


def rewrite_converted(rows: DataFrame, listing: DataFrame, path: str, old: str = "avi", new: str = "mp4") -> DataFrame:
    """``rows`` whose file has a converted twin beside it name the twin."""
    twins = listing.where(extension(F.col("path")) == new).select(F.col("path").alias("__twin")).distinct()
    wanted = F.when(extension(F.col(path)) == old, F.concat(F.regexp_replace(path, r"\.[^.]*$", ""), F.lit(f".{new}")))
    return rows.join(twins, wanted == F.col("__twin"), "left").withColumn(path, F.coalesce("__twin", path)).drop("__twin")
