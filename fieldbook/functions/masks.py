"""Masks: decoding, union, boxes and composites. Work on arrays inside Arrow batches; null and broken masks give null."""

from __future__ import annotations

import base64
import io
import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType


def decode(value: str | None) -> np.ndarray | None:
    """A 2-D mask of 0 and 1 from a JSON list of rows, or from base64 of zlib of an ``npy`` file, bare or as ``{"$binary": {"base64": ...}}``."""
    if value is None or not value.strip():
        return None
    try:
        text = value.strip()
        if text[0] in "[{":
            read = json.loads(text)
            if isinstance(read, list):
                return _checked(np.array(read))
            text = read["$binary"]["base64"]
        return _checked(np.load(io.BytesIO(zlib.decompress(base64.b64decode(text))), allow_pickle=False))
    except (ValueError, KeyError, TypeError, zlib.error, EOFError):
        return None


def _checked(mask: np.ndarray) -> np.ndarray | None:
    good = mask.ndim == 2 and mask.size and np.isin(mask, (0, 1)).all()
    return mask.astype(np.uint8) if good else None


def encode(mask: np.ndarray) -> str:
    out = io.BytesIO()
    np.save(out, mask.astype(np.uint8))
    return base64.b64encode(zlib.compress(out.getvalue())).decode()


_SHAPE = StructType([StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("pixels", IntegerType()), StructField("box", ArrayType(DoubleType()))])


def shape(column: Column) -> Column:
    """Height, width, pixels set and their relative bounding box of each encoded mask."""

    def shapes(values: pd.Series) -> pd.DataFrame:
        rows = []
        for mask in map(decode, values):
            if mask is None:
                rows.append((None, None, None, None))
                continue
            (h, w), y, x = mask.shape, np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
            box = [x[0] / w, y[0] / h, (x[-1] + 1 - x[0]) / w, (y[-1] + 1 - y[0]) / h] if len(y) else None
            rows.append((h, w, int(mask.sum()), box))
        return pd.DataFrame(rows, columns=["height", "width", "pixels", "box"], dtype=object).astype({"height": "Int32", "width": "Int32", "pixels": "Int32"})

    return F.pandas_udf(shapes, _SHAPE)(column)


def place(mask: np.ndarray, box: list[float], height: int, width: int) -> np.ndarray:
    """A mask, nearest neighbour, in its relative box on an empty image."""
    out = np.zeros((height, width), np.uint8)
    x0, y0 = int(box[0] * width), int(box[1] * height)
    w, h = max(1, int(box[2] * width)), max(1, int(box[3] * height))
    rows = (np.arange(h) * mask.shape[0] // h)[: max(0, height - y0)]
    columns = (np.arange(w) * mask.shape[1] // w)[: max(0, width - x0)]
    out[y0 : y0 + len(rows), x0 : x0 + len(columns)] = mask[np.ix_(rows, columns)]
    return out


def union(masks: list[tuple[np.ndarray, list[float]]], height: int, width: int) -> np.ndarray:
    """All masks of an image as one."""
    out = np.zeros((height, width), np.uint8)
    for mask, box in masks:
        out |= place(mask, box, height, width)
    return out


def composite(image: np.ndarray, mask: np.ndarray, mode: str = "rgb_masked") -> np.ndarray:
    """The image as it is (``raw``), black outside the mask (``rgb_masked``), black inside (``background``), or the mask itself (``binary_mask``)."""
    if mode == "raw":
        return image
    if mode == "binary_mask":
        return mask * np.uint8(255)
    if mode in ("rgb_masked", "background"):
        kept = mask if mode == "rgb_masked" else 1 - mask
        return image * (kept[..., None] if image.ndim == 3 else kept)
    raise ValueError(f"unknown mode {mode}")


MASKS = "array<struct<mask:string,box:array<double>>>"


def union_shape(masks: Column, height: Column, width: Column) -> Column:
    """Height, width, pixels set and relative bounding box of all of an image's masks (:data:`MASKS`) laid over each other; null without any."""

    def shapes(values: pd.Series, heights: pd.Series, widths: pd.Series) -> pd.DataFrame:
        rows = []
        for some, h, w in zip(values, heights, widths, strict=True):
            whole = None if some is None else _united(some, int(h), int(w))
            if whole is None:
                rows.append((None, None, None, None))
                continue
            y, x = np.flatnonzero(whole.any(1)), np.flatnonzero(whole.any(0))
            box = [x[0] / w, y[0] / h, (x[-1] + 1 - x[0]) / w, (y[-1] + 1 - y[0]) / h] if len(y) else None
            rows.append((h, w, int(whole.sum()), box))
        return pd.DataFrame(rows, columns=["height", "width", "pixels", "box"], dtype=object).astype({"height": "Int32", "width": "Int32", "pixels": "Int32"})

    return F.pandas_udf(shapes, _SHAPE)(masks, height, width)


def _united(some, height: int, width: int) -> np.ndarray | None:
    """The masks of an image as one; broken ones are left out."""
    read = [(mask, [float(v) for v in m["box"]]) for m in some if m["box"] is not None and len(m["box"]) == 4 and (mask := decode(m["mask"])) is not None]
    return union(read, height, width) if read else None


def render(pixels: Column, height: Column, width: Column, masks: Column, mode: str = "rgb_masked") -> Column:
    """The pixels of each image (bytes, rows first, one or more bands) as :func:`composite` shows them; null where bytes and size disagree or nothing masks."""
    if mode not in ("raw", "rgb_masked", "background", "binary_mask"):
        raise ValueError(f"unknown mode {mode}")

    def show(images: pd.Series, heights: pd.Series, widths: pd.Series, masks: pd.Series) -> pd.Series:
        out = []
        for data, h, w, some in zip(images, heights, widths, masks, strict=True):
            bands = len(data) // (h * w) if data is not None and h and w else 0
            whole = None if some is None or not bands else _united(some, int(h), int(w))
            if not bands or bands * h * w != len(data) or whole is None and mode != "raw":
                out.append(None)
                continue
            image = np.frombuffer(data, np.uint8).reshape(int(h), int(w), bands)
            out.append(composite(image, whole, mode).tobytes())
        return pd.Series(out, dtype=object)

    return F.pandas_udf(show, "binary")(pixels, height, width, masks)


def crop(pixels: Column, height: Column, width: Column, box: Column) -> Column:
    """The part of each image (as in :func:`render`) inside a relative box, as (height, width, pixels); null where nothing is left."""

    def cut(images: pd.Series, heights: pd.Series, widths: pd.Series, boxes: pd.Series) -> pd.DataFrame:
        rows = []
        for data, h, w, b in zip(images, heights, widths, boxes, strict=True):
            bands = len(data) // (h * w) if data is not None and h and w else 0
            part = np.zeros((0, 0, 1), np.uint8)
            if bands and bands * h * w == len(data) and b is not None and len(b) == 4:
                x0, y0 = int(b[0] * w), int(b[1] * h)
                part = np.frombuffer(data, np.uint8).reshape(int(h), int(w), bands)[y0 : int((b[1] + b[3]) * h), x0 : int((b[0] + b[2]) * w)]
            rows.append((part.shape[0], part.shape[1], part.tobytes()) if part.size else (None, None, None))
        return pd.DataFrame(rows, columns=["height", "width", "pixels"], dtype=object).astype({"height": "Int32", "width": "Int32"})

    return F.pandas_udf(cut, "struct<height:int,width:int,pixels:binary>")(pixels, height, width, box)
