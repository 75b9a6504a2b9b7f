"""Column functions for boxes, detections and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A detection: relative box [x, y, width, height].
DETECTION = "struct<id:string,label:string,confidence:double,bounding_box:array<double>>"
DETECTIONS = f"array<{DETECTION}>"


def box_error(box: Column) -> Column:
    """What is wrong with a box, or null: four finite numbers, not negative, inside the unit square."""
    at = lambda i: F.get(box, F.lit(i))
    finite = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.when(box.isNull() | (F.size(box) != 4), "box must have four numbers")
        .when(~F.coalesce(finite, F.lit(False)), "box must be finite")
        .when(F.exists(box, lambda x: x < 0), "box must not be negative")
        .when((at(0) + at(2) > 1) | (at(1) + at(3) > 1), "box must lie inside the image")
    )


def crop_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """A pixel crop as a relative box, clamped to the image; null if missing or degenerate."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    x, y, r, b = unit(left / width), unit(top / height), unit(right / width), unit(bottom / height)
    good = (width > 0) & (height > 0) & (r > x) & (b > y)
    return F.when(good, F.array(x, y, r - x, b - y))


def pixel_crop(size: Column, before: Column, after: Column) -> tuple[Column, Column]:
    """First and last pixel of a crop given as shares cut off, truncated as integers."""
    return (size * before).cast("int"), (size * (1 - after)).cast("int")


def area(box: Column) -> Column:
    return F.get(box, F.lit(2)) * F.get(box, F.lit(3))


def count_differs(detections: Column, expected: int) -> Column:
    """Whether there aren't ``expected`` detections; null counts as none."""
    return F.when(detections.isNull(), F.lit(expected != 0)).otherwise(F.size(detections) != expected)


def any_unexpected(detections: Column, least_confidence: float, least_area: float, most_area: float) -> Column:
    """Whether any detection is unsure, too small or too large; null has none."""
    bad = lambda d: (d["confidence"] < least_confidence) | (area(d["bounding_box"]) < least_area) | (area(d["bounding_box"]) > most_area)
    return F.coalesce(F.exists(detections, bad), F.lit(False))


def confident(detections: Column, least: float) -> Column:
    return F.filter(detections, lambda d: d["confidence"] >= least)


def with_tag(tags: Column, tag: str, when: Column) -> Column:
    """``tags`` with ``tag`` where ``when`` holds, once."""
    base = F.coalesce(tags, F.array().cast("array<string>"))
    return F.when(when, F.array_union(base, F.array(F.lit(tag)))).otherwise(base)


def without_tag(tags: Column, tag: str) -> Column:
    return F.array_remove(F.coalesce(tags, F.array().cast("array<string>")), tag)


def has_any(tags: Column, wanted: list[str]) -> Column:
    """Whether any of ``wanted`` is among the tags; null tags have none."""
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, wanted)).cast("array<string>")), F.lit(False))
