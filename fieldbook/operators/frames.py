"""Frame sampling from video metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_numbers(fps: Column, frames: Column, early_rate: float, early_seconds: float, late_rate: float) -> Column:
    """Frames to take, ascending: densely at first, sparsely later; a rate of 0 leaves its phase out; bad metadata gives none."""
    early = F.least((fps * early_seconds).cast("int"), frames)
    step = lambda rate: F.greatest(F.lit(1), (fps / rate).cast("int"))
    none = F.array().cast("array<int>")
    first = F.when(early > 0, F.sequence(F.lit(0), early - 1, step(early_rate))).otherwise(none) if early_rate > 0 else none
    start = (fps * early_seconds).cast("int")
    then = F.when(start < frames, F.sequence(start, frames - 1, step(late_rate))).otherwise(none) if late_rate > 0 else none
    return F.when((fps > 0) & (frames > 0), F.array_sort(F.array_union(first, then))).otherwise(none)


def sample_frames(videos: DataFrame, early_rate: float = 2.0, early_seconds: float = 1.0, late_rate: float = 0.5, folder: str = "frames", suffix: str = "jpg") -> DataFrame:
    """A row per sampled frame of (sample_id, filepath, fps, frame_count, ...): its number, source frame, path; the video's other columns stay."""
    stem = F.regexp_replace(F.element_at(F.split("filepath", "/"), -1), r"\.[^.]*$", "")
    numbers = frame_numbers(F.col("fps"), F.col("frame_count").cast("int"), early_rate, early_seconds, late_rate)
    rows = videos.select("*", F.posexplode(numbers).alias("frame_index", "source_frame"))
    path = F.format_string(f"{folder}/%s_%s/%06d.{suffix}", stem, F.col("sample_id").cast("string"), F.col("frame_index"))
    return rows.withColumns({"source_video": F.col("filepath"), "frame_path": path, "group_slice": F.lit("image")})
