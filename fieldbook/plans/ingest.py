"""Whole runs: label sheets to samples, samples to processed variants, records to metrics. A dry run validates and returns counts without writing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.operators import clean, dedup, frames, inference, match, metrics, split, stats, views
from fieldbook.operators.vectors import random_units
from fieldbook.plans.publish import export_variants, to_json, write_text
from fieldbook.session import materialize
from fieldbook.sources.files import list_media
from fieldbook.sources.sheets import read_sheet
from fieldbook.sources.slides import read_slides


@dataclass(frozen=True)
class Processing:
    """Parameters of :func:`process`; there is no default for the similarity, as every caller means another."""

    similarity: float
    detections: str = "detections"
    expected: int = 1
    least_confidence: float = 0.5
    least_area: float = 0.01
    most_area: float = 1.0
    split_by: str = "open"
    seed: int = 42


def ingest(spark: SparkSession, folder: str, sheet: str, out: str, dry_run: bool = True) -> dict:
    """Clean a label sheet, match its files with those below ``folder``; write the rows, and a report of each step."""
    raw = read_sheet(spark, sheet)
    rows = clean.clean_sheet(clean.numbered_in_order(raw.withColumn("__o", F.monotonically_increasing_id()), "__o", "row").drop("__o"), "row", folder)
    listing = list_media(spark, folder)
    wanted = clean.numbered_in_order(rows, "row", "row_id").select("row_id", "*")
    found = match.match_missing(wanted.withColumns({"target": F.col("FILE NAME"), "site": F.col("`CAMERA TRAP SITE`"), "cam": F.col("CAM")}), listing)
    report = {"rows": raw.count(), "cleaned": rows.count(), "outcomes": {r["outcome"]: r["count"] for r in found.groupBy("outcome").count().collect()}, "unlabelled": match.unlabelled(listing, found.where("path IS NOT NULL").withColumnRenamed("path", "__p"), "__p").count(), "status": "dry_run" if dry_run else "done"}
    if not dry_run:
        found.write.mode("overwrite").csv(f"{out}/labels", header=True)
        write_text(spark, f"{out}/report.json", to_json(report))
    return report


def ingest_slides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pictures of all decks below ``folder`` as samples with identities filled in, their report, and the decks that could not be read."""
    read = materialize(read_slides(spark, folder), "slides")
    pictures = clean.numbered_in_order(read.where("error IS NULL").withColumn("__o", F.struct("deck", "slide", "picture")), "__o", "row").drop("__o")
    rows = clean.fill_identities_by_sex(clean.slide_rows(pictures, "row"), "identity", "sex", "row")
    return rows, stats.slide_report(rows), read.where("error IS NOT NULL").select("deck", "error")


def process(samples: DataFrame, how: Processing, videos: DataFrame | None = None, model: Callable[[], Callable[[list], list]] | None = None, payload: str = "filepath") -> DataFrame:
    """Sample frames of ``videos``, embed rows without a vector, tag detections, assign splits, mark duplicates.

    ``samples``: (sample_id, detections, tags, label, vector, ...). Frames get
    their video's label and an id of their own, a text. ``model`` is as for
    :func:`inference.infer`; rows that it fails on keep no vector and are no one's
    duplicates.
    """
    if videos is not None:
        made = frames.sample_frames(videos).select(F.concat_ws("-", F.col("sample_id").cast("string"), F.col("source_frame").cast("string")).alias("sample_id"), F.col("frame_path").alias("filepath"), "label")
        samples = samples.withColumn("sample_id", F.col("sample_id").cast("string")).unionByName(made.withColumn("tags", F.array().cast("array<string>")), allowMissingColumns=True)
    if model is not None:
        found = inference.infer(samples.where("vector IS NULL"), model, "sample_id", payload).select("sample_id", F.col("embedding").alias("__made"))
        samples = samples.join(found, "sample_id", "left").withColumn("vector", F.coalesce("vector", F.col("__made").cast(samples.schema["vector"].dataType))).drop("__made")
    samples = materialize(samples, "process-samples")
    rows = views.tag_by_quality(views.tag_by_count(samples, how.detections, how.expected), how.detections, how.least_confidence, how.least_area, how.most_area)
    rows = split.open_set_split(split.closed_set_split(rows, "label", seed=how.seed), "label", seed=how.seed)
    rows = split.main_split(rows, how.split_by)
    numbered = materialize(clean.numbered_in_order(rows.where("vector IS NOT NULL").select("sample_id", "vector"), "sample_id", "id"), "process-vectors")
    marks = dedup.greedy_leaders(numbered.select("id", "vector"), how.similarity)
    names = numbered.select("sample_id", "id")
    marks = marks.join(names, "id").join(names.toDF("leader", "at"), F.col("duplicate_of") == F.col("at"), "left")
    return rows.join(marks.select("sample_id", "is_duplicate", F.col("leader").alias("duplicate_of"), "duplicate_similarity"), "sample_id", "left")


def export(samples: DataFrame, target: str, fields: list[str] | None = None) -> dict[str, int]:
    return export_variants(samples, target, {v: views.variant(samples, v) for v in views.VARIANTS}, fields)


def evaluate(samples: DataFrame, part: str = "val", support: int = 9, mode: str = "standard", seed: int = 42) -> DataFrame:
    """Retrieval metrics of a split, over all its identities and over those with enough support in all splits.

    ``mode``: ``standard`` ranks by the samples' vectors, ``random_baseline`` by
    seeded random ones of the same size, which tells what chance alone gives.
    """
    if mode not in ("standard", "random_baseline"):
        raise ValueError(f"unknown mode {mode}")
    rows = samples.select(F.col("sample_id").alias("id"), "label", "vector", "split")
    some = rows.where(F.col("split") == part)
    if mode == "random_baseline":
        size = some.agg(F.max(F.size("vector"))).first()[0] or 1
        drawn = random_units(some.where("vector IS NOT NULL").select("id"), size, seed).withColumnRenamed("embedding", "vector")
        some = some.drop("vector").join(drawn, "id")
    kept = metrics.with_support(some, support, rows)
    return metrics.retrieval_metrics(some).withColumn("scope", F.lit("all")).unionByName(metrics.retrieval_metrics(kept).withColumn("scope", F.lit("supported")))
