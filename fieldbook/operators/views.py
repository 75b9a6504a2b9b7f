"""Tags, detection filters, variant and saved views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.functions import boxes as b

VARIANTS = ("master", "segmented", "segmented_deduplicated", "not_segmented", "not_segmented_deduplicated")
FILTERED_TAGS = ("filter_count", "filter_quality")


def images(samples: DataFrame) -> DataFrame:
    """The image slice of grouped samples, all samples otherwise."""
    return samples.where("group_slice = 'image'") if "group_slice" in samples.columns else samples


def tag_by_count(samples: DataFrame, field: str, expected: int = 1, tag: str = "filter_count") -> DataFrame:
    return samples.withColumn("tags", b.with_tag(F.col("tags"), tag, b.count_differs(F.col(field), expected)))


def tag_by_quality(samples: DataFrame, field: str, least_confidence: float = 0.5, least_area: float = 0.01, most_area: float = 1.0, tag: str = "filter_quality") -> DataFrame:
    return samples.withColumn("tags", b.with_tag(F.col("tags"), tag, b.any_unexpected(F.col(field), least_confidence, least_area, most_area)))


def without_tagged(samples: DataFrame, tags: list[str]) -> DataFrame:
    return samples.where(~b.has_any(F.col("tags"), tags))


def variant(samples: DataFrame, name: str, field: str | None = "detections", duplicate: str = "is_duplicate", filtered: tuple[str, ...] = FILTERED_TAGS) -> DataFrame:
    """The rows of a named variant: everything, with or without the segmentation field, with or without marked duplicates."""
    if name in ("master", "full"):
        return samples
    there = F.col(field).isNotNull() if field in samples.columns else F.lit(False)
    rows = samples.where(~there if name.startswith("not_segmented") else there)
    if name.endswith("deduplicated") and duplicate in samples.columns:
        rows = rows.where(~F.coalesce(F.col(duplicate), F.lit(False)))
    return without_tagged(rows, list(filtered)) if filtered else rows


def saved_views(snapshot: DataFrame) -> dict[str, DataFrame]:
    """The nine saved views of a snapshot."""
    views = {"all": snapshot, "lineage_unresolved": snapshot.where("lineage_status <> 'matched'"), "review_required": snapshot.where("review_required")}
    for kind in ("closed_set", "open_set"):
        for part in ("train", "val", "test"):
            views[f"{kind}_{part}"] = snapshot.where(F.col(f"{kind}_split") == part)
    return views


def patches(samples: DataFrame, field: str, label_field: str = "label", sample_label: str = "label") -> DataFrame:
    """A row per detection; its label, else the sample's; rows without either are dropped; a null split is ``train``."""
    rows = samples.select("*", F.posexplode(field).alias("patch", "detection"))
    rows = rows.withColumn("patch_label", F.coalesce(F.col(f"detection.{label_field}"), F.col(sample_label))).where("patch_label IS NOT NULL")
    return rows.withColumn("split", F.coalesce("split", F.lit("train"))) if "split" in rows.columns else rows


def write_back(samples: DataFrame, made: DataFrame, field: str, values: str) -> DataFrame:
    """Put ``made`` (sample_id, det_id, value) into the samples' detections by key; detections without a value keep null."""
    per_sample = made.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("det_id", "value"))).alias("__made"))
    joined = samples.join(per_sample, "sample_id", "left")
    return joined.withColumn(field, F.transform(field, lambda d: d.withField(values, F.col("__made")[d["id"]]))).drop("__made")


def keep_confident(samples: DataFrame, field: str, least: float) -> DataFrame:
    """Only detections of at least ``least`` confidence; samples left without any are dropped."""
    return samples.withColumn(field, b.confident(F.col(field), least)).where(F.size(field) > 0)
