"""Curation: a versioned policy over a source table gives a complete decision log and the kept rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.text import stable_id
from fieldbook.operators.dedup import conflicts, representatives
from fieldbook.operators.validate import box_errors, require_none


def check_policy(source: DataFrame, policy: DataFrame) -> DataFrame:
    """(path, error): actions on unknown paths, and paths with two actions. ``policy``: path, action (false_positive, review, clip), reason, box."""
    unknown = policy.join(source.select("path"), "path", "left_anti").select("path", F.lit("not in the source").alias("error"))
    twice = policy.groupBy("path").count().where("count > 1").select("path", F.lit("has several actions").alias("error"))
    return unknown.unionByName(twice)


def valid_annotation(source: DataFrame) -> Column:
    """Whether a row has boxes, all of them sound, and masks where there is a column of masks."""
    boxes = F.col("bboxes_body")
    sound = F.coalesce(F.size(boxes) > 0, F.lit(False)) & box_errors(boxes, "bboxes_body").isNull()
    return sound & F.coalesce(F.size("segmentations_body") > 0, F.lit(False)) if "segmentations_body" in source.columns else sound


def decide(source: DataFrame, policy: DataFrame, valid: Column | None = None) -> DataFrame:
    """Every source row (path, sha256, identity, compatible, bboxes_body, ...) with decision, reason, keep_path, group_size and kept.

    Of equal content, over all rows, one row represents the group: one with a
    ``valid`` annotation (by default :func:`valid_annotation`), then one with an
    identity, then a compatible one, then the least path. The others go. The
    policy acts on representatives alone: a confirmed false positive goes, and
    its whole group with it; rows under review and clipped rows stay with that
    decision. Actions on other rows are errors, see :func:`action_errors`.
    """
    rows = source.join(policy.select(F.col("path").alias("__p"), "action", F.col("reason").alias("action_reason"), "box"), F.col("path") == F.col("__p"), "left").drop("__p")
    every = representatives(rows, "sha256", valid_annotation(source) if valid is None else valid, F.col("identity"), F.col("compatible"), "path").withColumnRenamed("kept", "represents")
    wrong = F.coalesce(F.col("action") == "false_positive", F.lit(False))
    kept = F.col("represents") & ~wrong
    decision = F.when(~kept, "drop").when(F.col("action") == "review", "review").when(F.col("action") == "clip", "clip").otherwise("keep")
    reason = F.when(~F.col("represents"), "exact_content_duplicate").when(wrong, "confirmed_false_positive").when(F.col("action") == "review", F.coalesce("action_reason", F.lit("review")))
    return every.withColumns({"kept": kept, "decision": decision, "reason": reason}).drop("represents")


def action_errors(decisions: DataFrame) -> DataFrame:
    """(path, error): actions of the policy that didn't take effect, as another row represents their content."""
    applied = F.when(F.col("action") == "false_positive", F.col("reason") == "confirmed_false_positive").otherwise(F.col("decision") == F.col("action"))
    return decisions.where(F.col("action").isNotNull() & ~F.coalesce(applied, F.lit(False))).select("path", F.concat(F.col("action"), F.lit(" was not applied")).alias("error"))


def annotation_errors(decisions: DataFrame, valid: Column | None = None) -> DataFrame:
    """(path, error): kept rows without a sound annotation that are neither under review nor clipped."""
    sound = valid_annotation(decisions) if valid is None else valid
    return decisions.where((F.col("decision") == "keep") & ~sound).select("path", F.lit("annotation is not valid").alias("error"))


def curated(decisions: DataFrame, version: str) -> DataFrame:
    """The kept rows with a stable id; clipped rows take the policy's box, rows under review lose their boxes, are pending and tagged."""
    review = F.col("decision") == "review"
    boxes = F.when(review, None).when(F.col("decision") == "clip", F.transform("bboxes_body", lambda d: d.withField("bounding_box", F.col("box")))).otherwise(F.col("bboxes_body"))
    return decisions.where("decision <> 'drop'").withColumns(
        {"sample_id": stable_id(F.lit(version), F.col("path")), "bboxes_body": boxes, "review_required": review, "review_status": F.when(review, "pending"), "tags": F.when(review, F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("review_required")))).otherwise(F.col("tags"))}
    )


def clip_errors(decisions: DataFrame) -> DataFrame:
    """(path, error): clipped rows that don't have exactly one detection."""
    return decisions.where("decision = 'clip' AND coalesce(size(bboxes_body), 0) <> 1").select("path", F.lit("a clipped row must have one detection").alias("error"))


def report(decisions: DataFrame) -> DataFrame:
    """(measure, value): source, kept and dropped rows, drops by reason, identities populated, null and distinct, duplicate groups."""
    kept = F.col("decision") != "drop"
    one = decisions.agg(
        F.count(F.lit(1)).alias("source"),
        F.count_if(kept).alias("kept"),
        F.count_if(~kept).alias("dropped"),
        F.count_if(F.col("reason") == "exact_content_duplicate").alias("dropped_duplicates"),
        F.count_if(F.col("reason") == "confirmed_false_positive").alias("dropped_false_positives"),
        F.count_if(F.col("decision") == "review").alias("review"),
        F.count_if(F.col("decision") == "clip").alias("clipped"),
        F.count_if(kept & F.col("identity").isNotNull()).alias("identified"),
        F.count_if(kept & F.col("identity").isNull()).alias("unidentified"),
        F.count_distinct(F.when(kept, F.col("identity"))).alias("identities"),
        F.count_distinct(F.when(F.col("group_size") > 1, F.col("sha256"))).alias("duplicate_groups"),
    )
    return one.unpivot([], one.columns, "measure", "value")


def require_counts(decisions: DataFrame, expected: dict[str, int]) -> None:
    """Raise if a measure of :func:`report` isn't as the policy expects."""
    found = {r["measure"]: r["value"] for r in report(decisions).collect()}
    if wrong := {k: (v, found.get(k)) for k, v in expected.items() if found.get(k) != v}:
        raise ValueError(f"counts differ from the policy (expected, found): {wrong}")


def plan(source: DataFrame, policy: DataFrame, version: str, expected: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Decisions and curated rows, once the policy and its counts hold.

    It fails if the policy names unknown paths, if equal content has two
    identities, if a clipped row hasn't one detection, if a kept row's annotation
    isn't valid, if an action wasn't applied, or if a count isn't as expected.
    """
    require_none(check_policy(source, policy), "policy")
    require_none(conflicts(source.withColumn("annotation", F.lit("")), "sha256", "identity", "annotation"), "identities")
    decisions = decide(source, policy)
    require_none(clip_errors(decisions), "clips")
    require_none(annotation_errors(decisions), "annotations")
    require_none(action_errors(decisions), "actions")
    if expected:
        require_counts(decisions, expected)
    return decisions, curated(decisions, version)
