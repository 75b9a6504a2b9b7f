"""Validation: rules as columns, errors as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.boxes import box_error

SPLITS = ("train", "val", "test")


def rule(when: Column, message: str) -> Column:
    """``message`` where a row breaks the rule, else null."""
    return F.when(F.coalesce(when, F.lit(False)), F.lit(message))


def error_rows(rows: DataFrame, key: str, rules: list[Column]) -> DataFrame:
    """(key, error): one row for each rule that a row breaks."""
    return rows.select(key, F.explode(F.array_compact(F.array(*rules))).alias("error"))


def box_errors(detections: Column, field: str) -> Column:
    """All box errors of a detections column, joined, or null."""
    told = F.filter(F.transform(detections, lambda d, i: F.when(box_error(d["bounding_box"]).isNotNull(), F.concat(F.lit(f"{field}["), i.cast("string"), F.lit("]: "), box_error(d["bounding_box"])))), lambda e: e.isNotNull())
    return F.nullif(F.array_join(told, "; "), F.lit(""))


def annotation_rules(boxes: str = "bboxes_body", masks: str = "segmentations_body") -> list[Column]:
    """Both annotations or neither; neither only for rows under review, which must have a reason, be pending and be tagged."""
    b, m = F.col(boxes), F.col(masks)
    review = F.coalesce(F.col("review_required"), F.lit(False))
    return [
        rule(b.isNotNull() & m.isNull(), f"{masks} is missing"),
        rule(m.isNotNull() & b.isNull(), f"{boxes} is missing"),
        rule(b.isNull() & m.isNull() & ~review, "annotations are missing"),
        rule(review & (b.isNotNull() | m.isNotNull()), "a row under review must have no annotations"),
        rule(review & F.coalesce(F.trim("review_reason") == "", F.lit(True)), "review_reason is missing"),
        rule(review & ~F.coalesce(F.col("review_status") == "pending", F.lit(False)), "review_status must be pending"),
        rule(review & ~F.coalesce(F.array_contains("tags", "review_required"), F.lit(False)), "the review tag is missing"),
        rule(b.isNotNull() & (F.size(b) == 0), f"{boxes} is empty"),
        rule(m.isNotNull() & (F.size(m) == 0), f"{masks} is empty"),
        box_errors(b, boxes),
    ]


def enrichment_rules(texts: list[str], splits: list[str], coordinates: list[str]) -> list[Column]:
    """Texts not blank, splits known, coordinates finite; null is always allowed."""
    finite = lambda c: F.col(c).isNull() | (~F.isnan(c) & (F.abs(c) < float("inf")))
    return [*[rule(F.trim(c) == "", f"{c} is blank") for c in texts], *[rule(F.col(c).isNotNull() & ~F.col(c).isin(*SPLITS), f"{c} is unknown") for c in splits], *[rule(~finite(c), f"{c} is not finite") for c in coordinates]]


def required_rules(columns: list[str]) -> list[Column]:
    return [rule(F.col(c).isNull(), f"{c} is missing") for c in columns]


def identity_rules(identity: str) -> list[Column]:
    return [rule(F.col(identity).isNotNull() & (F.trim(identity) == ""), f"{identity} is blank")]


def unique_errors(rows: DataFrame, key: str, column: str, what: str) -> DataFrame:
    """(key, error) for every row whose ``column`` another row has, too."""
    twice = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return rows.join(twice, F.col(column) == F.col("__v")).select(key, F.concat(F.lit(f"{what} occurs "), F.col("__n").cast("string"), F.lit(" times")).alias("error"))


def count_error(rows: DataFrame, expected: int) -> DataFrame:
    """(error): one row if there aren't ``expected`` rows."""
    return rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected).select(F.concat(F.lit(f"expected {expected} rows, found "), F.col("n").cast("string")).alias("error"))


def validate(rows: DataFrame, key: str, rules: list[Column], unique: dict[str, str], readable: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows whose media can be read, all errors, and one row of diagnostics. Errors are collected, never just the first."""
    errors = error_rows(rows, key, rules)
    for column, what in unique.items():
        errors = errors.unionByName(unique_errors(rows, key, column, what))
    errors = errors.unionByName(error_rows(rows, key, [rule(~F.col(readable), "media cannot be read")]))
    diagnostics = errors.agg(F.count(F.lit(1)).alias("n_errors"), F.count_distinct(key).alias("n_rows_with_errors"))
    return rows.where(F.col(readable)), errors, diagnostics


def require_none(errors: DataFrame, what: str, shown: int = 20) -> None:
    """Raise with the first errors if there are any."""
    if first := errors.limit(shown).collect():
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in first))


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one of two tables but not, as often, in the other: empty if they agree."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def checksum_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sha256, left, right) where two maps of checksums (sha256, checksum) differ."""
    joined = a.toDF("sha256", "left").join(b.toDF("sha256", "right"), "sha256", "full")
    return joined.where(~F.col("left").eqNullSafe(F.col("right")))
