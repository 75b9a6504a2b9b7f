"""The final snapshot: its schema, its rows, and its metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldbook.functions.boxes import DETECTIONS
from fieldbook.operators import validate

# Fields of the snapshot, in order.
FIELDS = (
    f"filepath string not null, tags array<string>, jaguar_id string, ground_truth struct<label:string>, bboxes_body {DETECTIONS}, segmentations_body {DETECTIONS}, review_required boolean not null, review_reason string, review_status string, lineage_status string not null, lineage_match_method string, closed_set_split string, open_set_split string, sighting_id string, site string, location string, "
    "camera_id string, camera_side string, camera_model string, latitude double, longitude double, capture_date string, capture_time string, capture_datetime string, original_filename string, source_media_path string, source_type string, sha256 string not null, size_bytes bigint, width int, height int"
)


def schema() -> StructType:
    """The snapshot's schema; needs a running session."""
    return StructType.fromDDL(FIELDS)


REQUIRED = ["review_required", "lineage_status", "sha256", "size_bytes", "width", "height"]
SPLITS = ["closed_set_split", "open_set_split"]


def snapshot_rows(records: DataFrame, identity: str = "resolved_identity") -> DataFrame:
    """Records as snapshot rows: exactly the schema's fields, cast to its types; fields that the records lack are null."""
    named = {"jaguar_id": F.col(identity), "ground_truth": F.when(F.col(identity).isNotNull(), F.struct(F.col(identity).alias("label")))}
    boolean = {f.name for f in records.schema.fields if f.dataType.simpleString() == "boolean"}

    def number(f) -> Column:
        if f.name not in ("latitude", "longitude"):
            return F.col(f.name).cast(f.dataType)
        return F.lit(None).cast(f.dataType) if f.name in boolean else F.col(f.name).try_cast(f.dataType)  # a boolean is no number

    columns = [(named[f.name].cast(f.dataType) if f.name in named else number(f) if f.name in records.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema().fields]
    return records.select(*columns)


def snapshot_errors(rows: DataFrame) -> DataFrame:
    """(filepath, error) of rows that break the snapshot's contract."""
    rules = [*validate.required_rules(REQUIRED), *validate.annotation_rules(), *validate.enrichment_rules([], SPLITS, ["latitude", "longitude"])]
    return validate.error_rows(rows, "filepath", rules).unionByName(validate.unique_errors(rows, "filepath", "sha256", "sha256"))


def metadata(rows: DataFrame, label: str, split: str | None = None) -> dict:
    """Counts for a metadata file: samples, classes, samples by split."""
    n, classes = rows.agg(F.count(F.lit(1)), F.count_distinct(label)).first()
    splits = {r[split]: r["count"] for r in rows.groupBy(split).count().collect()} if split else {}
    return {"n_samples": n, "n_classes": classes, "splits": splits}


def ensure_table(spark: SparkSession, name: str, rows: DataFrame, overwrite: bool = False) -> DataFrame:
    """The catalogue table ``name``; made from ``rows`` if it isn't there or may be replaced."""
    if overwrite or not spark.catalog.tableExists(name):
        rows.write.mode("overwrite").saveAsTable(name)
    return spark.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
