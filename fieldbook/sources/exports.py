"""JSON exports of a sample store, as terminal records and as lineage candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions.boxes import DETECTIONS
from fieldbook.functions.text import blank_to_null, first_filled, is_absolute, normal_path, source_path
from fieldbook.session import materialize
from fieldbook.sources.fixed import EXPORT_FOLDERS, HEADER_ALIASES, MANIFESTS

# How an export lays out its samples.
SAMPLE = f"_id struct<`$oid`:string>, filepath string, jaguar_id string, ground_truth struct<label:string>, bboxes_body struct<detections:{DETECTIONS}>, segmentations_body struct<detections:{DETECTIONS}>, tags array<string>, review_required boolean, review_reason string, review_status string, closed_set_split string, open_set_split string, source_filepath string, original_filename string"


def read_export(spark: SparkSession, folder: str) -> DataFrame:
    """The samples of an export folder, one row each."""
    return spark.read.schema(f"samples array<struct<{_struct(SAMPLE)}>>").json(f"{folder}/samples.json", multiLine=True).select(F.explode("samples").alias("s")).select("s.*")


def _struct(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"`{f.name}`: {f.dataType.simpleString() if f.name != '_id' else 'struct<`$oid`:string>'}" for f in StructType.fromDDL(ddl).fields)


def terminal_records(samples: DataFrame) -> DataFrame:
    """Strict records: source_id, identity, relative path, annotations, review fields. The result is keyed, not ordered; sort where it is shown."""
    path = normal_path(F.col("filepath"))
    return samples.select(
        F.col("_id.`$oid`").alias("source_id"),
        first_filled(F.col("jaguar_id"), F.col("ground_truth.label")).alias("identity"),
        path.alias("filepath"),
        F.regexp_replace(path, "^.*?/(?=data/)", "").alias("relative_path"),
        F.element_at(F.split(path, "/"), -1).alias("filename"),
        F.col("bboxes_body.detections").alias("bboxes_body"),
        F.col("segmentations_body.detections").alias("segmentations_body"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("review_required", F.lit(False)).alias("review_required"),
        "review_reason",
        "review_status",
    )


#: Fields of a candidate that enrich a record, as text; the aliases of their headers are fixed values.
ENRICHMENT = ("closed_set_split", "open_set_split", "sighting_id", "site", "location", "camera_id", "camera_side", "camera_model", "latitude", "longitude", "capture_date", "capture_time", "capture_datetime", "source_type")


def read_loose(spark: SparkSession, folder: str) -> DataFrame:
    """(position, sample) of an export folder whatever its samples' fields are: names and values as text, nested values as JSON text."""
    return spark.read.schema("samples array<map<string,string>>").json(f"{folder}/samples.json", multiLine=True).select(F.posexplode("samples").alias("position", "sample"))


def export_candidates(samples: DataFrame, root: str, ordinal: int = 0) -> DataFrame:
    """Lenient candidates of one export: (position, sample) with fields by any of their aliases; ids are the places in the export.

    An absolute file path below ``root`` is relative to it; another one has no
    relative path, and is the source path if nothing else names one.
    """
    header = F.transform(F.map_entries("sample"), lambda e: F.struct(F.regexp_replace(F.regexp_replace(F.upper(e["key"]), "[^A-Z0-9]+", "_"), "^_+|_+$", "").alias("key"), e["value"].alias("value")))
    rows = samples.select("position", header.alias("cells"))
    cell = lambda name: F.get(F.filter("cells", lambda e: e["key"] == name)["value"], F.lit(0))
    scalar = lambda name: F.when(~cell(name).rlike(r"^\s*[\[{]"), blank_to_null(cell(name)))
    of = lambda field: F.coalesce(*[scalar(a) for a in HEADER_ALIASES[field]])
    an_id = lambda name: blank_to_null(F.coalesce(F.get_json_object(cell(name), "$.$oid"), scalar(name)))
    path = F.when(blank_to_null(cell("FILEPATH")).isNotNull(), normal_path(cell("FILEPATH")))
    base = root.rstrip("/") + "/"
    rows = rows.withColumns({"path": path, "own_name": F.element_at(F.split(path, "/"), -1), "composed": source_path(of("source_media_path"), of("file_path"), of("raw_data_path"), of("dataset_path"))})
    relative = F.when(~is_absolute(F.col("path")), F.col("path")).when(F.col("path").startswith(base), F.substr("path", F.lit(len(base) + 1)))
    source = F.coalesce(F.nullif("composed", F.lit(".")), F.when(is_absolute(F.col("path")), F.col("path")))
    named = of("original_filename")
    return rows.select(
        F.concat_ws("-", F.lit(f"export{ordinal}"), F.col("position").cast("string")).alias("candidate_id"),
        F.lit("export").alias("kind"),
        F.coalesce(of("jaguar_id"), F.get_json_object(cell("GROUND_TRUTH"), "$.label")).alias("identity"),
        F.coalesce(named, "own_name").alias("filename"),
        F.array_distinct(F.array_compact(F.array(*[an_id(n) for n in ("ID", "SOURCE_ID", "SAMPLE_ID", "SOURCE")]))).alias("source_ids"),
        source.alias("source_path"),
        relative.alias("relative_path"),
        F.array_distinct(F.array_compact(F.array(F.coalesce(named, "own_name"), F.element_at(F.split(source, "/"), -1), F.element_at(F.split(relative, "/"), -1)))).alias("filenames"),
        *[of(f).alias(f) for f in ENRICHMENT],
    )


def source_hash(spark: SparkSession, folder: str) -> str:
    """SHA-256 of the bytes of an export's ``samples.json``: what a later run must find unchanged."""
    row = spark.read.format("binaryFile").load(f"{folder}/samples.json").select(F.sha2("content", 256)).first()
    return row[0]


def conventional_paths(folder: str) -> tuple[list[str], list[str]]:
    """The export folders and the manifests of a working folder, in order of precedence."""
    return [f"{folder}/{p}" for p in EXPORT_FOLDERS], [f"{folder}/{p}" for p in MANIFESTS]


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Candidates of several sources with their source's ordinal; columns that a source lacks are null."""
    made = None
    for i, part in enumerate(parts):
        part = part.withColumn("source_ordinal", F.lit(i))
        made = part if made is None else made.unionByName(part, allowMissingColumns=True)
    return made


def load_candidates(spark: SparkSession, folders: list[str], manifests: list[str]) -> DataFrame:
    """Candidates of all exports, then of all manifests."""
    from fieldbook.sources.sheets import read_manifest

    parts = [export_candidates(read_loose(spark, f), f, i) for i, f in enumerate(folders)]
    found = union_sources(parts + [read_manifest(spark, m, i) for i, m in enumerate(manifests)])
    return materialize(found, "candidates")  # their ids are made once


def find_export_root(spark: SparkSession, folder: str) -> str | None:
    """The first folder at or below ``folder`` that holds both ``samples.json`` and ``metadata.json``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{samples,metadata}.json").load(folder).select("path")
    held = files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("root")).agg(F.count_distinct("path").alias("n")).where("n = 2")
    first = held.agg(F.min("root")).first()
    return first[0]


def load_dataset(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """(path, label, split) from an image folder (``disk``) or an exported dataset (``export``)."""
    from fieldbook.sources.files import image_folder

    if kind == "disk":
        return image_folder(spark, path)
    if kind == "export":
        rows = read_export(spark, path)
        split = F.coalesce("closed_set_split", "open_set_split", F.lit("train"))
        label = first_filled(F.col("jaguar_id"), F.col("ground_truth.label"))
        return rows.select(F.col("filepath").alias("path"), label.alias("label"), split.alias("split")).where("label IS NOT NULL")
    raise ValueError(f"unknown dataset kind {kind}")
