"""Label sheets and manifests as DataFrames of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions.text import first_filled, header, source_path
from fieldbook.sources.fixed import HEADER_ALIASES

DELIMITERS = (";", ",", "\t", "|")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet, all columns text. The first delimiter that splits its header line is taken; one of one column is read as such."""
    line = (spark.read.text(path).limit(1).first() or [""])[0].lstrip("﻿")
    delimiter = next((d for d in DELIMITERS if d in line), ",")
    sheet = spark.read.csv(path, header=True, sep=delimiter, inferSchema=False, multiLine=True, escape='"')
    return sheet.toDF(*[c.lstrip("﻿") for c in sheet.columns])


def normalise_headers(sheet: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """``sheet`` with one text column per logical field: the first alias that isn't blank, null if no header matches."""
    by_name = {header(c): c for c in reversed(sheet.columns)}
    columns = []
    for field, names in aliases.items():
        there = [F.nullif(F.trim(F.col(f"`{by_name[header(n)]}`").cast("string")), F.lit("")) for n in names if header(n) in by_name]
        columns.append((F.coalesce(*there) if there else F.lit(None).cast("string")).alias(field))
    return sheet.select(*columns)


def read_manifest(spark: SparkSession, path: str, ordinal: int = 0) -> DataFrame:
    """A split manifest as lineage candidates; its source type is ``pptx`` if the file's name begins so, else ``csv``.

    Candidates are numbered by content and place, so equal rows stay two.
    """
    kind = "pptx" if path.rstrip("/").rsplit("/", 1)[-1].startswith("pptx_") else "csv"
    rows = normalise_headers(read_sheet(spark, path), HEADER_ALIASES)
    name = F.element_at(F.split(F.replace("file_path", F.lit("\\"), F.lit("/")), "/"), -1)
    direct = F.element_at(F.split(F.replace("source_media_path", F.lit("\\"), F.lit("/")), "/"), -1)
    return rows.withColumns(
        {
            "candidate_id": F.concat_ws("-", F.lit(f"manifest{ordinal}"), F.monotonically_increasing_id().cast("string")),
            "kind": F.lit("manifest"),
            "identity": F.col("jaguar_id"),
            "filename": first_filled(F.col("original_filename"), direct, name),
            "source_ids": F.array_compact(F.array("source_id")),
            "source_path": source_path(F.col("source_media_path"), F.col("file_path"), F.col("raw_data_path"), F.col("dataset_path")),
            "relative_path": F.col("export_relative_filepath"),
            "filenames": F.array_distinct(F.array_compact(F.array(F.col("original_filename"), direct, name))),
            "source_type": F.coalesce("source_type", F.lit(kind)),
            "latitude_value": F.col("latitude").try_cast("double"),
            "longitude_value": F.col("longitude").try_cast("double"),
        }
    )
