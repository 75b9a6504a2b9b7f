"""Joins of records with what was computed about them, by key and never by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from fieldbook.functions.text import normal_path
from fieldbook.operators.lineage import resolved_identity


def with_values(samples: DataFrame, made: DataFrame, key: str, column: str) -> DataFrame:
    """``samples`` with ``column`` of ``made`` (key, value); rows without a value get null, whatever they had."""
    values = made.groupBy(F.col(key).alias("__key")).agg(F.max_by("value", "value").alias("__value"))
    return samples.drop(column).join(values, F.col(key) == F.col("__key"), "left").withColumn(column, F.col("__value")).drop("__key", "__value")


def export_results(samples: DataFrame, results: DataFrame, column: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Results (filepath, value, order) on the samples of their path, the last by ``order`` where a path has several; and results of unknown paths."""
    last = results.groupBy("filepath").agg(F.max_by("value", order).alias("__value"))
    unknown = results.join(samples.select("filepath"), "filepath", "left_anti")
    return samples.join(last, "filepath", "left").withColumn(column, F.col("__value")).drop("__value"), unknown


def validated(terminals: DataFrame, enrichment: DataFrame, integrity: DataFrame, path: str = "filepath") -> DataFrame:
    """Terminal records with enrichment and media integrity by path, and the identity that they resolve to."""
    joined = terminals.join(enrichment, path, "left").join(integrity, path, "left")
    return joined.withColumn("resolved_identity", resolved_identity(F.col("identity"), F.col("lineage_status"), F.col("lineage_identity")))


def one_to_one_errors(raw: DataFrame, records: DataFrame, path: str = "path") -> DataFrame:
    """(path, error): paths that only one side has, or that a side has more than once."""
    count = lambda rows, name: rows.groupBy(path).agg(F.count(F.lit(1)).alias(name))
    both = count(raw, "n_raw").join(count(records, "n_records"), path, "full")
    what = F.when(F.col("n_raw").isNull(), "not in the source").when(F.col("n_records").isNull(), "no record").when((F.col("n_raw") > 1) | (F.col("n_records") > 1), "not unique")
    return both.select(path, what.alias("error")).where("error IS NOT NULL")


def media_path(path: Column, root: str) -> Column:
    """The normalised path below ``root``; null if it isn't strictly below it."""
    base = root.rstrip("/")
    full = normal_path(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(f"{base}/"), path)))
    return F.when(full.startswith(f"{base}/"), full)


def canonical(annotation: Column) -> Column:
    """An annotation's detections as text without generated ids, fields by name: equal text, equal meaning."""
    return F.to_json(F.transform(annotation, lambda d: F.struct(d["bounding_box"].alias("bounding_box"), d["confidence"].alias("confidence"), d["label"].alias("label"))))


def without_fields(value: Column, kind: DataType, names: tuple[str, ...] = ("_id",)) -> Column:
    """``value`` of a nested type without the fields of these names, however deep in structs, arrays and map values; other fields in order of their names.

    A struct that has no other field becomes an empty map, as no struct is empty.
    """
    if isinstance(kind, StructType):
        kept = sorted((f for f in kind.fields if f.name not in names), key=lambda f: f.name)
        if not kept:
            return F.when(value.isNotNull(), F.create_map().cast("map<string,string>"))
        return F.when(value.isNotNull(), F.struct(*[without_fields(value.getField(f.name), f.dataType, names).alias(f.name) for f in kept]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: without_fields(x, kind.elementType, names))
    if isinstance(kind, MapType):
        values = F.transform_values(value, lambda _, x: without_fields(x, kind.valueType, names))
        return F.map_filter(values, lambda k, _: ~k.isin(*names)) if isinstance(kind.keyType, StringType) else values
    return value


def meaning(rows: DataFrame, column: str, into: str) -> DataFrame:
    """``rows`` with ``into``: the column as JSON without generated identifiers, fields by name; equal text, equal meaning."""
    return rows.withColumn(into, F.to_json(F.struct(without_fields(F.col(column), rows.schema[column].dataType).alias("v"))))


def expected_path(rows: DataFrame, listing: DataFrame, name: str, site: str, cam: str, photo_dir: str = "ID PHOTOS") -> DataFrame:
    """``rows`` with the path where each file should be: as listed by name, else by stem, else site, camera or photo folder, and name; null without a site."""
    from fieldbook.functions import text as t
    from fieldbook.operators.match import index

    files = index(listing)
    by_name = files.groupBy("name").agg(F.min(F.struct("depth", "path")).alias("by_name"))
    by_stem = files.groupBy("stem").agg(F.min(F.struct("depth", "path")).alias("by_stem"))
    keyed = rows.withColumns({"__name": t.file_key(F.col(name)), "__stem": t.file_key(t.stem(F.col(name)))})
    joined = keyed.join(by_name, F.col("__name") == F.col("name"), "left").drop("name") if name != "name" else keyed.join(by_name.withColumnRenamed("name", "__n"), F.col("__name") == F.col("__n"), "left").drop("__n")
    joined = joined.join(by_stem.withColumnRenamed("stem", "__s"), F.col("__stem") == F.col("__s"), "left")
    built = F.when(t.file_type(F.col(name)) == "VIDEO", F.concat_ws("/", F.lit("sites"), site, cam, name)).otherwise(F.concat_ws("/", F.lit("sites"), F.col(site), F.lit(photo_dir), F.col(name)))
    path = F.coalesce("by_name.path", "by_stem.path", F.when(F.col(site).isNotNull(), built))
    return joined.withColumn("expected_path", path).drop("__name", "__stem", "__s", "by_name", "by_stem")


def detections_of(exported: Column, good: Column) -> Column:
    """An export's detections as typed ones: those with a label and a box; ``good`` tells of each (by position) whether its mask can be read."""
    kept = F.filter(F.zip_with(exported, good, lambda d, ok: F.struct(d.alias("d"), ok.alias("ok"))), lambda x: F.coalesce(x["ok"], F.lit(False)) & x["d"]["label"].isNotNull() & (F.size(x["d"]["bounding_box"]) == 4))
    return F.transform(kept, lambda x: x["d"])
