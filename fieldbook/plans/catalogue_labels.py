"""Queries over label sheets, manifests, exports, listings, paths and names, with SQL that gives the same rows.

What a source reads is written to the scratch folder first, from a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions import boxes, text
from fieldbook.operators import clean, match, records
from fieldbook.plans.registry import query
from fieldbook.session import scratch_path, table
from fieldbook.sources import exports, files, sheets
from fieldbook.sources.fixed import PHOTO_DIRS


def said(prefix: str, c: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), c.cast("string"), F.lit(suffix))


@query(
    "SELECT 'Site 0' || s_nationkey AS site, CASE WHEN s_suppkey % 3 > 0 THEN 'F' || s_suppkey END AS identity, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'B' END AS cam, 'v' || s_suppkey || '.mp4 and w.jpg' AS file, 'n; ' || s_suppkey AS notes FROM supplier WHERE s_suppkey % 10 <> 9"
)
def label_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet written with semicolons: the delimiter is found, known columns are kept, empty rows go."""
    k = F.col("s_suppkey")
    there = k % 10 != 9
    rows = table(spark, sf, "supplier").select(
        F.when(there, said("Site 0", F.col("s_nationkey"))).alias("CAMERA TRAP SITE"),
        F.when(there & (k % 3 > 0), said("F", k)).alias(" JAGUAR ID "),
        F.when(there, F.when(k % 2 == 0, "a").otherwise("B")).alias("CAM"),
        F.when(there, said("v", k, ".mp4 and w.jpg")).alias("Files Name"),
        said("n; ", k).alias("NOTES/ ERRORS"),
        said("x", k).alias("UNKNOWN"),
    )
    path = scratch_path(spark, "sheet")
    rows.write.csv(path, header=True, sep=";")
    read = clean.check_columns(sheets.read_sheet(spark, path))
    return read.toDF(*[{"CAMERA TRAP SITE": "site", "JAGUAR ID": "identity", "CAM": "cam", "Files Name": "file", "NOTES": "notes"}[c] for c in read.columns])


@query(
    "WITH x AS (SELECT p_partkey AS k, 'SITE ' || (p_size % 9) AS site, CASE WHEN p_partkey % 2 = 0 THEN 'CAM A' ELSE 'CAM B' END AS cam, CASE p_partkey % 5 WHEN 0 THEN '?' WHEN 1 THEN NULL WHEN 2 THEN 'u' || p_partkey ELSE 'F' || p_size END AS who, CASE WHEN p_partkey % 3 = 0 THEN '2020-02-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') ELSE '' END AS day, unnest(['f' || (p_partkey % 50) || '.mp4', 'g' || (p_partkey % 70) || '.JPG']) AS file, unnest([0, 1]) AS pos FROM part), "
    "u AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY site, cam, who, file ORDER BY k, pos) = 1), t AS (SELECT coalesce(max(try_cast(regexp_extract(who, '(?i)^\\s*U(\\d+)\\s*$', 1) AS BIGINT)), 0) AS top FROM u) "
    "SELECT k AS row, 'S' || k AS sighting, site, cam, CASE WHEN who IS NULL OR who = '?' THEN 'U' || ((SELECT top FROM t) + row_number() OVER (PARTITION BY who IS NULL OR who = '?' ORDER BY k, pos)) ELSE who END AS identity, file, CASE WHEN pos = 0 THEN 'VIDEO' ELSE 'IMAGE' END AS kind, CASE WHEN pos = 0 THEN 'mp4' ELSE 'jpg' END AS extension, day AS date, CASE WHEN day <> '' THEN day || ' 10:00:00' END AS at FROM u"
)
def cleaned_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cleaning chain of a label sheet."""
    p = F.col("p_partkey")
    sheet = table(spark, sf, "part").select(
        p.cast("string").alias("row"),
        said("  site 0", F.col("p_size") % 9).alias("CAMERA TRAP SITE"),
        F.when(p % 5 == 0, "?").when(p % 5 == 1, None).when(p % 5 == 2, said("u", p)).otherwise(said("F", F.col("p_size"))).alias("JAGUAR ID"),
        F.when(p % 2 == 0, "a").otherwise("Cam-B").alias("CAM"),
        F.concat(said("f", p % 50, ".mp4 and "), said("g", p % 70, ".JPG, ")).alias("Files Name"),
        F.when(p % 3 == 0, F.concat(F.lit("2/"), (F.col("p_size") % 28 + 1).cast("string"), F.lit("/2020"))).alias("DATE"),
        F.lit("10:00:00").alias("TIME"),
    )
    made = clean.clean_sheet(sheet, "row", "/data")
    return made.select(F.col("row"), F.col("SIGHTING_ID").alias("sighting"), F.col("`CAMERA TRAP SITE`").alias("site"), F.col("CAM").alias("cam"), F.col("`JAGUAR ID`").alias("identity"), F.col("`Files Name`").alias("file"), F.col("`FILE TYPE`").alias("kind"), F.col("`FILE EXTENSION`").alias("extension"), F.col("DATE").alias("date"), F.col("DATETIME").alias("at"))


@query(
    "WITH x AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN ['F', 'M'][c_custkey % 2 + 1] || c_custkey END AS who, CASE c_custkey % 4 WHEN 0 THEN 'Female' WHEN 1 THEN 'm' WHEN 2 THEN '' ELSE 'other' END AS sex, CASE c_custkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE 'U' END AS p FROM customer), t AS (SELECT substr(who, 1, 1) AS p, max(substr(who, 2)::BIGINT) AS top FROM x WHERE who IS NOT NULL GROUP BY 1) "
    "SELECT k AS c_custkey, coalesce(who, x.p || (coalesce(top, 0) + row_number() OVER (PARTITION BY x.p, who IS NULL ORDER BY k))) AS who FROM x LEFT JOIN t ON x.p = t.p"
)
def identities_by_sex(spark: SparkSession, sf: str) -> DataFrame:
    """Missing identities become the next number of their sex."""
    k = F.col("c_custkey")
    who = F.when(k % 3 > 0, F.concat(F.when(k % 2 == 0, "F").otherwise("M"), k.cast("string"))).when(k % 2 == 0, " ")
    sex = F.when(k % 4 == 0, "Female").when(k % 4 == 1, "m").when(k % 4 == 2, "").otherwise("other")
    return clean.fill_identities_by_sex(table(spark, sf, "customer").select("c_custkey", who.alias("who"), sex.alias("sex")), "who", "sex", "c_custkey").select("c_custkey", "who")


@query(
    "SELECT c_custkey, 'ACAI' || c_custkey AS identity, 'SITE ' || (c_custkey % 9 + 1) AS site, CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE '?' END AS sex, 'seen ' || c_nationkey AS notes, 'by the river' AS location, CASE WHEN c_custkey % 2 = 0 THEN '2020-03-04' ELSE '2021-05-06' END AS date, 'PP' || row_number() OVER (ORDER BY c_custkey) AS sighting FROM customer"
)
def slide_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled fields of a slide's text as a row of a label table."""
    k = F.col("c_custkey")
    body = F.concat(
        said("NUMBER ID: Açaí", k, "? (old)\nSITE: 00"), (k % 9 + 1).cast("string"), F.lit("\nSEX: "), F.when(k % 3 == 0, "Female adult").when(k % 3 == 1, "macho").otherwise("?"), F.lit(" LOCALIZAÇÃO: by   the\nriver DATAS: "), F.when(k % 2 == 0, "").otherwise("6-5-2021"), F.lit(" OBS: seen "), F.col("c_nationkey").cast("string"), F.when(k % 2 == 0, "").otherwise("")
    )
    rows = table(spark, sf, "customer").select("c_custkey", F.when(k % 2 == 0, F.concat(F.lit("3/4/2020 "), body)).otherwise(body).alias("text"))
    made = clean.slide_rows(rows, "c_custkey")
    return made.select("c_custkey", "identity", "site", "sex", "notes", "location", "date", F.col("SIGHTING_ID").alias("sighting"))


_BOX = "x AS (SELECT p_partkey, greatest(least((p_size - 5) / 100.0, 1), 0)::DOUBLE AS l, greatest(least(p_size / 80.0, 1), 0)::DOUBLE AS t, greatest(least((p_size + p_partkey % 90 - 4) / 100.0, 1), 0)::DOUBLE AS r, greatest(least((p_size + 20) / 80.0, 1), 0)::DOUBLE AS b FROM part)"


@query(f"WITH {_BOX} SELECT p_partkey, CASE WHEN r > l AND b > t THEN round(l, 6) END AS x, CASE WHEN r > l AND b > t THEN round(r - l, 6) END AS w, CASE WHEN r > l AND b > t THEN round(b - t, 6) END AS h, CAST(floor(640 * (p_partkey % 10) / 10.0) AS INT) AS first_pixel, CAST(floor(640 * (1 - (p_partkey % 4) / 8.0)) AS INT) AS last_pixel FROM x")
def crop_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel crops as relative boxes, and crops given as shares as pixels."""
    size, p = F.col("p_size").cast("double"), F.col("p_partkey")
    box = boxes.crop_box(size - 5, size, size + p % 90 - 4, size + 20, F.lit(100), F.lit(80))
    first, last = boxes.pixel_crop(F.lit(640), (p % 10) / 10, (p % 4) / 8)
    at = lambda i: F.round(F.get(box, F.lit(i)), 6)
    return table(spark, sf, "part").select("p_partkey", at(0).alias("x"), at(2).alias("w"), at(3).alias("h"), first.alias("first_pixel"), last.alias("last_pixel"))


@query(
    "SELECT 'F' || n_regionkey AS identity, 'raw/' || n_nationkey || '/a.jpg' AS source_path, CASE WHEN n_nationkey % 2 = 0 THEN 'o' || n_nationkey || '.jpg' ELSE 'a.jpg' END AS filename, 's' || n_nationkey AS source_id, 'exp/' || n_nationkey AS relative_path, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey + 0.5::DOUBLE END AS latitude_value, CASE WHEN n_nationkey % 3 > 0 THEN (n_nationkey + 0.5)::VARCHAR ELSE 'north' END AS latitude, 'csv' AS source_type, CASE WHEN n_nationkey % 2 = 0 THEN 'o' || n_nationkey || '.jpg,a.jpg' ELSE 'a.jpg' END AS filenames FROM nation"
)
def manifest_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """A split manifest with headers of other spellings, as lineage candidates."""
    k = F.col("n_nationkey")
    rows = table(spark, sf, "nation").select(
        said("s", k).alias("Sample-ID"), F.lit(None).cast("string").alias("SOURCE_ID"), said("F", F.col("n_regionkey")).alias("Jaguar ID"), said("./", k, "//a.jpg").alias("Source Filepath"), F.lit("raw").alias("Raw Data Path"), F.when(k % 3 > 0, (k + 0.5).cast("string")).otherwise("north").alias("Lat"), F.when(k % 2 == 0, said("o", k, ".jpg")).alias("File Name"), said("exp/", k).alias("Export Relative Filepath")
    )
    path = scratch_path(spark, "manifest")
    rows.write.csv(path, header=True)
    made = exports.union_sources([sheets.read_manifest(spark, path)])
    return made.select("identity", "source_path", "filename", F.get("source_ids", F.lit(0)).alias("source_id"), "relative_path", "latitude_value", "latitude", "source_type", F.array_join("filenames", ",").alias("filenames"))


def _export(spark: SparkSession, sf: str) -> str:
    """An export folder made of the nations, a table of fixed size."""
    k = F.col("n_nationkey")
    box = F.struct(F.struct(F.lit("d").alias("id"), F.lit("x").alias("label"), F.lit(0.5).alias("confidence"), F.array(*map(F.lit, (0.0, 0.0, 0.5, 0.5))).alias("bounding_box")).alias("d"))
    sample = F.struct(
        F.struct(said("o", k).alias("$oid")).alias("_id"),
        F.when(k % 3 == 0, said("/root/exp/data/", k, ".png")).when(k % 3 == 1, said("/else/", k, ".png")).otherwise(said("data/./", k, ".png")).alias("filepath"),
        F.when(k % 4 > 0, said(" F", k, " ")).alias("jaguar_id"),
        F.struct(said("G", k).alias("label")).alias("ground_truth"),
        F.struct(F.array(box["d"]).alias("detections")).alias("bboxes_body"),
        F.array(F.lit("t")).alias("tags"),
        said("SITE ", F.col("n_regionkey")).alias("Camera-Trap Site"),
        (k + 0.25).alias("lat"),
        F.when(k % 5 == 0, said("s", k)).alias("source_id"),
        F.when(k % 2 == 0, "val").alias("closed_set_split"),
        F.when(k % 7 == 0, said("orig", k, ".png")).alias("original_filename"),
    )
    path = scratch_path(spark, "export")
    one = table(spark, sf, "nation").agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), sample.alias("s")))).alias("all")).select(F.to_json(F.struct(F.col("all.s").alias("samples"))).alias("value"))
    one.coalesce(1).write.text(f"{path}/samples.json")
    return path


@query(
    "SELECT 'export0-' || n_nationkey AS candidate_id, CASE WHEN n_nationkey % 4 > 0 THEN 'F' || n_nationkey ELSE 'G' || n_nationkey END AS identity, CASE WHEN n_nationkey % 7 = 0 THEN 'orig' || n_nationkey || '.png' ELSE n_nationkey || '.png' END AS filename, CASE WHEN n_nationkey % 5 = 0 THEN 'o' || n_nationkey || ',s' || n_nationkey ELSE 'o' || n_nationkey END AS source_ids, CASE n_nationkey % 3 WHEN 0 THEN '/root/exp/data/' || n_nationkey || '.png' WHEN 1 THEN '/else/' || n_nationkey || '.png' END AS source_path, CASE n_nationkey % 3 WHEN 1 THEN NULL ELSE 'data/' || n_nationkey || '.png' END AS relative_path, 'SITE ' || n_regionkey AS site, (n_nationkey + 0.25)::VARCHAR AS latitude, CASE WHEN n_nationkey % 2 = 0 THEN 'val' END AS closed_set_split FROM nation"
)
def export_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """An export's samples as lineage candidates, with their enrichment."""
    made = exports.export_candidates(exports.read_loose(spark, _export(spark, sf)), "/root/exp")
    return made.select("candidate_id", "identity", "filename", F.array_join("source_ids", ",").alias("source_ids"), "source_path", "relative_path", "site", "latitude", "closed_set_split")


@query(
    "SELECT 'o' || n_nationkey AS source_id, CASE WHEN n_nationkey % 4 > 0 THEN 'F' || n_nationkey ELSE 'G' || n_nationkey END AS identity, CASE n_nationkey % 3 WHEN 0 THEN '/root/exp/data/' || n_nationkey || '.png' WHEN 1 THEN '/else/' || n_nationkey || '.png' ELSE 'data/' || n_nationkey || '.png' END AS filepath, n_nationkey || '.png' AS filename, 1 AS n_boxes, false AS review_required FROM nation"
)
def terminal_samples(spark: SparkSession, sf: str) -> DataFrame:
    """An export's samples as strict records."""
    made = exports.terminal_records(exports.read_export(spark, _export(spark, sf)))
    return made.select("source_id", "identity", "filepath", "filename", F.size("bboxes_body").alias("n_boxes"), "review_required")


@query(
    "SELECT CASE n_nationkey % 3 WHEN 0 THEN '/root/exp/data/' || n_nationkey || '.png' WHEN 1 THEN '/else/' || n_nationkey || '.png' ELSE 'data/./' || n_nationkey || '.png' END AS path, CASE WHEN n_nationkey % 4 > 0 THEN 'F' || n_nationkey ELSE 'G' || n_nationkey END AS label, CASE WHEN n_nationkey % 2 = 0 THEN 'val' ELSE 'train' END AS split FROM nation"
)
def exported_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """A labelled dataset loaded from an export."""
    return exports.load_dataset(spark, "export", _export(spark, sf))


_LISTING = "l AS (SELECT p_partkey AS k, p_size, 'SITE ' || (p_size % 9) AS site, 'CAM ' || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS cam, replace(p_name, ' ', '_') || '_' || p_partkey AS stem, CASE WHEN p_partkey % 3 = 0 THEN '.mp4' ELSE '.jpg' END AS ext FROM part)"


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), said("_", p), F.when(p % 3 == 0, ".mp4").otherwise(".jpg"))
    return table(spark, sf, "part").select(F.concat(said("SITE ", F.col("p_size") % 9, "/CAM "), F.when(p % 2 == 0, "A").otherwise("B"), F.lit("/"), name).alias("path"))


@query(f"WITH {_LISTING} SELECT site || '/' || cam || '/' || stem || ext AS path, site, cam, lower(stem || ext) AS name, lower(stem) AS stem, 3 AS depth FROM l")
def media_listing(spark: SparkSession, sf: str) -> DataFrame:
    """A listing with the keys by which its files are found."""
    return match.index(_listing(spark, sf)).select("path", "site", "cam", "name", "stem", "depth")


@query(f"WITH {_LISTING} SELECT k, CASE k % 4 WHEN 0 THEN site || '/' || cam || '/' || stem || ext WHEN 1 THEN site || '/' || cam || '/' || stem || ext WHEN 2 THEN 'sites/SITE 1/' || CASE WHEN k % 3 = 0 THEN cam ELSE 'ID PHOTOS' END || '/new' || k || ext END AS expected FROM l")
def expected_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Where each file should be: as listed by name, by stem, or by its site."""
    p = F.col("p_partkey")
    ext = F.when(p % 3 == 0, ".mp4").otherwise(".jpg")
    stem = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), said("_", p))
    name = F.when(p % 4 == 0, F.upper(F.concat(stem, ext))).when(p % 4 == 1, F.concat(stem, F.lit(".avi"))).otherwise(F.concat(said("new", p), ext))
    rows = table(spark, sf, "part").select(p.alias("k"), name.alias("file"), F.when(p % 4 < 3, "SITE 1").alias("site"), F.when(p % 2 == 0, "CAM A").otherwise("CAM B").alias("cam"))
    return records.expected_path(rows, _listing(spark, sf), "file", "site", "cam").select("k", F.col("expected_path").alias("expected"))


_TREES = ("SITE 1/x.jpg", "Jaguars Filtered/100MEDIA/1.jpg", "Jaguars Filtered/F1 jaguar/1.jpg", "old/jaguars filtered/ID PHOTOS/2.jpg", "jaguars filtered/conf_0.9/jaguar.jpg", "Jaguars filtered/123/4.jpg")


@query("SELECT p_partkey, p_partkey % 6 > 0 AS filtered_tree, p_partkey % 6 IN (0, 2, 3) AS candidate FROM part")
def candidate_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Which files may be matched: those of a filtered tree only in folders that name the subject."""
    path = F.element_at(F.array(*map(F.lit, _TREES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", match.is_filtered_tree(path, "jaguars filtered").alias("filtered_tree"), match.is_candidate(path, "jaguars filtered", "jaguar", PHOTO_DIRS).alias("candidate"))


@query(f"WITH {_LISTING} SELECT k, k % 5 > 0 AS listed FROM l WHERE k % 7 > 0")
def listed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose file is listed, and rows whose file is not; blank paths are in neither."""
    p = F.col("p_partkey")
    rows = _listing(spark, sf).withColumn("k", F.regexp_extract("path", r"_(\d+)\.[a-z0-9]+$", 1).cast("bigint"))
    wanted = rows.select("k", F.when(F.col("k") % 7 == 0, " ").when(F.col("k") % 5 == 0, F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("file"))
    there, missing = match.missing_files(wanted, rows.select("path"), "file")
    return there.select("k", F.lit(True).alias("listed")).unionByName(missing.select("k", F.lit(False).alias("listed")))


@query(
    "WITH x AS (SELECT p_partkey % 100 AS key, p_partkey AS o, 'SITE ' || (p_size % 9) || '/CAM ' || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END || '/' || CASE WHEN p_partkey % 7 = 0 THEN 'ID PHOTOS/' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN 'jaguar' ELSE 'x' END || p_partkey || '.jpg' AS path, 4 * (p_size % 9 = p_partkey % 100 % 9)::INT + 3 * (p_partkey % 2 = 0)::INT + (p_partkey % 5 = 0)::INT + (p_partkey % 7 = 0)::INT AS score, 3 + (p_partkey % 7 = 0)::INT AS depth FROM part) SELECT key, arg_min(path, (-score, depth, o)) AS path, max(score) AS score FROM x GROUP BY key"
)
def candidate_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The best of several candidate paths by site, camera, subject and photo folder."""
    p = F.col("p_partkey")
    path = F.concat(said("SITE ", F.col("p_size") % 9, "/CAM "), F.when(p % 2 == 0, "A").otherwise("B"), F.lit("/"), F.when(p % 7 == 0, "ID PHOTOS/").otherwise(""), F.when(p % 5 == 0, "jaguar").otherwise("x"), p.cast("string"), F.lit(".jpg"))
    rows = table(spark, sf, "part").select((p % 100).alias("key"), p.alias("o"), path.alias("path"), said("SITE ", p % 100 % 9).alias("site"), F.lit("CAM A").alias("cam"))
    return match.best_candidate(rows, "key", "path", "site", "cam", "jaguar", PHOTO_DIRS, "o")


@query(
    r"SELECT p_partkey, trim(regexp_replace(lower(regexp_replace('SubCenter ' || p_brand || '_v2', '([a-z0-9])([A-Z])', '\1-\2', 'g')), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(lower(p_brand || ' x'), '[^a-z0-9]', '', 'g') AS plain, 'embeddings_a_' || p_brand || '_b' AS field, 'Ab_' || p_partkey AS drive, lower(p_name || '.mp4') AS key, CASE p_partkey % 3 WHEN 0 THEN 'VIDEO' WHEN 1 THEN 'IMAGE' ELSE 'UNKNOWN' END AS kind, substr(sha256('v1' || chr(0) || p_name), 1, 24) AS stable FROM part"
)
def name_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Slugs, plain names, embedding fields, ids in links, file keys and kinds, stable ids."""
    p, brand = F.col("p_partkey"), F.col("p_brand")
    name = F.concat(F.lit("x."), F.when(p % 3 == 0, "MOV").when(p % 3 == 1, "png").otherwise("txt"))
    return table(spark, sf, "part").select(
        "p_partkey", text.slug(F.concat(F.lit("SubCenter "), brand, F.lit("_v2"))).alias("slug"), text.plain_name(F.concat(brand, F.lit(" x"))).alias("plain"), text.embedding_field(F.concat(F.lit("hf-hub:a/"), brand, F.lit("-b"))).alias("field"), text.drive_id(said("https://x/folders/Ab_", p, "?q")).alias("drive"), text.file_key(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(".MP4 "))).alias("key"), text.file_type(name).alias("kind"), text.stable_id(F.lit("v1"), F.col("p_name")).alias("stable")
    )


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS utc, CASE WHEN o_orderkey % 2 = 0 THEN epoch_us(o_orderdate) ELSE -62135596800000000 END AS micros, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN NULL ELSE 1.5 END::DOUBLE AS number, CASE o_orderkey % 3 WHEN 1 THEN 'true' END AS words, CASE WHEN o_orderkey % 4 = 0 THEN 'b' || o_orderkey ELSE 'a' END AS filled FROM orders"
)
def cell_functions(spark: SparkSession, sf: str) -> DataFrame:
    """UTC texts, lenient timestamps, numbers among texts, the first filled cell."""
    o = F.col("o_orderkey")
    raw = F.when(o % 3 == 0, F.col("o_totalprice").cast("string")).when(o % 3 == 1, "true").otherwise("1.5")
    number, words = text.number_or_text(raw, F.when(o % 3 == 1, "boolean").otherwise("double"))
    moment = F.when(o % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    return table(spark, sf, "orders").select("o_orderkey", text.utc_text(F.col("o_orderdate")).alias("utc"), F.unix_micros(text.timestamp_or_least(moment)).alias("micros"), number.alias("number"), words.alias("words"), text.first_filled(F.when(o % 4 > 0, " a ").otherwise(" "), said("b", o)).alias("filled"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '/root/x/a/' || c_custkey WHEN 1 THEN '/root/x/b' END AS path, c_custkey % 4 IN (1, 3) AS absolute FROM customer")
def media_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Media paths below a root; what leaves it is null."""
    c = F.col("c_custkey")
    path = F.when(c % 4 == 0, said("a/./", c)).when(c % 4 == 1, "/root/x/y/../b").when(c % 4 == 2, "../etc").otherwise("/root/other")
    return table(spark, sf, "customer").select("c_custkey", records.media_path(path, "/root/x").alias("path"), text.is_absolute(path).alias("absolute"))


@query("SELECT 'train/c' || (p_size % 9) || '/' || p_partkey || '.png' AS path, 'train' AS split, 'c' || (p_size % 9) AS label FROM part WHERE p_partkey % 3 = 0")
def image_tree(spark: SparkSession, sf: str) -> DataFrame:
    """A listing of an image folder as split, class and file."""
    p = F.col("p_partkey")
    path = F.concat(F.when(p % 3 < 2, said("train/c", F.col("p_size") % 9, "/")).otherwise(""), p.cast("string"), F.when(p % 3 == 1, ".txt").otherwise(".png"))
    return files.image_rows(table(spark, sf, "part").select(path.alias("path")))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'd/' || p_partkey || '.mp4' WHEN 1 THEN 'd/' || p_partkey || '.avi' ELSE 'd/' || p_partkey || '.jpg' END AS file FROM part")
def converted_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose file has a converted twin name the twin."""
    p = F.col("p_partkey")
    part = table(spark, sf, "part")
    rows = part.select("p_partkey", F.concat(said("d/", p), F.when(p % 3 < 2, ".avi").otherwise(".jpg")).alias("file"))
    listing = part.where(p % 3 != 1).select(said("d/", p, ".mp4").alias("path"))
    return files.rewrite_converted(rows, listing, "file").select("p_partkey", "file")


@query(
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 45 WHEN 1 THEN 33 WHEN 2 THEN 23 ELSE 0 END AS size_bytes, CASE WHEN c_custkey % 4 < 3 THEN c_nationkey + 1 END AS width, CASE WHEN c_custkey % 4 < 3 THEN c_nationkey + 2 END AS height, c_custkey % 4 IN (0, 2) AS readable FROM customer"
)
def media_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Whole and broken image files: size, width and height from their headers."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    hexed = lambda x, digits: F.lpad(F.hex(x), digits, "0")
    chunk = lambda kind, body: F.concat(hexed(F.length(body) / 2, 8), F.hex(F.lit(kind)), body, hexed(F.crc32(F.unhex(F.concat(F.hex(F.lit(kind)), body))), 8))
    head = F.concat(F.lit("89504E470D0A1A0A"), chunk("IHDR", F.concat(hexed(n + 1, 8), hexed(n + 2, 8), F.lit("0800000000"))))
    jpeg = F.concat(F.lit("FFD8FFC0000B08"), hexed(n + 2, 4), hexed(n + 1, 4), F.lit("01011100FFDA0004003FFFD9"))
    content = F.when(c % 4 == 0, F.unhex(F.concat(head, chunk("IEND", F.lit(""))))).when(c % 4 == 1, F.unhex(head)).when(c % 4 == 2, F.unhex(jpeg)).otherwise(F.lit(b""))
    rows = table(spark, sf, "customer").select(F.concat(c.cast("string"), F.when(c % 4 == 2, ".jpg").otherwise(".png")).alias("path"), content.alias("content"))
    return files.integrity_of(rows).select(F.regexp_extract("path", r"^\d+", 0).cast("bigint").alias("c_custkey"), "size_bytes", "width", "height", "readable")
