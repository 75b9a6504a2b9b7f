"""Queries over samples, records, validation, splits, vectors and experiment tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions import boxes, masks, text
from fieldbook.operators import clean, curate, dedup, experiments, frames, inference, lineage, metrics, records, split, stats, validate, vectors, views
from fieldbook.plans import catalogue, snapshot
from fieldbook.plans.registry import embedded, query, rounded
from fieldbook.session import table
from fieldbook.sources import video
from fieldbook.sources.fixed import BACKBONE_FIELDS


def said(prefix: str, c: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), c.cast("string"), F.lit(suffix))


_LINKS = "k AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN 'F' || (c_custkey % 50) END AS own, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'F' || (c_custkey % 70) END AS other, ['matched', 'ambiguous', 'missing'][c_custkey % 3 + 1] AS status FROM customer)"


def _links(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    status = F.element_at(F.array(*map(F.lit, ("matched", "ambiguous", "missing"))), (c % 3 + 1).cast("int"))
    other = F.when(c % 5 == 1, " ").when(c % 5 > 1, said(" F", c % 70, " "))
    return table(spark, sf, "customer").select(c.alias("k"), F.when(c % 3 > 0, said("F", c % 50)).alias("own"), other.alias("other"), status.alias("status"))


@query(f"WITH {_LINKS} SELECT k, coalesce(status = 'matched' AND (own IS NULL OR other IS NULL OR own = trim(other)), false) AS usable, coalesce(own, CASE WHEN status = 'matched' THEN nullif(trim(other), '') END) AS resolved FROM k")
def resolved_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Lineage matches that may count in ranking, and the identity that a record resolves to."""
    own, other, status = F.col("own"), F.col("other"), F.col("status")
    return _links(spark, sf).select("k", dedup.usable_match(status, own, other).alias("usable"), lineage.resolved_identity(own, status, other).alias("resolved"))


@query(f"WITH {_LINKS} SELECT 'status:' || s AS measure, count(k) AS value FROM (SELECT unnest(['matched', 'ambiguous', 'missing', 'conflict']) AS s) LEFT JOIN k ON status = s GROUP BY s UNION ALL SELECT 'terminal', count(own) FROM k UNION ALL SELECT 'resolved', count(coalesce(own, other)) FROM k UNION ALL SELECT 'unresolved', count_if(own IS NULL AND other IS NULL) FROM k")
def lineage_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Records by lineage status, zero where there are none, and how many have an identity."""
    rows = _links(spark, sf)
    by_status = stats.status_counts(rows, "status", ["matched", "ambiguous", "missing", "conflict"]).select(F.concat(F.lit("status:"), "value").alias("measure"), F.col("n").alias("value"))
    one = stats.resolved_counts(rows, "own", "other")
    return by_status.unionByName(one.unpivot([], one.columns, "measure", "value"))


@query(
    "WITH raw AS (SELECT 'p' || (c_custkey % 1000) AS path FROM customer), rec AS (SELECT 'p' || c_custkey AS path FROM customer WHERE c_custkey % 7 > 0), a AS (SELECT path, count(*) AS n FROM raw GROUP BY 1), b AS (SELECT path, count(*) AS m FROM rec GROUP BY 1) "
    "SELECT path, CASE WHEN n IS NULL THEN 'not in the source' WHEN m IS NULL THEN 'no record' ELSE 'not unique' END AS error FROM a FULL JOIN b USING (path) WHERE n IS NULL OR m IS NULL OR n > 1 OR m > 1"
)
def one_to_one(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that only the source or only the records have, or that either has twice."""
    c = F.col("c_custkey")
    rows = table(spark, sf, "customer")
    return records.one_to_one_errors(rows.select(said("p", c % 1000).alias("path")), rows.where(c % 7 > 0).select(said("p", c).alias("path")))


@query("WITH p AS (SELECT 'p' || (c_custkey % 200) AS path FROM customer WHERE c_custkey % 9 = 0) SELECT path, 'has several actions' AS error FROM p GROUP BY path HAVING count(*) > 1 UNION ALL SELECT path, 'not in the source' FROM p WHERE substr(path, 2)::INT % 2 = 1")
def policy_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Policy actions on paths that the source lacks, and paths with several actions."""
    c = F.col("c_custkey")
    rows = table(spark, sf, "customer")
    source = rows.where(c % 2 == 0).select(said("p", c).alias("path")).unionByName(rows.limit(0).select(F.lit("p0").alias("path"))).unionByName(spark.range(1).select(F.lit("p0").alias("path")))
    return curate.check_policy(source.distinct(), rows.where(c % 9 == 0).select(said("p", c % 200).alias("path"), F.lit("review").alias("action")))


@query("SELECT 'p' || c_custkey AS filepath, CASE WHEN c_custkey % 2 = 0 THEN 'matched' END AS lineage_status, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS size_bytes, CASE WHEN c_custkey % 4 = 0 THEN 'F' || c_custkey WHEN c_custkey % 2 = 0 THEN 'G' || c_custkey END AS resolved_identity FROM customer")
def validated_records(spark: SparkSession, sf: str) -> DataFrame:
    """Terminal records with enrichment and integrity by path."""
    c = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", said("p", c).alias("filepath"))
    terminals = rows.select("filepath", F.when(c % 4 == 0, said("F", c)).alias("identity"))
    enrichment = rows.where(c % 2 == 0).select("filepath", F.lit("matched").alias("lineage_status"), said("G", c).alias("lineage_identity"))
    integrity = rows.where(c % 3 > 0).select("filepath", F.col("c_nationkey").alias("size_bytes"))
    return records.validated(terminals, enrichment, integrity).select("filepath", "lineage_status", "size_bytes", "resolved_identity")


@query(f"WITH {catalogue._SAMPLES} SELECT sample_id, array_to_string(list_transform(detections, lambda d: CASE WHEN d.id = 'd0' THEN '-' ELSE sample_id || d.id END), ',') AS made FROM smp")
def detection_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values written back to detections by sample and detection; one without a value has null."""
    rows = catalogue.samples(spark, sf)
    made = rows.select("sample_id", F.explode("detections").alias("d")).where("d.id <> 'd0'").select("sample_id", F.col("d.id").alias("det_id"), F.concat(F.col("sample_id").cast("string"), "d.id").alias("value"))
    back = views.write_back(rows, made, "detections", "made")
    return back.select("sample_id", F.when(F.col("detections").isNotNull(), F.array_join(F.transform("detections", lambda d: F.coalesce(d["made"], F.lit("-"))), ",")).alias("made"))


@query("SELECT c_custkey AS sample_id, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS score FROM customer")
def sample_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values written back to samples by key; those without one lose what they had."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.lit(1.0).alias("score"), "c_acctbal")
    return records.with_values(rows, rows.where("sample_id % 3 > 0").select("sample_id", F.col("c_acctbal").alias("value")), "sample_id", "score").select("sample_id", "score")


@query("WITH a AS (SELECT c_nationkey AS n FROM customer), b AS (SELECT c_nationkey AS n FROM customer WHERE c_custkey % 5 > 0), x AS (SELECT n, count(*) AS k FROM a GROUP BY 1), y AS (SELECT n, count(*) AS k FROM b GROUP BY 1) SELECT n, 'left' AS side, x.k - coalesce(y.k, 0) AS times FROM x LEFT JOIN y USING (n) WHERE x.k > coalesce(y.k, 0)")
def multiset_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that one of two tables has more often."""
    a = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n"))
    found = validate.same_multiset(a.select("n"), a.where("c_custkey % 5 > 0").select("n"))
    return found.groupBy("n", "side").agg(F.count(F.lit(1)).alias("times"))


@query("SELECT md5('h' || c_custkey) AS sha256, CASE WHEN c_custkey % 11 <> 1 THEN 'a' || c_nationkey END AS left, CASE WHEN c_custkey % 11 <> 2 THEN CASE WHEN c_custkey % 11 = 3 THEN 'b' ELSE 'a' END || c_nationkey END AS right FROM customer WHERE c_custkey % 11 IN (1, 2, 3)")
def checksum_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Where two maps of checksums differ."""
    c = F.col("c_custkey")
    rows = table(spark, sf, "customer").withColumn("h", F.md5(said("h", c)))
    left = rows.where(c % 11 != 1).select("h", said("a", F.col("c_nationkey")))
    right = rows.where(c % 11 != 2).select("h", F.concat(F.when(c % 11 == 3, "b").otherwise("a"), F.col("c_nationkey").cast("string")))
    return validate.checksum_differences(left, right)


@query("SELECT count(*) AS n, count_if(p_partkey % 4 = 1) AS n_duplicates, round(count_if(p_partkey % 4 = 1) / count(*), 6) AS rate, round(avg(p_size / 50) FILTER (p_partkey % 4 = 1), 6) AS mean_similarity, round(min(p_size / 50) FILTER (p_partkey % 4 = 1), 6) AS least_similarity, round(max(p_size / 50) FILTER (p_partkey % 4 = 1), 6) AS most_similarity FROM part")
def duplicate_rates(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    rows = table(spark, sf, "part").select((p % 4 == 1).alias("is_duplicate"), (F.col("p_size") / 50).alias("duplicate_similarity"))
    return rounded(stats.duplicate_rates(rows), "rate", "mean_similarity", "least_similarity", "most_similarity")


@query("SELECT p_partkey AS id, false AS is_duplicate, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'a,b' END AS tags FROM part")
def reset_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Marks of an earlier run removed, also where there were none."""
    p = F.col("p_partkey")
    rows = table(spark, sf, "part").select(p.alias("id"), (p % 2 == 0).alias("is_duplicate"), F.when(p % 2 == 0, F.array(F.lit("a"), F.lit("duplicate"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("tags"))
    made = dedup.unmark(rows)
    return made.where("duplicate_of IS NULL AND duplicate_similarity IS NULL").select("id", "is_duplicate", F.array_join("tags", ",").alias("tags"))


@query("SELECT count(*) AS pictures, count(DISTINCT p_brand) AS identities, count(DISTINCT p_size) AS sites FROM part")
def slide_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.slide_report(table(spark, sf, "part"), "p_brand", "p_size")


@query("SELECT 'missing' AS what, vec_id::VARCHAR AS id FROM embeddings WHERE vec_id % 10 = 3 AND vec_id % 20 <> 3 UNION ALL SELECT 'not missing', vec_id::VARCHAR FROM embeddings WHERE vec_id % 20 = 4 UNION ALL SELECT 'total', (count(*) FILTER (vec_id % 10 <> 3))::VARCHAR FROM embeddings UNION ALL SELECT 'revision', vec_id::VARCHAR FROM embeddings WHERE vec_id % 10 <> 3 AND vec_id % 7 = 0")
def embedding_population(spark: SparkSession, sf: str) -> DataFrame:
    """Totals, missing rows and revisions that differ from what is recorded."""
    i = F.col("id")
    rows = embedded(spark, sf).select("id", F.when(i % 10 != 3, F.col("vector")).alias("embedding"), F.when(i % 7 > 0, "r1").when(i % 2 == 0, "r0").alias("revision"))
    wanted = rows.where((i % 20 == 3) | (i % 20 == 4)).select("id")
    wrong = vectors.revision_errors(rows, "r1").select(F.lit("revision").alias("what"), i.cast("string").alias("id"))
    return vectors.population_errors(rows, -1, wanted).unionByName(wrong)


@query(
    "WITH u AS (SELECT c_custkey AS id, i, (('0x' || substr(md5('42:' || c_custkey || ':' || i || ':0'), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657.0 AS a, (('0x' || substr(md5('42:' || c_custkey || ':' || i || ':1'), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657.0 AS b FROM customer, (SELECT unnest([1, 2, 3]) AS i)), g AS (SELECT id, i, sqrt(-2 * ln(a)) * cos(2 * pi() * b) AS x FROM u) "
    "SELECT id, round(max(x) FILTER (i = 1) / (sqrt(sum(x * x)) + 1e-12), 4) AS x, round(max(x) FILTER (i = 3) / (sqrt(sum(x * x)) + 1e-12), 4) AS z FROM g GROUP BY id"
)
def random_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded random unit vectors."""
    made = vectors.random_units(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), 3)
    at = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 4)
    return made.select("id", at(0).alias("x"), at(2).alias("z"))


@query(
    "WITH x AS (SELECT vec_id AS id, label, ['train', 'val', 'test'][vec_id % 3 + 1] AS c, CASE WHEN vec_id % 5 > 0 THEN ['test', 'train'][vec_id % 2 + 1] END AS o FROM embeddings), l AS (SELECT label, dense_rank() OVER (ORDER BY 'L' || label) - 1 AS n FROM (SELECT DISTINCT label FROM embeddings)) SELECT 'open' AS kind, id, o AS split, CASE WHEN o IS NULL THEN 'a' WHEN o = 'a' THEN 'a' ELSE 'a,' || o END AS tags, n AS label_id FROM x JOIN l USING (label) UNION ALL SELECT 'closed', id, c, 'a,' || c, n FROM x JOIN l USING (label) WHERE c = 'val'"
)
def main_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The main split and its tags, and one part of it with the labels of the whole."""
    i = F.col("id")
    closed = F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (i % 3 + 1).cast("int"))
    opened = F.when(i % 5 > 0, F.when(i % 2 == 0, "test").otherwise("train"))
    rows = embedded(spark, sf).select("id", F.concat(F.lit("L"), "label").alias("label"), closed.alias("closed_set_split"), opened.alias("open_set_split"), F.array(F.lit("a")).alias("tags"))
    rows = metrics.label_ids(rows, "label")
    told = lambda some, kind: some.select(F.lit(kind).alias("kind"), "id", "split", F.array_join("tags", ",").alias("tags"), F.col("label_id").cast("long"))
    return told(split.main_split(rows), "open").unionByName(told(split.main_split(rows, "closed").where("split = 'val'"), "closed"))


@query(
    "WITH s AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings), c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT label FROM embeddings)), "
    "d AS (SELECT d AS draw, ('0x' || substr(md5('42d:' || d), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u, ('0x' || substr(md5('42r:' || d), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS v FROM (SELECT unnest(range(200)) AS d)) SELECT draw, c.label, id FROM d JOIN c ON c.k = floor(u * m) JOIN s ON s.label = c.label AND s.r = floor(v * n)"
)
def class_balanced_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Draws with replacement, chance by class weight."""
    return split.class_balanced_draws(embedded(spark, sf), "label", 200)


@query("WITH x AS (SELECT p_partkey % 13 > 0 AS h, p_partkey % 17 > 0 AS w, p_partkey, CASE WHEN p_partkey % 10 = 3 THEN 'all' ELSE 'val' END AS sp FROM part), e AS (SELECT p_partkey, unnest([CASE WHEN NOT h THEN 'sha256 is missing' END, CASE WHEN NOT w THEN 'width is missing' END, CASE WHEN p_partkey % 5 = 0 THEN 'annotations are missing' END, CASE WHEN sp = 'all' THEN 'closed_set_split is unknown' END, CASE WHEN p_partkey % 19 = 0 THEN 'latitude is not finite' END]) AS error FROM x) SELECT 'f' || p_partkey AS filepath, error FROM e WHERE error IS NOT NULL")
def snapshot_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that break the snapshot's contract."""
    p = F.col("p_partkey")
    box = F.array(F.struct(F.lit("d").alias("id"), F.lit("x").alias("label"), F.lit(0.9).alias("confidence"), F.array(*map(F.lit, (0.0, 0.0, 0.5, 0.5))).alias("bounding_box")))
    rows = table(spark, sf, "part").select(
        said("f", p).alias("filepath"), F.when(p % 13 > 0, F.sha2(p.cast("string"), 256)).alias("sha256"), F.lit(9).alias("size_bytes"), F.when(p % 17 > 0, 5).alias("width"), F.lit(5).alias("height"), F.lit(False).alias("review_required"), F.lit("matched").alias("lineage_status"), F.when(p % 10 == 3, "all").otherwise("val").alias("closed_set_split"), F.when(p % 5 > 0, box).alias("bboxes_body"), F.when(p % 5 > 0, box).alias("segmentations_body"), F.when(p % 19 == 0, float("nan")).otherwise(1.0).alias("latitude")
    )
    return snapshot.snapshot_errors(snapshot.snapshot_rows(rows.withColumn("who", F.lit("F1")), "who"))


@query(
    "WITH x AS (SELECT p_partkey, p_partkey % 4 > 0 AS readable, 'h' || (p_partkey % 1500) AS h, CASE WHEN p_partkey % 6 = 0 THEN ' ' WHEN p_partkey % 6 = 1 THEN NULL ELSE 'F' END AS who FROM part), g AS (SELECT h, count(*) AS n FROM x GROUP BY 1 HAVING count(*) > 1), e AS (SELECT p_partkey FROM x WHERE trim(who) = '' UNION ALL SELECT p_partkey FROM x JOIN g USING (h) UNION ALL SELECT p_partkey FROM x WHERE NOT readable) "
    "SELECT 'errors' AS measure, count(*) AS value FROM e UNION ALL SELECT 'rows with errors', count(DISTINCT p_partkey) FROM e UNION ALL SELECT 'kept', count_if(readable) FROM x UNION ALL SELECT 'count errors', 1"
)
def batch_validation(spark: SparkSession, sf: str) -> DataFrame:
    """All errors of a batch, its rows that can be read, and its count."""
    p = F.col("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", (p % 4 > 0).alias("readable"), said("h", p % 1500).alias("sha256"), F.when(p % 6 == 0, " ").when(p % 6 > 1, "F").alias("who"))
    kept, _, told = validate.validate(rows, "p_partkey", validate.identity_rules("who"), {"sha256": "content"}, "readable")
    one = lambda frame, name, value: frame.select(F.lit(name).alias("measure"), value.alias("value"))
    return one(told, "errors", F.col("n_errors")).unionByName(one(told, "rows with errors", F.col("n_rows_with_errors"))).unionByName(one(kept.agg(F.count(F.lit(1)).alias("n")), "kept", F.col("n"))).unionByName(one(validate.count_error(rows, 0).agg(F.count(F.lit(1)).alias("n")), "count errors", F.col("n")))


_RECTANGLES = "r AS (SELECT p_partkey, p_size % 8 AS a, p_partkey % 7 AS b, p_partkey % 5 = 0 AS broken FROM part)"


def _masked(spark: SparkSession, sf: str) -> DataFrame:
    """Two full masks as rectangles of a 16 x 16 image; some are broken."""
    p, size = F.col("p_partkey"), F.col("p_size")
    full = lambda x, y: F.struct(F.when(p % 5 == 0, "[[2]]").otherwise("[[1, 1], [1, 1]]").alias("mask"), F.array(x / 16, y / 16, F.lit(0.5), F.lit(0.25)).alias("box"))
    return table(spark, sf, "part").select("p_partkey", F.array(full((size % 8).cast("double"), F.lit(0.0)), full(F.lit(0.0), (p % 7).cast("double"))).alias("masks"))


@query(f"WITH {_RECTANGLES} SELECT p_partkey, CASE WHEN NOT broken THEN 64 - (8 - a) * greatest(0, 4 - b) END AS pixels, CASE WHEN NOT broken THEN (8 + a) / 16.0::DOUBLE END AS width, CASE WHEN NOT broken THEN (b + 4) / 16.0::DOUBLE END AS height FROM r")
def mask_unions(spark: SparkSession, sf: str) -> DataFrame:
    """The pixels and the box of all masks of an image laid over each other; broken masks are left out."""
    shape = masks.union_shape(F.col("masks"), F.lit(16), F.lit(16))
    return _masked(spark, sf).withColumn("s", shape).select("p_partkey", F.col("s.pixels").cast("long").alias("pixels"), F.get("s.box", F.lit(2)).alias("width"), F.get("s.box", F.lit(3)).alias("height"))


@query(f"WITH {_RECTANGLES} SELECT p_partkey, CASE WHEN NOT broken THEN 64 - (8 - a) * greatest(0, 4 - b) END AS kept, CASE WHEN NOT broken THEN 192 + (8 - a) * greatest(0, 4 - b) END AS background, 8 AS crop_height, (16 - a)::BIGINT AS crop_width FROM r")
def mask_renderings(spark: SparkSession, sf: str) -> DataFrame:
    """An image inside and outside of its masks, and cropped to a box: pixels that are left."""
    image = F.unhex(F.repeat(F.lit("01"), 256))
    ones = lambda mode: F.length(F.regexp_replace(F.hex(masks.render(F.col("image"), F.lit(16), F.lit(16), F.col("masks"), mode)), "00", "")) / 2
    part = masks.crop(F.col("image"), F.lit(16), F.lit(16), F.col("box"))
    rows = _masked(spark, sf).withColumns({"image": image, "box": F.array(F.get("masks.box", F.lit(0))[0], F.lit(0.0), 1 - F.get("masks.box", F.lit(0))[0], F.lit(0.5))})
    return rows.withColumn("part", part).select("p_partkey", ones("rgb_masked").cast("long").alias("kept"), ones("background").cast("long").alias("background"), F.col("part.height").cast("long").alias("crop_height"), F.col("part.width").cast("long").alias("crop_width"))


@query("SELECT p_partkey, p_partkey % 3 AS n_pixels, p_partkey % 3 > 0 AS there FROM part WHERE p_partkey % 3 < 2 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_partkey % 3 = 2")
def decoded_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Masks decoded from JSON; what is no mask is null."""
    p = F.col("p_partkey")
    coded = F.when(p % 3 == 0, "[[0, 0], [0, 0]]").when(p % 3 == 1, "[[0, 0, 0], [0, 1, 0]]").otherwise("[[3]]")
    return table(spark, sf, "part").select("p_partkey", masks.shape(coded).alias("s")).select("p_partkey", F.col("s.pixels").cast("long").alias("n_pixels"), F.when(F.col("s.pixels").isNotNull(), F.col("s.box").isNotNull()).alias("there"))


@query("SELECT p_partkey % 40 AS k, count(*) AS n, 1 AS meanings FROM part GROUP BY 1")
def semantic_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations that differ in their generated ids alone mean the same."""
    p = F.col("p_partkey")
    box = F.array(F.struct(p.cast("string").alias("id"), said("x", p % 40).alias("label"), F.lit(0.5).alias("confidence"), F.array((p % 40) / 100, F.lit(0.0), F.lit(0.5), F.lit(0.5)).alias("bounding_box")))
    rows = table(spark, sf, "part").select((p % 40).alias("k"), records.canonical(box).alias("meaning"))
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("meaning").cast("int").alias("meanings"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 1 END AS n FROM part")
def rebuilt_detections(spark: SparkSession, sf: str) -> DataFrame:
    """An export's detections that have a label, a box and a mask that can be read."""
    p = F.col("p_partkey")
    one = F.struct(F.lit("d").alias("id"), F.when(p % 4 > 0, "x").alias("label"), F.lit(0.5).alias("confidence"), F.array(*map(F.lit, (0.0, 0.0, 0.5, 0.5))).alias("bounding_box"))
    return table(spark, sf, "part").select("p_partkey", F.size(records.detections_of(F.array(one), F.array(p % 4 != 2))).alias("n"))


@query("SELECT 'only labelled' AS measure, count(*) AS value FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)) UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'no field', 0 UNION ALL SELECT 'all without', (SELECT count(*) FROM customer)")
def path_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Differences and unions of keys, and variants of samples that lack the segmentation field."""
    a, b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    bare = table(spark, sf, "customer").withColumn("tags", F.array().cast("array<string>"))
    counts = {"only labelled": a.distinct().join(b, "k", "left_anti"), "either": a.union(b).distinct(), "no field": views.variant(bare, "segmented"), "all without": views.variant(bare, "not_segmented")}
    made = None
    for name, rows in counts.items():
        one = rows.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("measure"), "value")
        made = one if made is None else made.unionByName(one)
    return made


@query("SELECT p_partkey AS sample_id, k AS frame_index, k * 5 AS source_frame, 'SITE ' || (p_size % 9) AS site, 'v/' || p_partkey || '.mp4' AS source_video, 'image' AS group_slice FROM part, (SELECT unnest([0, 1]) AS k) WHERE p_partkey % 2 = 0")
def frame_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Frames keep their video's fields; videos without frames give none."""
    p = F.col("p_partkey")
    videos = table(spark, sf, "part").select(p.alias("sample_id"), said("v/", p, ".mp4").alias("filepath"), F.lit(10.0).alias("fps"), F.when(p % 2 == 0, 10).otherwise(0).alias("frame_count"), said("SITE ", F.col("p_size") % 9).alias("site"), F.lit("video").alias("group_slice"))
    made = frames.sample_frames(videos, 2.0, 1.0, 0.0)
    return made.select("sample_id", "frame_index", "source_frame", "site", "source_video", "group_slice")


@query(
    "WITH x AS (SELECT vec_id AS id, label % 4 AS y, list_transform(range(4), lambda i: greatest(embedding[2 * i + 1]::DOUBLE, embedding[2 * i + 2]::DOUBLE)) AS c, embedding[9]::DOUBLE AS m FROM embeddings), z AS (SELECT id, y, m, list_transform(range(4), lambda i: 30 * CASE WHEN i = y THEN CASE WHEN greatest(least(c[i + 1], 1 - 1e-7), -1 + 1e-7) > cos(pi() - 0.5) THEN greatest(least(c[i + 1], 1 - 1e-7), -1 + 1e-7) * cos(0.5) - sqrt(1 - greatest(least(c[i + 1], 1 - 1e-7), -1 + 1e-7) * greatest(least(c[i + 1], 1 - 1e-7), -1 + 1e-7)) * sin(0.5) ELSE greatest(least(c[i + 1], 1 - 1e-7), -1 + 1e-7) - sin(pi() - 0.5) * 0.5 END ELSE c[i + 1] END) AS l FROM x) "
    "SELECT id, round(list_max(l) + ln(list_sum(list_transform(l, lambda v: exp(v - list_max(l))))) - l[y + 1], 5) AS subcenter, round(list_max(l) + ln(list_sum(list_transform(l, lambda v: exp(v - list_max(l))))) - l[y + 1] + 0.5 * m, 5) AS total FROM z"
)
def subcenter_losses(spark: SparkSession, sf: str) -> DataFrame:
    """The best of each class's sub-centres with the angular margin, and a combined loss."""
    at = lambda i: F.get("vector", F.lit(i)).cast("double")
    cosines = F.array(*[F.array(at(2 * i), at(2 * i + 1)) for i in range(4)])
    rows = embedded(spark, sf).select("id", (F.col("label") % 4).alias("y"), cosines.alias("c"), at(8).alias("m"))
    loss = metrics.build_loss("subcenter_arcface")(F.col("c"), F.col("y"))
    rows = rows.withColumn("loss", loss)
    return rows.select("id", F.round("loss", 5).alias("subcenter"), F.round(metrics.combined_loss(F.col("loss"), F.col("m"), 0.5)["total"], 5).alias("total"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 9 <> 0 AND embedding[1] >= 0 THEN round(embedding[1]::DOUBLE * 2, 6) END AS made, CASE WHEN vec_id % 9 = 0 THEN 'no payload' WHEN embedding[1] < 0 THEN 'ValueError: negative' END AS error FROM embeddings")
def inferred_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A model over rows in batches: batches that fail are halved, rows that fail keep their error."""

    def load():
        def model(values: list) -> list:
            if any(v < 0 for v in values):
                raise ValueError("negative")
            return [[2 * v] for v in values]

        return model

    rows = embedded(spark, sf).select("id", F.when(F.col("id") % 9 > 0, F.get("vector", F.lit(0)).cast("double")).alias("x"))
    return inference.infer(rows, load, "id", "x", 8).select("id", F.round(F.get("embedding", F.lit(0)), 6).alias("made"), "error")


_RUNS = "r AS (SELECT event_id AS run_id, 'e' || (user_id % 40) AS experiment, event_type AS kind, CASE WHEN event_id % 5 > 0 THEN round(value, 3) END AS map, ts FROM events)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    metric = F.when(e % 5 > 0, F.round("value", 3).cast("string")).otherwise("n/a")
    return table(spark, sf, "events").select(e.alias("run_id"), said("e", F.col("user_id") % 40).alias("experiment"), F.col("event_type").alias("kind"), F.create_map(F.when(e % 2 == 0, "val/mAP").otherwise("map"), metric).alias("metrics"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"))


@query(f"WITH {_RUNS}, n AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY ts DESC, run_id) AS age FROM r) SELECT experiment, map, CASE WHEN map IS NULL THEN 'ERROR' ELSE 'ok' END AS status FROM n WHERE age = 1 UNION ALL SELECT 'none', NULL, 'ERROR'")
def run_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Each experiment's newest run by its metric under any of its names; without one it is an error."""
    runs = experiments.with_metrics(_runs(spark, sf), {"map": ["map", "val/mAP"]})
    newest = experiments.newest_first(runs, "experiment").where("age = 1").select("experiment", "map")
    wanted = newest.select("experiment").unionByName(spark.range(1).select(F.lit("none").alias("experiment")))
    return experiments.comparison_table(wanted, newest, "map")


@query(f"WITH {_RUNS} SELECT * FROM (SELECT 'top' AS what, run_id, map FROM r ORDER BY map DESC NULLS LAST, run_id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'best', run_id, map FROM r WHERE map IS NOT NULL ORDER BY map DESC, run_id LIMIT 1)")
def top_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The ten runs with the largest metric, and the best one."""
    runs = experiments.with_metrics(_runs(spark, sf), {"map": ["map", "val/mAP"]}).withColumn("map", F.col("map").try_cast("double"))
    told = lambda rows, what: rows.select(F.lit(what).alias("what"), "run_id", "map")
    return told(experiments.top(runs, "map", 10, "run_id"), "top").unionAll(told(experiments.best_run(runs, "map"), "best"))


@query(f"WITH {_RUNS} SELECT kind, array_to_string(list_sort(list(DISTINCT experiment)), ',') AS experiments, count(DISTINCT experiment) AS n FROM r GROUP BY kind")
def experiment_groups(spark: SparkSession, sf: str) -> DataFrame:
    found = experiments.grouped(_runs(spark, sf).select("kind", "experiment").distinct(), "kind")
    return found.select("kind", F.array_join("experiments", ",").alias("experiments"), "n")


@query(f"WITH {catalogue._SAMPLES} SELECT sample_id, d.confidence > 0.5 AS sure, 'bboxes_body[' || i || ']: box must lie inside the image' AS error FROM (SELECT sample_id, unnest(detections) AS d, unnest(range(len(detections))) AS i FROM smp) WHERE 0.25 + d.w > 1")
def box_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Each detection's box error."""
    rows = catalogue.samples(spark, sf).select("sample_id", F.posexplode("detections").alias("i", "d"))
    moved = F.transform("d.bounding_box", lambda x, at: F.when(at == 0, F.lit(0.25)).otherwise(x))
    told = rows.withColumn("e", boxes.box_error(moved)).where("e IS NOT NULL")
    return told.select("sample_id", (F.col("d.confidence") > 0.5).alias("sure"), F.concat(F.lit("bboxes_body["), F.col("i").cast("string"), F.lit("]: "), "e").alias("error"))


@query("WITH x AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) > 1) SELECT c_custkey FROM x")
def duplicate_label_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that repeat an earlier one's cells, and the same by marks."""
    rows = table(spark, sf, "customer")
    _, others = clean.first_of_duplicates(rows, ["c_nationkey", "c_mktsegment"], "c_custkey")
    marked = dedup.mark_first(rows, ["c_nationkey", "c_mktsegment"], "c_custkey").where("NOT is_first")
    return others.select("c_custkey").intersect(marked.select("c_custkey"))


#: A piece of a file: its bytes as hex, and how many there are.
Piece = tuple[Column, int]


def _be(n: Column | int) -> Piece:
    """Four bytes of a number, the highest first."""
    return F.lpad(F.hex((F.lit(n) if isinstance(n, int) else n).cast("long")), 8, "0"), 4


def _le(n: Column | int) -> Piece:
    digits = _be(n)[0]
    return F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]), 4


def _text(s: str) -> Piece:
    return F.lit(s.encode().hex()), len(s)


def _zeros(n: int) -> Piece:
    return F.lit("00" * n), n


def _joined(*pieces: Piece) -> Piece:
    return F.concat(*[c for c, _ in pieces]), sum(n for _, n in pieces)


def _box(kind: str, *content: Piece) -> Piece:
    return _joined(_be(8 + sum(n for _, n in content)), _text(kind), *content)


def _chunk(kind: str, *content: Piece) -> Piece:
    return _joined(_text(kind), _le(sum(n for _, n in content)), *content)


def _videos(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): an MP4 or AVI file for each part, its numbers taken from the key; every thirteenth is cut off."""
    k = F.col("p_partkey")
    shown, step = k % 90 + 10, F.when(k % 4 == 0, 20).otherwise(25)
    sound = _box("trak", _box("mdia", _box("hdlr", _zeros(8), _text("soun"), _zeros(13))))
    times = _box("minf", _box("stbl", _box("stts", _zeros(4), _be(2), _be(shown), _be(step), _be(5), _be(40))))
    media = _box("mdia", _box("mdhd", _zeros(12), _be(600), _be(shown * step + 200), _zeros(4)), _box("hdlr", _zeros(8), _text("vide"), _zeros(13)), times)
    picture = _box("trak", _box("tkhd", _zeros(76), _be((k % 7 + 320) * 65536), _be(240 * 65536)), media)
    mp4 = _joined(_box("ftyp", _text("isom"), _zeros(4)), _box("mdat", _zeros(32)), _box("moov", sound, picture))
    head = _chunk("avih", _le(40_000), _zeros(12), _le(k % 500 + 1), _zeros(12), _le(k % 7 + 320), _le(240), _zeros(16))
    stream = _chunk("LIST", _text("strl"), _chunk("strh", _text("vids"), _zeros(16), _le(k % 3 + 1), _le(k % 20 + 15), _zeros(4), _le(k % 500 + 1), _zeros(20)))
    avi = _joined(_text("RIFF"), _zeros(4), _text("AVI "), _chunk("LIST", _text("hdrl"), head, stream), _chunk("LIST", _text("movi"), _zeros(32)))
    content = F.when(k % 2 == 0, F.unhex(mp4[0])).otherwise(F.unhex(avi[0]))
    cut = F.when(k % 13 != 0, max(mp4[1], avi[1])).when(k % 2 == 0, 100).otherwise(110)
    path = F.concat(F.lit("v/"), k.cast("string"), F.when(k % 2 == 0, ".mp4").otherwise(".avi"))
    return table(spark, sf, "part").select(path.alias("path"), F.substr(content, F.lit(1), cut).alias("content"))


@query(
    "WITH k AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS mp4, p_partkey % 13 = 0 AS cut, p_partkey % 90 + 15 AS f, (p_partkey % 90 + 10) * CASE WHEN p_partkey % 4 = 0 THEN 20 ELSE 25 END + 200 AS t, p_partkey % 500 + 1 AS n, (p_partkey % 20 + 15)::DOUBLE / (p_partkey % 3 + 1) AS r FROM part) "
    "SELECT 'v/' || k || CASE WHEN mp4 THEN '.mp4' ELSE '.avi' END AS path, CASE WHEN mp4 THEN 'mp4' ELSE 'avi' END AS container, CASE WHEN NOT cut THEN (320 + k % 7)::INT END AS width, CASE WHEN NOT cut THEN round(CASE WHEN mp4 THEN f * 600.0 / t ELSE r END, 6) END AS fps, CASE WHEN NOT cut THEN (CASE WHEN mp4 THEN f ELSE n END)::BIGINT END AS frame_count, CASE WHEN NOT cut THEN round(CASE WHEN mp4 THEN t / 600.0 ELSE n / r END, 6) END AS seconds, NOT cut AS readable FROM k"
)
def video_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Frame rate, frames and duration as the containers' headers have them."""
    told = video.video_headers(_videos(spark, sf))
    return rounded(told.select("path", "container", "width", "fps", "frame_count", "seconds", F.col("error").isNull().alias("readable")), "fps", "seconds")


@query(
    "WITH k AS (SELECT p_partkey AS k, p_partkey % 90 + 15 AS f, ((p_partkey % 90 + 15) * 600.0 / ((p_partkey % 90 + 10) * CASE WHEN p_partkey % 4 = 0 THEN 20 ELSE 25 END + 200))::DOUBLE AS fps FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 13 <> 0), "
    "e AS (SELECT k, f, fps, least(floor(fps), f)::BIGINT AS early, floor(fps)::BIGINT AS start FROM k), s AS (SELECT k, unnest(list_distinct(list_concat(range(0, early, greatest(1, floor(fps / 2))::BIGINT), CASE WHEN start < f THEN range(start, f, greatest(1, floor(fps / 0.5))::BIGINT) ELSE [] END))) AS source_frame FROM e) SELECT 'v/' || k || '.mp4' AS filepath, source_frame::INT AS source_frame FROM s"
)
def sampled_videos(spark: SparkSession, sf: str) -> DataFrame:
    """Frames sampled by what the headers say: nothing of a file that can't be read."""
    told = video.video_headers(_videos(spark, sf).where("path LIKE '%.mp4'")).withColumnsRenamed({"path": "filepath"}).withColumn("sample_id", F.col("filepath"))
    return frames.sample_frames(told).select("filepath", "source_frame")


_MODELS = ", ".join(f"('{m}', '{f}')" for m, f in BACKBONE_FIELDS.items())


@query(
    f"WITH b(model, field) AS (VALUES {_MODELS}), r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'hub:' || p_brand || '/' || p_type || '-' || p_partkey ELSE (SELECT list(model ORDER BY model) FROM b)[p_partkey % {len(BACKBONE_FIELDS)} + 1] END AS model FROM part) SELECT p_partkey, model, coalesce(field, 'embeddings_' || regexp_replace(regexp_replace(model, '^.*:', ''), '[/-]', '_', 'g')) AS field FROM r LEFT JOIN b USING (model)"
)
def backbone_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Where the embeddings of known and of unknown models are kept."""
    k, names = F.col("p_partkey"), sorted(BACKBONE_FIELDS)
    known = F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    model = F.when(k % 3 == 0, F.concat(F.lit("hub:"), "p_brand", F.lit("/"), "p_type", F.lit("-"), k.cast("string"))).otherwise(known)
    return table(spark, sf, "part").select(k, model.alias("model")).withColumn("field", text.backbone_field(F.col("model")))


@query("SELECT c_custkey % 25 AS k, count(*) AS n, count(DISTINCT c_custkey % 2) AS meanings FROM customer GROUP BY 1")
def nested_meanings(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations with generated identifiers at every depth: what differs in these alone means the same."""
    c = F.col("c_custkey")
    made = said("id", c).alias("_id")
    point = F.struct(made, F.struct(made, (c % 2).alias("side")).alias("place"))
    nested = F.struct(made, F.array(point, F.struct(made, F.struct(made, F.lit(3).alias("side")).alias("place"))).alias("points"), F.create_map(F.lit("a"), F.struct(made, (c % 25).alias("z"), F.lit("y").alias("b"))).alias("more"))
    rows = table(spark, sf, "customer").select((c % 25).alias("k"), nested.alias("annotation"))
    return records.meaning(rows, "annotation", "meaning").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("meaning").alias("meanings"))
