"""Queries over whole runs: ingestion, processing, evaluation, publication, reports and streams, with SQL that gives the same rows.

What a run writes goes below the scratch folder and is read back.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions import boxes
from fieldbook.operators import curate, enrichment
from fieldbook.plans import catalogue, ingest, publish, snapshot
from fieldbook.plans.catalogue_samples import said
from fieldbook.plans.registry import embedded, query, rounded
from fieldbook.session import scratch_path, table
from fieldbook.sources import exports
from fieldbook.streaming.append import append_stream


def measures(spark: SparkSession, values: dict) -> DataFrame:
    """(measure, value) of a report's few numbers or texts."""
    return spark.createDataFrame([(str(k), str(v)) for k, v in values.items()], "measure string, value string")


def _contents_hash(spark: SparkSession, sf: str) -> str:
    """A hash of all documents, whatever their order: what must not change while they are exported."""
    return str(table(spark, sf, "documents").agg(F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)"))).first()[0])


@query(
    f"WITH {catalogue._TAGGED}, ok AS (SELECT *, NOT list_has_any(all_tags, ['filter_count', 'filter_quality']) AS fine, NOT coalesce(is_duplicate, false) AS single FROM tg) SELECT 'master' AS measure, count(*)::VARCHAR AS value FROM ok UNION ALL SELECT 'segmented', count_if(fine AND detections IS NOT NULL)::VARCHAR FROM ok UNION ALL SELECT 'segmented_deduplicated', count_if(fine AND single AND detections IS NOT NULL)::VARCHAR FROM ok UNION ALL SELECT 'not_segmented', count_if(fine AND detections IS NULL)::VARCHAR FROM ok UNION ALL SELECT 'not_segmented_deduplicated', count_if(fine AND single AND detections IS NULL)::VARCHAR FROM ok UNION ALL SELECT 'fields', 'label,sample_id,tags'"
)
def variant_export(spark: SparkSession, sf: str) -> DataFrame:
    """Variants written with some of their fields, counted as read back."""
    rows, target = catalogue._tagged(spark, sf), scratch_path(spark, "variants")
    from fieldbook.operators import views

    counts = publish.export_variants(rows, target, {v: views.variant(rows, v) for v in views.VARIANTS}, ["sample_id", "tags"], identity=("label",))
    return measures(spark, counts | {"fields": ",".join(sorted(spark.read.parquet(f"{target}/master").columns))})


@query(f"WITH {catalogue._C} SELECT path AS filepath, sha256 FROM c WHERE doc_id % 2 = 0")
def published_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot published, then replaced: readers find the second version."""
    rows = catalogue._contents(spark, sf).select(F.col("path").alias("filepath"), "sha256", "doc_id")
    target, half = scratch_path(spark, "snapshot"), rows.where("doc_id % 2 = 0").select("filepath", "sha256")
    publish.publish(rows.select("filepath", "sha256"), target, publish.same_rows(rows.count(), "filepath"))
    publish.publish(half, target, publish.same_rows(half.count(), "filepath"), replace=True)
    return publish.published(spark, target)


@query("SELECT 'phase' AS measure, 'done' AS value UNION ALL SELECT 'rows', count(*)::VARCHAR FROM documents UNION ALL SELECT 'failure', 'None' UNION ALL SELECT 'again', 'FileExistsError'")
def run_reports(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot run's report as its latest.json has it, and that of a second run, which must not replace it."""
    rows = table(spark, sf, "documents").select("doc_id")
    target, reports = scratch_path(spark, "snapshot"), scratch_path(spark, "reports")
    publish.snapshot_run(rows, target, "doc_id", reports, dry_run=False)
    first = json.loads(publish.read_text(spark, f"{reports}/latest.json"))
    try:
        publish.snapshot_run(rows, target, "doc_id", reports, dry_run=False)
    except FileExistsError:
        pass
    second = json.loads(publish.read_text(spark, f"{reports}/latest.json"))
    return measures(spark, {"phase": first["phase"], "rows": first["counts"]["rows"], "failure": first["failure"], "again": second["failure"].split(":")[0]})


@query(f"WITH {catalogue._C}, {catalogue._POLICY}, {catalogue._DECIDED} SELECT path, decision = 'review' AS review_required FROM dec WHERE decision <> 'drop'")
def curated_export(spark: SparkSession, sf: str) -> DataFrame:
    """The curated dataset as its export has it."""
    decisions, made = catalogue._decisions(spark, sf)
    target = scratch_path(spark, "curated")
    publish.curated_export(decisions, made, target, "v1", lambda: _contents_hash(spark, sf))
    return spark.read.schema("path string, review_required boolean").json(f"{publish.current(spark, target)}/samples.json")


@query(f"WITH {catalogue._C}, {catalogue._POLICY}, {catalogue._DECIDED} SELECT 'samples' AS measure, count(*)::VARCHAR AS value FROM dec WHERE decision <> 'drop' UNION ALL SELECT 'version', 'v1' UNION ALL SELECT 'dropped', count(*)::VARCHAR FROM dec WHERE decision = 'drop'")
def curated_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """The metadata and the report beside a curated dataset."""
    decisions, made = catalogue._decisions(spark, sf)
    target = scratch_path(spark, "curated")
    publish.curated_export(decisions, made, target, "v1", lambda: _contents_hash(spark, sf))
    read = lambda name: json.loads(publish.read_text(spark, f"{publish.current(spark, target)}/{name}.json"))
    return measures(spark, {"samples": read("metadata")["samples"], "version": read("metadata")["version"], "dropped": read("report")["dropped"]})


@query("SELECT 'rows' AS measure, count(*)::VARCHAR AS value FROM embeddings UNION ALL SELECT 'labels', count(DISTINCT label)::VARCHAR FROM embeddings UNION ALL SELECT 'size', '64' UNION ALL SELECT 'manifest', count(*)::VARCHAR FROM embeddings UNION ALL SELECT 'fields', 'path,label,embedding' UNION ALL SELECT 'same', 'True'")
def embedding_export(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings written with their metadata, and a copy of the table without media with its manifest."""
    rows = embedded(spark, sf).select(said("f", F.col("id")).alias("path"), "label", F.col("vector").alias("embedding"))
    target = scratch_path(spark, "embeddings")
    told = publish.export_embeddings(rows, target)
    made = [publish.checkpoint_export(rows.withColumn("content", F.lit(b"x")), f"{target}/copy{i}") for i in (0, 1)]
    return measures(spark, {"rows": told["rows"], "labels": told["labels"], "size": told["embedding_shape"][1], "manifest": made[0]["rows"], "fields": ",".join(made[0]["fields"]), "same": made[0] == made[1]})


@query("SELECT 'n_samples' AS measure, count(*)::VARCHAR AS value FROM embeddings UNION ALL SELECT 'n_classes', count(DISTINCT label)::VARCHAR FROM embeddings UNION ALL SELECT 'split ' || (vec_id % 3), count(*)::VARCHAR FROM embeddings GROUP BY 1")
def dataset_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Samples, classes and samples by split."""
    told = snapshot.metadata(embedded(spark, sf).withColumn("split", (F.col("id") % 3).cast("string")), "label", "split")
    return measures(spark, {"n_samples": told["n_samples"], "n_classes": told["n_classes"]} | {f"split {k}": v for k, v in told["splits"].items()})


_NATIONS = "n AS (SELECT n_nationkey AS k FROM nation)"


def _tree(spark: SparkSession, sf: str) -> str:
    """A folder with a label sheet and a file for some nations, a table of fixed size."""
    folder = scratch_path(spark, "tree")
    keys = sorted(r[0] for r in table(spark, sf, "nation").select("n_nationkey").collect())
    lines = ["CAMERA TRAP SITE;JAGUAR ID;CAM;Files Name"]
    for k in keys:
        if k % 5:
            publish.write_text(spark, f"{folder}/media/SITE {k % 4}/CAM A/clip_{k:04d}_of_the_trap.mp4", "x")
        if k % 3:
            name = f"clip_{k:04d}_of_the_trap.mp4" if k % 2 else f"CLIP-{k:04d}-of-the-trap.mp4"
            lines.append(f"site 0{k % 4};{'F' + str(k) if k % 4 else '?'};a;{name}")
    publish.write_text(spark, f"{folder}/labels.csv", "\n".join(lines) + "\n")
    return folder


@query(
    f"WITH {_NATIONS}, w AS (SELECT k, CASE WHEN k % 2 = 1 THEN 'clip_' ELSE 'clip-' END || printf('%04d', k) AS target FROM n WHERE k % 3 > 0) SELECT 'rows' AS measure, count(*)::VARCHAR AS value FROM w UNION ALL SELECT 'cleaned', count(*)::VARCHAR FROM w UNION ALL SELECT 'status', 'dry_run' UNION ALL SELECT 'exact', count(*)::VARCHAR FROM w WHERE k % 2 = 1 AND k % 5 > 0"
)
def ingestion_run(spark: SparkSession, sf: str) -> DataFrame:
    """A dry run over a label sheet and its media, then one that writes: rows, cleaned rows, files found by their exact name."""
    folder = _tree(spark, sf)
    report = ingest.ingest(spark, f"{folder}/media", f"{folder}/labels.csv", f"{folder}/out")
    ingest.ingest(spark, f"{folder}/media", f"{folder}/labels.csv", f"{folder}/out", dry_run=False)
    exact = spark.read.csv(f"{folder}/out/labels", header=True).where("method = 'exact_name'").count()
    return measures(spark, {"rows": report["rows"], "cleaned": report["cleaned"], "status": report["status"], "exact": exact})


@query(f"WITH {catalogue._V}, {catalogue._CLOSED}, i AS (SELECT label, row_number() OVER (ORDER BY md5('42i:' || label)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM u)), o AS (SELECT u.id, CASE WHEN k <= floor(i.n * 0.6) THEN 'train' WHEN k <= floor(i.n * 0.6) + floor(i.n * 0.2) THEN CASE WHEN md5('42:' || id) < 'cccccccd' THEN 'train' WHEN md5('42:' || id) < 'e6666666' THEN 'val' ELSE 'test' END ELSE CASE WHEN md5('42:' || id) < '80000000' THEN 'val' ELSE 'test' END END AS s FROM u JOIN i USING (label)) SELECT id AS sample_id, closed_set_split, s AS open_set_split, s AS split, CASE WHEN id % 4 = 0 THEN 'filter_count,' || s WHEN id % 4 = 1 THEN 'filter_quality,' || s ELSE s END AS tags, false AS is_duplicate FROM o JOIN c USING (id)")
def processed_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Detections tagged, splits assigned, no two samples similar enough to be duplicates."""
    i = F.col("id")
    one = F.struct(F.lit("d").alias("id"), F.lit("x").alias("label"), F.when(i % 4 == 1, 0.2).otherwise(0.9).alias("confidence"), F.array(*map(F.lit, (0.1, 0.1, 0.5, 0.5))).alias("bounding_box"))
    found = F.when(i % 4 > 0, F.array(one)).cast(boxes.DETECTIONS)
    rows = embedded(spark, sf).select(i.alias("sample_id"), found.alias("detections"), F.array().cast("array<string>").alias("tags"), "label", "vector")
    made = ingest.process(rows, ingest.Processing(similarity=1.5))
    return made.select("sample_id", "closed_set_split", "open_set_split", "split", F.array_join("tags", ",").alias("tags"), "is_duplicate")


_PART = "WITH keep AS (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= {least}), " + catalogue._S.replace("FROM embeddings", "FROM embeddings WHERE vec_id % 3 = 1 AND label IN (SELECT label FROM keep)") + catalogue._P


@query("SELECT *, 'all' AS scope FROM (" + _PART.format(least=0) + ") UNION ALL SELECT *, 'supported' FROM (" + _PART.format(least=9) + ")")
def evaluation_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval metrics of one split, over all its identities and over those with enough samples in all splits."""
    part = F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("id") % 3 + 1).cast("int"))
    rows = embedded(spark, sf).select(F.col("id").alias("sample_id"), "label", "vector", part.alias("split"))
    return rounded(ingest.evaluate(rows, "val", 9), *catalogue._RATES)


@query("WITH x AS (SELECT event_id, 'k' || (event_id % 700) AS path, 'h' || (event_id % 900) AS sha1 FROM events), p AS (SELECT * FROM x QUALIFY event_id = min(event_id) OVER (PARTITION BY path)) SELECT event_id FROM p QUALIFY event_id = min(event_id) OVER (PARTITION BY sha1)")
def appended_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stream appended once however often it arrives: the same files twice give the rows of the first time."""
    e = F.col("event_id")
    rows = table(spark, sf, "events").select("event_id", said("k", e % 700).alias("path"), said("h", e % 900).alias("sha1"))
    source, target = scratch_path(spark, "stream"), scratch_path(spark, "appended")
    for _ in range(2):
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        append_stream(stream, target, ["path", "sha1"], "event_id", f"{target}-checkpoint").awaitTermination()
    return spark.read.parquet(target).select("event_id")


@query("SELECT 'exports' AS measure, 4 AS value UNION ALL SELECT 'manifests', 2 UNION ALL SELECT 'clip errors', count(*) FROM part WHERE p_partkey % 3 = 0")
def curation_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Conventional sources, and clipped rows that don't have exactly one detection."""
    folders, manifests = exports.conventional_paths("/x")
    p = F.col("p_partkey")
    rows = table(spark, sf, "part").select(said("p", p).alias("path"), F.lit("clip").alias("decision"), F.when(p % 3 > 0, F.array(F.lit(1))).when(p % 2 == 0, F.array(F.lit(1), F.lit(2))).alias("bboxes_body"))
    n = curate.clip_errors(rows).agg(F.count(F.lit(1)).alias("value")).select(F.lit("clip errors").alias("measure"), "value")
    return spark.createDataFrame([("exports", len(folders)), ("manifests", len(manifests))], "measure string, value long").unionByName(n)


class Killed(Exception):
    """Ends a run from outside."""


def _length():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def _words():
    def count(texts: list[str]) -> list[list[float]]:
        if any(len(t) % 50 == 0 for t in texts):
            raise ValueError("a length that this model refuses")
        return [[float(len(t.split(" ")))] for t in texts]

    return count


@query(
    "WITH t AS (SELECT text, len(text) AS n FROM documents) SELECT 'length' AS model, count(text) AS n, 0::BIGINT AS failed, sum(n)::DOUBLE AS total FROM t UNION ALL SELECT 'words', count(text) FILTER (WHERE n % 50 <> 0), count(text) FILTER (WHERE n % 50 = 0), (sum(len(string_split(text, ' '))) FILTER (WHERE n % 50 <> 0))::DOUBLE FROM t"
)
def resumed_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Two models over all documents: a run that is killed half-way, one that does the rest, one with nothing but failures to do."""
    rows, target = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").alias("payload")), scratch_path(spark, "enriched")
    models = {"length": ("v1", _length), "words": ("v1", _words)}

    def kill(k: int) -> None:
        if k == 1:
            raise Killed

    try:
        enrichment.enrich(rows, models, target, slices=4, after_slice=kill)
    except Killed:
        pass
    for _ in range(2):
        enrichment.enrich(rows, models, target, slices=2)
    stored = enrichment.results(spark, target)
    return stored.groupBy("model").agg(F.count("embedding").alias("n"), F.count("error").alias("failed"), F.sum(F.get("embedding", F.lit(0)).cast("double")).alias("total"))


_DRAWN = "(('0x' || substr(md5('42:' || vec_id || ':' || i || ':{k}'), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657.0"
_RANDOM = f"g AS (SELECT vec_id AS id, label, i, sqrt(-2 * ln({_DRAWN.format(k=0)})) * cos(2 * pi() * {_DRAWN.format(k=1)}) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) d WHERE vec_id % 3 = 1), m AS (SELECT id, sqrt(sum(x * x)) AS n FROM g GROUP BY id), v AS (SELECT g.id, any_value(label) AS label, list((x / (n + 1e-12))::FLOAT::DOUBLE ORDER BY i) AS v FROM g JOIN m ON g.id = m.id GROUP BY g.id)"


@query(f"WITH {_RANDOM}, {catalogue._S[catalogue._S.index('u AS (SELECT id, label, v'):]}{catalogue._P}")
def evaluation_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval metrics of one split with random vectors in place of its own."""
    part = F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("id") % 3 + 1).cast("int"))
    rows = embedded(spark, sf).select(F.col("id").alias("sample_id"), "label", "vector", part.alias("split"))
    return rounded(ingest.evaluate(rows, "val", 9, "random_baseline").where("scope = 'all'").drop("scope"), *catalogue._RATES)
