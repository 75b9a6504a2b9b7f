"""Every registered query of the curation engine, with SQL that gives the same rows.

The tables stand in for label sheets, samples, detections, candidates and runs;
each query derives what it needs from whole tables. Doubles are rounded on both
sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions import boxes, text
from fieldbook.operators import clean, curate, dedup, experiments, frames, inference, lineage, match, metrics, near_blocks, records, similarity_index, split, stats, validate, vectors, views
from fieldbook.plans import snapshot
from fieldbook.plans.registry import embedded, query, rounded
from fieldbook.session import materialize, table

_V = "v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT id, label, v, sqrt(list_dot_product(v, v)) AS n FROM v)"
_S = _V + ", s AS (SELECT a.id AS q, a.label AS ql, b.id AS g, b.label AS gl, round(list_dot_product(a.v, b.v) / ((a.n + 1e-12) * (b.n + 1e-12)), 12) AS s FROM u a JOIN u b ON a.id <> b.id)"
_P = ", r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, g) AS rk FROM s), h AS (SELECT q, ql, rk, row_number() OVER (PARTITION BY q ORDER BY rk) AS hit FROM r WHERE ql = gl), p AS (SELECT q, ql, avg(hit / rk) AS ap, min(rk) AS f FROM h GROUP BY q, ql), l AS (SELECT avg(ap) AS m FROM p GROUP BY ql) SELECT count(*) AS n_queries, round(avg(ap), 6) AS map, (SELECT round(avg(m), 6) FROM l) AS identity_balanced_map, round(avg((f <= 1)::INT), 6) AS cmc_1, round(avg((f <= 5)::INT), 6) AS cmc_5, round(avg((f <= 10)::INT), 6) AS cmc_10, round(avg((f <= 20)::INT), 6) AS cmc_20 FROM p"
_RATES = ("map", "identity_balanced_map", "cmc_1", "cmc_5", "cmc_10", "cmc_20")


@query(f"WITH {_S}{_P}")
def retrieval_map_cmc(spark, sf):
    return rounded(metrics.retrieval_metrics(embedded(spark, sf)), *_RATES)


@query("WITH keep AS (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 50), " + _S.replace("FROM embeddings", "FROM embeddings WHERE label IN (SELECT label FROM keep)") + _P)
def retrieval_map_filtered(spark, sf):
    return rounded(metrics.retrieval_metrics(metrics.with_support(embedded(spark, sf), 50)), *_RATES)


@query(f"WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, g) AS rk FROM s), f AS (SELECT q, min(rk) AS f FROM r WHERE ql = gl GROUP BY q), n AS (SELECT count(*) AS n FROM embeddings) SELECT round(count_if(f <= 1) / (SELECT n FROM n), 6) AS cmc_1, round(count_if(f <= 3) / (SELECT n FROM n), 6) AS cmc_3, round(count_if(f <= 5) / (SELECT n FROM n), 6) AS cmc_5 FROM f")
def retrieval_cmc_all_queries(spark, sf):
    return rounded(metrics.cmc_all_queries(embedded(spark, sf)), "cmc_1", "cmc_3", "cmc_5")


@query(f"WITH {_S} SELECT q AS id, count(*) FILTER (s >= 0.25) AS n_links, arg_min(g, (-s, g)) FILTER (s >= 0.25) AS nearest, round(max(s) FILTER (s >= 0.25), 6) AS similarity FROM s GROUP BY q")
def similar_neighbours(spark, sf):
    return rounded(near_blocks.neighbour_counts(embedded(spark, sf), 0.25), "similarity")


@query(
    f"WITH RECURSIVE {_S}, e AS MATERIALIZED (SELECT q AS a, g AS b, s FROM s WHERE s >= 0.25 AND q < g), o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k, coalesce(ns, []) AS ns FROM u LEFT JOIN (SELECT b, list(a) AS ns FROM e GROUP BY b) ON b = id), "
    "w(k, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.k, CASE WHEN list_has_any(w.leaders, o.ns) THEN w.leaders ELSE list_append(w.leaders, o.id) END FROM w JOIN o ON o.k = w.k + 1), "
    "f AS MATERIALIZED (SELECT unnest(arg_max(leaders, k)) AS leader FROM w), d AS (SELECT b, min(a) AS duplicate_of, arg_min(s, a) AS s FROM e JOIN f ON a = leader WHERE b NOT IN (SELECT leader FROM f) GROUP BY b) "
    "SELECT id, b IS NOT NULL AS is_duplicate, duplicate_of, round(s, 6) AS duplicate_similarity FROM u LEFT JOIN d ON b = id"
)
def near_dup_greedy(spark, sf):
    return rounded(dedup.greedy_leaders(embedded(spark, sf), 0.25, places=12), "duplicate_similarity")


def _document_vectors(spark, sf):
    """(id, vector): words of a document counted in 64 hashed places, half of the words negatively; documents without words have none."""
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))
    digest = F.md5("word")
    placed = words.select("doc_id", (F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % 64).alias("place"), F.when(F.substring(digest, 3, 1) < "8", 1).otherwise(-1).alias("sign"))
    sums = placed.groupBy("doc_id").agg(*[F.sum(F.when(F.col("place") == i, F.col("sign")).otherwise(0)).cast("double").alias(f"x{i}") for i in range(64)])
    return materialize(sums.select(F.col("doc_id").alias("id"), F.array(*[f"x{i}" for i in range(64)]).alias("vector")), "document-vectors")


_D = r"d AS (SELECT doc_id, md5(unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS h FROM documents), e AS (SELECT doc_id, ('0x' || substr(h, 1, 2))::INT % 64 AS place, sum(CASE WHEN substr(h, 3, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS x FROM d GROUP BY 1, 2), g AS (SELECT doc_id, p AS place, 0::DOUBLE AS x FROM (SELECT DISTINCT doc_id FROM e) i, range(64) r(p)), v AS (SELECT doc_id AS id, list(x ORDER BY place) AS v FROM (SELECT doc_id, place, sum(x) AS x FROM (SELECT * FROM e UNION ALL SELECT * FROM g) y GROUP BY 1, 2) k GROUP BY 1), u AS MATERIALIZED (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM v), s AS (SELECT a.id AS q, b.id AS g, list_dot_product(a.v, b.v) / ((a.n + 1e-12) * (b.n + 1e-12)) AS s FROM u a JOIN u b ON a.id < b.id)"


@query(
    f"WITH RECURSIVE {_D}, e2 AS MATERIALIZED (SELECT q AS a, g AS b, s FROM s WHERE s >= 0.98), o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k, coalesce(ns, []) AS ns FROM u LEFT JOIN (SELECT b, list(a) AS ns FROM e2 GROUP BY b) ON b = id), "
    "w(k, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.k, CASE WHEN list_has_any(w.leaders, o.ns) THEN w.leaders ELSE list_append(w.leaders, o.id) END FROM w JOIN o ON o.k = w.k + 1), "
    "f AS MATERIALIZED (SELECT unnest(arg_max(leaders, k)) AS leader FROM w), x AS (SELECT b, min(a) AS duplicate_of, arg_min(s, a) AS s FROM e2 JOIN f ON a = leader WHERE b NOT IN (SELECT leader FROM f) GROUP BY b) "
    "SELECT id, b IS NOT NULL AS is_duplicate, duplicate_of, round(s, 6) AS duplicate_similarity FROM u LEFT JOIN x ON b = id"
)
def document_near_dups(spark, sf):
    return rounded(dedup.greedy_leaders(_document_vectors(spark, sf), 0.98), "duplicate_similarity")


@query()
def near_dup_pruning(spark, sf):
    """How much of all pairs of blocks an exact search for near duplicates compares."""
    found = near_blocks.near_blocks(_document_vectors(spark, sf), 0.98)
    return spark.createDataFrame([(found.n_blocks, found.n_pairs, round(found.share, 6))], "n_blocks long, n_pairs long, share double")


_CLOSED = "first AS (SELECT label, arg_min(id, (md5('42o:' || id), id)) AS first_id FROM u GROUP BY label), c AS (SELECT u.id, u.label, CASE WHEN id = first_id THEN 'train' WHEN md5('42:' || id) < 'cccccccd' THEN 'train' WHEN md5('42:' || id) < 'e6666666' THEN 'val' ELSE 'test' END AS closed_set_split FROM u JOIN first USING (label))"


def _closed(spark, sf):
    return split.closed_set_split(embedded(spark, sf), "label", "id")


@query(f"WITH {_V}, {_CLOSED} SELECT id, label, closed_set_split FROM c")
def closed_set_split(spark, sf):
    return _closed(spark, sf).select("id", "label", "closed_set_split")


@query(f"WITH {_S}, {_CLOSED} SELECT q AS id, a.closed_set_split AS split, count(*) AS n_leaks FROM s JOIN c a ON a.id = q JOIN c b ON b.id = g WHERE s >= 0.3 AND a.closed_set_split <> b.closed_set_split GROUP BY 1, 2")
def leaky_split_rows(spark, sf):
    return dedup.leaky_splits(_closed(spark, sf).withColumnRenamed("closed_set_split", "split"), 0.3)


@query(
    "WITH i AS (SELECT c_nationkey, row_number() OVER (ORDER BY md5('42i:' || c_nationkey)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT c_nationkey FROM customer)) "
    "SELECT c_custkey, c_nationkey, CASE WHEN k <= floor(n * 0.6) THEN 'train' WHEN k <= floor(n * 0.6) + floor(n * 0.2) THEN CASE WHEN md5('42:' || c_custkey) < 'cccccccd' THEN 'train' WHEN md5('42:' || c_custkey) < 'e6666666' THEN 'val' ELSE 'test' END ELSE CASE WHEN md5('42:' || c_custkey) < '80000000' THEN 'val' ELSE 'test' END END AS open_set_split FROM customer JOIN i USING (c_nationkey)"
)
def open_set_split(spark, sf):
    return split.open_set_split(table(spark, sf, "customer"), "c_nationkey", "c_custkey").select("c_custkey", "c_nationkey", "open_set_split")


@query(
    "WITH r AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings), c AS (SELECT label, row_number() OVER (ORDER BY md5('42c:' || label)) - 1 AS o FROM (SELECT DISTINCT label FROM r WHERE n >= 4)) "
    "SELECT CAST(floor(o / 3) AS BIGINT) AS batch, label, id FROM r JOIN c USING (label) WHERE k <= 4 AND floor(o / 3) < (SELECT count(*) // 3 FROM c)"
)
def pk_batches(spark, sf):
    return split.pk_batches(embedded(spark, sf), "label", p=3, k=4)


@query("SELECT vec_id AS id, label, count(*) OVER (PARTITION BY label) AS n_class, round(1 / count(*) OVER (PARTITION BY label), 6) AS weight FROM embeddings")
def class_balanced_weights(spark, sf):
    return rounded(split.class_weights(embedded(spark, sf), "label").select("id", "label", "n_class", "weight"), "weight")


@query("WITH w AS (SELECT vec_id AS id, label, -ln((('0x' || substr(md5('42w:' || vec_id), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657.0) * count(*) OVER (PARTITION BY label) AS t FROM embeddings) SELECT id, label FROM w ORDER BY t, id LIMIT 100")
def class_balanced_sample(spark, sf):
    return split.class_balanced_sample(embedded(spark, sf), "label", 100).select("id", "label")


@query("SELECT vec_id AS id FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 50")
def random_subset(spark, sf):
    return split.random_subset(embedded(spark, sf), 50).select("id")


@query("SELECT vec_id AS id, label, dense_rank() OVER (ORDER BY 'L' || label) - 1 AS label_id FROM embeddings")
def label_encoding(spark, sf):
    return metrics.label_ids(embedded(spark, sf).withColumn("name", F.concat(F.lit("L"), "label")), "name").select("id", "label", F.col("label_id").cast("long"))


@query("SELECT vec_id AS id, len(embedding) = 64 AS valid, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def embedding_contract(spark, sf):
    return rounded(embedded(spark, sf).select("id", vectors.is_valid(F.col("vector"), 64).alias("valid"), vectors.norm(F.col("vector")).alias("norm")), "norm")


@query()
def embedding_checksums(spark, sf):
    rows = embedded(spark, sf).withColumn("checksum", vectors.checksum(F.col("vector")))
    plan = vectors.reuse_plan(F.col("vector"), F.lit("r1"), F.col("checksum"), "r1", False)
    return rows.select("id", "checksum", plan.alias("plan"))


_LOGITS = "x AS (SELECT vec_id AS id, label % 8 AS y, list_transform(embedding[1:8], lambda x: x::DOUBLE * 10) AS z FROM embeddings), m AS (SELECT *, list_max(z) + ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) AS lse FROM x)"


def _logits(spark, sf):
    return embedded(spark, sf).select("id", (F.col("label") % 8).alias("y"), F.transform(F.slice("vector", 1, 8), lambda x: x.cast("double") * 10).alias("z"))


@query(
    f"WITH {_LOGITS} SELECT id, round(-pow(1 - exp(z[y + 1] - lse), 2.0) * (z[y + 1] - lse), 6) AS focal, round(lse - z[y + 1], 6) AS cross_entropy, round(lse - 0.9 * z[y + 1] - 0.1 * list_sum(z) / 8, 6) AS label_smoothing, "
    "round((list_sum(list_transform(z, lambda v: greatest(0, 1 - z[y + 1] + v))) - 1) / 8, 6) AS multi_margin FROM m"
)
def classification_losses(spark, sf):
    made = {"focal": metrics.build_loss("focal"), "cross_entropy": metrics.build_loss("cross_entropy"), "label_smoothing": metrics.build_loss("label_smoothing"), "multi_margin": metrics.build_loss("multi_margin")}
    return rounded(_logits(spark, sf).select("id", *[f(F.col("z"), F.col("y")).alias(k) for k, f in made.items()]), *made)


@query(
    "WITH x AS (SELECT vec_id AS id, greatest(least(embedding[1]::DOUBLE, 1 - 1e-7), -1 + 1e-7) AS c, embedding[1]::DOUBLE AS raw FROM embeddings), p AS (SELECT *, c * cos(0.5) - sqrt(1 - c * c) * sin(0.5) AS phi FROM x) "
    "SELECT id, round(30 * CASE WHEN c > cos(pi() - 0.5) THEN phi ELSE c - sin(pi() - 0.5) * 0.5 END, 6) AS arcface, round(30 * CASE WHEN c > 0 THEN phi ELSE c END, 6) AS easy FROM p"
)
def arcface_logits(spark, sf):
    c = F.get("vector", F.lit(0)).cast("double")
    return rounded(embedded(spark, sf).select("id", metrics.arcface_logit(c).alias("arcface"), metrics.arcface_logit(c, easy=True).alias("easy")), "arcface", "easy")


def _batches(spark, sf):
    return embedded(spark, sf).withColumn("batch", F.floor(F.col("id") / 32))


_D = "e AS (SELECT vec_id AS id, vec_id // 32 AS batch, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), d AS (SELECT a.batch, a.id AS a, b.id AS b, a.label = b.label AS same, sqrt(greatest(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 0) + 1e-8) AS d FROM e a JOIN e b ON a.batch = b.batch AND a.id <> b.id)"
_HARD = "hard AS (SELECT batch, coalesce(avg(l), 0.0) AS loss FROM (SELECT batch, a, CASE WHEN count(*) FILTER (NOT same) = 0 THEN 0.0 ELSE greatest(max(d) FILTER (same) - min(d) FILTER (NOT same) + 0.3, 0) END AS l FROM d GROUP BY batch, a HAVING count(*) FILTER (same) > 0) GROUP BY batch)"
_ALL = "allt AS (SELECT batch, avg(l) AS loss FROM (SELECT p.batch, p.d - n.d + 0.3 AS l FROM d p JOIN d n ON p.batch = n.batch AND p.a = n.a WHERE p.same AND NOT n.same) WHERE l > 1e-16 GROUP BY batch)"
_SEMI = "semih AS (SELECT batch, avg(l) AS loss FROM (SELECT p.batch, p.a, p.b, any_value(p.d) - min(n.d) + 0.3 AS l FROM d p JOIN d n ON p.batch = n.batch AND p.a = n.a AND n.d > p.d AND n.d < p.d + 0.3 WHERE p.same AND NOT n.same GROUP BY p.batch, p.a, p.b) GROUP BY batch)"


@query(f"WITH {_D}, {_HARD}, {_ALL}, {_SEMI}, b AS (SELECT DISTINCT batch FROM e) SELECT batch, round(coalesce(hard.loss, 0), 6) AS hard, round(coalesce(semih.loss, hard.loss, 0), 6) AS semi_hard, round(coalesce(allt.loss, 0), 6) AS all_triplets FROM b LEFT JOIN hard USING (batch) LEFT JOIN semih USING (batch) LEFT JOIN allt USING (batch)")
def triplet_losses(spark, sf):
    rows, made = _batches(spark, sf), None
    for mining, name in (("hard", "hard"), ("semi_hard", "semi_hard"), ("all", "all_triplets")):
        part = metrics.triplet_loss(rows, 0.3, mining).withColumnRenamed("loss", name)
        made = part if made is None else made.join(part, "batch")
    return rounded(made, "hard", "semi_hard", "all_triplets")


def _contents(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    path = F.format_string("data/%08d.txt", "doc_id")
    rows = docs.join(labels, "doc_id", "left").select("doc_id", path.alias("path"), dedup.content_hash(F.coalesce("text", F.lit(""))).alias("sha256"), "quality", "toxic", "source", "lang")
    return rows.withColumns({"identity": F.when(F.col("quality") == 1, F.col("source")), "compatible": F.coalesce(F.col("toxic") == 0, F.lit(True))})


_C = "c AS (SELECT doc_id, printf('data/%08d.txt', doc_id) AS path, sha256(coalesce(text, '')) AS sha256, CASE WHEN quality = 1 THEN source END AS identity, coalesce(toxic = 0, true) AS compatible, quality, toxic, source, lang FROM documents LEFT JOIN labels USING (doc_id))"
_BEST = "ORDER BY (identity IS NULL), NOT compatible, path"


@query(f"WITH {_C} SELECT doc_id, path, sha256, first_value(path) OVER w AS keep_path, count(*) OVER (PARTITION BY sha256) AS group_size, row_number() OVER w = 1 AS kept FROM c WINDOW w AS (PARTITION BY sha256 {_BEST} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def exact_content_representatives(spark, sf):
    rows = _contents(spark, sf)
    return dedup.representatives(rows, "sha256", F.lit(True), F.col("identity"), F.col("compatible"), "path").select("doc_id", "path", "sha256", "keep_path", "group_size", "kept")


@query(f"WITH {_C} SELECT sha256 AS hash, unnest(list_filter([CASE WHEN min(identity) <> max(identity) THEN 'identities differ' END, CASE WHEN min(lang) <> max(lang) THEN 'annotations differ' END], lambda x: x IS NOT NULL)) AS reason FROM c GROUP BY sha256")
def content_conflicts(spark, sf):
    return dedup.conflicts(_contents(spark, sf), "sha256", "identity", "lang")


@query(f"WITH {_C}, g AS (SELECT sha256, count(*) AS n FROM c GROUP BY sha256) SELECT count(*) AS unique_keys, count_if(n > 1) AS duplicate_groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows, coalesce(sum(n * (n - 1) // 2), 0)::BIGINT AS duplicate_pairs FROM g")
def duplicate_diagnostics(spark, sf):
    return dedup.duplicate_diagnostics(_contents(spark, sf), "sha256")


@query(f"WITH {_C} SELECT sha256, count(*) AS n, min(doc_id) AS first_id FROM c GROUP BY sha256 HAVING count(*) > 1")
def duplicate_content_groups(spark, sf):
    return dedup.duplicate_groups(_contents(spark, sf).withColumnRenamed("doc_id", "id"), ["sha256"])


_POLICY = "pol AS (SELECT path, CASE doc_id % 3 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'review' ELSE 'clip' END AS action FROM c WHERE doc_id % 40 = 7)"
#: Of equal content the row with a valid annotation, then an identity, then a compatible lineage, then the least path; then the policy.
_DECIDED = "j AS (SELECT c.*, action, doc_id % 7 <> 3 AS valid FROM c LEFT JOIN pol USING (path)), k AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS group_size, first_value(path) OVER (PARTITION BY sha256 ORDER BY NOT valid, identity IS NULL, NOT compatible, path) AS keep_path FROM j), dec AS (SELECT *, CASE WHEN path <> keep_path OR action = 'false_positive' THEN 'drop' WHEN action = 'review' THEN 'review' WHEN action = 'clip' THEN 'clip' ELSE 'keep' END AS decision, CASE WHEN path <> keep_path THEN 'exact_content_duplicate' WHEN action = 'false_positive' THEN 'confirmed_false_positive' WHEN action = 'review' THEN 'policy' END AS reason FROM k)"


def _decisions(spark, sf):
    """Decisions and curated rows; every seventh row's box reaches out of its picture."""
    width = F.when(F.col("doc_id") % 7 == 3, 1.5).otherwise(0.5)
    rows = _contents(spark, sf).withColumns({"bboxes_body": F.array(F.struct(F.lit("d").alias("id"), F.lit("x").alias("label"), F.lit(0.9).alias("confidence"), F.array(F.lit(0.1), F.lit(0.1), width, F.lit(0.5)).alias("bounding_box"))), "tags": F.array().cast("array<string>")})
    action = F.element_at(F.array(F.lit("false_positive"), F.lit("review"), F.lit("clip")), (F.col("doc_id") % 3 + 1).cast("int"))
    policy = rows.where("doc_id % 40 = 7").select("path", action.alias("action"), F.lit("policy").alias("reason"), F.array(*map(F.lit, (0.0, 0.0, 0.4, 0.4))).alias("box"))
    decisions = curate.decide(rows, policy)
    return decisions, curate.curated(decisions, "v1")


@query(f"WITH {_C}, {_POLICY}, {_DECIDED} SELECT path, action || ' was not applied' AS error FROM dec WHERE (action = 'false_positive' AND reason <> 'confirmed_false_positive') OR (action <> 'false_positive' AND decision <> action) UNION ALL SELECT path, 'annotation is not valid' FROM dec WHERE decision = 'keep' AND NOT valid")
def curation_errors(spark, sf):
    decisions, _ = _decisions(spark, sf)
    return curate.action_errors(decisions).unionByName(curate.annotation_errors(decisions))


@query(f"WITH {_C}, {_POLICY}, {_DECIDED} SELECT path, decision, reason FROM dec")
def curation_decisions(spark, sf):
    return _decisions(spark, sf)[0].select("path", "decision", "reason")


@query(
    f"WITH {_C}, {_POLICY}, {_DECIDED}, o AS (SELECT count(*) AS source, count_if(decision <> 'drop') AS kept, count_if(decision = 'drop') AS dropped, count_if(reason = 'exact_content_duplicate') AS dropped_duplicates, count_if(reason = 'confirmed_false_positive') AS dropped_false_positives, count_if(decision = 'review') AS review, count_if(decision = 'clip') AS clipped, "
    "count_if(decision <> 'drop' AND identity IS NOT NULL) AS identified, count_if(decision <> 'drop' AND identity IS NULL) AS unidentified, count(DISTINCT CASE WHEN decision <> 'drop' THEN identity END) AS identities, count(DISTINCT CASE WHEN group_size > 1 THEN sha256 END) AS duplicate_groups FROM dec) "
    "SELECT measure, value::BIGINT AS value FROM (UNPIVOT (SELECT COLUMNS(*)::BIGINT FROM o) ON COLUMNS(*) INTO NAME measure VALUE value)"
)
def curation_report(spark, sf):
    return curate.report(_decisions(spark, sf)[0])


@query(f"WITH {_C}, {_POLICY}, {_DECIDED} SELECT path, substr(sha256(('v1' || chr(0) || path)), 1, 24) AS sample_id, decision = 'review' AS review_required, CASE WHEN decision = 'review' THEN 'pending' END AS review_status, CASE WHEN decision = 'review' THEN NULL WHEN decision = 'clip' THEN 0.16::DOUBLE WHEN NOT valid THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS area FROM dec WHERE decision <> 'drop'")
def curated_samples(spark, sf):
    made = _decisions(spark, sf)[1]
    return made.select("path", "sample_id", "review_required", "review_status", F.round(boxes.area(F.get("bboxes_body", F.lit(0))["bounding_box"]), 6).alias("area"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with detections, tags, duplicates and identities, derived from documents."""
    docs = table(spark, sf, "documents")
    one = lambda i: F.struct(F.concat(F.lit("d"), i.cast("string")).alias("id"), F.col("lang").alias("label"), ((F.col("n_chars") + i * 31) % 100 / 100).alias("confidence"), F.array(F.lit(0.1), F.lit(0.1), (F.col("doc_id") + i) % 10 / 10, F.lit(0.5)).alias("bounding_box"))
    found = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 4 == 0, F.array().cast(boxes.DETECTIONS)).otherwise(F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 4 - 1).cast("int")), one).cast(boxes.DETECTIONS))
    return docs.select(
        F.col("doc_id").alias("sample_id"),
        F.when(F.col("doc_id") % 7 == 0, "video").otherwise("image").alias("group_slice"),
        found.alias("detections"),
        F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 5 == 1).alias("is_duplicate"),
        F.array(F.col("lang"), F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string"))).alias("tags"),
        F.when(F.col("doc_id") % 13 > 0, F.col("source")).alias("label"),
    )


_SAMPLES = "smp AS (SELECT doc_id AS sample_id, CASE WHEN doc_id % 7 = 0 THEN 'video' ELSE 'image' END AS group_slice, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE list_transform(range(doc_id % 4), lambda i: {'id': 'd' || i, 'confidence': ((n_chars + i * 31) % 100) / 100, 'w': ((doc_id + i) % 10) / 10}) END AS detections, CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 = 1 END AS is_duplicate, [lang, 't' || (doc_id % 3)] AS tags, CASE WHEN doc_id % 13 > 0 THEN source END AS label, lang FROM documents)"
_TAGGED = _SAMPLES + ", tg AS (SELECT *, list_concat(tags, list_concat(CASE WHEN coalesce(len(detections), 0) <> 1 THEN ['filter_count'] ELSE [] END, CASE WHEN len(list_filter(coalesce(detections, []), lambda d: d.confidence < 0.3 OR d.w * 0.5 < 0.1 OR d.w * 0.5 > 0.4)) > 0 THEN ['filter_quality'] ELSE [] END)) AS all_tags FROM smp)"


def _tagged(spark, sf):
    return views.tag_by_quality(views.tag_by_count(samples(spark, sf), "detections"), "detections", 0.3, 0.1, 0.4)


@query(f"WITH {_TAGGED} SELECT sample_id, array_to_string(all_tags, ',') AS tags FROM tg")
def detection_filters(spark, sf):
    return _tagged(spark, sf).select("sample_id", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {_TAGGED} SELECT sample_id FROM tg WHERE NOT list_has_any(all_tags, ['filter_count', 'filter_quality'])")
def cleaned_samples(spark, sf):
    return views.without_tagged(_tagged(spark, sf), ["filter_count", "filter_quality"]).select("sample_id")


@query(
    f"WITH {_TAGGED}, ok AS (SELECT *, NOT list_has_any(all_tags, ['filter_count', 'filter_quality']) AS fine, NOT coalesce(is_duplicate, false) AS single FROM tg) SELECT 'master' AS variant, sample_id FROM ok UNION ALL SELECT 'segmented', sample_id FROM ok WHERE fine AND detections IS NOT NULL UNION ALL SELECT 'segmented_deduplicated', sample_id FROM ok WHERE fine AND single AND detections IS NOT NULL "
    "UNION ALL SELECT 'not_segmented', sample_id FROM ok WHERE fine AND detections IS NULL UNION ALL SELECT 'not_segmented_deduplicated', sample_id FROM ok WHERE fine AND single AND detections IS NULL"
)
def variant_views(spark, sf):
    rows, made = _tagged(spark, sf), None
    for name in views.VARIANTS:
        part = views.variant(rows, name).select(F.lit(name).alias("variant"), "sample_id")
        made = part if made is None else made.unionByName(part)
    return made


@query(f"WITH {_SAMPLES} SELECT sample_id, d.id AS det_id, coalesce(lang, label) AS patch_label FROM (SELECT sample_id, lang, label, unnest(detections) AS d FROM smp) WHERE coalesce(lang, label) IS NOT NULL")
def detection_patches(spark, sf):
    return views.patches(samples(spark, sf), "detections").select("sample_id", F.col("detection.id").alias("det_id"), "patch_label")


@query(f"WITH {_SAMPLES}, k AS (SELECT sample_id, list_filter(detections, lambda d: d.confidence >= 0.5) AS d FROM smp) SELECT sample_id, len(d) AS n FROM k WHERE len(d) > 0")
def confident_detections(spark, sf):
    return views.keep_confident(samples(spark, sf), "detections", 0.5).select("sample_id", F.size("detections").cast("long").alias("n"))


@query(f"WITH {_SAMPLES} SELECT sample_id FROM smp WHERE group_slice = 'image'")
def image_slice(spark, sf):
    return views.images(samples(spark, sf)).select("sample_id")


@query(f"WITH {_SAMPLES} SELECT CASE WHEN detections IS NULL THEN 0 ELSE len(detections) END AS n_detections, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM smp GROUP BY 1")
def detection_histogram(spark, sf):
    return rounded(stats.detection_histogram(samples(spark, sf), "detections").withColumn("n_detections", F.col("n_detections").cast("long")), "share")


@query(f"WITH {_SAMPLES} SELECT count(*) AS n, count_if(label IS NULL) AS no_identity, count_if(len(detections) > 1) AS several_detections, count_if(is_duplicate IS NULL) AS no_embedding FROM smp")
def quality_counts(spark, sf):
    return stats.quality_counts(samples(spark, sf), "label", "detections", "is_duplicate")


@query(f"WITH {_SAMPLES}, t AS (SELECT unnest(tags) AS tag, label FROM smp) SELECT tag, count(*) AS n_samples, count(DISTINCT label) AS n_identities FROM t GROUP BY tag")
def identities_per_tag(spark, sf):
    return stats.identities_per_tag(samples(spark, sf), "label")


@query("WITH g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT count(*) AS n_groups, round(avg(n), 6) AS mean, round(median(n), 6) AS median, min(n) AS least, max(n) AS most, round(stddev_pop(n), 6) AS std FROM g")
def identity_statistics(spark, sf):
    return rounded(stats.group_statistics(embedded(spark, sf), "label"), "mean", "median", "std")


@query("SELECT * FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_nationkey LIMIT 10) UNION ALL SELECT * FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 ORDER BY n, c_nationkey LIMIT 10)")
def extreme_identities(spark, sf):
    rows = table(spark, sf, "customer")
    return stats.extreme_groups(rows, "c_nationkey").unionAll(stats.extreme_groups(rows, "c_nationkey", largest=False))


@query(f"WITH {_V}, {_CLOSED}, p AS (SELECT label, count_if(closed_set_split = 'train') AS tr, count_if(closed_set_split = 'val') AS va, count_if(closed_set_split = 'test') AS te FROM c GROUP BY label), o AS (SELECT sum(tr + va + te)::BIGINT AS samples, count(*)::BIGINT AS identities, count_if(tr > 0)::BIGINT AS identities_train, count_if(va > 0)::BIGINT AS identities_val, count_if(te > 0)::BIGINT AS identities_test, count_if(va > 0 AND tr = 0)::BIGINT AS unseen_val, count_if(te > 0 AND tr = 0)::BIGINT AS unseen_test FROM p) SELECT measure, value FROM (UNPIVOT (SELECT COLUMNS(*)::BIGINT FROM o) ON COLUMNS(*) INTO NAME measure VALUE value)")
def curation_statistics(spark, sf):
    return stats.curation_statistics(_closed(spark, sf), "label", "closed_set_split")


@query("SELECT source AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def source_distribution(spark, sf):
    return rounded(stats.value_counts(table(spark, sf, "documents"), "source"), "share")


@query(f"WITH {_SAMPLES}, f AS (SELECT count(sample_id) AS sample_id, count(group_slice) AS group_slice, count(detections) AS detections, count(is_duplicate) AS is_duplicate, count(tags) AS tags, count(label) AS label FROM smp) SELECT 'slice:' || group_slice AS measure, count(*) AS value FROM smp GROUP BY 1 UNION ALL SELECT 'tag:' || t, count(*) FROM (SELECT unnest(tags) AS t FROM smp) GROUP BY 1 UNION ALL SELECT 'field:' || measure, value FROM (UNPIVOT f ON COLUMNS(*) INTO NAME measure VALUE value)")
def dataset_state(spark, sf):
    return stats.dataset_state(samples(spark, sf))


@query("SELECT o_orderpriority, first(n) FILTER (o_orderstatus = 'F') AS F, first(n) FILTER (o_orderstatus = 'O') AS O, first(n) FILTER (o_orderstatus = 'P') AS P FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderpriority")
def metric_sheet(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return stats.sheet(counts, "o_orderpriority", "o_orderstatus", "n", ["F", "O", "P"])


@query("SELECT * FROM (SELECT c_nationkey, max(c_acctbal) AS c_acctbal, arg_max(c_custkey, (c_acctbal, c_custkey)) AS c_custkey FROM customer GROUP BY 1 ORDER BY c_acctbal DESC, c_custkey DESC, c_nationkey LIMIT 9)")
def best_per_identity(spark, sf):
    return stats.best_per_group(table(spark, sf, "customer"), "c_nationkey", ["c_acctbal", "c_custkey"])


def _candidates(spark, sf):
    docs = table(spark, sf, "documents")
    d = F.col("doc_id")
    text_of = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    rows = docs.select(
        text_of("c", d).alias("candidate_id"),
        F.when(d % 3 == 0, "manifest").otherwise("export").alias("kind"),
        F.when(d % 7 > 0, text_of("i", F.floor(d / 3) % 40)).alias("identity"),
        text_of("f", F.floor(d / 3)).alias("filename"),
        F.when(d % 5 == 0, F.array(text_of("s", d % 333))).otherwise(F.array().cast("array<string>")).alias("source_ids"),
        F.when(d % 4 == 0, text_of("p", d % 250)).alias("source_path"),
        F.when(d % 6 == 1, text_of("r", d)).alias("relative_path"),
        F.array(text_of("f", F.floor(d / 3)), text_of("g", d)).alias("filenames"),
        F.col("lang").alias("camera"),
    )
    terminals = docs.select(
        d.alias("terminal_id"), F.when(d % 2 == 0, text_of("i", F.floor(d / 3) % 40)).alias("identity"), text_of("s", d % 400).alias("source_id"), text_of("p", d % 300).alias("source_path"), text_of("r", d).alias("relative_path"), F.when(d % 9 == 0, text_of("zz", d)).when(d % 2 == 0, text_of("g", d)).otherwise(text_of("f", F.floor(d / 3))).alias("filename")
    )
    return rows, terminals


@query(
    "WITH c AS (SELECT 'c' || doc_id AS cid, CASE WHEN doc_id % 3 = 0 THEN 'manifest' ELSE 'export' END AS kind, CASE WHEN doc_id % 7 > 0 THEN 'i' || ((doc_id // 3) % 40) END AS who, 'f' || (doc_id // 3) AS file, doc_id AS d, lang AS camera FROM documents), "
    "k AS (SELECT 0 AS l, 's' || (d % 333) AS key, cid, kind, who, file FROM c WHERE d % 5 = 0 UNION ALL SELECT 1, 'p' || (d % 250), cid, kind, who, file FROM c WHERE d % 4 = 0 UNION ALL SELECT 2, 'r' || d, cid, kind, who, file FROM c WHERE d % 6 = 1 UNION ALL SELECT 3, file, cid, kind, who, file FROM c UNION ALL SELECT 3, 'g' || d, cid, kind, who, file FROM c), "
    "g AS (SELECT l, key, count(*) AS n, min(cid) FILTER (kind = 'export') AS ex, min(cid) FILTER (kind = 'manifest') AS ma, min(who) AS who, min(file) AS file, count(*) = 1 OR coalesce(count(*) = 2 AND count(*) FILTER (kind = 'export') = 1 AND count(who) = 2 AND min(who) = max(who) AND min(file) = max(file), false) AS one FROM k GROUP BY l, key), "
    "m AS (SELECT who AS mw, file AS mf, min(cid) AS mid FROM c WHERE kind = 'manifest' AND who IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1), "
    "gg AS (SELECT l, key, one, who, ex, coalesce(ma, mid) AS ma FROM g LEFT JOIN m ON n = 1 AND ex IS NOT NULL AND who = mw AND file = mf), "
    "t AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'i' || ((doc_id // 3) % 40) END AS own, ['s' || (doc_id % 400), 'p' || (doc_id % 300), 'r' || doc_id, CASE WHEN doc_id % 9 = 0 THEN 'zz' || doc_id WHEN doc_id % 2 = 0 THEN 'g' || doc_id ELSE 'f' || (doc_id // 3) END] AS keys FROM documents), "
    "hit AS (SELECT id, own, arg_min({'one': one, 'who': gg.who, 'ex': ex, 'ma': ma}, l) AS b, min(l) AS l FROM t JOIN gg ON key = keys[l + 1] GROUP BY id, own), "
    "r AS (SELECT t.id, CASE WHEN hit.id IS NULL THEN 'missing' WHEN b.one AND (t.own IS NULL OR b.who IS NULL OR t.own = b.who) THEN 'matched' ELSE 'ambiguous' END AS st, l, b FROM t LEFT JOIN hit ON hit.id = t.id) "
    "SELECT r.id AS terminal_id, st AS lineage_status, CASE WHEN st = 'matched' THEN ['source_id', 'normalized_source_filepath', 'export_relative_filepath', 'unique_filename'][l + 1] END AS lineage_match_method, CASE WHEN st = 'matched' THEN coalesce(e.camera, n.camera) END AS camera FROM r LEFT JOIN c e ON e.cid = b.ex LEFT JOIN c n ON n.cid = b.ma"
)
def lineage_enrich(spark, sf):
    rows, terminals = _candidates(spark, sf)
    return lineage.enrich(terminals, rows, ["camera"]).select("terminal_id", "lineage_status", "lineage_match_method", "camera")


@query("SELECT 'S' || p_partkey AS sighting, p_partkey, trim(unnest(list_filter(string_split(replace(p_name || '.jpg, ' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand || '.mp4 and x' || p_size || '.avi' END, ' and ', ','), ','), lambda x: trim(x) <> ''))) AS file FROM part")
def sighting_split(spark, sf):
    part = table(spark, sf, "part")
    files = F.concat("p_name", F.lit(".jpg, "), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat("p_brand", F.lit(".mp4 and x"), F.col("p_size").cast("string"), F.lit(".avi"))))
    return clean.split_files(part.select("p_partkey", files.alias("file")), "file", "p_partkey", "sighting").select("sighting", "p_partkey", "file")


@query(
    "WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '?' WHEN c_custkey % 4 = 1 THEN NULL WHEN c_custkey % 50 = 2 THEN 'u' || c_custkey ELSE 'F' || c_custkey END AS who FROM customer), t AS (SELECT coalesce(max(try_cast(regexp_extract(who, '(?i)^\\s*U(\\d+)\\s*$', 1) AS BIGINT)), 0) AS top FROM x) "
    "SELECT c_custkey, CASE WHEN who IS NULL OR trim(who) IN ('', '?') THEN 'U' || ((SELECT top FROM t) + row_number() OVER (PARTITION BY who IS NULL OR trim(who) IN ('', '?') ORDER BY c_custkey)) ELSE who END AS who FROM x"
)
def fill_missing_identities(spark, sf):
    c = F.col("c_custkey")
    who = F.when(c % 4 == 0, "?").when(c % 4 == 1, None).when(c % 50 == 2, F.concat(F.lit("u"), c.cast("string"))).otherwise(F.concat(F.lit("F"), c.cast("string")))
    return clean.fill_unknown_identities(table(spark, sf, "customer").select("c_custkey", who.alias("who")), "who", "c_custkey")


@query(
    "WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) WHEN 2 THEN day(o_orderdate) || '-' || month(o_orderdate) || '-' || year(o_orderdate) WHEN 3 THEN ' ' || day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) || ' ' ELSE 'unknown' END AS s, CASE WHEN o_orderkey % 3 = 0 THEN '12:34:56' ELSE 'noon' END AS tm, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders) "
    "SELECT o_orderkey, day, CASE WHEN day <> '' AND tm <> 'noon' THEN day || ' ' || tm END AS at FROM x"
)
def date_clean(spark, sf):
    o, d = F.col("o_orderkey"), F.col("o_orderdate")
    form = lambda f: F.date_format(d, f)
    s = F.when(o % 5 == 0, form("yyyy-MM-dd")).when(o % 5 == 1, form("M/d/yyyy")).when(o % 5 == 2, form("d-M-yyyy")).when(o % 5 == 3, F.concat(F.lit(" "), form("d.M.yyyy"), F.lit(" "))).otherwise("unknown")
    rows = table(spark, sf, "orders").select("o_orderkey", s.alias("s"), F.when(o % 3 == 0, "12:34:56").otherwise("noon").alias("tm"))
    rows = rows.withColumn("day", text.clean_date(F.col("s")))
    return rows.select("o_orderkey", "day", text.clean_datetime(F.col("day"), F.col("tm")).alias("at"))


@query(
    "WITH x AS (SELECT p_partkey, (p_size % 12)::DOUBLE AS fps, p_partkey % 60 AS n FROM part), y AS (SELECT *, floor(fps)::BIGINT AS early, greatest(1, floor(fps / 2))::BIGINT AS i1, greatest(1, floor(fps / 0.5))::BIGINT AS i2 FROM x WHERE fps > 0 AND n > 0), f AS (SELECT p_partkey, unnest(list_concat(range(0, least(early, n), i1), range(early, n, i2))) AS source_frame FROM y) "
    "SELECT p_partkey AS sample_id, row_number() OVER (PARTITION BY p_partkey ORDER BY source_frame) - 1 AS frame_index, source_frame, printf('frames/v_%d/%06d.jpg', p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY source_frame) - 1) AS frame_path FROM f"
)
def frame_sampling(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"), F.lit("videos/v.mp4").alias("filepath"), (F.col("p_size") % 12).cast("double").alias("fps"), (F.col("p_partkey") % 60).alias("frame_count"))
    made = frames.sample_frames(p)
    return made.select("sample_id", F.col("frame_index").cast("long"), F.col("source_frame").cast("long"), "frame_path")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 2 THEN 'RIVER BEND' WHEN 3 THEN NULL ELSE 'SITE ' || s_nationkey END AS site, CASE s_suppkey % 5 WHEN 0 THEN 'CAM A' WHEN 1 THEN 'CAM B' WHEN 2 THEN 'CAM A' WHEN 3 THEN 'NORTH' END AS cam FROM supplier")
def site_cam_normalise(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    s = F.when(k % 4 == 0, F.concat(F.lit("  site 0"), n)).when(k % 4 == 1, F.concat(F.lit("Site"), n)).when(k % 4 == 2, " river  bend ").otherwise(" ")
    c = F.when(k % 5 == 0, "a").when(k % 5 == 1, "Cam-B 2").when(k % 5 == 2, "cam a").when(k % 5 == 3, "north").otherwise("")
    return table(spark, sf, "supplier").select("s_suppkey", text.site(s).alias("site"), text.camera(c).alias("cam"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS name, o_orderstatus AS sex, CASE WHEN day(o_orderdate) > 9 THEN right(year(o_orderdate)::VARCHAR, 2) || '-' || month(o_orderdate) || '-' || day(o_orderdate) || ',' ELSE '' END || year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) AS dates FROM orders")
def field_extract(spark, sf):
    o = F.col("o_orderkey")
    body = F.concat(F.lit("Sexo:  "), "o_orderstatus", F.when(o % 3 == 0, "").otherwise(F.concat(F.lit("\nNOME: "), F.regexp_replace("o_orderpriority", "-", "-"))), F.lit("\nData: "), F.date_format("o_orderdate", "yyyy-M-d"))
    rows = table(spark, sf, "orders").withColumn("body", body)
    found = lambda k: text.labelled_field(F.col("body"), k, [o for o in ("nome", "sexo", "data") if o != k])
    return rows.select("o_orderkey", found("nome").alias("name"), found("sexo").alias("sex"), F.array_join(text.dates_in(F.col("body")), ",").alias("dates"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'raw/a/' || c_custkey WHEN 1 THEN '/abs/' || c_custkey WHEN 2 THEN 'set/b' ELSE 'C:/x' END AS path FROM customer")
def path_compose(spark, sf):
    c, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    direct = F.when(c % 4 == 0, F.concat(F.lit("./a//"), n)).when(c % 4 == 1, F.concat(F.lit("/abs/x/../"), n)).when(c % 4 == 2, " ")
    file_path = F.when(c % 4 == 2, "q\\..\\b").when(c % 4 == 3, "C:\\x")
    return table(spark, sf, "customer").select("c_custkey", text.source_path(direct, file_path, F.lit("raw"), F.lit("set")).alias("path"))


@query(
    "WITH x AS (SELECT p_partkey, [0.1, 0.1, p_size / 40, CASE WHEN p_partkey % 6 = 0 THEN -0.1 ELSE 0.5 END] AS box, p_partkey % 9 = 0 AS review, CASE WHEN p_partkey % 18 = 0 THEN 'why' END AS reason, p_partkey % 5 = 0 AS nobox, CASE WHEN p_partkey % 10 = 3 THEN ' ' ELSE 'SITE' END AS site, CASE WHEN p_partkey % 7 = 0 THEN 'all' ELSE 'val' END AS split FROM part), "
    "e AS (SELECT p_partkey, unnest([CASE WHEN NOT nobox AND review THEN 'a row under review must have no annotations' END, CASE WHEN nobox AND NOT review THEN 'annotations are missing' END, CASE WHEN review AND reason IS NULL THEN 'review_reason is missing' END, CASE WHEN NOT nobox AND list_min(box) < 0 THEN 'bboxes_body[0]: box must not be negative' WHEN NOT nobox AND (box[1] + box[3] > 1 OR box[2] + box[4] > 1) THEN 'bboxes_body[0]: box must lie inside the image' END, CASE WHEN trim(site) = '' THEN 'site is blank' END, CASE WHEN split = 'all' THEN 'split is unknown' END]) AS error FROM x) SELECT p_partkey, error FROM e WHERE error IS NOT NULL"
)
def validation_errors(spark, sf):
    p = F.col("p_partkey")
    detection = F.array(F.struct(F.lit("d").alias("id"), F.lit("x").alias("label"), F.lit(0.9).alias("confidence"), F.array(F.lit(0.1), F.lit(0.1), F.col("p_size") / 40, F.when(p % 6 == 0, -0.1).otherwise(0.5)).alias("bounding_box")))
    review = p % 9 == 0
    rows = table(spark, sf, "part").select(
        "p_partkey", F.when(p % 5 > 0, detection).alias("bboxes_body"), F.when(p % 5 > 0, detection).alias("segmentations_body"), review.alias("review_required"), F.when(p % 18 == 0, "why").alias("review_reason"), F.when(review, "pending").alias("review_status"), F.when(review, F.array(F.lit("review_required"))).alias("tags"), F.when(p % 10 == 3, " ").otherwise("SITE").alias("site"), F.when(p % 7 == 0, "all").otherwise("val").alias("split")
    )
    return validate.error_rows(rows, "p_partkey", [*validate.annotation_rules(), *validate.enrichment_rules(["site"], ["split"], [])])


@query(f"WITH {_C}, g AS (SELECT sha256, count(*) AS n FROM c GROUP BY 1 HAVING count(*) > 1) SELECT path, 'content occurs ' || n || ' times' AS error FROM c JOIN g USING (sha256)")
def unique_hash_errors(spark, sf):
    return validate.unique_errors(_contents(spark, sf), "path", "sha256", "content")


@query(
    "WITH r AS (SELECT event_id AS run_id, event_type || '_' || (user_id % 3) AS name, ['user:' || (user_id % 20), 'dataset:' || (event_id % 4)] AS tags, ts FROM events), x AS (SELECT 'loss_click_' || (user_id % 3) || '_' || user_id AS e, user_id, 'click' || (user_id % 3) AS short FROM (SELECT DISTINCT user_id FROM events WHERE user_id < 20)), "
    "m AS (SELECT e, run_id, NOT list_contains(tags, 'dataset:1') AS relaxed, CASE WHEN regexp_replace(name, '[^a-z0-9]', '', 'g') = short || user_id THEN 0 WHEN contains(short || user_id, regexp_replace(name, '[^a-z0-9]', '', 'g')) OR contains(regexp_replace(name, '[^a-z0-9]', '', 'g'), short || user_id) OR contains('loss' || short || user_id, regexp_replace(name, '[^a-z0-9]', '', 'g')) OR contains(regexp_replace(name, '[^a-z0-9]', '', 'g'), 'loss' || short || user_id) THEN 1 ELSE 2 END AS nm, ts FROM x JOIN r ON list_contains(tags, 'user:' || user_id)) "
    "SELECT e AS experiment, arg_min(run_id, (relaxed, nm, -epoch_us(ts), run_id)) AS run_id, arg_min(relaxed, (relaxed, nm, -epoch_us(ts), run_id)) AS relaxed FROM m GROUP BY e"
)
def latest_run_metrics(spark, sf):
    ev = table(spark, sf, "events")
    u = F.col("user_id")
    runs = ev.select(F.col("event_id").alias("run_id"), F.concat("event_type", F.lit("_"), (u % 3).cast("string")).alias("name"), F.array(F.concat(F.lit("user:"), (u % 20).cast("string")), F.concat(F.lit("dataset:"), (F.col("event_id") % 4).cast("string"))).alias("tags"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"))
    wanted = ev.where("user_id < 20").select("user_id").distinct().select(F.concat(F.lit("loss_click_"), (u % 3).cast("string"), F.lit("_"), u.cast("string")).alias("experiment"), F.array(F.concat(F.lit("user:"), u.cast("string")), F.lit("dataset:1")).alias("required_tags"))
    return experiments.latest_runs(wanted, runs)


@query("WITH a AS (SELECT c_mktsegment AS k, avg(c_acctbal) AS m FROM customer WHERE c_nationkey < 12 GROUP BY 1), b AS (SELECT c_mktsegment AS k, avg(c_acctbal) AS m FROM customer WHERE c_nationkey >= 12 GROUP BY 1) SELECT k AS experiment, round(a.m, 6) AS map_left, round(b.m, 6) AS map_right, round(b.m - a.m, 6) AS map_difference FROM a FULL JOIN b USING (k)")
def result_comparison(spark, sf):
    c = table(spark, sf, "customer")
    side = lambda rows: rows.groupBy(F.col("c_mktsegment").alias("experiment")).agg(F.avg("c_acctbal").alias("map"))
    return rounded(experiments.compare(side(c.where("c_nationkey < 12")), side(c.where("c_nationkey >= 12")), "experiment", ["map"]), "map_left", "map_right", "map_difference")


@query("SELECT m::DOUBLE AS margin, s AS scale FROM (VALUES (0.2), (0.3), (0.5)) a(m), (VALUES (16), (30), (64)) b(s)")
def experiment_grid(spark, sf):
    return experiments.grid(spark, margin=[0.2, 0.3, 0.5], scale=[16, 30, 64]).withColumn("scale", F.col("scale").cast("int"))


@query("WITH x AS (SELECT event_id, 'k' || (event_id % 700) AS path, 'h' || (event_id % 900) AS sha1 FROM events WHERE event_id % 3 > 0), old AS (SELECT 'k' || (event_id % 350) AS path, 'h' || (event_id % 80) AS sha1 FROM events WHERE event_id % 3 = 0), n AS (SELECT * FROM x WHERE path NOT IN (SELECT path FROM old) AND sha1 NOT IN (SELECT sha1 FROM old)), p AS (SELECT * FROM n QUALIFY event_id = min(event_id) OVER (PARTITION BY path)) SELECT event_id FROM p QUALIFY event_id = min(event_id) OVER (PARTITION BY sha1)")
def idempotent_append(spark, sf):
    e, n = table(spark, sf, "events"), F.col("event_id")
    key = lambda p, m: F.concat(F.lit(p), (n % m).cast("string"))
    old = e.where("event_id % 3 = 0").select(key("k", 350).alias("path"), key("h", 80).alias("sha1"))
    new = e.where("event_id % 3 > 0").select("event_id", key("k", 700).alias("path"), key("h", 900).alias("sha1"))
    return match.append_new(old, new, ["path", "sha1"], "event_id").select("event_id")


def _listing(spark, sf):
    part = table(spark, sf, "part")
    return part.select(F.concat(F.lit("SITE "), (F.col("p_size") % 9).cast("string"), F.lit("/CAM "), F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("B"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".mp4").otherwise(".jpg")).alias("path"))


@query("WITH l AS (SELECT 'SITE ' || (p_size % 9) || '/CAM ' || CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.mp4' ELSE '.jpg' END AS path, p_partkey FROM part) SELECT path FROM l WHERE path LIKE '%.mp4' AND path NOT IN (SELECT path FROM l WHERE p_partkey % 4 = 0)")
def unlabelled_videos(spark, sf):
    listing = _listing(spark, sf)
    labelled = listing.where(F.regexp_extract("path", r"_(\d+)\.", 1).cast("int") % 4 == 0)
    return match.unlabelled(listing, labelled.withColumnRenamed("path", "file"), "file")


@query()
def fuzzy_best_match(spark, sf):
    part = table(spark, sf, "part")
    target = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".mp4").otherwise(".jpg"))
    missing = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("row_id"), target.alias("target"), F.concat(F.lit("SITE "), (F.col("p_size") % 9).cast("string")).alias("site"), F.when(F.col("p_partkey") % 2 == 0, "CAM A").otherwise("CAM B").alias("cam"))
    return match.match_missing(missing, _listing(spark, sf), 0.95, 0.80)


@query(f"WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, g) AS rank FROM s WHERE q % 50 = 0) SELECT q AS query, rank, g AS id, round(s, 6) AS similarity FROM r WHERE rank <= 10")
def nearest_neighbours(spark, sf):
    rows = embedded(spark, sf)
    found = inference.top_k(rows.where("id % 50 = 0"), rows, 10)
    return rounded(found.withColumn("rank", F.col("rank").cast("long")), "similarity")


#: The index's rule in SQL: centres drawn by a hash, each row in two cells, each query in twenty.
_INDEX = _V + ", z AS MATERIALIZED (SELECT id, list_transform(v, lambda x: x / (n + 1e-12)) AS z FROM u), c AS MATERIALIZED (SELECT z AS centre, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS cell FROM z QUALIFY cell < (SELECT ceil(sqrt(count(*))) FROM z)), a AS MATERIALIZED (SELECT id, cell, row_number() OVER (PARTITION BY id ORDER BY round(list_dot_product(z, centre), 12) DESC, cell) AS place FROM z, c), m AS MATERIALIZED (SELECT q.id AS q, r.id AS g FROM a q JOIN a r ON q.cell = r.cell AND q.place <= 20 AND r.place <= 2 AND q.id % 50 = 0), f AS MATERIALIZED (SELECT q, g, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, g) AS rank FROM (SELECT DISTINCT q, g FROM m WHERE q <> g) d JOIN (SELECT q, g, s FROM s) e USING (q, g))"
_INDEX = _INDEX.replace(", z AS", _S.removeprefix(_V) + ", z AS", 1)


def _searched(spark, sf):
    rows = embedded(spark, sf)
    index = similarity_index.build(rows)
    queries = rows.where("id % 50 = 0")
    return index, queries, rows


@query(f"WITH {_INDEX} SELECT q AS query, rank, g AS id, round(s, 6) AS similarity FROM f WHERE rank <= 10")
def index_neighbours(spark, sf):
    index, queries, _ = _searched(spark, sf)
    return rounded(similarity_index.search(index, queries, 10).withColumn("rank", F.col("rank").cast("long")), "similarity")


@query(f"WITH {_INDEX}, x AS (SELECT q, g, row_number() OVER (PARTITION BY q ORDER BY s DESC, g) AS rank FROM s WHERE q % 50 = 0) SELECT count(DISTINCT x.q) AS n_queries, round(avg((f.q IS NOT NULL)::INT), 6) AS recall, round((SELECT count(*) FROM m) / (SELECT count(*) FROM u WHERE id % 50 = 0), 6) AS mean_compared FROM x LEFT JOIN (SELECT q, g FROM f WHERE rank <= 10) f ON x.q = f.q AND x.g = f.g WHERE x.rank <= 10")
def index_recall(spark, sf):
    index, queries, rows = _searched(spark, sf)
    quality = similarity_index.recall(similarity_index.search(index, queries, 10), inference.top_k(queries, rows, 10))
    mean = similarity_index.compared(index, queries).agg(F.avg("n").alias("mean_compared"))
    return rounded(quality.crossJoin(mean), "recall", "mean_compared")  # one row each


@query(f"WITH {_LOGITS} SELECT count(*) AS n, round(100 * avg((list_position(z, list_max(z)) - 1 = y)::INT), 6) AS accuracy FROM x")
def classification_accuracy(spark, sf):
    return rounded(inference.accuracy(_logits(spark, sf), "z", "y"), "accuracy")


@query("WITH r AS (SELECT 'f' || (event_id % 1500) AS filepath, value, event_id FROM events), l AS (SELECT filepath, arg_max(value, event_id) AS value FROM r GROUP BY 1) SELECT 'f' || c_custkey AS filepath, value AS prediction FROM customer LEFT JOIN l ON filepath = 'f' || c_custkey")
def export_predictions(spark, sf):
    results = table(spark, sf, "events").select(F.concat(F.lit("f"), (F.col("event_id") % 1500).cast("string")).alias("filepath"), "value", "event_id")
    rows = table(spark, sf, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("filepath"))
    return records.export_results(rows, results, "prediction", "event_id")[0]


@query(f"WITH {_C} SELECT path AS filepath, identity AS jaguar_id, quality IS NULL AS review_required, CASE WHEN quality IS NULL THEN 'missing' ELSE 'matched' END AS lineage_status, sha256, source AS site, doc_id / 1000.0::DOUBLE AS latitude FROM c")
def snapshot_rows(spark, sf):
    rows = _contents(spark, sf).withColumns({"filepath": F.col("path"), "review_required": F.col("quality").isNull(), "lineage_status": F.when(F.col("quality").isNull(), "missing").otherwise("matched"), "site": F.col("source"), "latitude": (F.col("doc_id") / 1000).cast("string")})
    return snapshot.snapshot_rows(rows, "identity").select("filepath", "jaguar_id", "review_required", "lineage_status", "sha256", "site", "latitude")


_VIEWS = "vw AS (SELECT doc_id, quality IS NULL AS review_required, CASE WHEN toxic = 1 THEN 'ambiguous' ELSE 'matched' END AS lineage_status, ['train', 'val', 'test'][doc_id % 3 + 1] AS c, ['train', 'val', 'test'][doc_id % 5 % 3 + 1] AS o FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"WITH {_VIEWS} SELECT 'all' AS view, count(*) AS n FROM vw UNION ALL SELECT 'lineage_unresolved', count_if(lineage_status <> 'matched') FROM vw UNION ALL SELECT 'review_required', count_if(review_required) FROM vw UNION ALL SELECT 'closed_set_' || c, count(*) FROM vw GROUP BY 1 UNION ALL SELECT 'open_set_' || o, count(*) FROM vw GROUP BY 1")
def saved_views(spark, sf):
    part = lambda i: F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (i + 1).cast("int"))
    d = F.col("doc_id")
    rows = _contents(spark, sf).select(d, F.col("quality").isNull().alias("review_required"), F.when(F.col("toxic") == 1, "ambiguous").otherwise("matched").alias("lineage_status"), part(d % 3).alias("closed_set_split"), part(d % 5 % 3).alias("open_set_split"))
    return stats.view_counts(rows)
