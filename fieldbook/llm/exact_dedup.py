"""Exact deduplication with streaming state (operator 9).

A stream of content digests feeds a keyed aggregation whose state lives in
RocksDB on disk and never expires. For each digest the state retains the stable
identifier and the content locator (file and row) of the document that stays,
and how many documents arrived. Digests seen more than once are hits; for hits
the whole normalised texts are compared, and documents whose digest agrees but
whose bytes do not are regrouped by their text. Only DataFrame functions run:
the stream, the state, and the comparison all stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm.common import SPACE, located
from fieldbook.session import materialize, scratch_path

#: State on disk; without preallocated files, which would cost each small state partition several megabytes.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

#: Hit digests are broadcast up to this many rows (about 100 bytes each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 300_000


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _preference(doc_id: Column, n_points: Column, locator: Column) -> Column:
    """Least for the document that stays: most code points, then smallest identifier (null last), then first place."""
    return F.struct((-n_points).alias("shorter"), doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), locator.alias("locator"))


def keyed_state(spark: SparkSession, digests: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Run the stateful stream over the digest table at path ``digests``; read back its state.

    Returns (digest, stays: struct, group_size). Without a watermark the state
    never expires. Spark's commit log and state snapshots are in the shared
    scratch folder, so a lost executor costs a replay of its partitions only.
    """
    before, checkpoint = {k: spark.conf.get(k, None) for k in _STATE}, scratch_path(spark, "dedup-state")
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    state = reader.parquet(digests).groupBy("digest").agg(F.min(_preference(F.col("doc_id"), F.col("n_points"), F.col("locator"))).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        stored = spark.read.format("statestore").load(checkpoint)
        kept, count = stored.schema["value"].dataType.names[:2]
        return stored.select(F.col("key.digest").alias("digest"), F.col("value")[kept].alias("stays"), F.col("value")[count].alias("group_size"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """One row per input row: doc_id, locator, digest, keep_id, keep_locator, group_size, kept.

    Texts are equal when identical without ASCII white space; null counts as
    empty, so null, empty and blank texts form one group. Of a group the row
    with the most code points stays, then the smallest identifier (null last),
    then, for rows repeated whole, the first place. An empty table gives an
    empty result. Texts of any length are compared whole. Other columns are not
    looked at.
    """
    with_rows, locator = located(docs)
    return _dedup(with_rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(locator).alias("locator")), digest, files_per_batch)


def _dedup(rows: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """:func:`exact_dedup` over (doc_id, text, locator)."""
    spark = rows.sparkSession
    norm = normalised(F.col("text"))
    path = scratch_path(spark, "dedup-digests")
    digests = materialize(rows.select("doc_id", digest(norm).alias("digest"), F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"), "locator"), "dedup-digests", path)
    groups = materialize(keyed_state(spark, path, digests.schema, files_per_batch), "dedup-groups")
    hits = groups.where("group_size > 1").select("digest")
    members = digests.join(groups, "digest").select("doc_id", "locator", "digest", F.col("stays.doc_id").alias("keep_id"), F.col("stays.locator").alias("keep_locator"), "group_size")

    few = hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = rows.select("doc_id", "locator", "text", norm.alias("norm"), digest(norm).alias("digest"))
    if few:
        texts = texts.join(F.broadcast(hits), "digest", "left_semi")
    else:
        at = digests.join(hits, "digest", "left_semi").select("locator")
        texts = rows.join(at, "locator", "left_semi").select("doc_id", "locator", "text", norm.alias("norm"), digest(norm).alias("digest"))
    # The least and the greatest text of a digest are equal only if all are; partial aggregation keeps hot groups in their tasks.
    unlike = materialize(texts.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest")).where("least <> greatest").select("digest"), "dedup-unlike")
    if not unlike.isEmpty():
        mixed = texts.join(unlike, "digest", "left_semi")
        stays = mixed.groupBy("digest", "norm").agg(F.min(_preference(F.col("doc_id"), F.char_length(F.coalesce("text", F.lit(""))), F.col("locator"))).alias("stays"), F.count(F.lit(1)).alias("group_size"))
        again = mixed.join(stays, ["digest", "norm"]).select("doc_id", "locator", "digest", F.col("stays.doc_id").alias("keep_id"), F.col("stays.locator").alias("keep_locator"), "group_size")
        members = members.join(unlike, "digest", "left_anti").select(*again.columns).unionByName(again)
    return members.withColumn("kept", F.col("locator") == F.col("keep_locator"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops, columns unchanged.

    Of null, empty and blank texts one row stays; ties are settled as there. An
    empty table stays empty; columns of any name are kept.
    """
    with_rows, locator = located(docs)
    rows = with_rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(locator).alias("locator"))
    dropped = materialize(_dedup(rows).where("NOT kept").select(F.col("locator").alias(locator)), "dedup-dropped")
    if dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return with_rows.join(dropped, locator, "left_anti").select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
