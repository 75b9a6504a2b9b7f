"""Incremental ingestion: rows that arrive once more are not appended again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldbook.operators.match import append_new
from fieldbook.plans.publish import exists

#: Keys of a batch that are looked up by their values, as the filter is a chain of so many; more are joined.
LOOKED_UP = 400


def _hashed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(hash, kind, key): all keys of ``rows`` that aren't null."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in keys])).alias("k")
    return rows.select(each).select("k.*").where("key IS NOT NULL").distinct().select(F.xxhash64("kind", "key").alias("hash"), "kind", "key")


def known_keys(batch: DataFrame, target: str, keys: list[str], number: int) -> DataFrame:
    """Those keys of ``batch`` that earlier batches stored, each in its own column.

    The key table has Bloom filters and is ordered by hash within its files, so a
    look-up of a small batch reads the parts of it that may hold a key. A batch of
    more than ``LOOKED_UP`` keys reads all hashes and keys; neither reads the target.
    """
    spark = batch.sparkSession
    if not exists(spark, f"{target}-keys"):
        return batch.select(*[F.col(k).cast("string").alias(k) for k in keys]).limit(0)
    wanted = _hashed(batch, keys)
    stored = spark.read.parquet(f"{target}-keys").where(F.col("batch") != number)
    values = [r["hash"] for r in wanted.select("hash").distinct().limit(LOOKED_UP + 1).collect()]
    if len(values) <= LOOKED_UP:
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(LOOKED_UP))
        stored = stored.where(F.col("hash").isin(values))
    met = stored.join(wanted, ["hash", "kind", "key"], "left_semi")
    return met.select(*[F.when(F.col("kind") == k, F.col("key")).alias(k) for k in keys])


def append_stream(stream: DataFrame, target: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's new rows to the Parquet table at ``target``; a batch that is replayed writes to its own folder again.

    A row is new if none of its keys is stored, see
    :func:`fieldbook.operators.match.append_new`. Stored keys stand in a table
    beside the target. The batch number is a partition of both, and writing
    overwrites that partition alone, so a replay after a failure doesn't double
    rows.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = append_new(known_keys(batch, target, keys, number), batch, keys, order)
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")
        stored = batch.sparkSession.read.schema(batch.schema).parquet(f"{target}/batch={number}")
        made = _hashed(stored, keys).repartitionByRange("hash").sortWithinPartitions("hash")
        made.write.mode("overwrite").option("parquet.bloom.filter.enabled#hash", "true").parquet(f"{target}-keys/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
