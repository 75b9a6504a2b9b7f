"""Enrichment by several models that resumes: what is stored and current is skipped, what failed is tried again.

Results are appended, a folder for each slice of a run, so a run that is killed
loses only the slice that it was at. A slice is read, each payload once, by all
models that want it. Reading takes the latest result of each row and model and
puts models side by side.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.operators.inference import settled
from fieldbook.operators.vectors import checksum
from fieldbook.plans.publish import exists

_SCHEMA = "id string, model string, revision string, embedding array<float>, error string, checksum string, made string"


def results(spark: SparkSession, target: str) -> DataFrame:
    """The latest result (id, model, revision, embedding, error, checksum, made) of each row and model stored at ``target``; empty if there is nothing."""
    if not exists(spark, f"{target}/results"):
        return spark.createDataFrame([], _SCHEMA)
    stored = spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{target}/results")
    latest = F.max_by(F.struct("revision", "embedding", "error", "checksum", "made"), "made").alias("r")
    return stored.groupBy("id", "model").agg(latest).select("id", "model", "r.*")


def plan(rows: DataFrame, stored: DataFrame, models: dict[str, str], overwrite: bool = False) -> DataFrame:
    """(id, model, action) for every row and model (name to revision): ``compute``, ``skip`` what is current, ``conflict`` what has another revision and may not be replaced.

    A result whose checksum doesn't fit its embedding counts as another's.
    """
    named = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(m), F.lit(r)) for m, r in models.items()]))).alias("model", "wanted")
    asked = rows.select(F.col("id").cast("string").alias("id"), named)
    known = stored.where("embedding IS NOT NULL").select("id", "model", "revision", "checksum", "embedding")
    whole = F.coalesce((F.col("revision") == F.col("wanted")) & (F.col("checksum") == checksum(F.col("embedding"))), F.lit(False))
    action = F.when(F.col("embedding").isNull(), "compute").when(whole, "skip").when(F.lit(overwrite), "compute").otherwise("conflict")
    return asked.join(known, ["id", "model"], "left").select("id", "model", action.alias("action"))


def enrich(rows: DataFrame, models: dict[str, tuple[str, Callable[[], Callable[[list], list]]]], target: str, payload: str = "payload", overwrite: bool = False, slices: int = 8, batch: int = 32, on_error: str = "keep", after_slice: Callable[[int], None] | None = None) -> dict[str, int]:
    """Run ``models`` (name to revision and loader) on (id, payload) and append what is not stored yet at ``target``; how many were skipped, computed, in conflict.

    ``on_error``: ``keep`` stores the error, and the next run tries again;
    ``raise`` ends the run after the slice. Conflicts are never touched.
    ``after_slice`` is told each slice that is stored.
    """
    if on_error not in ("keep", "raise"):
        raise ValueError(f"unknown policy {on_error}")
    spark = rows.sparkSession
    made = datetime.now(UTC).isoformat(timespec="microseconds")
    run = f"{target}/results/run-{uuid.uuid4().hex}"
    actions = plan(rows, results(spark, target), {m: r for m, (r, _) in models.items()}, overwrite)
    # The plan is part of the run: it must not change while results are appended.
    actions.write.parquet(f"{target}/plans/{run.rsplit('/', 1)[-1]}")
    actions = spark.read.schema(actions.schema).parquet(f"{target}/plans/{run.rsplit('/', 1)[-1]}")
    counts = {"skip": 0, "compute": 0, "conflict": 0} | {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = actions.where("action = 'compute'").groupBy("id").agg(F.collect_set("model").alias("models"))  # as many as there are models
    work = rows.select(F.col("id").cast("string").alias("id"), F.col(payload).alias("payload")).join(wanted, "id")
    revisions = F.create_map(*[F.lit(x) for m, (r, _) in models.items() for x in (m, r)])

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Callable] = {}
        for frame in batches:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                for name, (_, load) in models.items():
                    asked = part[part["models"].map(lambda m, name=name: name in m)]
                    if asked.empty:
                        continue
                    model = loaded[name] = loaded.get(name) or load()
                    found = settled(model, asked["payload"])
                    yield pd.DataFrame({"id": asked["id"].to_numpy(), "model": name, "embedding": [None if v is None else np.asarray(v, "<f4") for v, _ in found], "error": [e for _, e in found]})

    for k in range(slices if counts["compute"] else 0):
        some = work.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == k)
        told = some.mapInPandas(infer, "id string, model string, embedding array<float>, error string")
        told = told.select("id", "model", F.element_at(revisions, F.col("model")).alias("revision"), "embedding", "error", checksum(F.col("embedding")).alias("checksum"), F.lit(made).alias("made"))
        told.write.parquet(f"{run}/slice-{k}")
        if after_slice:
            after_slice(k)
        if on_error == "raise" and (bad := spark.read.schema(_SCHEMA).parquet(f"{run}/slice-{k}").where("error IS NOT NULL").first()):
            raise RuntimeError(f"{bad['model']} failed on {bad['id']}: {bad['error']}")
    return counts


def enriched(rows: DataFrame, target: str, models: list[str]) -> DataFrame:
    """``rows`` with the stored embedding of each model as a column of its name; null where there is none."""
    stored = results(rows.sparkSession, target).where("embedding IS NOT NULL")
    side: list[Column] = [F.first(F.when(F.col("model") == m, F.col("embedding")), ignorenulls=True).alias(m) for m in models]
    beside = stored.groupBy(F.col("id").alias("__id")).agg(*side)
    return rows.join(beside, F.col("id").cast("string") == F.col("__id"), "left").drop("__id")
