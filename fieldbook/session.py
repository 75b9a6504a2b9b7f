"""Session helpers: where shared scratch data lives, and how lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder for checkpoints and scratch tables that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and everything runs in one process (tests) a temporary folder is made and
    registered; a cluster without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-fieldbook-"))
        known = context.getCheckpointDir()
    return known.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_root`; never reused, so reruns cannot read stale parts."""
    return f"{shared_root(spark)}/fieldbook/{name}-{uuid.uuid4().hex}"


def materialize(frame: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``frame`` to a scratch table and read it back.

    Unlike a cache or a local checkpoint the table outlives any executor, and
    unlike ``checkpoint()`` it is columnar and compressed.
    """
    path = path or scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
