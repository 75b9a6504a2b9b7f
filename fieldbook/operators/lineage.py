"""Lineage: enrich terminal records from candidates by the first key that finds any.

Keys are tried in order. A level with candidates decides: exactly one logical
candidate with a compatible identity is a match, anything else is ambiguous, and
later levels are not tried. Candidates are counted by their own id, so equal
rows stay two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.text import identities_compatible

LEVELS = ("source_id", "normalized_source_filepath", "export_relative_filepath", "unique_filename")


def candidate_keys(candidates: DataFrame) -> DataFrame:
    """(level, key, candidate_id, kind, identity, filename): every key of every candidate once.

    ``candidates``: candidate_id, kind (export or manifest), identity, filename,
    source_ids (array), source_path, relative_path, filenames (array).
    """
    keyed = F.array(
        F.transform("source_ids", lambda x: F.struct(F.lit(LEVELS[0]).alias("level"), x.alias("key"))),
        F.array(F.struct(F.lit(LEVELS[1]).alias("level"), F.col("source_path").alias("key"))),
        F.array(F.struct(F.lit(LEVELS[2]).alias("level"), F.col("relative_path").alias("key"))),
        F.transform("filenames", lambda x: F.struct(F.lit(LEVELS[3]).alias("level"), x.alias("key"))),
    )
    rows = candidates.select("candidate_id", "kind", "identity", "filename", F.explode(F.array_distinct(F.flatten(F.transform(keyed, lambda x: F.coalesce(x, F.array().cast("array<struct<level:string,key:string>>")))))).alias("k"))
    return rows.select("k.level", "k.key", "candidate_id", "kind", "identity", "filename").where("key IS NOT NULL AND key <> ''")


def logical_candidates(candidates: DataFrame) -> DataFrame:
    """(level, key, n, export_id, manifest_id, identity): how many candidates a key has, and the one they amount to, if one.

    An export and a manifest row of equal identity and file name are one
    candidate; so is a lone export with exactly one such manifest elsewhere.
    """
    keys = candidate_keys(candidates)
    of = lambda kind, c: F.min(F.when(F.col("kind") == kind, F.col(c)))
    groups = keys.groupBy("level", "key").agg(
        F.count_distinct("candidate_id").alias("n"),
        F.count_distinct(F.when(F.col("kind") == "export", F.col("candidate_id"))).alias("exports"),
        of("export", "candidate_id").alias("export_id"),
        of("manifest", "candidate_id").alias("manifest_id"),
        F.min("identity").alias("i0"),
        F.max("identity").alias("i1"),
        F.count("identity").alias("identified"),
        F.min("filename").alias("f0"),
        F.max("filename").alias("f1"),
        F.count("filename").alias("named"),
    )
    merged = (F.col("n") == 2) & (F.col("exports") == 1) & (F.col("identified") == 2) & (F.col("named") == 2) & (F.col("i0") == F.col("i1")) & (F.col("f0") == F.col("f1"))
    one = (F.col("n") == 1) | merged
    groups = groups.select("level", "key", "n", F.coalesce(one, F.lit(False)).alias("one"), "export_id", "manifest_id", F.col("i0").alias("identity"), F.col("f0").alias("filename"))
    manifests = candidates.where("kind = 'manifest' AND identity IS NOT NULL AND filename IS NOT NULL").groupBy(F.col("identity").alias("mi"), F.col("filename").alias("mf")).agg(F.count(F.lit(1)).alias("mn"), F.min("candidate_id").alias("mid"))
    lone = (F.col("n") == 1) & F.col("export_id").isNotNull() & (F.col("identity") == F.col("mi")) & (F.col("filename") == F.col("mf")) & (F.col("mn") == 1)
    return groups.join(manifests, lone, "left").withColumn("manifest_id", F.coalesce("manifest_id", "mid")).select("level", "key", "n", "one", "export_id", "manifest_id", "identity")


def enrich(terminals: DataFrame, candidates: DataFrame, fields: list[str]) -> DataFrame:
    """``terminals`` with lineage_status, lineage_match_method and ``fields``, export before manifest; empty unless matched.

    ``terminals``: terminal_id, identity, source_id, source_path, relative_path, filename.
    """
    logical = logical_candidates(candidates)
    rows = terminals
    for i, (level, column) in enumerate(zip(LEVELS, ("source_id", "source_path", "relative_path", "filename"), strict=True)):
        at = logical.where(F.col("level") == level).select(F.col("key").alias(f"__k{i}"), F.struct("n", "one", "export_id", "manifest_id", F.col("identity").alias("who")).alias(f"__l{i}"))
        rows = rows.join(at, F.col(column) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    method = F.coalesce(*[F.when(F.col(f"__l{i}").isNotNull(), F.lit(level)) for i, level in enumerate(LEVELS)])
    found = F.coalesce(*[F.col(f"__l{i}") for i in range(len(LEVELS))])
    rows = rows.withColumns({"__method": method, "__found": found}).drop(*[f"__l{i}" for i in range(len(LEVELS))])
    good = F.col("__found.one") & identities_compatible(F.col("identity"), F.col("__found.who"))
    rows = rows.withColumn("lineage_status", F.when(F.col("__found").isNull(), "missing").when(F.coalesce(good, F.lit(False)), "matched").otherwise("ambiguous"))
    rows = rows.withColumn("lineage_match_method", F.when(F.col("lineage_status") == "matched", F.col("__method")))
    for kind in ("export", "manifest"):
        side = candidates.select(F.col("candidate_id").alias(f"__{kind}"), *[F.col(f).alias(f"__{kind}_{f}") for f in fields])
        rows = rows.withColumn(f"__{kind}_at", F.when(F.col("lineage_status") == "matched", F.col(f"__found.{kind}_id"))).join(side, F.col(f"__{kind}_at") == F.col(f"__{kind}"), "left")
    filled = [F.coalesce(f"__export_{f}", f"__manifest_{f}").alias(f"lineage_{f}" if f in terminals.columns else f) for f in fields]
    return rows.select(*terminals.columns, "lineage_status", "lineage_match_method", *filled)


def resolved_identity(own, status, other):
    """The terminal's identity, else the lineage's if matched and not blank."""
    return F.coalesce(own, F.when(status == "matched", F.nullif(F.trim(other), F.lit(""))))
