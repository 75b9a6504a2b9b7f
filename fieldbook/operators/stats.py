"""Counts and statistics of datasets, each in one pass where it can be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of a column; null is a value."""
    counts = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts)


def with_share(counts: DataFrame) -> DataFrame:
    """``counts`` with each row's share of the sum of ``n``, which is one row and broadcast."""
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__total")).drop("__total")


def field_population(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n): how many rows have each field."""
    one = rows.agg(*[F.count(c).alias(c) for c in fields])
    return one.unpivot([], fields, "field", "n")


def group_statistics(rows: DataFrame, key: str) -> DataFrame:
    """One row over the sizes of the non-null groups: n_groups, mean, median, least, most, population deviation."""
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_groups"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.min("n").alias("least"), F.max("n").alias("most"), F.stddev_pop("n").alias("std"))


def extreme_groups(rows: DataFrame, key: str, n: int = 10, largest: bool = True) -> DataFrame:
    """The ``n`` largest (or smallest) groups, ties by key."""
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.orderBy(F.col("n").desc() if largest else F.col("n"), key).limit(n)


def identities_per_tag(rows: DataFrame, identity: str, tags: str = "tags") -> DataFrame:
    return rows.select(F.explode(tags).alias("tag"), F.col(identity).alias("who")).groupBy("tag").agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct("who").alias("n_identities"))


def duplicate_rates(rows: DataFrame) -> DataFrame:
    """One row: rows, duplicates, their share, and their similarity's mean, least and most."""
    d = F.col("is_duplicate")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(d).alias("n_duplicates"), (F.count_if(d) / F.count(F.lit(1))).alias("rate"), F.avg(F.when(d, F.col("duplicate_similarity"))).alias("mean_similarity"), F.min(F.when(d, F.col("duplicate_similarity"))).alias("least_similarity"), F.max(F.when(d, F.col("duplicate_similarity"))).alias("most_similarity"))


def detection_histogram(rows: DataFrame, field: str) -> DataFrame:
    """(n_detections, n, share): samples by number of detections, null counted as none."""
    counted = rows.withColumn("n_detections", F.when(F.col(field).isNull(), 0).otherwise(F.size(field)))
    return with_share(counted.groupBy("n_detections").agg(F.count(F.lit(1)).alias("n")))


def quality_counts(rows: DataFrame, identity: str, field: str, embedding: str) -> DataFrame:
    """One row: samples, without identity, with several detections, without embedding."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(identity).isNull()).alias("no_identity"), F.count_if(F.size(field) > 1).alias("several_detections"), F.count_if(F.col(embedding).isNull()).alias("no_embedding"))


def curation_statistics(rows: DataFrame, identity: str, split: str) -> DataFrame:
    """(measure, value): samples and identities by split, and identities of val and test that train lacks."""
    who = rows.where(F.col(identity).isNotNull())
    per = who.groupBy(identity).agg(*[F.count_if(F.col(split) == p).alias(p) for p in ("train", "val", "test")])
    one = per.agg(
        F.sum(F.col("train") + F.col("val") + F.col("test")).alias("samples"),
        F.count(F.lit(1)).alias("identities"),
        *[F.count_if(F.col(p) > 0).alias(f"identities_{p}") for p in ("train", "val", "test")],
        *[F.count_if((F.col(p) > 0) & (F.col("train") == 0)).alias(f"unseen_{p}") for p in ("val", "test")],
    )
    return one.unpivot([], one.columns, "measure", "value")


def dataset_state(rows: DataFrame) -> DataFrame:
    """(measure, value): samples by slice, samples by tag, which fields exist in how many."""
    tags = rows.select(F.explode("tags").alias("t")).groupBy(F.concat(F.lit("tag:"), "t").alias("measure")).agg(F.count(F.lit(1)).alias("value"))
    slices = rows.groupBy(F.concat(F.lit("slice:"), F.coalesce("group_slice", F.lit("none"))).alias("measure")).agg(F.count(F.lit(1)).alias("value"))
    fields = field_population(rows, rows.columns).select(F.concat(F.lit("field:"), "field").alias("measure"), F.col("n").alias("value"))
    return slices.unionByName(tags).unionByName(fields)


def best_per_group(rows: DataFrame, key: str, score: list[str], n: int = 9) -> DataFrame:
    """The best row of each group by ``score``, of those the best ``n``, by group."""
    rank = F.struct(*score)
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(rank).alias("best"))
    return best.orderBy(F.col("best").desc(), key).limit(n).select(key, "best.*").orderBy(key)


def sheet(rows: DataFrame, row: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    """A sheet of ``value`` by row and column."""
    return rows.groupBy(row).pivot(column, columns).agg(F.first(value))


def status_counts(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """(value, n) for each of ``known``, 0 if there are none."""
    one = rows.agg(*[F.count_if(F.col(column) == k).alias(k) for k in known])
    return one.unpivot([], known, "value", "n")


def resolved_counts(rows: DataFrame, own: str, other: str) -> DataFrame:
    """One row: terminals with an identity, and identities that either side gives (any that isn't null, whatever its status)."""
    return rows.agg(F.count(own).alias("terminal"), F.count(F.coalesce(own, other)).alias("resolved"), F.count_if(F.col(own).isNull() & F.col(other).isNull()).alias("unresolved"))


def slide_report(slides: DataFrame, identity: str = "identity", site: str = "site") -> DataFrame:
    """One row: pictures, and how many identities and sites they name."""
    return slides.agg(F.count(F.lit(1)).alias("pictures"), F.count_distinct(identity).alias("identities"), F.count_distinct(site).alias("sites"))


def view_counts(snapshot: DataFrame) -> DataFrame:
    """(view, n) of the nine saved views, in one pass."""
    tests = {"all": F.lit(True), "lineage_unresolved": F.col("lineage_status") != "matched", "review_required": F.col("review_required")}
    tests |= {f"{kind}_{part}": F.col(f"{kind}_split") == part for kind in ("closed_set", "open_set") for part in ("train", "val", "test")}
    one = snapshot.agg(*[F.count_if(t).alias(name) for name, t in tests.items()])
    return one.unpivot([], one.columns, "view", "n")
