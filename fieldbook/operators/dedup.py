"""Duplicates: greedy leaders among similar vectors, equal content, and their diagnostics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.text import identities_compatible
from fieldbook.operators.near_blocks import first_edges, neighbour_counts
from fieldbook.operators.vectors import norm
from fieldbook.session import materialize


def unmark(samples: DataFrame, tag: str = "duplicate") -> DataFrame:
    """Marks of an earlier run removed."""
    return samples.withColumns({"is_duplicate": F.lit(False), "duplicate_of": F.lit(None).cast("long"), "duplicate_similarity": F.lit(None).cast("double"), "tags": F.array_remove("tags", tag)})


#: Edges among unsettled rows that one task settles row by row; earlier neighbours that a row keeps of each block near it.
SETTLED_AT_ONCE, FIRST = 1_000_000, 16
#: Rows that are settled first, and at most at a time.
BATCH, LARGEST = 16_384, 262_144


def _settle(edges: DataFrame) -> DataFrame:
    """(id, leads) of all ends of ``edges`` (a, b; a <= b), null where the edges don't tell.

    An edge from a row to itself stands for earlier neighbours that are not
    listed: unless a leader is found for the row, it stays open, and so may what
    follows it. Rounds drop what is settled, until few edges are left, which one
    task settles.
    """
    done: list[DataFrame] = []
    while True:
        if edges.limit(SETTLED_AT_ONCE + 1).count() <= SETTLED_AT_ONCE:
            done.append(materialize(edges.coalesce(1).mapInPandas(_in_order, "id long, leads boolean"), "leaders"))
            break
        ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        first = materialize(ends.join(edges.select(F.col("b").alias("id")), "id", "left_anti"), "leaders")  # no earlier neighbour is left
        if first.isEmpty():
            done.append(materialize(ends.withColumn("leads", F.lit(None).cast("boolean")), "leaders"))
            break
        led = edges.join(first.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct()
        settled = materialize(first.withColumn("leads", F.lit(True)).unionByName(led.withColumn("leads", F.lit(False))), "leaders")
        done.append(settled)
        ids = settled.select("id")
        rest = materialize(edges.join(ids.withColumnRenamed("id", "a"), "a", "left_anti").join(ids.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"), "edges")
        # Rows that lost all their edges have no leader among their neighbours.
        left = ends.join(ids, "id", "left_anti").join(rest.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_anti")
        done.append(materialize(left.withColumn("leads", F.lit(True)), "leaders"))
        edges = rest
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The loop itself, over a bounded number of edges: a row leads unless an earlier neighbour does."""
    parts = list(batches)
    edges = pd.concat(parts) if parts else pd.DataFrame({"a": [], "b": []})
    a, b = edges["a"].to_numpy(np.int64), edges["b"].to_numpy(np.int64)
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    leads: dict[int, bool | None] = dict.fromkeys(np.unique(np.concatenate([a, b])).tolist(), True)
    cuts = [*np.flatnonzero(np.diff(b, prepend=b[:1] - 1)), len(b)]
    for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
        row = int(b[start])
        before = [None if x == row else leads[x] for x in a[start:stop].tolist()]
        leads[row] = False if any(before) else None if None in before else True
    yield pd.DataFrame({"id": np.array(list(leads), np.int64), "leads": pd.array(list(leads.values()), "boolean")})


def _with_loops(edges: DataFrame) -> DataFrame:
    """(a, b) of first edges, and (b, b) for rows that have more earlier neighbours than were listed."""
    return edges.select("a", "b").unionByName(edges.where("more").select(F.col("b").alias("a"), "b").distinct())


def _led(ids: DataFrame, least: float, first: int, places: int | None) -> DataFrame:
    """(id, leader, similarity) of the duplicates among (id, vector), going through the rows by id.

    Each row lists its ``first`` earlier neighbours in each block, not all pairs of
    a dense group; rows that these leave open are held against the leaders and each
    other again.
    """
    edges = materialize(first_edges(ids.withColumns({"target": F.lit(True), "source": F.lit(True)}), least, first, places=places), "edges")
    state = materialize(_settle(materialize(_with_loops(edges), "edges")), "states")  # rows that it lacks lead
    while not (opened := state.where("leads IS NULL").select("id")).isEmpty():
        held = ids.join(state.where("NOT leads").select("id"), "id", "left_anti").join(opened.withColumn("target", F.lit(True)), "id", "left")
        again = materialize(_with_loops(first_edges(held.select("id", "vector", F.coalesce("target", F.lit(False)).alias("target"), F.lit(True).alias("source")), least, first, places=places)), "edges")
        told = opened.join(_settle(again).withColumn("seen", F.lit(True)), "id", "left").select("id", F.when(F.col("seen").isNull(), True).otherwise(F.col("leads")).alias("leads"))
        state = materialize(state.where("leads IS NOT NULL").unionByName(told), "states")
    followers = state.where("NOT leads").select("id")
    cut = followers.join(edges.where("more").select(F.col("b").alias("id")).distinct(), "id", "left_semi")
    led = edges.join(followers.withColumnRenamed("id", "a"), "a", "left_anti").select("a", "b", "similarity")
    if not cut.isEmpty():  # a leader before the listed ones is looked for among the leaders alone
        led = led.unionByName(_first_leaders(ids.join(cut, "id"), ids.join(followers, "id", "left_anti"), least, places).select(F.col("leader").alias("a"), F.col("id").alias("b"), "similarity"))
    best = led.groupBy("b").agg(F.min(F.struct("a", "similarity")).alias("best"))
    return materialize(followers.join(best.withColumnRenamed("b", "of"), F.col("id") == F.col("of")).select("id", F.col("best.a").alias("leader"), "best.similarity"), "led")


def _first_leaders(ids: DataFrame, leaders: DataFrame, least: float, places: int | None) -> DataFrame:
    """(id, leader, similarity): of (id, vector) those with an earlier similar one among ``leaders``, and the first of these."""
    held = leaders.select("id", "vector", F.lit(False).alias("target"), F.lit(True).alias("source"))
    sought = ids.select("id", "vector", F.lit(True).alias("target"), F.lit(False).alias("source"))
    edges = first_edges(held.unionByName(sought), least, 1, places=places, sides="target")
    return edges.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("a", "similarity")).alias("best")).select("id", F.col("best.a").alias("leader"), "best.similarity")


def _bounds(ids: DataFrame) -> list[int]:
    """The last ids of all batches but the last: each has as many rows, about, as those before it, ``BATCH`` at least and ``LARGEST`` at most."""
    n, ends, size = ids.count(), [], BATCH
    while sum(ends[-1:]) + size < n:
        ends.append(sum(ends[-1:]) + size)
        size = min(LARGEST, max(BATCH, ends[-1]))
    return sorted(set(ids.agg(F.percentile_approx("id", [e / n for e in ends], 100_000)).first()[0])) if ends else []


def greedy_leaders(vectors: DataFrame, least: float, first: int = FIRST, places: int | None = None) -> DataFrame:
    """(id, is_duplicate, duplicate_of, duplicate_similarity) for (id, vector), going through the rows by id.

    A row is a leader unless an earlier leader is similar; it then is a duplicate
    of the first such leader. Batches of rows, each as large as all before, are
    held against the earlier leaders, and what none of these leads is settled among
    itself: where leaders are few, no more than rows times leaders is compared.
    Equal vectors are settled once, as their first row, unless they are not similar
    to themselves, as zero vectors are. Null vectors are left out before positions
    are taken. Similarities are rounded to ``places``, if that is given.
    """
    rows = vectors.where("vector IS NOT NULL").select("id", "vector")
    length = norm(F.col("vector"))
    alone = F.when(length * length / ((length + 1e-12) * (length + 1e-12)) < least, F.col("id"))
    rows = materialize(rows.withColumn("alone", alone), "vectors")
    equal = materialize(rows.groupBy("vector", "alone").agg(F.min("id").alias("first")), "equal-vectors")
    members = rows.join(equal.select(F.col("vector").alias("same"), F.col("alone").alias("other"), "first"), (F.col("vector") == F.col("same")) & F.col("alone").eqNullSafe(F.col("other"))).select("id", "first")
    ids = equal.select(F.col("first").alias("id"), "vector")
    bounds, leaders, led = _bounds(ids), None, []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        batch = ids.where(F.lit(True) if low is None else F.col("id") > low).where(F.lit(True) if high is None else F.col("id") <= high)
        if leaders is not None:
            led.append(materialize(_first_leaders(batch, leaders, least, places), "led"))
            batch = materialize(batch.join(led[-1].select("id"), "id", "left_anti"), "batch")
        led.append(_led(batch, least, first, places))
        if high is not None:
            more = materialize(batch.join(led[-1].select("id"), "id", "left_anti"), "leaders")
            leaders = more if leaders is None else leaders.unionByName(more)
    every = led[0]
    for part in led[1:]:
        every = every.unionByName(part)
    out = members.join(every.withColumnsRenamed({"id": "of", "similarity": "s"}), F.col("first") == F.col("of"), "left")
    duplicate = F.col("leader").isNotNull() | (F.col("id") != F.col("first"))
    return out.select("id", duplicate.alias("is_duplicate"), F.when(duplicate, F.coalesce("leader", "first")).alias("duplicate_of"), F.when(duplicate, F.coalesce("s", F.lit(1.0))).alias("duplicate_similarity"))


def leaky_splits(vectors: DataFrame, least: float) -> DataFrame:
    """(id, split, n_leaks): rows of (id, vector, split) with similar rows in other splits, and how many."""
    found = neighbour_counts(vectors, least, apart="split").where("n_links > 0")
    return found.join(vectors.select("id", "split"), "id").select("id", "split", F.col("n_links").alias("n_leaks"))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def representatives(records: DataFrame, hash_col: str, valid: Column, identity: Column, compatible: Column, path: str) -> DataFrame:
    """``records`` with keep_path, group_size, kept: of equal content the valid, then identified, then compatible row stays, then the least path."""
    rank = F.struct((~valid).alias("a"), identity.isNull().alias("b"), (~compatible).alias("c"), F.col(path).alias("path"))
    groups = records.groupBy(F.col(hash_col).alias("__hash")).agg(F.min(rank).alias("__best"), F.count(F.lit(1)).alias("group_size"))
    joined = records.join(groups, F.col(hash_col) == F.col("__hash"))
    return joined.withColumns({"keep_path": F.col("__best.path"), "kept": F.col(path) == F.col("__best.path")}).drop("__hash", "__best")


def conflicts(records: DataFrame, hash_col: str, identity: str, annotation: str) -> DataFrame:
    """(hash, reason): groups of equal content with two identities or with different annotations."""
    groups = records.groupBy(F.col(hash_col).alias("hash")).agg(F.min(identity).alias("i0"), F.max(identity).alias("i1"), F.min(annotation).alias("a0"), F.max(annotation).alias("a1"))
    reasons = F.array_compact(F.array(F.when(F.col("i0") != F.col("i1"), "identities differ"), F.when(F.col("a0") != F.col("a1"), "annotations differ")))
    return groups.select("hash", F.explode(reasons).alias("reason"))


def usable_match(status: Column, identity: Column, other: Column) -> Column:
    """Whether a lineage match may count in ranking: matched, and identities not in conflict."""
    return F.coalesce((status == "matched") & identities_compatible(identity, other), F.lit(False))


def duplicate_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows and their least id."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def duplicate_diagnostics(rows: DataFrame, key: str) -> DataFrame:
    """One row: unique keys, groups of more than one, rows in them, pairs in them."""
    sizes = rows.groupBy(key).count()
    pairs = F.sum(F.col("count") * (F.col("count") - 1) / 2).cast("long")
    return sizes.agg(F.count(F.lit(1)).alias("unique_keys"), F.count_if(F.col("count") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("duplicate_rows"), F.coalesce(pairs, F.lit(0)).alias("duplicate_pairs"))


def mark_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with is_first: the least of its key by ``order``."""
    return rows.withColumn("is_first", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1)
