"""An approximate similarity index kept as tables: inverted lists around sampled rows.

Built once, it is a table of cells (a centre each, one for about the square root
of the rows) and a table of rows, each in the lists of the cells nearest to it,
ordered by cell. A search holds its queries against the centres, joins them with
the lists of the nearest cells, and compares within blocks of one list, so a query
meets a number of rows that grows like the square root of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldbook.operators.vectors import BLOCK, unit_matrix
from fieldbook.session import materialize, scratch_path

#: Cells at most, and numbers in all their centres at most (32 MB): they travel to every task.
MOST_CELLS, MOST_NUMBERS = 16_384, 4_000_000


@dataclass(frozen=True)
class SimilarityIndex:
    """``cells`` (cell, centre) and ``rows`` (cell, id, vector): a row stands once in each of its cells."""

    cells: DataFrame
    rows: DataFrame


def _nearest(rows: pd.DataFrame, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` cells of highest cosine for each row, ties by cell."""
    return np.argsort(-np.round(unit_matrix(rows) @ centres.T, 12), axis=1, kind="stable")[:, :n]


def _with_cells(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """``rows`` once for each of their ``n`` nearest cells."""
    columns = rows.columns

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = _nearest(batch, centres, n)
            yield batch.loc[batch.index.repeat(cells.shape[1])].assign(cell=cells.ravel().astype("int32"))[["cell", *columns]]

    return rows.mapInPandas(place, rows.select(F.lit(0).alias("cell"), *columns).schema)


def build(vectors: DataFrame, cells: int | None = None, spill: int = 2, seed: int = 42, path: str | None = None) -> SimilarityIndex:
    """Write the index of (id, vector) below ``path`` (a scratch folder if none is given); null vectors are left out.

    ``cells`` rows, drawn by a hash of seed and id, are the centres (the square
    root of the rows if None; ``MOST_CELLS`` at most). Each row stands in the
    ``spill`` lists of highest cosine: neighbours that a cell's border parts meet in
    the other list.
    """
    path = path or scratch_path(vectors.sparkSession, "similarity-index")
    rows = vectors.where("vector IS NOT NULL").select("id", "vector")
    n = rows.count()
    size = (rows.agg(F.max(F.size("vector"))).first()[0] or 1) if n else 1
    wanted = min(int(np.ceil(np.sqrt(n))) if cells is None else cells, MOST_CELLS, max(1, MOST_NUMBERS // size))
    drawn = rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(wanted).toPandas()
    centres = unit_matrix(drawn)
    spark = vectors.sparkSession
    frame = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    listed = _with_cells(rows, centres, spill) if n else rows.select(F.lit(0).alias("cell"), "id", "vector")
    ordered = listed.repartitionByRange(max(1, n // 65_536), "cell", "id").sortWithinPartitions("cell")
    return SimilarityIndex(materialize(frame, "", f"{path}/cells"), materialize(ordered, "", f"{path}/rows"))


def read(spark: SparkSession, path: str) -> SimilarityIndex:
    """The index that :func:`build` wrote below ``path``."""
    return SimilarityIndex(spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/rows"))


def _centres(index: SimilarityIndex) -> np.ndarray:
    """The centres by cell: bounded by ``MOST_NUMBERS``."""
    return np.array([r["centre"] for r in index.cells.orderBy("cell").collect()])


def search(index: SimilarityIndex, queries: DataFrame, k: int = 10, probes: int = 20, block: int = BLOCK) -> DataFrame:
    """(query, rank, id, similarity): of the rows in the ``probes`` cells nearest to each of (id, vector) the ``k`` most similar others, ties by id.

    A cell's queries and rows are both dealt into blocks, so neither a cell that
    holds a third of all rows nor one that most queries ask for is one task.
    """
    centres = _centres(index)
    empty = "query long, id long, similarity double"
    if not len(centres):
        return index.rows.sparkSession.createDataFrame([], "query long, rank int, id long, similarity double")
    asked = materialize(_with_cells(queries.where("vector IS NOT NULL").select("id", "vector"), centres, probes), "probes")
    blocks = lambda rows, name: rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = F.broadcast(blocks(index.rows, "n_right").join(blocks(asked, "n_left"), "cell"))  # a row a cell
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "cell").select("cell", "id", "vector", F.lit(True).alias("is_left"), deal("n_left").alias("i"), spread("n_right").alias("j"))
    right = index.rows.join(sizes, "cell").select("cell", "id", "vector", F.lit(False).alias("is_left"), spread("n_left").alias("i"), deal("n_right").alias("j"))

    def best(part: pd.DataFrame) -> pd.DataFrame:
        a, b = part[part["is_left"]], part[~part["is_left"]].sort_values("id")
        if a.empty or b.empty:
            return pd.DataFrame({"query": [], "id": [], "similarity": []}).astype({"query": "int64", "id": "int64"})
        ids, mine = b["id"].to_numpy(), a["id"].to_numpy()
        s = np.round(unit_matrix(a) @ unit_matrix(b).T, 12)
        s[mine[:, None] == ids[None]] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        found = pd.DataFrame({"query": np.repeat(mine, order.shape[1]), "id": ids[order].ravel(), "similarity": np.take_along_axis(s, order, 1).ravel()})
        return found[np.isfinite(found["similarity"])]

    found = left.unionByName(right).groupBy("cell", "i", "j").applyInPandas(best, empty)
    once = found.groupBy("query", "id").agg(F.max("similarity").alias("similarity"))  # a row may have been met in several cells
    return ranked(once, k)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """(query, rank, id, similarity): the ``k`` best of (query, id, similarity); each task keeps ``k`` a query before anything is shuffled."""
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "similarity")


def compared(index: SimilarityIndex, queries: DataFrame, probes: int = 20) -> DataFrame:
    """(query, n): how many rows each of (id, vector) is compared with, a row that stands in two probed cells twice."""
    sizes = index.rows.groupBy("cell").count()
    asked = _with_cells(queries.where("vector IS NOT NULL").select("id", "vector"), _centres(index), probes)
    return asked.join(sizes, "cell").groupBy(F.col("id").alias("query")).agg(F.sum("count").alias("n"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n_queries, and the share of (query, id) in ``exact`` that ``found`` has."""
    both = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return both.agg(F.countDistinct("query").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
