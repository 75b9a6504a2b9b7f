"""Batched model inference with collected errors, and nearest neighbours of its embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.operators.similarity_index import ranked
from fieldbook.operators.vectors import blocks_of, over_block_pairs, unit_matrix


def settled(model: Callable[[list], list], payloads: pd.Series) -> list[tuple]:
    """A vector and no error, or none and what was raised, for each payload: a batch that fails is halved until single rows are left."""

    def settle(values: list) -> list[tuple]:
        try:
            return [(v, None) for v in model(values)]
        except Exception as error:  # a model may raise anything; the row keeps what it said
            if len(values) == 1:
                return [(None, f"{type(error).__name__}: {error}")]
            half = len(values) // 2
            return settle(values[:half]) + settle(values[half:])

    there = payloads.notna().to_numpy()
    made: list = [(None, "no payload")] * len(payloads)
    if there.any():
        for i, result in zip(np.flatnonzero(there), settle(payloads[there].tolist()), strict=True):
            made[i] = result
    return made


def infer(rows: DataFrame, load: Callable[[], Callable[[list], list]], key: str, payload: str, batch: int = 32) -> DataFrame:
    """(key, embedding, error): ``load`` runs once in each task and gives the model's function from a list of payloads to vectors.

    A batch that fails is halved until single rows are left; a row that still
    fails keeps null and its error. Null payloads are errors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in batches:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                made = settled(model, part[payload])
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": [None if v is None else np.asarray(v, float).tolist() for v, _ in made], "error": [e for _, e in made]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, payload).mapInPandas(run, f"{key} {kind}, embedding array<double>, error string")


def top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query, rank, id, similarity): the ``k`` most similar other rows of (id, vector), ties by id. Each pair of blocks keeps its best ``k``."""
    left, n_left = blocks_of(queries.select("id", "vector"), block)
    right, n_right = blocks_of(vectors.select("id", "vector"), block)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = {"query": "int64", "id": "int64", "similarity": "float64"}
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in empty}).astype(empty)
        b = b.sort_values("id")
        ids, mine = b["id"].to_numpy(), a["id"].to_numpy()
        s = np.round(unit_matrix(a) @ unit_matrix(b).T, 12)
        s[mine[:, None] == ids[None]] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ties by id
        found = np.take_along_axis(s, order, 1)
        made = pd.DataFrame({"query": np.repeat(mine, order.shape[1]), "id": ids[order].ravel(), "similarity": found.ravel()})
        return made[np.isfinite(made["similarity"])].astype(empty)

    pairs = over_block_pairs(left, right, n_left, n_right, best, "query long, id long, similarity double")
    return ranked(pairs, k)


def accuracy(rows: DataFrame, scores: str, label: str) -> DataFrame:
    """One row: n and the percentage of rows whose largest score is the label's (the first of equals)."""
    guess = F.array_position(scores, F.array_max(scores)) - 1
    return rows.agg(F.count(F.lit(1)).alias("n"), (100 * F.avg((guess == F.col(label)).cast("double"))).alias("accuracy"))
