"""Embeddings: norms, contracts, and similarity of all pairs in blocks.

Pairs are compared by matrix products over pairs of blocks: rows are dealt into
blocks of bounded size, each pair of blocks is one task's input, and only what a
caller asks for (counts, best neighbours, similar pairs) leaves the task. Where
blocks are many they are packed into a row each, and tasks read them from a table:
no shuffle holds a copy of a block for each block that it meets.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fieldbook.sources.fixed import BACKBONE_FIELDS

#: Rows in a block of vectors; in a packed one that tasks read one after the other.
BLOCK, PACKED = 2048, 4096


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def normalised(v: Column, epsilon: float = 1e-12) -> Column:
    """The vector divided by its length (plus a little, so that zero stays zero)."""
    return F.transform(v, lambda x: x.cast("double") / (norm(v) + epsilon))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-12)


def euclidean(a: Column, b: Column) -> Column:
    """Distance with the square clamped at 0 and kept off the root's pole."""
    return F.sqrt(F.greatest(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0)) + 1e-8)


def is_valid(v: Column, size: int = 2152) -> Column:
    """Whether an embedding has ``size`` finite numbers."""
    return F.coalesce((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def checksum(vector: Column) -> Column:
    """SHA-256 of the little-endian float32 bytes; null of null."""

    def digests(some: pd.Series) -> pd.Series:
        import hashlib

        return some.map(lambda v: None if v is None else hashlib.sha256(np.asarray(v, "<f4").tobytes()).hexdigest())

    return F.pandas_udf(digests, StringType())(vector)


def reuse_plan(stored: Column, revision: Column, checksum_: Column, expected_revision: str, overwrite: bool) -> Column:
    """``skip`` what is current, ``compute`` what is missing or may be replaced, ``conflict`` otherwise."""
    current = checksum_.isNotNull() & (revision == expected_revision)
    return F.when(F.coalesce(current, F.lit(False)), "skip").when(stored.isNotNull() & F.lit(not overwrite), "conflict").otherwise("compute")


def population_errors(records: DataFrame, expected: int, expected_missing: DataFrame) -> DataFrame:
    """Rows (what, id) that break the contract: a total other than ``expected``, or other missing rows than ``expected_missing`` (id)."""
    missing = records.where("embedding IS NULL").select("id")
    total = records.agg(F.count("embedding").alias("n")).where(F.col("n") != expected).select(F.lit("total").alias("what"), F.col("n").cast("string").alias("id"))
    tell = lambda rows, what: rows.select(F.lit(what).alias("what"), F.col("id").cast("string").alias("id"))
    return total.unionByName(tell(missing.exceptAll(expected_missing), "missing")).unionByName(tell(expected_missing.exceptAll(missing), "not missing"))


def random_units(ids: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Seeded random unit vectors for (id): a baseline. Numbers are hashes of id, place and seed through Box and Muller."""

    def u(i: Column, k: int) -> Column:
        digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), i.cast("string"), F.lit(str(k)))), 1, 12)
        return (F.conv(digits, 16, 10).cast("double") + 1) / float(16**12 + 1)

    normal = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.sqrt(-2 * F.log(u(i, 0))) * F.cos(2 * np.pi * u(i, 1)))
    drawn = ids.withColumn("embedding", normal)
    return drawn.withColumn("embedding", normalised(F.col("embedding")).cast("array<float>"))


def revision_errors(records: DataFrame, revision: str) -> DataFrame:
    """(id, error): embedded rows whose revision isn't the recorded one."""
    wrong = F.col("embedding").isNotNull() & ~F.col("revision").eqNullSafe(F.lit(revision))
    return records.where(wrong).select("id", F.concat(F.lit(f"expected revision {revision}, found "), F.coalesce("revision", F.lit("none"))).alias("error"))


def embedding_choice(columns: list[str], given: str | None, model: str, usual: str = "embeddings_full_image") -> str:
    """The column that holds the embeddings: the given one, else the usual one if there is such a column, else the model's."""
    return given or (usual if usual in columns else BACKBONE_FIELDS.get(model) or "embeddings_" + re.sub("[/-]", "_", model.rsplit(":", 1)[-1]))


def n_blocks(rows: DataFrame, block: int = BLOCK) -> int:
    """How many blocks of at most ``block`` rows: enough that the pairs of blocks occupy all cores, if that leaves a hundred rows in each."""
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // block), min(-(-n // 128), int(np.ceil(np.sqrt(2 * cores)))))


def blocks_of(vectors: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """``vectors`` (id, vector, ...) without null vectors, with their block number, and the number of blocks."""
    rows = vectors.where("vector IS NOT NULL")
    n = n_blocks(rows, block)
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n


def over_block_pairs(left: DataFrame, right: DataFrame, n_left: int, n_right: int, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``work`` on every pair of a left and a right block. Both sides have (id, vector, block) and the same further columns."""
    columns = [c for c in left.columns if c != "block"]
    a = left.select(*columns, F.lit(True).alias("is_left"), F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))).alias("j"))
    b = right.select(*columns, F.lit(False).alias("is_left"), F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))).alias("i"), F.col("block").alias("j"))

    def run(block: pd.DataFrame) -> pd.DataFrame:
        return work(block[block["is_left"]].reset_index(drop=True), block[~block["is_left"]].reset_index(drop=True))

    # A number of partitions that is asked for is not coalesced: a task for each pair or few.
    return a.unionByName(b).repartition(2 * n_left * n_right, "i", "j").groupBy("i", "j").applyInPandas(run, schema)


def unit_matrix(rows: pd.DataFrame) -> np.ndarray:
    """The vectors of a block as rows of length 1."""
    if rows.empty:
        return np.zeros((0, 0))
    m = np.stack(rows["vector"].to_numpy()).astype(float)
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)


Block = dict[str, np.ndarray]


def arrays(rows: pd.DataFrame, kind: str = "f8") -> Block:
    """The columns of a block as arrays, its vectors as a matrix of numbers of this kind, of small whole ones if they all are."""
    made = {c: rows[c].to_numpy() for c in rows.columns if c != "vector"}
    m = np.stack(rows["vector"].to_numpy()).astype(kind) if len(rows) else np.zeros((0, 0), kind)
    whole = (np.abs(m) < 2**15).all() and (np.rint(m) == m).all()
    return made | {"vector": m.astype("i2") if whole else m}


def pack(block: Block) -> bytes:
    return pickle.dumps(block, protocol=5)


def unpack(data: pa.BinaryScalar) -> Block:
    return pickle.loads(data.as_buffer())  # noqa: S301 - made by :func:`pack` in this job


def number_kind(rows: DataFrame) -> str:
    """What keeps the numbers of the column ``vector`` whole."""
    return "f4" if rows.schema["vector"].dataType.simpleString() == "array<float>" else "f8"


def packed(rows: DataFrame, size: int = PACKED) -> DataFrame:
    """(data): the rows of (id, vector, ...) in blocks of ``size`` at most, a row each."""
    kind = number_kind(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"data": [pack(arrays(batch.iloc[k : k + size], kind)) for k in range(0, len(batch), size)]})

    return rows.mapInPandas(run, "data binary")


def over_all(asked: DataFrame, task: Column, n: int, held: DataFrame, work: Callable[[Block, Iterator[Block]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Run ``work`` on the rows of ``asked`` of each ``task`` (0 to ``n`` - 1) and on all :func:`packed` blocks of ``held``, one after the other.

    Each task reads ``held`` from its table, so only ``asked`` is moved.
    """
    kind = number_kind(asked)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if parts := [b for b in batches if len(b)]:
            yield pd.DataFrame({"asked": [pack(arrays(pd.concat(parts, ignore_index=True), kind))]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def blocks() -> Iterator[Block]:
            yield from map(unpack, first.column("data"))
            for batch in batches:
                yield from map(unpack, batch.column("data"))

        for made in work(unpack(first.column("asked")[0]), blocks()):
            yield pa.RecordBatch.from_pandas(made, preserve_index=False)

    right = asked.repartitionById(n, task.cast("int")).mapInPandas(whole, "asked binary")
    return held.coalesce(1).crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(run, schema)


def units(block: Block) -> np.ndarray:
    """The vectors of a block as rows of length 1."""
    m = block["vector"].astype(float)
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)


def cosines(a: Block, b: Block, places: int | None = None) -> np.ndarray:
    """Cosines of two blocks' rows as SQL has them: the product over the lengths, a little added to each, rounded to ``places``.

    Of whole numbers the product is exact in any order, so equal vectors meet a
    threshold alike, here and in SQL, even on it.
    """
    x, y = a["vector"].astype(float), b["vector"].astype(float)
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)))
    s = x @ y.T
    s /= np.outer(np.linalg.norm(x, axis=1) + 1e-12, np.linalg.norm(y, axis=1) + 1e-12)
    return s if places is None else np.round(s, places)
