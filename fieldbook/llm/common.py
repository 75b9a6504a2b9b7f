"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.session import materialize

#: ASCII white space, as a regex class body: space and \x09 to \x0D.
SPACE = r"\x20\x09-\x0D"


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it (names clash without regard to case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Operators of a plan that reads each row of its files once at most, and the same rows whenever it runs.
_PLAIN = {"FileScan", "ColumnarToRow", "Project", "Filter"}


def _plain_scan(rows: DataFrame) -> bool:
    """Whether ``rows`` are filtered and projected files, by their physical plan; what cannot be told counts as no."""
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        rows.explain()
    nodes = re.findall(r"^[\s:|+-]*(?:\*\(\d+\) )?(\w+)", shown.getvalue().split("==\n", 1)[-1].strip(), re.M)
    return set(nodes) <= _PLAIN and nodes.count("FileScan") == 1


def _each_once(rows: DataFrame, locator: str) -> bool:
    """Whether no locator occurs twice (a path may have been given twice): bitmaps of row numbers, four kilobytes for 32,768 rows."""
    row = F.col(f"{locator}.row")
    parts = rows.groupBy(F.col(f"{locator}.file").alias("file"), F.bitmap_bucket_number(row).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias("bits"), F.count(F.lit(1)).alias("n"))
    return parts.where(F.bitmap_count("bits") != F.col("n")).isEmpty()


def located(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a further column, the content locator (file and row in it), and that column's name.

    No two rows share a locator, and reading again gives the same ones. That
    holds for filtered and projected files; any other frame (exploded, joined,
    sorted, made in memory) is written to a scratch table first.
    """
    name = fresh("locator", docs.columns)
    locator = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name)
    try:
        rows = docs.select("*", locator)
        if _plain_scan(rows) and _each_once(rows, name):
            return rows, name
    except AnalysisException:
        pass
    return materialize(docs, "dedup-input").select("*", locator), name


def documents_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the identifier and the text, so that further columns cannot clash."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def held_out(id_column: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the identifier as text leaves ``remainder``; a null identifier is never held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample_labels(labels: DataFrame, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows of (doc_id, label) chosen by a hash of doc_id; all rows if there are fewer.

    Labels repeated for one document count once (the smallest). The result has a
    proven size bound, so it may be broadcast.
    """
    labels = labels.where("doc_id IS NOT NULL AND label IS NOT NULL")
    n = labels.count()
    if n > bound:
        slots = 1 << 30
        labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(slots)) < int(slots * bound / n))
    return labels.groupBy("doc_id").agg(F.min("label").alias("label"))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of ``batch`` whose texts hold about ``most_bytes``, one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def per_text(make: Callable[[], Callable[[list], list]], column: str, names: list[str], types: list[pa.DataType], keep: list[str] | None = None, most_bytes: int = 4_000_000):
    """A ``mapInArrow`` function that keeps the input columns (or those in ``keep``) and adds computed ones.

    ``make`` runs once in each task and gives the function from a list of texts
    (None for null) to a list of columns. Memory is bounded by slices of about
    ``most_bytes`` of text, or one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            kept = batch.schema.names if keep is None else keep
            for part in slices(batch, column, most_bytes):
                made = work(part.column(column).to_pylist())
                arrays = [pa.array(v, t) for v, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *arrays], names=[*kept, *names])

    return run


#: Rows of a key that one task gets, about, in :func:`salted_join`; rows of a table that may be broadcast.
HOT, BROADCAST_ROWS = 1_024, 200_000


def bounded_broadcast(rows: DataFrame) -> DataFrame:
    """``rows`` (cheap to count) with a hint to broadcast them if they are at most ``BROADCAST_ROWS``."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def salted_join(rows: DataFrame, key: str, node: str, values: DataFrame, counts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns that ``values`` has for their ``key``, one row a key; ``counts``: (key, n), the rows of each key.

    Rows of keys with more than ``HOT`` are dealt by ``node`` over salts, and
    their values are sent to each salt once, so no task gets all rows of a key.
    """
    hot = materialize(counts.where(F.col("n") > HOT).select(key, F.ceil(F.col("n") / HOT).cast("int").alias("__salts")), "hot-keys")
    if hot.isEmpty():
        return rows.join(values, key, how)
    hot = bounded_broadcast(hot)
    salts = F.coalesce("__salts", F.lit(1))
    salted = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(node), salts).cast("int")).drop("__salts")
    sent = values.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return salted.join(sent, [key, "__salt"], how).drop("__salt")


def with_leaders(members: DataFrame, key: str, node: str, order: Column) -> DataFrame:
    """``members`` with ``leader``, the least ``order`` of their key, of keys with more than one member."""
    leaders = materialize(members.groupBy(key).agg(F.min(order).alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"), "leaders")
    return salted_join(members, key, node, leaders.drop("n"), leaders)


def runs_in(texts: pa.Array, is_part: Callable[[np.ndarray], np.ndarray], lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of bytes that ``is_part`` marks, none across two texts, and the place of each run's text.

    A-Z are lower-cased first unless ``lower`` is off; no other character is. The
    work is done on the column's bytes at once, without a Python object a run.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    part = is_part(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    before, after = np.concatenate([[False], part[:-1]]) if len(part) else part, np.concatenate([part[1:], [False]]) if len(part) else part
    starts, ends = np.flatnonzero(part & (~before | edge[:-1])), np.flatnonzero(part & (~after | edge[1:])) + 1
    ends_at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    runs = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends_at), pa.py_buffer(np.ascontiguousarray(data[part])))
    return runs, np.searchsorted(offsets, starts, side="right") - 1


def pair_counts(place: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes, places and numbers of occurrences of the distinct pairs, ordered by code and then place."""
    width = int(place.max(initial=-1)) + 1
    keys, counts = np.unique(code.astype(np.int64) * width + place, return_counts=True)
    return keys // max(width, 1), keys % max(width, 1), counts
