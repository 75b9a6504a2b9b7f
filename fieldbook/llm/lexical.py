"""Ranked lexical search by MaxScore in shards (operator 11).

An index is a table: documents are cut into shards of bounded size, and a row
holds the postings of one term in one shard. A search reads only the rows of its
terms. In each shard a query's terms are ordered by the most that they can add;
those that together cannot lift a document over the k-th best score so far are
non-essential, and their postings are probed only for documents that can still
qualify. Scores are whole numbers, so results don't depend on how documents are
dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from fieldbook.llm.common import bounded_broadcast, pair_counts, runs_in, slices
from fieldbook.session import materialize

#: Bytes of text in a shard, about; documents that are scored together; items that one task searches together.
SHARD_BYTES, SPAN, ITEMS = 16_000_000, 1_024, 512
#: Pairs of an item and a term that may be broadcast.
BROADCAST_PAIRS = 1_000_000

_IS_TERM = np.zeros(256, bool)
_IS_TERM[48:58] = _IS_TERM[65:91] = _IS_TERM[97:123] = _IS_TERM[128:] = True


def terms_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms (runs of digits, letters and characters outside ASCII, A-Z lower-cased) and the place of each one's text."""
    return runs_in(texts, lambda data: _IS_TERM[data])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, path: str | None = None) -> DataFrame:
    """Write the index of all ``docs`` and return it: rows (shard, term, held, total, docs, times, lengths, ids).

    A term's row lists in ``docs`` the places of the shard's documents that hold
    it, in ``times`` how often and in ``lengths`` each one's number of terms;
    ``held`` counts them. A shard's row of the null term has in ``ids`` the
    identifiers (of any type that Spark orders, in its order, null last) by
    place, in ``held`` the documents with a term and in ``total`` their terms.
    Null texts have no terms; of an empty table the index is empty. Repeated
    rows are documents of their own. A long text is indexed whole, in a shard
    of its own. Every further column is ignored.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    ints = ArrayType(IntegerType())
    schema = StructType([StructField("shard", StringType()), StructField("term", StringType()), StructField("held", LongType()), StructField("total", LongType()), *(StructField(n, ints) for n in ("docs", "times", "lengths")), StructField("ids", ArrayType(kind))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = 0
        for batch in batches:
            for part in slices(batch, "text", shard_bytes):
                cut += 1
                shard = f"{TaskContext.get().partitionId()}-{cut}"
                ids = part.column("id")
                order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                terms, owner = terms_in(part.column("text"))
                encoded = terms.dictionary_encode()
                names = encoded.dictionary.cast(pa.string())
                code, at, times = pair_counts(place[owner], encoded.indices.to_numpy())
                lengths = np.bincount(place[owner], minlength=len(ids))
                bounds = np.searchsorted(code, np.arange(len(names) + 1)).astype(np.int32)
                lists = lambda values: pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.astype(np.int32)))
                sorted_terms = pc.sort_indices(names)
                arrays = [pa.array([shard] * len(names), pa.string()), names, pa.array(np.diff(bounds).astype(np.int64)), pa.array(np.zeros(len(names), np.int64)), lists(at), lists(times), lists(lengths[at]), pa.nulls(len(names), pa.list_(ids.type))]
                made = pa.RecordBatch.from_arrays(arrays, names=schema.names).take(sorted_terms)
                for start in range(0, made.num_rows, 4096):
                    yield made.slice(start, 4096)
                empty = pa.nulls(1, pa.list_(pa.int32()))
                by_place = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.string()), pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), empty, empty, empty, by_place], names=schema.names)

    return materialize(rows.mapInArrow(index, schema), "lexical-index", path)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The distinct (item, term) of ``queries``; rows with the same identifier are one item, and null texts have no terms."""
    rows = queries.select(queries[id_col].alias("item"), queries[text_col].cast("string").alias("text"))
    schema = StructType([rows.schema["item"], StructField("term", StringType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                terms, owner = terms_in(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(owner)), terms.cast(pa.string())], names=["item", "term"])

    return rows.mapInArrow(split, schema).distinct()


def best_in_shard(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best places with a score above 0 and their scores, best first, equal ones by place; ``lists``: (places, scores) of each term.

    MaxScore over spans of places: after each span the threshold rises to the
    k-th best score, and terms join the non-essential ones while their bounds
    add up to the threshold at most. Places come in rising order, so that a later
    document has to beat the threshold, not to reach it.
    """
    lists = sorted(lists, key=lambda x: int(x[1].max(initial=0)))
    bounds = np.cumsum([int(s.max(initial=0)) for _, s in lists])
    cuts = [np.searchsorted(p, np.arange(0, n_docs + SPAN, SPAN)) for p, _ in lists]
    best_at, best, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for span, low in enumerate(range(0, n_docs, SPAN)):
        essential = int(np.searchsorted(bounds, threshold, side="right"))
        if essential == len(lists):
            break
        scores = np.zeros(min(SPAN, n_docs - low), np.int64)
        for (places, values), cut in zip(lists[essential:], cuts[essential:], strict=True):
            here = slice(cut[span], cut[span + 1])
            scores[places[here] - low] += values[here]  # a list has each place once
        alive = np.flatnonzero(scores)
        for j in range(essential - 1, -1, -1):
            alive = alive[scores[alive] + bounds[j] > threshold]
            if not len(alive):
                break
            places, values = lists[j][0][cuts[j][span] : cuts[j][span + 1]], lists[j][1][cuts[j][span] : cuts[j][span + 1]]
            if not len(places):
                continue
            found = np.minimum(np.searchsorted(places, alive + low), len(places) - 1)
            hit = places[found] == alive + low
            scores[alive[hit]] += values[found[hit]]
        alive = alive[scores[alive] > threshold]
        if len(alive):
            best_at, best = np.concatenate([best_at, alive + low]), np.concatenate([best, scores[alive]])
            order = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[order], best[order]
            if len(best) == k:
                threshold = int(best[-1])
    return best_at, best


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each query as (item, rank, doc_id, score); scores above 0 only, equal ones by ascending identifier.

    ``index`` is what :func:`build_index` returned, ``queries`` have ``id_col``
    and ``text_col``. An item without terms, or whose terms stand nowhere, has no
    row. Queries are searched in blocks of about 512; a task gets one block's
    terms in one shard.
    """
    every = index.where("term IS NULL").agg(F.sum("held").alias("n"), F.sum("total").alias("total")).first()
    n_docs, n_terms = every["n"] or 0, every["total"] or 0
    terms = materialize(query_terms(queries, id_col, text_col), "query-terms")
    n_blocks = max(1, -(-terms.select("item").distinct().count() // ITEMS))
    asked = terms.groupBy("term", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).alias("block")).agg(F.collect_list("item").alias("items"), F.count_if(F.col("item").isNull()).alias("nulls"))
    words = bounded_broadcast(materialize(terms.select("term").distinct(), "query-words"))
    held = index.where("term IS NOT NULL").select("term", "held").join(words, "term").groupBy("term").agg(F.sum("held").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    asked = materialize(asked.join(held, "term").select("term", "block", "items", "nulls", weight.alias("weight")), "weighted-terms")
    if terms.count() <= BROADCAST_PAIRS:
        asked = F.broadcast(asked)
    lists = index.where("term IS NOT NULL").select("shard", "term", "docs", "times", "lengths").join(asked, "term")
    schema = StructType([StructField("shard", StringType()), StructField("item", terms.schema["item"].dataType), StructField("place", IntegerType()), StructField("score", LongType())])

    def in_shard(table: pa.Table) -> pa.Table:
        of_item: dict[object, list] = {}
        highest = 0
        for batch in table.to_batches():
            docs, times, lengths = (batch.column(c) for c in ("docs", "times", "lengths"))
            cut, first = docs.offsets.to_numpy(), docs.offsets[0].as_py()
            flat, often, size = docs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64), lengths.flatten().to_numpy().astype(np.int64)
            measure = 10 + (90 * size * n_docs) // n_terms
            part = (1_000_000_000 * often) // (1000 * often + 8 * measure)
            highest = max(highest, int(flat.max(initial=0)) + 1)
            rows = zip(batch.column("weight").to_pylist(), batch.column("items").to_pylist(), batch.column("nulls").to_pylist(), cut[:-1] - first, cut[1:] - first, strict=True)
            for w, items, nulls, a, b in rows:
                if w > 0:
                    scored = flat[a:b].astype(np.int64), w * part[a:b]
                    for item in [*items, *[None] * nulls]:
                        of_item.setdefault(item, []).append(scored)
        shard, out = table.column("shard")[0].as_py(), []
        for item, found in of_item.items():
            out += [(item, int(p), int(s)) for p, s in zip(*best_in_shard(found, highest, k), strict=True)]
        items, places, scores = zip(*out, strict=True) if out else ((), (), ())
        return pa.Table.from_arrays([pa.array([shard] * len(out), pa.string()), pa.array(items, table.schema.field("items").type.value_type), pa.array(places, pa.int32()), pa.array(scores, pa.int64())], names=schema.names)

    best = lists.groupBy("shard", "block").applyInArrow(in_shard, schema)
    first = Window.partitionBy("item", "some").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    best = materialize(best, "shard-bests")
    ids = index.where("term IS NULL").select("shard", F.posexplode("ids").alias("place", "id")).join(bounded_broadcast(best.select("shard", "place").distinct()), ["shard", "place"])
    # Two levels: the shards' bests meet in 64 groups an item first.
    best = best.join(ids, ["shard", "place"]).withColumn("some", F.pmod(F.xxhash64("shard"), F.lit(64)))
    best = best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("some")
    last = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("item", "rank", F.col("id").alias("doc_id"), "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id and score of the ten best documents for every benchmark item."""
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) x),
tf AS MATERIALIZED (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY doc_id, term),
n AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
t AS MATERIALIZED (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM t) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
m AS MATERIALIZED (SELECT doc_id, 100 - 90 + ((90 * n * docs) // terms) AS m FROM n, t),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
