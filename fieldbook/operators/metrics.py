"""Retrieval metrics and losses.

Ranking a gallery for each query needs only the places of its positives, but of a
label with a tenth of all rows even those are a tenth of all pairs. So no pair
leaves a task: a task has a few queries, reads the whole gallery block by block,
and gives one row for each query. The fewer queries, the larger the gallery is, so
that what a task holds is bounded; a gallery beyond that is ranked in parts between
bounds of similarity, a task each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.operators.vectors import over_all, packed, unit_matrix, units
from fieldbook.session import materialize

CMC_AT = (1, 5, 10, 20)
#: Similarities that a task holds at once; vectors drawn to place the bounds between the parts of longer rankings.
MERGED, DRAWN = 12_000_000, 512
#: Tied values of one query that are looked up one by one, not by sorting all.
TIES = 8


def _bounds(rows: DataFrame, n: int) -> np.ndarray:
    """Similarities that cut a ranking of ``n`` rows into parts of about ``MERGED``, from the pairs of ``DRAWN`` rows."""
    parts = -(-n // MERGED)
    if parts < 2:
        return np.zeros(0)
    drawn = unit_matrix(rows.select("vector").orderBy(F.md5(F.col("id").cast("string")), "id").limit(DRAWN).toPandas())
    return np.unique(np.quantile((drawn @ drawn.T)[np.triu_indices(len(drawn), 1)], np.arange(1, parts) / parts))[::-1]


def _places(s: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places from 0, in rising order, of the rows ``at`` in the ranking of ``s`` by falling similarity, ties by id."""
    marks, ranked = np.sort(-s[at]), np.sort(-s)
    low, high = np.searchsorted(ranked, marks, "left"), np.searchsorted(ranked, marks, "right")
    tied = np.unique(marks[high > low + 1])
    if len(tied) > TIES:
        wanted = np.zeros(len(s), bool)
        wanted[at] = True
        return np.flatnonzero(wanted[np.lexsort((ids, -s))])
    for mark in tied:
        equal = np.flatnonzero(-s == mark)
        equal = equal[np.argsort(ids[equal], kind="stable")]
        a, b = np.searchsorted(marks, mark, "left"), np.searchsorted(marks, mark, "right")
        low[a:b] += np.flatnonzero(np.isin(equal, at))
    return low


def _ranked(asked: dict[str, np.ndarray], blocks: Iterator[dict[str, np.ndarray]], edges: np.ndarray, best_only: bool) -> Iterator[pd.DataFrame]:
    """(query, sum, n, first) of the queries of a task: precisions at the positives that lie in its part, summed; their number; the first one's rank."""
    x, names, part = units(asked), asked["id"], int(asked["part"][0])
    top, bottom, whole = edges[part], edges[part + 1], len(edges) == 2
    known, of = np.unique(asked["label"], return_inverse=True)
    known = pd.Index(known)
    above, hits_above = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    held: list[list[tuple]] = [[] for _ in names]
    rows, ids, labels = [], [], []
    for block in blocks:
        s = x @ units(block).T
        s *= 1e12
        np.rint(s, out=s)  # 12 places, so that ties are ties whatever the summation order
        theirs = known.get_indexer(block["label"])
        s[names[:, None] == block["id"][None]] = -np.inf
        if whole:
            rows.append(s)
            ids.append(block["id"])
            labels.append(theirs)
            continue
        for q, row in enumerate(s):
            before, mine = row >= top, (row < top) & (row >= bottom)
            above[q] += before.sum()
            hits_above[q] += (theirs[before] == of[q]).sum()
            held[q].append((row[mine], block["id"][mine], theirs[mine]))
    if whole:
        every, told = np.concatenate(ids), np.concatenate(labels)
    out: list[tuple] = []
    for q, name in enumerate(names):
        if whole:
            s = np.concatenate([block[q] for block in rows])
        else:
            s, every, told = (np.concatenate(k) for k in zip(*held[q], strict=True))
        at = np.flatnonzero((told == of[q]) & (s > -np.inf))
        if not len(at):
            continue
        if best_only:
            best = s[at].max()
            equal = s == best
            first = above[q] + (s > best).sum() + (every[equal] < every[at[s[at] == best]].min()).sum() + 1
            out.append((name, 1 / first, 1, first))
            continue
        rank = above[q] + _places(s, every, at) + 1
        out.append((name, ((hits_above[q] + np.arange(1, len(at) + 1)) / rank).sum(), len(at), rank[0]))
    yield pd.DataFrame(out, columns=["query", "sum", "n", "first"]).astype({"query": "int64", "sum": "float64", "n": "int64", "first": "int64"})


def query_precision(vectors: DataFrame, block: int = 1024, best_only: bool = False) -> DataFrame:
    """(query, label, ap, first) of (id, label, vector): average precision, and the rank of the first positive, of queries that have one.

    The gallery is all other rows, by falling cosine, ties by id. Null vectors are
    left out; null labels are one label. A task has ``block`` queries at most, and
    so few that their similarities to the gallery are ``MERGED`` at most.
    ``best_only`` looks at each query's best positive alone: ``first`` is the
    same, ``ap`` has no meaning.
    """
    rows = materialize(vectors.where("vector IS NOT NULL").select("id", F.coalesce(F.col("label").cast("string"), F.lit("\0")).alias("label"), "vector"), "ranked-vectors")
    total = rows.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    edges = np.array([np.inf, *np.rint(_bounds(rows, total) * 1e12), -np.inf])
    parts = len(edges) - 1
    size = max(1, min(block, MERGED // max(1, total), max(64, -(-total // (2 * cores)))))
    n = max(1, -(-total // size))
    several = rows.groupBy("label").count().where("count > 1").select("label")
    asked = rows.join(several, "label", "left_semi").withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "task": F.pmod(F.xxhash64("id"), F.lit(n)) * parts})
    held = materialize(packed(rows), "packed-vectors")
    task = (F.col("task") + F.col("part")).cast("int")
    ranks = over_all(asked.select("id", "label", "vector", "part", "task"), task, n * parts, held, lambda a, b: _ranked(a, b, edges, best_only), "query long, sum double, n long, first long")
    found = ranks.groupBy("query").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"), F.min("first").alias("first"))
    told = vectors.select(F.col("id").alias("query"), "label")
    return found.select("query", (F.col("sum") / F.col("n")).alias("ap"), "first").join(told, "query").select("query", "label", "ap", "first")


def retrieval_metrics(vectors: DataFrame, at: tuple[int, ...] = CMC_AT, block: int = 1024) -> DataFrame:
    """One row: n_queries (with a positive), map, identity_balanced_map, cmc_<k>; of no valid query n_queries is 0 and the rest null."""
    per_query = query_precision(vectors, block)
    per_label = per_query.groupBy("label").agg(F.sum("ap").alias("ap"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("first") <= k).alias(f"c{k}") for k in at])
    return per_label.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_queries"), (F.sum("ap") / F.sum("n")).alias("map"), F.avg(F.col("ap") / F.col("n")).alias("identity_balanced_map"), *[(F.sum(f"c{k}") / F.sum("n")).alias(f"cmc_{k}") for k in at])


def with_support(vectors: DataFrame, least: int, support: DataFrame | None = None) -> DataFrame:
    """Rows of the labels that have ``least`` rows in ``support`` (label), or among themselves."""
    counts = (vectors if support is None else support).groupBy("label").count().where(F.col("count") >= least)
    return vectors.join(counts.select("label"), "label", "left_semi")


def cmc_all_queries(vectors: DataFrame, at: tuple[int, ...] = (1, 3, 5), block: int = 1024) -> DataFrame:
    """One row: cmc_<k> over all queries, the query itself standing last: for k of all rows or more, each query finds itself."""
    n = vectors.where("vector IS NOT NULL").count()
    return query_precision(vectors, block, best_only=True).agg(*[((F.lit(float(n)) if k >= n else F.count_if(F.col("first") <= k)) / F.lit(float(n)) if n else F.lit(None).cast("double")).alias(f"cmc_{k}") for k in at])


def log_sum_exp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def focal_loss(logits: Column, label: Column, gamma: float = 2.0, alpha: Column | None = None) -> Column:
    """-(1 - p)^gamma log p of the label's probability; gamma 0 is cross entropy."""
    log_p = F.get(logits, label) - log_sum_exp(logits)
    loss = -F.pow(1 - F.exp(log_p), F.lit(gamma)) * log_p
    return loss if alpha is None else alpha * loss


def cross_entropy(logits: Column, label: Column, smoothing: float = 0.0) -> Column:
    lse = log_sum_exp(logits)
    mean = F.aggregate(logits, F.lit(0.0), lambda a, v: a + v) / F.size(logits)
    return lse - (1 - smoothing) * F.get(logits, label) - smoothing * mean


def multi_margin(logits: Column, label: Column, margin: float = 1.0) -> Column:
    own = F.get(logits, label)
    over = F.transform(logits, lambda v, i: F.when(i == label, 0.0).otherwise(F.greatest(F.lit(0.0), margin - own + v)))
    return F.aggregate(over, F.lit(0.0), lambda a, v: a + v) / F.size(logits)


def arcface_logit(cosine: Column, margin: float = 0.5, scale: float = 30.0, easy: bool = False) -> Column:
    """The target's logit with an angular margin."""
    c = F.least(F.greatest(cosine, F.lit(-1 + 1e-7)), F.lit(1 - 1e-7))
    phi = c * np.cos(margin) - F.sqrt(1 - c * c) * np.sin(margin)
    kept = F.when(c > 0, phi).otherwise(c) if easy else F.when(c > np.cos(np.pi - margin), phi).otherwise(c - np.sin(np.pi - margin) * margin)
    return kept * scale


def arcface_logits(cosines: Column, label: Column, margin: float = 0.5, scale: float = 30.0, easy: bool = False) -> Column:
    """All logits, the label's with the margin; a null label leaves scaled cosines."""
    return F.transform(cosines, lambda c, i: F.when(i.eqNullSafe(label), arcface_logit(c, margin, scale, easy)).otherwise(c * scale))


def subcenter_cosines(cosines: Column) -> Column:
    """The best of each class's sub-centres, from an array per class."""
    return F.transform(cosines, F.array_max)


def combined_loss(classification: Column, metric: Column, weight: float) -> Column:
    return F.struct((classification + weight * metric).alias("total"), classification.alias("classification"), metric.alias("metric"))


LOSSES = {
    "cross_entropy": cross_entropy,
    "label_smoothing": lambda logits, label, smoothing=0.1: cross_entropy(logits, label, smoothing),
    "nll": cross_entropy,
    "focal": focal_loss,
    "multi_margin": multi_margin,
    "arcface": lambda cosines, label, **k: cross_entropy(arcface_logits(cosines, label, **k), label),
    "subcenter_arcface": lambda cosines, label, **k: cross_entropy(arcface_logits(subcenter_cosines(cosines), label, **k), label),
}


def build_loss(name: str, **options):
    """The per-row loss of a name as a function of two columns; ``triplet`` works on batches, see :func:`triplet_loss`."""
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name}; known: {', '.join(sorted(LOSSES))}")
    return lambda scores, label: LOSSES[name](scores, label, **options)


def triplet_loss(batches: DataFrame, margin: float = 0.3, mining: str = "hard", distance: str = "euclidean") -> DataFrame:
    """(batch, loss) of (batch, id, label, vector); mining is ``hard``, ``semi_hard`` or ``all``.

    A batch is a training batch: its size is the sampler's parameter, never the
    table's. Hard: mean over anchors with a positive of the farthest positive
    against the nearest negative; anchors without negatives count 0. Semi-hard:
    for each positive the nearest negative beyond it within the margin; batches
    without any fall back to hard. All: mean over triplets that violate.
    """
    if mining not in ("hard", "semi_hard", "all"):
        raise ValueError(f"unknown mining {mining}")

    def loss(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        x, labels = np.stack(rows["vector"].to_numpy()).astype(float), rows["label"].to_numpy()
        if distance == "cosine":
            unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
            d = 1 - unit @ unit.T
        else:
            d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0) + 1e-8)
        same = labels[:, None] == labels[None]
        positive, negative = same & ~np.eye(len(x), dtype=bool), ~same
        made = 0.0
        if mining == "all":
            triplets = np.maximum(d[:, :, None] - d[:, None, :] + margin, 0)[positive[:, :, None] & negative[:, None, :]]
            triplets = triplets[triplets > 1e-16]
            made = triplets.mean() if len(triplets) else 0.0
        else:
            semi = []
            if mining == "semi_hard":
                a, p = np.nonzero(positive)
                inside = np.where(negative[a] & (d[a] > d[a, p][:, None]) & (d[a] < d[a, p][:, None] + margin), d[a], np.inf).min(1, initial=np.inf)
                semi = np.maximum(d[a, p] - inside + margin, 0)[np.isfinite(inside)]
            if len(semi):
                made = semi.mean()
            elif positive.any():
                farthest = np.where(positive, d, -np.inf).max(1)
                nearest = np.where(negative, d, d.max() + 1).min(1)
                each = np.where(negative.any(1), np.maximum(farthest - nearest + margin, 0), 0)
                made = each[positive.any(1)].mean()
        return pd.DataFrame({"batch": [rows["batch"].iloc[0]], "loss": [float(made)]})

    return batches.select("batch", "id", "label", "vector").groupBy("batch").applyInPandas(loss, "batch long, loss double")


def label_ids(rows: DataFrame, label: str, into: str = "label_id") -> DataFrame:
    """``rows`` with the place of each label among the sorted distinct labels, from 0."""
    from fieldbook.operators.clean import numbered_in_order

    names = numbered_in_order(rows.where(F.col(label).isNotNull()).select(F.col(label).alias("__label")).distinct(), "__label", "__n")
    return rows.join(names, F.col(label) == F.col("__label"), "left").withColumn(into, (F.col("__n") - 1).cast("int")).drop("__label", "__n")
