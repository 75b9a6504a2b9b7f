"""Quality classifier: a regularised quadratic discriminant over document statistics (operator 10).

Each whole text becomes a vector of transformed statistics. Both classes get a
mean and a covariance, shrunk towards the pooled covariance and towards a scaled
identity. The Cholesky factors of the two covariances are computed once, kept in
the model, and a batch is scored by two triangular products: the score is the
logistic of the difference of the log densities, prior included.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fieldbook.llm.common import documents_of, fresh, held_out, per_text, sample_labels

#: Most labelled rows that a model is fitted on, chosen by a hash of doc_id.
FIT_ROWS = 30_000

STATISTICS = ("log words", "word length", "upper case", "symbols", "punctuation", "digits", "bars", "repeated neighbours", "distinct words", "commonest word", "words ending in symbols", "long words", "line length", "non-ASCII")

_KIND = np.zeros(256, np.uint8)
_KIND[np.frombuffer(bytes(range(65, 91)), np.uint8)] = 1
_KIND[np.frombuffer(bytes(range(97, 123)), np.uint8)] = 2
_KIND[np.frombuffer(b"0123456789", np.uint8)] = 3
_KIND[np.frombuffer(b".,;:?'\"()-", np.uint8)] = 4
_KIND[np.frombuffer(b"!#$%&*+/<=>@[\\]^_`{}~", np.uint8)] = 5
_KIND[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = 6
_KIND[124] = 7
_KIND[128:] = 8


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of :data:`STATISTICS` for each text, logarithms of smoothed shares; null counts as empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(raw), len(STATISTICS)))
    for row, text in zip(out, raw, strict=True):
        n = len(text)
        kinds = _KIND[np.frombuffer(text, np.uint8)]
        count = np.bincount(kinds, minlength=9)
        words = text.split()
        m = len(words)
        tops = Counter(words)
        common = max(tops.values(), default=0)
        same = sum(map(eq, words, islice(words, 1, None)))
        starts = np.flatnonzero((kinds[1:] == 6) & (kinds[:-1] == 5)).size + (n > 0 and kinds[-1] == 5)
        letters = count[1] + count[2] + count[8]
        lines = text.count(b"\n") + 1
        # Counts of short texts are drawn to those of clean prose by some pseudo-words.
        row[:] = (
            np.log(m + 20),
            np.log((n - count[6] + 100) / (m + 20)),
            np.log(0.01 + count[1] / (letters + 100)),
            np.log(0.001 + count[5] / (n + 100)),
            np.log(0.01 + count[4] / (n + 100)),
            np.log(0.01 + count[3] / (n + 100)),
            np.log(0.001 + count[7] / (m + 20)),
            np.log(0.01 + same / (m + 20)),
            np.log((len(tops) + 20) / (m + 20)),
            np.log((common + 1) / (m + 20)),
            np.log(0.01 + starts / (m + 20)),
            np.log(0.001 + sum(c for w, c in tops.items() if len(w) > 24) / (m + 20)),
            np.log(n / lines + 100),
            np.log(0.01 + count[8] / (n + 100)),
        )
    return out


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors, log determinants and log priors; index 1 is label 1."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        z = (x - self.centre) / self.scale
        density = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = 0.1, to_identity: float = 0.05) -> Discriminant:
    """Fit to rows ``x`` with labels ``y``; a class without rows takes the pooled shape and half a row of prior."""
    d = x.shape[1]
    centre, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(d), np.ones(d))
    z = (x - centre) / scale
    pooled = np.cov(z, rowvar=False, bias=True) if len(z) > 1 else np.eye(d)
    means, factors, constants = [], [], []
    for label in (0, 1):
        own = z[y == label]
        mean = own.mean(0) if len(own) else np.zeros(d)
        shape = np.cov(own, rowvar=False, bias=True) if len(own) > 1 else pooled
        shape = (1 - to_pooled) * shape + to_pooled * pooled
        shape = (1 - to_identity) * shape + to_identity * max(np.trace(shape) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(shape)
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log((len(own) + 0.5) / (len(y) + 1)) - np.log(np.diag(lower)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(factors), np.array(constants))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 5) -> Discriminant:
    """Fit on (doc_id, text) rows that ``labels`` (doc_id, label 0 or 1) covers, about ``fit_rows`` at most.

    The sample's statistics, a hundred bytes a row, come to the driver.
    """
    sample = docs.join(F.broadcast(sample_labels(labels, fit_rows, seed)), "doc_id").select("text", F.col("label").cast("int").alias("label"))
    names = [f"s{i}" for i in range(len(STATISTICS))]
    schema = ", ".join(["label int", *(f"{n} double" for n in names)])
    rows = sample.mapInArrow(per_text(lambda: lambda texts: list(statistics(texts).T), "text", names, [pa.float64()] * len(names), ["label"]), schema).toArrow().to_pandas()
    rows = rows.sort_values([*names, "label"])  # a fit that doesn't depend on the order of arrival
    return fit(rows[names].to_numpy(float).reshape(-1, len(names)), rows["label"].to_numpy(int))


def score(docs: DataFrame, model: Discriminant, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text as a last double column ``into``.

    The name is lengthened by ``_`` where the input has such a column. A score
    depends on the text alone. Null and empty texts, and repeated rows, are
    scored like any other; an empty table stays empty.
    """
    into = fresh(into, docs.columns)
    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])
    return docs.mapInArrow(per_text(lambda: lambda texts: [model.score(statistics(texts))], text_col, [into], [pa.float64()]), schema)


def quality_labels(labels: DataFrame, name: str = "quality") -> DataFrame:
    """(doc_id, label) without the rows that op10 holds out."""
    return labels.where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", F.col(name).alias("label"))


def drop_rejected(docs: DataFrame, labelled: DataFrame, labels: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` whose score reaches ``least``, columns unchanged; the model is fitted on ``labelled`` (doc_id, text).

    Null and empty texts are scored like any other, repeated rows stay or go
    together, a score equal to ``least`` stays, an empty table stays empty, and
    without labels every row stays; columns of any name are kept.
    """
    into = fresh("score", docs.columns)
    return score(docs, train(labelled, labels), text_col, into).where(F.col(into) >= least).select(*docs.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    docs = documents_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    model = train(docs, quality_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
