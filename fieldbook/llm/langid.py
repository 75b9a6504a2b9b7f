"""Language identification with string kernels (operator 2).

The blended-spectrum presence kernel of two texts counts the byte n-grams of
lengths 1 to 4 that both hold, divided by the root of the product of how many
each holds. Landmark texts give a Nyström map of that kernel, and one-versus-rest
kernel ridge regression in the mapped space gives a score for each language.

As the kernel is a product of presence vectors, landmarks, map and ridge weights
fold into one matrix (n-gram slots by languages) when the model is fitted;
scoring is a batched product of presence rows with it, divided by their norms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fieldbook.llm.common import documents_of, fresh, held_out, per_text
from fieldbook.session import materialize

#: Rows fitted on: for each language, and in all (two of each language at least).
FIT_ROWS, MOST_ROWS = 600, 120_000
#: Landmarks: for each language, and in all.
LANDMARKS, MOST_LANDMARKS = 48, 2_048
#: Tasks that add up the normal equations; each sends one matrix of landmarks by landmarks.
SUMS = 8
#: n-grams are hashed to this many slots (a power of two); lengths 1 to LONGEST.
SLOT_BITS, LONGEST = 15, 4

_OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; digits of any kind, such as ½ and ², are not."""
    return bool(text) and any(map(str.isalpha, text))


def _slots(text: str) -> np.ndarray:
    """The distinct n-gram slots of a text: lower case, everything but letters one blank."""
    raw = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    seen = np.zeros(1 << SLOT_BITS, bool)
    code = raw
    for n in range(1, LONGEST + 1):
        if n > 1:
            if len(code) < 2:
                break
            code = (code[:-1] << np.uint32(8)) | raw[n - 1 :]
        seen[((code + np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)] = True
    return np.flatnonzero(seen)


def _rows(slots: list[np.ndarray]) -> np.ndarray:
    """A row for each list of slots: 1 over the root of their number where an n-gram is present."""
    out = np.zeros((len(slots), 1 << SLOT_BITS), np.float32)
    for row, own in zip(out, slots, strict=True):
        row[own] = 1 / np.sqrt(len(own))
    return out


def presence(texts: list[str]) -> np.ndarray:
    return _rows([_slots(text) for text in texts])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # slots by languages
    offset: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and its score for each text; ``und`` and 0 for texts without letters."""
        told, sure = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for some in (at[k : k + 64] for k in range(0, len(at), 64)):
            scores = presence([texts[i] for i in some]) @ self.weights + self.offset
            odds = np.exp(8 * (scores - scores.max(1, keepdims=True)))
            best = scores.argmax(1)
            for i, b, p in zip(some, best.tolist(), (odds.max(1) / odds.sum(1)).tolist(), strict=True):
                told[i], sure[i] = self.languages[b], float(p)
        return told, sure


def nystroem(marks: np.ndarray) -> np.ndarray:
    """From kernel values with the landmarks (their presence rows) to Nyström features."""
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    keep = values > 1e-6 * values.max()
    return vectors[:, keep] / np.sqrt(values[keep])


@dataclass
class Sums:
    """What ridge regression needs of mapped rows z of weight w: sums of w z z', of w z by language, of w by language."""

    square: np.ndarray
    linear: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(z: np.ndarray, lang: np.ndarray, weight: np.ndarray, languages: int) -> Sums:
        at = np.zeros((languages, len(z)))
        at[lang, np.arange(len(z))] = weight
        return Sums((z * weight[:, None]).T @ z, at @ z, at.sum(1))

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.square + other.square, self.linear + other.linear, self.weight + other.weight)


def solve(languages: tuple[str, ...], marks: np.ndarray, to_map: np.ndarray, sums: Sums, ridge: float) -> Model:
    """One-versus-rest ridge regression on +1 and -1, folded with the map and the landmarks into one matrix."""
    total = sums.weight.sum()
    centre = sums.linear.sum(0) / total
    middle = (2 * sums.weight - total) / total
    square = sums.square - total * np.outer(centre, centre)
    cross = 2 * (sums.linear - sums.weight[:, None] * centre).T  # the rows' deviations times target, the constant part cancels
    beta = np.linalg.solve(square + ridge * np.eye(len(square)), cross)
    return Model(languages, (marks.T @ (to_map @ beta)).astype(np.float32), (middle - centre @ beta).astype(np.float32))


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-3) -> Model:
    """The model of a few texts in one process, their first ``landmarks`` of each language being the landmarks; see :func:`train`."""
    languages = tuple(sorted(set(langs)))
    chosen = [t for lang in languages for t in [t for t, own in zip(texts, langs, strict=True) if own == lang][:landmarks]]
    marks = presence(chosen)
    to_map = nystroem(marks)
    lang = np.searchsorted(languages, langs)
    weight = 1 / np.bincount(lang)[lang]
    return solve(languages, marks, to_map, Sums.of((presence(texts) @ marks.T) @ to_map, lang, weight, len(languages)), ridge)


def _sampled(docs: DataFrame, fit_rows: int, most_rows: int, seed: int) -> tuple[DataFrame, int]:
    """(lang, order, slots) of a bounded number of rows of each language, drawn by a hash of doc_id and text; and how many languages there are."""
    docs = docs.where("lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = materialize(docs.groupBy("lang").count(), "langid-counts")
    n = counts.count()
    each = min(fit_rows, max(2, most_rows // max(n, 1)))
    slots = 1 << 30
    chance = counts.select("lang", (F.least(F.lit(1.0), F.lit(2.0 * each) / F.col("count")) * slots).alias("chance"))
    drawn = docs.join(F.broadcast(chance) if n <= most_rows else chance, "lang").withColumn("u", F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(slots))).where("u < chance")
    order = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", "text"))
    chosen = drawn.withColumn("order", order).where(F.col("order") <= each).select("lang", "order", "text")
    work = per_text(lambda: lambda texts: [[_slots(t) if has_letter(t) else None for t in texts]], "text", ["slots"], [pa.list_(pa.int32())], ["lang", "order"])
    made = chosen.mapInArrow(work, "lang string, order int, slots array<int>").where("slots IS NOT NULL")
    return materialize(made, "langid-sample"), n


def train(docs: DataFrame, fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS, most_rows: int = MOST_ROWS, most_landmarks: int = MOST_LANDMARKS, ridge: float = 1e-3, seed: int = 2) -> Model:
    """Fit on (doc_id, text, lang): every language, ``fit_rows`` rows of each at most, ``most_rows`` in all.

    Rows with null lang or texts without letters teach nothing; repeated rows are
    rows. Texts become n-gram slots in tasks. The driver gets the landmarks'
    slots and ``SUMS`` matrices of landmarks by landmarks, never a text.
    """
    sample, n = _sampled(docs, fit_rows, most_rows, seed)
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}  # one row a language
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((1 << SLOT_BITS, 0), np.float32), np.zeros(0, np.float32))
    each = min(landmarks, max(1, most_landmarks // len(languages)))
    chosen = sample.where(F.col("order") <= each).orderBy("order", "lang").limit(most_landmarks).select("slots").collect()
    if not chosen:
        chosen = sample.orderBy("order", "lang").limit(most_landmarks).select("slots").collect()
    own = [np.array(r["slots"], np.int64) for r in chosen]
    spark = docs.sparkSession
    marks = _rows(own)
    to_map = nystroem(marks)
    shared = spark.sparkContext.broadcast((own, to_map, languages, sizes))  # bounded by the landmarks and one number a language

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, to_map, languages, sizes = shared.value
        marks, place = _rows(own), {lang: i for i, lang in enumerate(languages)}
        r = to_map.shape[1]
        square, linear, weight = np.zeros((r, r)), {}, {}
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                names = part.column("lang").to_pylist()
                z = (_rows([s.values.to_numpy() for s in part.column("slots")]) @ marks.T) @ to_map
                w = np.array([1 / sizes[lang] for lang in names])  # each language counts alike
                square += (z * w[:, None]).T @ z
                for lang, row, one in zip(names, z, w, strict=True):
                    linear[place[lang]] = linear.get(place[lang], 0) + row * one
                    weight[place[lang]] = weight.get(place[lang], 0.0) + one
        yield pa.RecordBatch.from_pydict({"lang": pa.array([-1, *linear], pa.int32()), "weight": pa.array([0.0, *weight.values()], pa.float64()), "values": pa.array([square.tobytes(), *(v.tobytes() for v in linear.values())], pa.binary())})

    r = to_map.shape[1]
    total = Sums(np.zeros((r, r)), np.zeros((len(languages), r)), np.zeros(len(languages)))
    for row in sample.repartition(SUMS, F.xxhash64("lang", "order")).mapInArrow(add, "lang int, weight double, values binary").collect():
        if row["lang"] < 0:
            total.square += np.frombuffer(row["values"]).reshape(r, r)
        else:
            total.linear[row["lang"]] += np.frombuffer(row["values"])
            total.weight[row["lang"]] += row["weight"]
    return solve(languages, marks, to_map, total, ridge)


def identify(docs: DataFrame, model: Model, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its score (0 to 1) of each whole text, as two last columns.

    They are named ``into``, lengthened by ``_`` where the input has such a
    column. A prediction depends on the text alone. Null texts and texts without
    letters, and all texts if nothing was learned, are ``und`` with score 0;
    repeated rows are alike; an empty table stays empty.
    """
    names = [fresh(n, docs.columns) for n in into]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots by languages
    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return docs.mapInArrow(per_text(lambda: lambda texts: shared.value.predict(texts), text_col, names, [pa.string(), pa.float64()]), schema)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = held_out(F.col("doc_id"), 5, 0)
    model = train(docs.where(~held).select("doc_id", "text", "lang"))
    return identify(documents_of(docs, "doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
