"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text (operator 8).

Text and lexicon are folded alike: lower case, accents and invisible characters
dropped, homoglyphs of other scripts, and digits and signs that touch letters,
mapped to the Latin letters they stand for (l and 1 fold to i). Numbers stay
numbers. Words of the lexicon, and words that begin with one of its stems, add
their weights, except inside an exception phrase; the sum is divided by a slowly
growing function of the length, and a logistic curve turns it into a score.
Weights, exception phrases and curve are learned from labelled rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fieldbook.llm.common import documents_of, fresh, held_out, per_text, sample_labels, slices
from fieldbook.session import materialize

#: Most labelled rows that a model is fitted on, chosen by a hash of doc_id.
FIT_ROWS = 30_000
#: Most candidate terms, and most learned phrases, that reach the driver.
CANDIDATES = 20_000

#: Harmless phrases that hold whatever the labels say; more are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "idiot proof", "pond scum")

# Characters and the Latin letters that they pass for.
_PASS_FOR = dict(
    zip(
        "авеёкмнорстухіјѕԁһԛԝґєӏ" "αβεηικνορτυχωγϲϳ" "օսոհցզ" "ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ" "ıłøđħŧɑɡɩʋ",
        "abeekmhopctyxijsdhqwrei" "abenikvoptuxwycj" "ounhgq" "abcdefghijkimnoprstuvwyz" "iiodhtagiv",
        strict=True,
    )
)
_DIGITS = str.maketrans("0134579", "oieastg")
_SIGNS = str.maketrans("@$!|€", "asiie")
#: Invisible characters, which only split words.
_INVISIBLE = (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370))
#: Blocks whose characters decompose to Latin letters: accents, letter-like, enclosed, full-width and mathematical ones.
_DECOMPOSED = ((0xC0, 0x250), (0x1E00, 0x1F00), (0x2100, 0x2150), (0x249C, 0x24EA), (0xFF01, 0xFF5F), (0x1D400, 0x1D7D0))


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for code in (code for first, last in _DECOMPOSED for code in range(first, last)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if plain != chr(code):
            table[code] = plain.replace("l", "i")
    table |= {ord(k): v for k, v in _PASS_FOR.items()}
    return table | dict.fromkeys(_INVISIBLE) | {ord("l"): "i"}


_FOLD = _table()
_LETTER = r"[^\W\d_]"
_INSIDE = re.compile(rf"(?<={_LETTER})[@$!|€]+(?=\w)|(?<=\w)[@$!|€]+(?={_LETTER})")
_TOUCHING = re.compile(rf"(?<={_LETTER})[0-9]+|[0-9]+(?={_LETTER})")
_WORD = re.compile(f"{_LETTER}+")


def fold(text: str | None) -> str:
    """Lower case, with look-alikes replaced; null folds to the empty text."""
    text = (text or "").lower()
    text = _INSIDE.sub(lambda m: m[0].translate(_SIGNS), text)
    return _TOUCHING.sub(lambda m: m[0].translate(_DIGITS), text.translate(_FOLD))


def terms(text: str) -> set[str]:
    """The words of a folded text, and their stems of four to six letters, marked by ``*``."""
    found = set(_WORD.findall(text))
    return found | {f"{w[:k]}*" for w in found for k in (4, 5, 6) if len(w) > k}


def sketch(text: str) -> int:
    """The least hash among the text's word triples: mostly equal for near copies, hardly ever for others."""
    words = text.split()
    return min((xxhash.xxh3_64_intdigest("\x00".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) - (1 << 63)


@dataclass(frozen=True)
class Model:
    """Folded terms with weights, folded exception phrases, and the curve: slope and offset."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float = 1.0
    offset: float = -2.0

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), False, None))
        for term, weight in self.weights.items():
            plain, stem = term.rstrip("*"), term.endswith("*")
            before = found.get(plain, (0, False, 0.0))
            found.add_word(plain, (len(plain), stem or before[1], max(weight, before[2] or 0.0)))
        if len(found) == 0:
            return None
        found.make_automaton()
        return found

    def measure(self, texts: list[str | None]) -> np.ndarray:
        """The normalised lexicon weight of each text."""
        automaton = self.automaton()
        return np.array([_weigh(automaton, fold(t)) for t in texts], float)

    def curve(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * measures + self.offset, -50, 50)))


def _hits(automaton: ahocorasick.Automaton | None, text: str) -> tuple[list[tuple[int, int, float]], list[tuple[int, int]]]:
    """Where lexicon words (with weights) and exception phrases stand in a folded text, as first and last place."""
    hits, safe, n = [], [], len(text)
    for end, (length, stem, weight) in automaton.iter(text) if automaton else ():
        start = end - length + 1
        if start and text[start - 1].isalpha():
            continue
        after = end + 1 + (text[end + 1 : end + 2] == "s")  # a plural counts as the word
        if not stem and after < n and text[after].isalpha():
            continue
        if weight is None:
            safe.append((start, end))
        else:
            hits.append((start, end, weight))
    return hits, safe


def _weigh(automaton: ahocorasick.Automaton | None, text: str) -> float:
    hits, safe = _hits(automaton, text)
    safe.sort()
    firsts, reach = [a for a, _ in safe], list(accumulate((b for _, b in safe), max))  # how far the phrases reach that begin by then
    total = 0.0
    for start, end, weight in hits:
        k = bisect_right(firsts, start)
        if not k or reach[k - 1] < end:
            total += weight
    return np.log1p(total / (1 + np.log1p(len(text) / 2000)))


def _phrases(model: Model):
    """A function from batches of (text, label) to (phrase, toxic, clean): lexicon words with the word before or after them, counted by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                    text, found = fold(text), set()
                    hits, _ = _hits(automaton, text)
                    words = list(_WORD.finditer(text)) if hits else []
                    starts = [w.start() for w in words]
                    for start, _, _ in hits:
                        k = bisect_right(starts, start) - 1
                        for i in (k - 1, k):
                            if 0 <= i < len(words) - 1 and text[words[i].end() : words[i + 1].start()] == " ":
                                found.add(text[words[i].start() : words[i + 1].end()])
                    (toxic if label else clean).update(found)
                if len(toxic) + len(clean) > 300_000:
                    yield _counted("phrase", toxic, clean)
        yield _counted("phrase", toxic, clean)

    return run


def _counted(name: str, toxic: Counter, clean: Counter) -> pa.RecordBatch:
    """Both counters as rows; they are emptied."""
    names = list(toxic.keys() | clean.keys())
    made = pa.RecordBatch.from_pydict({name: pa.array(names, pa.string()), "toxic": pa.array([toxic[w] for w in names], pa.int64()), "clean": pa.array([clean[w] for w in names], pa.int64())})
    toxic.clear()
    clean.clear()
    return made


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word how many toxic and clean documents hold it, summed over some hundred thousand words at a time."""
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for part in slices(batch, "text"):
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                (toxic if label else clean).update(terms(fold(text)))
                if len(toxic) + len(clean) > 300_000:
                    yield _counted("word", toxic, clean)
    yield _counted("word", toxic, clean)


def _choose(found: list[np.ndarray], t: np.ndarray, c: np.ndarray, n_clean: int, words: list[str], covers: int = 3, least_share: float = 0.03) -> dict[str, float]:
    """Terms that explain toxic documents, greedily, until each has ``covers`` terms or no term explains enough more.

    ``found``: the candidate terms of each toxic document; ``t`` and ``c``: how
    many toxic and clean documents hold each. Terms that merely occur in
    documents explained already are left out. A stem must explain clearly more
    than a word.
    """
    n_toxic = len(found)
    odds = np.log((t + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1))
    favour = np.array([0.85 if w.endswith("*") else 1.0 for w in words])
    row, word = np.repeat(np.arange(n_toxic), [len(f) for f in found]), np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
    by_word = np.argsort(word, kind="stable")
    rows, ends = row[by_word], np.searchsorted(word[by_word], np.arange(len(words) + 1))
    weights, need, least = {}, np.full(n_toxic, covers), 0.0
    open_ = np.ones(len(words), bool)
    while len(words):
        gain = (np.bincount(word[need[row] > 0], minlength=len(words)) - c) * favour * open_
        best = int(np.lexsort((np.arange(len(words)), -t, -gain))[0])
        least = least or max(2.0, least_share * gain[best])
        if gain[best] < least:
            break
        weights[words[best]] = float(odds[best])
        need[rows[ends[best] : ends[best + 1]]] -= 1
        # Longer and shorter forms of a chosen term would only count it again.
        form = words[best].rstrip("*")
        open_ &= np.array([not (w.startswith(form) if words[best].endswith("*") else w == form or form.startswith(w.rstrip("*")) and w.endswith("*")) for w in words])
    return weights


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, candidates: int = CANDIDATES, exceptions: tuple[str, ...] = EXCEPTIONS, seed: int = 8) -> Model:
    """Fit on (doc_id, text) rows that ``labels`` (doc_id, label 0 or 1) covers, about ``fit_rows`` at most.

    Near copies count once. Words and stems that three toxic rows hold, and clean
    rows an eighth as often at most, are candidates: the ``candidates`` held by
    most toxic rows, so that what reaches the driver is bounded. A lexicon word and its neighbour are an exception phrase
    where clean rows hold both together, and toxic rows next to never. Without
    toxic rows the lexicon is empty and every score the same low one.
    """
    sample = docs.join(F.broadcast(sample_labels(labels, fit_rows, seed)), "doc_id").select("text", (F.col("label") > 0).cast("int").alias("label"))
    sketched = sample.mapInArrow(per_text(lambda: lambda texts: [[sketch(fold(t)) for t in texts]], "text", ["sketch"], [pa.int64()]), "text string, label int, sketch long")
    sample = materialize(sketched.groupBy("sketch", "label").agg(F.min("text").alias("text")).select("text", "label"), "toxic-sample")
    counts = sample.mapInArrow(_document_words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    kept = counts.where("t >= 3 AND t >= 8 * c").orderBy(F.col("t").desc(), "c", "word").limit(candidates).collect()
    words = [r["word"] for r in kept]
    place = {w: i for i, w in enumerate(words)}

    def presence(texts: list[str | None]) -> list[list]:
        return [[sorted(place[w] for w in terms(fold(t)) if w in place) for t in texts]]

    found = sample.where("label = 1").mapInArrow(per_text(lambda: presence, "text", ["found"], [pa.list_(pa.int32())], []), "found array<int>").collect()
    n_clean = sample.where("label = 0").count()
    safe = tuple(fold(p) for p in exceptions)
    chosen = _choose([np.array(r["found"], np.int64) for r in found], np.array([r["t"] for r in kept], float), np.array([r["c"] for r in kept], float), n_clean, words)
    model = Model(chosen, safe)
    told = sample.mapInArrow(_phrases(model), "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    learned = sorted(r["phrase"] for r in told.where("c >= 3 AND c >= 8 * t").orderBy(F.col("c").desc(), "phrase").limit(candidates).collect())
    model = Model(chosen, tuple(dict.fromkeys((*safe, *learned))))
    measured = sample.mapInArrow(per_text(lambda: lambda texts: [model.measure(texts)], "text", ["x"], [pa.float64()], ["label"]), "label int, x double").toArrow().to_pandas().sort_values(["x", "label"])
    return Model(chosen, model.exceptions, *_logistic(measured["x"].to_numpy(float), measured["label"].to_numpy(float)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """Slope and offset by Newton's method; a little ridge keeps separable labels finite."""
    if not len(x):
        return 1.0, -2.0
    design, b = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -50, 50)))
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        b = b + np.linalg.solve(curve, design.T @ (y - p) - ridge * b)
    return float(b[0]), float(b[1])


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the toxicity of each whole text, 0 to 1, as a last column ``into``.

    The name is lengthened by ``_`` where the input has such a column. A score
    depends on the text alone; null counts as empty, repeated rows score alike,
    an empty table stays empty.
    """

    def make():
        automaton = model.automaton()
        return lambda texts: [model.curve(np.array([_weigh(automaton, fold(t)) for t in texts], float))]

    into = fresh(into, docs.columns)
    return docs.mapInArrow(per_text(make, text_col, [into], [pa.float64()]), StructType([*docs.schema.fields, StructField(into, DoubleType())]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    docs = documents_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col("toxic").alias("label"))
    out = score(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
