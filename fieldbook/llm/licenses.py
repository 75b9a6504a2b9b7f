"""Licence scans over a positional index of rare words (operator 4).

Templates are licence phrases and notices. How many documents hold each template
word is counted over the whole corpus; a template is looked up by its word of
highest inverse document frequency. Where that word stands in a file, the
template's other words are intersected by their position relative to it, and a
notice that agrees well enough is confirmed by its mandatory key phrases.
Base phrases must stand word by word; notices may differ in some words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from fieldbook.llm.common import documents_of, fresh, per_text, slices

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Notice:
    """A template: label, wording, phrases that must stand in it, share of its words that must agree by position."""

    label: str
    wording: str
    keys: tuple[str, ...]
    least: float = 0.7


#: Notices of our own choosing, worded as licences ask to be announced.
NOTICES = (
    Notice("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    Notice("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Notice("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Notice("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Notice("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Notice("mit-notice", "released under the mit license", ("mit license",)),
    Notice("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Notice("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Notice("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

#: Bytes that words are made of: digits, lower-case letters, everything outside ASCII.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_WORD = rb"[0-9a-z\x80-\xff]"


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only


def vocabulary(base: dict[str, str], notices: tuple[Notice, ...]) -> list[str]:
    return sorted({w for t in [*base, *(n.wording for n in notices)] for w in t.split()})


def document_frequencies(docs: DataFrame, words: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that hold each of ``words``, over the whole corpus. One row per word comes back."""
    finder = re.compile(rb"(?<!%b)(?:%b)(?!%b)" % (_WORD, b"|".join(re.escape(w.encode()) for w in sorted(words, key=lambda w: (-len(w), w))), _WORD))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = 0, dict.fromkeys(words, 0)
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    total += 1
                    for w in set(finder.findall(_bytes(text))):
                        held[w.decode()] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(["", *held], pa.string()), "n": pa.array([total, *held.values()], pa.int64())})

    rows = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found.pop("", 0), {w: found.get(w, 0) for w in words}


def scanner(base: dict[str, str], notices: tuple[Notice, ...], n_docs: int, held: dict[str, int]) -> Callable[[list], list]:
    """The function from texts to columns: n_words, base spans (label, start), notice spans, score."""
    weight = {w: np.log((n_docs + 1) / (n + 0.5)) for w, n in held.items()}
    templates = [(label, phrase.split(), None) for phrase, label in base.items()] + [(n.label, n.wording.split(), n) for n in notices]
    postings: dict[bytes, list[tuple[int, int]]] = {}
    encoded = [[w.encode() for w in words] for _, words, _ in templates]
    for i, (_, words, _) in enumerate(templates):
        # A notice is found by its rarest key word, so that an edited word elsewhere cannot hide it.
        pool = words if templates[i][2] is None else [w for k in templates[i][2].keys for w in k.split() if w in words]
        rare = max(pool, key=lambda w: (weight[w], w))
        for at, w in enumerate(words):
            if w == rare:
                postings.setdefault(w.encode(), []).append((i, at))
    anchor = re.compile(rb"(?<!%b)(?:%b)(?!%b)" % (_WORD, b"|".join(sorted(map(re.escape, postings), key=lambda w: (-len(w), w))), _WORD))
    totals = [sum(weight[w] for w in words) for _, words, _ in templates]
    keys = [[[w.encode() for w in k.split()] for k in n.keys] if n else [] for _, _, n in templates]

    def stands(phrase: list[bytes], words: list[bytes]) -> bool:
        return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))

    def scan(texts: list[str | None]) -> list[list]:
        counts, bases, found, scores = [], [], [], []
        for text in texts:
            raw = _bytes(text)
            mask = _IS_WORD[np.frombuffer(raw, np.uint8)]
            edge = np.flatnonzero(np.diff(mask, prepend=False, append=False)) if len(raw) else np.zeros(0, int)
            starts, ends = edge[::2], edge[1::2]
            counts.append(len(starts))
            here, own, score = set(), {}, 0.0
            if hits := [(m.start(), m[0]) for m in anchor.finditer(raw)]:
                word = lambda k: raw[starts[k] : ends[k]]
                n = len(starts)
                for k, w in zip(np.searchsorted(starts, [p for p, _ in hits]).tolist(), (w for _, w in hits), strict=True):
                    for i, at in postings[w]:
                        first, size = k - at, len(encoded[i])
                        label, _, notice = templates[i]
                        if notice is None:
                            if first >= 0 and first + size <= n and all(word(first + j) == encoded[i][j] for j in range(size)):
                                here.add((label, first))
                                score = 1.0
                            continue
                        window = [word(j) if 0 <= j < n else b"" for j in range(first, first + size)]
                        agree = sum(weight[templates[i][1][j]] for j in range(size) if window[j] == encoded[i][j]) / totals[i]
                        if agree >= notice.least and all(stands(key, window) for key in keys[i]):
                            own[(label, max(first, 0))] = agree
                            score = max(score, agree)
            bases.append([{"label": a, "start": b} for a, b in sorted(here, key=lambda x: (x[1], x[0]))])
            found.append([{"label": a, "start": b} for a, b in sorted(own, key=lambda x: (x[1], x[0]))])
            scores.append(float(min(1.0, score)))
        return [counts, bases, found, scores]

    return scan


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
_SPAN_TYPE = ArrayType(StructType([StructField("label", StringType()), StructField("start", LongType())]))


def scan_licenses(docs: DataFrame, text_col: str = "text", base: dict[str, str] | None = None, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """``docs`` with n_words, base (places of base phrases), notices (places of notices), evidence (0 to 1) as last columns.

    Their names are lengthened by ``_`` where the input has such columns. Repeated
    rows are alike; texts are scanned whole, whatever their length.
    A place is (label, start), words counted from 0. Evidence is the best share
    of a template's inverse document frequency that stands in place, 1 for a base
    phrase. Null counts as empty; of an empty table the result is empty.
    """
    base = BASE if base is None else base
    n_docs, held = document_frequencies(docs, vocabulary(base, notices), text_col)
    names = [fresh(n, docs.columns) for n in ("n_words", "base", "notices", "evidence")]
    kinds = (LongType(), _SPAN_TYPE, _SPAN_TYPE, DoubleType())
    schema = StructType([*docs.schema.fields, *(StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    return docs.mapInArrow(per_text(lambda: scanner(base, notices, n_docs, held), text_col, names, [pa.int64(), _SPANS, _SPANS, pa.float64()]), schema)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every document."""
    found = scan_licenses(documents_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "notices.label")).alias("labels"),
        F.col("evidence").alias("score"),
    )


def _op4_sql() -> str:
    """The same by brute force over every alignment of every template; for small tables."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = [f"('{label}', {quoted(phrase.split())}, NULL, 1.0)" for phrase, label in BASE.items()]
    rows += [f"('{n.label}', {quoted(n.wording.split())}, {quoted(n.keys)}, {n.least})" for n in NOTICES]
    return rf"""
WITH t(label, ws, keys, least) AS (VALUES {", ".join(rows)}),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
v AS (SELECT DISTINCT unnest(ws) AS word FROM t),
f AS MATERIALIZED (SELECT word, ln(((SELECT count(*) FROM d) + 1) / ((SELECT count(*) FROM d WHERE list_contains(w, word)) + 0.5)) AS idf FROM v),
k AS (SELECT label, arg_max(word, (idf, word)) AS rare FROM (SELECT label, unnest(CASE WHEN keys IS NULL THEN ws ELSE string_split(array_to_string(keys, ' '), ' ') END) AS word FROM t) JOIN f USING (word) GROUP BY label),
tt AS MATERIALIZED (SELECT t.*, rare FROM t JOIN k USING (label)),
a AS (SELECT DISTINCT doc_id, label, ws, keys, least, p - q AS first, list_transform(range(1, len(ws) + 1), lambda j: coalesce(CASE WHEN p - q + j >= 1 THEN w[p - q + j] END, '')) AS seen FROM (SELECT d.doc_id, d.w, tt.*, unnest(range(1, len(d.w) + 1)) AS p FROM d JOIN tt ON list_contains(d.w, rare)) x, (SELECT unnest(range(1, 40)) AS q) y WHERE w[p] = rare AND q <= len(ws) AND ws[q] = rare),
m AS (SELECT doc_id, label, keys, first, least, ' ' || array_to_string(seen, ' ') || ' ' AS window_text, (SELECT sum(CASE WHEN seen[j] = ws[j] THEN idf ELSE 0 END) / sum(idf) FROM (SELECT unnest(range(1, len(ws) + 1)) AS j) JOIN f ON word = ws[j]) AS agree, seen = ws AS whole FROM a),
b AS (SELECT doc_id, label, first FROM m WHERE keys IS NULL AND whole),
o AS (SELECT doc_id, label, agree FROM m WHERE keys IS NOT NULL AND agree >= least AND len(list_filter(keys, lambda x: NOT contains(window_text, ' ' || x || ' '))) = 0),
bb AS (SELECT doc_id, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(s) AS score FROM (SELECT doc_id, label, 1.0::DOUBLE AS s FROM b UNION ALL SELECT doc_id, label, least(agree, 1.0)::DOUBLE FROM o) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN al USING (doc_id)
"""


OP4_SQL = _op4_sql()
