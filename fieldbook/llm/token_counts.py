"""Token counts with a whole-token shortcut (operator 3).

The vocabulary is examined once, on the driver: a string that the library, given
it alone, encodes as one token is proven whole. Texts are cut into pre-tokens;
pre-tokens proven whole count one each, and only the others are merged, each
distinct one once a slice. The proof is bounded by the vocabulary and travels
with the tasks.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from fieldbook.llm.common import documents_of, fresh, per_text

#: Token counts above this are flagged.
LIMIT = 2048
#: Distinct pre-tokens a task remembers at most; then it forgets those that aren't proven whole.
REMEMBERED = 200_000


def _plain_letters() -> tuple[str, str, str]:
    """Characters below U+0250 by what the tokenizer's pattern makes of them: letters, numbers, white space."""
    kinds = {"L": "", "N": "", "Z": "\t\n\x0b\x0c\r\x85"}
    for code in range(0x250):
        if (kind := unicodedata.category(chr(code))[0]) in kinds:
            kinds[kind] += re.escape(chr(code))
    return kinds["L"], kinds["N"], kinds["Z"]


_L, _N, _S = _plain_letters()
#: Texts of these characters alone are cut by an expression of our own; NFC leaves them as they are and lower case is the same everywhere.
_FOREIGN = re.compile("[^\x00-įı-ſ–—‘’“”…€]")
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


def byte_letters() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes as."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def whole_tokens(tokenizer: Tokenizer, suffix: str = "</w>") -> frozenset[str]:
    """Strings that are one pre-token and encode as one token, proven by encoding each alone."""
    letters, words = byte_letters(), []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if token.endswith(suffix):
            try:
                words.append(bytes(letters[c] for c in token.removesuffix(suffix)).decode())
            except (KeyError, UnicodeDecodeError):
                continue
    words = [w for w in words if tokenizer.normalizer.normalize_str(w) == w]
    return frozenset(w for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True) if len(e.ids) == 1 and len(tokenizer.pre_tokenizer.pre_tokenize_str(w)) == 1)


def counter(definition: str, whole: frozenset[str], special: tuple[str, ...]) -> Callable[[list], list]:
    """The function from texts to their token counts. ``definition``: the tokenizer as JSON."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_str(definition)
    known = dict.fromkeys(whole, 1)
    specials = re.compile("|".join(map(re.escape, special))) if special else None
    back = {chr_: byte for chr_, byte in byte_letters().items()}

    def cut(text: str) -> list[str]:
        if not _FOREIGN.search(text):
            return _CUT.findall(text.lower())
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))
        return [bytes(back[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in pieces]

    def count(texts: list[str | None]) -> list[list[int]]:
        nonlocal known
        cuts, marks = [], []
        for text in texts:
            text, found = text or "", 0
            if specials and (found := len(specials.findall(text))):
                cuts.append([piece for part in specials.split(text) for piece in cut(part)])
            else:
                cuts.append(cut(text))
            marks.append(found)
        rest = list(set().union(*map(set, cuts)) - known.keys())
        if len(known) + len(rest) > len(whole) + REMEMBERED:
            known = dict.fromkeys(whole, 1)
            rest = list(set().union(*map(set, cuts)) - whole)
        for start in range(0, len(rest), 10_000):
            some = rest[start : start + 10_000]
            known.update(zip(some, (len(e.ids) for e in tokenizer.encode_batch(some, add_special_tokens=False)), strict=True))
        return [[found + sum(map(known.__getitem__, pieces)) for found, pieces in zip(marks, cuts, strict=True)]]

    return count


def count_tokens(docs: DataFrame, tokenizer_file: str, text_col: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text as a last long column ``into``.

    The name is lengthened by ``_`` where the input has such a column.

    No begin, end or padding tokens, no truncation; special strings inside a
    text count as the one token that the library makes of them. Null counts as
    empty: 0 tokens. Repeated rows count alike; an empty table stays empty.
    ``tokenizer_file`` is read by the driver.
    """
    into = fresh(into, docs.columns)
    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    whole, definition = whole_tokens(tokenizer), tokenizer.to_str()
    special = tuple(sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=lambda s: (-len(s), s)))
    shared = docs.sparkSession.sparkContext.broadcast((definition, whole, special))  # a few megabytes, bounded by the vocabulary
    make = lambda: counter(*shared.value)
    return docs.mapInArrow(per_text(make, text_col, [into], [pa.int64()]), StructType([*docs.schema.fields, StructField(into, LongType())]))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every document."""
    import public_tokenizers

    docs = documents_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
