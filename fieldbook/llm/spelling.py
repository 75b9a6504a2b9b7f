"""Spelling variants: words one edit apart, grouped under their most frequent form (operator 12).

Two words one edit apart share what stands before the edit or what stands after
it, up to the middle of the shorter. So words are dealt by their first and by
their last half, and a group that is still large is dealt again by the halves of
what is left of it, until little is left: no group is unbounded and none is cut.
In a group the rest of the words is a trie. Along its heavy paths the light
subtrees are merged, with one character replaced or skipped, into the heavy child
or into each other; words that end in the same place are one edit apart. Each
edge is walked once for every light subtree that holds it, so a group of n
characters takes n log n steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm.common import bounded_broadcast, pair_counts, runs_in, slices
from fieldbook.session import materialize

#: Of the runs whose hash this divides one code point goes; code points and occurrences that a word needs.
EVERY, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
#: Characters in a group beyond which it is dealt again.
GROUP = 200_000


def _crc_table() -> np.ndarray:
    """The crc32 of each byte, by its rule (reversed polynomial 0xEDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_after(start: np.ndarray, words: pa.LargeStringArray, code: np.ndarray) -> np.ndarray:
    """crc32 of the bytes that gave ``start`` followed by ``words[code]``, pair by pair."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
    sizes = (ends[1:] - ends[:-1])[code]
    order = np.argsort(-sizes, kind="stable")
    at, left = ends[:-1][code][order], sizes[order]
    state = start[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-left, -64, side="left"))  # words over 64 bytes are few: one at a time
    for i in range(long):
        state[i] = zlib.crc32(data[at[i] : at[i] + left[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for j in range(int(left[long]) if long < len(left) else 0):
        live = slice(long, int(np.searchsorted(-left, -j, side="left")))
        state[live] = _CRC[(state[live] ^ data[at[live] + j]) & 255] ^ (state[live] >> 8)
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of a-z (already lower-cased), and of U+00C0 to U+00FF: 0xC3 and what follows it."""
    lead = data == 0xC3
    after = np.zeros(len(data), bool)
    after[1:] = lead[:-1]
    return (data >= 97) & (data <= 122) | lead | after


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of ``docs``: runs of Latin letters, A-Z lower-cased, at least so long and so frequent.

    Where ``every`` divides the crc32 of ``<id>:<run>``, the run loses the code
    point at the hash modulo its length. Null texts have no runs; a null
    identifier counts as empty text. Repeated rows count each time. Texts and
    runs of any length are read whole.
    """
    rows = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), docs[text_col].cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 16_000_000):
                runs, owner = runs_in(part.column("text"), _letters)
                encoded = runs.dictionary_encode()
                names = encoded.dictionary
                code, at, times = pair_counts(owner, encoded.indices.to_numpy())
                start = np.array([zlib.crc32(f"{i}:".encode()) for i in part.column("id").to_pylist()], np.uint32)
                hashes = crc_after(start[at], names, code)
                changed = hashes % every == 0
                counts = np.bincount(code[~changed], weights=times[~changed], minlength=len(names)).astype(np.int64)
                kept = pa.array((counts > 0) & (pc.utf8_length(names).to_numpy() >= least_length))
                altered: dict[str, int] = {}
                for c, h, n in zip(code[changed], hashes[changed].tolist(), times[changed].tolist(), strict=True):
                    run = names[int(c)].as_py()
                    i = h % len(run)
                    if len(run) > least_length:
                        altered[word] = altered.get(word := run[:i] + run[i + 1 :], 0) + n
                words = pa.concat_arrays([names.filter(kept).cast(pa.string()), pa.array(list(altered), pa.string())])
                yield pa.RecordBatch.from_arrays([words, pa.concat_arrays([pa.array(counts).filter(kept), pa.array(list(altered.values()), pa.int64())])], names=["word", "n"])

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def one_edit_pairs(strings: list[str], most: int | None = None) -> Iterator[tuple[int, int, int, bool]]:
    """Pairs of places in ``strings`` (all different) one edit apart, the length that they share in front, and whether a character is replaced.

    Each pair comes once. If one is longer it comes second. Pairs that share
    ``most`` characters or more in front are left out.
    """
    kids: list[dict[str, int]] = [{}]
    ends, weight = [-1], [0]
    for i, s in enumerate(strings):
        v = 0
        weight[0] += 1
        for c in s:
            x = kids[v].get(c)
            if x is None:
                x = kids[v][c] = len(kids)
                kids.append({})
                ends.append(-1)
                weight.append(0)
            weight[x] += 1
            v = x
        ends[v] = i

    def meet(p: int, q: int) -> Iterator[tuple[int, int]]:
        """Ends below both, by the same way."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            if ends[p] >= 0 and ends[q] >= 0:
                yield ends[p], ends[q]
            if len(kids[p]) <= len(kids[q]):
                other = kids[q]
                stack += [(x, other[c]) for c, x in kids[p].items() if c in other]
            else:
                other = kids[p]
                stack += [(other[c], y) for c, y in kids[q].items() if c in other]

    def merge(x: int, into: tuple[dict, list[int]]) -> Iterator[tuple[int, int]]:
        """Ends below ``x`` with those that the merged tree has there; then it has those of ``x``, too."""
        stack = [(x, into)]
        while stack:
            x, (below, here) = stack.pop()
            if (i := ends[x]) >= 0:
                yield from ((i, j) for j in here)
                here.append(i)
            for c, y in kids[x].items():
                if c not in below:
                    below[c] = ({}, [])
                stack.append((y, below[c]))

    stack = [(0, 0)]
    while stack:
        v, depth = stack.pop()
        own = kids[v]
        if weight[v] < 2 or most is not None and depth >= most:
            continue
        stack += [(x, depth + 1) for x in own.values()]
        if ends[v] >= 0:  # one is the other with its last character skipped
            yield from ((ends[v], ends[x], depth, False) for x in own.values() if ends[x] >= 0)
        if len(own) < 2:
            continue
        h = max(own, key=lambda c: weight[own[c]])
        heavy, merged = own[h], ({}, [])
        for c, x in own.items():
            if c == h:
                continue
            yield from ((i, j, depth, True) for i, j in meet(x, heavy))
            if len(own) > 2:
                yield from ((i, j, depth, True) for i, j in merge(x, merged))
            for e, y in kids[x].items():  # the light character skipped
                if e != c and e in own:
                    yield from ((j, i, depth, False) for i, j in meet(y, own[e]))
            if c in kids[heavy]:  # the heavy character skipped
                yield from ((i, j, depth, False) for i, j in meet(x, kids[heavy][c]))


def _near_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows that come ordered by ``key``: each word's near words in each group, counted, and the best of them."""
    names = ["word", "n_near", "form", "form_n"]
    out: tuple[list, ...] = ([], [], [], [])

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=names)
        for v in out:
            v.clear()
        return made

    def work(rows: list[tuple]) -> None:
        groups: dict[tuple, list] = {}
        for _, ell, a, t, word, n in rows:  # keys are hashes: the words themselves decide
            groups.setdefault((ell, a, t, word[:a], word[len(word) - t :]), []).append((word, n))
        for (ell, a, t, _, _), members in groups.items():
            if len(members) < 2:
                continue
            near: dict[int, list] = {}
            rest = [w[a : len(w) - t] for w, _ in members]
            for i, j, _, replaced in one_edit_pairs(rest, (ell - t if t else ell + 1) - a):
                if replaced and len(members[i][0]) != ell:
                    continue  # both are longer: another group's pair
                for x, y in ((i, j), (j, i)):
                    word, n = members[y]
                    if x not in near:
                        near[x] = [1, n, word]
                    else:
                        best = near[x]
                        best[0] += 1
                        if n > best[1] or n == best[1] and word < best[2]:
                            best[1:] = n, word
            for x, (count, n, word) in near.items():
                for v, value in zip(out, (members[x][0], count, word, n), strict=True):
                    v.append(value)

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "ell", "a", "t", "word", "n")), strict=True):
            if rows and row[0] != rows[0][0]:
                if len(rows) > 1:
                    work(rows)
                    if len(out[0]) > 20_000:
                        yield flush()
                rows = []
            rows.append(row)
    if len(rows) > 1:
        work(rows)
    yield flush()


def _halves(rows: DataFrame) -> DataFrame:
    """``rows`` once for each half of what their group (ell, a, t) has between its ``a`` first and ``t`` last characters."""
    middle = (F.col("a") + F.floor((F.col("ell") - F.col("t") - F.col("a")) / 2)).cast("int")
    half = F.explode(F.array(F.struct(F.col("a").alias("a"), (F.col("ell") - middle).alias("t")), F.struct(middle.alias("a"), F.col("t").alias("t")))).alias("half")
    parted = rows.select("word", "n", "ell", half).select("word", "n", "ell", "half.a", "half.t")
    word = F.col("word")
    return parted.withColumn("key", F.xxhash64("ell", "a", "t", F.left(word, F.col("a")), F.right(word, F.col("t"))))


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, form, form_n) of each word of ``words`` (word, n; words differ) that has near words.

    Words are near if exactly one inserted, deleted or replaced code point parts
    them; ``form`` is the near word of largest n, the smallest in code-point
    order among equals. Any word finds all of its near words, however large the
    groups are: those of more than ``group`` characters are dealt again by halves.
    """
    size = F.length("word")
    left = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("ell")).select("*", F.lit(0).alias("a"), F.lit(0).alias("t"))
    left, found = materialize(_halves(left), "word-halves"), []
    while True:
        span = F.col("ell") - F.col("t") - F.col("a")
        hot = materialize(left.groupBy("key").agg(F.sum(span + 1).alias("characters"), F.max(span).alias("span")).where((F.col("characters") > group) & (F.col("span") > 1)).select("key"), "hot-halves")
        more = not hot.isEmpty()
        near = left.join(bounded_broadcast(hot), "key", "left_anti") if more else left
        ordered = near.select("key", "ell", "a", "t", "word", "n").repartition("key").sortWithinPartitions("key")
        found.append(ordered.mapInArrow(_near_in_groups, "word string, n_near long, form string, form_n long"))
        if not more:
            break
        left = materialize(_halves(left.join(bounded_broadcast(hot), "key", "left_semi")), "word-halves")
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", "best.form", (-F.col("best.n")).alias("form_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``docs``, see :func:`word_counts` and :func:`near_words`.

    ``form`` is null unless its n is at least ``factor`` (over 1) times the
    word's. ``root`` is where following forms ends: n rises with each step, so
    there is no circle. Words without a form are their own root. An empty table
    gives no words; further columns of the input are ignored.
    """
    words = materialize(word_counts(docs, id_col, text_col), "words")
    near = words.join(near_words(words), "word", "left")
    has_form = F.col("form_n") >= factor * F.col("n")
    rows = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("form")).alias("form"), F.when(has_form, F.col("form_n")).alias("form_n")), "forms")
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps taken
        jumped = roots.join(bounded_broadcast(roots.select(F.col("word").alias("root"), F.col("root").alias("next"))), "root", "left")
        jumped = materialize(jumped.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH RECURSIVE k AS MATERIALIZED (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)) x),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
c AS MATERIALIZED (SELECT doc_id, run, count(*)::BIGINT AS times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS code FROM r GROUP BY doc_id, run),
h AS MATERIALIZED (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, (length(code) // 2)::BIGINT), lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT)), lambda s, b: xor(s >> 8, crc[(xor(s, b) & 255) + 1]))) AS h FROM c, k),
v AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h) x WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v) x),
p AS MATERIALIZED (SELECT a.word AS u, b.word AS w FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, v.word FROM d JOIN v ON d.cut = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.cut = v.word),
b AS (SELECT u, w, n, row_number() OVER (PARTITION BY u ORDER BY n DESC, w) AS place, count(*) OVER (PARTITION BY u) AS n_near FROM p JOIN v ON v.word = p.w),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 2 * v.n THEN w END AS form, CASE WHEN b.n >= 2 * v.n THEN b.n END AS form_n FROM v LEFT JOIN b ON b.u = v.word AND place = 1),
s(word, stop) AS (SELECT word, word FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.stop WHERE f.form IS NOT NULL),
e AS (SELECT s.word, s.stop AS root FROM s JOIN f ON f.word = s.stop WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
"""
