"""Mixing sources to target weights by pivotal dependent rounding (operator 1).

A source whose target is r times its size takes floor(r) copies of each of its
documents and one more with probability frac(r). The last copies are rounded
dependently: two documents with fractional probabilities move mass (words times
probability) from one to the other, in a random direction that keeps both
expectations, until one of them is 0 or 1; the other meets the next document.
Mass is conserved exactly up to the last fractional document, which is rounded by
itself; as that is a large one as a rule, what it adds or lacks is then made up by
small documents, drawn by a hash from each class of sizes.

The rounding is a reduction tree. Documents are dealt by hash into blocks of
about ``BLOCK``; each block folds its pairs and leaves at most one fractional
residual; residuals of a source meet in blocks again until one is left, which is
rounded by itself. A source with a third of all rows is simply more blocks.
Only DataFrame functions run. Random numbers are hashes of identifiers and seed,
so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import BROADCAST_ROWS, SPACE, fresh, located
from fieldbook.session import materialize

#: Weights of the sources in code-point order, repeating; share of all sizes to take; most copies of a source.
WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2.0
#: Documents or residuals in one block of the reduction tree.
BLOCK = 64
#: A block with so many times as many is dealt again by row.
OVERFULL = 4
#: Documents of a source and a class of sizes (a power of two) that may make up for its last rounding.
SPARE = 64


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space, as a long; null counts 0."""
    text = F.coalesce(text, F.lit(""))
    words = F.length(F.regexp_replace(text, f"[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+", "x"))
    return F.when(text.rlike(f"[^{SPACE}]"), words).otherwise(0).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_copies: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size): budget shared by weight, capped, the excess reshared.

    Sorted by cap over weight, sources reach their cap in that order; the rest
    share what is left by weight. One row per source: this table, and the
    windows over it, do not grow with the documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    totals = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most_copies)))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns(
        {
            "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
            "weights": F.sum("weight").over(everything),
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "used": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = (F.col("budget") - F.col("capped")) / (F.col("weights") - F.col("used"))
    totals = totals.withColumn("level", level)
    lowest = F.min(F.when(F.col("level") < F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.coalesce(F.least("cap", F.col("weight") * lowest), F.col("cap"))
    return totals.select("source", "source_size", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _pair(state: Column, doc: Column, seed: int, level: int) -> Column:
    """One step of the fold: ``doc`` meets the fractional document held in ``state``."""
    held, out = state["held"], state["out"]

    def moved(at: Column) -> Column:
        a, b = at["a"], at["b"]
        up_a, down_a, up_b, down_b = a["size"] * (1 - a["p"]), a["size"] * a["p"], b["size"] * (1 - b["p"]), b["size"] * b["p"]
        to_a, to_b = F.least(up_a, down_b), F.least(down_a, up_b)
        # Mass goes to a with this chance, which keeps both expectations.
        first = _uniform(a["key"], b["key"], a["size"], b["size"], F.lit(seed), F.lit(level)) * (to_a + to_b) < to_b
        p_a = F.when(first, F.when(up_a <= down_b, 1.0).otherwise(a["p"] + to_a / a["size"])).otherwise(F.when(down_a <= up_b, 0.0).otherwise(a["p"] - to_b / a["size"]))
        p_b = F.when(first, F.when(down_b <= up_a, 0.0).otherwise(b["p"] - to_a / b["size"])).otherwise(F.when(up_b <= down_a, 1.0).otherwise(b["p"] + to_b / b["size"]))
        return F.array(a.withField("p", p_a), b.withField("p", p_b))

    met = F.flatten(F.transform(F.array(F.struct(held.alias("a"), doc.alias("b"))), moved))
    split = lambda both: F.struct(F.get(F.filter(both, lambda x: (x["p"] > 0) & (x["p"] < 1)), F.lit(0)).alias("held"), F.concat(out, F.filter(both, lambda x: (x["p"] <= 0) | (x["p"] >= 1))).alias("out"))
    return F.when(held.isNull(), F.struct(doc.alias("held"), out.alias("out"))).otherwise(F.get(F.transform(F.array(met), split), F.lit(0)))


def _reduce(fractional: DataFrame, seed: int, level: int, block: int) -> DataFrame:
    """Blocks of (source, key, locator, size, p): for each the decided documents and the residual, as a rule a large one.

    Blocks are dealt by key. One with ``OVERFULL`` times its share, as repeated
    keys make it, is dealt again by the places of its rows.
    """
    blocks = fractional.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")).withColumnRenamed("source", "of")
    salt = F.when(F.col("key").isNull(), F.col("locator.row"))
    dealt = fractional.join(blocks, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.xxhash64("key", salt, F.lit(seed), F.lit(level)), F.col("blocks"))).drop("of")
    over = materialize(dealt.groupBy(F.col("source").alias("of"), F.col("block").alias("full")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OVERFULL * block), "mix-overfull")
    n_over = over.limit(BROADCAST_ROWS + 1).count()
    if n_over:
        dealt = dealt.join(F.broadcast(over) if n_over <= BROADCAST_ROWS else over, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("full")), "left")
        again = F.pmod(F.xxhash64("locator", F.lit(seed), F.lit(level)), F.ceil(F.col("n") / block))
        dealt = dealt.withColumn("part", F.coalesce(again, F.lit(0)))
    else:
        dealt = dealt.withColumn("part", F.lit(0))
    rows = dealt.groupBy("source", "block", "part").agg(F.sort_array(F.collect_list(F.struct("size", "key", "p", "locator")), asc=False).alias("docs"))
    docs = rows.schema["docs"].dataType
    start = F.struct(F.lit(None).cast(docs.elementType).alias("held"), F.array().cast(docs).alias("out"))
    return rows.select("source", F.aggregate("docs", start, lambda state, x: _pair(state, x, seed, level)).alias("done")).select("source", "done.*")


def _copies(rows: DataFrame, weights: tuple[float, ...], share: float, most_copies: float, seed: int, block: int) -> DataFrame:
    """:func:`copies` over (doc_id, source, size, locator)."""
    targets = materialize(source_targets(rows, weights, share, most_copies), "mix-targets").withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_source = targets.select("of", "source_size", "target", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("p"))
    rows = rows.join(per_source.select("of", "p"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    tree = (F.col("p") > 0) & (F.col("size") > 0)
    out = ["doc_id", "locator", "source", "size", "more"]
    decided, level = [rows.where(~tree).withColumn("more", F.lit(0)).select(*out)], 0
    fractional = rows.where(tree).select("source", F.col("doc_id").alias("key"), "size", "p", "locator")
    while True:
        made = materialize(_reduce(fractional, seed, level, block), f"mix-level-{level}")
        decided.append(made.select("source", F.explode("out").alias("doc")).select("source", "doc.*").withColumns({"doc_id": F.col("key"), "more": F.col("p").cast("int")}).select(*out))
        fractional = made.where("held IS NOT NULL").select("source", "held.*")
        level += 1
        if (fractional.groupBy("source").count().agg(F.max("count")).first()[0] or 0) <= 1:
            break
    last = (_uniform(F.col("key"), F.lit(seed), F.lit(-1)) < F.col("p")).cast("int")
    decided.append(fractional.withColumns({"doc_id": F.col("key"), "more": last}).select(*out))
    rounded = decided[1]
    for part in decided[2:]:
        rounded = rounded.unionByName(part)
    whole = decided[0].unionByName(_settled(rounded, per_source.select("of", "p"), seed))
    whole = whole.join(per_source.drop("p"), F.col("source").eqNullSafe(F.col("of")))
    return whole.select("doc_id", "locator", "source", "size", "source_size", "target", (F.col("whole") + F.col("more")).cast("int").alias("copies"))


def _settled(rounded: DataFrame, per_source: DataFrame, seed: int) -> DataFrame:
    """``rounded`` with some ``more`` turned, so that each source's words come as near its share ``p`` as a bounded draw of its documents allows.

    From every class of sizes at most ``SPARE`` documents are drawn, by a hash;
    the largest that still fit what is lacking (or too much) are turned first.
    """
    words = rounded.groupBy("source").agg(F.sum("size").alias("all"), F.sum(F.col("size") * F.col("more")).alias("taken")).withColumnRenamed("source", "of_words")
    lack = words.join(per_source, F.col("of_words").eqNullSafe(F.col("of"))).select("of", (F.col("all") * F.col("p") - F.col("taken")).alias("lack"))
    spare = rounded.join(lack, F.col("source").eqNullSafe(F.col("of"))).where((F.col("more") == (F.col("lack") < 0).cast("int")) & (F.col("size") <= F.abs("lack")))
    drawn = Window.partitionBy("source", F.floor(F.log2("size"))).orderBy("hash", "locator.row")
    spare = spare.withColumn("hash", F.xxhash64("doc_id", "size", F.lit(seed))).withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= SPARE)
    rows = spare.groupBy("source", F.abs("lack").alias("lack")).agg(F.sort_array(F.collect_list(F.struct("size", "hash", "locator")), asc=False).alias("docs"))
    taken = rows.schema["docs"].dataType
    start = F.struct(F.col("lack").alias("left"), F.array().cast(taken).alias("turned"))
    fold = F.aggregate("docs", start, lambda s, x: F.when(x["size"] <= s["left"], F.struct((s["left"] - x["size"]).alias("left"), F.array_append(s["turned"], x).alias("turned"))).otherwise(s))
    turned = materialize(rows.select(F.explode(fold["turned"]).alias("doc")).select(F.col("doc.locator").alias("turned")), "mix-turned")
    joined = rounded.join(turned, F.col("locator") == F.col("turned"), "left")
    return joined.withColumn("more", F.when(F.col("turned").isNull(), F.col("more")).otherwise(1 - F.col("more"))).drop("turned")


def _sized(with_rows: DataFrame, locator: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return materialize(with_rows.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), F.col(locator).alias("locator")), "mix-sizes")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_copies: float = MOST_COPIES, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """(doc_id, locator, source, size, source_size, target, copies), one row per input row.

    Null texts and texts of white space have size 0 and get floor(target /
    source_size) copies; a null source is a source, the last one. Rows of one
    identifier, and rows repeated whole, are documents of their own. A source
    of size 0 gets target 0 and no copies. An empty table gives an empty result.
    Reruns over the same files agree; texts may be of any length, only their
    number of words counts. Other columns are not looked at.
    """
    with_rows, locator = located(docs)
    return _copies(_sized(with_rows, locator, id_col, text_col, source_col), weights, share, most_copies, seed, block)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_copies: float = MOST_COPIES, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as :func:`copies` says, columns unchanged.

    Null and blank texts, null sources, repeated rows and empty tables are as in
    :func:`copies`; columns of any name are kept.
    """
    with_rows, locator = located(docs)
    taken = _copies(_sized(with_rows, locator, id_col, text_col, source_col), weights, share, most_copies, seed, block)
    times = fresh("copies", with_rows.columns)
    taken = taken.where("copies > 0").select(F.col("locator").alias(locator), F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias(times))
    return with_rows.join(taken, locator).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, copies, size, source_size, target and taken (words, repeats counted) for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return copies(docs).select("doc_id", "source", "copies", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
