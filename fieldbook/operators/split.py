"""Splits and samplers. Every draw is a hash of seed and identifier, so a run can be repeated on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.operators.clean import numbered_in_order


def draw(seed: int, *parts: Column, salt: str = "") -> Column:
    """32 hex digits that depend on seed and parts alone: compared as text, a uniform number in [0, 1)."""
    return F.md5(F.concat_ws(":", F.lit(f"{seed}{salt}"), *[p.cast("string") for p in parts]))


def share(ratio: float) -> str:
    """The text below which a drawn number falls with chance ``ratio``."""
    return "g" if ratio >= 1 else f"{int(round(ratio * 16**8)):08x}"


def closed_set_split(samples: DataFrame, identity: str, id_col: str = "sample_id", ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, field: str = "closed_set_split") -> DataFrame:
    """Each identity has one sample in train for sure; the others are drawn by the ratios. A null identity stays unassigned."""
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")
    first = samples.where(F.col(identity).isNotNull()).groupBy(F.col(identity).alias("__who")).agg(F.min(F.struct(draw(seed, F.col(id_col), salt="o").alias("o"), F.col(id_col).alias("i"))).alias("__first"))
    rows = samples.join(first, F.col(identity) == F.col("__who"), "left")
    u = draw(seed, F.col(id_col))
    drawn = F.when(u < share(ratios[0]), "train").when(u < share(ratios[0] + ratios[1]), "val").otherwise("test")
    return rows.withColumn(field, F.when(F.col("__who").isNull(), F.lit(None)).when(F.col(id_col) == F.col("__first.i"), "train").otherwise(drawn)).drop("__who", "__first")


def open_set_split(samples: DataFrame, identity: str, id_col: str = "sample_id", train_only: float = 0.6, shared: float = 0.2, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, field: str = "open_set_split") -> DataFrame:
    """Shuffled identities: the first share is for training only, the next is drawn by the ratios, the rest is never trained on."""
    who = samples.where(F.col(identity).isNotNull()).select(F.col(identity).alias("__who")).distinct().withColumn("__u", draw(seed, F.col("__who"), salt="i"))
    n = who.count()
    ranked = numbered_in_order(who, "__u", "__rank")
    kind = F.when(F.col("__rank") <= int(n * train_only), "train_only").when(F.col("__rank") <= int(n * train_only) + int(n * shared), "shared").otherwise("held_out")
    rows = samples.join(ranked.select("__who", kind.alias("__kind")), F.col(identity) == F.col("__who"), "left")
    u = draw(seed, F.col(id_col))
    of_three = F.when(u < share(ratios[0]), "train").when(u < share(ratios[0] + ratios[1]), "val").otherwise("test")
    rest = ratios[1] + ratios[2]
    of_two = F.when(u < share(ratios[1] / rest if rest else 0.5), "val").otherwise("test")
    return rows.withColumn(field, F.when(F.col("__kind") == "train_only", "train").when(F.col("__kind") == "shared", of_three).when(F.col("__kind") == "held_out", of_two)).drop("__who", "__kind")


def main_split(samples: DataFrame, by: str = "open", closed_requested: bool = True) -> DataFrame:
    """``split``, a copy of the open split if asked for or if there is no closed one, else of the closed split, and a tag that names it."""
    chosen = F.col("open_set_split" if by == "open" or not closed_requested else "closed_set_split")
    rows = samples.withColumn("split", chosen)
    return rows.withColumn("tags", F.array_union("tags", F.array_compact(F.array("split")))) if "tags" in rows.columns else rows


def pk_batches(samples: DataFrame, label: str, p: int, k: int, id_col: str = "id", seed: int = 42, drop_last: bool = True) -> DataFrame:
    """(batch, label, id): batches of ``p`` classes with ``k`` distinct samples each, of the classes that have as many."""
    order = F.row_number().over(Window.partitionBy(label).orderBy(draw(seed, F.col(id_col)), id_col))
    counts = samples.groupBy(F.col(label).alias("__label")).count().where(F.col("count") >= k)
    valid = counts.count()
    if valid < p:
        raise ValueError(f"{valid} classes have {k} samples; {p} are needed")
    classes = numbered_in_order(counts.select("__label", draw(seed, F.col("__label"), salt="c").alias("__u")), "__u", "__n").select("__label", F.floor((F.col("__n") - 1) / p).alias("batch"))
    rows = samples.withColumn("__k", order).where(F.col("__k") <= k).join(F.broadcast(classes) if valid <= 100_000 else classes, F.col(label) == F.col("__label"))
    return (rows.where(F.col("batch") < valid // p) if drop_last else rows).select("batch", label, id_col)


def class_weights(samples: DataFrame, label: str) -> DataFrame:
    """``samples`` with n_class and weight, one over it."""
    counts = samples.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("n_class"))
    return samples.join(counts, F.col(label).eqNullSafe(F.col("__label"))).drop("__label").withColumn("weight", 1 / F.col("n_class"))


def class_balanced_sample(samples: DataFrame, label: str, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, chance by class weight: the least exponential arrival times."""
    u = (F.conv(F.substring(draw(seed, F.col(id_col), salt="w"), 1, 12), 16, 10).cast("double") + 1) / float(16**12 + 1)
    rows = class_weights(samples, label).withColumn("__t", -F.log(u) / F.col("weight"))
    return rows.orderBy("__t", id_col).limit(n).drop("__t")


def _uniform(seed: int, *parts: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 48 bits of :func:`draw`."""
    return F.conv(F.substring(draw(seed, *parts, salt=salt), 1, 12), 16, 10).cast("double") / float(16**12)


def class_balanced_draws(samples: DataFrame, label: str, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """(draw, label, id): ``n`` draws with replacement, chance by class weight: a class, all alike, then one of its rows, all alike."""
    rows = numbered_in_order(samples.where(F.col(label).isNotNull()).select(F.col(label).alias("__label"), F.col(id_col).alias("__id"), F.struct(label, id_col).alias("__order")), "__order", "__n")
    classes = rows.groupBy("__label").agg(F.min("__n").alias("__first"), F.count(F.lit(1)).alias("__size"))
    classes = numbered_in_order(classes, "__label", "__class")
    n_classes = classes.count()
    draws = samples.sparkSession.range(n).withColumnRenamed("id", "draw")
    draws = draws.withColumn("__class", F.floor(_uniform(seed, F.col("draw"), salt="d") * n_classes) + 1)
    if not n_classes:
        return samples.select(F.lit(0).cast("long").alias("draw"), label, id_col).limit(0)
    draws = draws.join(F.broadcast(classes) if n_classes <= 100_000 else classes, "__class").withColumn("__n", F.col("__first") + F.floor(_uniform(seed, F.col("draw"), salt="r") * F.col("__size")))
    return draws.drop("__label").join(rows, "__n").select("draw", F.col("__label").alias(label), F.col("__id").alias(id_col))


def random_subset(rows: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """``n`` rows without replacement."""
    return rows.orderBy(draw(seed, F.col(id_col)), id_col).limit(n)
