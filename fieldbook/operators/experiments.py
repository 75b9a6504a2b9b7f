"""Experiment tables: latest run per experiment, metric aliases, parameter grids, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldbook.functions.text import plain_name, timestamp_or_least

#: Prefixes of tags that are dropped when no run has all tags.
RELAXED = ("run_batch:", "dataset:", "source:", "backbone:")


def with_metrics(runs: DataFrame, aliases: dict[str, list[str]], map_col: str = "metrics") -> DataFrame:
    """``runs`` with each canonical metric: the first alias that the map has."""
    return runs.withColumns({name: F.coalesce(*[F.col(map_col)[k] for k in keys]) for name, keys in aliases.items()})


def name_candidates(name):
    """The forms of an experiment's name that runs may go by, normalised."""
    short = F.regexp_replace(name, "^.*?__", "")
    bare = F.regexp_replace(short, "^(baseline|loss|backbone)_", "")
    return F.array_distinct(F.transform(F.array(name, short, bare), plain_name))


def latest_runs(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """(experiment, run_id, relaxed): for each (experiment, required_tags) the newest fitting run of (run_id, name, tags, created_at).

    A run must have all required tags; if none has, those with relaxed prefixes
    are not required. Among these, runs whose name equals the experiment's come
    before those that contain it or are contained, those before others; then the
    newest, then the least run_id. Experiments without runs keep null.
    """
    tagged = runs.select(F.col("run_id"), plain_name(F.col("name")).alias("plain"), "tags", timestamp_or_least(F.col("created_at")).alias("at"), F.explode("tags").alias("tag"))
    strict = lambda t: ~F.exists(F.array(*map(F.lit, RELAXED)), lambda p: t.startswith(p))
    wanted = experiments.select("experiment", F.array_distinct("required_tags").alias("required"), F.filter(F.array_distinct("required_tags"), strict).alias("relaxed_tags"), name_candidates(F.col("experiment")).alias("names"))
    # Runs meet an experiment through a tag that even the relaxed search asks for.
    first = wanted.withColumn("tag", F.get("relaxed_tags", F.lit(0)))
    met = first.join(tagged, "tag")
    has = lambda want: F.size(F.array_except(F.col(want), F.col("tags"))) == 0
    met = met.where(has("relaxed_tags")).withColumn("strict", has("required"))
    name = F.when(F.array_contains("names", F.col("plain")), 0).when(F.exists("names", lambda n: F.contains(n, F.col("plain")) | F.contains(F.col("plain"), n)), 1).otherwise(2)
    rank = F.struct((~F.col("strict")).alias("relaxed"), name.alias("name"), (-F.unix_micros("at")).alias("age"), "run_id")
    best = met.groupBy("experiment").agg(F.min(rank).alias("best"))
    return experiments.select("experiment").join(best, "experiment", "left").select("experiment", F.col("best.run_id").alias("run_id"), F.col("best.relaxed").alias("relaxed"))


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """Every combination of the axes' values: a parameter table, bounded by its author."""
    made = None
    for name, values in axes.items():
        axis = spark.createDataFrame([(v,) for v in values], [name])
        made = axis if made is None else made.crossJoin(axis)
    return made


def compare(left: DataFrame, right: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Metrics of two tables side by side, with differences; keys of one side only are kept."""
    a = left.select(key, *[F.col(m).alias(f"{m}_left") for m in metrics])
    b = right.select(key, *[F.col(m).alias(f"{m}_right") for m in metrics])
    return a.join(b, key, "full").withColumns({f"{m}_difference": F.col(f"{m}_right") - F.col(f"{m}_left") for m in metrics})


def comparison_table(experiments: DataFrame, results: DataFrame, metric: str) -> DataFrame:
    """Experiments with their metric, best first; those without a run say ERROR and come last."""
    value = F.col(metric).try_cast("double")
    rows = experiments.join(results, "experiment", "left").withColumn(metric, value)
    return rows.withColumn("status", F.when(F.col(metric).isNull(), "ERROR").otherwise("ok")).orderBy(F.col(metric).desc_nulls_last(), "experiment")


def top(rows: DataFrame, metric: str, n: int = 10, key: str = "experiment") -> DataFrame:
    return rows.orderBy(F.col(metric).desc_nulls_last(), key).limit(n)


def newest_first(runs: DataFrame, key: str) -> DataFrame:
    """``runs`` with age, 1 for the newest of its key."""
    return runs.withColumn("age", F.row_number().over(Window.partitionBy(key).orderBy(timestamp_or_least(F.col("created_at")).desc(), "run_id")))


def sweep_spec(metric: str, axes: dict[str, list], method: str = "bayes", runs: int = 20, least_epochs: int = 5) -> dict:
    """A sweep's specification: what to maximise, over which values, and when to stop early."""
    return {"method": method, "metric": {"name": metric, "goal": "maximize"}, "run_cap": runs, "parameters": {k: {"values": list(v)} for k, v in axes.items()}, "early_terminate": {"type": "hyperband", "min_iter": least_epochs}}


def grouped(experiments: DataFrame, group: str) -> DataFrame:
    """(group, experiments, n): the names of each group's experiments, sorted."""
    return experiments.groupBy(group).agg(F.sort_array(F.collect_list("experiment")).alias("experiments"), F.count(F.lit(1)).alias("n"))


def best_run(runs: DataFrame, metric: str, key: str = "run_id") -> DataFrame:
    """The row with the largest metric, the least key of equals; none if no row has a number."""
    return top(runs.withColumn(metric, F.col(metric).try_cast("double")).where(F.col(metric).isNotNull()), metric, 1, key)
