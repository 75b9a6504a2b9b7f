"""The mix comes near every source's target, also where one document holds a large part of a source."""

import random

from pyspark.sql import functions as F

from fieldbook.llm import mixing


def test_targets_of_small_sources(spark):
    rng = random.Random(11)
    rows = [(i, " ".join("w" * n), f"s{i % 5}") for i in range(300) for n in [rng.choice([1, 2, 3, 7, 20, 50]) if i % 60 > 4 else 300]]
    rows += [(1000, None, "s0"), (1001, "", None), (1002, "one", "lone"), (0, "again", "s0")]
    made = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), block=8)
    told = made.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("copies").alias("most"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least")).collect()
    for r in told:
        assert abs(r.taken - r.target) <= max(0.02 * r.target, r.least or 0) and r.most <= 2
    assert made.count() == len(rows)


def test_reruns_agree(spark, tmp_path):
    spark.range(500).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 37 * (id % 11) AS int)) AS text", "concat('s', id % 3) AS source").repartition(4).write.parquet(str(tmp_path / "d"))
    both = [sorted((r.doc_id, r.copies) for r in mixing.copies(spark.read.parquet(str(tmp_path / "d"))).collect()) for _ in range(2)]
    assert both[0] == both[1]
