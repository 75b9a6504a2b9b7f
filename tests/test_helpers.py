"""Append by a table of keys, and small helpers of runs."""

import random

from fieldbook.operators import experiments, vectors
from fieldbook.plans import snapshot
from fieldbook.streaming import append


def test_append_over_many_batches(spark, tmp_path, monkeypatch):
    """Row by row the same as going through the batches in order; also where a batch has too many keys to look up by value."""
    rng = random.Random(4)
    pick = lambda n: rng.choice([None, *map(str, range(n))])
    batches = [[(pick(30), pick(40), b * 20 + i) for i in range(20)] for b in range(4)]
    source, target = tmp_path / "in", tmp_path / "out"
    paths, hashes, want = set(), set(), []
    for number, rows in enumerate(batches):
        monkeypatch.setattr(append, "LOOKED_UP", 400 if number % 2 else 3)
        spark.createDataFrame(rows, "path string, sha1 string, n int").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("path string, sha1 string, n int").parquet(str(source))
        append.append_stream(stream, str(target), ["path", "sha1"], "n", str(tmp_path / "check")).awaitTermination()
        new = [r for r in rows if r[0] not in paths and r[1] not in hashes]
        first = {p: min(n for q, _, n in new if q == p) for p, _, _ in new if p is not None}
        new = [r for r in new if r[0] is None or first[r[0]] == r[2]]
        first = {h: min(n for _, g, n in new if g == h) for _, h, _ in new if h is not None}
        new = [r for r in new if r[1] is None or first[r[1]] == r[2]]
        want += [r[2] for r in new]
        paths |= {r[0] for r in new} - {None}
        hashes |= {r[1] for r in new} - {None}
        assert sorted(r.n for r in spark.read.parquet(str(target)).collect()) == sorted(want)


def test_a_lookup_reads_keys_and_not_the_target(spark, tmp_path):
    target = str(tmp_path / "out")
    made = append._hashed(spark.range(1000).selectExpr("cast(id AS string) AS path"), ["path"]).repartitionByRange(4, "hash").sortWithinPartitions("hash")
    made.write.option("parquet.bloom.filter.enabled#hash", "true").parquet(f"{target}-keys/batch=0")
    batch = spark.createDataFrame([("7",), ("x",), (None,), ("999",)], "path string")
    found = append.known_keys(batch, target, ["path"], 1)
    assert sorted(r.path for r in found.collect()) == ["7", "999"]
    assert append.known_keys(batch, target, ["path"], 0).count() == 0  # a replayed batch doesn't meet itself
    assert "In(hash" in found._jdf.queryExecution().toString()


def test_helpers(spark, tmp_path):
    assert vectors.embedding_choice(["x"], "mine", "m") == "mine" and vectors.embedding_choice(["embeddings_full_image"], None, "m") == "embeddings_full_image"
    assert vectors.embedding_choice([], None, "resnet50") == "embeddings_ResNet50" and vectors.embedding_choice([], None, "hub:a/b-c") == "embeddings_a_b_c"
    spec = experiments.sweep_spec("map", {"scale": [16, 32]})
    assert spec["metric"] == {"name": "map", "goal": "maximize"} and spec["parameters"]["scale"] == {"values": [16, 32]} and spec["early_terminate"]["type"] == "hyperband"
    snapshot.drop_table(spark, "kept_rows")
    rows = spark.range(3)
    assert snapshot.ensure_table(spark, "kept_rows", rows).count() == 3 and snapshot.ensure_table(spark, "kept_rows", spark.range(9)).count() == 3
    assert snapshot.ensure_table(spark, "kept_rows", spark.range(9), overwrite=True).count() == 9
    snapshot.drop_table(spark, "kept_rows")
    assert not spark.catalog.tableExists("kept_rows")


def test_generated_identifiers_go_at_every_depth(spark):
    from fieldbook.operators import records

    schema = "v struct<_id string, b array<struct<_id int, x int>>, a map<string, struct<_id int, y int>>, only struct<_id int>>"
    rows = spark.createDataFrame([((str(i), [(i, 1), (i + 1, 2)], {"k": (i, 5), "_id": (0, i)}, (i,)),) for i in (1, 2)] + [(None,), (("3", None, None, None),)], schema)
    assert [r.m for r in records.meaning(rows, "v", "m").collect()] == ['{"v":{"a":{"k":{"y":5}},"b":[{"x":1},{"x":2}],"only":{}}}'] * 2 + ["{}", '{"v":{}}']
