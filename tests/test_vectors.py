"""Pruned similarity, bounded greedy deduplication, the similarity index and ranks against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbook.operators import dedup, inference, metrics, near_blocks, similarity_index
from fieldbook.plans import ingest


def unit(x):
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def frame_of(spark, x, **more):
    names = "".join(f", {k} {'string' if isinstance(v[0], str) else 'int'}" for k, v in more.items())
    return spark.createDataFrame([(i, v.tolist(), *(m[i] for m in more.values())) for i, v in enumerate(x)], f"id long, vector array<double>{names}")


def clusters(rng, n, k, spread, size=12):
    centres = rng.normal(size=(k, size))
    return unit(centres)[rng.integers(0, k, n)] + spread * rng.normal(size=(n, size))


def loop(x, least):
    s, leaders, out = unit(x) @ unit(x).T, [], {}
    for i in range(len(x)):
        out[i] = next((j for j in leaders if s[i, j] >= least), None)
        if out[i] is None:
            leaders.append(i)
    return out


def test_pruned_pairs_are_all_pairs(spark):
    x = clusters(np.random.default_rng(1), 900, 20, 0.03)
    x[5] = 0
    s = unit(x) @ unit(x).T
    frame = frame_of(spark, x)
    blocks = near_blocks.near_blocks(frame, 0.95, block=25)
    assert blocks.n_blocks >= 24 and blocks.share < 1 / 3
    got = {(r.a, r.b) for r in near_blocks.similar_edges(frame, 0.95, block=25).collect()}
    assert got == {(i, j) for i in range(900) for j in range(i + 1, 900) if s[i, j] >= 0.95}
    counts = {r.id: (r.n_links, r.nearest) for r in near_blocks.neighbour_counts(frame, 0.95, block=25).collect()}
    np.fill_diagonal(s, -1)
    s = np.round(s, 12)
    assert counts == {i: (int((s[i] >= 0.95).sum()), int(s[i].argmax()) if s[i].max() >= 0.95 else None) for i in range(900)}


def test_nothing_is_left_out_without_structure(spark):
    x = np.random.default_rng(2).normal(size=(150, 8))
    blocks = near_blocks.near_blocks(frame_of(spark, x), -0.5, block=20)
    assert blocks.share == 1.0
    s = unit(x) @ unit(x).T
    got = {(r.a, r.b) for r in near_blocks.similar_edges(frame_of(spark, x), -0.5, block=20).collect()}
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if s[i, j] >= -0.5}
    none = frame_of(spark, x).where("id < 0")
    assert near_blocks.similar_edges(none, 0.9).count() == 0 and near_blocks.neighbour_counts(none, 0.9).count() == 0


@pytest.mark.parametrize(("least", "first", "at_once"), [(0.9, 1, 1_000_000), (0.5, 2, 1_000_000), (0.7, 1, 40)])
def test_greedy_with_few_edges_follows_the_loop(spark, monkeypatch, least, first, at_once):
    """A row that lists one neighbour a block, where it has dozens, still gets the loop's leader."""
    monkeypatch.setattr(dedup, "SETTLED_AT_ONCE", at_once)
    x = clusters(np.random.default_rng(3), 160, 4, 0.25, 6)
    x = x[np.random.default_rng(4).permutation(160)]
    got = {r.id: r.duplicate_of for r in dedup.greedy_leaders(frame_of(spark, x), least, first).collect()}
    assert got == loop(x, least)


def test_a_dense_group_gives_few_edges(spark):
    x = np.array([[1.0, 0.0]]) + 0.01 * np.random.default_rng(5).normal(size=(400, 2))
    frame = frame_of(spark, x).withColumns({"target": F.lit(True), "source": F.lit(True)})
    blocks = near_blocks.near_blocks(frame, 0.9, block=100)
    edges = near_blocks.first_edges(frame, 0.9, 16, block=100)
    assert edges.count() <= 16 * 400 * blocks.n_blocks / 2 + 16 * 400 < 400 * 399 / 2
    assert dedup.greedy_leaders(frame, 0.9).where("NOT is_duplicate").count() == 1


def test_leaks_between_splits(spark):
    x = clusters(np.random.default_rng(6), 120, 5, 0.1)
    split = [("train", "val", "test")[i % 3] for i in range(120)]
    s = unit(x) @ unit(x).T
    want = {i: sum(s[i, j] >= 0.8 and split[i] != split[j] for j in range(120)) for i in range(120)}
    got = {r.id: (r.split, r.n_leaks) for r in dedup.leaky_splits(frame_of(spark, x, split=split), 0.8).collect()}
    assert got == {i: (split[i], n) for i, n in want.items() if n}


def test_the_index_is_kept_and_finds_neighbours(spark, tmp_path):
    x = clusters(np.random.default_rng(7), 900, 30, 0.2)
    frame = frame_of(spark, x)
    similarity_index.build(frame, path=str(tmp_path / "index"))
    index = similarity_index.read(spark, str(tmp_path / "index"))
    queries = frame.where("id % 9 = 0")
    found = similarity_index.search(index, queries, 10, probes=6, block=40)
    exact = inference.top_k(queries, frame, 10)
    quality = similarity_index.recall(found, exact).first()
    assert quality.n_queries == 100 and quality.recall >= 0.9
    assert similarity_index.compared(index, queries, 6).agg(F.avg("n")).first()[0] < 900 / 2
    every = similarity_index.search(index, queries, 10, probes=10_000, block=40)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    empty = similarity_index.build(frame.where("id < 0"))
    assert similarity_index.search(empty, queries).count() == 0 and similarity_index.search(index, frame.where("id < 0")).count() == 0


def test_one_cell_with_most_rows_is_dealt_in_blocks(spark):
    x = np.concatenate([np.ones((300, 3)) + 1e-3 * np.random.default_rng(8).normal(size=(300, 3)), np.eye(3)[np.arange(100) % 3]])
    index = similarity_index.build(frame_of(spark, x), cells=4)
    found = similarity_index.search(index, frame_of(spark, x).where("id % 7 = 0"), 3, probes=4, block=32)
    exact = inference.top_k(frame_of(spark, x).where("id % 7 = 0"), frame_of(spark, x), 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact.collect()))


def ranks(x, y):
    s = np.round(unit(x) @ unit(x).T, 12)
    out = {}
    for q in range(len(x)):
        order = [g for g in np.lexsort((np.arange(len(x)), -s[q])) if g != q]
        hits = [r + 1 for r, g in enumerate(order) if y[g] == y[q]]
        if hits:
            out[q] = (round(float(np.mean([(k + 1) / r for k, r in enumerate(hits)])), 9), hits[0])
    return out


@pytest.mark.parametrize(("block", "merged"), [(16, 25), (16, 10_000), (1024, 65_536)])
def test_ranks_when_one_label_has_half_of_all_rows(spark, monkeypatch, block, merged):
    """Many ties: runs are cut at bounds that equal similarities, and merged in order."""
    monkeypatch.setattr(metrics, "MERGED", merged)
    rng = np.random.default_rng(9)
    x = rng.integers(-1, 2, (130, 3)).astype(float)
    y = np.where(rng.random(130) < 0.5, 0, rng.integers(1, 12, 130)).astype(int)
    frame = frame_of(spark, x, label=y.tolist())
    want = ranks(x, y)
    got = {r["query"]: (round(r.ap, 9), r["first"]) for r in metrics.query_precision(frame, block).collect()}
    assert got == want
    firsts = {r["query"]: r["first"] for r in metrics.query_precision(frame, block, best_only=True).collect()}
    assert firsts == {q: f for q, (_, f) in want.items()}


def scratch_bytes(spark):
    from pathlib import Path

    from fieldbook.session import shared_root

    return sum(f.stat().st_size for f in Path(shared_root(spark).removeprefix("file:")).rglob("*") if f.is_file())


def ranked_rows(spark, n=800):
    """Two labels, each too large for a block of 64."""
    return frame_of(spark, np.random.default_rng(11).normal(size=(n, 4)), label=(np.arange(n) % 2).tolist())


def test_ranking_keeps_no_pairs(spark):
    frame, before = ranked_rows(spark), scratch_bytes(spark)
    assert metrics.retrieval_metrics(frame, block=64).first().n_queries == 800
    assert scratch_bytes(spark) - before < 800 * 800


def test_first_ranks_keep_no_pairs(spark):
    frame, before = ranked_rows(spark), scratch_bytes(spark)
    assert metrics.cmc_all_queries(frame, (1, 800), block=64).first().cmc_800 == 1
    assert scratch_bytes(spark) - before < 800 * 800


def test_ranking_of_supported_labels_keeps_no_pairs(spark):
    frame, before = ranked_rows(spark).withColumn("label", F.when(F.col("id") < 3, 2).otherwise(F.col("label"))), scratch_bytes(spark)
    assert metrics.retrieval_metrics(metrics.with_support(frame, 50), block=64).first().n_queries == 797
    assert scratch_bytes(spark) - before < 800 * 800


@pytest.mark.parametrize("mode", ["standard", "random_baseline"])
def test_evaluation_keeps_no_pairs(spark, monkeypatch, mode):
    ranked = metrics.query_precision
    monkeypatch.setattr(metrics, "query_precision", lambda rows, _: ranked(rows, 64))
    frame, before = ranked_rows(spark).select(F.col("id").alias("sample_id"), "label", "vector", F.lit("val").alias("split")), scratch_bytes(spark)
    assert [r.n_queries for r in ingest.evaluate(frame, "val", 9, mode).collect()] == [800, 800]
    assert scratch_bytes(spark) - before < 2 * 800 * 800


def pairs_loop(x, least):
    """The loop over cosines as SQL has them."""
    n = np.sqrt((x * x).sum(1)) + 1e-12
    s, leaders, out = (x @ x.T) / np.outer(n, n), [], {}
    for i in range(len(x)):
        out[i] = next((j for j in leaders if s[i, j] >= least), None)
        if out[i] is None:
            leaders.append(i)
    return out


def test_leaders_on_the_threshold_and_without_direction(spark):
    """Cosines of whole numbers that are the threshold but for the little added to lengths; zero vectors, which are like none."""
    u = 10 ** np.arange(8)
    x = np.concatenate([np.stack([u, 0 * u, 0 * u, 0 * u], 1), np.stack([49 * u, 9 * u, 3 * u, 3 * u], 1), np.zeros((3, 4)), np.eye(4)[[1, 1, 2]]]).astype(float)
    got = {r.id: r.duplicate_of for r in dedup.greedy_leaders(frame_of(spark, x), 0.98).collect()}
    assert got == pairs_loop(x, 0.98)
    assert all(got[i] is None for i in (16, 17, 18)) and got[20] == 19


def test_near_blocks_are_not_copied(spark):
    """Blocks meet in a product of tables, so nothing is shuffled for each pair of them."""
    rng = np.random.default_rng(4)
    frame = frame_of(spark, rng.normal(size=(640, 6))).withColumns({"target": F.lit(True), "source": F.lit(True)})
    edges = near_blocks.first_edges(frame, 0.99, 1, block=10)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapGroups" not in plan


def test_batches_are_held_against_leaders(spark, monkeypatch):
    """Rows in batches give what the loop gives, and of a hundred rows about each of three centres few edges are kept."""
    monkeypatch.setattr(dedup, "BATCH", 40)
    x, kept = clusters(np.random.default_rng(6), 300, 3, 0.05), []
    write = dedup.materialize
    monkeypatch.setattr(dedup, "materialize", lambda frame, name, *more: kept.append((name, made := write(frame, name, *more))) or made)
    got = {r.id: r.duplicate_of for r in dedup.greedy_leaders(frame_of(spark, x), 0.9).collect()}
    assert got == loop(x, 0.9)
    assert sum(made.count() for name, made in kept if name == "edges") < 300 * 10
