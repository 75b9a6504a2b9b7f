"""Enrichment that resumes: what a killed run stored is not computed again."""

import pytest

from fieldbook.operators import enrichment


class Killed(Exception):
    pass


def loaders():
    """The models; workers can't import this file, so they travel by value."""

    def doubled():
        return lambda values: [[2.0 * v] for v in values]

    def picky():
        def run(values):
            if any(v % 7 == 0 for v in values):
                raise ValueError("no sevens")
            return [[float(v), 1.0] for v in values]

        return run

    return doubled, picky


def test_a_killed_run_goes_on(spark, tmp_path):
    doubled, picky = loaders()
    target, models = str(tmp_path / "t"), {"a": ("1", doubled), "b": ("1", picky)}
    rows = spark.createDataFrame([(i, i) for i in range(1, 101)] + [(500, None)], "id long, payload long")

    def kill(k):
        if k == 2:
            raise Killed

    with pytest.raises(Killed):
        enrichment.enrich(rows, models, target, slices=6, after_slice=kill)
    stored = enrichment.results(spark, target)
    done = stored.where("embedding IS NOT NULL").count()
    assert 0 < done < 186
    before = {(r.id, r.model): r.made for r in stored.where("embedding IS NOT NULL").collect()}
    assert enrichment.enrich(rows, models, target) == {"skip": done, "compute": 202 - done, "conflict": 0}
    after = {(r.id, r.model): r for r in enrichment.results(spark, target).collect()}
    assert len(after) == 202 and all(after[k].made == m for k, m in before.items())
    assert {k for k, r in after.items() if r.error} == {(str(i), "b") for i in range(7, 101, 7)} | {("500", "a"), ("500", "b")}
    assert all("no sevens" in after[str(i), "b"].error for i in range(7, 101, 7))
    # What failed is tried again, and nothing else.
    assert enrichment.enrich(rows, models, target) == {"skip": 186, "compute": 16, "conflict": 0}
    side = {r.id: (r.a, r.b) for r in enrichment.enriched(rows, target, ["a", "b"]).collect()}
    assert side[3] == ([6.0], [3.0, 1.0]) and side[7] == ([14.0], None) and side[500] == (None, None) and len(side) == 101
    # A new revision conflicts with what is stored, unless it may be replaced.
    newer = {"a": ("2", doubled)}
    assert enrichment.enrich(rows, newer, target) == {"skip": 0, "compute": 1, "conflict": 100}
    assert enrichment.enrich(rows, newer, target, overwrite=True)["compute"] == 101
    assert enrichment.results(spark, target).where("model = 'a' AND revision = '2'").count() == 101
    with pytest.raises(RuntimeError, match="sevens"):
        enrichment.enrich(rows.where("payload = 14"), {"b": ("1", picky)}, target, on_error="raise", slices=1)


def test_nothing_to_do(spark, tmp_path):
    doubled, _ = loaders()
    rows = spark.createDataFrame([], "id long, payload long")
    assert enrichment.enrich(rows, {"a": ("1", doubled)}, str(tmp_path / "t")) == {"skip": 0, "compute": 0, "conflict": 0}
    assert enrichment.enriched(rows, str(tmp_path / "none"), ["a"]).columns == ["id", "payload", "a"]
