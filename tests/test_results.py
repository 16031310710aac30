"""Savers that meet, and versions that are not committed."""

from multiprocessing.pool import ThreadPool

import pytest
from pyspark.sql import functions as F

from evalspark.operators import report
from evalspark.sources import results


def rows(spark, method, value=1.0):
    return spark.createDataFrame([("t", method, "metrics", "accuracy", float(value), None)], report.RESULT)


def saved(spark, path):
    return {r["method"]: r["value"] for r in results.load_results(spark, path).collect()}


def test_savers_that_meet_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "results")
    with ThreadPool(6) as pool:
        versions = pool.map(lambda i: results.save_results(rows(spark, f"m{i}", i), path), range(6))
    assert sorted(versions) == list(range(6))
    assert saved(spark, path) == {f"m{i}": float(i) for i in range(6)}
    assert not list((tmp_path / "results").glob("_pending*"))


def test_the_loser_of_a_number_merges_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    results.save_results(rows(spark, "a"), path)
    true_newest, calls = results.newest_version, []

    def late(session, at):
        """Looks before another saver commits, and acts after it."""
        found = true_newest(session, at)
        calls.append(found)
        if len(calls) == 1:
            monkeypatch.setattr(results, "newest_version", true_newest)
            results.save_results(rows(spark, "b"), path)
            monkeypatch.setattr(results, "newest_version", late)
        return found

    monkeypatch.setattr(results, "newest_version", late)
    assert results.save_results(rows(spark, "c"), path) == 2 and calls == [0, 1]
    monkeypatch.undo()
    assert saved(spark, path) == {"a": 1.0, "b": 1.0, "c": 1.0}


def test_half_written_versions_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "results")
    assert saved(spark, path) == {}
    results.save_results(rows(spark, "a"), path)
    rows(spark, "half").write.parquet(f"{path}/_pending-dead")
    (tmp_path / "results" / "version=x").mkdir()
    assert saved(spark, path) == {"a": 1.0}
    results.save_results(rows(spark, "a", 2.0), path)
    assert saved(spark, path) == {"a": 2.0}


def test_an_empty_version_is_one(spark, tmp_path):
    path = str(tmp_path / "results")
    assert results.save_results(rows(spark, "a").where("false"), path) == 0
    assert results.save_results(rows(spark, "a"), path) == 1 and saved(spark, path) == {"a": 1.0}


def test_a_failing_commit_is_told(spark, tmp_path, monkeypatch):
    def broken(*_):
        raise OSError("no space")

    monkeypatch.setattr(results.os, "rename", broken)
    with pytest.raises(OSError):
        results.save_results(rows(spark, "a"), str(tmp_path / "results"))


def test_limits_are_off_by_default(spark):
    from evalspark.functions import state
    from evalspark.plans.catalog import DOC_LANG
    from evalspark.registry.sampling_queries import LIMITED_LANG

    df = spark.createDataFrame([("x" * 2000,)], "text string")
    long = df.select(DOC_LANG.is_short().alias("all"), LIMITED_LANG.is_short().alias("few")).first()
    assert long["all"] and not long["few"]
    packed = df.select(F.struct("text").alias("s"))
    cut = packed.select(*[state.shorten(F.col("s"), packed.schema["s"].dataType, n)["text"].alias(f"c{n}") for n in (None, 600)]).first()
    assert len(cut[0]) == 2000 and len(cut[1]) < 700
