from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalspark.operators import sampling


def labelled(spark, counts):
    rows, i = [], 0
    for label, n in counts.items():
        rows += [(i + j, label) for j in range(n)]
        i += n
    return spark.createDataFrame(rows, "row_id long, label string")


def tally(df, *by):
    return {tuple(r[c] for c in by): r["count"] for r in df.groupBy(*by).count().collect()}


# Known sizes: rows -> test rows at a share of 0.2.
@pytest.mark.parametrize("counts,test_rows", [
    ({"0": 549, "1": 342}, 179), ({"0": 4825, "1": 747}, 1115),
    ({"a": 510, "b": 386, "c": 417, "d": 511, "e": 401}, 445), ({"x": 50, "y": 50, "z": 50}, 30),
])
def test_split_sizes(spark, counts, test_rows):
    split = sampling.stratified_split(labelled(spark, counts))
    sizes = tally(split, "split")
    assert sizes[("test",)] == test_rows and sum(sizes.values()) == sum(counts.values())
    per_label = tally(split, "label", "split")
    for label, n in counts.items():
        assert abs(per_label[(label, "test")] - 0.2 * n) < 1.001
    assert split.where("is_scored AND split = 'train'").count() == 0
    assert split.where("NOT is_scored AND split = 'test'").count() == 0


def test_scored_subset(spark):
    split = sampling.stratified_split(labelled(spark, {"0": 549, "1": 342}), scored_n=50)
    scored = split.where("is_scored")
    assert scored.count() == 50 and scored.where("split = 'train'").count() == 0
    rate = lambda df: df.agg(F.avg(F.col("label").cast("int"))).first()[0]
    assert abs(rate(scored) - rate(split.where("split = 'test'"))) < 0.05


def test_split_repeats_and_depends_on_seed(spark):
    df = labelled(spark, {"a": 60, "b": 40})
    ids = lambda d: {r["row_id"] for r in d.where("split = 'test'").collect()}
    assert ids(sampling.stratified_split(df)) == ids(sampling.stratified_split(df.repartition(7)))
    assert ids(sampling.stratified_split(df)) != ids(sampling.stratified_split(df, seed=43))


def test_tiny_strata(spark):
    split = sampling.stratified_split(labelled(spark, {"a": 1, "b": 1, "c": 18}))
    assert tally(split, "split") == {("train",): 16, ("test",): 4}


def test_folds(spark):
    counts = {"a": 23, "b": 11, "c": 2}
    folds = sampling.stratified_folds(labelled(spark, counts))
    assert folds.count() == 36 and folds.select("row_id").distinct().count() == 36
    sizes = Counter({f: n for (f,), n in tally(folds, "fold").items()})
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1
    per = tally(folds, "label", "fold")
    for label, n in counts.items():
        got = [per.get((label, f), 0) for f in range(5)]
        assert sum(got) == n and max(got) - min(got) <= 1


def test_refined_prefixes_give_the_same_rows(spark, monkeypatch):
    """The path for very large labels, forced on a small one."""
    df = labelled(spark, {"a": 3000, "b": 1500})
    ids = lambda d: sorted((r["row_id"], r["fold"]) for r in d.collect())
    plain = ids(sampling.stratified_folds(df))
    monkeypatch.setattr(sampling, "HEX_STEP", 1)
    monkeypatch.setattr(sampling, "RANKED_ROWS", 3)
    assert ids(sampling.stratified_folds(df)) == plain


def test_first_rows_are_those_of_the_hash_order(spark):
    df = labelled(spark, {"a": 100, "b": 70})
    got = {(r["label"], r["row_id"]) for r in sampling.sample_per_label(df, {"a": 5, "b": 3}).collect()}
    hashed = [r for r in df.withColumn("h", sampling.order_hash(F.col("row_id"), "shots")).collect()]
    want = set()
    for label, n in (("a", 5), ("b", 3)):
        want |= {(label, r["row_id"]) for r in sorted((r for r in hashed if r["label"] == label), key=lambda r: r["h"])[:n]}
    assert got == want


def test_short_rows_are_preferred_only_when_there_are_enough(spark):
    df = labelled(spark, {"a": 20, "b": 20}).withColumn(
        "short", F.when(F.col("label") == "a", F.col("row_id") < 5).otherwise(F.col("row_id") < 22)
    )
    chosen = sampling.shots_k(df, ["a", "b"], 4, F.col("short")).collect()
    assert Counter(r["label"] for r in chosen) == {"a": 4, "b": 4}
    assert all(r["short"] for r in chosen if r["label"] == "a")  # 5 short rows
    assert not all(r["short"] for r in chosen if r["label"] == "b")  # only 2


def test_small_label_gives_all_its_rows(spark):
    assert sampling.shots_k(labelled(spark, {"a": 2, "b": 9}), ["a", "b"], 3).count() == 5


def test_control_matches_counts_and_salt_draws_others(spark):
    df = labelled(spark, {"a": 60, "b": 60})
    shots = sampling.sample_per_label(df, {"a": 3, "b": 5})
    control = sampling.shots_matched(df, shots, ["a", "b"])
    assert tally(control, "label") == {("a",): 3, ("b",): 5}
    ids = lambda d: {r["row_id"] for r in d.collect()}
    assert ids(control) == ids(shots)  # same order, equal counts
    assert ids(sampling.shots_matched(df, shots, ["a", "b"], salt="x")) != ids(shots)


def test_stage2_sample_leaves_out_shots(spark):
    df = labelled(spark, {"a": 300, "b": 100})
    shots = sampling.shots_k(df, ["a", "b"], 3)
    sample = sampling.stage2_sample(df, shots, n=40)
    assert tally(sample, "label") == {("a",): 30, ("b",): 10}
    assert sample.join(shots, "row_id", "left_semi").count() == 0
    assert sampling.stage2_sample(df, shots).count() == 394  # all of them when there are few


def test_rows_without_a_label_stay(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "ab"[i % 4 // 2]) for i in range(20)], "row_id long, label string")
    split = sampling.stratified_split(df)
    assert split.count() == 20 and split.where("split IS NULL AND NOT is_scored").count() == 10
    assert split.where("split = 'test'").count() == 2
    assert sampling.stratified_folds(df).where("fold IS NULL").count() == 10


def test_many_labels(spark):
    df = spark.range(3000).selectExpr("id AS row_id", "CAST(id % 1500 AS STRING) AS label")
    assert sampling.stratified_split(df).groupBy("split").count().orderBy("split").collect()[0]["count"] == 600
