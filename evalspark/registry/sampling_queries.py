"""Splits, folds and samples."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from evalspark.operators import metrics, sampling
from evalspark.plans import catalog
from evalspark.plans.catalog import DOC_LANG
from evalspark.registry import sql
from evalspark.registry.base import query

# Fixed values of the judge limits: a state over 700 characters is not short; strings in examples are cut at 600.
LIMITED_LANG = dataclasses.replace(DOC_LANG, short_state=700, example_text=600)
SHORT_DOC = f"length(to_json({{'article': text}})) <= {LIMITED_LANG.short_state}"


def lang_split(spark, folder, scored_n=None):
    return sampling.stratified_split(catalog.doc_lang_rows(spark, folder), scored_n=scored_n)


def lang_train(spark, folder):
    return lang_split(spark, folder).where(F.col("split") == "train")


@query("stratified_split", f"WITH {sql.split(sql.DOCS)} SELECT row_id, label, split FROM split_rows")
def stratified_split(spark, folder):
    return lang_split(spark, folder).select("row_id", "label", "split")


@query("stratified_split_orders", f"WITH {sql.split(sql.ORDERS)} SELECT row_id, label, split FROM split_rows")
def stratified_split_orders(spark, folder):
    return sampling.stratified_split(catalog.order_status_rows(spark, folder)).select("row_id", "label", "split")


@query("scored_subset", f"WITH {sql.split(sql.DOCS, 50)} SELECT row_id, label FROM split_rows WHERE is_scored")
def scored_subset(spark, folder):
    return lang_split(spark, folder, scored_n=50).where("is_scored").select("row_id", "label")


def fold_sql(source: str) -> str:
    """A query of row_id, label and fold over a table or CTE with row_id and label."""
    sizes = ", ".join(f"(first + n - {i} + 4) // 5 - (first - {i} + 4) // 5 AS s{i}" for i in range(5))
    ends = ["s0", "s0 + s1", "s0 + s1 + s2", "s0 + s1 + s2 + s3"]
    cases = " ".join(f"WHEN place <= {e} THEN {i}" for i, e in enumerate(ends))
    return f"""WITH base AS (SELECT *, {sql.h('fold')} AS hf FROM {source}),
counts AS (SELECT label, count(*) AS n FROM base GROUP BY label),
starts AS (SELECT label, n, CAST(sum(n) OVER (ORDER BY label) - n AS BIGINT) AS first FROM counts),
sizes AS (SELECT label, {sizes} FROM starts),
placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY hf) AS place FROM base)
SELECT row_id, label, CAST(CASE {cases} ELSE 4 END AS INTEGER) AS fold FROM placed JOIN sizes USING (label)"""


@query("stratified_folds", fold_sql(sql.ORDERS))
def stratified_folds(spark, folder):
    return sampling.stratified_folds(catalog.order_status_rows(spark, folder)).select("row_id", "label", "fold")


K_OF_EACH = "(SELECT DISTINCT label, 3 AS k FROM base_rows)"


@query(
    "shots_k",
    f"WITH {sql.split(sql.DOCS)}, {sql.shots('train', K_OF_EACH, SHORT_DOC)} SELECT row_id, label FROM shots",
)
def shots_k(spark, folder):
    train = lang_train(spark, folder)
    return sampling.shots_k(train, list(DOC_LANG.labels), 3, LIMITED_LANG.is_short()).select("row_id", "label")


@query(
    "shots_matched",
    f"""WITH {sql.split(sql.DOCS)},
wanted AS (SELECT label, count(DISTINCT source) AS k FROM train GROUP BY label),
{sql.shots('train', 'wanted', SHORT_DOC)} SELECT row_id, label FROM shots""",
)
def shots_matched(spark, folder):
    """As many rows per label as a reference selection: one row of every (label, source)."""
    train = lang_train(spark, folder)
    sources = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("row_id"), "source")
    reference = train.join(sources, "row_id").groupBy("label", "source").agg(F.min("row_id").alias("row_id"))
    chosen = sampling.shots_matched(train, reference, list(DOC_LANG.labels), LIMITED_LANG.is_short())
    return chosen.select("row_id", "label")


@query(
    "stage2_sample",
    f"""WITH {sql.split(sql.ORDERS)}, {sql.shots('train', K_OF_EACH, None)},
eligible AS (SELECT * FROM train WHERE row_id NOT IN (SELECT row_id FROM shots)),
eligible_n AS (SELECT label, count(*) AS n FROM eligible GROUP BY label),
{sql.quota('sample_q', 'eligible_n', 'least(2000, sum(n))')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql.h('stage2')}) AS place FROM eligible)
SELECT row_id, label FROM ranked JOIN sample_q USING (label) WHERE place <= quota""",
)
def stage2_sample(spark, folder):
    split = sampling.stratified_split(catalog.order_status_rows(spark, folder))
    train = split.where(F.col("split") == "train")
    shots = sampling.shots_k(train, ["0", "1"], 3)
    return sampling.stage2_sample(train, shots).select("row_id", "label")


@query("label_histogram", "SELECT label, count(*) AS n FROM " + sql.ORDERS + " GROUP BY label")
def label_histogram(spark, folder):
    return metrics.label_histogram(catalog.order_status_rows(spark, folder))
