"""TF-IDF, naive Bayes, table features, clusters and models."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark.functions.vectors import l2_normalise, squared_distance
from evalspark.operators import cluster, models, sampling, scoring, svd, tabular, tfidf
from evalspark.operators.requests import build_requests
from evalspark.operators.stacking import baseline_features
from evalspark.plans import catalog
from evalspark.plans.catalog import DOC_LANG, DOC_QUALITY, ORDER_STATUS, VECTOR_CLASS
from evalspark.registry import sql
from evalspark.registry.base import query
from evalspark.registry.sampling_queries import fold_sql, lang_split
from evalspark.registry.scoring_queries import rounded
from evalspark.session import new_path, stage
from evalspark.sources import tables

WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


def counts_sql(name: str, source: str, tokens: str = WORDS) -> str:
    """CTE ``name``(row_id, label, term, tf)."""
    return f"""{name} AS (SELECT row_id, label, term, count(*) AS tf FROM
  (SELECT row_id, label, unnest({tokens}) AS term FROM {source}) GROUP BY ALL)"""


def weights_sql(fit: str, rows: str, min_df: int) -> str:
    """CTEs ending in ``vocab`` (learned from ``fit``) and ``weights`` of the counts ``rows``."""
    return f"""
n_docs AS (SELECT count(*) AS n FROM train),
vocab AS (SELECT term, count(*) AS df, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf
  FROM {fit}, n_docs GROUP BY term HAVING count(*) >= {min_df}),
raw AS (SELECT row_id, label, term, tf, (1.0 + ln(CAST(tf AS DOUBLE))) * idf AS raw FROM {rows} JOIN vocab USING (term)),
weights AS (SELECT row_id, label, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY row_id)) AS weight FROM raw)"""


@query(
    "tfidf_weights",
    f"""WITH {sql.split(sql.DOCS)}, {counts_sql('train_counts', 'train')}, {counts_sql('all_counts', 'split_rows')},
{weights_sql('train_counts', 'all_counts', 2)}
SELECT row_id, term, tf, round(weight, 6) AS weight FROM weights""",
)
def tfidf_weights(spark, folder):
    """Vocabulary and document frequencies from the train split, weights for every document."""
    split = tfidf.with_counts(lang_split(spark, folder), "text", keep=["split"])
    model = tfidf.fit_tfidf(split.where("split = 'train'"), min_df=2)
    return rounded(model.weights(split))


@query(
    "tfidf_bigrams",
    f"""WITH base AS (SELECT row_id, label, {WORDS} AS w FROM {sql.QUALITY}),
tokens AS (SELECT row_id, label, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS t FROM base),
counted AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(t) AS term FROM tokens) GROUP BY ALL)
SELECT term, count(*) AS df, round(ln((1.0 + (SELECT count(*) FROM base)) / (1.0 + count(*))) + 1.0, 6) AS idf
FROM counted GROUP BY term HAVING count(*) >= 2""",
)
def tfidf_bigrams(spark, folder):
    """The whole vocabulary of words and word pairs."""
    rows = catalog.doc_quality_rows(spark, folder)
    return rounded(tfidf.fit_tfidf(rows, bigrams=True, min_df=2).vocabulary)


def nb_scores_sql() -> str:
    """CTEs ending in ``scores``(row_id, s0, s1): joint log scores of every good/bad document."""
    return f"""{sql.split(sql.QUALITY)}, {counts_sql('train_counts', 'train')}, {counts_sql('all_counts', 'split_rows')},
{weights_sql('train_counts', 'train_counts', 1).replace('weights AS', 'train_weights AS')},
classes AS (SELECT label, ln(count(*) / CAST((SELECT count(*) FROM train) AS DOUBLE)) AS prior FROM train GROUP BY label),
class_sums AS (SELECT label, term, sum(weight) AS s FROM train_weights GROUP BY label, term),
class_totals AS (SELECT label, sum(s) + 0.1 * (SELECT count(*) FROM vocab) AS total FROM class_sums GROUP BY label),
logs AS (SELECT label, term, ln((coalesce(s, 0.0) + 0.1) / total) AS logp
  FROM (SELECT label, total, term FROM class_totals, vocab) LEFT JOIN class_sums USING (label, term)),
all_raw AS (SELECT row_id, term, (1.0 + ln(CAST(tf AS DOUBLE))) * idf AS r FROM all_counts JOIN vocab USING (term)),
joint AS (SELECT row_id, l.label, sum(r * logp) / sqrt(sum(r * r)) AS j FROM all_raw JOIN logs l USING (term) GROUP BY row_id, l.label),
scores AS (SELECT row_id, max(coalesce(j, 0.0) + prior) FILTER (WHERE label = '0') AS s0, max(coalesce(j, 0.0) + prior) FILTER (WHERE label = '1') AS s1
  FROM (SELECT row_id, c.label, prior FROM split_rows, classes c) LEFT JOIN joint USING (row_id, label) GROUP BY row_id)"""


@query(
    "nb_predict",
    f"""WITH {nb_scores_sql()}
SELECT row_id, CASE WHEN s0 >= s1 THEN '0' ELSE '1' END AS pred, round(1.0 / (1.0 + exp(s0 - s1)), 6) AS p_positive FROM scores""",
)
def nb_predict(spark, folder):
    rows = sampling.stratified_split(catalog.doc_quality_rows(spark, folder))
    split = tfidf.with_counts(rows, "text", keep=["label", "split"])
    model = tfidf.fit_naive_bayes(split.where("split = 'train'"), DOC_QUALITY.labels)
    pred = model.predict(split)
    return pred.select("row_id", "pred", F.round(F.col("probabilities")[1], 6).alias("p_positive"))


@query(
    "model_judge",
    f"""WITH {nb_scores_sql()}
SELECT row_id, CASE WHEN s1 >= s0 THEN '1' ELSE '0' END AS pred, round(1.0 / (1.0 + exp(s0 - s1)), 6) AS p_positive FROM scores""",
)
def model_judge(spark, folder):
    """The fitted naive Bayes as a judge of all documents, asked through requests and the answer table."""
    split = sampling.stratified_split(catalog.doc_quality_rows(spark, folder))
    model = models.NaiveBayes().fit(DOC_QUALITY, models.NaiveBayes().prepare(DOC_QUALITY, split.where("split = 'train'")))
    judge = scoring.ModelScorer(DOC_QUALITY, model, "document string", {"text": "document"})
    requests = build_requests(DOC_QUALITY, split, DOC_QUALITY.question())
    records = scoring.score_rows(requests, judge, new_path(spark, "model-answers"))
    return scoring.decode(DOC_QUALITY, records).select("row_id", "pred", F.round("score", 6).alias("p_positive"))


# ---------------------------------------------------------------- tables


@query(
    "standardize",
    f"""SELECT row_id, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS price,
round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS balance FROM {sql.ORDERS}""",
)
def standardize(spark, folder):
    rows = catalog.order_status_rows(spark, folder)
    scaler = tabular.fit_standardiser(rows, ["o_totalprice", "c_acctbal"])
    return rounded(rows.select("row_id", scaler.column("o_totalprice").alias("price"), scaler.column("c_acctbal").alias("balance")))


GAPS = """(SELECT c_custkey AS row_id, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer)"""


def customer_gaps(spark, folder):
    return tables.load(spark, folder, "customer").select(
        F.col("c_custkey").alias("row_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_nationkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"),
    )


@query(
    "impute",
    f"""SELECT row_id, round(coalesce(balance, (SELECT quantile_cont(balance, 0.5) FROM {GAPS})), 6) AS balance,
coalesce(segment, (SELECT segment FROM {GAPS} WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)) AS segment
FROM {GAPS}""",
)
def impute(spark, folder):
    rows = customer_gaps(spark, folder)
    return rounded(tabular.fit_imputer(rows, ["balance"], ["segment"]).transform(rows))


@query(
    "rare_onehot",
    """SELECT o_orderkey AS row_id, CASE WHEN count(*) OVER (PARTITION BY o_custkey) >= 10 THEN CAST(o_custkey AS VARCHAR)
ELSE '__rare__' END AS bucket FROM orders""",
)
def rare_onehot(spark, folder):
    """Customers as categories of their orders: many categories, some of them rare."""
    rows = tables.load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").cast("string").alias("customer")
    )
    return tabular.fit_one_hot(rows, "customer").bucketed(rows, "_found").select("row_id", F.col("_found").alias("bucket"))


@query(
    "ordinal_codes",
    "SELECT row_id, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM " + sql.ORDERS,
)
def ordinal_codes(spark, folder):
    rows = catalog.order_status_rows(spark, folder)
    codes = tabular.ordinal_codes(rows, "o_orderpriority")
    return tabular.with_ordinal_code(rows, codes, "o_orderpriority", "found").select("row_id", F.col("found").alias("code"))


# ---------------------------------------------------------------- clusters

CENTRES = 10
ASSIGNED = f"""
points AS (SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
centres AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS cluster, e AS centre FROM (SELECT * FROM points ORDER BY row_id LIMIT {CENTRES})),
assigned AS (SELECT row_id, label, any_value(e) AS e, arg_min(cluster, (list_distance(e, centre), cluster)) AS cluster
  FROM points, centres GROUP BY row_id, label),
cells AS (SELECT label, cluster, count(*) AS cell_size, sum(count(*)) OVER (PARTITION BY cluster) AS cluster_size FROM assigned GROUP BY label, cluster)"""


def assigned_vectors(spark, folder):
    """Every vector with the nearest of the first ten vectors as its cluster."""
    rows = catalog.vector_class_rows(spark, folder).withColumn("features", F.col("embedding").cast("array<double>"))
    first = rows.orderBy("row_id").limit(CENTRES).select("features").collect()
    return cluster.assign_nearest(rows, [r["features"] for r in first]).drop("embedding")


@query(
    "cluster_cells",
    f"""WITH {ASSIGNED} SELECT label, CAST(cluster AS INTEGER) AS cluster, cell_size, CAST(cluster_size AS BIGINT) AS cluster_size,
round(cell_size / cluster_size, 3) AS label_share FROM cells""",
)
def cluster_cells(spark, folder):
    return cluster.cluster_cells(assigned_vectors(spark, folder))


@query(
    "cell_representatives",
    f"""WITH {ASSIGNED},
parts AS (SELECT row_id, label, cluster, unnest(e) AS x, unnest(range(len(e))) AS i FROM assigned),
means AS (SELECT label, cluster, i, avg(x) AS m FROM parts GROUP BY label, cluster, i),
distances AS (SELECT row_id, label, cluster, sqrt(sum((x - m) * (x - m))) AS d FROM parts JOIN means USING (label, cluster, i) GROUP BY ALL),
flagged AS (SELECT *, row_id % 3 <> 0 AS short FROM distances),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label, cluster ORDER BY short DESC, d, row_id) AS place FROM flagged)
SELECT label, CAST(cluster AS INTEGER) AS cluster, cell_size, row_id, round(d, 6) AS distance
FROM ranked JOIN cells USING (label, cluster) WHERE place = 1 AND cell_size >= 3""",
)
def cell_representatives(spark, folder):
    rows = assigned_vectors(spark, folder).withColumn("short", F.col("row_id") % 3 != 0)
    found = cluster.cell_representatives(rows).select("label", "cluster", "cell_size", "row_id", "distance")
    return rounded(found)


@query(
    "l2_normalise",
    """SELECT vec_id AS row_id, array_to_string(list_transform(e, lambda x: CAST(CAST(round(x / n * 1000) AS BIGINT) AS VARCHAR)), ' ') AS v
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings)""",
)
def l2(spark, folder):
    rows = catalog.vector_class_rows(spark, folder)
    unit = l2_normalise(F.col("embedding").cast("array<double>"))
    shown = F.array_join(F.transform(unit, lambda x: F.round(x * 1000).cast("long").cast("string")), " ")
    return rows.select("row_id", shown.alias("v"))


KNOWN_TERMS = f"""WITH terms AS (SELECT DISTINCT row_id, unnest({WORDS}) AS term FROM {sql.DOCS}),
known AS (SELECT term FROM terms GROUP BY term HAVING count(*) >= 2)"""


@query(
    "svd_features",
    f"""{KNOWN_TERMS} SELECT row_id, CAST(least(100, (SELECT count(*) FROM known)) AS INTEGER) AS dimensions, true AS unit_length
FROM {sql.DOCS}""",
)
def svd_features(spark, folder):
    """Documents as SVD vectors of their TF-IDF weights: how many numbers each has, and that its length is 1
    (or 0, for a document of which no term is known)."""
    found = cluster.text_features(catalog.doc_lang_rows(spark, folder), "text", stop_words=[])
    squares = F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)
    return found.select("row_id", F.size("features").alias("dimensions"), ((F.abs(squares - 1) < 1e-9) | (squares == 0)).alias("unit_length"))


@query(
    "svd_quality",
    "SELECT count(*) > 0 AS orthonormal, count(*) > 0 AS captures_more_than_columns, count(*) > 0 AS descending FROM documents",
)
def svd_quality(spark, folder):
    """The right singular vectors of the documents: orthonormal, in order of the energy they capture, and
    together capturing more of it than the as many heaviest terms."""
    rows = tfidf.with_counts(catalog.doc_lang_rows(spark, folder), "text")
    model = tfidf.fit_tfidf(rows, min_df=2)
    numbered, size = tfidf.placed_terms(model.vocabulary, cluster.TEXT_WIDTH)
    entries = tfidf.to_vectors(model, numbered, size, rows).entries()
    vectors = svd.right_vectors(entries, size)
    width = vectors.shape[1]
    error = float(abs(vectors.T @ vectors - np.eye(width)).max())
    parts = svd.project(entries, vectors).select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x") * F.col("x")).alias("energy"))
    falling = Window.orderBy("i")
    energy = parts.withColumn("next", F.lead("energy").over(falling)).agg(
        F.sum("energy").alias("captured"), F.bool_and(F.coalesce(F.col("next") <= F.col("energy") * 1.05, F.lit(True))).alias("descending"))
    terms = entries.select(F.explode(F.arrays_zip("indices", "values")).alias("e")).groupBy("e.indices").agg(
        F.sum(F.col("e.values") * F.col("e.values")).alias("w")).orderBy(F.desc("w")).limit(width).agg(F.sum("w").alias("columns"))
    return energy.withColumn("columns", terms.scalar()).select(
        F.lit(error < 1e-8).alias("orthonormal"), (F.col("captured") > F.col("columns")).alias("captures_more_than_columns"), "descending")


def _table_width_sql() -> str:
    buckets = ", ".join(
        f"CASE WHEN count(*) OVER (PARTITION BY {c}) >= 10 THEN {c} ELSE '__rare__' END AS {c}" for c in catalog.ORDER_CATEGORIES
    )
    width = " + ".join([str(len(catalog.ORDER_NUMBERS)), *[f"(SELECT count(DISTINCT {c}) FROM cells)" for c in catalog.ORDER_CATEGORIES]])
    return f"""WITH cells AS (SELECT row_id, {buckets} FROM {sql.ORDERS})
SELECT row_id, CAST({width} AS INTEGER) AS width, {len(catalog.ORDER_CATEGORIES)} AS ones FROM cells"""


@query("table_cluster_features", _table_width_sql())
def table_cluster_features(spark, folder):
    """How many numbers every order has as cluster features, and how many of the category ones are set."""
    found = cluster.cluster_features(ORDER_STATUS, catalog.order_status_rows(spark, folder))
    ones = F.size(F.filter(F.slice("features", len(catalog.ORDER_NUMBERS) + 1, F.size("features")), lambda x: x == 1.0))
    return found.select("row_id", F.size("features").alias("width"), ones.alias("ones"))


def _table_vectors_sql() -> str:
    numbers = ", ".join(
        f"CAST(round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () * 1000) AS BIGINT) AS {c}" for c in catalog.ORDER_NUMBERS
    )
    buckets = ", ".join(
        f"CASE WHEN count(*) OVER (PARTITION BY {c}) >= 10 THEN {c} ELSE '__rare__' END AS {c}" for c in catalog.ORDER_CATEGORIES
    )
    lists = ", ".join(f"list(DISTINCT {c} ORDER BY {c}) AS l_{c}" for c in catalog.ORDER_CATEGORIES)
    parts = f"[{', '.join(catalog.ORDER_NUMBERS)}]"
    for c in catalog.ORDER_CATEGORIES:
        parts = f"list_concat({parts}, list_transform(l_{c}, lambda v: CAST(v = {c} AS BIGINT) * 1000))"
    return f"""WITH cells AS (SELECT row_id, {numbers}, {buckets} FROM {sql.ORDERS}), lists AS (SELECT {lists} FROM cells)
SELECT row_id, array_to_string({parts}, ' ') AS v FROM cells, lists"""


@query("table_vectors", _table_vectors_sql())
def table_vectors(spark, folder):
    """Standardised numbers and one-hot categories of every order, in thousandths."""
    features = cluster.cluster_features(ORDER_STATUS, catalog.order_status_rows(spark, folder))
    shown = F.transform("features", lambda x: F.round(x * 1000).cast("long").cast("string"))
    return features.select("row_id", F.array_join(shown, " ").alias("v"))


def vector_features(spark, folder):
    rows = catalog.vector_class_rows(spark, folder)
    return stage(cluster.cluster_features(VECTOR_CLASS, rows), "features")


@query("kmeans_best", f"""WITH points AS (SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS label FROM embeddings)
SELECT row_id, true AS is_nearest, true AS splits_further FROM points""")
def kmeans_best(spark, folder):
    """The best of four k-means runs: whether every row lies nearest to the mean of its own cluster (give or take the last step of the means), and
    whether rows lie nearer to these means than to the means of the labels, of which there are as many."""
    rows = vector_features(spark, folder)
    model = cluster.kmeans_best(rows, k=10)
    given = stage(cluster.assign_nearest(rows, model.centres.tolist()), "assigned")
    labels = catalog.vector_class_rows(spark, folder).select("row_id", "label")

    def means(grouped, by):
        return grouped.groupBy(by).agg(Summarizer.mean(array_to_vector("features")).alias("m")).select(by, vector_to_array("m").alias("m"))

    own = means(given, "cluster").orderBy("cluster").collect()
    nearest = cluster.assign_nearest(given.withColumnRenamed("cluster", "given"), [r["m"] for r in own])
    to_means = F.array(*[squared_distance(F.col("features"), F.array(*[F.lit(x) for x in r["m"]])) for r in own])
    place = {r["cluster"]: i for i, r in enumerate(own)}
    at = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    slack = 1.1
    measured = nearest.select("row_id", "features", (F.get(to_means, at[F.col("given")]) <= slack * F.array_min(to_means)).alias("is_nearest"))
    by_label = given.join(labels, "row_id")
    of_label = by_label.join(means(by_label, "label"), "label").agg(F.sum(squared_distance(F.col("features"), F.col("m"))).alias("cost"))
    return measured.withColumn("_label_cost", of_label.scalar()).select("row_id", "is_nearest", (F.col("_label_cost") >= model.cost).alias("splits_further"))


@query("choose_k", "SELECT CAST(k AS INTEGER) AS k, count(*) > 0 AS valid FROM range(2, 9) t(k), orders GROUP BY k")
def choose_k(spark, folder):
    """Every k from 2 to 8 has a silhouette between -1 and 1, for table rows."""
    features = stage(cluster.cluster_features(ORDER_STATUS, catalog.order_status_rows(spark, folder)), "features")
    best, scores = cluster.choose_k(features, 2)
    top = max(scores.values())
    return spark.createDataFrame([(k, -1 <= v <= 1 and scores[best.k] == top) for k, v in scores.items()], "k int, valid boolean")


@query("shots_cluster", "SELECT DISTINCT CAST(label AS VARCHAR) AS label, true AS own_label, true AS large_enough FROM embeddings")
def shots_cluster(spark, folder):
    """One example per (label, cluster) cell of the training vectors: of the cell's label, and from cells of three rows or more."""
    train = sampling.stratified_split(catalog.vector_class_rows(spark, folder)).where("split = 'train'")
    cells = cluster.select_cluster_shots(VECTOR_CLASS, train).cells
    truth = train.select("row_id", F.col("label").alias("true_label"))
    return cells.join(truth, "row_id", "left").groupBy("label").agg(
        F.bool_and(F.coalesce(F.col("label") == F.col("true_label"), F.lit(False))).alias("own_label"),
        F.bool_and((F.col("cell_size") >= cluster.MIN_CELL_SIZE) & (F.col("cell_size") <= F.col("cluster_size"))).alias("large_enough"))


# ---------------------------------------------------------------- models


def _baseline(task, rows, baseline=None):
    wide, _ = models.evaluate_baseline(task, sampling.stratified_split(rows), baseline)
    return stage(wide, "baseline-metrics")


def _checked(wide):
    """Field and number of rows, and whether every number is a share."""
    shares = [F.coalesce(F.col(c).between(0, 1), F.lit(True)) for c in ("accuracy", "macro_f1", "f1_positive", "roc_auc")]
    return wide.select("field", "n", functools.reduce(lambda a, b: a & b, shares).alias("valid"), (F.col("macro_f1") > 0).alias("finds_some"))


def _checked_sql(source: str) -> str:
    return f"""WITH {sql.split(source)}
SELECT unnest(['metrics', 'full_test_metrics']) AS field, count(*) AS n, true AS valid, true AS finds_some FROM split_rows WHERE split = 'test'"""


NB_PRED = "(SELECT 0 AS g, label, CASE WHEN s0 >= s1 THEN '0' ELSE '1' END AS pred FROM scores JOIN split_rows USING (row_id) WHERE is_scored)"


@query(
    "baseline_nb",
    f"""WITH {nb_scores_sql()}, m AS ({sql.metric_columns(NB_PRED, ['0', '1'], 'g', None)})
SELECT unnest(['metrics', 'full_test_metrics']) AS field, n, accuracy, macro_f1 FROM m""",
)
def baseline_nb(spark, folder):
    return rounded(_baseline(DOC_QUALITY, catalog.doc_quality_rows(spark, folder)).select("field", "n", "accuracy", "macro_f1"))


# A model that learned nothing is right as often as the most frequent label; this much more is asked for.
MARGIN = 0.1


def _beats_majority(wide, split):
    """Field, number of rows, share of the most frequent test label, and whether the accuracy lies clearly above it."""
    counts = split.where("split = 'test'").groupBy("label").agg(F.count("*").alias("k"))
    share = counts.agg((F.max("k") / F.sum("k")).alias("majority"))
    return wide.select("field", "n", "accuracy").withColumn("majority", share.scalar()).select(
        "field", "n", F.round("majority", 6).alias("majority"), (F.col("accuracy") >= F.col("majority") + MARGIN).alias("beats_majority"))


@query(
    "baseline_svm",
    f"""WITH {sql.split(sql.DOCS)}, counts AS (SELECT label, count(*) AS k FROM split_rows WHERE split = 'test' GROUP BY label)
SELECT unnest(['metrics', 'full_test_metrics']) AS field, CAST(sum(k) AS BIGINT) AS n, round(max(k) / sum(k), 6) AS majority, true AS beats_majority FROM counts""",
)
def baseline_svm(spark, folder):
    rows = catalog.doc_lang_rows(spark, folder)
    return _beats_majority(_baseline(DOC_LANG, rows), sampling.stratified_split(rows))


VECTORS = "(SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS label FROM embeddings)"


@query("baseline_lr", _checked_sql(VECTORS))
def baseline_lr(spark, folder):
    return _checked(_baseline(VECTOR_CLASS, catalog.vector_class_rows(spark, folder)))


@query("baseline_text_lr", _checked_sql(sql.QUALITY))
def baseline_text_lr(spark, folder):
    return _checked(_baseline(DOC_QUALITY, catalog.doc_quality_rows(spark, folder), models.TextLogistic()))


@query("baseline_gbt", _checked_sql(sql.ORDERS))
def baseline_gbt(spark, folder):
    return _checked(_baseline(ORDER_STATUS, catalog.order_status_rows(spark, folder)))


@query(
    "oof_scores",
    f"""WITH {sql.split(VECTORS)}, folds AS ({fold_sql('train')}) SELECT row_id, fold, 10 AS features, true AS sums_to_one FROM folds""",
)
def oof_scores(spark, folder):
    """Out-of-fold scores of every training vector: its fold, and that its probabilities add up to 1."""
    train = sampling.stratified_split(catalog.vector_class_rows(spark, folder)).where("split = 'train'")
    oof, probabilistic = models.oof_scores(VECTOR_CLASS, train)
    features = baseline_features(VECTOR_CLASS, oof, probabilistic)
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    return features.join(oof, "row_id").select(
        "row_id", "fold", F.size("features").alias("features"), (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


OOF_NB = f"""WITH {sql.split(sql.QUALITY)}, folds AS ({fold_sql('train')}),
folded AS (SELECT t.row_id, t.label, t.text, fold FROM train t JOIN folds USING (row_id)), models AS (SELECT k FROM range(5) r(k)),
{counts_sql('base_counts', 'folded')},
counts AS (SELECT c.*, fold FROM base_counts c JOIN folds USING (row_id)),
n_docs AS (SELECT k, count(*) AS n FROM folded, models WHERE fold <> k GROUP BY k),
vocab AS (SELECT k, term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf FROM counts JOIN n_docs ON fold <> k GROUP BY k, term),
raw AS (SELECT k, row_id, label, fold, term, (1.0 + ln(CAST(tf AS DOUBLE))) * idf AS r FROM counts JOIN vocab USING (term)),
learned AS (SELECT k, label, term, r / sqrt(sum(r * r) OVER (PARTITION BY k, row_id)) AS w FROM raw WHERE fold <> k),
class_sums AS (SELECT k, label, term, sum(w) AS s FROM learned GROUP BY ALL),
sizes AS (SELECT k, count(*) AS size FROM vocab GROUP BY k),
class_totals AS (SELECT k, label, sum(s) + 0.1 * any_value(size) AS total FROM class_sums JOIN sizes USING (k) GROUP BY k, label),
logs AS (SELECT k, label, term, ln((coalesce(s, 0.0) + 0.1) / total) AS logp
  FROM (SELECT k, label, total, term FROM class_totals JOIN vocab USING (k)) LEFT JOIN class_sums USING (k, label, term)),
priors AS (SELECT k, label, ln(count(*) / CAST(any_value(n) AS DOUBLE)) AS prior FROM folded JOIN n_docs ON fold <> k GROUP BY k, label),
joint AS (SELECT row_id, l.label, sum(r * logp) / sqrt(sum(r * r)) AS j FROM raw JOIN logs l ON raw.k = l.k AND raw.term = l.term
  WHERE fold = raw.k GROUP BY row_id, l.label),
scores AS (SELECT row_id, fold, max(coalesce(j, 0.0) + prior) FILTER (WHERE label = '0') AS s0, max(coalesce(j, 0.0) + prior) FILTER (WHERE label = '1') AS s1
  FROM (SELECT row_id, fold, p.label, prior FROM folded JOIN priors p ON fold = k) LEFT JOIN joint USING (row_id, label) GROUP BY row_id, fold)
SELECT row_id, fold, round(1.0 / (1.0 + exp(s0 - s1)), 6) AS p_positive FROM scores"""


@query("oof_naive_bayes", OOF_NB)
def oof_naive_bayes(spark, folder):
    """Every training document by the naive Bayes model of the other four folds."""
    train = sampling.stratified_split(catalog.doc_quality_rows(spark, folder)).where("split = 'train'")
    oof, _ = models.oof_scores(DOC_QUALITY, train)
    return oof.select("row_id", "fold", F.round(F.col("raw")[1], 6).alias("p_positive"))
