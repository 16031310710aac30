"""TF-IDF weights and multinomial naive Bayes as relational operations.

The term counts of a row are made inside the row, without a shuffle. Only document frequencies
(pre-aggregated) and the sums per row or per class are shuffled. The fitted vocabulary is a staged table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from evalspark.functions import text as texts
from evalspark.functions.scalars import argmax_label
from evalspark.functions.ordered import running_totals
from evalspark.functions.skew import lookup
from evalspark.operators.sampling import first_by_hash
from evalspark.session import new_path, stage

# Fixed value: the smoothing of the naive Bayes baseline.
ALPHA = 0.1


COUNTS = "term_counts"  # a column: the distinct terms of a text with their counts


def _counted(df: DataFrame, text: str, bigrams: bool, stop_words: Sequence[str]) -> tuple[DataFrame, Column]:
    """``df`` with helper columns, and the expression that makes the counts of a row from them.

    The words of a text are sorted and equal neighbours counted, all within the row.
    """
    tokens = texts.without(texts.words(F.col(text)), stop_words)
    if bigrams:
        tokens = texts.with_bigrams(tokens)
    listed = df.withColumn("_terms", F.sort_array(tokens))
    is_first = lambda i: (i == 0) | (F.get("_terms", i) != F.get("_terms", i - 1))
    # No filter on empty texts: it would be pushed below and split every text a second time.
    positions = F.when(F.size("_terms") > 0, F.sequence(F.lit(0), F.size("_terms") - 1))
    none = F.array().cast("array<int>")
    starts = listed.withColumn("_starts", F.coalesce(F.filter(positions, is_first), none))
    ends = F.concat(F.slice("_starts", F.lit(2), F.size("_terms")), F.array(F.size("_terms")))
    counts = F.zip_with(
        "_starts", ends, lambda a, b: F.struct(F.get("_terms", a).alias("term"), (b - a).cast("long").alias("tf"))
    )
    return starts, F.when(F.size("_terms") > 0, counts)


def with_counts(
    df: DataFrame, text: str, bigrams: bool = False, stop_words: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """row_id, the ``keep`` columns and ``term_counts``, written once for all passes of a fit.

    Splitting texts costs more than reading the counts back. Rows that carry counts already stay
    as they are.
    """
    if COUNTS in df.columns:
        return df
    rows, counts = _counted(df, text, bigrams, stop_words)
    return stage(rows.select("row_id", *keep, counts.alias(COUNTS)), "term-counts")


def term_counts(
    df: DataFrame, text: str = "text", bigrams: bool = False, stop_words: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """row_id, term, tf (and the ``keep`` columns): one row per distinct term of a text."""
    if COUNTS in df.columns:
        return df.select("row_id", *keep, F.inline(COUNTS))
    # The expression goes into the generator itself. As a column of its own it would get a
    # not-empty filter, which repeats all of the work above for every element.
    rows, counts = _counted(df, text, bigrams, stop_words)
    return rows.select("row_id", *keep, F.inline(counts))


@dataclass(frozen=True)
class TfidfModel:
    """A vocabulary with document frequencies, learned from training rows only."""

    vocabulary: DataFrame  # term, df, idf (staged)
    n_docs: int
    text: str
    bigrams: bool
    stop_words: tuple[str, ...]

    def raw(self, df: DataFrame, terms: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """row_id, term, tf, raw = (1 + ln tf) * idf and the other columns of ``terms`` for known terms."""
        counts = term_counts(df, self.text, self.bigrams, self.stop_words, keep)
        return lookup(counts, terms, "term", "df").withColumn(
            "raw", (1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf")
        )

    def weights(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """row_id, term, tf, weight: the raw weights scaled to length 1 per row."""
        raw = self.raw(df, self.vocabulary, [c for c in keep if c != "idf"])
        # Grouped into arrays and not over a window: the pairs of a row move once, together, and are neither
        # sorted nor buffered on their own.
        entry = F.struct("term", "tf", "raw", *[c for c in keep if c == "idf"])
        others = [c for c in keep if c != "idf"]
        rows = raw.groupBy("row_id", *others).agg(
            F.collect_list(entry).alias("entries"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
        out = rows.select("row_id", *others, "length", F.inline("entries"))
        return out.select("row_id", *keep, "term", "tf", (F.col("raw") / F.col("length")).alias("weight"))


def fit_tfidf(
    train: DataFrame, text: str = "text", bigrams: bool = False, min_df: int = 1, max_features: int | None = None,
    stop_words: Sequence[str] = (),
) -> TfidfModel:
    """idf = ln((1 + N) / (1 + df)) + 1 over the training rows.

    ``max_features`` keeps the terms with the highest total count, ties by the hash order of terms.
    """
    n_docs = train.count()
    found = term_counts(train, text, bigrams, stop_words).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("total")
    ).where(F.col("df") >= min_df)
    if max_features is not None:
        found = top_terms(stage(found, "term-totals"), max_features)
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    vocabulary = stage(found.select("term", "df", idf.alias("idf")), "vocabulary")
    return TfidfModel(vocabulary, n_docs, text, bigrams, tuple(stop_words))


def top_terms(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` terms of highest ``total``. Found by the total of the n-th term, not by a sort.

    Few distinct totals occur, so counting terms per total is a small table. Among the terms of
    the last total, the first by hash order fill up.
    """
    if counts.count() <= n:
        return counts
    per_total = counts.groupBy((-F.col("total")).alias("order")).agg(F.count("*").alias("terms"))
    ranked = running_totals(per_total, [], "order", {"terms": "before"})
    last = ranked.where((F.col("before") < n) & (F.col("before") + F.col("terms") >= n)).first()
    if last is None:
        return counts
    tied = counts.where(F.col("total") == -last["order"])
    return counts.where(F.col("total") > -last["order"]).unionByName(
        first_by_hash(tied, "term", n - last["before"], "terms")
    )


@dataclass(frozen=True)
class NaiveBayesModel:
    """Log probabilities per term and class, next to the TF-IDF model they belong to."""

    tfidf: TfidfModel
    labels: tuple[str, ...]
    terms: DataFrame  # term, df, idf, logp: array<double> in label order (staged)
    log_prior: tuple[float, ...]

    def predict(self, df: DataFrame) -> DataFrame:
        """row_id, pred, probabilities (array in label order). A row without a known term gets the prior."""
        # The length scaling is taken out of the sums, so one aggregation per row does both.
        length = F.sqrt(F.sum(F.col("raw") * F.col("raw")))
        per_label = [
            (F.sum(F.col("raw") * F.col("logp")[i]) / length).alias(f"_joint_{i}") for i in range(len(self.labels))
        ]
        sums = self.tfidf.raw(df, self.terms).groupBy("row_id").agg(*per_label)
        scores = [F.coalesce(F.col(f"_joint_{i}"), F.lit(0.0)) + F.lit(p) for i, p in enumerate(self.log_prior)]
        scored = df.select("row_id").join(sums, "row_id", "left").select(
            "row_id", *[s.alias(f"_score_{i}") for i, s in enumerate(scores)]
        )
        names = [f"_score_{i}" for i in range(len(self.labels))]
        return scored.select(
            "row_id", argmax_label([F.col(c) for c in names], self.labels).alias("pred"), _probabilities(names).alias("probabilities"))


def _probabilities(names: Sequence[str]) -> Column:
    """The columns, joint log scores, as an array of probabilities."""
    top = F.greatest(*names)
    exps = [F.exp(F.col(c) - top) for c in names]
    total = sum(exps[1:], exps[0])
    return F.array(*[e / total for e in exps])


def fit_naive_bayes(
    train: DataFrame, labels: Sequence[str], text: str = "text", label: str = "label", alpha: float = ALPHA,
    tfidf: TfidfModel | None = None, **options,
) -> NaiveBayesModel:
    """Multinomial naive Bayes on TF-IDF weights; class priors are the plain label shares."""
    labels = tuple(labels)
    train = with_counts(train, text, options.get("bigrams", False), options.get("stop_words", ()), keep=[label])
    tfidf = tfidf or fit_tfidf(train, text, **options)
    weights = tfidf.weights(train.select("row_id", COUNTS, F.col(label).alias("_label")), keep=["_label", "idf"])
    sums = [F.sum(F.when(F.col("_label") == l, F.col("weight")).otherwise(0.0)).alias(f"_sum_{i}")
            for i, l in enumerate(labels)]
    per_term = stage(
        weights.groupBy("term").agg(F.count("*").alias("df"), F.any_value("idf").alias("idf"), *sums), "class-weights"
    )
    totals = per_term.agg(F.count("*").alias("size"), *[F.sum(f"_sum_{i}").alias(f"t{i}") for i in range(len(labels))])
    fitted = totals.first()
    tally = {r["label"]: r["n"] for r in train.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
             .where(F.col("label").isin(list(labels))).collect()}
    n = sum(tally.values())
    logp = [F.log((F.col(f"_sum_{i}") + alpha) / (fitted[f"t{i}"] + alpha * fitted["size"])) for i in range(len(labels))]
    terms = stage(per_term.select("term", "df", "idf", F.array(*logp).alias("logp")), "class-logs")
    prior = tuple(log(tally[l] / n) if tally.get(l) else float("-inf") for l in labels)
    return NaiveBayesModel(tfidf, labels, terms, prior)


def out_of_fold(
    rows: DataFrame, labels: Sequence[str], folds: int, text: str = "text", label: str = "label", alpha: float = ALPHA,
) -> DataFrame:
    """row_id, fold, raw: the class probabilities of every row by the naive Bayes model of the other folds.

    Document frequencies are counted once, per term and fold; the model of a fold knows the total less the fold, its vocabulary
    included. The weights of a row change with the model only by the row's length and by idf, which is the same for all rows of a
    term. So one sum per term, model and class of what rows hold before idf gives all models, and the number of scans does
    not grow with the folds. Rows without a fold take no part.
    """
    rows = with_counts(rows, text, keep=[label, "fold"]).where("fold IS NOT NULL")
    models, classes = range(folds), range(len(labels))
    tally = {(r["fold"], r["label"]): r["n"] for r in rows.groupBy(
        "fold", F.when(F.col(label).isin(list(labels)), F.col(label)).alias("label")).agg(F.count("*").alias("n")).collect()}
    others = [{l: sum(n for (f, of), n in tally.items() if f != m and of == l) for l in [*labels, None]} for m in models]
    n_docs = [sum(o.values()) for o in others]
    log_prior = [[log(o[l] / (n - o[None])) if o[l] else float("-inf") for l in labels] for o, n in zip(others, n_docs)]

    counts = term_counts(rows, text, keep=[label, "fold"])
    per_fold = [F.count_if(F.col("fold") == m).alias(f"_df_{m}") for m in models]
    seen = [F.col("df") - F.col(f"_df_{m}") for m in models]
    idf = [F.when(d > 0, F.log((1.0 + n) / (1.0 + d)) + 1.0) for d, n in zip(seen, n_docs)]
    vocabulary = stage(counts.groupBy("term").agg(F.count("*").alias("df"), *per_fold).select("term", "df", F.array(*idf).alias("idf")),
                       "fold-vocabulary")

    strength = 1.0 + F.log(F.col("tf").cast("double"))
    parts = lookup(counts, vocabulary, "term", "df").withColumn("part", strength)
    squares = [F.sum(F.pow(F.col("part") * F.coalesce(F.col("idf")[m], F.lit(0.0)), 2)) for m in models]
    weighed = stage(parts.groupBy("row_id", label, "fold").agg(
        F.array(*[F.sqrt(x) for x in squares]).alias("lengths"), F.collect_list(F.struct("term", "part")).alias("entries")), "fold-weights")

    held = weighed.select(F.col(label).alias("_label"), "fold", "lengths", F.inline("entries"))
    learned = [F.sum(F.when((F.col("_label") == l) & (F.col("fold") != m), F.col("part") / F.col("lengths")[m]).otherwise(0.0))
               for m in models for l in labels]
    at = lambda m, c: m * len(labels) + c
    sums = held.groupBy("term").agg(F.array(*learned).alias("_sums")).join(vocabulary, "term")
    weights = [F.coalesce(F.col("idf")[m] * F.col("_sums")[at(m, c)], F.lit(0.0)) for m in models for c in classes]
    per_term = stage(sums.select("term", "df", "idf", F.array(*weights).alias("weights")), "fold-class-weights")
    total = per_term.agg(*[F.count(F.col("idf")[m]).alias(f"size_{m}") for m in models],
                         *[F.coalesce(F.sum(F.col("weights")[i]), F.lit(0.0)).alias(f"t{i}") for i in range(folds * len(labels))]).first()

    def logs(m: int) -> list[Column]:
        return [F.log((F.col("weights")[at(m, c)] + alpha) / (total[f"t{at(m, c)}"] + alpha * max(total[f"size_{m}"], 1))) for c in classes]

    known = [F.when(F.col("idf")[m].isNotNull(), F.struct(F.col("idf")[m].alias("idf"), F.array(*logs(m)).alias("logp"))) for m in models]
    terms = stage(per_term.select("term", "df", F.array(*known).alias("models")), "fold-class-logs")
    asked = weighed.select("row_id", "fold", F.get("lengths", "fold").alias("length"), F.inline("entries"))
    model = F.get("models", "fold")
    weight = F.when(F.col("length") > 0, F.col("part") * model["idf"] / F.col("length"))  # 0: the model knows no term of the row
    found = lookup(asked, terms, "term", "df").select("row_id", weight.alias("weight"), model["logp"].alias("logp"))
    joint = found.groupBy("row_id").agg(*[F.sum(F.col("weight") * F.col("logp")[c]).alias(f"_joint_{c}") for c in classes])
    prior = [F.get(F.array(*[F.lit(log_prior[m][c]) for m in models]), F.col("fold")) for c in classes]
    scored = rows.select("row_id", "fold").join(joint, "row_id", "left").select(
        "row_id", "fold", *[(F.coalesce(F.col(f"_joint_{c}"), F.lit(0.0)) + prior[c]).alias(f"_score_{c}") for c in classes])
    return scored.select("row_id", "fold", _probabilities([f"_score_{c}" for c in classes]).alias("raw"))


def number_terms(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary with ``position``: terms numbered from 0, in order of a hash prefix and the term."""
    prefixed = vocabulary.select("term", "df", "idf", F.substring(F.sha2("term", 256), 1, 3).alias("_prefix"))
    before = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = prefixed.groupBy("_prefix").agg(F.count("*").alias("n")).select(
        "_prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")
    )
    place = F.row_number().over(Window.partitionBy("_prefix").orderBy("term"))
    return prefixed.withColumn("_place", place).join(starts, "_prefix").select(
        "term", "df", "idf", (F.col("_start") + F.col("_place") - 1).cast("int").alias("position")
    )


def placed_terms(vocabulary: DataFrame, width: int) -> tuple[DataFrame, int]:
    """The vocabulary with ``position``, and the number of positions.

    Up to ``width`` terms get a position each. A larger vocabulary is hashed into ``width`` positions; terms that
    meet there add up, and none is dropped.
    """
    size = vocabulary.count()
    if size <= width:
        return stage(number_terms(vocabulary), "term-positions"), size
    place = F.pmod(F.xxhash64("term"), F.lit(width)).cast("int")
    return stage(vocabulary.select("term", "df", "idf", place.alias("position")), "term-positions"), width


@dataclass(frozen=True)
class TermVectors:
    """Sparse rows in a staged table: row_id, features = struct(type, size, indices, values).

    That struct is the file layout of Spark's vector types, so the same files can be read back as
    vectors and no value leaves the JVM to build them.
    """

    spark: SparkSession
    path: str
    others: tuple[StructField, ...]  # row_id and the kept columns

    def _read(self, dtype: DataType) -> DataFrame:
        schema = StructType([*self.others, StructField("features", dtype)])
        return self.spark.read.schema(schema).parquet(self.path)

    def vectors(self) -> DataFrame:
        return self._read(VectorUDT())

    def entries(self, keep: Sequence[str] = ()) -> DataFrame:
        """row_id, indices, values, and kept columns."""
        return self._read(VectorUDT.sqlType()).select("row_id", "features.indices", "features.values", *keep)


def to_vectors(model: TfidfModel, numbered: DataFrame, size: int, rows: DataFrame, keep: Sequence[str] = ()) -> TermVectors:
    """One sparse TF-IDF vector per row of ``rows``, with its ``keep`` columns; a row without known terms is all zero.

    One lookup per term and one shuffle per row; terms of one position add up, and the scaling to length 1
    is done inside the row. There are at least as many files as cores, so that later passes use all.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = model.raw(rows, numbered).select("row_id", "position", "raw").repartition(parts, "row_id")
    entries = placed.groupBy("row_id", "position").agg(F.sum("raw").alias("raw")).groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "raw"))).alias("entries"),
        F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"),
    )
    empty = F.array().cast("array<struct<position:int,raw:double>>")
    filled = rows.select("row_id", *keep).join(entries, "row_id", "left").withColumn("entries", F.coalesce("entries", empty))
    sparse = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.col("entries.position").alias("indices"),
        F.transform("entries.raw", lambda v: v / F.col("length")).alias("values"),
    )
    path = new_path(spark, "term-vectors")
    filled.select("row_id", *keep, sparse.alias("features")).write.parquet(path)
    return TermVectors(spark, path, tuple(StructField(c, rows.schema[c].dataType) for c in ["row_id", *keep]))
