"""Exact stratified splits, folds and samples, repeatable by a hash order.

Every row gets a hash of (seed, purpose, row id). "The first n rows of a label" then means: the
rows whose hash is at most the n-th smallest hash of that label. Finding those few cut points
costs small aggregations; applying them is a comparison on each row. No row is shuffled, and no
label is ever ranked in one task, however large it is.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the experiment design.
SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
STAGE2_ROWS = 2000

# Hash prefixes are refined until at most this many rows share one, then those are ranked.
RANKED_ROWS = 1_000_000
HEX_STEP = 3
ABOVE_ALL = "g"  # sorts after every hexadecimal digit


def require_unique(df: DataFrame, row_id: str = "row_id") -> None:
    """Raise when a row id is null or occurs twice. Hashes are compared, combined before the shuffle."""
    twice = df.groupBy(F.xxhash64(F.col(row_id).cast("string")).alias("h"), row_id).agg(F.count("*").alias("n"))
    bad = twice.where((F.col("n") > 1) | F.col(row_id).isNull()).first()
    if bad is not None:
        raise ValueError(f"row ids must be unique and present: {bad[row_id]!r} occurs {bad['n']} times")


def order_hash(row_id: Column, purpose: str, seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|{purpose}|"), row_id.cast("string")), 256)


def local_table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A small driver-made table (cut points, counts) as a DataFrame."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def largest_remainder(counts: Mapping[str, int], total: int) -> dict[str, int]:
    """Share ``total`` among labels in proportion to their counts, exactly.

    What is left after rounding down goes to the largest remainders, ties to the first label.
    """
    size = sum(counts.values())
    if size == 0:
        return {label: 0 for label in counts}
    quota = {label: n * total // size for label, n in counts.items()}
    left = total - sum(quota.values())
    for label in sorted(counts, key=lambda l: (-(counts[l] * total % size), l))[:left]:
        quota[label] += 1
    return quota


class LabelOrder:
    """The hash order inside each label, summarised by counts per hash prefix.

    ``rows`` has the columns ``label`` (string) and ``h`` (order hash).
    """

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        self.spark = rows.sparkSession
        self.prefixes = self._prefix_counts(rows, HEX_STEP).persist()
        sizes = self.prefixes.groupBy("label").agg(F.sum("n").alias("n")).collect()  # one row per label
        self.counts: dict[str, int] = {r["label"]: r["n"] for r in sorted(sizes, key=lambda r: r["label"])}

    @staticmethod
    def _prefix_counts(rows: DataFrame, length: int) -> DataFrame:
        return rows.groupBy("label", F.substring("h", 1, length).alias("prefix")).agg(F.count("*").alias("n"))

    def _locate(self, prefixes: DataFrame, wanted: list[dict]) -> list[dict]:
        """For each (label, rank): the prefix that holds the row, and its rank inside it."""
        targets = local_table(
            self.spark, wanted,
            pa.schema([("label", pa.string()), ("rank", pa.int64()), ("within", pa.string()), ("need", pa.int64())]),
        )
        order = Window.partitionBy("label", "within").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        running = prefixes.withColumn("upto", F.sum("n").over(order))
        found = running.join(F.broadcast(targets), ["label", "within"]).where(
            (F.col("need") <= F.col("upto")) & (F.col("need") > F.col("upto") - F.col("n"))
        )
        return [
            r.asDict()
            for r in found.select(
                "label", "rank", F.col("prefix").alias("within"),
                (F.col("need") - F.col("upto") + F.col("n")).alias("need"), "n",
            ).collect()
        ]

    def _inside(self, located: list[dict]) -> DataFrame:
        """The rows whose label and hash prefix are among the located ones."""
        length = len(located[0]["within"])
        cells = [{"label": a, "within": b} for a, b in sorted({(r["label"], r["within"]) for r in located})]
        table = local_table(self.spark, cells, pa.schema([("label", pa.string()), ("within", pa.string())]))
        rows = self.rows.withColumn("within", F.substring("h", 1, length))
        return rows.join(F.broadcast(table), ["label", "within"])

    def cuts(self, ranks: Mapping[str, list[int]]) -> dict[tuple[str, int], str]:
        """The hash of the row at each wanted 1-based rank of each label."""
        out: dict[tuple[str, int], str] = {}
        wanted = []
        for label, label_ranks in ranks.items():
            for rank in set(label_ranks):
                if rank <= 0:
                    out[label, rank] = ""
                elif rank >= self.counts.get(label, 0):
                    out[label, rank] = ABOVE_ALL
                else:
                    wanted.append({"label": label, "rank": rank, "within": "", "need": rank})
        if not wanted:
            return out

        located = self._locate(self.prefixes.withColumn("within", F.lit("")), wanted)
        while max(r["n"] for r in located) > RANKED_ROWS and len(located[0]["within"]) < 15:
            length = len(located[0]["within"])
            finer = self._prefix_counts(self._inside(located), length + HEX_STEP)
            located = self._locate(finer.withColumn("within", F.substring("prefix", 1, length)), located)

        place = Window.partitionBy("label", "within").orderBy("h")
        needs = local_table(
            self.spark, located,
            pa.schema([("label", pa.string()), ("rank", pa.int64()), ("within", pa.string()), ("need", pa.int64())]),
        )
        ranked = self._inside(located).withColumn("need", F.row_number().over(place).cast("long"))
        for r in ranked.join(F.broadcast(needs), ["label", "within", "need"]).select("label", "rank", "h").collect():
            out[r["label"], r["rank"]] = r["h"]
        return out

    def close(self) -> None:
        self.prefixes.unpersist()


def _label_order(df: DataFrame, label: str, row_id: str, purpose: str, seed: int) -> LabelOrder:
    return LabelOrder(
        df.where(F.col(label).isNotNull()).select(
            F.col(label).cast("string").alias("label"), order_hash(F.col(row_id), purpose, seed).alias("h")
        )
    )


def _with_cuts(df: DataFrame, label: str, cuts: Mapping[str, list[str]]) -> DataFrame:
    """Add ``_cuts``, the label's list of cut hashes, to each row (null for an unknown label)."""
    rows = [{"_label": name, "_cuts": values} for name, values in cuts.items()]
    table = local_table(df.sparkSession, rows, pa.schema([("_label", pa.string()), ("_cuts", pa.list_(pa.string()))]))
    return df.join(F.broadcast(table), F.col(label).cast("string") == F.col("_label"), "left").drop("_label")


def stratified_split(
    df: DataFrame, label: str = "label", row_id: str = "row_id", test: float = TEST_SHARE,
    scored_n: int | None = None, seed: int = SEED,
) -> DataFrame:
    """Add ``split`` ("train"/"test") and ``is_scored``.

    The test split has ceil(test * n) rows, shared among labels by largest remainder of the train
    rows. ``scored_n`` marks a stratified part of the test rows; by default all of them. A row without a
    label stays, with a null split, and is not scored.
    """
    order = _label_order(df, label, row_id, "split", seed)
    size = sum(order.counts.values())
    n_test = ceil(Fraction(str(test)) * size)
    train = largest_remainder(order.counts, size - n_test)
    test_quota = {name: n - train[name] for name, n in order.counts.items()}
    if scored_n is None or scored_n >= n_test:
        scored = test_quota
    else:
        scored = largest_remainder(test_quota, scored_n)
    found = order.cuts({name: [test_quota[name], scored[name]] for name in order.counts})
    order.close()
    cuts = {name: [found[name, test_quota[name]], found[name, scored[name]]] for name in order.counts}
    h = order_hash(F.col(row_id), "split", seed)
    return (
        _with_cuts(df, label, cuts)
        .withColumn("_h", h)
        .withColumn("split", F.when(F.col("_h") <= F.col("_cuts")[0], "test").when(F.col("_cuts").isNotNull(), "train"))
        .withColumn("is_scored", F.coalesce(F.col("_h") <= F.col("_cuts")[1], F.lit(False)))
        .drop("_h", "_cuts")
    )


def fold_sizes(counts: Mapping[str, int], folds: int) -> dict[str, list[int]]:
    """Rows of each label per fold: with the labels laid end to end, position p goes to fold p % folds."""
    sizes, start = {}, 0
    for name in sorted(counts):
        end = start + counts[name]
        sizes[name] = [(end - i + folds - 1) // folds - (start - i + folds - 1) // folds for i in range(folds)]
        start = end
    return sizes


def stratified_folds(
    df: DataFrame, label: str = "label", row_id: str = "row_id", folds: int = FOLDS, seed: int = SEED
) -> DataFrame:
    """Add ``fold`` in 0..folds-1. Fold sizes differ by at most one row, over all and per label.

    A row without a label stays, with a null fold.
    """
    order = _label_order(df, label, row_id, "fold", seed)
    ends = {}
    for name, sizes in fold_sizes(order.counts, folds).items():
        ends[name] = [sum(sizes[: i + 1]) for i in range(folds - 1)]
    found = order.cuts(ends)
    order.close()
    cuts = {name: [found[name, rank] for rank in ranks] for name, ranks in ends.items()}
    h = order_hash(F.col(row_id), "fold", seed)
    return (
        _with_cuts(df, label, cuts)
        .withColumn("_h", h)
        .withColumn("fold", F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col("_h")))))
        .drop("_h", "_cuts")
    )


def stratified_sample(
    df: DataFrame, n: int, label: str = "label", row_id: str = "row_id", purpose: str = "sample", seed: int = SEED
) -> DataFrame:
    """``n`` rows, shared among labels by largest remainder; every row when there are no more than ``n``."""
    order = _label_order(df, label, row_id, purpose, seed)
    if sum(order.counts.values()) <= n:
        order.close()
        return df
    quota = largest_remainder(order.counts, n)
    return _first_of_each(df, order, quota, label, row_id, purpose, seed)


def first_by_hash(df: DataFrame, row_id: str, n: int, purpose: str, seed: int = SEED) -> DataFrame:
    """The first ``n`` rows in hash order, whatever their labels."""
    marked = df.withColumn("_all", F.lit("all"))
    order = _label_order(marked, "_all", row_id, purpose, seed)
    return _first_of_each(marked, order, {"all": n}, "_all", row_id, purpose, seed).drop("_all")


def _first_of_each(
    df: DataFrame, order: LabelOrder, quota: Mapping[str, int], label: str, row_id: str, purpose: str, seed: int
) -> DataFrame:
    found = order.cuts({name: [n] for name, n in quota.items()})
    order.close()
    cuts = {name: [found[name, n]] for name, n in quota.items()}
    h = order_hash(F.col(row_id), purpose, seed)
    return _with_cuts(df, label, cuts).where(h <= F.col("_cuts")[0]).drop("_cuts")


def sample_per_label(
    df: DataFrame, counts: Mapping[str, int], short: Column | None = None, label: str = "label",
    row_id: str = "row_id", salt: str = "", seed: int = SEED,
) -> DataFrame:
    """``counts[label]`` random rows of each label, or all of a smaller label.

    A label with enough ``short`` rows is sampled from those alone, any other from all its rows.
    Equal counts give equal rows; a ``salt`` draws others.
    """
    counts = {name: n for name, n in counts.items() if n > 0}
    name = F.col(label).cast("string")
    pool = df.where(name.isin(list(counts)))
    if short is not None:
        tally = pool.where(short).groupBy(name.alias("label")).agg(F.count("*").alias("n")).collect()
        n_short = {r["label"]: r["n"] for r in tally}
        lacking = [l for l, n in counts.items() if n_short.get(l, 0) < n]
        pool = pool.where(short | name.isin(lacking)) if lacking else pool.where(short)
    purpose = f"shots{salt}"
    order = _label_order(pool, label, row_id, purpose, seed)
    return _first_of_each(pool, order, counts, label, row_id, purpose, seed)


def shots_k(df: DataFrame, labels: list[str], k: int, short: Column | None = None, **options) -> DataFrame:
    """``k`` random training rows per label."""
    return sample_per_label(df, {l: k for l in labels}, short, **options)


def shots_matched(
    df: DataFrame, reference: DataFrame, labels: list[str], short: Column | None = None, label: str = "label", **options
) -> DataFrame:
    """As many random rows per label as ``reference`` holds: the control of a chosen selection."""
    tally = reference.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    found = {r["label"]: r["n"] for r in tally.where(F.col("label").isin(labels)).collect()}
    return sample_per_label(df, {l: found.get(l, 0) for l in labels}, short, label=label, **options)


def without_rows(df: DataFrame, excluded: DataFrame | None, row_id: str = "row_id") -> DataFrame:
    """Rows whose id is not among the excluded ones."""
    return df if excluded is None else df.join(excluded.select(row_id), row_id, "left_anti")


def stage2_sample(
    train: DataFrame, shots: DataFrame | None, n: int = STAGE2_ROWS, label: str = "label", row_id: str = "row_id"
) -> DataFrame:
    """Training rows for the second stage: a stratified sample that leaves out the shown examples."""
    return stratified_sample(without_rows(train, shots, row_id), n, label, row_id, purpose="stage2")
