"""Exact top-k inner products with a vector-approximation file.

Vectors become integers, floor(256 * x). The approximation file keeps one byte per component: the number of
the cell, out of ``CELLS`` equal ones between the smallest and the largest value of that dimension. From the
cell middles follows an approximate score whose error is at most half the cell widths weighed with the
query, so every score lies between two bounds. Queries are taken in batches of at most about
``QUERY_BATCH``; a batch scans the approximation file once, in blocks, and each task keeps only vectors whose upper
bound reaches the (k+1)-th best lower bound it has met. Exact vectors are then read in the order of
their upper bounds: first the best few, whose exact scores give a threshold, then all others whose upper
bound still reaches it. What is left out cannot be among the k best, so the answer is exact.

Equal vectors share one entry with their k + 1 smallest ids; more can never be asked for, so a vector that
fills a third of the table costs no more than any other.

Edge cases: vectors that are null, hold a null or non-finite component, or have a null id take no part;
vectors of different lengths do not meet; repeated rows (same id and vector) count once; an id with several vectors is a
query once for each; fewer than k other vectors give fewer rows; empty tables give no row. Components should be
below 2**20 in size, so that integer scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import batch, map_batches
from evalspark.session import stage

CELLS = 64
QUERY_BATCH = 2048
BLOCK = 2048  # vectors of a block
FIRST_READ = 4  # exact vectors read first, as a multiple of k + 1

RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Distinct ``(vec_id, v)`` of the rows that take part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * 256))
    return vectors.where(F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


class Cells:
    """Cell borders of every dimension, per vector length."""

    def __init__(self, ranges: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.low = {d: low.astype(np.float64) for d, (low, _) in ranges.items()}
        self.width = {d: (high - low + 1) / CELLS for d, (low, high) in ranges.items()}

    def of(self, v: np.ndarray) -> np.ndarray:
        d = v.shape[1]
        return np.clip((v - self.low[d]) / self.width[d], 0, CELLS - 1).astype(np.uint8)

    def middles(self, cells: np.ndarray) -> np.ndarray:
        d = cells.shape[1]
        return self.low[d] + (cells + 0.5) * self.width[d]

    def error(self, queries: np.ndarray) -> np.ndarray:
        """The largest distance between approximate and exact score, with room for rounding."""
        d = queries.shape[1]
        return np.abs(queries) @ self.width[d] * (0.5 + 1e-6) + 1


def _ranges(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    rows = (vectors.select(F.size("v").alias("d"), F.posexplode("v").alias("pos", "x"))
            .groupBy("d", "pos").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect())  # one row per dimension
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {r["d"] for r in rows}:
        mine = sorted((r for r in rows if r["d"] == d), key=lambda r: r["pos"])
        out[d] = (np.array([r["low"] for r in mine], np.float64), np.array([r["high"] for r in mine], np.float64))
    return out


def build(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, Cells]:
    """The exact vectors ``(key, ids, v)``, the approximation file ``(key, d, cells)`` and its borders."""
    order = Window.partitionBy("v").orderBy("vec_id")
    distinct = (vectors.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k + 1)
                .groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")))
    exact = stage(distinct.select(F.monotonically_increasing_id().alias("key"), "ids", "v"), "va-vectors")
    cells = Cells(_ranges(exact))
    schema = pa.schema([("key", pa.int64()), ("d", pa.int32()), ("cells", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            values = part.column(1)
            sizes = values.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                mine = part.filter(pa.array(sizes == d))
                v = mine.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), d)
                found = cells.of(v) if d else np.zeros((len(mine), 0), np.uint8)
                yield batch(schema, {"key": mine.column(0), "d": [d] * len(mine), "cells": [r.tobytes() for r in found]})

    made = map_batches(exact.select("key", "v"), task, "key bigint, d int, cells binary", BLOCK)
    return exact, stage(made, "va-file"), cells


def _candidates(file: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], cells: Cells, keep: int) -> DataFrame:
    """``(qkey, key, approx)`` of the vectors that may be among the ``keep`` best of a query, task by task."""
    shared = file.sparkSession.sparkContext.broadcast(queries)  # one batch of queries
    schema = pa.schema([("qkey", pa.int64()), ("key", pa.int64()), ("approx", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for part in batches:
            sizes = part.column(1).to_numpy()
            for d, (qkeys, q) in shared.value.items():
                mine = part.filter(pa.array(sizes == d))
                if not len(mine):
                    continue
                keys = mine.column(0).to_numpy()
                codes = np.frombuffer(b"".join(mine.column(2).to_pylist()), np.uint8).reshape(len(mine), d)
                approx = cells.middles(codes) @ q.T if d else np.zeros((len(mine), len(q)))
                error = cells.error(q) if d else np.zeros(len(q))
                top = np.concatenate([best.get(d, np.full((keep, len(q)), -np.inf)), approx])
                best[d] = top = np.partition(top, len(top) - keep, axis=0)[-keep:]
                row, col = np.nonzero(approx >= top.min(axis=0) - 2 * error)
                yield batch(schema, {"qkey": qkeys[col], "key": keys[row], "approx": approx[row, col]})

    return map_batches(file, task, "qkey bigint, key bigint, approx double", BLOCK)


def _exact(pairs: DataFrame, exact: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``(qkey, vec_id, score)`` of the pairs, for every id of the vector."""
    shared = exact.sparkSession.sparkContext.broadcast(
        {int(key): row for keys, q in queries.values() for key, row in zip(keys, q.astype(np.int64))})
    schema = pa.schema([("qkey", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            score = [int(shared.value[key] @ np.array(v, np.int64)) for key, v in zip(part.column(0).to_pylist(), part.column(2).to_pylist())]
            yield batch(schema, {"qkey": part.column(0), "ids": part.column(1), "score": score})

    rows = pairs.join(exact, "key").select("qkey", "ids", "v")
    scored = map_batches(rows, task, "qkey bigint, ids array<bigint>, score bigint", BLOCK)
    return scored.select("qkey", F.explode("ids").alias("vec_id"), "score")


def _batch_top_k(exact: DataFrame, file: DataFrame, cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    found: dict[int, list] = {}
    for row in queries.select("qkey", "v").collect():  # one batch
        found.setdefault(len(row["v"]), []).append(row)
    arrays = {d: (np.array([r["qkey"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64).reshape(len(rows), d))
              for d, rows in found.items()}
    keep = k + 1  # one may be the query itself
    errors = queries.sparkSession.createDataFrame(
        [(int(key), float(e)) for d, (keys, q) in arrays.items() for key, e in zip(keys, cells.error(q) if d else np.zeros(len(q)))],
        "qkey bigint, error double")
    by_query = Window.partitionBy("qkey").orderBy(F.desc("approx"), "key")
    near = _candidates(file, arrays, cells, keep).withColumn("place", F.row_number().over(by_query))
    floor = F.max(F.when(F.col("place") == keep, F.col("approx"))).over(Window.partitionBy("qkey"))
    near = (near.withColumn("floor", floor).join(F.broadcast(errors), "qkey")
            .where(F.col("floor").isNull() | (F.col("approx") >= F.col("floor") - 2 * F.col("error"))))
    near = stage(near.select("qkey", "key", "place", (F.col("approx") + F.col("error")).alias("upper")), "va-candidates")

    owners = queries.select("qkey", F.col("vec_id").alias("query_id"))
    first = near.where(F.col("place") <= FIRST_READ * keep)
    ranked = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")

    def best(scores: DataFrame) -> DataFrame:
        others = scores.join(F.broadcast(owners), "qkey").where("vec_id <> query_id")
        return others.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    read = stage(best(_exact(first, exact, arrays)), "va-first")
    certain = read.groupBy("qkey").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    rest = near.where(F.col("place") > FIRST_READ * keep).join(certain, "qkey", "left").where(
        F.col("n").isNull() | (F.col("n") < k) | (F.col("upper") >= F.col("kth")))
    more = _exact(rest.select("qkey", "key"), exact, arrays)
    return best(read.select("qkey", "vec_id", "score").unionByName(more)).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best other vectors of every query: ``query_id, rank, vec_id, score``; ties go to the smaller id.

    Both inputs are ``(vec_id, v)`` as made by ``integer_vectors``.
    """
    spark = vectors.sparkSession
    exact, file, cells = build(vectors, k)
    asked = stage(queries.distinct().withColumn("qkey", F.monotonically_increasing_id()), "va-queries")
    count = asked.count()
    batches = -(-count // QUERY_BATCH)
    out = spark.createDataFrame([], RESULT)
    for turn in range(batches):
        mine = asked.where(F.pmod(F.xxhash64("qkey"), F.lit(batches)) == turn)
        out = out.unionByName(stage(_batch_top_k(exact, file, cells, mine, k), "va-result"))
    return out.select(*[F.col(c).cast(t) for c, t in (("query_id", "long"), ("rank", "int"), ("vec_id", "long"), ("score", "long"))])
