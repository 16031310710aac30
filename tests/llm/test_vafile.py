import math

import numpy as np

from evalspark.llm import vafile


def brute(rows, queries, k):
    """Every query against every row of another id."""
    rows = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
                   if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, v in rows:
        if queries(i):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i and len(w) == len(v))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, queries, k):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    vectors = vafile.integer_vectors(frame)
    return sorted(tuple(r) for r in vafile.top_k(vectors, vectors.where(queries), k).collect())


def test_whole_table(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert run(spark, rows, "vec_id % 50 = 0", 5) == brute(rows, lambda i: i % 50 == 0, 5)


def test_ties_copies_and_batches(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=3).round(1).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5, 0.5, 0.5]) for i in range(200)]  # one vector many times
    rows += [(600 + i, rng.normal(size=4).tolist()) for i in range(3)]  # fewer than k of this length
    monkeypatch.setattr(vafile, "QUERY_BATCH", 10)
    assert run(spark, rows, "vec_id % 7 = 0", 5) == brute(rows, lambda i: i % 7 == 0, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (5, []), (6, [-1.0, 0.5]),
            (7, [3.0])]
    assert run(spark, rows, "true", 5) == brute(rows, lambda i: True, 5) == [(0, 1, 6, 0 - 256 * 256 + 512 * 128), (6, 1, 0, 0)]
    assert run(spark, [], "true", 5) == []
    assert run(spark, rows, "false", 5) == []
