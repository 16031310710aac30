import math
import zlib
from collections import Counter

import numpy as np
import pytest

from evalspark.llm import pitman_yor


def base_rows(rows):
    """Tokens, known tokens and add-one scores, the plain way."""
    words = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total = sum(counts.values())
    return {i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), total,
                sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ws)) for i, ws in words.items()}


def test_base_and_held_out(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = base_rows([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    found = pitman_yor.score_documents(docs).collect()
    assert len(found) == len(want)
    for r in found:
        held, tokens, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["score"] < 0
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    again = pitman_yor.score_documents(docs).collect()
    assert {r["doc_id"]: round(r["score"], 6) for r in again} == {r["doc_id"]: round(r["score"], 6) for r in found}


def seats_of(tokens, words):
    """Seats of (word, code) tokens."""
    counts = Counter(tokens)
    for w in range(words):  # a pair without customers in every context
        for code in range(pitman_yor.CODES):
            counts.setdefault((w, code), 0)
    keys = sorted(counts)
    return pitman_yor.Seats(*(np.array(x) for x in zip(*keys)), np.array([counts[k] for k in keys]), words)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    words = 12
    tokens = [(int(rng.integers(words - 2)), int(rng.integers(5)) if rng.random() < 0.5 else pitman_yor.FREQUENT + int(rng.integers(3))) for _ in range(3000)]
    seats = seats_of(tokens, words)
    parents = np.zeros(pitman_yor.FREQUENT, np.int64)
    seats.place(parents)
    for turn in range(3):
        totals = pitman_yor.Totals(seats.sums(), parents, words - 1)  # the last word stands for the unknown one
        assert totals.c0 == seats.t1.sum() and (totals.t2 <= totals.c2).all()
        p = seats.probabilities(totals)[2].reshape(words, pitman_yor.CODES)
        assert np.allclose(p.sum(axis=0), 1)
        seats.sweep(totals, np.random.default_rng(turn))


def test_draws_follow_the_conditional():
    """Small counts: frequencies of table counts against the exact distribution, by enumeration of seatings."""
    discount, weight = 0.4, 1.7
    logs = pitman_yor.stirling(discount)
    assert np.exp(logs[3, 1]) == pytest.approx((1 - discount) * (2 - discount))
    assert np.exp(logs[3, 2]) == pytest.approx(3 - 3 * discount) and logs[3, 3] == 0
    many = np.full(40_000, 5)
    drawn = pitman_yor.draw_tables(many, np.full(len(many), weight), discount, np.random.default_rng(1))
    p = np.exp(logs[5, 1:6]) * weight ** np.arange(1, 6)
    assert np.allclose(np.bincount(drawn, minlength=6)[1:] / len(many), p / p.sum(), atol=0.01)
    big = pitman_yor.draw_tables(np.full(2000, 5000), np.full(2000, 3.0), 0.5, np.random.default_rng(2))
    assert 1 <= big.min() and big.max() <= 5000 and big.std() > 0


def test_odd_rows(spark, odd_documents, no_documents):
    found = pitman_yor.score_documents(odd_documents).collect()
    assert len(found) == odd_documents.count()
    empty = [r for r in found if r["doc_id"] in (3, 4, 5)]
    assert all(r["n_tokens"] == 1 for r in empty) and len({round(r["score"], 9) for r in empty}) == 1
    assert len({round(r["score"], 9) for r in found if r["doc_id"] in (1, 2)}) == 1
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
    assert pitman_yor.score_documents(no_documents).count() == 0
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    alone = pitman_yor.score_documents(spark.createDataFrame([(i, "all held out") for i in ids], "doc_id bigint, text string")).collect()
    assert all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in alone)


def neighbours_corpus():
    """600 words that are frequent, and a text of 40 others, all with the same ending, that comes 20 times; two
    texts that are held out: those words in the same order and backwards."""
    rng = np.random.default_rng(3)
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    often, seldom = [f"often{i}" for i in range(600)], [f"word{i}same" for i in range(40)]
    texts = [" ".join(rng.permutation(often)) for _ in range(40)] + [" ".join(seldom)] * 20
    return [*zip(ids, texts), (held[0], " ".join(seldom)), (held[1], " ".join(seldom[::-1]))], held


def test_every_neighbour_has_a_restaurant(spark):
    rows, held = neighbours_corpus()
    found = {r["doc_id"]: r["perplexity"] for r in pitman_yor.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[held[0]] < 3 and found[held[1]] > 10 * found[held[0]]


def test_probabilities_sum_to_one_with_other_neighbours():
    rng = np.random.default_rng(6)
    words, others, parents = 12, np.array([3, 3, 4]), np.zeros(pitman_yor.FREQUENT, np.int64)
    contexts = pitman_yor.CODES + len(others)
    tokens = Counter((int(rng.integers(words - 2)), pitman_yor.CODES + int(rng.integers(2))) for _ in range(2000))  # the third has no customers
    word, code = (x.ravel() for x in np.divmod(np.arange(words * contexts), contexts))
    seats = pitman_yor.Seats(word, code, np.array([tokens[k] for k in zip(word.tolist(), code.tolist())]), words)
    seats.place(parents, others)
    for turn in range(3):
        mine = seats.code >= pitman_yor.CODES
        customers, tables = (np.bincount(seats.code[mine] - pitman_yor.CODES, x[mine], 3).astype(np.int64) for x in (seats.count, seats.t2))
        totals = pitman_yor.Totals(seats.sums(), parents, words - 1).own(customers, tables)
        assert customers.sum() == 2000 and customers[2] == 0 and totals.c1.sum() == seats.t2.sum()
        assert np.allclose(seats.probabilities(totals)[2].reshape(words, contexts).sum(axis=0), 1)
        seats.sweep(totals, np.random.default_rng(turn))


def test_owners_add_up_the_buckets(spark):
    """Customers and first tables of every restaurant, as the owners tell them, against plain counts."""
    rows, _ = neighbours_corpus()
    rows += [(5000 + i, f"often{i} word{i % 40}same often{i + 1} seldom{i}") for i in range(300)]
    plain = {i: t.split() + [" end"] for i, t in rows}
    counts = Counter(w for i, ws in plain.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    ranked = sorted(counts, key=lambda w: (-counts[w], np.uint64(pitman_yor.word_hash(w.encode())).astype(np.int64)))
    often = set(ranked[:pitman_yor.FREQUENT])
    followers = {}
    for i, ws in plain.items():
        for v, w in zip(ws, ws[1:]):
            if v not in often:
                followers.setdefault(v, Counter())[w] += zlib.crc32(str(i).encode()) % 7 != 2
    want = Counter((sum(f.values()), sum(n > 0 for n in f.values())) for f in followers.values())

    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    frequent = [pitman_yor.word_hash(w.encode()) for w in ranked[:pitman_yor.FREQUENT]]
    parents = np.array([pitman_yor.ending(w.encode()) for w in ranked[:pitman_yor.FREQUENT]])
    packed = pitman_yor.packed_tokens(docs, frequent, 9).groupBy("bucket")
    merged = packed.applyInArrow(lambda table: pitman_yor._merge(table, parents), pitman_yor.MERGED_SQL).cache()
    letters = pitman_yor._letters(pitman_yor._buckets(merged, [], 8, "seats"), 0, pitman_yor.World(parents), 3).cache()
    answers = pitman_yor._answers(letters, letters, 0).collect()
    found = {}
    for row in merged.where("bucket >= 0").select("bucket", "seats").collect():
        told = pitman_yor.Told([r.asDict() for r in answers if r["bucket"] == row["bucket"]])
        keys = pitman_yor.Bucket(row["seats"], row["bucket"], parents).keys
        assert len(keys) == len(told.customers) == len(told.tables[0])
        for key, pair in zip(keys.tolist(), zip(told.customers.tolist(), told.tables[0].tolist())):
            assert found.setdefault(key, pair) == pair  # every bucket is told the same
    assert Counter(found.values()) == want
