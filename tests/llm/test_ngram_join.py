import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from evalspark.llm import ngram_join
from evalspark.llm.graph import components
from evalspark.session import shared_dir


def sets(rows, n):
    out = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        out[doc_id] = frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()
    return out


def brute(rows, n, percent):
    """Sizes and smallest linked ids, from all pairs."""
    grams = sets(rows, n)
    parent = {d: d for d in grams}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(grams)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = grams[a], grams[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                if 100 * len(x & y) >= percent * len(x | y):
                    lo, hi = sorted((find(a), find(b)))
                    parent[hi] = lo
    return {d: (len(grams[d]), find(d)) for d in ids}


def drifting(seed, count=220, words=60):
    """A chain of copies that drift apart, copies of copies, and texts that share a passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows, current = [], [rng.choice(vocabulary) for _ in range(words)]
    for i in range(count):
        kind = rng.random()
        if kind < 0.5:
            current = list(current)
            for _ in range(rng.randint(0, 3)):
                current[rng.randrange(len(current))] = rng.choice(vocabulary)
            rows.append((i, " ".join(current)))
        elif kind < 0.7:
            rows.append((i, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))])))
        elif kind < 0.8 and rows:
            rows.append((i, rng.choice(rows)[1]))
        else:
            rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))))
    return rows


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (2, 60), (1, 95)])
def test_components_are_those_of_all_pairs(spark, words, percent):
    rows = drifting(words * percent)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"])
             for r in ngram_join.link_documents(docs, ngram_join.Rule(words, percent)).collect()}
    assert found == brute(rows, words, percent)


def test_families_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FAMILY_ROWS", 8)
    rows = drifting(77, count=300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"])
             for r in ngram_join.link_documents(docs, ngram_join.Rule(2, 60)).collect()}
    assert found == brute(rows, 2, 60)


@pytest.mark.parametrize("columns", [3, 2048])
def test_the_product_is_that_of_all_pairs(monkeypatch, columns):
    monkeypatch.setattr(ngram_join, "COLUMNS", columns)
    rng = np.random.default_rng(columns)
    rule = ngram_join.Rule(3, 60)
    for _ in range(30):
        base = rng.integers(0, 40, 30)
        grams = [np.unique(np.where(rng.random(30) < rng.random() * 0.4, rng.integers(0, 60, 30), base)).astype(np.uint64) for _ in range(25)]
        root = rng.integers(0, 12, 25)
        left, right = np.arange(15), np.arange(10, 25)
        links = ngram_join.product_links(grams, left, right, root, rule)
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                both = len(np.intersect1d(grams[x], grams[y]))
                want = root[x] != root[y] and 100 * both >= 60 * (len(grams[x]) + len(grams[y]) - both)
                assert links[i, j] == want
        found = ngram_join.spanning(links, left, right, root)
        assert len(found) < len(set(root.tolist()))
        assert _parts(root, [(left[i], right[j]) for i, j in np.argwhere(links)]) == _parts(root, found)


def _parts(root, pairs):
    """The components that links between rows make of the given ones."""
    label = {int(r): int(r) for r in root}
    for i, j in pairs:
        a, b = label[int(root[i])], label[int(root[j])]
        label = {r: min(a, b) if x in (a, b) else x for r, x in label.items()}
    return label


def test_signatures_meet_for_every_linked_pair():
    """Pairs at the very edge of the threshold share a signature, whatever their sizes."""
    rng = np.random.default_rng(3)
    for percent in (50, 80, 90):
        rule = ngram_join.Rule(3, percent)
        for _ in range(400):
            a = int(rng.integers(1, 400))
            b = int(rng.integers(a, rule.largest_partner(a) + 1))
            shared = rule.needed(a, b)
            if shared > a:
                continue
            pool = rng.choice(1 << 62, a + b, replace=False).astype(np.uint64) * np.uint64(3)
            x, y = np.sort(pool[:a]), np.sort(np.r_[pool[:shared], pool[a:a + b - shared]])
            if a == b == shared:
                continue  # equal sets are merged before
            assert np.intersect1d(ngram_join.signatures(x, rule), ngram_join.signatures(y, rule)).size
            assert ngram_join.overlap_reaches(x, y, shared)
            assert not ngram_join.overlap_reaches(x, y, shared + 1)


def test_odd_rows(odd_documents, no_documents):
    found = ngram_join.link_documents(odd_documents, ngram_join.Rule(3, 90)).collect()
    by_id = defaultdict(list)
    for r in found:
        by_id[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert by_id[1] == [(6, 1)] * 2 and by_id[2] == [(6, 1)]
    assert by_id[3] == by_id[4][:0] + [(0, 3)] and by_id[5] == [(0, 5)]
    assert by_id[6] == [(1, 6)] and by_id[9] == [(1, 9)]
    assert by_id[7] == [(3, 7)] and by_id[8] == [(4, 8)]
    assert by_id[None] == [(5, None)]
    assert ngram_join.link_documents(no_documents, ngram_join.Rule()).count() == 0
    kept = ngram_join.keep_one(odd_documents, ngram_join.Rule(3, 90))
    assert kept.columns == odd_documents.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 1, 3, 4, 5, 6, None, 7, 8, 9, 10])


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(5).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001)], "a bigint, b bigint")
    assert {r["cls"]: r["root"] for r in components(links).collect()} == {**{i: 0 for i in range(200)}, 1000: 1000, 1001: 1000}


def test_linked_pairs_share_what_each_of_them_needs():
    rng = np.random.default_rng(4)
    most = 0
    for percent in (50, 80, 90):
        rule = ngram_join.Rule(3, percent)
        for _ in range(400):
            a = int(rng.integers(1, 600))
            b = int(rng.integers(a, rule.largest_partner(a) + 1))
            shared = rule.needed(a, b)
            if shared > a or a == b == shared:
                continue
            pool = rng.choice(1 << 62, a + b, replace=False).astype(np.uint64) * np.uint64(3)
            x, y = np.sort(pool[:a]), np.sort(np.r_[pool[:shared], pool[a:a + b - shared]])
            band = ngram_join.band_of(b, rule)
            (at_x, need_x), (at_y, need_y) = (ngram_join.signatures_and_needs(z, rule) for z in (x, y))
            both = np.intersect1d(at_x, at_y)
            need = max(need_x[band - ngram_join.band_of(a, rule)], need_y[0])
            assert np.count_nonzero(both & np.uint64(1) == np.uint64(band & 1)) >= need
            most = max(most, need)
    assert most > 3


def with_passage(count=200):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(25)]
    return [(i, " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(80)])) for i in range(count)]


def test_rows_that_share_a_passage_are_no_family(spark, monkeypatch):
    """Each holds few signatures with others, too few for a link; their pairs are not compared and their sets not kept."""
    held, chosen, families, sets_of = [], [], ngram_join._families, ngram_join.sets_of
    monkeypatch.setattr(ngram_join, "_families", lambda members, sizes: held.append(members.count()) or families(members, sizes))
    monkeypatch.setattr(ngram_join, "sets_of", lambda docs, rows, rule: chosen.append(rows.count()) or sets_of(docs, rows, rule))
    rows = with_passage()
    near = rows + [(1000 + i, text + " end") for i, text in rows[:5]]
    docs = spark.createDataFrame(near, "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link_documents(docs, ngram_join.Rule(5, 80)).collect()}
    assert found == brute(near, 5, 80)
    assert held[0] < 20 and chosen[0] < 50


def test_only_the_dropped_ids_stay_on_disk(spark):
    folder = Path(shared_dir(spark).removeprefix("file:")) / "evalspark"
    before = set(folder.glob("*"))
    docs = spark.createDataFrame(with_passage(20) + with_passage(20), "doc_id bigint, text string")
    kept = ngram_join.keep_one(docs, ngram_join.Rule(5, 80))
    assert {p.name.rpartition("-")[0] for p in set(folder.glob("*")) - before} == {"ngram-dropped"}
    assert kept.count() == 40
