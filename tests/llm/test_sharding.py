import hashlib
import zlib
from collections import defaultdict

from evalspark.llm import sharding


def expected(rows, shards, slack):
    """(doc_id, size, crc, shard, slot) of (doc_id, text) rows, plainly."""
    placed = sorted(((hashlib.sha256((t or "").encode()).hexdigest(), i is not None, i or 0), i, t or "") for i, t in rows)
    sizes = [len(t.encode()) + 1 for _, _, t in placed]
    total, before, spans = sum(sizes), 0, []
    groups = defaultdict(list)
    for (key, *_), size in zip((p[0] for p in placed), sizes):
        spans.append([before, size, (2 * before + size) * shards // (2 * total), key])
        groups[key].append(spans[-1])
        before += size
    for group in groups.values():
        start, end = group[0][0], group[-1][0] + group[-1][1]
        if group[0][2] != group[-1][2] and (end - start) * shards <= total * slack:
            for span in group:
                span[2] = (start + end) * shards // (2 * total)
    slots, out = defaultdict(int), []
    for (_, i, t), span in zip(placed, spans):
        out.append((i, span[1], zlib.crc32(t.encode()), span[2], slots[span[2]]))
        slots[span[2]] += 1
    return out


def check(docs, shards=16, slack=sharding.SLACK):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = [tuple(r) for r in sharding.assign(docs, shards, slack).collect()]
    order = lambda r: (r[3], r[4])
    assert sorted(found, key=order) == sorted(expected(rows, shards, slack), key=order)
    return found


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)


def test_balance_with_a_hot_text(spark):
    rows = [(i, "the same text again") for i in range(1500)] + [(5000 + i, f"text {i} " * (i % 7)) for i in range(2000)]
    found = check(table(spark, rows))
    sizes, largest = defaultdict(int), max(r[1] for r in found)
    for r in found:
        sizes[r[3]] += r[1]
    assert sorted(sizes) == list(range(16))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * (largest + sharding.SLACK * sum(sizes.values()) / 16)


def test_small_groups_stay_whole(spark):
    rows = [(i, f"a text that {i // 8} others share") for i in range(4000)]
    found = check(table(spark, rows), slack=0.05)
    shards = defaultdict(set)
    for r in found:
        shards[r[2]].add(r[3])
    assert all(len(s) == 1 for s in shards.values())
    assert any(len(s) > 1 for s in _shards_by_text(check(table(spark, rows), slack=0.0)))


def _shards_by_text(found):
    shards = defaultdict(set)
    for r in found:
        shards[r[2]].add(r[3])
    return shards.values()


def test_more_shards_than_documents(spark):
    found = check(table(spark, [(1, "a"), (2, "bb"), (2, "bb")]), shards=64)
    assert len(found) == 3


def test_whole_rows_come_along(odd_documents):
    rows = sharding.assign(odd_documents, 4, whole_rows=True).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert r["document"]["doc_id"] == r["doc_id"] and len((r["document"]["text"] or "").encode()) + 1 == r["size"]
        assert r["document"].asDict().keys() == set(odd_documents.columns)


def test_odd_rows(odd_documents, no_documents):
    check(odd_documents)
    assert sharding.assign(no_documents).count() == 0


def test_no_python_in_the_plan(spark, folder):
    plan = sharding.assign(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
