import hashlib
from collections import defaultdict

from evalspark.llm import exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return groups


def check(found, rows):
    groups = expected(rows)
    kept = defaultdict(list)
    for r in found:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        known = [i for i in groups[text] if i is not None]
        assert r["group_size"] == len(groups[text])
        assert r["keep_id"] == (max(known) if known else None)
        if r["kept"]:
            kept[text].append(r["doc_id"])
    assert {t: [max((i for i in ids if i is not None), default=None)] for t, ids in groups.items()} == dict(kept)


def test_groups_large_and_small(spark):
    rows = [(i, "hot") for i in range(400)] + [(400 + i, f"text {i // 2}") for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    for support in (0.001, 0.1, 0.9):
        check(exact_dedup.decisions(docs, support=support).collect(), rows)
    assert {r["doc_id"] for r in exact_dedup.keep_one(docs, support=0.1).collect()} == {
        399, *range(401, 700, 2), 901}


def test_odd_rows(odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.select("doc_id", "text").collect()]
    check(exact_dedup.decisions(odd_documents).collect(), rows)
    kept = exact_dedup.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    texts = [r["text"] or "" for r in kept.select("text").collect()]
    assert sorted(texts) == sorted({t or "" for _, t in rows})
    assert exact_dedup.decisions(no_documents).count() == 0
    assert exact_dedup.keep_one(no_documents).count() == 0


def test_no_python_in_the_plan(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = exact_dedup.decisions(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
