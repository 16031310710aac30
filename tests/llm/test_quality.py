from evalspark.llm import quality


def test_agrees_with_labels(spark, folder):
    at = folder.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    found = quality.classify(docs, labels).collect()
    assert len(found) == docs.count()
    good = [r["keep"] for r in found if truth.get(r["doc_id"]) == 1]
    bad = [r["keep"] for r in found if truth.get(r["doc_id"]) == 0]
    assert sum(good) >= 0.97 * len(good)
    assert sum(bad) <= 0.2 * len(bad)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_stage_keeps_what_the_query_keeps(spark, folder):
    at = folder.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.classify(docs, labels).where("keep").collect()}


def test_odd_rows(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    found = quality.classify(odd_documents, none).collect()
    assert len(found) == odd_documents.count() and all(r["keep"] and r["score"] == 1 for r in found)
    odd = spark.createDataFrame([(1, 1), (1, None), (None, 0), (2, 0), (2, 1), (3, 0), (4, 1), (5, 0), (6, 1), (7, 0), (8, 1), (9, 1), (10, 0)],
                                "doc_id bigint, quality int")
    found = quality.classify(odd_documents, odd).collect()
    assert len(found) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in found)
    assert quality.keep_good(odd_documents, odd).columns == odd_documents.columns
    assert quality.classify(no_documents, odd).count() == 0 and quality.keep_good(no_documents, none).count() == 0
    assert quality.classify(odd_documents.select("doc_id", "text"), odd).count() == odd_documents.count()
