import public_tokenizers
from test_ngram_join import brute

import corpus_pipeline
from evalspark.llm import pii, quality
from test_packing import check
from tokenizers import Tokenizer


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]
    steps = [docs]
    for _, function in corpus_pipeline.STAGES[:-1]:
        steps.append(function(spark, steps[-1], folder).cache())
        assert steps[-1].columns == docs.columns
    rows = [{r["doc_id"]: r["text"] for r in s.collect()} for s in steps]

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert set(rows[1]) == {r["doc_id"] for r in quality.classify(docs, labels).where("keep").collect()}
    last = {}
    for doc_id, text in rows[1].items():
        last[text or ""] = max(doc_id, last.get(text or "", doc_id))
    assert set(rows[2]) == set(last.values())
    groups = brute(list(rows[2].items()), 5, 80)
    assert set(rows[3]) == {i for i, (_, root) in groups.items() if i == root}
    assert set(rows[4]) == set(rows[3])
    for doc_id, text in rows[4].items():
        assert not pii.base_spans(text)
        if not pii.base_spans(rows[3][doc_id]):
            assert text == rows[3][doc_id]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check(corpus_pipeline.run(spark, folder).collect(), rows[4], tokenizer)
