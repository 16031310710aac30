import math
from collections import Counter

import numpy as np
import pytest

from evalspark.llm import langid


def slow_bits(texts, text):
    """Code length of ``text`` after learning ``texts``, escape by escape."""
    counts = [Counter() for _ in range(langid.ORDER + 1)]
    for t in texts:
        padded = b"\0" * langid.ORDER + t
        for i in range(langid.ORDER, len(padded)):
            for k in range(langid.ORDER + 1):
                counts[k][(padded[i - k:i], padded[i])] += 1
    total = 0.0
    padded = b"\0" * langid.ORDER + text
    for i in range(langid.ORDER, len(padded)):
        for k in range(langid.ORDER, -1, -1):
            context = padded[i - k:i]
            seen = {b: n for (c, b), n in counts[k].items() if c == context}
            if padded[i] in seen:
                total -= math.log2(seen[padded[i]] / (sum(seen.values()) + len(seen)))
                break
            if seen:
                total += math.log2((sum(seen.values()) + len(seen)) / len(seen))
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    texts = {"aa": [b"the cat sat", b"the hat"], "bb": [b"le chat noir", b"la chatte"], "cc": [b"zz"]}
    trees = langid.Trees(texts)
    probes = [b"the chat", b"zzz le", "é!".encode(), b"a", b""]
    found = trees.code_lengths(probes)
    for i, probe in enumerate(probes):
        for j, lang in enumerate(trees.langs):
            assert found[i, j] == pytest.approx(slow_bits(texts[lang], probe), rel=1e-4, abs=1e-3)


def test_places():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 3000).astype(np.uint64))
    places = langid.Places(keys)
    assert (places.of(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(np.arange(5000, dtype=np.uint64), keys)
    assert (places.of(other) == -1).all()


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    found = langid.identify(docs).collect()
    assert len(found) == len(truth)
    held = [r for r in found if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_odd_rows(odd_documents, no_documents):
    found = {r["doc_id"]: r for r in langid.identify(odd_documents).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (3, 4, 5, 6))
    assert found[1]["lang_pred"] in ("en", "fr", "de") and found[None]["held_out"] is False
    assert langid.identify(no_documents).count() == 0
    unlabelled = odd_documents.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}


def test_long_rows_leave_room_for_the_others(spark):
    order = spark.range(400).where(~langid.held_out("id")).selectExpr("id", "xxhash64(id) h").orderBy("h", "id").collect()
    ids = [r["id"] for r in order]
    for places in ([0], [1], [0, 1, 5]):
        long = {ids[p] for p in places}
        rows = [(i, "ab " * 200_000 if i in long else f"short text number {i}", "en") for i in ids]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
        found = [r["text"] for r in langid.training_sample(docs).collect()]
        assert len(found) == len(ids) and sum(t.startswith("short") for t in found) == len(ids) - len(places)
        assert sum(len(t) for t in found) <= langid.SAMPLE_BYTES
    assert langid.learn(docs).langs == ["en"]


def test_repeated_ids_keep_the_sample_within_its_bound(spark):
    same = spark.range(5000).selectExpr("1L doc_id", "'one text' text", "'en' lang")
    ids = spark.range(5000).selectExpr("1L doc_id", "concat('text ', id) text", "'fr' lang")
    found = langid.training_sample(same.unionByName(ids)).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in found} == {"en": 1, "fr": langid.SAMPLE_ROWS}


def test_long_texts_are_learned_from_end_to_end(spark):
    text = "".join(f"{n:06d} " for n in range(50_000))
    docs = spark.createDataFrame([(1, text, "en"), (4, "é" * 100_000, "fr")], "doc_id bigint, text string, lang string")
    found = {r["lang"]: r["text"] for r in langid.training_sample(docs).collect()}
    share = langid.SAMPLE_BYTES // langid.SHARES
    assert all(0.9 * share < len(t.encode()) <= share for t in found.values())
    parts = found["en"].split("\n")
    assert len(parts) == langid.STRETCHES and all(p in text for p in parts)
    assert text.startswith(parts[0]) and text.endswith(parts[-1])
