import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evalspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(pieces, texts, tokenizer):
    by_doc = defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096 and r["offset"] == 0
    assert len({r["sequence_id"] for r in pieces}) == len(pieces)
    for doc_id, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            piece = ids[at:at + r["length"]]
            assert (r["start"], r["doc_tokens"], len(piece)) == (at, len(ids), r["length"])
            assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["ids"] == piece.tobytes()
            at += r["length"]
        assert at == len(ids)


def test_round_trip(spark, folder, tokenizer):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    check(packing.pack(docs, PATH).collect(), texts, tokenizer)


def test_words_that_are_not_plain(tokenizer):
    texts = ["It's THE <|endoftext|> end-of-it 3.14 ÉCOLE Straße ŒUVRE İstanbul ΣΟΦΟΣ 日本語 \U0001f600 a b c d x\x1cy", "''s 'S don't é Ångstrom ªº µ",
             "(paren) [x] {y} `z` ~!@#$%^&*-_=+|;:\"',.<>/?", "\x00\x01 ok", "ﬁ ligature ǅ"]
    for text in texts:
        found = packing.WordEncoder(PATH).encode([text.encode()])[0]
        assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_lengths():
    assert packing.piece_lengths(1) == [1] and packing.piece_lengths(4096) == [4096]
    assert packing.piece_lengths(10_001) == [4096, 4096, 1024, 512, 256, 16, 1]
    assert packing.piece_lengths(0) == []


def test_odd_rows(odd_documents, no_documents, tokenizer):
    pieces = packing.pack(odd_documents, PATH).collect()
    assert [(r["length"], r["doc_tokens"]) for r in pieces if r["doc_id"] == 3] == [(1, 1)]
    texts = {r["doc_id"]: r["text"] for r in odd_documents.where("doc_id > 2").select("doc_id", "text").collect()}
    check([r for r in pieces if r["doc_id"] is not None and r["doc_id"] > 2], texts, tokenizer)
    assert sum(r["doc_id"] == 1 for r in pieces) == 2 * sum(r["doc_id"] == 2 for r in pieces)
    assert packing.pack(no_documents, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(no_documents, PATH, limit=1000)


def test_strings_of_special_tokens(spark, tokenizer):
    texts = dict(enumerate(["a <|endoftext|> b", "x<|endoftext|>y", "A <|ENDOFTEXT|> b", "<|startoftext|><|endoftext|>", "<|endoftext|> <|EndOfText|> <|endoftext|>"]))
    assert 49407 in tokenizer.encode(texts[0], add_special_tokens=False).ids
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1)
    check(packing.pack(docs, PATH).collect(), texts, tokenizer)


def test_long_words_are_not_remembered():
    encoder = packing.WordEncoder(PATH)
    words = [("字" * 200 + str(i)).encode() for i in range(50)] + [b"q" * 500, b"short"]
    encoder.encode([b" ".join(words)])
    assert list(encoder.words) == [b"short"] and list(encoder.runs) == ["short"]


def test_words_met_again_are_not_encoded_again(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    encoder = packing.WordEncoder(PATH)
    asked, merged = [], encoder.runs.ids_of
    encoder.runs.ids_of = lambda letters: asked.append(letters) or merged(letters)
    texts = [f"often {a} {b}" for a, b in ("ab", "cd", "ef", "gh")]
    for text, found in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert asked.count("often") == 1 and len(asked) == 9
    assert max(len(encoder.words), len(encoder.runs), len(encoder.words.older), len(encoder.runs.older)) <= 3


def test_letters_are_remembered_as_words(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "CACHED_WORDS", 320)
    encoder = packing.WordEncoder(PATH)
    asked, merged = [], encoder.runs.ids_of
    encoder.runs.ids_of = lambda letters: asked.append(letters) or merged(letters)
    stems = [a + b + c for a in "bdfgk" for b in "aeioué" for c in "lmnr"]
    texts = [" ".join(s + mark for s in stems) for mark in ("", ",", "!")]
    for text, found in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert all(asked.count(s) == 1 for s in stems)  # found again as words, whatever marks stand behind them
    assert len(encoder.runs) + len(encoder.runs.older) <= 40  # and not held a second time
