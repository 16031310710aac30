import hashlib
import random

import public_tokenizers

from evalspark.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_tree_equals_the_whole(spark, folder):
    tree = byte_bpe.encoder(PATH, public_tokenizers.PATTERN, 5, 3)
    rng = random.Random(4)
    parts = ["the", " ", "  ", "\n", "\t", "don't", "'s", "abc", "ABC", "12", "é", "日本", "\U0001f600", "...", " ", " ", "\x1c", "\x85", "x y", "'", "ll "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = tree.encode(text)
        assert ids == tree.encode_leaf(text), repr(text)
        assert tree.decode(ids) == text.encode()
    for text in ("a" * 50_000, " " * 5000 + "x", "日本語" * 5000, "word " * 20_000):
        assert tree.encode(text) == tree.encode_leaf(text)


def test_whole_table(spark, folder, odd_documents, no_documents):
    tree = byte_bpe.encoder(PATH, public_tokenizers.PATTERN)
    for docs in (spark.read.parquet(f"{folder}/documents.parquet"), odd_documents):
        texts = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
        want = sorted(str((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
                      for i, t in texts for ids in [tree.encode_leaf(t)])
        found = byte_bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, with_ids=False)
        assert sorted(str(tuple(r)) for r in found.collect()) == want
    full = byte_bpe.encode_documents(odd_documents, PATH, public_tokenizers.PATTERN).where("doc_id = 1").first()
    assert bytes(full["decoded"]).decode().startswith("a plain") and len(full["ids"]) == full["n_tokens"]
    assert byte_bpe.encode_documents(no_documents, PATH, public_tokenizers.PATTERN).count() == 0
