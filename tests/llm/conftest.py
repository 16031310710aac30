from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names the operators use."""
    rows = [
        (1, "a plain little text with a few words", "en", "s", 36, 1, "x"),
        (1, "a plain little text with a few words", "en", "s", 36, 1, "x"),  # a repeated row
        (2, "a plain little text with a few words", None, None, None, 2, None),
        (3, None, "en", "s", 0, 3, None),
        (4, "", "fr", None, 0, 4, None),
        (5, " \t\n ", None, "s", 4, 5, None),
        (6, "12 34 !!", "de", "s", 8, 6, None),
        (None, "nobody knows the number of this text", "en", "s", None, None, None),
        (7, LONG, "en", "s", len(LONG), 7, None),
        (8, LONG + "end", "en", "s", None, 8, None),
        (9, "x" * 300_000, "en", "s", 300_000, 9, None),
        (10, "naïve Übung ÉCOLE 日本語 テキスト \U0001f600 ok", "de", "s", 30, 10, None),
    ]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    clashing = ["n", "cls", "sig", "bucket", "blob", "keep_id", "kept", "keep", "score", "row", "_digest", "_id", "_drop", "root"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in clashing)
    return spark.createDataFrame([(*r[:5], *[r[6]] * len(clashing)) for r in rows], schema).select(*names, *clashing).repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
