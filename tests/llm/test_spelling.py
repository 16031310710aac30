import itertools
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.llm import spelling


def one_edit(a, b):
    """Whether exactly one inserted, deleted or replaced code point lies between two words."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def expected(rows, slip=None):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= 2 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def found(docs, slip=None):
    return sorted(tuple(r) for r in spelling.group_variants(docs, slip=slip).collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


CHAIN = [("abcdefgh", 96), ("abcdefgx", 48), ("abcdefyx", 24), ("abcdezyx", 12), ("abcdwzyx", 6), ("abcvwzyx", 3)]


def test_chains_ties_and_accents(spark):
    words = CHAIN + [("colour", 9), ("color", 9), ("colours", 4), ("Étéss", 3), ("Étess", 9), ("été÷s", 5), ("été×s", 5), ("four", 50), ("fours", 3),
                     ("maison", 3), ("raison", 7), ("saison", 7), ("rare1x", 2), ("MAISON", 1)]
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words)] + [(None, "colour-colour"), (99, None), (100, "")]
    got = found(table(spark, rows))
    assert got == expected(rows)
    by_word = {r[0]: r for r in got}
    assert by_word["abcvwzyx"][2] == "abcdefgh"
    assert by_word["maison"][1] is None and by_word["colours"][1] == "colour"


def test_planted_slips_on_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = found(docs, spelling.SLIP)
    assert got == expected(rows, spelling.SLIP) and any(r[1] for r in got)


WORD = st.text(alphabet="aeinzéÿ÷", min_size=5, max_size=9)


@settings(max_examples=200, deadline=None)
@given(WORD, st.integers(0, 9), st.sampled_from(["drop", "put", "add"]), st.sampled_from("aeinzéÿ÷"))
def test_one_edit_of_a_word_is_at_most_one_of_its_code(word, at, kind, letter):
    at = min(at, len(word) - 1)
    other = word[:at] + {"drop": "", "put": letter, "add": letter + word[at]}[kind] + word[at + 1:]
    code = lambda w: "".join(spelling.SYMBOLS[ord(c) % 8] for c in w)
    assert code(word) == code(other) or one_edit(code(word), code(other))


def test_the_neighbourhoods_are_whole(spark):
    codes = [c for n in (1, 2, 3) for c in map("".join, itertools.product("0127", repeat=n))]
    rows = spark.createDataFrame([(c,) for c in codes], "code string").select("code", spelling.neighbourhood("code").alias("n")).collect()
    around = {r["code"]: r["n"] for r in rows}
    for a, b in itertools.product(codes, codes):
        assert (b in around[a]) + (a in around[b]) == (2 if a == b else one_edit(a, b))
    assert all(around[c][0] == c and len(set(around[c])) == len(around[c]) for c in codes)


def test_a_word_of_many_copies_meets_its_variants_once(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("frequent frequent frequemt").alias("text"))
    assert found(docs) == [("frequemt", "frequent", "frequent", 2000, 1, 4000), ("frequent", None, "frequent", 4000, 1, None)]


def test_odd_rows(odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.select("doc_id", "text").collect()]
    assert found(odd_documents, 5) == expected(rows, 5)
    assert found(no_documents) == []
