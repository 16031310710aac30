from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalspark.functions import scalars, state, text
from evalspark.operators import tabular, tfidf
from evalspark.plans.catalog import TICKET_CLASSES


def column(spark, values, expression, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r["out"] for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_titles(spark):
    names = ["Braund, Mr. Owen Harris", "A", "A, . B", None, "B, the Countess. of X, Y", "C,Dr"]
    assert column(spark, names, text.extract_title) == ["Mr", "Unknown", "Unknown", "Unknown", "the Countess", "Dr"]


def test_breaks(spark):
    values = ["  a<br />b<br>c<br/>  ", "<BR>x", " \ttext ", "a<br\n/>b"]
    assert column(spark, values, text.strip_breaks) == ["a b c", "<BR>x", "text", "a b"]


@pytest.mark.parametrize("n", [599, 600, 601])
def test_shortening_edge(spark, n):
    (got,) = column(spark, ["x" * n], lambda c: text.truncate(c, 600))
    assert got == ("x" * n if n <= 600 else "x" * 600 + " …")


def test_shortening_strips_the_cut(spark):
    (got,) = column(spark, ["ab \t\n" + " " * 10 + "c" * 10], lambda c: text.truncate(c, 10))
    assert got == "ab …"


def test_shorten_walks_structs_only(spark):
    df = spark.sql("SELECT struct('abcdef' AS a, struct('ghijkl' AS b, 5 AS n) AS s, array('mnopqr') AS l) AS st")
    out = df.select(state.state_json(state.shorten(F.col("st"), df.schema["st"].dataType, 3)).alias("j")).first()["j"]
    assert json.loads(out) == {"a": "abc …", "s": {"b": "ghi …", "n": 5}, "l": ["mnopqr"]}


def test_state_keeps_nulls(spark):
    df = spark.sql("SELECT struct(struct(CAST(NULL AS DOUBLE) AS age, 'x' AS sex) AS p) AS st")
    assert df.select(state.state_json(F.col("st"))).first()[0] == '{"p":{"age":null,"sex":"x"}}'


def test_codes(spark):
    assert column(spark, [1, 3, None], lambda c: scalars.map_code(c, TICKET_CLASSES, True), "int") == ["1st (upper)", "3rd (lower)", None]
    assert column(spark, [1, 4], lambda c: scalars.map_code(c, TICKET_CLASSES, False), "int") == ["1st (upper)", None]
    with pytest.raises(PySparkException):
        column(spark, [4], lambda c: scalars.map_code(c, TICKET_CLASSES, True), "int")


def test_logit_is_clipped(spark):
    got = column(spark, [0.0, 0.5, 1.0], scalars.clipped_logit, "double")
    edge = np.log(1e-4 / (1 - 1e-4))
    assert got == pytest.approx([edge, 0.0, -edge])


TEXTS = ["Ça va? ça VA 12 a b_c été", "", "!!!", None, "x y z", "one two one two one", "naïve naïve façade Straße 東京 東京"]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "row_id int, text string")


def tokens(t):
    return [w for w in re.findall(r"(?u)\b\w\w+\b", (t or "").lower())]


@pytest.mark.parametrize("bigrams", [False, True])
def test_term_counts_against_python(spark, bigrams):
    want = {}
    for i, t in enumerate(TEXTS):
        words = tokens(t)
        want.update({(i, w): n for w, n in Counter(words + [" ".join(p) for p in zip(words, words[1:])] * bigrams).items()})
    got = {(r["row_id"], r["term"]): r["tf"] for r in tfidf.term_counts(docs(spark), bigrams=bigrams).collect()}
    assert got == want


def test_tfidf_against_formula(spark):
    model = tfidf.fit_tfidf(docs(spark))
    got = {(r["row_id"], r["term"]): r["weight"] for r in model.weights(docs(spark)).collect()}
    counts = [Counter(tokens(t)) for t in TEXTS]
    df = Counter(w for c in counts for w in c)
    for i, c in enumerate(counts):
        raw = {w: (1 + np.log(n)) * (np.log((1 + len(TEXTS)) / (1 + df[w])) + 1) for w, n in c.items()}
        norm = np.sqrt(sum(v * v for v in raw.values()))
        for w, v in raw.items():
            assert got.pop((i, w)) == pytest.approx(v / norm)
    assert not got


def test_vocabulary_cap_keeps_the_most_frequent(spark):
    rows = [(i, " ".join(f"w{j:02d}" for j in range(20) if i % (j + 1) == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id int, text string")
    for cap in (1, 3, 7, 20, 50):
        kept = tfidf.fit_tfidf(df, max_features=cap).vocabulary.collect()
        assert len(kept) == min(cap, 20)
        totals = sorted((sum(i % (j + 1) == 0 for i in range(60)) for j in range(20)), reverse=True)
        assert sorted((r["df"] for r in kept), reverse=True) == totals[:cap]


def test_vectors_hold_the_weights(spark):
    model = tfidf.fit_tfidf(docs(spark))
    numbered = tfidf.number_terms(model.vocabulary).cache()
    size = numbered.count()
    assert sorted(r["position"] for r in numbered.collect()) == list(range(size))
    place = {r["term"]: r["position"] for r in numbered.collect()}
    vectors = {r["row_id"]: r["features"] for r in tfidf.to_vectors(model, numbered, size, docs(spark)).vectors().collect()}
    assert len(vectors) == len(TEXTS) and all(v.size == size for v in vectors.values())
    for r in model.weights(docs(spark)).collect():
        assert vectors[r["row_id"]][place[r["term"]]] == pytest.approx(r["weight"])


def test_naive_bayes_against_formula(spark):
    rows = [(0, "aa bb bb", "0"), (1, "aa cc", "1"), (2, "cc dd dd dd", "1"), (3, "bb", "0"), (4, "zz", "1")]
    df = spark.createDataFrame(rows, "row_id int, text string, label string")
    model = tfidf.fit_naive_bayes(df, ("0", "1"))
    test = spark.createDataFrame([(9, "aa dd"), (10, "unknown"), (11, "bb bb zz")], "row_id int, text string")
    got = {r["row_id"]: r["probabilities"] for r in model.predict(test).collect()}
    vocab = sorted({w for _, t, _ in rows for w in t.split()})
    df_of = {w: sum(w in t.split() for _, t, _ in rows) for w in vocab}
    idf = {w: np.log(6 / (1 + df_of[w])) + 1 for w in vocab}

    def weigh(t):
        raw = {w: (1 + np.log(n)) * idf[w] for w, n in Counter(t.split()).items() if w in idf}
        norm = np.sqrt(sum(v * v for v in raw.values())) or 1
        return {w: v / norm for w, v in raw.items()}

    logp, prior = {}, {}
    for c in "01":
        sums = Counter()
        for _, t, l in rows:
            if l == c:
                sums.update(weigh(t))
        total = sum(sums.values()) + 0.1 * len(vocab)
        logp[c] = {w: np.log((sums[w] + 0.1) / total) for w in vocab}
        prior[c] = np.log(sum(l == c for *_, l in rows) / len(rows))
    for i, t in ((9, "aa dd"), (10, "unknown"), (11, "bb bb zz")):
        joint = np.array([prior[c] + sum(v * logp[c][w] for w, v in weigh(t).items()) for c in "01"])
        p = np.exp(joint - joint.max())
        assert got[i] == pytest.approx(list(p / p.sum()))


def test_imputing_and_scaling(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y"), (3, 4.0, None), (4, 9.0, "y"), (5, 2.0, "x")], "row_id int, n double, c string")
    filled = tabular.fit_imputer(df, ["n"], ["c"]).transform(df).orderBy("row_id").collect()
    assert [r["n"] for r in filled] == [1.0, 3.0, 4.0, 9.0, 2.0] and filled[2]["c"] == "x"  # tie: the smaller
    flat = spark.createDataFrame([(5.0,), (5.0,)], "k double")
    assert [r[0] for r in flat.select(tabular.fit_standardiser(flat, ["k"]).column("k")).collect()] == [0.0, 0.0]


def test_rare_categories_share_a_bucket(spark):
    df = spark.createDataFrame([(i, "big") for i in range(12)] + [(20, "small"), (21, None)], "row_id int, c string")
    onehot = tabular.fit_one_hot(df, "c")
    new = spark.createDataFrame([(0, "big"), (1, "small"), (2, "new"), (3, None)], "row_id int, c string")
    got = {r["row_id"]: r["b"] for r in onehot.bucketed(new, "b").collect()}
    assert got == {0: "big", 1: tabular.RARE, 2: tabular.RARE, 3: tabular.RARE}


def test_typing(spark):
    df = spark.createDataFrame([(1, 2.0, "x", True)], "a int, b double, c string, d boolean")
    assert tabular.split_by_type(df, ["a", "b", "c", "d"]) == (["a", "b"], ["c", "d"])


def test_vectors_of_several_lengths_are_an_error(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0, 100.0])], "row_id long, v array<double>")
    with pytest.raises(ValueError, match="2 to 3"):
        tabular.vector_width(df, "v")


def test_a_large_vocabulary_is_hashed_and_drops_no_term(spark):
    df = spark.createDataFrame([(0, "aa bb cc dd"), (1, "aa ee ff gg"), (2, "")], "row_id long, text string")
    counted = tfidf.with_counts(df, "text")
    model = tfidf.fit_tfidf(counted)
    placed, size = tfidf.placed_terms(model.vocabulary, 3)
    assert size == 3 and placed.count() == 7
    rows = {r["row_id"]: (r["indices"], r["values"]) for r in tfidf.to_vectors(model, placed, size, counted).entries().collect()}
    assert all(indices == sorted(set(indices)) for indices, _ in rows.values()) and rows[2] == ([], [])
    exact = {r["term"]: r["idf"] for r in model.vocabulary.collect()}
    places = {r["term"]: r["position"] for r in placed.collect()}
    want = {}
    for term in "aa bb cc dd".split():
        want[places[term]] = want.get(places[term], 0.0) + exact[term]
    length = sum(v * v for v in want.values()) ** 0.5
    assert dict(zip(*rows[0])) == pytest.approx({k: v / length for k, v in want.items()})


def test_ordinal_codes(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["b", "a", None, "c", "a"])], "row_id long, c string")
    codes = tabular.ordinal_codes(df.where("row_id <> 3"), "c")
    got = {r["row_id"]: r["code_"] for r in tabular.with_ordinal_code(df, codes, "c", "code_").collect()}
    assert got == {0: 1, 1: 0, 2: -1, 3: -1, 4: 0}
