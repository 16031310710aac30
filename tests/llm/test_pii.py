import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from evalspark.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def brute(text):
    found = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if passes(k, m[0])]
    return sorted(found, key=lambda s: (s[1], list(BASE).index(s[0])))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(11)
    parts = ["4111111111111111", "4111-1111 1111-1111", "1.2.3.4", "300.1.1.1", "+1 (555) 555-0100", "+12", "a@b.c", "@", ".", "-", " ",
             "x", "255", "+", "00", "(", ")", "é", "a.b@c-d.e.f", "\n"]
    for i in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10))) if i % 2 else "".join(
            rng.choice("ab01459.@+- ()%é") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000 + "@", "@a" * 200_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "1-" * 200_000, "a:" * 200_000, "(1" * 200_000):
        pii.base_spans(text)
        pii.loose_matches(text)


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in pii.find(docs).collect():
        base = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in BASE] == [sum(k == b for b, _, _ in base) for k in BASE]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))


@pytest.fixture(scope="module")
def taught(spark):
    """A table with enough personal data to learn from."""
    rng = random.Random(2)
    rows = []
    for i in range(240):
        card = "".join(rng.choice("0123456789") for _ in range(15))
        card = next(card + c for c in "0123456789" if passes("card", card + c))
        ip = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        rows.append((i, f"in {1900 + i} mail p{i}@host{i}.example.com or call +1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} "
                        f"card {card} host {ip} page {i}."))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_loose_forms_are_added_and_look_alikes_are_not(taught):
    selector = pii.learn(taught)
    right = {"Call me on (668) 555-2801 today": "(668) 555-2801", "mail bob.smith [at] example [dot] com now": "bob.smith [at] example [dot] com",
             "host 42[.]144[.]35[.]254 up": "42[.]144[.]35[.]254"}
    for text, value in right.items():
        assert value in [text[a:b] for _, a, b in selector.added(text, pii.base_spans(text))]
    for text in ("on 2021-03-04 we met", "version 1.2.3 of 10.12.99", "pages 100-200", "at the dot com era", "card 4111.1111.1111.1112"):
        assert selector.added(text, pii.base_spans(text)) == []


def test_redaction(taught, odd_documents, no_documents):
    text = pii.redact(taught).orderBy("doc_id").first()["text"]
    assert text == "in 1900 mail [EMAIL] or call [PHONE] card [CARD] host [IP] page 0."
    out = pii.redact(odd_documents)
    assert out.columns == odd_documents.columns
    key = ["doc_id", "text"]
    assert sorted(map(str, out.select(*key).collect())) == sorted(map(str, odd_documents.select(*key).collect()))
    assert pii.redact(no_documents).count() == 0 and pii.find(no_documents).count() == 0


def test_odd_rows(odd_documents):
    empty = hashlib.sha256(b"").hexdigest()
    found = pii.find(odd_documents).collect()
    assert len(found) == odd_documents.count()
    assert all(r["base_sha256"] == empty and r["spans"] == "" for r in found)


def test_a_document_of_numbers_does_not_fill_the_sample(spark, taught):
    numbers = ", ".join(str(10_000 + i) for i in range(45_000))
    first = spark.createDataFrame([(-3, numbers)], "doc_id bigint, text string").coalesce(1)
    plain = "Call me on (668) 555-2801 today"
    selectors = [pii.learn(first.unionByName(taught)), pii.learn(taught.repartition(5).unionByName(first))]
    for selector in selectors:
        assert "(668) 555-2801" in [plain[a:b] for _, a, b in selector.added(plain, [])]
    assert selectors[0].threshold == selectors[1].threshold


def test_rare_matches_of_a_large_table_are_learned_from(spark, taught):
    empty = spark.range(1000, 40_000).selectExpr("id doc_id", "'nothing personal here' text")
    assert pii.learn(empty.unionByName(taught)).threshold == pii.learn(taught).threshold != {}


def test_spoken_addresses_do_not_depend_on_the_rest_of_the_text(taught):
    selector = pii.learn(taught)
    for value in ("john [AT] example [DOT] com", "john (AT) example.com", "john at example.com"):
        for text in (f"mail {value} now", f"mail {value} now, é", f"mail {value} now, dot by dot"):
            assert value in [text[a:b] for kind, a, b in pii.loose_matches(text) if kind == "email"], text
    plain, accented = "mail bob.smith [AT] example [DOT] com now", "mail bob.smith [AT] example [DOT] com now, café"
    assert selector.added(plain, []) == selector.added(accented, []) == [("email", 5, 37)]
    for text in ("look at example.com", "we met at home.Then we left", "stay at hotel.example.org dot 12"):
        assert selector.added(text, []) == []


def test_marks_find_the_matches_of_the_pattern():
    rng = random.Random(4)
    parts = [" at ", "[at]", "(AT)", "{At}", "at", " ", ".", " dot ", "[DOT]", "a", "bc", "é", "x" * 70, "y" * 63, "-", "at at "]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert list(pii._spoken(text)) == [m.span() for m in pii.SPOKEN.finditer(text)], text


def test_covered_stretches():
    rng = random.Random(4)
    for _ in range(300):
        spans = [("ip", a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 8)))]
        covered = pii._Covered(spans)
        for _ in range(30):
            a = rng.randrange(70)
            probe = ("ip", a, a + rng.randint(1, 6))
            apart = all(probe[2] <= s or e <= probe[1] for _, s, e in spans)
            assert covered.apart(probe) == apart
            if apart:
                covered.put(probe)
                spans.append(probe)


def test_all_matches_are_learned_from(spark, taught):
    numbers = ", ".join(str(10_000 + i) for i in range(3000))
    docs = taught.unionByName(spark.createDataFrame([(-3, numbers), (-4, "+12 34"), (-4, "+12 34")], "doc_id bigint, text string"))
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    wanted = sum(len(pii.strict_matches(text)) for _, text in texts)
    matches = pii.training_matches(docs)
    assert matches.count() == wanted > 3000
    counted = pii.example_counts(matches).where("strict").groupBy("kind").agg({"good": "sum", "bad": "sum"}).collect()
    assert sum(r["sum(good)"] + r["sum(bad)"] for r in counted) == wanted


def test_scans_on_spark_give_the_same_trees(taught, monkeypatch):
    monkeypatch.setattr(pii, "TREES", 3)
    here = pii.learn(taught)
    monkeypatch.setattr(pii, "LOCAL_ROWS", 0)
    there = pii.learn(taught.repartition(7))
    assert here.threshold == there.threshold != {}
    for name in ("feature", "cut", "value"):
        assert (getattr(here.trees, name) == getattr(there.trees, name)).all() and len(here.trees.value) == 3


def test_thresholds_are_the_smallest_sure_ones(spark, monkeypatch):
    rng = random.Random(5)
    for high in (40, 400):
        rows = [(kind, rng.randint(0, 20) / 20, rng.randint(0, high), rng.randint(0, 1)) for kind in pii.KINDS for _ in range(60)]
        rows += [("ip", 0.95, 5000, 0), ("card", 0.1, 5, 50)]
        monkeypatch.setattr(pii, "_probabilities", lambda *_: spark.createDataFrame(rows, "kind string, p double, good bigint, bad bigint").groupBy("kind", "p").agg(
            F.sum("good").alias("good"), F.sum("bad").alias("bad")))
        wanted = {}
        for kind in pii.KINDS:
            mine = [r[1:] for r in rows if r[0] == kind]
            for cut in sorted({0.5} | {p for p, good, _ in mine if p >= 0.5 and good}):
                right, wrong = (sum(r[i] for r in mine if r[0] >= cut) for i in (1, 2))
                if wrong <= (1 - pii.PRECISION) * (wrong + right):
                    wanted[kind] = cut
                    break
        assert pii.thresholds(None, None) == wanted
