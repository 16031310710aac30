import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from evalspark.llm import merkle


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """All levels, plainly."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H("".join(now[i:i + 2])) for i in range(0, len(now), 2)])
    return levels


def siblings(levels, slot):
    out = []
    for level in levels[:-1]:
        other = slot ^ 1
        out.append((other < slot, level[other]) if other < len(level) else None)
        slot //= 2
    return out


def expected(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    inner = {g: tree([leaf(r) for r in groups[g]]) for g in order}
    upper = tree([inner[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for slot, r in enumerate(groups[g]):
            path = siblings(inner[g], slot) + siblings(upper, at)
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                changed = (*r[:3], r[3] + 1, r[4])
            node = leaf(changed)
            for step in path:
                node = H(node if step is None else step[1] + node if step[0] else node + step[1])
            out.append((r[0], leaf(r), inner[g][-1][0], upper[-1][0], H("".join(s[1] for s in path if s)), node, node == upper[-1][0]))
    return out


def check(docs):
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    found = [tuple(r) for r in merkle.verify(docs).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(found, key=order) == sorted(expected(rows), key=order)
    return found


def made(spark, sizes):
    rows = [(i * 100 + len(lang or ""), "s", lang, i, f"text {i}") for lang, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)


def test_groups_of_all_sizes(spark):
    found = check(made(spark, {"a": 1, "bb": 2, None: 3, "dddd": 255, "é": 256, "ff": 257, "z": 1500}))
    assert 0 < sum(not r[-1] for r in found) < len(found)


def test_a_group_of_three_stretch_levels(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    check(made(spark, {"hot": 150, "b": 17, "c": 16}))


def test_one_group_and_one_row(spark):
    check(made(spark, {"a": 7}))
    (only,) = check(made(spark, {"a": 1}))
    assert only[1] == only[2] == only[3] and only[4] == H("")


def test_any_change_of_a_field_is_seen(spark):
    docs = made(spark, {"a": 40, "b": 3})
    rows = merkle.manifest(docs, keep={k: merkle.leaf([F.concat(F.col(c).cast("string"), F.lit("x")) if c == k else F.col(c) for c in merkle.FIELDS])
                                      for k in merkle.FIELDS})
    seen = rows.select(*[(merkle.fold(F.col(k)) == F.col("root")).alias(k) for k in merkle.FIELDS],
                       (merkle.fold(F.col("leaf")) == F.col("root")).alias("same")).collect()
    assert all(r["same"] and not any(r[k] for k in merkle.FIELDS) for r in seen)


def test_odd_rows(odd_documents, no_documents):
    check(odd_documents)
    assert merkle.verify(no_documents).count() == 0
