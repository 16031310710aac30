"""Spelling variants: words that differ by exactly one inserted, deleted or replaced letter, and the form each belongs to.

*Reduced alphabet.* Every letter is hashed to one of eight symbols (its code point modulo 8, which tells the frequent letters apart).
One edit of a word changes its reduced word by at most one edit. The full one-edit neighbourhoods of the reduced
words are therefore joined with the reduced vocabulary, which finds every pair of near words. Each edge of the
neighbourhoods is generated from one end (an insertion is a deletion seen from the other word), some ``4.5 * length`` strings a word,
and a pair meets under one string only. The original words are compared in the join condition itself, so only
pairs that are near are ever passed on.

*Forms.* A word's form is its most frequent near word, if that is at least twice as frequent as the word. Frequencies
double along forms, so chains are short, and their ends are found by pointer doubling.

Scale: words are counted with Spark's partial aggregation, so a frequent word leaves a task as one row. The vocabulary
is a written table, a neighbourhood has some 40 short strings a word whatever the corpus, and the number of words
under one reduced word falls with every further letter. Nothing is broadcast by hint.

Edge cases: a null text has no words; a null id counts as the empty string where runs are hashed; texts of any length are
split inside their row; repeated rows count as often as they occur; ties are broken by code point order; an empty table gives an
empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.session import stage

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters that words may hold after lower-casing.
ALPHABET = LOWER + "".join(map(chr, range(0xC0, 0x100)))
SYMBOLS = "01234567"
MIN_LENGTH, MIN_COUNT = 5, 3
#: A form occurs at least so many times as often as its variant.
LEAD = 2
#: One run of this many (by hash) loses a letter, which plants misspellings.
SLIP = 97


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = SLIP) -> DataFrame:
    """``word``: every run of letters with A-Z in lower case; with ``slip``, runs whose CRC-32 it divides lose a letter."""
    lowered = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
                        F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("word"))
    if slip is None:
        return found.select("word")
    hashed = found.select("word", F.crc32(F.concat("_id", F.lit(":"), "word")).alias("_h"))
    at = (F.col("_h") % F.char_length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return hashed.select(F.when(F.col("_h") % slip == 0, cut).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    long_enough = words.where(F.char_length("word") >= MIN_LENGTH)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def reduced(word: str) -> Column:
    return F.translate(F.col(word), ALPHABET, "".join(SYMBOLS[ord(c) % len(SYMBOLS)] for c in ALPHABET))


def neighbourhood(code: str) -> Column:
    """The distinct strings one edit away from a reduced word, as far as they are this word's to generate, itself first.

    Being one edit apart goes both ways, so each pair of codes is generated from one end: a deletion by the
    longer code, a replacement by the code with the smaller symbol. Together the codes generate their full neighbourhoods.
    """
    w, size = F.col(code), F.char_length(code)
    head = lambda i: F.substring(w, F.lit(1), i)  # noqa: E731  the first i symbols
    tail = lambda i: F.substring(w, i + 1, size)  # noqa: E731  those behind the first i
    places = F.sequence(F.lit(0), size - 1)
    deleted = F.transform(places, lambda i: F.concat(head(i), tail(i + 1)))
    larger = lambda i: F.slice(F.array(*[F.lit(s) for s in SYMBOLS]), F.substring(w, i + 1, F.lit(1)).cast("int") + 2, F.lit(len(SYMBOLS)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(larger(i), lambda s: F.concat(head(i), s, tail(i + 1)))))
    return F.array_distinct(F.concat(F.array(w), deleted, replaced))


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every ordered pair of words that differ by exactly one edit. ``words`` has ``word, n``."""
    coded = words.withColumn("code", reduced("word"))
    around = coded.select("word", "n", F.posexplode(neighbourhood("code")).alias("_edit", "code"))
    known = coded.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("code").alias("_code"))
    once = (F.col("_edit") > 0) | (F.col("word") < F.col("near"))  # words of one code meet from both ends
    one_edit = F.levenshtein("word", "near", 1) == 1
    pairs = around.join(known, (F.col("code") == F.col("_code")) & once & one_edit)
    ends = F.array(F.struct("word", "n", "near", "near_n"),
                   F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(ends))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for the words of ``forms`` (``word, form``): the end of each chain, by pointer doubling."""
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("_word"), F.col("root").alias("_ahead"))
        moved = stage(now.join(ahead, F.col("root") == F.col("_word"), "left").select(
            "word", F.coalesce("_ahead", "root").alias("root"), F.col("_ahead").isNotNull().alias("_moved")), "spelling-roots")
        now = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return now


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = None) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``."""
    words = stage(vocabulary(runs(docs, id_col, text_col, slip)), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    known = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"),
        (-F.col("best.less")).alias("form_n")), "spelling-near")
    leads = F.col("form_n") >= LEAD * F.col("n")
    formed = known.select("word", "n", "n_near", F.when(leads, F.col("form")).alias("form"), F.when(leads, F.col("form_n")).alias("form_n"))
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
