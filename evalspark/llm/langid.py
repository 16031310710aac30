"""Language identification by prediction by partial matching.

Each language has a context tree of variable order: the counts of the byte that follows every
context of up to ``ORDER`` bytes. A byte is coded in the longest context that has seen it; every
longer context that the language knows but in which the byte is new charges an escape (method C:
the escape count is the number of distinct followers, without exclusion). Below order 0 all 256
bytes are equally likely. Statistics are frozen after learning, so the code length of a text is an
exact sum over its bytes, and the language with the shortest code wins; the score is the share of
the winner in the probabilities of one byte (mean code length as the exponent, over at most
``EVIDENCE`` bytes, so that long texts do not all score 1).

The trees are learned from a bounded sample of labelled rows: per language at most
``SAMPLE_ROWS`` distinct rows and ``SAMPLE_BYTES`` bytes, taken in hash order. A text longer than one part in
``SHARES`` of the bytes takes part with ``STRETCHES`` stretches of that length in sum, spread from its beginning to its end,
so that no text uses up the bytes of the others. Rows of equal id and text count once. Code lengths of all
languages are laid out per context order as sorted tables, so that a batch of texts is scored
with a few vector look-ups per byte.

Edge cases: a text that is null or has no letter is ``und`` with score 0, and so is every text
when no labelled row exists; rows whose label is null are not learned from; an empty table gives an
empty result; equally short codes go to the language first in code-point order; repeated rows are predicted one by one;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import batch, map_batches, strings

ORDER = 4  # bytes of the longest context
SAMPLE_ROWS = 400  # per language
SAMPLE_BYTES = 400_000  # per language
SHARES = 20  # a text takes at most SAMPLE_BYTES / SHARES
STRETCHES = 10  # parts of a text that is longer
EVIDENCE = 32
UNKNOWN = "und"

FIELDS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


def _keys(data: np.ndarray, order: int) -> np.ndarray:
    """The (order + 1)-byte strings that end at each byte, as numbers. ``data`` is led by ORDER zeros."""
    n = len(data) - ORDER
    key = np.zeros(n, np.uint64)
    for back in range(order, -1, -1):
        key = (key << np.uint64(8)) | data[ORDER - back:ORDER - back + n].astype(np.uint64)
    return key


def _padded(text: bytes) -> np.ndarray:
    return np.frombuffer(b"\0" * ORDER + text, np.uint8)


class Places:
    """Where each of some sorted distinct numbers stands; vectorised look-ups by open addressing."""

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.place = np.full(1 << bits, -1, np.int32)
        self.key = np.zeros(1 << bits, np.uint64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]  # of several that want a slot the last one written has it
            won = self.place[slot] == left
            self.key[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.STEP) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 for numbers that are not there."""
        slot = self._slot(keys)
        out = self.place[slot]
        odd = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        slot = slot[odd]
        while len(odd):
            slot = (slot + 1) & self.mask
            out[odd] = self.place[slot]
            more = (out[odd] >= 0) & (self.key[slot] != keys[odd])
            odd, slot = odd[more], slot[more]
        return out


class Trees:
    """Frozen code lengths (bits) of all languages.

    ``grams[k]`` are the sorted (k+1)-byte strings that some language knows, ``costs[k]`` their code
    lengths per language; ``escapes[k]`` are the escape charges of the known contexts of k bytes (0
    for a language that does not know the context).
    """

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        width = len(self.langs)
        self.grams, self.costs, self.escapes = [], [], []
        self.gram_places, self.context_places = [], []
        self.floor = np.full(width, 8.0, np.float32)
        for order in range(ORDER + 1):
            seen = []
            for lang in self.langs:
                keys = [_keys(_padded(t), order) for t in texts[lang] if t]
                found, counts = np.unique(np.concatenate(keys), return_counts=True) if keys else (
                    np.zeros(0, np.uint64), np.zeros(0, np.int64))
                seen.append((found, counts))
            grams = np.unique(np.concatenate([f for f, _ in seen])) if seen else np.zeros(0, np.uint64)
            above = grams >> np.uint64(8)
            contexts = np.unique(above)
            place = np.searchsorted(contexts, above)
            escapes = np.zeros((len(contexts), width), np.float32)
            costs = self._lower(grams, order, width)  # what the shorter context charges
            for j, (found, counts) in enumerate(seen):
                at = np.searchsorted(grams, found)
                total = np.bincount(place[at], counts, len(contexts))
                distinct = np.bincount(place[at], minlength=len(contexts))
                known = total > 0
                escapes[known, j] = np.log2((total + distinct)[known] / distinct[known])
                costs[:, j] += escapes[place, j]
                costs[at, j] = np.log2((total + distinct)[place[at]] / counts)
            self.grams.append(grams)
            self.gram_places.append(Places(grams))
            self.context_places.append(Places(contexts))
            self.costs.append(costs.astype(np.float32))
            self.escapes.append(escapes)

    def _lower(self, grams: np.ndarray, order: int, width: int) -> np.ndarray:
        """Code lengths of the same bytes in the next shorter context."""
        if order == 0:
            return np.tile(self.floor, (len(grams), 1))
        short = grams & np.uint64((1 << (8 * order)) - 1)
        return self.costs[order - 1][np.searchsorted(self.grams[order - 1], short)].copy()  # every suffix is known

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Code length of every byte of ``data`` (led by ORDER zeros) in every language."""
        n = len(data) - ORDER
        out = np.zeros((n, len(self.langs)), np.float32)
        left = np.arange(n)
        full = _keys(data, ORDER)
        for order in range(ORDER, -1, -1):
            key = full[left] & np.uint64((1 << (8 * (order + 1))) - 1)
            at = self.gram_places[order].of(key)
            hit = at >= 0
            out[left[hit]] += self.costs[order][at[hit]]
            left, key = left[~hit], key[~hit]
            if not len(left):
                return out
            at = self.context_places[order].of(key >> np.uint64(8))
            known = at >= 0
            out[left[known]] += self.escapes[order][at[known]]
        out[left] += self.floor
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits per text and language, in blocks so that a long text needs bounded memory."""
        out = np.zeros((len(texts), len(self.langs)))
        data = np.frombuffer(b"".join(b"\0" * ORDER + t for t in texts), np.uint8)
        sizes = np.array([len(t) + ORDER for t in texts])
        owner = np.repeat(np.arange(len(texts)), sizes)
        lead = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < ORDER
        block = 1 << 18
        for start in range(ORDER, len(data), block):
            stop = min(len(data), start + block)
            bits = self.bits(data[start - ORDER:stop])
            bits[lead[start:stop]] = 0
            mine = owner[start:stop]
            heads = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            out[mine[heads]] += np.add.reduceat(bits.astype(np.float64), heads, axis=0)
        return out


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame:
    """Labelled rows to learn from: per language the first ``rows`` distinct ones (id and text) in hash order, up to ``size`` bytes in sum;
    of a long text stretches from its beginning to its end. Ranks move ids and hashes only, and copies meet in the tasks first;
    Spark keeps the first ``rows`` per task before the shuffle by language."""
    learn = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("_key", F.xxhash64("doc_id", "text"))
    order = Window.partitionBy("lang").orderBy("_hash", "doc_id", "_key")
    taken = F.least(F.octet_length("text"), F.lit(_share(size)))
    picked = (learn.groupBy("doc_id", "lang", "_key").agg(F.first(taken).alias("_size")).withColumn("_hash", F.xxhash64("doc_id"))
              .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows)
              .withColumn("_sum", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= size))
    found = learn.join(F.broadcast(picked.select("doc_id", "lang", "_key")), ["doc_id", "lang", "_key"], "left_semi")
    return found.select("doc_id", "lang", "_key", _stretches(_share(size)).alias("text")).dropDuplicates(["doc_id", "lang", "_key"]).select("lang", "text")


def _stretches(share: int) -> Column:
    """A text of at most ``share`` bytes; of a longer one STRETCHES parts, evenly spread, that have about as many bytes in sum."""
    length = F.length("text")
    part = F.greatest(F.lit(1), (F.lit(share // STRETCHES) * length / F.octet_length("text")).cast("int") - 1)
    starts = [1 + (F.lit(i) * (length - part) / max(1, STRETCHES - 1)).cast("int") for i in range(STRETCHES)]
    return F.when(F.octet_length("text") <= share, F.col("text")).otherwise(
        F.concat_ws("\n", *[F.substr(F.col("text"), start, part) for start in starts]))


def _share(size: int) -> int:
    return max(1, size // SHARES)


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Trees:
    texts: dict[str, list[bytes]] = {}
    for row in training_sample(docs, rows, size).toLocalIterator():  # bounded by the sample
        texts.setdefault(row["lang"], []).append(row["text"].encode()[:_share(size)])
    return Trees(texts)


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in batches:
            texts = strings(part.column(2))
            speaks = np.array([bool(model.langs) and any(map(str.isalpha, t)) for t in texts], bool)
            data = [t.encode() if s else b"" for t, s in zip(texts, speaks)]
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if speaks.any():
                bits = model.code_lengths(data)
                sizes = np.array([max(1, len(t)) for t in data])
                best = bits.argmin(axis=1)
                gap = (bits - bits.min(axis=1, keepdims=True)) * (np.minimum(sizes, EVIDENCE) / sizes)[:, None]
                share = 1 / np.exp2(-gap).sum(axis=1)
                pred = [model.langs[b] if s else UNKNOWN for b, s in zip(best, speaks)]
                score = np.where(speaks, share, 0.0)
            yield batch(FIELDS, {"doc_id": part.column(0), "held_out": part.column(1), "lang_pred": pred, "score": score})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return map_batches(rows, task, SCHEMA)


def identify(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame:
    """Learn from ``docs`` (``doc_id, text, lang``) and predict every row of it."""
    docs = docs.select("doc_id", "text", "lang")
    return predict(docs, learn(docs, rows, size))
