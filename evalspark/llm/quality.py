"""Quality classification by co-training of two views of a document.

The *text* view sees what is written: hashed word endings and word shapes (letter case, digits, marks), and how much
of it is said again.
The *metadata* view sees the record around it: language, source, stated length and layout (lines, their
lengths, repeats, shares of character classes). Each view is a logistic regression. They begin with labelled
rows; in every round each view labels the rows of an unlabelled pool that it is surest of, for the other
to learn from. At the end each view is calibrated on labelled rows that neither has learned from, and a
logistic combination of the two calibrated views, fitted there as well, scores every document. Its constant is
moved from the sample's share of good rows to the share among all labelled rows.

The classifiers are fitted on a bounded sample: at most ``LABELLED`` rows of each label and ``POOL`` rows
without, the first in hash order in each of four parts of the ids. Every document is scored on its whole text.

Edge cases: null text is empty, null metadata is a value of its own; a document is rejected only when
its score is below ``KEEP``; without rows of both labels there is nothing to learn and every document is
kept with score 1; several labels of an id are averaged; empty tables give empty results; repeated rows
are scored once each.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import batch, map_batches, utf8

LABELLED, POOL, PARTS = 2000, 3000, 4
ROUNDS, SHARE = 3, 0.1  # rounds, and the share of the pool each view labels per round and label
SURE = 0.9  # least probability of a pseudo-label
KEEP = 0.5
TEXT_WIDTH, LANGS, SOURCES = 1024, 16, 64
STEPS = 200


class WordFeatures(dict):
    """Two feature numbers of a word: its ending and its shape."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        half = TEXT_WIDTH // 2
        ending = xxhash.xxh32_intdigest(word[-3:]) % half
        shape = half + xxhash.xxh32_intdigest(_shape(word)) % half
        value = self[word] = ending << 16 | shape
        return value


SHAPES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def _shape(word: bytes) -> bytes:
    """Classes of the characters, runs as one: "Hello,!!" has the shape "Aa,!"."""
    out, last = bytearray(), -1
    for c in word[:64].translate(SHAPES):
        if c != last:
            out.append(c)
            last = c
    return bytes(out[:8])


def text_view(text: bytes, known: WordFeatures) -> np.ndarray:
    """Shares of word endings and shapes, on a square-root scale; shares of words that repeat the one before or
    the one before that, and the variety of words."""
    words = text.split()
    out = np.zeros(TEXT_WIDTH + 4, np.float32)
    if words:
        size = len(words)
        both = np.fromiter(map(known.__getitem__, words), np.int64, size)
        counts = np.bincount(both >> 16, minlength=TEXT_WIDTH) + np.bincount(both & 0xFFFF, minlength=TEXT_WIDTH)
        out[:TEXT_WIDTH] = np.sqrt(counts / size)
        again = [sum(map(operator.eq, words, words[gap:])) / size for gap in (1, 2)]
        distinct = len(set(words))
        out[TEXT_WIDTH:] = [*again, distinct / size, np.log(distinct + 1) / np.log(size + 1)]
    return out


DROP = {name: bytes(b for b in range(256) if b not in keep) for name, keep in {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32),
    "mark": {*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)}, "high": range(128, 256)}.items()}


def metadata_view(text: bytes, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(LANGS + SOURCES + 13, np.float32)
    out[xxhash.xxh32_intdigest(lang or "") % LANGS] = 1
    out[LANGS + xxhash.xxh32_intdigest(source or "") % SOURCES] = 1
    lines = text.split(b"\n")
    filled = [line for line in lines if line.strip()]
    size = max(1, len(text))
    out[LANGS + SOURCES:] = [
        n_chars is None, np.log1p(max(0, n_chars or 0)) / 10, np.log1p(len(text)) / 10, np.log1p(len(lines)) / 5,
        np.log1p(size / len(lines)) / 5, 1 - len(set(filled)) / max(1, len(filled)), len(filled) / len(lines),
        *[len(text.translate(None, drop)) / size for drop in DROP.values()],
    ]
    return out


class Logistic:
    """L2-regularised logistic regression, fitted by accelerated gradient steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
        z = (x - self.mean) / self.scale
        weigh = np.where(y > 0.5, 0.5 / max(1e-9, (y > 0.5).mean()), 0.5 / max(1e-9, (y <= 0.5).mean())).astype(np.float32)
        rows = len(y)
        step = 1 / (0.25 * float(weigh.max()) * self._largest(z) / rows + penalty + 0.25)
        w, b = np.zeros(z.shape[1], np.float32), 0.0
        ahead_w, ahead_b = w, b
        for turn in range(STEPS):
            slope = weigh * (_sigmoid(z @ ahead_w + ahead_b) - y)
            new_w = ahead_w - step * (z.T @ slope / rows + penalty * ahead_w)
            new_b = ahead_b - step * float(slope.mean())
            push = turn / (turn + 3)
            ahead_w, ahead_b = new_w + push * (new_w - w), new_b + push * (new_b - b)
            w, b = new_w, new_b
        self.w, self.b = w / self.scale, b - float(self.mean @ (w / self.scale))

    @staticmethod
    def _largest(z: np.ndarray) -> float:
        """The largest eigenvalue of the Gram matrix, by power steps."""
        v = np.ones(z.shape[1], np.float32) / np.sqrt(z.shape[1])
        size = 1.0
        for _ in range(12):
            v = z.T @ (z @ v)
            size = float(np.linalg.norm(v)) or 1.0
            v = v / size
        return 1.1 * size

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Combined:
    """Both views after co-training, and the calibrated combination."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, label: np.ndarray, held: np.ndarray, odds: float):
        """``odds``: good to bad among all labelled rows; the sample holds both in other numbers."""
        views = [text, meta]
        labelled, pool = ~np.isnan(label) & ~held, np.isnan(label)
        held = held & ~np.isnan(label)
        guess = [np.full(len(label), np.nan) for _ in views]  # labels a view has been given by the other
        for turn in range(ROUNDS + 1):
            models = []
            for view, own in zip(views, guess):
                y = np.where(labelled, label, own)
                rows = ~np.isnan(y) & ~held
                models.append(Logistic(view[rows], y[rows].astype(np.float32)))
            if turn == ROUNDS:
                break
            for k, (view, model) in enumerate(zip(views, models)):
                other = guess[1 - k]
                free = np.flatnonzero(pool & np.isnan(other))
                p = _sigmoid(model.margin(view[free]))
                most = max(1, int(SHARE * pool.sum()))
                for value, sure in ((1.0, p), (0.0, 1 - p)):
                    best = np.argsort(-sure, kind="stable")[:most]
                    other[free[best[sure[best] >= SURE]]] = value
        self.models = models
        self.calibrate = [self._line(m.margin(v[held])[:, None], label[held]) for v, m in zip(views, models)]
        both = np.stack([self._calibrated(k, v[held]) for k, v in enumerate(views)], axis=1)
        weights, constant = self._line(both, label[held])
        self.shift = float(np.log(odds / ((label[held] == 1).sum() / (label[held] == 0).sum())))
        self.join = weights, constant + self.shift

    @staticmethod
    def _line(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Logistic coefficients by Newton steps, pulled weakly to an even sum of the inputs."""
        start = np.append(np.full(x.shape[1], 1 / x.shape[1]), 0.0)
        x1, w = np.column_stack([x, np.ones(len(x))]), start.copy()
        for _ in range(25):
            p = _sigmoid(x1 @ w)
            hessian = x1.T @ (x1 * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(w))
            w -= np.clip(np.linalg.solve(hessian, x1.T @ (p - y) + 0.1 * (w - start)), -1, 1)
        return w[:-1], float(w[-1])

    def _calibrated(self, k: int, x: np.ndarray) -> np.ndarray:
        (a,), b = self.calibrate[k]
        return a * self.models[k].margin(x) + b

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality: combined, by text, by metadata."""
        sides = [self._calibrated(0, text), self._calibrated(1, meta)]
        w, b = self.join
        return _sigmoid(w[0] * sides[0] + w[1] * sides[1] + b), _sigmoid(sides[0] + self.shift), _sigmoid(sides[1] + self.shift)


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _known(docs: DataFrame) -> DataFrame:
    """The five columns that are used; those a table lacks are null."""
    types = dict(zip(COLUMNS, ("long", "string", "string", "string", "long")))
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def _labels(labels: DataFrame, label: str) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg(label)).cast("int").alias("y"))


def training_sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, y``: labelled ids with 0 or 1, pool ids with null; bounded per label."""
    mean = _labels(labels, label)
    ids = docs.select("doc_id").where("doc_id is not null").distinct().join(mean, "doc_id", "left")
    # In parts, since Spark lets tasks pass on only the first rows of a window when few (1,000) are asked for.
    order = Window.partitionBy("y", "_part").orderBy("_hash", "doc_id")
    placed = ids.withColumn("_hash", F.xxhash64("doc_id")).withColumn("_part", F.pmod("_hash", F.lit(PARTS))).withColumn(
        "_place", F.row_number().over(order)).where(F.col("_place") <= max(LABELLED, POOL) // PARTS)
    return placed.where(F.col("_place") <= F.when(F.col("y").isNull(), POOL // PARTS).otherwise(LABELLED // PARTS)).select("doc_id", "y")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Combined | None:
    docs = _known(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("text", pa.binary()), ("meta", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for part in batches:
            texts = utf8(part.column(1))
            views = zip(texts, *[part.column(i).to_pylist() for i in (2, 3, 4)])
            yield batch(schema, {"doc_id": part.column(0), "y": part.column(5),
                                 "text": [text_view(t, known).astype(np.float16).tobytes() for t in texts],
                                 "meta": [metadata_view(*v).tobytes() for v in views]})

    chosen = docs.join(F.broadcast(training_sample(docs, labels, label)), "doc_id").select(*COLUMNS, "y")
    rows = map_batches(chosen, task, "doc_id bigint, y int, text binary, meta binary").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([np.nan if r["y"] is None else float(r["y"]) for r in rows])
    held = np.array([xxhash.xxh32_intdigest(str(r["doc_id"])) % 4 == 0 for r in rows], bool)
    if any(not ((y == v) & s).any() for v in (0, 1) for s in (held, ~held)):
        return None
    text = np.stack([np.frombuffer(r["text"], np.float16) for r in rows]).astype(np.float32)
    meta = np.stack([np.frombuffer(r["meta"], np.float32) for r in rows])
    every = {r["y"]: r["n"] for r in _labels(labels, label).groupBy("y").agg(F.count("*").alias("n")).collect()}
    return Combined(text, meta, y, held, every[1] / every[0])


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("text_score", pa.float64()),
                    ("metadata_score", pa.float64()), ("keep", pa.bool_())])
SCORED_SQL = "doc_id bigint, score double, text_score double, metadata_score double, keep boolean"


def _views(part: pa.RecordBatch, at: list[int], known: WordFeatures) -> tuple[np.ndarray, np.ndarray]:
    texts = utf8(part.column(at[0]))
    rest = [part.column(i).to_pylist() if i >= 0 else [None] * len(texts) for i in at[1:]]
    return (np.stack([text_view(t, known) for t in texts]), np.stack([metadata_view(*v) for v in zip(texts, *rest)]))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: float = KEEP) -> DataFrame:
    """``doc_id, score, text_score, metadata_score, keep`` of every document."""
    known_docs = _known(docs)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for part in batches:
            if not part.num_rows:
                continue
            if shared.value is None:
                scores = [np.ones(part.num_rows)] * 3
            else:
                scores = shared.value.score(*_views(part, [1, 2, 3, 4], known))
            yield batch(SCORED, {"doc_id": part.column(0), "score": scores[0], "text_score": scores[1],
                                 "metadata_score": scores[2], "keep": scores[0] >= keep})

    return map_batches(known_docs, task, SCORED_SQL)


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: float = KEEP) -> DataFrame:
    """``docs``, with its own columns, without the rows whose score is below ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label))
    at = [docs.columns.index(c) if c in docs.columns else -1 for c in COLUMNS[1:]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for part in batches:
            if part.num_rows and shared.value is not None:
                part = part.filter(pa.array(shared.value.score(*_views(part, at, known))[0] >= keep))
            yield part

    return map_batches(docs, task, docs.schema)
